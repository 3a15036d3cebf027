"""MinHash fingerprints of documents, their likeness, and near pairs by bands.

A fingerprint holds 128 minima of universal hashes over five-word shingles, 16
bits of each. The share of equal minima estimates the Jaccard likeness of two
texts with a standard error of at most 0.045. Bands of eight minima are joined
in Spark; whoever meets in a band is compared on the full sets, so groups of
near-duplicates hold verified links only. A pair at the threshold of 0.8 meets
in one of 16 bands with probability 0.95, one at 0.9 with 0.9999.

A null text counts as empty; an empty text has no shingles, and its fingerprint
equals only that of other texts without words. Very long texts are read whole. Ties of doc_id are ordered by
the length of their text; every row gives one row. Rows without a doc_id come last in that
order and are in no group. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.chosen_path import confirm, merge, tile_links
from vectide.llm.common import SLICE_BYTES, discard, lists, materialise, minhashes, shingle_hashes, slices

HASHES = 128
BANDS = 16
DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_group long"
PACKED = "doc_id long, size long, packed binary"
#: Stands for a missing doc_id in the order of documents.
LAST = -(1 << 63)
OWN, HALO, GROUP = 0, 1, 2


def fingerprint_rows(texts: pa.LargeStringArray, width: int = 5, count: int = HASHES) -> np.ndarray:
    """The fingerprints of a column of texts, a row of 16-bit numbers each."""
    return minhashes(*shingle_hashes(texts, width), count).astype(">u2")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they move whole, and most of what moves is text."""
    codec = pa.Codec("zstd")
    for part in slices(batches, "text"):
        text = part.column("text").cast(pa.large_binary())
        packed = [codec.compress(t, asbytes=True) for t in (x.as_buffer() for x in text)]
        sizes = [len(x.as_buffer()) for x in text]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "size", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Lists of the columns and the text, of about a megabyte of text."""
    codec = pa.Codec("zstd")
    held, size = [], 0
    for batch in batches:
        for *row, packed, n in zip(*(batch.column(c).to_pylist() for c in (*columns, "packed", "size"))):
            held.append((*row, codec.decompress(packed, n, asbytes=True).decode() if n else ""))
            size += n
            if size > SLICE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _unpacked(batches, ("doc_id",)):
        ids, texts = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def _marks_of(texts: list[str]) -> np.ndarray:
    made = [fingerprint_rows(s.column("text")) for s in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])]), "text")]
    return np.concatenate(made) if made else np.zeros((0, HASHES), dtype=">u2")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket; of each first what is known of groups, then documents by falling doc_id, then the halo."""
    kept: tuple | None = None
    groups: dict[int, int] = {}
    now = None
    for rows in _unpacked(batches, ("bucket", "kind", "doc_id", "near_group")):
        docs = []
        for bucket, kind, doc, group, text in rows:
            if bucket != now:
                now, groups = bucket, {}
            if kind == GROUP:
                groups[doc] = group
            else:
                docs.append((bucket, kind, doc, groups.get(doc, doc), text))
        if not docs:
            continue
        marks = list(_marks_of([d[4] for d in docs]))
        seen = [(*d, m) for d, m in zip(docs, marks)]
        if kept is not None:
            seen.insert(0, kept)
        kept = seen[-1]
        # a document's successor is the next row of its bucket; of the halo only the first row is one
        pairs = [(x, y) for x, y in zip(seen, seen[1:]) if x[0] == y[0] and x[1] == OWN]
        if not pairs:
            continue
        edited = [x[4][: len(x[4]) - len(x[4]) // 3] + y[4][: len(x[4]) // 3] for x, y in pairs]
        own, after, changed = np.stack([x[5] for x, _ in pairs]), np.stack([y[5] for _, y in pairs]), _marks_of(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[2] for x, _ in pairs], pa.int64()),
                pa.array([len(x[4]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([m.tobytes().hex() for m in own]),
                pa.array([m.tobytes().hex() for m in changed]),
                pa.array((own == changed).mean(axis=1)),
                pa.array((own == after).mean(axis=1)),
                pa.array([x[3] for x, _ in pairs], pa.int64()),
            ],
            names=[c.split()[0] for c in DIGEST.split(", ")],
        )


def digests(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document, and its near group.

    The next document is the one with the next smaller doc_id, and after the
    smallest the largest. Documents move once, into ranges of doc_id; only the
    first of each range is also sent to the range before it. near_group is the
    smallest doc_id that verified links of ``percent`` reach.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(thin.approxQuantile("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 0.1 / parts)))
    order = F.coalesce("doc_id", F.lit(LAST))
    slot = F.aggregate(F.lit(cuts).cast("array<double>"), F.lit(0), lambda n, cut: n + F.when(order > cut, 1).otherwise(0)) if cuts else F.lit(0)
    heads = sorted((r.bucket, r.head) for r in thin.select(slot.alias("bucket"), order.alias("head")).groupBy("bucket").agg(F.max("head").alias("head")).collect())
    # the row that follows a bucket's last one is the head of the bucket below, or of the highest
    halo = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    to = F.array(F.struct(slot.alias("bucket"), F.lit(OWN).alias("kind")))
    if halo:
        below = F.create_map(*[x for head, bucket in halo.items() for x in (F.lit(head).cast("long"), F.lit(bucket))])[order]
        to = F.when(below.isNotNull(), F.array(F.struct(slot.alias("bucket"), F.lit(OWN).alias("kind")), F.struct(below.alias("bucket"), F.lit(HALO).alias("kind")))).otherwise(to)
    groups = near_groups(thin, percent).where("id <> component")
    told = groups.select(F.col("id").alias("doc_id"), F.col("component").alias("near_group")).withColumn("bucket", slot)
    told = told.select("bucket", F.lit(GROUP).alias("kind"), "doc_id", "near_group", F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("packed"))
    dealt = thin.mapInArrow(_packed, PACKED).withColumn("to", F.explode(to))
    dealt = dealt.select("to.bucket", "to.kind", "doc_id", F.lit(None).cast("long").alias("near_group"), "size", "packed")
    ordered = dealt.unionByName(told).repartition(parts, "bucket").sortWithinPartitions("bucket", F.expr(f"(kind + 1) % {GROUP + 1}"), F.desc("doc_id"), "size", "packed")
    return ordered.mapInArrow(_digests, DIGEST)


def _bands(batches: Iterator[pa.RecordBatch], width: int, bands: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        shingles, limits = shingle_hashes(part.column("text"), width)
        marks = minhashes(shingles, limits, HASHES).reshape(part.num_rows, bands, -1).astype(np.uint64)
        keys = np.zeros(marks.shape[:2], dtype=np.uint64)
        for k in range(marks.shape[2]):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + marks[:, :, k]
        keys += np.arange(bands, dtype=np.uint64)
        full = pa.array(np.diff(limits) > 0)
        columns = [part.column("id"), pa.array(np.diff(limits)), part.column("text_a"), part.column("text_b"), lists(keys.view(np.int64), bands, pa.int64())]
        yield pa.RecordBatch.from_arrays([c.filter(full) for c in columns], names=["id", "n", "text_a", "text_b", "bands"])


def near_groups(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = BANDS) -> DataFrame:
    """``(id, component)``: documents that share a band with one alike, and equal texts.

    Equal texts take part once. In each band all members are tried against the
    smallest id first, with links confirmed on full sets. The members of bands
    that still hold more than one component are then compared with each other,
    in bounded tiles. Rows of one doc_id are one document. Whole texts move
    compressed, and what was written on the way is removed at the end.
    """
    text = F.col("text").cast("string")
    thin = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_a"), F.crc32(F.encode(text, "UTF-8")).alias("text_b"))
    marks = thin.mapInArrow(partial(_bands, width=width, bands=bands), "id long, n long, text_a long, text_b long, bands array<long>")
    same = ["text_a", "text_b", "n"]
    classes = materialise(marks.groupBy(*same).agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")))
    marks = classes.select("id", "n", F.explode("bands").alias("band"))
    first = marks.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("many")).where("many > 1").drop("many")
    met = materialise(marks.join(first, "band"))
    # a sorted join whatever the sizes: what moves grows with the documents, and evenly
    packed = thin.select(F.col("id").alias("doc_id"), "text").mapInArrow(_packed, PACKED)
    wanted = met.select(F.col("id").alias("doc_id")).distinct()
    texts = materialise(packed.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_restored, "id long, text string"))
    pairs = met.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    judged = materialise(confirm(pairs, texts, width, percent))
    linked = judged.where("linked").select("a", "b").distinct()
    told = met.join(linked.select("a", F.col("b").alias("id"), F.lit(True).alias("led")), ["a", "id"], "left")
    told = told.select(F.col("band").alias("path"), "id", "n", F.when(F.col("led"), F.col("a")).otherwise(F.col("id")).alias("home"), "a")
    mixed = told.where("home <> a").select("path").distinct()
    open_ = materialise(told.join(mixed, "path", "left_semi").drop("a").withColumn("sketch", F.array().cast("array<long>")))
    copies = thin.select("id", "text_a", "text_b").join(classes.select("text_a", "text_b", F.col("id").alias("a")), ["text_a", "text_b"]).where("id <> a")
    found = merge(None, linked.union(tile_links(open_, texts, width, percent)).union(copies.select("a", F.col("id").alias("b"))))
    discard(classes, met, texts, judged, open_)
    return found
