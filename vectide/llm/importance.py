"""Resampling of documents towards a target text by hashed n-gram features.

A document is scanned once, as its words with one space before each, and the
running CRC-32 after every word is stored. The CRC of any n-gram follows from
two of these prefixes: appending bytes to a prefix shifts its CRC by a linear
map over GF(2), so shifting the earlier prefix by the n-gram's length and
cancelling it from the later one leaves the CRC of the n-gram alone. Shifts by
powers of two are lookup tables; a length takes one lookup for each set bit.

A bucket's gain is the log ratio of its share in the target to its share in the
corpus. Documents are scored by their mean gain and keyed Gumbel noise, and the
best are drawn, which samples without replacement in proportion to the weights.

Every document comes back; undrawn ones have no rank. Null and empty texts have
no features and weight 0. Very long texts are read whole. A missing doc_id keys
its noise by the empty string and comes last among ties; repeated rows are drawn
one by one, equal scores and doc_ids in no set order. Other columns are ignored,
whatever their names. Without a target or documents all gains are 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import discard, materialise, slices
from vectide.llm.terms import WORDS_SQL, words

BUCKETS = 10_000
POLYNOMIAL = 0xEDB88320
_U = np.uint32


def _shift_tables(count: int) -> np.ndarray:
    """Tables ``[k, p, b]``: what byte b in place p of a CRC becomes when ``2 ** k`` zero bytes follow."""
    step = np.arange(256, dtype=_U)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ _U(POLYNOMIAL), step >> 1)
    single = np.arange(256, dtype=_U)[None, :] << (8 * np.arange(4, dtype=_U))[:, None]
    tables = [step[single & 255] ^ (single >> 8)]
    for _ in range(count - 1):
        tables.append(_through(tables[-1], tables[-1]))
    return np.stack(tables)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_SHIFT = _shift_tables(31)


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after ``length`` zero bytes each: the linear part of appending that many bytes."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = _through(_SHIFT[k], out[at])
    return out


def prefixes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Running CRCs and lengths of the document that has one space before each word: 0 first, then after each word."""
    crcs = np.fromiter(accumulate(found, lambda crc, word: crc32(word, crc32(b" ", crc)), initial=0), _U, len(found) + 1)
    ends = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=ends[1:])
    return crcs, ends


def ngram_crcs(crcs: np.ndarray, ends: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """CRC-32 of the n words from each of ``firsts`` on, joined by single spaces, from prefixes alone."""
    before = shift(crcs[firsts], np.ones(len(firsts), np.int64)) ^ _U(crc32(b" "))
    return crcs[firsts + n] ^ shift(before, ends[firsts + n] - ends[firsts] - 1)


def _features(text: str, width: int, buckets: int):
    """An Arrow function: words and n-gram buckets (16 bits each) of every row, beside the row's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [words(t.as_py().encode()) for t in batch.column(text)]
            counts = np.array([len(w) for w in found], np.int64)
            scans = [prefixes(w) for w in found]
            crcs, ends = (np.concatenate([s[k] for s in scans]) for k in (0, 1))
            base = np.cumsum(counts + 1) - counts - 1  # each document's first prefix
            grams, sizes = [], []
            for n in range(1, width + 1):
                have = np.maximum(counts - n + 1, 0)
                firsts = np.repeat(base - np.cumsum(have) + have, have) + np.arange(have.sum())
                grams.append((ngram_crcs(crcs, ends, firsts, n) % _U(buckets)).astype("<u2"))
                sizes.append(np.concatenate([[0], np.cumsum(have)]))
            own = [b"".join(g[s[i] : s[i + 1]].tobytes() for g, s in zip(grams, sizes, strict=True)) for i in range(len(found))]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts), pa.array(own, pa.binary())], [*(n for n in batch.schema.names if n != text), "n_words", "buckets"])

    return run


def _totals(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column("buckets"):
                total += np.bincount(np.frombuffer(own.as_buffer(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "count"])

    return run


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """How often each bucket is met: ``(bucket, count)``, summed inside tasks first."""
    return features.select("buckets").mapInArrow(_totals(buckets), "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def features(docs: DataFrame, text: str = "text", width: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Each row without its text, with ``n_words`` and ``buckets``: 16 bits for each n-gram of 1 to ``width`` words."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    kept = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(_features(text, width, buckets), f"{kinds}{', ' if kinds else ''}n_words long, buckets binary")


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Floored ``1000 * ln`` of smoothed target share over corpus share, an entry for each bucket."""
    both = corpus.select("bucket", F.col("count").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "count"))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    sums = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    out = np.zeros(buckets, np.int64)
    for row in every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[row.bucket] = row.gain
    return out


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b.as_buffer(), "<u2") for b in batch.column("buckets")]
            sizes = np.array([len(b) for b in own], np.int64)
            sums = np.array([gain[b].sum() for b in own], np.int64)
            weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """Rank by falling score, then doc_id: rows are cut into sorted ranges, and those before count first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = materialise(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each range, as many as shuffle partitions
    starts = ranges.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.join(F.broadcast(starts), "range").withColumn("rank", (own + F.col("before")).cast("long")).drop("range", "before")


def resample(documents: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; ``target`` has a column text."""
    own = materialise(features(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width=width, buckets=buckets))
    gain = gains(bucket_counts(own, buckets), bucket_counts(features(target.select("text"), width=width, buckets=buckets), buckets), buckets)
    weighed = own.mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weighed.select("*", (F.col("weight") + noise).cast("long").alias("score"), F.monotonically_increasing_id().alias("row")))
    discard(own)

    open_to = F.col("n_words") >= least_words
    # scores are whole numbers within a few times 10**4, so these are as few at any size
    levels = sorted(scored.where(open_to).groupBy("score").count().collect(), reverse=True)
    take, floor, seen = sum(r["count"] for r in levels) * percent // 100, None, 0
    for level in levels:
        if seen >= take:
            break
        floor, seen = level["score"], seen + level["count"]
    near = open_to & (F.col("score") >= floor) if floor is not None else F.lit(False)
    ranked = _numbered(scored.where(near)).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the hexadecimal form of each distinct word
ORACLE = rf"""WITH RECURSIVE steps AS (SELECT range AS b, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
  tab AS (SELECT list(c ORDER BY b) AS tab FROM steps WHERE k = 8),
  docs AS (SELECT row_number() OVER () AS n, doc_id, {WORDS_SQL} AS w FROM documents),
  dw AS (SELECT n, word, count(*) AS c FROM (SELECT n, unnest(w) AS word FROM docs) GROUP BY n, word),
  tw AS (SELECT word, count(*) AS c FROM (SELECT unnest({WORDS_SQL}) AS word FROM benchmark) GROUP BY word),
  spelt AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
  crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM spelt, tab),
  sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM (SELECT word, c AS s, 0 AS t FROM dw UNION ALL SELECT word, 0, c FROM tw) JOIN crc USING (word) GROUP BY bucket),
  gain AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
  per AS (SELECT n, CAST(sum(c) AS BIGINT) AS f, CAST(sum(c * gain) AS BIGINT) AS g FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY n),
  weighed AS (SELECT n, doc_id, coalesce(f, 0) AS n_features, CASE WHEN f > 0 THEN CAST((g - ((g % f) + f) % f) // f AS BIGINT) ELSE 0 END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN per USING (n)),
  scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
  drawn AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () * 10 // 100 AS most FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM scored LEFT JOIN drawn USING (n)"""
