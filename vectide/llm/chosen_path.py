"""Near-duplicate detection by a chosen-path set similarity join.

Each text becomes its set of word shingles and a row of minwise tokens. A tree
branches every document by a few tokens chosen by the node itself; documents
that agree on a token meet in a child. Small nodes are compared exhaustively,
larger ones branch again with other tokens. Independent trees raise the recall:
with three branches and three trees a pair at the threshold of 0.85 is missed
at the first level with probability 0.15**9, about 4e-8. Below the root a node
takes one token, and now and then a second one, so that a pair at the threshold
meets in one child or more on average while pairs below it thin out from level
to level, however large their group is.

Four things keep it whole at scale. Equal sets collapse first and take part
once. In every node all members are tried against the smallest id, and
components are carried along: a node whose members are all in one component is
closed, so a group of thousands of near copies costs one comparison each.
Of an open node that is small, only documents whose sketch comes near one of
another component are compared; their texts are sent once a node, and pairs
are counted inside the task, in which links found make others needless. A node
that is still large at the last level is compared in blocks, without a cap.
Every link is confirmed on the full sets.

Nulls and empty texts have no shingles and are linked with nothing. Rows of one
doc_id are one document, linked with what any of its texts is linked with; rows
without a doc_id are judged too, and their component_id is the smallest doc_id
that they reach, or null. Ties, pairs exactly at the threshold, are linked; of equal
sets the smallest doc_id leads. Very long texts are read whole. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import discard, lists, materialise, minhashes, shingle_hashes, slices
from vectide.llm.components import components

TOKENS = 32
BITS = 256
SKETCH = [f"bits_{k}" for k in range(BITS // 64)]
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, tokens array<int>, " + ", ".join(f"{c} long" for c in SKETCH)
#: Documents that are compared in one task; shingles in them; and how few documents are compared whatever they hold.
SMALL, WEIGHT, FEW = 2048, 1 << 21, 8
#: Bytes of shingle bits held at once by a comparison.
BITMAP = 96 << 20


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        shingles, limits = shingle_hashes(part.column("text"), width)
        least = minhashes(shingles, limits, BITS)
        rows = part.num_rows
        size, key_a, key_b = (np.zeros(rows, dtype=np.uint64) for _ in range(3))
        for i in range(rows):
            own = np.unique(shingles[limits[i] : limits[i + 1]])
            size[i] = len(own)
            key_a[i] = own.sum(dtype=np.uint64)
            key_b[i] = (own * (own >> np.uint64(7))).sum(dtype=np.uint64)
        low = np.packbits((least & 1).astype(np.uint8), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                *(pa.array(x.view(np.int64)) for x in (size, key_a, key_b)),
                lists(least[:, :TOKENS].view(np.int32), TOKENS, pa.int32()),
                *(pa.array(low[:, k]) for k in range(len(SKETCH))),
            ],
            names=["doc_id", "n_shingles", "set_a", "set_b", "tokens", *SKETCH],
        )


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """Set size, set hash, minwise tokens and a 256-bit sketch of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_signatures, width=width), SIGNATURE)


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.concat_arrays([batch.column(k).cast(pa.large_string()) for k in (2, 3)]).dictionary_encode()
        sets = []  # of each different text once
        for part in slices(iter([pa.RecordBatch.from_arrays([texts.dictionary], names=["text"])]), "text"):
            shingles, limits = shingle_hashes(part.column("text"), width)
            sets += [np.unique(shingles[i:k]) for i, k in zip(limits, limits[1:])]
        at = texts.indices.to_pylist()
        linked = []
        for i, k in zip(at, at[batch.num_rows :]):
            x, y = sets[i], sets[k]
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``(a, b, linked)``: each pair judged on the full shingle sets of its texts."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(partial(_confirm, width=width, percent=percent), "a long, b long, linked boolean")


def _children(path: Column, tree: Column, branches: int, chance: int = 100) -> Column:
    """The tokens that a node chooses, as an array of child paths of a row; all but the first with a chance in a hundred."""
    start, stride = F.pmod(F.xxhash64(path, tree, F.lit(1)), F.lit(TOKENS)), F.pmod(F.xxhash64(path, tree, F.lit(2)), F.lit(TOKENS // 2)) * 2 + 1
    picks = [F.pmod(start + stride * k, F.lit(TOKENS)).cast("int") for k in range(branches)]
    chosen = [F.xxhash64(path, tree, p, F.element_at("tokens", p + 1)) for p in picks]
    if chance == 100:
        return F.array(*chosen)
    return F.when(F.pmod(F.xxhash64(path, tree, F.lit(3)), F.lit(100)) < chance, F.array(*chosen)).otherwise(F.array(chosen[0]))


def links(docs: DataFrame, sigs: DataFrame, percent: int, width: int = 5, branches: int = 3, trees: int = 3, depth: int = 24, small: int = SMALL) -> DataFrame:
    """``(id, component)`` of the documents that have at least one link.

    sigs: signatures of documents with different, non-empty sets. The root has
    ``branches`` children in each tree, other nodes one or two.
    """
    j = percent / 100
    most = int(BITS * (1 - j) / 2 + 4.5 * (BITS * (1 - j) / 2 * (1 + j) / 2) ** 0.5)
    apart_bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"o.{SKETCH[0]}"))))
    alike = (apart_bits <= most) & (F.least("n", "o.n") * 100 >= F.greatest("n", "o.n") * percent)
    base = sigs.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *SKETCH, "tokens")
    # home: the component that the document is known to be in; itself at first
    roots = base.withColumn("home", F.col("id")).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("path", F.lit(0).cast("long"))
    rows = roots.withColumn("path", F.explode(_children(F.col("path"), F.col("tree"), branches)))
    texts = known = None
    leaves = []
    me = ["id", "n", *SKETCH, "home"]
    fits = ((F.col("size") <= small) & (F.col("weight") <= WEIGHT)) | (F.col("size") <= min(FEW, small))
    for level in range(1, depth + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min(F.struct(*me)).alias("o")).where("size > 1")
        met = materialise(rows.drop("tokens").join(sizes, "path"))
        leads = materialise(met.where("home <> o.home").where(alike).select(F.col("o.id").alias("a"), F.col("id").alias("b")).distinct())
        if texts is None:
            some = _beside(met.drop("o").where(fits), alike).select("id")
            wanted = leads.select(F.explode(F.array("a", "b")).alias("id")).union(some).union(met.where(~fits).select("id"))
            texts = materialise(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(wanted.distinct(), "id", "left_semi"))
        known = merge(known, confirm(leads, texts, width, percent).where("linked").select("a", "b"))
        told = at_home(met.drop("o"), known)
        mixed = told.groupBy("path").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low < high").select("path")
        apart = materialise(told.join(mixed, "path"))
        discard(met, leads)
        leaves.append(apart.where(fits))
        big = apart.where(~fits)
        if big.isEmpty():
            break
        if level == depth:
            leaves.append(big)
            break
        grown = big.select("path", "tree", "id", "home").join(base, "id")
        chance = -(-10000 // percent) - 100 + 7  # one child at the threshold, and some to spare
        rows = materialise(grown.withColumn("path", F.explode(_children(F.col("path"), F.col("tree"), 2, chance))))
    near = leaves[0]
    for more in leaves[1:]:
        near = near.unionByName(more)
    near = _beside(at_home(near, known), alike)
    return merge(known, tile_links(near.withColumn("sketch", F.array(*SKETCH)), texts, width, percent, most, small))


def tile_links(near: DataFrame, texts: DataFrame, width: int, percent: int, most: int = BITS, small: int = SMALL) -> DataFrame:
    """Links ``(a, b)`` among all documents of each ``path`` with different homes.

    near: path, id, n (shingles), home, and sketch, whose documents more than
    ``most`` bits apart are no candidates (an empty one excludes none). A path
    of more than ``small`` documents is compared in pairs of bounded blocks.
    """
    rows = near.select("path", "id", "n", "home", "sketch").dropDuplicates(["path", "id"])
    sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    half = max(1, small // 2)
    blocks = F.when((F.col("size") <= small) & (F.col("weight") <= WEIGHT), 1).otherwise(F.ceil(F.greatest(F.col("size") / half, F.least(F.col("weight") / (WEIGHT // 2), F.col("size"))))).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiled = rows.join(sizes.select("path", blocks.alias("blocks")), "path").withColumn("own", own)
    tiles = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("block"), "id", "home", "sketch")
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = tiles.join(texts, "id").select("tile", "block", "id", "home", "sketch", "text").repartition(parts, "tile").sortWithinPartitions("tile")
    return filled.mapInArrow(partial(_tiles, width=width, percent=percent, most=most), "a long, b long")


def at_home(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the component of each document as its home."""
    return rows.drop("home").join(known, "id", "left").withColumn("home", F.coalesce("component", "id")).drop("component")


def _beside(rows: DataFrame, alike: Column) -> DataFrame:
    """The rows with another row in their node that passes the sketch and has another home."""
    o = rows.select(F.col("path").alias("__path"), F.struct("id", "n", *SKETCH, "home").alias("o"))
    return rows.join(o, (F.col("path") == F.col("__path")) & (F.col("home") != F.col("o.home")) & alike, "left_semi")


def merge(known: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components of what is known and new links ``(a, b)``."""
    edges = new if known is None else new.union(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return materialise(components(edges))


def _tiles(batches: Iterator[pa.RecordBatch], width: int, percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links among the documents of each tile; rows come sorted by tile."""
    held: list[tuple] = []
    now = None
    for part in slices(batches, "text"):
        shingles, limits = shingle_hashes(part.column("text"), width)
        marks = zip(*(part.column(c).to_pylist() for c in ("tile", "block", "id", "home", "sketch")))
        for i, (tile, *mark) in enumerate(marks):
            if tile != now:
                yield _forest(held, percent, most)
                held, now = [], tile
            held.append((*mark, np.unique(shingles[limits[i] : limits[i + 1]])))
    yield _forest(held, percent, most)


def _candidates(held: list[tuple], percent: int, most: int) -> np.ndarray:
    """Pairs of rows of different homes whose sizes and sketches allow a link, nearest first."""
    block, home, size = (np.array(x) for x in zip(*((h[0], h[2], len(h[4])) for h in held)))
    bits = np.array([h[3] for h in held], dtype=np.int64).view(np.uint64).reshape(len(held), -1)
    found, far = [], []
    for i in range(len(held) - 1):
        rest = slice(i + 1, None)
        ok = (home[rest] != home[i]) & (np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * percent)
        if block[i] >= 0:  # two blocks: each has been compared within itself elsewhere
            ok &= block[rest] != block[i]
        k = np.flatnonzero(ok)
        apart = np.bitwise_count(bits[i + 1 + k] ^ bits[i]).sum(axis=1, dtype=np.int64)
        k, apart = k[apart <= most], apart[apart <= most]
        found.append(np.stack([np.full(len(k), i, dtype=np.int32), (i + 1 + k).astype(np.int32)], axis=1))
        far.append(apart.astype(np.uint16))
    if not found:
        return np.zeros((0, 2), dtype=np.int32)
    order = np.argsort(np.concatenate(far), kind="stable").astype(np.int32)
    del far
    return np.concatenate(found)[order]


def _common(pairs: np.ndarray, sets: list[np.ndarray], bitmap: np.ndarray | None) -> np.ndarray:
    """How many shingles the sets of each pair share."""
    if bitmap is None:
        return np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for i, k in pairs], dtype=np.int64)
    step = max(1, (16 << 20) // max(1, bitmap.shape[1] * 8))
    parts = [np.bitwise_count(bitmap[p[:, 0]] & bitmap[p[:, 1]]).sum(axis=1, dtype=np.int64) for p in (pairs[a : a + step] for a in range(0, len(pairs), step))]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _bitmap(sets: list[np.ndarray]) -> np.ndarray | None:
    """A row of bits for each set, a bit for each shingle that several sets hold; None where it would be too large."""
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    words = -(-int((count > 1).sum()) // 64)
    if words * 8 * len(sets) > BITMAP:
        return None
    out = np.zeros((len(sets), words * 8), dtype=np.uint8)
    at = 0
    for i, own in enumerate(sets):
        mine = code[at : at + len(own)]
        at += len(own)
        row = np.zeros(words * 64, dtype=bool)
        row[number[mine[count[mine] > 1]]] = True
        out[i] = np.packbits(row)
    return out.view(np.uint64)


def _forest(held: list[tuple], percent: int, most: int) -> pa.RecordBatch:
    """Edges that join documents whose full sets are linked; pairs that others have joined are passed over."""
    edges = []
    pairs = _candidates(held, percent, most) if len(held) > 1 else np.zeros((0, 2), dtype=np.int32)
    if len(pairs):
        sets = [h[4] for h in held]
        bitmap, size = _bitmap(sets), np.array([len(x) for x in sets])
        _, root = np.unique([h[2] for h in held], return_inverse=True)
        step = 64
        while len(pairs):
            now, pairs = pairs[:step], pairs[step:]
            both = _common(now, sets, bitmap)
            for i, k in now[100 * both >= percent * (size[now].sum(axis=1) - both)]:
                if root[i] != root[k]:
                    edges.append((held[i][1], held[k][1]))
                    root[root == root[k]] = root[i]
            pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
            step = min(2 * step, 1 << 16)
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, **tree: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each document.

    Documents are linked if ``100 * intersection >= percent * union`` of their
    shingle sets; component_id is the smallest doc_id that links reach, and
    kept says whether that is the document itself.
    """
    sigs = materialise(signatures(docs, width))
    ids = sigs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.rows != ids.ids:  # rows without a doc_id, or with one doc_id
        return _by_rows(docs, percent, width, **tree)
    filled = sigs.where("n_shingles > 0")
    classes = materialise(filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = materialise(filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    found = links(docs, reps, percent, width, **tree)
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _by_rows(docs: DataFrame, percent: int, width: int, **tree: int) -> DataFrame:
    """``near_duplicates`` where doc_ids repeat or are missing: rows are linked by keys of their own, and through their doc_ids."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")))
    found = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), percent, width, **tree)
    told = materialise(found.withColumnRenamed("doc_id", "key").join(rows.select("key", "id"), "key").select("id", "n_shingles", "component_id"))
    # a component of rows is named by its smallest doc_id; doc_ids join such components
    first = told.groupBy("component_id").agg(F.min("id").alias("name"))
    named = told.join(first, "component_id")
    whole = components(named.where("id <> name").select(F.col("id").alias("a"), F.col("name").alias("b")).distinct())
    out = named.join(whole.select(F.col("id").alias("name"), "component"), "name", "left")
    component = F.coalesce("component", "name")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
