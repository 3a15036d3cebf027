"""Ranked lexical search with hashed max-sketches.

The index holds a row for each document: its number of terms, its distinct terms
with their counts, and a sketch. The sketch hashes every term to one of 1024
coordinates and keeps the largest count of each. A term's impact rises with its
count, so the largest count gives the largest impact of a coordinate once the
document's length factor is known, and the weighted impacts of the coordinates
of a query's terms add up to no less than the document's score.

1. Lookup. A batch of documents meets a block of queries in one product of
   impacts and query weights: an upper bound for each pair.
2. Rescoring. For each query a task takes its documents by falling bound and
   scores them exactly from their counts, until the bound falls below the k-th
   best score known so far. The first such score comes from a few thousand
   documents that are searched beforehand.
3. Merge. Tasks hand on at most k documents a query; the best k of them stay.

Queries go in blocks of bounded size, whatever their number. Every row of the
queries is one of its own, repeated ones as well. Null and empty texts have no
terms and are never found; a query without known terms finds nothing. Very long
texts are read whole. Equal scores are ordered by doc_id, a missing one last.
Other columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import discard, materialise, slices
from vectide.llm.terms import WORDS_SQL, words

WIDTH = 1024
#: A count of 255 in a sketch stands for that many and more.
FULL = 255
#: No impact reaches this: ``1e9 * tf / (1000 * tf + 20 * m)`` stays below ``1e6``.
TOP = 10**6
LAST = 1 << 62
ROWS, SEED_ROWS = 2048, 4096
BLOCK_TERMS, BLOCK_ITEMS = 50_000, 512


def coordinate(term: bytes) -> int:
    """The coordinate of a sketch that a term belongs to."""
    return crc32(term) % WIDTH


def sketch(counts: dict[bytes, int]) -> bytes:
    """The largest count of each coordinate, a byte each."""
    out = np.zeros(WIDTH, np.uint8)
    if counts:
        at = np.fromiter(map(crc32, counts), np.uint32, len(counts)) % WIDTH
        np.maximum.at(out, at, np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), FULL).astype(np.uint8))
    return out.tobytes()


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [words(t.as_py().encode()) for t in batch.column("text")]
        counts = [Counter(w) for w in found]
        columns = {
            "doc_id": batch.column("doc_id"),
            "n": pa.array([len(w) for w in found], pa.int64()),
            "sketch": pa.array([sketch(c) for c in counts], pa.binary()),
            "terms": pa.array([b" ".join(c).decode() for c in counts], pa.string()),
            "counts": pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
        }
        yield pa.RecordBatch.from_pydict(columns)


def index(documents: DataFrame) -> DataFrame:
    """The written index: doc_id, n, sketch, terms (joined by spaces) and their counts, for each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(docs.mapInArrow(_indexed, "doc_id long, n long, sketch binary, terms string, counts array<long>"))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [[w.decode() for w in dict.fromkeys(words(t.as_py().encode()))] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["item", "item_id", "terms"])


def _merged(top: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item, first among parts of them."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return top


def _searching(queries: dict[int, list[tuple[str, int]]], floors: dict[int, int], k: int, stats: bool = False):
    """An Arrow function: the best k of the index rows it reads, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted(queries)
        terms = [[(t.encode(), w) for t, w in queries[i]] for i in items]
        matrix = np.zeros((WIDTH, len(items)))
        for q, own in enumerate(terms):
            for term, w in own:
                matrix[coordinate(term), q] += w
        floor = np.array([floors.get(i, 1) for i in items], np.int64)
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        pairs = scored = 0
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                m = batch.column("m").to_numpy(zero_copy_only=False)
                tf = np.frombuffer(b"".join(s.as_py() for s in batch.column("sketch")), np.uint8).reshape(-1, WIDTH).astype(np.int64)
                impact = np.where(tf == FULL, TOP, 10**9 * tf // (1000 * tf + 20 * m[:, None]))
                bound = impact.astype(np.float64) @ matrix  # whole numbers below 2**53, so sums are exact
                doc_ids, known = batch.column("doc_id").to_pylist(), {}
                pairs += bound.size
                near = bound >= floor
                for q in np.flatnonzero(near.any(axis=0)):
                    rows = np.flatnonzero(near[:, q])
                    for row in rows[np.argsort(-bound[rows, q])]:
                        if bound[row, q] < floor[q]:
                            break
                        if row not in known:
                            known[row] = dict(zip(batch.column("terms")[row].as_py().encode().split(), batch.column("counts")[row].as_py(), strict=True))
                        own, length, score = known[row], 20 * int(m[row]), 0
                        for term, w in terms[q]:
                            count = own.get(term)
                            if count:
                                score += w * (10**9 * count // (1000 * count + length))
                        scored += 1
                        if score >= floor[q]:
                            insort(best[q], (-score, LAST if doc_ids[row] is None else doc_ids[row]))
                            if len(best[q]) >= k:
                                del best[q][k:]
                                floor[q] = max(floor[q], -best[q][-1][0])
        if stats:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([scored])], ["pairs", "scored"])
            return
        out = [(items[q], None if doc_id == LAST else doc_id, -score) for q, found in enumerate(best) for score, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, indexed: DataFrame, documents: int) -> Iterator[dict[int, list[tuple[str, int]]]]:
    """Blocks of queries: the weighted terms of each item, at most about ``BLOCK_TERMS`` terms and ``BLOCK_ITEMS`` items at a time."""
    terms = items.select("item", F.explode("terms").alias("term"))
    # every term's documents, counted before anything moves
    holding = indexed.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")
    weighed = materialise(holding.join(terms.select("term").distinct(), "term").join(terms, "term").select("item", "term", weight))
    size = weighed.agg(F.count("*").alias("terms"), F.count_distinct("item").alias("items")).first()
    blocks = max(1, -(-size.terms // BLOCK_TERMS), -(-size["items"] // BLOCK_ITEMS))
    for block in range(blocks):
        queries: dict[int, list[tuple[str, int]]] = {}
        for row in weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toLocalIterator():
            queries.setdefault(row["item"], []).append((row.term, row.w))
        if queries:
            yield queries
    discard(weighed)


def _prepared(documents: DataFrame) -> tuple[DataFrame, int]:
    """The index with each document's length factor m, and the number of documents with terms."""
    indexed = index(documents)
    sums = indexed.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    m = F.expr(f"50 + (50 * n * {sums.N}L) div {max(1, sums.L)}L").alias("m")
    return indexed.where("n > 0").select("doc_id", "sketch", "terms", "counts", m), sums.N


def search(documents: DataFrame, benchmark: DataFrame, k: int = 50) -> DataFrame:
    """Each item's best k documents: item_id, rank, doc_id, score; ``benchmark`` has columns item_id and text."""
    spark = documents.sparkSession
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = materialise(numbered.mapInArrow(_query_terms, f"item long, item_id {kind}, terms array<string>"))
    indexed, known = _prepared(documents)
    share = min(1.0, SEED_ROWS / max(1, known))
    found = spark.createDataFrame([], "item long, doc_id long, score long, part int")
    for queries in _blocks(items, indexed, known):
        seeds = indexed.sample(share, 1).mapInArrow(_searching(queries, {}, k), "item long, doc_id long, score long")
        floors = {r["item"]: r.score for r in _merged(seeds.withColumn("part", F.lit(0)), k).where(F.col("rank") == k).select("item", "score").collect()}
        own = indexed.mapInArrow(_searching(queries, floors, k), "item long, doc_id long, score long")
        found = found.unionByName(own.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))))
    return _merged(found, k).join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def rescored_share(documents: DataFrame, benchmark: DataFrame, k: int = 50) -> float:
    """Which share of all pairs of a document and a query is scored exactly, thresholds from the seed rows included."""
    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    items = materialise(numbered.mapInArrow(_query_terms, "item long, item_id long, terms array<string>"))
    indexed, known = _prepared(documents)
    pairs = scored = 0
    for queries in _blocks(items, indexed, known):
        seeds = indexed.sample(min(1.0, SEED_ROWS / max(1, known)), 1).mapInArrow(_searching(queries, {}, k), "item long, doc_id long, score long")
        floors = {r["item"]: r.score for r in _merged(seeds.withColumn("part", F.lit(0)), k).where(F.col("rank") == k).collect()}
        row = indexed.mapInArrow(_searching(queries, floors, k, True), "pairs long, scored long").agg(F.sum("pairs"), F.sum("scored")).first()
        pairs, scored = pairs + (row[0] or 0), scored + (row[1] or 0)
    return scored / max(1, pairs)


ORACLE = rf"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {WORDS_SQL} AS w FROM documents),
  lens AS (SELECT n, doc_id, len(w) AS size FROM docs WHERE len(w) > 0),
  sums AS (SELECT count(*) AS N_, CAST(sum(size) AS BIGINT) AS L_ FROM lens),
  tfs AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest(w) AS term FROM docs) GROUP BY n, term),
  dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
  items AS (SELECT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, list_distinct({WORDS_SQL}) AS w FROM benchmark)),
  weighed AS (SELECT item, item_id, term, CAST(floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM items JOIN dfs USING (term), sums),
  scored AS (SELECT item, item_id, n, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * N_) // L_)))) AS BIGINT) AS score
    FROM weighed JOIN tfs USING (term) JOIN lens USING (n), sums GROUP BY item, item_id, n, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50"""
