"""Exact deduplication by sorting contents, with DataFrame functions alone.

Texts are equal when nothing but ``[\\x20\\x09-\\x0D]`` differs between them.

1. Splitters. Spark samples the rows and cuts the space of (first bytes of the
   normalised text, its hash, split) into ranges of like size. What it samples
   is of bounded length, and texts that begin alike can still be cut apart.
2. Sort. Inside a range rows are sorted by the normalised text itself, on disk
   where memory ends, so equal texts lie beside each other.
3. Comparison. Neighbours are compared in full; each run of equal texts knows
   its size and its first row: most code points, then smallest doc_id.

A text whose copies would fill more than a quarter of an average range is split
by row number into parts of that size. Each part finds its own first row, and
the parts' first rows, again compared in full, find the text's.

Every row comes back, dropped ones as well. Null texts count as empty, and
empty texts are equal to each other and to texts of white space alone. A missing
doc_id comes last among ties; of rows equal in length and doc_id one stays. Very
long texts are compared whole. Other columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import discard, materialise

SPACES = r"[\x20\x09-\x0D]+"
HEAD = 24
ROW_BYTES = 64


def normalised(text: Column) -> Column:
    """The text without spaces and the controls 9 to 13; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _heavy(docs: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Hashes of texts whose copies exceed a quarter of a range, and into how many parts each goes: ``4 * ranges`` rows at most."""
    size = (F.octet_length("norm") + ROW_BYTES).cast("long")
    sizes = materialise(docs.select(F.xxhash64("norm").alias("hash"), size.alias("bytes")).groupBy("hash").agg(F.sum("bytes").alias("bytes")))
    share = max(1, (sizes.agg(F.sum("bytes")).first()[0] or 0) // (4 * ranges))
    return sizes, sizes.where(F.col("bytes") > share).select("hash", F.ceil(F.col("bytes") / share).cast("int").alias("parts"))


def equal_texts(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = documents.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), normalised(F.col("text")).alias("norm"))
    sizes, heavy = _heavy(docs, ranges)
    part = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")), F.lit(0)).cast("int")
    keyed = docs.withColumn("hash", F.xxhash64("norm")).join(F.broadcast(heavy), "hash", "left").select("*", part.alias("part"), F.substring("norm", 1, HEAD).alias("head"))

    dealt = keyed.repartitionByRange("head", "hash", "part")
    # the partitioning by ranges serves this window, which adds a sort but no exchange
    run = Window.partitionBy("head", "hash", "part", "norm").orderBy(F.desc("size"), F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "part")).over(whole)
    compared = dealt.select("*", F.row_number().over(run).alias("place"), F.count("*").over(whole).alias("copies"), first.alias("first"))
    split = F.col("parts").isNotNull()
    rows = materialise(
        compared.select("doc_id", "hash", "part", "place", "copies", "first", F.sha2("norm", 256).alias("text_sha256"), split.alias("split"), F.when(split & (F.col("place") == 1), F.col("norm")).alias("norm"))
    )
    discard(sizes)

    leaders = rows.where("split and place = 1").groupBy("hash", "norm")
    joined = leaders.agg(F.min("first").alias("best"), F.sum("copies").alias("all_copies"), F.first("text_sha256").alias("text_sha256")).drop("norm")
    best = F.coalesce("best", "first")
    return rows.join(F.broadcast(joined), ["hash", "text_sha256"], "left").select(
        "doc_id",
        best["doc_id"].alias("keep_id"),
        F.coalesce("all_copies", "copies").alias("group_size"),
        ((F.col("place") == 1) & (F.col("part") == best["part"])).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""WITH docs AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
  groups AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY norm) AS group_size FROM docs
    WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM groups"""
