"""The corpus pipeline: from raw documents to packed training sequences.

Rows are judged one by one, whatever their doc_id: those without one, and
different texts under one doc_id, are kept or dropped for what they hold.
Null texts count as empty. Empty texts are no near-duplicates of each other and
hold no benchmark item and no secret; the classifier scores them like others.
Equal rows of one doc_id are near-duplicates, so one stays. Of a tie (equal
doc_ids in a group of near-duplicates) the row read first stays. Very long texts
are read whole. Columns beyond doc_id and text pass through, whatever their
names, up to packing, which returns its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import chosen_path, decontaminate, packing, quality, secrets
from vectide.llm.common import materialise, table


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of each row's own: the doc_id if it tells them apart, else a number, written so that it stays."""
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.rows == ids.ids:
        return docs.withColumn("__key", F.col("doc_id").cast("long"))
    return materialise(docs.withColumn("__key", F.monotonically_increasing_id()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    known = quality.training_labels(table(spark, sf_dir, "labels"))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known.select("doc_id"), "doc_id", "left_semi")
    model = quality.fit(quality.document_statistics(labelled).join(known, "doc_id").select("x", "y"))
    return docs.where(quality.accepted(F.col("text"), model))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null last."""
    rows = keyed(docs)
    found = chosen_path.near_duplicates(rows.select(F.col("__key").alias("doc_id"), "text"), percent=80).select(F.col("doc_id").alias("__key"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    first = found.join(rows.select("__key", "doc_id"), "__key").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = rows.join(first.select("first.__key"), "__key", "left_semi")
    # texts too short to compare
    return kept.select(*docs.columns).dropDuplicates(["doc_id", "text"])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    held = decontaminate.held(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (decontaminate.text_digest() == F.col("__digest"))
    return docs.join(held.distinct(), same, "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced by a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
