"""Moments that grow with a stream of shards, and restart where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectide.operators.moments import merge_moments, moments


def shard_stream(spark: SparkSession, pattern: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """New Parquet files under a pattern, a bounded number each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)


def incremental_moments(rows: DataFrame, keys: list[str], d: int, target: str, checkpoint: str, mode: str = "complete", sink: str = "memory") -> StreamingQuery:
    """Running moments by group. State and progress live in the checkpoint; a failed batch is run again."""
    totals = moments(rows, keys, d)
    writer = totals.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("memory").queryName(target).start() if sink == "memory" else writer.format(sink).option("path", target).start()


def merge_batches(rows: DataFrame, keys: list[str], d: int, path: str, checkpoint: str) -> StreamingQuery:
    """Partial moments of each batch in a folder of its own below ``path``; writing a batch twice changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        moments(batch, keys, d).write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """The finished folders ``name=number`` of a path, by number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith(f"{name}=")]
    return {int(p.getName().split("=")[1]): p.toString() for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _state(spark: SparkSession, path: str) -> tuple[int, list[str], dict[int, str]]:
    """The last batch that is folded (-1 if none), the folders to read, and the batches not folded yet."""
    folded, parts = _folders(spark, f"{path}/folded", "upto"), _folders(spark, f"{path}/parts", "batch")
    last = max(folded, default=-1)
    rest = {b: p for b, p in parts.items() if b > last}
    return last, ([folded[last]] if folded else []) + list(rest.values()), rest


def fold(spark: SparkSession, path: str, keys: list[str], d: int) -> int:
    """Fold the batches written so far into one table, a file for each range of keys; returns the last batch in it.

    The new table counts once it is complete; before that, and if a fold is stopped
    at any point, the former one and its batches do. What it replaces is then
    removed, or ignored if that is stopped. A batch that the stream writes again after
    it was folded is ignored as well.
    """
    last, folders, rest = _state(spark, path)
    if rest:
        last = max(rest)
        sums = merge_moments(spark.read.parquet(*folders), keys, d)
        sums.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/folded/upto={last}")
    jvm = spark.sparkContext._jvm
    for n, folder in [*((n, f) for n, f in _folders(spark, f"{path}/folded", "upto").items() if n < last), *((n, f) for n, f in _folders(spark, f"{path}/parts", "batch").items() if n <= last)]:
        old = jvm.org.apache.hadoop.fs.Path(folder)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return last


def merged(spark: SparkSession, path: str, keys: list[str], d: int) -> DataFrame:
    """The moments of all batches so far, folded or not."""
    _, folders, _ = _state(spark, path)
    if not folders:
        raise ValueError(f"no batch has been written to {path}")
    return merge_moments(spark.read.parquet(*folders), keys, d)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_rows(events: DataFrame) -> DataFrame:
    """Events as coordinates: the value and the number in their properties."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(F.col("event_type").alias("cond"), (F.col("user_id") % 5).alias("line"), F.array(F.col("value"), k).alias("x"))
