"""Reading, sampling and writing the tables of the engine."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.vec import INF


def scan_list_counts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Shards with list columns; only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def scan_coo_counts(spark: SparkSession, path: str, cell: str, gene: str, value: str) -> DataFrame:
    """Long triples under standard names and signed types."""
    return spark.read.parquet(path).select(F.col(cell).cast("long").alias("cell"), F.col(gene).cast("int").alias("gene"), F.col(value).cast("int").alias("value"))


def scan_dimension(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """A dimension table with one row for each key."""
    return spark.read.parquet(path).select(key, *columns).dropDuplicates([key])


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_moments(m: DataFrame, path: str) -> None:
    m.write.mode("overwrite").parquet(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Constants and vectors from a JSON document, one row."""
    return spark.read.json(path, multiLine=True)


def systematic_indices(n_shards: int, n: int, shift: float = 0.0) -> list[int]:
    """Distinct indices spread evenly over ``0 .. n_shards - 1``; halves round to even."""
    if n_shards <= 0 or n <= 0:
        return []
    if n == 1:
        return [0]
    step = (n_shards - 1) / (n - 1)
    return sorted({min(round(i * step + shift * step), n_shards - 1) for i in range(n)})


def systematic_sample(df: DataFrame, shard: str, n: int) -> DataFrame:
    """The rows of n shards spread evenly over all shard ids."""
    ids = df.select(shard).distinct()
    return df.join(F.broadcast(_numbered(ids, shard).where(F.col("__i").isin(systematic_indices(ids.count(), n)))), shard, "left_semi")


def disjoint_indices(total: int, n: int) -> list[int]:
    """Indices half a step on, free of the systematic ones and filled up from the lowest."""
    first = set(systematic_indices(total, n))
    second = [i for i in systematic_indices(total, n, 0.5) if i not in first]
    free = (i for i in range(total) if i not in first and i not in set(second))
    while len(second) < min(n, total - len(first)):
        second.append(next(free))
    return second


def disjoint_sample(df: DataFrame, shard: str, n: int) -> DataFrame:
    """A second such sample, half a step on, free of the first and filled up from the lowest ids."""
    ids = df.select(shard).distinct()
    return df.join(F.broadcast(_numbered(ids, shard).where(F.col("__i").isin(disjoint_indices(ids.count(), n)))), shard, "left_semi")


def sampled_shards(spark: SparkSession, path: str, shard: str | None = None, n: int = 14, second: bool = False) -> DataFrame:
    """The rows of n shards spread evenly, chosen from the listing of files alone.

    A shard is a folder ``shard=value`` of a partitioned table, in order of its
    value, a missing one first; without a partition column it is a file, in order
    of its name. Files outside the sample are never opened. ``second`` takes the
    disjoint sample.
    """
    every = spark.read.parquet(path)
    files = sorted(every.inputFiles())
    if shard is None:
        groups = [[f] for f in files]
    else:
        kind, named = every.schema[shard].dataType.typeName(), {}
        for f in files:
            value = unquote(next(p for p in f.split("/") if p.startswith(f"{shard}=")).split("=", 1)[1])
            named.setdefault(None if value == "__HIVE_DEFAULT_PARTITION__" else float(value) if kind in ("integer", "long", "double", "byte", "short") else value, []).append(f)
        groups = [named[v] for v in sorted(named, key=lambda v: (v is not None, v))]
    picked = (disjoint_indices if second else systematic_indices)(len(groups), n)
    chosen = [f for i in picked for f in groups[i]]
    if not chosen:
        return every.where("false")
    return spark.read.schema(every.schema).option("basePath", path).parquet(*chosen)


def _numbered(ids: DataFrame, shard: str) -> DataFrame:
    from pyspark.sql.window import Window

    return ids.withColumn("__i", F.row_number().over(Window.orderBy(shard)) - 1)


def head_block(df: DataFrame, key: str, k: int) -> DataFrame:
    """The rows with ids below k; files sorted by the id are skipped by their statistics."""
    return df.where(F.col(key) < k)


def compose_key(sample: str, line: str) -> Column:
    return F.concat_ws("|", F.col(sample), F.col(line))


def split_key(key: str) -> tuple[Column, Column]:
    """The parts before and after the last bar; the first part may hold bars itself."""
    return F.regexp_extract(F.col(key), r"(?s)^(.*)\|([^|]*)$", 1), F.regexp_extract(F.col(key), r"(?s)^(.*)\|([^|]*)$", 2)


DOSE = r"^\[\([\x27\x22]?([^\x27\x22,]*)[\x27\x22]?,\s*([-+0-9.eE]+)"


def parse_dose(literal: str) -> Column:
    """The amount in ``[('drug', 5.0, 'uM')]``; NaN if there is none."""
    return F.coalesce(F.regexp_extract(F.col(literal), DOSE, 2).try_cast("double"), F.lit(float("nan")))


def parse_drug(literal: str) -> Column:
    """The name in the literal; the raw string if it has another form, and '?' if null or empty."""
    c = F.col(literal)
    name = F.regexp_extract(c, DOSE, 1)
    return F.when(c.isNull() | (c == ""), F.lit("?")).when(name != "", name).otherwise(c)


RESULT = ["cond_id", "m_raw", "m_corr", "n_t", "n_c", "n_star", "regime"]


def condition_table(df: DataFrame) -> DataFrame:
    return df.select(*RESULT)


def write_condition_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """The result by condition. Parquet keeps infinite quotas; CSV writes them as -1."""
    out = condition_table(df)
    if form == "csv":
        out = csv_form(out)
        out.write.mode("overwrite").csv(path, header=True)
    else:
        out.write.mode("overwrite").parquet(path)


def csv_form(df: DataFrame) -> DataFrame:
    return df.withColumn("n_star", F.when(F.col("n_star") == F.lit(INF), F.lit(-1.0)).otherwise(F.col("n_star")))


def markdown_rows(df: DataFrame, name: str, numbers: list[str], places: int = 1) -> DataFrame:
    """A short summary as lines of a Markdown table."""
    cells = [F.coalesce(F.format_string(f"%.{places}f", F.col(c).cast("double")), F.lit("--")) for c in numbers]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name).cast("string"), *cells), F.lit(" |")).alias("line"))


def write_report(summary: DataFrame, path: str, name: str, numbers: list[str]) -> None:
    """A short summary as JSON, CSV and Markdown under one folder."""
    one = summary.coalesce(1)
    one.write.mode("overwrite").json(f"{path}/json")
    one.write.mode("overwrite").csv(f"{path}/csv", header=True)
    markdown_rows(one, name, numbers).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
