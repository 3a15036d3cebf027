"""The engine's roles on the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.quota import evidence
from vectide.operators import moments as M

D = 4
THETA = 0.3
KEYS = ["brand", "band", "line"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function as a query under its own name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names; a local one only on a single machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-work-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table from a new folder, for what is read several times."""
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name) if name else F.round(c.cast("double"), 6) + F.lit(0.0)


def flat(name: str, d: int = D, out: str | None = None) -> list[Column]:
    """An array's entries as rounded columns name_1, name_2, ..."""
    return [r6(F.col(name)[k], f"{out or name}_{k + 1}") for k in range(d)]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of a tall table: coordinates, condition, line and plate."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    met = li.join(part.select("p_partkey", "p_brand"), li.l_partkey == part.p_partkey)
    return met.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_id"),
        F.col("p_brand").alias("brand"),
        F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("band"),
        F.col("l_returnflag").alias("line"),
        (F.col("l_suppkey") % 5).alias("plate"),
        F.array(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_discount") * 100, F.col("l_tax") * 100).alias("x"),
    )


def group_moments(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    return M.moments(cells(spark, sf_dir), keys or KEYS, D)


def cond_id() -> Column:
    return F.concat_ws("|", "brand", F.col("band").cast("string"), "line").alias("cond_id")


def standard(m: DataFrame) -> DataFrame:
    """The standard table: every group but the control, against Brand#1 band 2 of its line."""
    control = M.centroid(m.where("brand = 'Brand#1' and band = 2")).select("line", F.col("mu").alias("mu_c"), F.col("n").cast("double").alias("n_c"))
    ell = M.within_variance(m, D).select("ell")
    treated = M.centroid(m.where("not (brand = 'Brand#1' and band = 2)"))
    return treated.join(control, "line").crossJoin(F.broadcast(ell)).select(cond_id(), *KEYS, F.col("mu").alias("mu_t"), "mu_c", F.col("n").cast("double").alias("n_t"), "n_c", "ell")


def judged(spark: SparkSession, sf_dir: str, theta: float = THETA, ghost: float = 50_000.0) -> DataFrame:
    return evidence(standard(group_moments(spark, sf_dir)), theta, ghost)


def ks(pattern: str, sep: str = ", ", d: int = D) -> str:
    """A SQL pattern written out for each dimension; # stands for its number."""
    return sep.join(pattern.replace("#", str(k + 1)) for k in range(d))


CELLS = """cells AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
  p_brand AS brand, CAST(least(floor(l_quantity / 10), 4) AS INT) AS band, l_returnflag AS line, l_suppkey % 5 AS plate,
  l_quantity / 10 AS x1, l_extendedprice / 10000 AS x2, l_discount * 100 AS x3, l_tax * 100 AS x4
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def sql_moments(keys: str = "brand, band, line", name: str = "mom", source: str = "cells") -> str:
    return f"{name} AS (SELECT {keys}, count(*) AS n, {ks('sum(x#) AS a#')}, {ks('sum(x# * x#) AS b#')} FROM {source} GROUP BY {keys})"


WITHIN = f"within_ AS (SELECT {ks('sum(b# - a# * a# / n) / sum(n - 1) AS e#')} FROM mom WHERE n >= 2)"
STANDARD = f"""std AS (SELECT concat_ws('|', t.brand, t.band, t.line) AS cond_id, t.brand, t.band, t.line, {ks('t.a# / t.n AS t#')}, {ks('c.a# / c.n AS c#')}, CAST(t.n AS DOUBLE) AS n_t, CAST(c.n AS DOUBLE) AS n_c, w.*
  FROM mom t JOIN mom c ON c.line = t.line AND c.brand = 'Brand#1' AND c.band = 2 CROSS JOIN within_ w
  WHERE NOT (t.brand = 'Brand#1' AND t.band = 2))"""


def sql_evidence(theta: str = str(THETA), ghost: str = "50000", source: str = "std", name: str = "ev") -> str:
    return f"""{name}0 AS (SELECT *, sqrt({ks('(t# - c#) * (t# - c#)', ' + ')}) AS m_raw, ({ks('e#', ' + ')}) AS tr_all FROM {source}),
  {name}1 AS (SELECT *, {ks('CASE WHEN m_raw > 0 THEN (t# - c#) / m_raw ELSE 0 END AS u#')}, tr_all * (1 / n_t + 1 / n_c) AS tr_s FROM {name}0),
  {name}2 AS (SELECT *, tr_all - ({ks('u# * u# * e#', ' + ')}) AS tr_perp, CASE WHEN tr_s > 0 THEN m_raw / sqrt(tr_s) ELSE 0 END AS snr, greatest(m_raw * m_raw - tr_s, 0) AS m2_corr FROM {name}1),
  {name}3 AS (SELECT *, sqrt(m2_corr) AS m_corr, snr > 1.5 AS detectable, m2_corr * {theta} * {theta} / tr_perp - 1 / n_c AS room, sqrt(tr_perp / (n_c * {theta} * {theta})) AS m_min FROM {name}2),
  {name}4 AS (SELECT *, CASE WHEN room > 0 THEN 1 / room ELSE CAST('Infinity' AS DOUBLE) END AS n_star FROM {name}3),
  {name} AS (SELECT *, CASE WHEN NOT detectable THEN 'NOT-DETECTABLE' WHEN n_star = CAST('Infinity' AS DOUBLE) THEN 'POOL-LIMITED' WHEN n_star > {ghost} THEN 'GHOST' WHEN n_star < n_t THEN 'OVER' ELSE 'UNDER' END AS regime FROM {name}4)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


EVIDENCE = with_(CELLS, sql_moments(), WITHIN, STANDARD, sql_evidence())


def q6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def q6s(*names: str) -> str:
    return ", ".join(q6(n, n) for n in names)
