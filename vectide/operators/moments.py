"""Mergeable statistics of groups of vectors: counts, sums, squares, covariance.

Everything is a plain sum, so partial results combine before the shuffle and
replicate groups, shards and stream batches add up to the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vec


def moments(rows: DataFrame, keys: list[str], d: int, x: str = "x") -> DataFrame:
    """``n, s1, s2`` of each group: row count, sums and sums of squares."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), vec.sums(x, d).alias("s1"), vec.sums(x, d, square=True).alias("s2"))


def merge_moments(parts: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Add moments of replicate groups; the order of merging does not matter."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), vec.sums("s1", d).alias("s1"), vec.sums("s2", d).alias("s2"))


def centroid(m: DataFrame) -> DataFrame:
    """Append ``mu``, the group's mean."""
    return m.withColumn("mu", vec.over("s1", F.col("n")))


def line_baseline(m: DataFrame, line: str, d: int) -> DataFrame:
    """The mean over all rows of a line, controls included: ``line, mu_c, n_c``."""
    all_rows = merge_moments(m, [line], d)
    return all_rows.select(line, vec.over("s1", F.col("n")).alias("mu_c"), F.col("n").cast("double").alias("n_c"))


def pooled_control(m: DataFrame, keys: list[str], d: int) -> DataFrame:
    """The count-weighted pool of every control group with the same keys."""
    pool = merge_moments(m, keys, d)
    return pool.select(*keys, vec.over("s1", F.col("n")).alias("mu_c"), F.col("n").cast("double").alias("n_c"))


def matched_control(parts: DataFrame, controls: DataFrame, condition: list[str], place: list[str], d: int) -> DataFrame:
    """Treated parts against the control of each part's own place.

    The control mean is weighted by the treated counts, and its effective size
    is ``sum(c)**2 / sum(c**2 / n_control)``. A condition with a part that has
    no control drops out whole.
    """
    met = parts.join(controls, place, "left")
    weight = F.col("n").cast("double")
    out = met.groupBy(*condition).agg(
        F.sum(weight).alias("n_t"),
        vec.sums("s1", d).alias("s1"),
        F.array(*[F.sum(F.col("mu_c")[k] * weight) / F.sum(weight) for k in range(d)]).alias("mu_c"),
        (F.pow(F.sum(weight), F.lit(2)) / F.sum(weight * weight / F.col("n_c"))).alias("n_c"),
        F.bool_and(F.col("n_c").isNotNull()).alias("complete"),
    )
    return out.where("complete").select(*condition, vec.over("s1", F.col("n_t")).alias("mu_t"), "mu_c", "n_t", "n_c")


def within_variance(m: DataFrame, d: int) -> DataFrame:
    """``ell, sigma2``: pooled variance inside groups of two rows or more, from moments."""
    big = m.where("n >= 2")
    ell = [F.sum(F.col("s2")[k] - F.col("s1")[k] * F.col("s1")[k] / F.col("n")) / F.sum(F.col("n") - 1) for k in range(d)]
    out = big.agg(F.array(*ell).alias("ell"), F.count("*").alias("groups"))
    return out.where("groups > 0").select("ell", (vec.total("ell") / d).alias("sigma2"))


def within_variance_two_pass(rows: DataFrame, keys: list[str], d: int, x: str = "x") -> DataFrame:
    """The same from residuals to group means; agrees with the moments up to rounding."""
    mean = rows.groupBy(*keys).agg(F.count("*").alias("__n"), vec.means(x, d).alias("__mu")).where("__n >= 2")
    near = rows.join(mean, keys)
    squares = [F.sum(F.pow(F.col(x)[k].cast("double") - F.col("__mu")[k], F.lit(2))) for k in range(d)]
    dof = F.sum(F.lit(1.0) - F.lit(1.0) / F.col("__n"))
    out = near.agg(F.array(*squares).alias("sq"), dof.alias("dof"), F.count("*").alias("rows")).where("rows > 0")
    return out.select(vec.over("sq", F.col("dof")).alias("ell")).select("ell", (vec.total("ell") / d).alias("sigma2"))


def _gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    gram = total = None
    n, fourth = 0, 0.0
    for f in frames:
        if len(f):
            x = np.array(f.v.tolist(), dtype=float)
            gram = x.T @ x if gram is None else gram + x.T @ x
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
            n, fourth = n + len(f), fourth + float(((x * x).sum(axis=1) ** 2).sum())
    if gram is not None:
        yield pd.DataFrame({"i": np.arange(len(gram)), "s": total, "g": list(gram), "n": n, "q": fourth})


def _add_rows(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": f.i[:1], "s": [f.s.sum()], "g": [np.sum(f.g.tolist(), axis=0)], "n": [f.n.sum()], "q": [f.q.sum()]})


def gram(rows: DataFrame, x: Column) -> DataFrame:
    """Row i of the products ``g`` summed over all rows, with the sum ``s`` of entry i, the count ``n`` and ``q``, the sum of fourth powers of lengths.

    One matrix product for each Arrow batch; a partition passes on one matrix.
    """
    schema = "i int, s double, g array<double>, n long, q double"
    return rows.select(x.alias("v")).mapInPandas(_gram, schema).groupBy("i").applyInPandas(_add_rows, schema)


#: Up to so many entries a group's products are plain sums of columns.
FEW = 8
#: Rows of a group that one task sums, about.
SHARE = 1_000_000


def _alike(a: tuple, b: tuple) -> bool:
    """Whether two keys are equal; missing parts equal each other."""
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _running(keys: list[str], sums):
    """A pandas function over rows sorted by keys: one row for each key, from ``sums`` of its rows in each batch, held only while the key lasts."""

    def row(key: tuple, n: int, s1: np.ndarray, s2: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "n": [n], "s1": [s1], "s2": [s2]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = held = None
        for f in frames:
            for at in sorted(f.groupby(keys, dropna=False, sort=False).indices.values(), key=lambda at: at[0]):
                now, part = tuple(f[k].iloc[at[0]] for k in keys), sums(f.iloc[at])
                if held is not None and _alike(key, now):
                    held = tuple(a + b for a, b in zip(held, part))
                else:
                    if held is not None:
                        yield row(key, *held)
                    key, held = now, part
        if held is not None:
            yield row(key, *held)

    return run


def cross_moments(rows: DataFrame, keys: list[str], d: int, x: str = "x") -> DataFrame:
    """``n``, sums ``s1`` and the upper triangle ``s2[i, j]`` of products, one row for each group."""
    v = [F.col(x)[k].cast("double") for k in range(d)]
    if d <= FEW:
        return rows.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.array(*[F.sum(c) for c in v]).alias("s1"),
            F.array(*[F.sum(v[i] * v[j]) for i in range(d) for j in range(i, d)]).alias("s2"),
        )
    upper = np.triu_indices(d)

    def products(f: pd.DataFrame) -> tuple:
        own = np.array(f.v.tolist(), dtype=float).reshape(len(f), d)
        return len(f), own.sum(axis=0), (own.T @ own)[upper]

    def added(f: pd.DataFrame) -> tuple:
        return int(f.n.sum()), np.sum(f.s1.tolist(), axis=0), np.sum(f.s2.tolist(), axis=0)

    thin = rows.select(*keys, F.array(*v).alias("v"))
    # a large group goes to as many tasks as it has shares; such groups are few, by what they hold
    large = thin.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > SHARE).select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("__n") / SHARE).cast("int").alias("__tasks"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    dealt = F.pmod(F.xxhash64("v"), F.coalesce("__tasks", F.lit(1))).cast("int").alias("__task")
    shared = thin.join(F.broadcast(large), same, "left").select(*keys, "v", dealt)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", n long, s1 array<double>, s2 array<double>"
    parts = shared.repartition(*keys, "__task").sortWithinPartitions(*keys, "__task").drop("__task").mapInPandas(_running(keys, products), schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_running(keys, added), schema)


def _triangle(d: int) -> Column:
    return F.lit([[i, j] for i in range(d) for j in range(i, d)])


def tidy_triangle(df: DataFrame, d: int, cells: str = "s2") -> DataFrame:
    """A triangle as rows ``i, j, value`` beside the other columns."""
    rest = [c for c in df.columns if c != cells]
    flat = df.select(*rest, F.posexplode(F.zip_with(cells, _triangle(d), lambda v, ij: F.struct(ij[0].alias("i"), ij[1].alias("j"), v.alias("value")))).alias("__k", "__c"))
    return flat.select(*rest, "__c.*")


def within_covariance(rows: DataFrame, keys: list[str], d: int, x: str = "x") -> DataFrame:
    """The pooled covariance inside groups, as ``i, j, value`` with i <= j.

    All products together less those of the groups' means: no group's own
    products are needed, and groups of one row cancel out.
    """
    if d <= FEW:
        own = cross_moments(rows, keys, d, x)
        apart = tidy_triangle(own, d).withColumn("value", F.col("value") - F.col("s1")[F.col("i")] * F.col("s1")[F.col("j")] / F.col("n"))
        pooled = apart.groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum(F.col("n") - 1).alias("dof")).where("dof > 0")
        return pooled.select("i", "j", (F.col("value") / F.col("dof")).alias("value"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), vec.sums(x, d).alias("s1"))
    mean = gram(sums, F.transform("s1", lambda s: s / F.sqrt(F.col("n").cast("double"))))
    dof = sums.agg(F.sum(F.col("n") - 1).alias("dof"))
    both = gram(rows, vec.doubles(x)).select("i", "g").join(mean.select("i", F.col("g").alias("h")), "i").crossJoin(F.broadcast(dof)).where("dof > 0")
    cells = both.select("i", F.posexplode(F.transform(vec.minus("g", "h"), lambda c: c / F.col("dof"))).alias("j", "value"))
    return cells.where("i <= j")


def group_covariance(rows: DataFrame, keys: list[str], d: int, x: str = "x", ddof: int = 1) -> DataFrame:
    """Each group's own covariance, as ``i, j, value``; groups of ddof rows or fewer are left out."""
    cells = tidy_triangle(cross_moments(rows, keys, d, x).where(F.col("n") > ddof), d)
    residual = F.col("value") - F.col("s1")[F.col("i")] * F.col("s1")[F.col("j")] / F.col("n")
    return cells.select(*keys, "n", "i", "j", (residual / (F.col("n") - ddof)).alias("value"))


def group_variance(m: DataFrame) -> DataFrame:
    """Append ``ell``: each group's own diagonal variance (ddof 0, at least 0)."""
    n = F.col("n").cast("double")
    mean = F.transform("s1", lambda s: s / n)
    return m.withColumn("ell", F.zip_with("s2", mean, lambda s, mu: F.greatest(s / n - mu * mu, F.lit(0.0))))


def marginal_variance(rows: DataFrame, d: int, x: str = "x") -> DataFrame:
    """``ell, sigma2`` over all rows together (ddof 0)."""
    ell = F.array(*[F.var_pop(F.col(x)[k].cast("double")) for k in range(d)])
    return rows.agg(ell.alias("ell")).select("ell", (vec.total("ell") / d).alias("sigma2"))


def ledoit_wolf(rows: DataFrame, keys: list[str], d: int, x: str = "x") -> DataFrame:
    """Shrinkage of the pooled residual covariance toward a multiple of the identity.

    Returns ``n, mu, shrinkage`` and the triangle ``cov`` after shrinking. Only sums
    of products and of squared lengths of residuals are needed.
    """
    mean = rows.groupBy(*keys).agg(vec.means(x, d).alias("__mu"))
    r = rows.join(mean, keys)
    products = gram(r, vec.minus(vec.doubles(x), "__mu"))
    whole = F.array_sort(F.collect_list(F.struct("i", "c")))
    s = products.withColumn("c", F.transform("g", lambda c: c / F.col("n"))).agg(F.max("n").alias("n"), F.max("q").alias("q"), whole.alias("rows")).where("n > 0")
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    trace = add(F.transform("rows", lambda p: F.get(p["c"], p["i"])))
    square = add(F.transform("rows", lambda p: add(F.transform(p["c"], lambda v: v * v))))
    s = s.withColumns({"mu": trace / d, "sq": square})
    s = s.withColumn("delta", F.col("sq") - F.col("mu") * F.col("mu") * d)
    s = s.withColumn("beta", F.least((F.col("q") / F.col("n") - F.col("sq")) / F.col("n"), F.col("delta")))
    s = s.withColumn("shrinkage", F.when(F.col("delta") > 0, F.greatest(F.col("beta"), F.lit(0.0)) / F.col("delta")).otherwise(F.lit(0.0)))
    # row i gives the entries from i on of the triangle
    shrunk = lambda p: F.transform(p["c"], lambda v, j: v * (1 - F.col("shrinkage")) + F.when(p["i"] == j, F.col("shrinkage") * F.col("mu")).otherwise(0.0))
    return s.select("n", "mu", "shrinkage", F.flatten(F.transform("rows", lambda p: F.slice(shrunk(p), p["i"] + 1, F.lit(d)))).alias("cov"))
