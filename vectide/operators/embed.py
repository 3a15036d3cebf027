"""From sparse counts to coordinates: normalising, features, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.operators.entries import Entries
from vectide.operators.moments import gram

TARGET = 1e4
#: Features of at most so many rows are sent to every executor.
BROADCAST_FEATURES = 100_000
#: A basis of at most so many rows (some 64 MB as a matrix) goes to every task.
BASIS_ENTRIES = 8_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """The table, to be sent to every executor if it is no longer than stated."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def long_counts(df: DataFrame, cell: str, genes: str, values: str) -> DataFrame:
    """List columns as rows ``cell, gene, value``."""
    pairs = F.zip_with(F.col(genes), F.col(values), lambda g, v: F.struct(g.alias("gene"), v.alias("value")))
    return df.select(F.col(cell).alias("cell"), F.explode(pairs).alias("p")).select("cell", "p.gene", "p.value")


def total_counts(counts: DataFrame) -> DataFrame:
    """The sum of each cell's counts; 0 is taken as 1."""
    t = counts.groupBy("cell").agg(F.sum("value").alias("total"))
    return t.withColumn("total", F.when(F.col("total") == 0, F.lit(1)).otherwise(F.col("total")))


def normalized(value: Column, total: Column, target: float = TARGET) -> Column:
    return F.log1p(value * F.lit(target) / total)


def normalize_log1p(counts: DataFrame, totals: DataFrame | None = None, target: float = TARGET) -> DataFrame:
    """Append ``total`` and ``log``. Totals cover all genes: take them before features are picked."""
    met = counts.join(totals if totals is not None else total_counts(counts), "cell")
    return met.withColumn("log", normalized(F.col("value"), F.col("total"), target))


def restrict_to_features(counts: DataFrame, features: DataFrame) -> DataFrame:
    """The counts of the given genes only."""
    return counts.join(small(features.select("gene").distinct(), BROADCAST_FEATURES), "gene", "left_semi")


def pseudobulk(logs: DataFrame, cells: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """Sums of log values by condition and gene, and cells by condition.

    cells has a row for each cell, so those without any kept gene count too.
    """
    sums = logs.join(cells.select("cell", condition), "cell").groupBy(condition, "gene").agg(F.sum("log").alias("s"))
    return sums, cells.groupBy(condition).agg(F.count_distinct("cell").alias("n"))


def gene_stats(normal: DataFrame, n_cells: int, value: str = "x") -> DataFrame:
    """Mean and variance (ddof 1) of each gene over all cells; absent entries are zeros."""
    s = normal.groupBy("gene").agg(F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    mean = F.col("s1") / n_cells
    return s.select("gene", mean.alias("mean"), ((F.col("s2") - mean * mean * n_cells) / (n_cells - 1)).alias("var"))


def select_hvg(stats: DataFrame, n: int = 2000, bins: int = 20) -> DataFrame:
    """The genes with the greatest dispersion for their mean: ``gene, score, r``.

    Log dispersion is standardised inside equal-width bins of the log mean; a
    bin of one gene scores 1. Genes whose mean or variance is not above 0 are left out.
    """
    g = stats.where("mean > 0 and var > 0").select("gene", F.log1p("mean").alias("lm"), F.log(F.col("var") / F.col("mean")).alias("disp"))
    ends = g.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    g = g.crossJoin(F.broadcast(ends))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("lm") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    g = g.withColumn("bin", at.cast("int"))
    per = g.groupBy("bin").agg(F.avg("disp").alias("mu"), F.stddev_samp("disp").alias("sd"), F.count("*").alias("k"))
    z = F.when(F.col("k") == 1, F.lit(1.0)).when(F.col("sd") > 0, (F.col("disp") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd"))).otherwise(F.lit(0.0))
    scored = g.join(F.broadcast(per), "bin").select("gene", z.alias("score"))
    # bins of two genes score alike but for rounding: the gene decides
    order = [F.desc(F.round("score", 9)), "gene"]
    return scored.orderBy(*order).limit(n).withColumn("r", F.row_number().over(Window.orderBy(*order)))


def hvg_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("gene").intersect(b.select("gene")).agg(F.count("*").alias("shared"))


def fit_pca(cells: DataFrame, d: int, k: int, x: str = "x") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Centred principal components from one aggregation of products.

    Returns ``loadings(gene, pc, w)``, ``gene_mean(gene, mu)`` and
    ``pc_info(pc, var, evr)``; genes are positions in x. The d x d covariance is
    finished on the driver; each component's largest loading is positive.
    """
    sums = gram(cells, F.array(*[F.col(x)[i].cast("double") for i in range(d)])).toPandas().sort_values("i")
    n = int(sums.n.iloc[0])
    mean = sums.s.to_numpy() / n
    cov = (np.array(sums.g.tolist()) - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    w = vectors[:, order]
    w = w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
    spark = cells.sparkSession
    loadings = spark.createDataFrame(pd.DataFrame({"gene": np.repeat(np.arange(d), w.shape[1]), "pc": np.tile(np.arange(w.shape[1]), d), "w": w.reshape(-1)}), "gene long, pc int, w double")
    means = spark.createDataFrame(pd.DataFrame({"gene": np.arange(d), "mu": mean}), "gene long, mu double")
    info = spark.createDataFrame(pd.DataFrame({"pc": np.arange(len(order)), "var": values[order], "evr": values[order] / values.sum()}), "pc int, var double, evr double")
    return loadings, means, info


def offsets(loadings: DataFrame, means: DataFrame) -> DataFrame:
    return loadings.join(means, "gene").groupBy("pc").agg(F.sum(F.col("w") * F.col("mu")).alias("off"))


def project_cells(logs: DataFrame, cells: DataFrame, loadings: DataFrame, means: DataFrame, value: str = "log") -> DataFrame:
    """Coordinates ``cell, pc, x``; genes that a cell lacks add nothing before the offset."""
    hit = logs.join(small(loadings, BROADCAST_FEATURES), "gene").groupBy("cell", "pc").agg(F.sum(F.col(value) * F.col("w")).alias("y"))
    all_ = cells.select("cell").crossJoin(F.broadcast(offsets(loadings, means)))
    return all_.join(hit, ["cell", "pc"], "left").select("cell", "pc", (F.coalesce("y", F.lit(0.0)) - F.col("off")).alias("x"))


def project_lists(cells: DataFrame, cell: str, genes: str, values: str | None, loadings: DataFrame, means: DataFrame, target: float = TARGET) -> DataFrame:
    """Coordinates ``cell, x`` of list columns, without a shuffle: the basis goes to every task, products stay inside a batch.

    Values of one gene in a cell add up; without a column of values every entry
    counts 1. A basis of more than ``BASIS_ENTRIES`` rows is joined with the
    exploded cells instead, which must then have names of their own.
    """
    if loadings.limit(BASIS_ENTRIES + 1).count() > BASIS_ENTRIES:
        own = cells.withColumn("__ones", F.transform(genes, lambda g: F.lit(1.0))) if values is None else cells
        logs = normalize_log1p(long_counts(own, cell, genes, values or "__ones").groupBy("cell", "gene").agg(F.sum("value").alias("value")), target=target)
        long = project_cells(logs, cells.select(F.col(cell).alias("cell")), loadings, means)
        return long.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "x"))), lambda p: p["x"]).alias("x"))
    basis = loadings.toPandas().pivot(index="gene", columns="pc", values="w").fillna(0.0)
    names, w = pa.array(basis.index.tolist()), basis.to_numpy()
    off = means.toPandas().set_index("gene").mu.reindex(basis.index).fillna(0.0).to_numpy() @ w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = Entries(batch.column("genes"), batch.column("values") if values else None)
            gene = e.places(names)
            kept = gene >= 0
            log = np.log1p(e.normalised(target))[kept]
            out = np.stack([np.bincount(e.cell[kept], weights=log * w[gene[kept], k], minlength=e.cells) for k in range(w.shape[1])], axis=1) - off
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(e.cells + 1, dtype=np.int32) * w.shape[1]), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("cell"), vectors], names=["cell", "x"])

    thin = cells.select(F.col(cell).alias("cell"), F.col(genes).alias("genes"), *([F.col(values).cast("array<double>").alias("values")] if values else []))
    return thin.mapInArrow(run, f"cell {cells.schema[cell].dataType.simpleString()}, x array<double>")


def project_dense(cells: DataFrame, loadings: DataFrame, means: DataFrame, x: str = "x") -> DataFrame:
    """Coordinates of dense rows, as arrays: one matrix product for each Arrow batch."""
    w = loadings.toPandas().pivot(index="gene", columns="pc", values="w").to_numpy()
    mu = means.toPandas().sort_values("gene").mu.to_numpy()
    rest = [c for c in cells.columns if c != x]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*rest).schema) + f", `{x}` array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f[rest].assign(**{x: list((np.array(f[x].tolist(), dtype=float) - mu) @ w)})

    return cells.select(*rest, x).mapInPandas(run, schema)


def project_centroids(bulk: DataFrame, counts: DataFrame, condition: str, loadings: DataFrame, means: DataFrame) -> DataFrame:
    """The projection of each condition's mean, after the aggregation: far fewer rows than cells."""
    hit = bulk.join(small(loadings, BROADCAST_FEATURES), "gene").groupBy(condition, "pc").agg(F.sum(F.col("s") * F.col("w")).alias("y"))
    all_ = counts.crossJoin(F.broadcast(offsets(loadings, means)))
    return all_.join(hit, [condition, "pc"], "left").select(condition, "pc", (F.coalesce("y", F.lit(0.0)) / F.col("n") - F.col("off")).alias("mu"))


def cross_products(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pc_a, pc_b, c``: products of two bases over the genes that both have."""
    other = b.select("gene", F.col("pc").alias("pc_b"), F.col("w").alias("w_b"))
    return a.join(other, "gene").groupBy(F.col("pc").alias("pc_a"), "pc_b").agg(F.sum(F.col("w") * F.col("w_b")).alias("c"))


def subspace_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The mean squared cosine of two subspaces of k dimensions."""
    return cross_products(a, b).agg((F.sum(F.col("c") * F.col("c")) / k).alias("overlap"))


def principal_angles(a: DataFrame, b: DataFrame) -> DataFrame:
    """``i, angle`` in degrees, from small to large; the k x k products are finished on the driver."""
    c = cross_products(a, b).toPandas().pivot(index="pc_a", columns="pc_b", values="c").fillna(0.0).to_numpy()
    angles = np.degrees(np.arccos(np.clip(np.linalg.svd(c, compute_uv=False), -1, 1)))
    return a.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(np.sort(angles))], "i int, angle double")


def angle_summary(angles: DataFrame) -> DataFrame:
    s = F.sin(F.radians("angle"))
    return angles.agg(
        F.max("angle").alias("largest"),
        F.percentile("angle", F.lit(0.5)).alias("median"),
        *[F.count_if(F.col("angle") < t).alias(f"under_{t}") for t in (10, 25, 45)],
        F.sqrt(F.sum(F.pow(F.radians("angle"), F.lit(2)))).alias("grassmann"),
        F.sqrt(F.sum(s * s)).alias("chordal"),
    )


def orthonormality_residual(a: DataFrame) -> DataFrame:
    eye = F.when(F.col("pc_a") == F.col("pc_b"), 1.0).otherwise(0.0)
    return cross_products(a, a).agg(F.max(F.abs(F.col("c") - eye)).alias("residual"))


def consensus_pool_hvg(stats_a: DataFrame, stats_b: DataFrame, pooled: DataFrame, n: int) -> DataFrame:
    """How many features two pools share when each selects alone, and with the pooled set."""
    a, b, both = (select_hvg(s, n).select("gene") for s in (stats_a, stats_b, pooled))
    return hvg_overlap(a, b).withColumnRenamed("shared", "shared_apart").crossJoin(hvg_overlap(a, both).withColumnRenamed("shared", "a_in_pool")).crossJoin(hvg_overlap(b, both).withColumnRenamed("shared", "b_in_pool"))
