"""Summaries over conditions: regimes, tolerance sweeps, layouts, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.functions.quota import REGIMES, THETA, evidence
from vectide.functions.vec import INF
from vectide.operators.quantiles import exact_quantiles


def median(x: str, where: Column | None = None) -> Column:
    return F.percentile(F.col(x) if where is None else F.when(where, F.col(x)), F.lit(0.5))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100.0


def regime_shares() -> list[Column]:
    return [share(F.col("regime") == r).alias("pct_" + r.lower().replace("-", "_")) for r in REGIMES]


def spectrum_summary(df: DataFrame, by: list[str] | None = None, sigma2: float | None = None, theta: float = THETA) -> DataFrame:
    """One record of regime shares and medians over all conditions, or for each value of ``by``.

    The median quota covers every finite value, whatever its regime. Over and under shares
    among detectable conditions are null when none is detectable.
    """
    seen = F.col("regime") != "NOT-DETECTABLE"
    finite = F.col("n_star") < F.lit(INF)
    among = lambda r: F.when(F.sum(seen.cast("int")) > 0, F.sum((F.col("regime") == r).cast("int")) * 100.0 / F.sum(seen.cast("int")))
    out = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count("*").alias("n"),
        *regime_shares(),
        share(F.col("detectable")).alias("pct_detectable"),
        among("OVER").alias("over_of_detectable"),
        among("UNDER").alias("under_of_detectable"),
        median("m_raw").alias("median_m_raw"),
        median("m_corr").alias("median_m_corr"),
        median("n_star", finite).alias("median_n_star"),
        median("n_t").alias("median_n_t"),
        median("n_c").alias("median_n_c"),
        median("m_min").alias("median_m_min"),
    )
    if sigma2 is not None:
        out = out.withColumn("sigma2", F.lit(float(sigma2)))
    return out


def spectrum_by(df: DataFrame, dim: str) -> DataFrame:
    """Regime shares and median shifts for each value of a dimension, such as the dose."""
    return df.groupBy(dim).agg(F.count("*").alias("n"), *regime_shares(), median("m_corr").alias("median_m"), median("m_raw").alias("median_m_raw"))


def multi_screen_spectrum(screens: dict[str, DataFrame]) -> DataFrame:
    """The summaries of several screens, one row each, in a single aggregation."""
    columns = ["screen", "regime", "detectable", "m_raw", "m_corr", "n_star", "n_t", "n_c", "m_min"]
    rows = None
    for name, df in screens.items():
        own = df.withColumn("screen", F.lit(name)).select(*columns)
        rows = own if rows is None else rows.unionByName(own)
    return spectrum_summary(rows, ["screen"])


def with_tolerances(df: DataFrame, thetas: list[float]) -> DataFrame:
    """Every condition judged at every tolerance."""
    grid = df.sparkSession.createDataFrame([(float(t),) for t in thetas], "theta double")
    return evidence(df.crossJoin(F.broadcast(grid)), theta="theta")


def tolerance_sweep(df: DataFrame, thetas: list[float]) -> DataFrame:
    return with_tolerances(df, thetas).groupBy("theta").agg(F.count("*").alias("n"), *regime_shares())


def topk_strong(df: DataFrame, k: int = 12, by: str = "m_corr", tie: str = "cond_id") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def angle_stats(df: DataFrame, theta: float = THETA, limit: float | None = None, angle: str = "angle") -> DataFrame:
    """The root mean square angle over theta with its error, and how often a limit is passed."""
    sq = F.col(angle) * F.col(angle)
    rms = F.sqrt(F.avg(sq))
    p = F.avg((F.col(angle) > (theta if limit is None else limit)).cast("double"))
    n = F.count("*")
    return df.agg(
        n.alias("n"),
        (rms / theta).alias("ratio"),
        F.when(rms > 0, F.stddev_samp(sq) / F.sqrt(n) / (rms * 2) / theta).alias("ratio_se"),
        p.alias("exceed"),
        F.sqrt(p * (1 - p) / n).alias("exceed_se"),
    )


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def quantile_vector(df: DataFrame, x: str) -> DataFrame:
    """Exact quantiles, the distance of the quartiles, and the 90th percentile, of any number of rows."""
    *q, p90 = exact_quantiles(df, x, [*QUANTILES, 0.9])
    names = [f"q{round(p * 100):02d}" for p in QUANTILES]
    row = (*q, None if q[0] is None else q[3] - q[1], p90)
    return df.sparkSession.createDataFrame([row], ", ".join(f"{c} double" for c in [*names, "iqr", "p90"]))


def layout_summary(cells: DataFrame, kept: Column) -> DataFrame:
    """Wells, plates, drugs, lines and rows before and after the filter.

    wells_per_plate is null unless all plates have the same number.
    """
    wells = cells.groupBy("plate").agg(F.count_distinct("sample").alias("w")).agg(F.when(F.min("w") == F.max("w"), F.max("w")).alias("wells_per_plate"))
    all_ = cells.agg(
        F.count_distinct("sample").alias("wells"),
        F.count_distinct("plate").alias("plates"),
        F.count_distinct("drug").alias("drugs"),
        F.count_distinct("line").alias("lines"),
        F.count("*").alias("cells_pre"),
        F.count_if(kept).alias("cells_post"),
        (F.count_if(~kept) * 100.0 / F.count("*")).alias("pct_filtered"),
    )
    return all_.crossJoin(F.broadcast(wells))


def plate_table(cells: DataFrame, kept: Column) -> DataFrame:
    return cells.groupBy("plate").agg(F.count_distinct("sample").alias("wells"), F.count("*").alias("cells_pre"), F.count_if(kept).alias("cells_post"))


def distribution_stats(df: DataFrame, x: str) -> DataFrame:
    """Least, exact median, mean, greatest, total and number, of any number of rows."""
    median = F.lit(exact_quantiles(df, x, [0.5])[0]).cast("double")
    return df.agg(F.min(x).alias("low"), median.alias("median"), F.round(F.avg(x), 1).alias("mean"), F.max(x).alias("high"), F.sum(x).alias("total"), F.count("*").alias("n"))


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """How often each value occurs, and the share of the most frequent one."""
    counts = df.groupBy(x).agg(F.count("*").alias("n"))
    top = counts.agg((F.max("n") / F.sum("n")).alias("majority"))
    return counts.crossJoin(F.broadcast(top))


def log_histogram(df: DataFrame, low: float = 20.0, high: float = 2e6, bins: int = 36) -> DataFrame:
    """Counts of finite quotas by regime and log-spaced bin; bin -1 is below the axis, ``bins`` beyond it."""
    seen = df.where((F.col("regime") != "NOT-DETECTABLE") & (F.col("n_star") < F.lit(INF)))
    at = F.floor((F.log10("n_star") - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low))) * bins)
    bin_ = F.when(F.col("n_star") < low, -1).when(F.col("n_star") == high, bins - 1).when(F.col("n_star") > high, bins).otherwise(F.least(at, F.lit(bins - 1)))
    return seen.groupBy("regime", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def kde_log10(df: DataFrame, x: str = "m_corr", low: float = -1.6, high: float = 1.5, points: int = 300) -> DataFrame:
    """A Gaussian density of log10 of the positive values on an even grid, with their median.

    The bandwidth is ``n**(-1/5)`` times the standard deviation.
    """
    logs = df.where(F.col(x) > 0).select(F.log10(x).alias("y"))
    stat = logs.agg(F.count("*").alias("n"), F.stddev_samp("y").alias("sd"), F.pow(F.lit(10.0), F.percentile("y", F.lit(0.5))).alias("median"))
    grid = df.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("g"))
    width = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    z = (F.col("g") - F.col("y")) / width
    mass = F.exp(z * z * -0.5) / (width * 2.5066282746310002)
    return logs.crossJoin(F.broadcast(stat)).crossJoin(F.broadcast(grid)).groupBy("g").agg(F.avg(mass).alias("density"), F.first("median").alias("median"))
