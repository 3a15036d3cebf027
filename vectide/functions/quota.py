"""How many rows a group needs before the direction of its mean shift is known.

Every function is a column expression over one row per condition. A condition
has a treated mean, a control mean, their row counts, and a diagonal noise
``ell`` (variance of each dimension). theta is the tolerated angle in radians.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.functions.vec import INF, col

THETA = 0.1
SNR_LIMIT = 1.5
GHOST = 50_000.0
REGIMES = ("OVER", "UNDER", "GHOST", "POOL-LIMITED", "NOT-DETECTABLE")
#: how cost grows with rows, by the name of a method (fixed values)
COMPLEXITY = {"linear": 1.0, "ram": 1.0, "storage": 1.0, "pca": 1.0, "quadratic": 2.0, "pairwise": 2.0, "kernel": 2.0, "distance": 2.0, "nlogn": None}

inf = lambda: F.lit(INF)


def perp_trace(u: Column | str, ell: Column | str) -> Column:
    """Noise across the direction u: the trace of the noise less its part along u."""
    along = F.zip_with(col(u), col(ell), lambda a, e: a * a * e)
    return vec.total(ell) - vec.total(along)


def full_trace(cov: Column | str, d: Column) -> Column:
    """The trace of a full matrix, given as its rows one after another."""
    return vec.total(F.filter(col(cov), lambda _, k: k % (d + 1) == 0))


def full_along(u: Column | str, cov: Column | str) -> Column:
    """Noise along the direction u for a full matrix."""
    d = F.size(col(u))
    return vec.total(F.transform(col(cov), lambda c, k: c * F.get(col(u), F.floor(k / d).cast("int")) * F.get(col(u), k % d)))


def perp_trace_full(u: Column | str, cov: Column | str) -> Column:
    """Noise across the direction u for a full matrix."""
    return full_trace(cov, F.size(col(u))) - full_along(u, cov)


def effective_dimensions_full(u: Column | str, cov: Column | str) -> Column:
    """``tr(M)**2 / tr(M**2)`` of the noise M across u, for a full matrix: tr(M**2) is tr(C**2) - 2 |Cu|**2 + (uCu)**2."""
    d = F.size(col(u))
    row = lambda i: vec.dot(F.slice(col(cov), i * d + 1, d), col(u))
    turned = vec.total(F.transform(F.sequence(F.lit(0), d - 1), lambda i: row(i) * row(i)))
    along, trace = full_along(u, cov), perp_trace_full(u, cov)
    square = vec.dot(cov, cov) - turned * 2 + along * along
    return F.when(square > 0, trace * trace / square).otherwise(F.lit(0.0))


def floor_trace(ell: Column | str, n_t: Column | str, n_c: Column | str) -> Column:
    """The squared length that noise alone gives a difference of two means."""
    return vec.total(ell) * (F.lit(1.0) / col(n_t) + F.lit(1.0) / col(n_c))


def quota_two_arm(trace: Column, m2: Column, n_c: Column, theta: Column | float = THETA) -> Column:
    """Rows needed given the control's size; infinite where the control itself is too small."""
    room = F.when(trace > 0, m2 * theta * theta / trace).otherwise(F.when(m2 > 0, inf()).otherwise(F.lit(0.0))) - F.lit(1.0) / n_c
    return F.when(room > 0, F.lit(1.0) / room).otherwise(inf())


def quota_large_pool(trace: Column, m2: Column, theta: Column | float = THETA) -> Column:
    """The quota as the control grows without bound."""
    return quota_two_arm(trace, m2, F.lit(INF), theta)


def quota_equal_arm(trace: Column, m2: Column, theta: Column | float = THETA) -> Column:
    """The quota where control and treated grow together: twice the large-pool one."""
    return quota_large_pool(trace, m2, theta) * 2


def quota_isotropic(sigma2: Column, d: Column | int, m: Column, n_c: Column, theta: Column | float = THETA) -> Column:
    return quota_two_arm(sigma2 * (F.lit(d) - 1 if isinstance(d, int) else d - 1), m * m, n_c, theta)


def m_min(trace: Column, n_c: Column, theta: Column | float = THETA) -> Column:
    """The least shift that any number of treated rows can resolve."""
    return F.sqrt(trace / (n_c * theta * theta))


def predicted_rms_angle(n: Column, sigma2: Column, d: int, m: Column) -> Column:
    """The angle that n rows in each arm leave."""
    return F.sqrt(sigma2 * 2 * (d - 1) / (n * m * m))


def classify(detectable: Column, n_star: Column, n_t: Column, ghost: float = GHOST) -> Column:
    """The regime; the first that holds counts."""
    return (
        F.when(~detectable, F.lit("NOT-DETECTABLE"))
        .when(n_star == inf(), F.lit("POOL-LIMITED"))
        .when(n_star > ghost, F.lit("GHOST"))
        .when(n_star < n_t, F.lit("OVER"))
        .otherwise(F.lit("UNDER"))
    )


def evidence(df: DataFrame, theta: float | str = THETA, ghost: float = GHOST) -> DataFrame:
    """Append m_raw, snr, detectable, tr_perp, m_corr, n_star, m_min and regime.

    Reads mu_t, mu_c, n_t, n_c and ell, the variances, or if there is a column
    ``cov`` a full matrix as its rows one after another. theta is a number or a
    column's name.
    """
    t = F.col(theta) if isinstance(theta, str) else F.lit(float(theta))
    df = df.withColumn("v", vec.minus("mu_t", "mu_c")).withColumn("m_raw", vec.norm("v")).withColumn("u", vec.unit("v"))
    if "cov" in df.columns:
        both = F.lit(1.0) / F.col("n_t") + F.lit(1.0) / F.col("n_c")
        df = df.withColumns({"tr_perp": perp_trace_full("u", "cov"), "tr_s": full_trace("cov", F.size("u")) * both})
    else:
        df = df.withColumns({"tr_perp": perp_trace("u", "ell"), "tr_s": floor_trace("ell", "n_t", "n_c")})
    df = df.withColumn("snr", F.when(F.col("tr_s") > 0, F.col("m_raw") / F.sqrt("tr_s")).otherwise(F.lit(0.0)))
    df = df.withColumns({"detectable": F.col("snr") > SNR_LIMIT, "m2_corr": F.greatest(F.col("m_raw") * F.col("m_raw") - F.col("tr_s"), F.lit(0.0))})
    df = df.withColumn("m_corr", F.sqrt("m2_corr"))
    df = df.withColumns({"n_star": quota_two_arm(F.col("tr_perp"), F.col("m2_corr"), F.col("n_c"), t), "m_min": m_min(F.col("tr_perp"), F.col("n_c"), t)})
    return df.withColumn("regime", classify(F.col("detectable"), F.col("n_star"), F.col("n_t"), ghost))


def effective_dimensions(u: Column | str, ell: Column | str) -> Column:
    """``tr(M)**2 / tr(M**2)`` of the noise M across u, in closed form for diagonal noise."""
    us2 = vec.total(F.zip_with(col(u), col(ell), lambda a, e: a * a * e * e))
    us1 = vec.total(F.zip_with(col(u), col(ell), lambda a, e: a * a * e))
    square = vec.total(F.transform(col(ell), lambda e: e * e)) - us2 * 2 + us1 * us1
    trace = perp_trace(u, ell)
    return F.when(square > 0, trace * trace / square).otherwise(F.lit(0.0))


def second_order_angle(u: Column | str, ell: Column | str, m: Column, n: Column) -> Column:
    """E[angle**2] of a mean of n rows to second order, for diagonal noise.

    With S the noise over n, P the projection across u and m the length: the
    first order is tr(PSP)/m**2; the lever arm adds 3 (uSu tr(PSP) + 2 uSPSu)/m**4,
    and the arc takes 2/3 (tr(PSP)**2 + 2 tr((PSP)**2))/m**4 off.
    """
    us1 = vec.total(F.zip_with(col(u), col(ell), lambda a, e: a * a * e)) / n
    us2 = vec.total(F.zip_with(col(u), col(ell), lambda a, e: a * a * e * e)) / (n * n)
    tr = perp_trace(u, ell) / n
    square = vec.total(F.transform(col(ell), lambda e: e * e)) / (n * n) - us2 * 2 + us1 * us1
    across = us2 - us1 * us1
    m2 = m * m
    lever = (us1 * tr + across * 2) * 3 / (m2 * m2)
    arc = (tr * tr + square * 2) * F.lit(2.0 / 3.0) / (m2 * m2)
    return tr / m2 + lever - arc


def resource_allocation(n_star: Column, n0: Column, complexity: str) -> tuple[Column, Column, Column]:
    """What trimming from n0 rows to the quota saves: status, share saved, gain in conditions."""
    if complexity not in COMPLEXITY:
        raise ValueError(f"unknown complexity: {complexity}")
    power = COMPLEXITY[complexity]
    if power is None:
        cost = lambda n: n * F.log(F.greatest(n, F.lit(2.0)))
        left = cost(n_star) / cost(n0)
    else:
        left = F.pow(n_star / n0, F.lit(power))
    over = n_star < n0
    status = F.when(n_star == inf(), F.lit("CONTROL-POOL-LIMITED")).when(over, F.lit("OVER")).otherwise(F.lit("UNDER"))
    saved = F.when(over, F.greatest(F.lit(1.0) - left, F.lit(0.0))).otherwise(F.lit(0.0))
    gain = F.when(n_star == inf(), F.lit(0.0)).when(over, n0 / n_star).otherwise(F.lit(1.0))
    return status, saved, gain


def large_pool_constant(trace: Column, sigma2: Column, theta: float = THETA) -> Column:
    """``(d - 1) sigma2 / theta**2`` with d as the rounded ratio of trace and sigma2."""
    return (F.bround(trace / sigma2, 0) - 1) * sigma2 / (theta * theta)


def aniso_iso_ratio(u: Column | str, ell: Column | str) -> Column:
    """Noise across u against what the mean variance would give."""
    d = F.size(col(ell)).cast("double")
    mean = vec.total(ell) / d
    return perp_trace(u, ell) / ((d - 1) * mean)


def rejected(df: DataFrame, theta: float = THETA) -> DataFrame:
    """The rows that no quota can be computed for, each with its first reason."""
    if theta <= 0:
        raise ValueError("theta must be above 0")
    shift = vec.norm(vec.minus("mu_t", "mu_c"))
    reason = (
        F.when(F.col("n_c").isNull(), F.lit("n_c is required"))
        .when(F.col("n_c") <= 0, F.lit("n_c must be above 0"))
        .when(F.size("ell") != F.size("mu_t"), F.lit("ell has another dimension"))
        .when(F.size("ell") < 2, F.lit("at least two dimensions are needed"))
        .when(F.exists("ell", lambda e: e < 0) | (vec.total("ell") <= 0), F.lit("variance must be above 0"))
        .when(shift == 0, F.lit("the shift has no length"))
    )
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def _inflation(frames: Iterator[pd.DataFrame], delta: float) -> Iterator[pd.DataFrame]:
    log = math.log(1 / delta)
    for f in frames:
        if not len(f):
            continue
        out = []
        for u, noise in zip(f.u, f.noise):
            u, s = np.asarray(u, dtype=float), np.asarray(list(noise), dtype=float)
            s = np.diag(s) if s.size == u.size else s.reshape(u.size, u.size)
            p = np.eye(u.size) - np.outer(u, u)
            values = np.maximum(np.linalg.eigvalsh(p @ s @ p), 0)
            trace = values.sum()
            wide = (trace + 2 * math.sqrt(log) * math.sqrt((values**2).sum()) + 2 * log * values.max()) / trace if trace > 0 else 1.0
            out.append((trace, wide, trace**2 / (values**2).sum() if trace > 0 else 0.0))
        yield f.drop(columns=["noise"]).assign(tr_perp=[o[0] for o in out], inflation=[o[1] for o in out], d_eff=[o[2] for o in out])


def confidence_quota(df: DataFrame, delta: float = 0.05, theta: float = THETA) -> DataFrame:
    """Append the inflated quota that holds with probability 1 - delta.

    Reads cond_id, u, m, n_c and ``noise``: the variances, or the rows of a full
    matrix one after another. The trace is inflated, not the quota.
    """
    if not 0 < delta < 1:
        raise ValueError("delta must be between 0 and 1")
    kept = df.select(F.col("cond_id").cast("string").alias("cond_id"), vec.doubles("u").alias("u"), F.col("m").cast("double").alias("m"), F.col("n_c").cast("double").alias("n_c"), vec.doubles("noise").alias("noise"))
    out = kept.mapInPandas(lambda it: _inflation(it, delta), "cond_id string, u array<double>, m double, n_c double, tr_perp double, inflation double, d_eff double")
    wide = F.col("tr_perp") * F.col("inflation")
    return out.withColumns({"n_star": quota_two_arm(F.col("tr_perp"), F.col("m") * F.col("m"), F.col("n_c"), theta), "n_confident": quota_two_arm(wide, F.col("m") * F.col("m"), F.col("n_c"), theta), "m_min_confident": m_min(wide, F.col("n_c"), theta)})
