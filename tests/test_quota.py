import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import quota as Q
from vectide.functions import vec

INF = float("inf")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def close(a, b, rel=1e-9):
    return a == b or math.isclose(a, b, rel_tol=rel)


@pytest.mark.parametrize(("n_c", "quota", "floor"), [(INF, 531.4457708397101, 0.0), (200000.0, 532.8617063410971, 0.15309849770654185), (3113.0, 640.8506418097388, 1.2271463689100826), (300.0, INF, 3.95298621297874)])
def test_isotropic_golden(spark, n_c, quota, floor):
    r = one(spark, q=Q.quota_isotropic(F.lit(0.9567), 50, F.lit(2.97), F.lit(n_c)), m=Q.m_min(F.lit(49 * 0.9567), F.lit(n_c)))
    assert close(r.q, quota) and close(r.m, floor)


GOLDEN = [
    (20000.0, 1e6, 0.5, 22.14037214, 0.4994897396, 2668.531424, 0.02576819745, "OVER"),
    (2000.0, 1e6, 0.5, 7.064007333, 0.4949646452, 2717.680476, 0.02576819745, "UNDER"),
    (200000.0, 1e7, 0.045, 6.301260378, 0.04442971978, 348081.3588, 0.008148619515, "GHOST"),
    (100.0, 400.0, 1.0, 2.828427125, 0.9354143467, INF, 1.288409873, "POOL-LIMITED"),
    (100.0, 400.0, 0.5, 1.414213562, 0.3535533906, INF, 1.288409873, "NOT-DETECTABLE"),
]


def standard(spark, rows):
    return spark.createDataFrame(rows, "cond_id string, mu_t array<double>, mu_c array<double>, n_t double, n_c double, ell array<double>")


def test_anisotropic_golden_and_every_regime(spark):
    rows = [(str(i), [0.6 * m, 0.8 * m, 0.0, 0.0], [0.0] * 4, n_t, n_c, [4.0, 3.0, 2.0, 1.0]) for i, (n_t, n_c, m, *_) in enumerate(GOLDEN)]
    got = {r.cond_id: r for r in Q.evidence(standard(spark, rows)).collect()}
    for i, (_, _, _, snr, m_corr, n_star, floor, regime) in enumerate(GOLDEN):
        r = got[str(i)]
        assert r.regime == regime
        assert close(r.snr, snr, 1e-8) and close(r.m_corr, m_corr, 1e-8) and close(r.n_star, n_star, 1e-8) and close(r.m_min, floor, 1e-8)
        assert close(r.tr_perp, 6.64)
    r = Q.evidence(standard(spark, rows[:1])).select(Q.effective_dimensions("u", "ell").alias("d")).first()
    assert close(r.d, 2.4159214448535855)


@pytest.mark.parametrize(("trace", "m", "n_c", "n"), [(31.866783367786667, 5.887394924241997, 33272.0, 92.19207612347088), (34.549195027466446, 0.6891795227097325, 8769.0, 42665.9701526681)])
def test_recorded_quotas(spark, trace, m, n_c, n):
    assert close(one(spark, q=Q.quota_two_arm(F.lit(trace), F.lit(m) * F.lit(m), F.lit(n_c))).q, n)


def test_arms_and_scaling(spark):
    t, m2 = F.lit(30.0), F.lit(4.0)
    r = one(spark, large=Q.quota_large_pool(t, m2), equal=Q.quota_equal_arm(t, m2), half=Q.quota_large_pool(t, m2 / 4), wide=Q.quota_large_pool(t, m2, 0.2), none=Q.quota_two_arm(t, F.lit(0.0), F.lit(100.0)))
    assert close(r.equal, 2 * r.large) and close(r.half, 4 * r.large) and close(r.wide, r.large / 4) and r.none == INF
    # a control as large as the equal-arm quota gives that quota back
    assert close(one(spark, q=Q.quota_two_arm(t, m2, F.lit(r.equal))).q, r.equal)


def test_confidence_golden(spark):
    df = spark.createDataFrame([("a", [1.0] + [0.0] * 49, 2.97, 3113.0, [0.9567] * 50), ("b", [1.0] + [0.0] * 49, 2.97, 3113.0, (np.eye(50) * 0.9567).reshape(-1).tolist())], "cond_id string, u array<double>, m double, n_c double, noise array<double>")
    for r in Q.confidence_quota(df, 0.05).collect():
        assert close(r.inflation, 1.6167943245620402) and close(r.n_confident, 1186.8201124011175) and close(r.m_min_confident, 1.5603562133474063) and close(r.d_eff, 49)
    with pytest.raises(ValueError):
        Q.confidence_quota(df, 1.0)


def test_allocation(spark):
    frame = spark.createDataFrame([(INF, 100.0), (200.0, 100.0), (50.0, 100.0)], "s double, n double")
    for name, saved in (("linear", 0.5), ("quadratic", 0.75), ("nlogn", 1 - 50 * math.log(50) / (100 * math.log(100)))):
        status, share, gain = Q.resource_allocation(F.col("s"), F.col("n"), name)
        rows = frame.select(status.alias("status"), share.alias("share"), gain.alias("gain")).collect()
        assert [r.status for r in rows] == ["CONTROL-POOL-LIMITED", "UNDER", "OVER"]
        assert [r.gain for r in rows] == [0.0, 1.0, 2.0] and rows[0].share == rows[1].share == 0.0 and close(rows[2].share, saved)
    with pytest.raises(ValueError):
        Q.resource_allocation(F.col("s"), F.col("n"), "unknown")


def test_rejected_rows_name_their_reason(spark):
    good = ("ok", [1.0, 0.0], [0.0, 0.0], 10.0, 10.0, [1.0, 1.0])
    rows = [good, ("a", *good[1:4], None, good[5]), ("b", *good[1:4], 0.0, good[5]), ("c", *good[1:5], [1.0]), ("d", [0.0, 0.0], *good[2:]), ("e", *good[1:5], [-1.0, 3.0]), ("f", [1.0], [0.0], 10.0, 10.0, [1.0])]
    got = {r.cond_id: r.reason for r in Q.rejected(standard(spark, rows)).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "f"}
    assert got["a"] == "n_c is required" and got["d"] == "the shift has no length"
    with pytest.raises(ValueError):
        Q.rejected(standard(spark, rows), 0.0)


def test_second_order_angle_by_simulation(spark):
    rng = np.random.default_rng(3)
    ell, u, m, n = np.array([4.0, 3, 2, 1]), np.array([0.6, 0.8, 0, 0]), 2.0, 40
    e = m * u + rng.normal(size=(400_000, 4)) * np.sqrt(ell / n)
    angle = np.arccos(np.clip(e @ u / np.linalg.norm(e, axis=1), -1, 1))
    df = spark.createDataFrame([(u.tolist(), ell.tolist())], "u array<double>, ell array<double>")
    got = df.select(Q.second_order_angle("u", "ell", F.lit(m), F.lit(float(n))).alias("a"), (Q.perp_trace("u", "ell") / n / m**2).alias("first")).first()
    assert abs(got.a / (angle**2).mean() - 1) < 0.01 < abs(got.first / (angle**2).mean() - 1) + 0.02


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, -3.0])], "a array<double>, z array<double>, b array<double>")
    r = df.select(vec.norm("a").alias("n"), vec.unit("z").alias("u"), vec.cosine("a", "b").alias("c"), vec.cosine("a", "z").alias("cz"), vec.angle("a", "a").alias("g")).first()
    assert r.n == 5 and r.u == [0, 0] and r.c == 0 and r.cz == 0 and abs(r.g) < 1e-7
