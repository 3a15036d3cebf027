"""Queries of the quota functions, moments, controls and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import quota as Q
from vectide.functions import vec
from vectide.operators import moments as M
from vectide.operators import spectrum as S
from vectide.plans.base import (
    CELLS,
    D,
    EVIDENCE,
    KEYS,
    STANDARD,
    THETA,
    WITHIN,
    cells,
    cond_id,
    group_moments,
    judged,
    ks,
    q6,
    q6s,
    query,
    r6,
    flat,
    sql_evidence,
    sql_moments,
    standard,
    table,
    with_,
)

MOM = with_(CELLS, sql_moments())
Spark, Frame = SparkSession, DataFrame


@query(EVIDENCE + f"SELECT cond_id, {ks('round(t# - c#, 6) + 0.0 AS v_#')}, {ks('round(u#, 6) + 0.0 AS u_#')}, {q6s('m_raw')} FROM ev")
def p09_effect_vector(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", *flat("v"), *flat("u"), r6("m_raw", "m_raw"))


@query(EVIDENCE + f"SELECT cond_id, {q6s('tr_perp')} FROM ev")
def p10_perp_noise_trace(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", r6("tr_perp", "tr_perp"))


FULL = EVIDENCE[:-1] + ", pr AS (SELECT " + ", ".join(f"sum(r{i}{j}) / sum(n - 1) AS f{i}{j}" for i in range(D) for j in range(i, D)) + " FROM (SELECT brand, band, line, count(*) AS n, " + ", ".join(f"sum(x{i + 1} * x{j + 1}) - sum(x{i + 1}) * sum(x{j + 1}) / count(*) AS r{i}{j}" for i in range(D) for j in range(i, D)) + " FROM cells GROUP BY ALL)), fu AS (SELECT ev.*, " + " + ".join(f"f{i}{i}" for i in range(D)) + " AS whole, " + " + ".join(f"{1 if i == j else 2} * f{i}{j} * u{i + 1} * u{j + 1}" for i in range(D) for j in range(i, D)) + " AS along, " + " + ".join(f"{1 if i == j else 2} * f{i}{j} * f{i}{j}" for i in range(D) for j in range(i, D)) + " AS squares, " + " + ".join("power(" + " + ".join(f"f{min(i, j)}{max(i, j)} * u{j + 1}" for j in range(D)) + ", 2)" for i in range(D)) + " AS turned FROM ev CROSS JOIN pr)"


def full_noise(spark: Spark, sf: str) -> Frame:
    """The standard table beside the full pooled covariance of its groups."""
    cov = M.within_covariance(cells(spark, sf), KEYS, D)
    full = cov.unionByName(cov.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    rows = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "value"))), lambda c: c["value"]).alias("cov"))
    return standard(group_moments(spark, sf)).crossJoin(F.broadcast(rows))


@query(FULL + f" SELECT cond_id, {q6('whole - along', 'tr_perp')}, {q6('m_raw / sqrt(whole * (1 / n_t + 1 / n_c))', 'snr')} FROM fu")
def p10_perp_noise_trace_full(spark: Spark, sf: str) -> Frame:
    return Q.evidence(full_noise(spark, sf), THETA).select("cond_id", r6("tr_perp", "tr_perp"), r6("snr", "snr"))


@query(FULL + f" SELECT cond_id, {q6('power(whole - along, 2) / (squares - 2 * turned + along * along)', 'd_eff')} FROM fu")
def p18_effective_dimensions_full(spark: Spark, sf: str) -> Frame:
    return Q.evidence(full_noise(spark, sf), THETA).select("cond_id", r6(Q.effective_dimensions_full("u", "cov"), "d_eff"))


@query(EVIDENCE + f"SELECT cond_id, {q6s('tr_s', 'snr')}, detectable FROM ev")
def p11_two_arm_floor(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", r6("tr_s", "tr_s"), r6("snr", "snr"), "detectable")


@query(EVIDENCE + f"SELECT cond_id, {q6s('m2_corr', 'm_corr')} FROM ev")
def p12_bias_corrected_magnitude(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", r6("m2_corr", "m2_corr"), r6("m_corr", "m_corr"))


@query(EVIDENCE + f"SELECT cond_id, {q6('n_star', 'n_star')} FROM ev")
def p13_quota_two_arm(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", r6("n_star", "n_star"))


@query(EVIDENCE + f"SELECT cond_id, {q6s('m_min')} FROM ev")
def p14_m_min_floor(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", r6("m_min", "m_min"))


@query(EVIDENCE + f"SELECT cond_id, {q6('tr_perp / (m2_corr * 0.09)', 'large_pool')}, {q6('2 * tr_perp / (m2_corr * 0.09)', 'equal_arm')} FROM ev WHERE m2_corr > 0")
def p15_quota_large_pool_equal_arm(spark: Spark, sf: str) -> Frame:
    df = judged(spark, sf).where("m2_corr > 0")
    return df.select("cond_id", r6(Q.quota_large_pool(F.col("tr_perp"), F.col("m2_corr"), THETA), "large_pool"), r6(Q.quota_equal_arm(F.col("tr_perp"), F.col("m2_corr"), THETA), "equal_arm"))


@query(EVIDENCE + f"SELECT cond_id, {q6('CASE WHEN m_raw * m_raw * 0.09 / (3 * tr_all / 4) - 1 / n_c > 0 THEN 1 / (m_raw * m_raw * 0.09 / (3 * tr_all / 4) - 1 / n_c) ELSE CAST(' + chr(39) + 'Infinity' + chr(39) + ' AS DOUBLE) END', 'n_iso')} FROM ev")
def p16_quota_isotropic(spark: Spark, sf: str) -> Frame:
    df = judged(spark, sf)
    return df.select("cond_id", r6(Q.quota_isotropic(vec.total("ell") / D, D, F.col("m_raw"), F.col("n_c"), THETA), "n_iso"))


@query(with_(CELLS, sql_moments(), WITHIN, STANDARD, sql_evidence(ghost="300")) + "SELECT cond_id, regime FROM ev")
def p17_classify_regime(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf, ghost=300.0).select("cond_id", "regime")


EFF = f"power(tr_perp, 2) / (({ks('e# * e#', ' + ')}) - 2 * ({ks('u# * u# * e# * e#', ' + ')}) + power({ks('u# * u# * e#', ' + ')}, 2))"


@query(EVIDENCE + f"SELECT cond_id, {q6(EFF, 'd_eff')} FROM ev")
def p18_effective_dimensions(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", r6(Q.effective_dimensions("u", "ell"), "d_eff"))


#: the noise across u as a matrix, and powers of it whose columns turn to its strongest direction
ACROSS = EVIDENCE[:-1] + """, us AS (SELECT cond_id, m_corr, n_c, tr_perp, [u1, u2, u3, u4] AS u, [e1, e2, e3, e4] AS e FROM ev),
  ps AS (SELECT *, list_transform(range(4), lambda i: list_transform(range(4), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END - u[i + 1] * u[j + 1])) AS p FROM us),
  ms AS (SELECT *, list_transform(p, lambda r: list_transform(p, lambda c: list_sum(list_transform(range(4), lambda k: r[k + 1] * e[k + 1] * c[k + 1])))) AS m FROM ps)"""
POWERS = ACROSS.replace("WITH ", "WITH RECURSIVE ", 1) + """, pw AS (SELECT cond_id, 0 AS k, m AS q FROM ms UNION ALL
  SELECT cond_id, k + 1, list_transform(s, lambda r: list_transform(r, lambda c: c / (s[1][1] + s[2][2] + s[3][3] + s[4][4]))) FROM (SELECT cond_id, k, list_transform(q, lambda r: list_transform(q, lambda c: list_dot_product(r, c))) AS s FROM pw WHERE k < 16)),
  lead AS (SELECT cond_id, list_transform(q, lambda r: r[1] + 0.7 * r[2] + 0.4 * r[3] + 0.9 * r[4]) AS v FROM pw WHERE k = 16),
  lam AS (SELECT *, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) / list_dot_product(v, v) AS top, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS squares FROM ms JOIN lead USING (cond_id)),
  inf AS (SELECT *, (tr_perp + 2 * sqrt(ln(20.0)) * sqrt(squares) + 2 * ln(20.0) * top) / tr_perp AS inflation FROM lam)"""
ROOM = "CASE WHEN m_corr * m_corr * 0.3 * 0.3 / ({t}) - 1 / n_c > 0 THEN 1 / (m_corr * m_corr * 0.3 * 0.3 / ({t}) - 1 / n_c) ELSE CAST('Infinity' AS DOUBLE) END"


@query(POWERS + f" SELECT cond_id, {q6s('tr_perp', 'inflation')}, {q6('tr_perp * tr_perp / squares', 'd_eff')}, {q6(ROOM.format(t='tr_perp'), 'n_star')}, {q6(ROOM.format(t='tr_perp * inflation'), 'n_confident')}, {q6('sqrt(tr_perp * inflation / (n_c * 0.3 * 0.3))', 'm_min_confident')} FROM inf")
def p19_confidence_quota(spark: Spark, sf: str) -> Frame:
    df = judged(spark, sf).select("cond_id", "u", F.col("m_corr").alias("m"), "n_c", F.col("ell").alias("noise"))
    return Q.confidence_quota(df, 0.05, THETA).select("cond_id", *[r6(c, c) for c in ("tr_perp", "inflation", "d_eff", "n_star", "n_confident", "m_min_confident")])


@query(EVIDENCE + f"SELECT cond_id, {q6('sqrt(2 * 3 * (tr_all / 4) / (n_t * m_raw * m_raw))', 'rms')} FROM ev WHERE m_raw > 0")
def p20_predicted_rms_angle(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).where("m_raw > 0").select("cond_id", r6(Q.predicted_rms_angle(F.col("n_t"), vec.total("ell") / D, D, F.col("m_raw")), "rms"))


@query(
    EVIDENCE
    + f""", s AS (SELECT *, ({ks('u# * u# * e#', ' + ')}) / n_t AS us1, ({ks('u# * u# * e# * e#', ' + ')}) / (n_t * n_t) AS us2, ({ks('e# * e#', ' + ')}) / (n_t * n_t) AS ee, tr_perp / n_t AS tr, m_raw * m_raw AS m2 FROM ev WHERE m_raw > 0)
    SELECT cond_id, {q6('tr / m2 + 3 * (us1 * tr + 2 * (us2 - us1 * us1)) / (m2 * m2) - (2.0 / 3.0) * (tr * tr + 2 * (ee - 2 * us2 + us1 * us1)) / (m2 * m2)', 'angle2')} FROM s"""
)
def p21_second_order_angle(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).where("m_raw > 0").select("cond_id", r6(Q.second_order_angle("u", "ell", F.col("m_raw"), F.col("n_t")), "angle2"))


@query(
    EVIDENCE
    + f"""SELECT cond_id, CASE WHEN n_star = CAST('Infinity' AS DOUBLE) THEN 'CONTROL-POOL-LIMITED' WHEN n_star < n_t THEN 'OVER' ELSE 'UNDER' END AS status,
    {q6('CASE WHEN n_star < n_t THEN greatest(1 - power(n_star / n_t, 2), 0) ELSE 0 END', 'saved_quadratic')},
    {q6('CASE WHEN n_star < n_t THEN greatest(1 - (n_star * ln(greatest(n_star, 2))) / (n_t * ln(greatest(n_t, 2))), 0) ELSE 0 END', 'saved_nlogn')},
    {q6("CASE WHEN n_star = CAST('Infinity' AS DOUBLE) THEN 0 WHEN n_star < n_t THEN n_t / n_star ELSE 1 END", 'gain')} FROM ev"""
)
def p22_resource_allocation(spark: Spark, sf: str) -> Frame:
    status, square, gain = Q.resource_allocation(F.col("n_star"), F.col("n_t"), "quadratic")
    _, nlogn, _ = Q.resource_allocation(F.col("n_star"), F.col("n_t"), "nlogn")
    return judged(spark, sf).select("cond_id", status.alias("status"), r6(square, "saved_quadratic"), r6(nlogn, "saved_nlogn"), r6(gain, "gain"))


@query(EVIDENCE + f"SELECT {q6('(round_even(tr_all / (tr_all / 4), 0) - 1) * (tr_all / 4) / 0.09', 'c')} FROM ev LIMIT 1")
def p23_large_pool_constant(spark: Spark, sf: str) -> Frame:
    ell = M.within_variance(group_moments(spark, sf), D)
    return ell.select(r6(Q.large_pool_constant(vec.total("ell"), F.col("sigma2"), THETA), "c"))


@query(EVIDENCE + f"SELECT cond_id, {q6('tr_perp / (3 * tr_all / 4)', 'ratio')} FROM ev")
def p24_aniso_iso_ratio(spark: Spark, sf: str) -> Frame:
    return judged(spark, sf).select("cond_id", r6(Q.aniso_iso_ratio("u", "ell"), "ratio"))


@query(with_(CELLS, sql_moments(), WITHIN, STANDARD) + f"SELECT cond_id, 'n_c must be above 0' AS reason FROM std WHERE n_c - (SELECT max(n_c) FROM std) / 1.0 < 0 UNION ALL SELECT cond_id, 'the shift has no length' FROM std WHERE n_c = (SELECT max(n_c) FROM std) AND {ks('t# = c#', ' AND ')}")
def p25_validate_inputs(spark: Spark, sf: str) -> Frame:
    std = standard(group_moments(spark, sf))
    top = std.agg(F.max("n_c").alias("top"))
    # only the lines with the largest control keep a size above 0 here
    broken = std.crossJoin(F.broadcast(top)).withColumn("n_c", F.when(F.col("n_c") < F.col("top"), F.lit(0.0)).otherwise(F.col("n_c")))
    return Q.rejected(broken, THETA).select("cond_id", "reason")


@query(EVIDENCE + f"SELECT cond_id, theta, {q6('CASE WHEN m2_corr > 0 THEN tr_perp / (m2_corr * theta * theta) ELSE CAST(' + chr(39) + 'Infinity' + chr(39) + ' AS DOUBLE) END', 'quota')} FROM ev CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) g(theta)")
def p26_tolerance_table(spark: Spark, sf: str) -> Frame:
    grid = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "theta double")
    df = judged(spark, sf).crossJoin(F.broadcast(grid))
    return df.select("cond_id", "theta", r6(Q.quota_large_pool(F.col("tr_perp"), F.col("m2_corr"), F.col("theta")), "quota"))


@query(MOM + f"SELECT brand, band, line, n, {ks('round(a#, 6) + 0.0 AS s1_#')}, {ks('round(b#, 6) + 0.0 AS s2_#')} FROM mom")
def a02_moments(spark: Spark, sf: str) -> Frame:
    return group_moments(spark, sf).select(*KEYS, "n", *flat("s1"), *flat("s2"))


@query(with_(CELLS, sql_moments("brand")) + f"SELECT brand, n, {ks('round(a#, 6) + 0.0 AS s1_#')} FROM mom")
def a03_merge_moments(spark: Spark, sf: str) -> Frame:
    parts = group_moments(spark, sf, ["brand", "plate", "line"])
    return M.merge_moments(parts, ["brand"], D).select("brand", "n", *flat("s1"))


@query(MOM + f"SELECT brand, band, line, {ks('round(a# / n, 6) + 0.0 AS mu_#')} FROM mom")
def a04_centroid(spark: Spark, sf: str) -> Frame:
    return M.centroid(group_moments(spark, sf)).select(*KEYS, *flat("mu"))


@query(with_(CELLS, sql_moments("line")) + f"SELECT line, CAST(n AS DOUBLE) AS n_c, {ks('round(a# / n, 6) + 0.0 AS mu_c_#')} FROM mom")
def a05_line_baseline(spark: Spark, sf: str) -> Frame:
    return M.line_baseline(group_moments(spark, sf), "line", D).select("line", "n_c", *flat("mu_c"))


CONTROLS = with_(CELLS, sql_moments("brand, band, line, plate", "parts"), f"ctl AS (SELECT plate, line, sum(n) AS nc, {ks('sum(a#) / sum(n) AS k#')} FROM parts WHERE brand IN ('Brand#1', 'Brand#2') GROUP BY plate, line)")


def plate_controls(spark: Spark, sf: str) -> tuple[Frame, Frame]:
    parts = group_moments(spark, sf, ["brand", "band", "line", "plate"])
    return parts, M.pooled_control(parts.where("brand in ('Brand#1', 'Brand#2')"), ["plate", "line"], D)


@query(CONTROLS + f"SELECT plate, line, CAST(nc AS DOUBLE) AS n_c, {ks('round(k#, 6) + 0.0 AS mu_c_#')} FROM ctl")
def a06_pooled_control(spark: Spark, sf: str) -> Frame:
    return plate_controls(spark, sf)[1].select("plate", "line", "n_c", *flat("mu_c"))


MATCHED = CONTROLS + f", ctl2 AS (SELECT * FROM ctl WHERE NOT (plate = 0 AND line = 'A')), met AS (SELECT p.brand, p.band, p.line, CAST(sum(p.n) AS DOUBLE) AS n_t, {ks('sum(p.a#) / sum(p.n) AS t#')}, {ks('sum(c.k# * p.n) / sum(p.n) AS c#')}, power(sum(p.n), 2) / sum(p.n * p.n / c.nc) AS n_c, bool_and(c.nc IS NOT NULL) AS whole FROM parts p LEFT JOIN ctl2 c ON c.plate = p.plate AND c.line = p.line WHERE p.brand NOT IN ('Brand#1', 'Brand#2') GROUP BY p.brand, p.band, p.line) "


def matched(spark: Spark, sf: str) -> Frame:
    parts, controls = plate_controls(spark, sf)
    some = controls.where("not (plate = 0 and line = 'A')")  # a control that is missing takes its conditions along
    return M.matched_control(parts.where("brand not in ('Brand#1', 'Brand#2')"), some, KEYS, ["plate", "line"], D)


@query(MATCHED + f"SELECT brand, band, line, {ks('round(c#, 6) + 0.0 AS mu_c_#')} FROM met WHERE whole")
def a07_matched_control_centroid(spark: Spark, sf: str) -> Frame:
    return matched(spark, sf).select(*KEYS, *flat("mu_c"))


@query(MATCHED + f"SELECT brand, band, line, n_t, {q6s('n_c')} FROM met WHERE whole")
def a08_effective_pool_size(spark: Spark, sf: str) -> Frame:
    return matched(spark, sf).select(*KEYS, "n_t", r6("n_c", "n_c"))


WITHIN_SQL = with_(CELLS, sql_moments(), WITHIN) + f"SELECT {ks('round(e#, 6) + 0.0 AS ell_#')}, round(({ks('e#', ' + ')}) / 4, 6) AS sigma2 FROM within_"


@query(WITHIN_SQL)
def a09_within_variance_two_pass(spark: Spark, sf: str) -> Frame:
    return M.within_variance_two_pass(cells(spark, sf), KEYS, D).select(*flat("ell"), r6("sigma2", "sigma2"))


@query(WITHIN_SQL)
def a10_within_variance(spark: Spark, sf: str) -> Frame:
    return M.within_variance(group_moments(spark, sf), D).select(*flat("ell"), r6("sigma2", "sigma2"))


LONG = "lng AS (SELECT brand, band, line, row_id, x1, x2, x3, x4, unnest([0, 1, 2, 3]) AS i FROM cells)"
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


@query(with_(CELLS, "g AS (SELECT brand, band, line, count(*) AS n, " + ", ".join(f"sum(x{i + 1} * x{j + 1}) - sum(x{i + 1}) * sum(x{j + 1}) / count(*) AS r{i}{j}" for i, j in PAIRS) + " FROM cells GROUP BY ALL HAVING count(*) >= 2)") + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(r{i}{j}) / sum(n - 1), 5) + 0.0 AS value FROM g" for i, j in PAIRS))
def a11_within_covariance(spark: Spark, sf: str) -> Frame:
    return M.within_covariance(cells(spark, sf), KEYS, D).select("i", "j", (F.round("value", 5) + 0.0).alias("value"))


@query(with_(CELLS) + " UNION ALL ".join(f"SELECT brand, line, {i} AS i, {j} AS j, round(covar_samp(x{i + 1}, x{j + 1}), 5) + 0.0 AS value FROM cells GROUP BY brand, line" for i, j in PAIRS))
def a12_group_covariance(spark: Spark, sf: str) -> Frame:
    return M.group_covariance(cells(spark, sf), ["brand", "line"], D).select("brand", "line", "i", "j", (F.round("value", 5) + 0.0).alias("value"))


@query(with_(CELLS) + f"SELECT {ks('round(var_pop(x#), 6) + 0.0 AS ell_#')} FROM cells")
def a13_marginal_variance(spark: Spark, sf: str) -> Frame:
    return M.marginal_variance(cells(spark, sf), D).select(*flat("ell"))


@query(
    with_(
        CELLS,
        f"mu AS (SELECT brand, {ks('avg(x#) AS m#')} FROM cells GROUP BY brand)",
        f"r AS (SELECT {ks('x# - m# AS x#')} FROM cells JOIN mu USING (brand))",
        "g AS (SELECT count(*) AS n, sum(power(x1 * x1 + x2 * x2 + x3 * x3 + x4 * x4, 2)) AS q, " + ", ".join(f"sum(x{i + 1} * x{j + 1}) / count(*) AS c{i}{j}" for i, j in PAIRS) + " FROM r)",
        "h AS (SELECT *, (" + " + ".join(f"c{i}{i}" for i in range(D)) + ") / 4 AS mu, " + " + ".join(f"{1 if i == j else 2} * c{i}{j} * c{i}{j}" for i, j in PAIRS) + " AS sq FROM g)",
        "s AS (SELECT *, greatest(least((q / n - sq) / n, sq - 4 * mu * mu), 0) / (sq - 4 * mu * mu) AS shrinkage FROM h)",
    )
    + "SELECT n, round(mu, 6) AS mu, round(shrinkage, 8) AS shrinkage, round(c00 * (1 - shrinkage) + shrinkage * mu, 6) AS c00, round(c01 * (1 - shrinkage), 6) + 0.0 AS c01 FROM s"
)
def a14_ledoit_wolf(spark: Spark, sf: str) -> Frame:
    df = M.ledoit_wolf(cells(spark, sf), ["brand"], D)
    return df.select("n", F.round("mu", 6).alias("mu"), F.round("shrinkage", 8).alias("shrinkage"), F.round(F.col("cov")[0], 6).alias("c00"), (F.round(F.col("cov")[1], 6) + 0.0).alias("c01"))


def layout_cells(spark: Spark, sf: str) -> Frame:
    return cells(spark, sf).select(F.concat_ws(".", "brand", F.col("plate").cast("string")).alias("sample"), "plate", F.col("brand").alias("drug"), "line", (F.col("x")[2] < 8).alias("full"))


LAYOUT = with_(CELLS, "lay AS (SELECT concat_ws('.', brand, plate) AS sample, plate, brand AS drug, line, x3 < 8 AS full_ FROM cells)")


@query(LAYOUT + "SELECT count(DISTINCT sample) AS wells, count(DISTINCT plate) AS plates, count(DISTINCT drug) AS drugs, count(DISTINCT line) AS lines, count(*) AS cells_pre, CAST(count_if(full_) AS BIGINT) AS cells_post, round(count_if(NOT full_) * 100.0 / count(*), 6) AS pct_filtered, (SELECT CASE WHEN min(w) = max(w) THEN max(w) END FROM (SELECT plate, count(DISTINCT sample) AS w FROM lay GROUP BY plate)) AS wells_per_plate FROM lay")
def a15_layout_summary(spark: Spark, sf: str) -> Frame:
    return S.layout_summary(layout_cells(spark, sf), F.col("full")).withColumn("pct_filtered", F.round(F.col("pct_filtered").cast("double"), 6))


@query(LAYOUT + "SELECT plate, count(DISTINCT sample) AS wells, count(*) AS cells_pre, CAST(count_if(full_) AS BIGINT) AS cells_post FROM lay GROUP BY plate")
def a15_plate_table(spark: Spark, sf: str) -> Frame:
    return S.plate_table(layout_cells(spark, sf), F.col("full"))


@query("WITH c AS (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1) SELECT min(k) AS low, quantile_cont(k, 0.5) AS median, round(avg(k), 1) AS mean, max(k) AS high, CAST(sum(k) AS BIGINT) AS total, count(*) AS n FROM c")
def a16_distribution_stats(spark: Spark, sf: str) -> Frame:
    return S.distribution_stats(table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k")), "k")


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_type, n, round((SELECT max(n) / sum(n) FROM c), 6) AS majority FROM c")
def a17_value_counts(spark: Spark, sf: str) -> Frame:
    return S.value_counts(table(spark, sf, "part"), "p_type").withColumn("majority", F.round("majority", 6))


SHARES = ", ".join(f"round(avg(CASE WHEN regime = '{r}' THEN 100.0 ELSE 0 END), 6) AS pct_{r.lower().replace('-', '_')}" for r in Q.REGIMES)
SUMMARY = f"""count(*) AS n, {SHARES}, round(avg(CASE WHEN detectable THEN 100.0 ELSE 0 END), 6) AS pct_detectable,
  round(CASE WHEN count_if(regime <> 'NOT-DETECTABLE') > 0 THEN count_if(regime = 'OVER') * 100.0 / count_if(regime <> 'NOT-DETECTABLE') END, 6) AS over_of_detectable,
  round(CASE WHEN count_if(regime <> 'NOT-DETECTABLE') > 0 THEN count_if(regime = 'UNDER') * 100.0 / count_if(regime <> 'NOT-DETECTABLE') END, 6) AS under_of_detectable,
  {', '.join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}" for c in ('m_raw', 'm_corr'))}, round(quantile_cont(n_star, 0.5) FILTER (WHERE n_star < CAST('Infinity' AS DOUBLE)), 6) AS median_n_star,
  {', '.join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}" for c in ('n_t', 'n_c', 'm_min'))}"""


def rounded(df: Frame) -> Frame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@query(EVIDENCE + f"SELECT {SUMMARY} FROM ev")
def a18_spectrum_summary(spark: Spark, sf: str) -> Frame:
    return rounded(S.spectrum_summary(judged(spark, sf)))


@query(EVIDENCE + f"SELECT band, count(*) AS n, {SHARES}, round(quantile_cont(m_corr, 0.5), 6) AS median_m, round(quantile_cont(m_raw, 0.5), 6) AS median_m_raw FROM ev GROUP BY band")
def a19_spectrum_by_dose(spark: Spark, sf: str) -> Frame:
    return rounded(S.spectrum_by(judged(spark, sf), "band"))


BASE = f"base AS (SELECT concat_ws('|', t.brand, t.band, t.line) AS cond_id, {ks('t.a# / t.n AS t#')}, {ks('l.a# / l.n AS c#')}, CAST(t.n AS DOUBLE) AS n_t, CAST(l.n AS DOUBLE) AS n_c, w.* FROM mom t JOIN (SELECT line, sum(n) AS n, {ks('sum(a#) AS a#')} FROM mom GROUP BY line) l ON l.line = t.line CROSS JOIN within_ w)"


def baseline_judged(spark: Spark, sf: str) -> Frame:
    m = group_moments(spark, sf)
    ell = M.within_variance(m, D).select("ell")
    std = M.centroid(m).join(M.line_baseline(m, "line", D), "line").crossJoin(F.broadcast(ell))
    return Q.evidence(std.select(cond_id(), F.col("mu").alias("mu_t"), "mu_c", F.col("n").cast("double").alias("n_t"), "n_c", "ell"), THETA)


@query(with_(CELLS, sql_moments(), WITHIN, STANDARD, sql_evidence(), BASE, sql_evidence(source="base", name="bev")) + f"SELECT 'shared' AS screen, {SUMMARY} FROM ev UNION ALL SELECT 'baseline' AS screen, {SUMMARY} FROM bev")
def a20_multi_screen_spectrum(spark: Spark, sf: str) -> Frame:
    return rounded(S.multi_screen_spectrum({"shared": judged(spark, sf), "baseline": baseline_judged(spark, sf)}))


SWEEP = with_(CELLS, sql_moments(), WITHIN, STANDARD, "swept AS (SELECT * FROM std CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE)) g(theta))", sql_evidence("theta", source="swept"))
THETAS = [0.1, 0.2, 0.3, 0.4]


@query(SWEEP + f"SELECT theta, count(*) AS n, {SHARES} FROM ev GROUP BY theta")
def a21_tolerance_sweep(spark: Spark, sf: str) -> Frame:
    return rounded(S.tolerance_sweep(standard(group_moments(spark, sf)), THETAS))


@query(EVIDENCE + f"SELECT cond_id, {q6s('m_corr')}, regime FROM ev ORDER BY ev.m_corr DESC, cond_id LIMIT 12")
def a22_topk_strong(spark: Spark, sf: str) -> Frame:
    return S.topk_strong(judged(spark, sf)).select("cond_id", r6("m_corr", "m_corr"), "regime")


ANG = with_(CELLS, sql_moments(), WITHIN, STANDARD, sql_evidence()) + ", a AS (SELECT sqrt(tr_perp / n_t) / m_raw AS angle FROM ev WHERE m_raw > 0) "


@query(ANG + "SELECT count(*) AS n, round(sqrt(avg(angle * angle)) / 0.3, 6) AS ratio, round(stddev_samp(angle * angle) / sqrt(count(*)) / (2 * sqrt(avg(angle * angle))) / 0.3, 6) AS ratio_se, round(avg(CASE WHEN angle > 0.3 THEN 1.0 ELSE 0 END), 6) AS exceed, round(sqrt(avg(CASE WHEN angle > 0.3 THEN 1.0 ELSE 0 END) * (1 - avg(CASE WHEN angle > 0.3 THEN 1.0 ELSE 0 END)) / count(*)), 6) AS exceed_se FROM a")
def a23_angle_stats(spark: Spark, sf: str) -> Frame:
    df = judged(spark, sf).where("m_raw > 0").select((F.sqrt(F.col("tr_perp") / F.col("n_t")) / F.col("m_raw")).alias("angle"))
    return rounded(S.angle_stats(df, THETA))


@query(EVIDENCE + "SELECT " + ", ".join(f"round(quantile_cont(m_corr, {p}), 6) AS q{round(p * 100):02d}" for p in S.QUANTILES) + ", round(quantile_cont(m_corr, 0.75) - quantile_cont(m_corr, 0.25), 6) AS iqr, round(quantile_cont(m_corr, 0.9), 6) AS p90 FROM ev")
def a24_quantile_vector(spark: Spark, sf: str) -> Frame:
    return rounded(S.quantile_vector(judged(spark, sf), "m_corr"))


@query(
    EVIDENCE
    + """SELECT regime, CASE WHEN n_star < 20 THEN -1 WHEN n_star = 2e6 THEN 35 WHEN n_star > 2e6 THEN 36 ELSE CAST(least(floor((log10(n_star) - log10(20)) / (log10(2e6) - log10(20)) * 36), 35) AS INT) END AS bin, count(*) AS n
    FROM ev WHERE regime <> 'NOT-DETECTABLE' AND n_star < CAST('Infinity' AS DOUBLE) GROUP BY 1, 2"""
)
def d1_log_histogram(spark: Spark, sf: str) -> Frame:
    return S.log_histogram(judged(spark, sf))


@query(
    EVIDENCE
    + """, l AS (SELECT log10(m_corr) AS y FROM ev WHERE m_corr > 0), s AS (SELECT stddev_samp(y) * power(count(*), -0.2) AS w, power(10, quantile_cont(y, 0.5)) AS median FROM l),
    g AS (SELECT -1.6 + i * (3.1 / 299) AS g FROM range(300) t(i))
    SELECT round(g, 6) AS g, round(avg(exp(-0.5 * power((g - y) / w, 2)) / (w * 2.5066282746310002)), 6) AS density, round(any_value(median), 6) AS median FROM g CROSS JOIN l CROSS JOIN s GROUP BY g"""
)
def d2_kde_log10(spark: Spark, sf: str) -> Frame:
    return rounded(S.kde_log10(judged(spark, sf)))
