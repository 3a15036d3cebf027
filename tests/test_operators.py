import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.functions.quota import evidence
from vectide.operators import embed as E
from vectide.operators import graph as G
from vectide.operators import moments as M
from vectide.operators import qc as C
from vectide.operators import resample as R
from vectide.operators import spectrum as S
from vectide.sources import ingest as I
from vectide.streaming import moments as T

GROUPS = {"a": [(1, 2), (3, 4), (5, 9)], "b": [(0, 0), (2, 2)], "c": [(7, 7)]}


def rows(spark):
    return spark.createDataFrame([(g, [float(x), float(y)]) for g, ps in GROUPS.items() for x, y in ps], "g string, x array<double>")


def test_within_variance_golden_both_ways(spark):
    m = M.moments(rows(spark), ["g"], 2)
    for r in (M.within_variance(m, 2).first(), M.within_variance_two_pass(rows(spark), ["g"], 2).first()):
        assert np.allclose(r.ell, [10 / 3, 28 / 3]) and math.isclose(r.sigma2, 19 / 3)
    assert M.within_variance(m.where("n < 2"), 2).count() == 0


def test_moments_merge_in_any_order(spark):
    parts = rows(spark).withColumn("p", F.col("x")[0] > 2)
    merged = M.merge_moments(M.moments(parts, ["g", "p"], 2), ["g"], 2)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, M.moments(rows(spark), ["g"], 2).collect()))


def test_matched_control_pools_and_drops(spark):
    parts = spark.createDataFrame([("d", 1, 100, [100.0], [1.0]), ("d", 2, 300, [600.0], [1.0]), ("e", 1, 5, [5.0], [1.0]), ("e", 3, 5, [5.0], [1.0])], "cond string, plate int, n long, s1 array<double>, s2 array<double>")
    controls = spark.createDataFrame([(1, [10.0], 1000.0), (2, [20.0], 2000.0)], "plate int, mu_c array<double>, n_c double")
    got = M.matched_control(parts, controls, ["cond"], ["plate"], 1).collect()
    assert len(got) == 1 and got[0].cond == "d"
    assert math.isclose(got[0].n_c, 2909.090909090909) and got[0].mu_c == [17.5] and got[0].mu_t == [1.75]


def test_pooled_control_keeps_every_well(spark):
    m = spark.createDataFrame([(1, "w1", 1, [1.0], [1.0]), (1, "w2", 3, [9.0], [9.0])], "plate int, well string, n long, s1 array<double>, s2 array<double>")
    r = M.pooled_control(m, ["plate"], 1).first()
    assert r.mu_c == [2.5] and r.n_c == 4


def test_covariances(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "g int, x array<double>")
    res = np.concatenate([x[i::3] - x[i::3].mean(axis=0) for i in range(3)])
    want = res.T @ res / 57
    assert all(math.isclose(r.value, want[r.i, r.j], abs_tol=1e-9) for r in M.within_covariance(df, ["g"], 3).collect())
    own = M.group_covariance(df, ["g"], 3).where("g = 1").collect()
    assert len(own) == 6 and all(math.isclose(r.value, np.cov(x[1::3].T)[r.i, r.j], abs_tol=1e-9) for r in own)
    n, s = len(res), res.T @ res / len(res)
    mu = np.trace(s) / 3
    delta = ((s - mu * np.eye(3)) ** 2).sum()
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in res) / n**2, delta)
    got = M.ledoit_wolf(df, ["g"], 3).first()
    assert math.isclose(got.shrinkage, beta / delta, rel_tol=1e-9)
    assert math.isclose(got.cov[1], (1 - beta / delta) * s[0, 1], abs_tol=1e-9)


def test_qc_rules(spark):
    df = spark.createDataFrame([(1, "A_1|A_2"), (2, "A_1;B_2"), (3, "nan| A"), (4, None)], "i int, guide string")
    assert [r.i for r in C.guide_concordance_filter(df, "guide").orderBy("i").collect()] == [1, 3, 4]
    assert C.guide_concordance_filter(df, None).count() == 4
    mito = spark.createDataFrame([(1, 10.0, 50.0), (2, 10.0, 5.0), (3, 10.0, float("nan"))], "i int, umi double, mito double")
    assert [r.i for r in C.high_mito_filter(mito, "umi", "mito", 1.0).collect()] == [2]
    labels = spark.createDataFrame([("Non-targeting", 50), ("control x", 80), ("gene", 900)], "label string, n long")
    assert C.detect_control_label(labels, "label") == "control x"
    kept = [r.label for r in C.scored_condition_filter(labels, "label", "control x").collect()]
    assert sorted(kept) == ["Non-targeting", "gene"]
    with pytest.raises(ValueError):
        C.detect_control_label(labels.where("label = 'gene'"), "label")
    with pytest.raises(ValueError):
        C.resolve_columns(spark.createDataFrame([(1,)], "umi int"))
    assert C.contiguous_ids(spark.range(5), "id").count() == 0 and C.contiguous_ids(spark.range(1, 5), "id").count() == 1
    assert C.shares_sum(spark.createDataFrame([(50.0, 49.0)], "a double, b double"), ["a", "b"]).count() == 1
    arrays = spark.createDataFrame([([1, 5, 9], [1.0, 2.0, 3.0])], "g array<int>, v array<double>")
    assert C.drop_special_in_arrays(arrays, "g", "v").first() == ([5, 9], [2.0, 3.0])


def test_keys_and_doses(spark):
    df = spark.createDataFrame([("a|b|c", "[('Drug A', 5.0, 'uM')]"), ("x|y", None), ("p|q", ""), ("r|s", "plain")], "k string, d string")
    left, right = I.split_key("k")
    got = df.select(left.alias("l"), right.alias("r"), I.parse_dose("d").alias("dose"), I.parse_drug("d").alias("drug")).collect()
    assert [(r.l, r.r) for r in got] == [("a|b", "c"), ("x", "y"), ("p", "q"), ("r", "s")]
    assert got[0].dose == 5.0 and all(math.isnan(r.dose) for r in got[1:])
    assert [r.drug for r in got] == ["Drug A", "?", "?", "plain"]


def test_samples_are_spread_and_disjoint(spark):
    df = spark.range(40).selectExpr("id % 20 as shard")
    a = {r.shard for r in I.systematic_sample(df, "shard", 6).collect()}
    b = {r.shard for r in I.disjoint_sample(df, "shard", 6).collect()}
    assert a == {0, 4, 8, 11, 15, 19} and len(b) == 6 and not a & b
    assert I.systematic_indices(3, 5) == [0, 1, 2]


def test_files_round_trip(spark, tmp_path):
    m = M.moments(rows(spark), ["g"], 2)
    I.write_moments(m, str(tmp_path / "m"))
    assert sorted(map(tuple, I.read_moments(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, m.collect()))
    df = spark.createDataFrame([("c", 1.0, 1.0, 5.0, 5.0, float("inf"), "POOL-LIMITED")], ", ".join(f"{c} {'string' if c in ('cond_id', 'regime') else 'double'}" for c in I.RESULT))
    I.write_condition_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first().n_star == float("inf")
    I.write_condition_table(df, str(tmp_path / "c"), "csv")
    assert float(spark.read.csv(str(tmp_path / "c"), header=True).first().n_star) == -1
    (tmp_path / "k.json").write_text('{"sigma2": 0.5, "ell": [1.0, 2.0]}')
    assert I.read_calibration(spark, str(tmp_path / "k.json")).first().ell == [1.0, 2.0]
    I.write_report(df.select("regime", "n_t"), str(tmp_path / "r"), "regime", ["n_t"])
    assert spark.read.text(str(tmp_path / "r/markdown")).first().value == "| POOL-LIMITED | 5.0 |"


def planted(spark, n=300, d=6, m=2.0):
    rng = np.random.default_rng(5)
    out = [(f"{g}|{i}", g, "L", (rng.normal(size=d) + (m if g == "t" else 0) * np.eye(d)[0]).tolist()) for g in ("t", "k") for i in range(n)]
    return spark.createDataFrame(out, "row_id string, g string, line string, x array<double>").repartition(3).cache(), d


def groups(rows_, d, control):
    return R.describe_groups(M.moments(rows_.where("g = 't'"), ["g", "line"], d), control, "line")


def test_draws_do_not_depend_on_partitions(spark):
    df, _ = planted(spark)
    depths = spark.createDataFrame([("t", "L", 20, 300), ("t", "L", 299, 300)], "g string, line string, n long, size long")
    draw = lambda x: sorted((r.n, r.rep, r.row_id) for r in R.subsample(x, depths, ["g", "line"], "row_id", 3).collect())
    a = draw(df)
    assert a == draw(df.repartition(11)) and len(a) == 3 * (20 + 299)


@pytest.mark.parametrize("chunk", [100_000, 70])
def test_draws_equal_brute_force_in_any_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    df, d = planted(spark)
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % R.PRIME
    x = {r.row_id: r.x for r in df.where("g = 't'").collect()}
    depths = spark.createDataFrame([("t", "L", n, 300) for n in (5, 20, 150, 299)], "g string, line string, n long, size long")
    want = {}
    for n in (5, 20, 150, 299):
        for rep in range(4):
            a, b = number(f"{n}|{rep}|7|a"), number(f"{n}|{rep}|7|b")
            want[n, rep] = sorted(x, key=lambda r: ((number(r) * a + b) % R.PRIME, r))[:n]
    got = {}
    for r in R.subsample(df, depths, ["g", "line"], "row_id", 4, 7).collect():
        got.setdefault((r.n, r.rep), []).append(r.row_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    means = R.drawn_means(df, depths, ["g", "line"], "row_id", d, 4, 7).collect()
    assert len(means) == 16 and all(np.allclose(r.mu_n, np.mean([x[i] for i in want[r.n, r.rep]], axis=0)) for r in means)


@pytest.mark.parametrize("chunk", [100_000, 70])
def test_draw_extents_send_one_row_for_each_draw(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    df, _ = planted(spark)
    depths = spark.createDataFrame([("t", "L", n, 300) for n in (5, 150, 299)], "g string, line string, n long, size long")
    drawn = R.subsample(df, depths, ["g", "line"], "row_id", 3, 7).groupBy("n", "rep").agg(F.count("*"), F.min("row_id"), F.max("row_id"))
    extents = R.draw_extents(df, depths, ["g", "line"], "row_id", 3, 7)
    assert sorted(map(tuple, extents.select("n", "rep", "rows", "low", "high").collect())) == sorted(map(tuple, drawn.collect()))


def test_draws_where_names_repeat():
    rng = np.random.default_rng(3)
    h, values = np.sort(np.repeat(rng.integers(0, R.PRIME, 60), 50)), rng.normal(size=(3000, 2))
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % R.PRIME
    got = R._draw_whole(h, 900, 3000, 20, 0, lambda: R._Sums(pa.scalar(values.tobytes(), pa.binary()), 3000, 20)).sums
    for rep in range(20):
        key = (h * number(f"900|{rep}|0|a") + number(f"900|{rep}|0|b")) % R.PRIME
        want = np.argsort(key, kind="stable")[:900]
        want = want[key[want] <= R.PRIME * (900 + 8 * 30 + 32) / 3000]  # as the SQL has it
        assert np.allclose(got[rep], [*values[want].sum(axis=0), len(want)])


def test_scaled_keys_compare_as_keys_do():
    keys = np.array([0, 1, 2, 1014138928, R.PRIME - 2, R.PRIME - 1])
    a, b = (np.array([R._factors(40, 50, 1)[k][:, 0]]).T for k in (0, 1))
    number = lambda rep, which: int(hashlib.md5(f"40|{rep}|1|{which}".encode()).hexdigest()[:8], 16) % R.PRIME
    exact = np.array([[(int(k) * number(r, "a") + number(r, "b")) % R.PRIME for k in keys] for r in range(50)])
    half = keys * a + b >> 32
    assert (R._key_of(half) == exact).all()
    top = np.vectorize(R._top)(exact)
    assert (half <= top).all() and (half > np.vectorize(R._top)(exact - 1)).all()


def test_curves_follow_the_prediction(spark):
    df, d = planted(spark, 600, 6, 4.0)
    control = spark.createDataFrame([("L", [0.0] * d)], "line string, mu_c array<double>")
    g = groups(df, d, control)
    points, record = R.heldout_curves(df, g, ["g", "line"], "row_id", d, 5, 200)
    r = record.first()
    assert 0.85 < r.ratio < 1.15 and r.r2 > 0.98 and r.rho2 > 3
    assert R.mean_relative_error(points).first().error < 0.25
    halves = R.two_halves(df, g, ["g", "line"], "row_id", d, 4, 200).first()
    assert 1.2 < halves.ratio < 1.65
    std = g.select("g", "line", F.col("mu").alias("mu_t"), "mu_c", F.col("size").cast("double").alias("n_t"), F.lit(1e9).alias("n_c"), "ell")
    judged = evidence(std, 0.2).withColumn("size", F.col("n_t").cast("long"))
    assert judged.first().regime == "OVER"
    gated = R.gate(df, judged, ["g", "line"], "row_id", d, 0.2, 40)
    report = R.gate_report(gated).first()
    assert report.predicted == 1 and report.verified == 1 and report.pass_fraction == 1.0
    assert R.gate_report(gated.where("false")).first().pass_fraction == 1.0 and R.gate_exceptions(gated).count() == 0


def test_depth_grid(spark):
    got = spark.createDataFrame([(100,), (30,), (10,)], "n long").select(R.half_grid("n", 4).alias("g")).collect()
    assert [r.g for r in got] == [[20, 27, 37, 50], [20, 25], []]


def test_rank_correlation_and_splits(spark):
    rec = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 3.0, 6.0), (2.0, 2.0, 7.0), (4.0, 9.0, 8.0)], "a double, b double, rho2 double")
    assert math.isclose(R.spearman(rec, F.col("a"), F.col("b")).first().spearman, 0.9486832980505138)
    split = R.hi_lo_snr_split(rec.withColumn("ratio", F.col("a"))).first()
    assert (split.ratio_high, split.ratio_low) == (3.0, 1.5)
    summary = {r.dataset: r.n for r in R.heldout_summary(rec.selectExpr("'x' dataset", "500 size", "a ratio", "b r2", "rho2"), spark.createDataFrame([("x",), ("y",)], "dataset string")).collect()}
    assert summary == {"x": 4, "y": 0}


def test_knn_equals_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(f"n{i:02d}", f"e{i % 4}", v.tolist()) for i, v in enumerate(u)], "id string, drug string, u array<double>")
    c = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T
    want = {f"n{i:02d}": [f"n{j:02d}" for j in sorted((j for j in range(40) if j % 4 != i % 4), key=lambda j: -c[i, j])[:3]] for i in range(40)}
    for block in (7, 1000):
        got = {}
        for r in G.knn(df, 3, "drug", block).orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append(r.dst)
        assert got == want
    e = G.knn(df, 3, "drug")
    assert G.graph_jaccard(e, e).first().jaccard == 1.0


def test_budgets(spark):
    df = spark.createDataFrame([("a", 50.0, 1.0, 1.0), ("b", 150.0, 3.0, 1.0), ("c", float("inf"), 1.0, 0.0)], "cond_id string, n_star double, tr_perp double, m2_corr double")
    assert {r.rows for r in G.allocate_flat(df, 300).collect()} == {100.0}
    assert [r.rows for r in G.allocate_capped(df, 100).orderBy("cond_id").collect()] == [50.0, 100.0, 100.0]
    curve, first = G.budget_curve(df, [50.0, 150.0], 0.15, 0.6)
    assert {r.cap: round(r.adaptive, 3) for r in curve.collect()} == {50.0: 0.333, 150.0: 0.667}
    assert first.first().first_adaptive == 350.0
    cost = G.cost_translation(df, 100.0, 2.0).first()
    assert math.isclose(cost.uniform_rows, 280.0) and math.isclose(cost.adaptive_rows, 150.0)
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, value double")
    b = spark.createDataFrame([("x", 2.0), ("z", 3.0)], "name string, value double")
    got = {r.name: (r.old, r.new, r.delta) for r in G.compare_metrics(a, b).collect()}
    assert got == {"x": ("1.000000", "2.000000", 1.0), "y": ("2.000000", "--", None), "z": ("--", "3.000000", None)}


def test_principal_components(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6)) * [5, 4, 3, 2, 1, 1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, x array<double>").repartition(3)
    w, mu, info = E.fit_pca(df, 6, 3)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose([r["var"] for r in info.orderBy("pc").collect()], values[:3])
    assert E.orthonormality_residual(w).first().residual < 1e-9
    assert math.isclose(E.subspace_overlap(w, w, 3).first().overlap, 1.0)
    assert E.angle_summary(E.principal_angles(w, w)).first().largest < 1e-3
    dense = {r.cell: r.x for r in E.project_dense(df, w, mu).collect()}
    assert np.allclose(np.cov(np.array([dense[i] for i in range(200)]).T), np.diag(values[:3]), atol=1e-8)
    long = df.select("cell", F.posexplode("x").alias("gene", "log")).withColumn("gene", F.col("gene").cast("long"))
    tidy = E.project_cells(long, df, w, mu).where("cell = 5").orderBy("pc").collect()
    assert np.allclose([r.x for r in tidy], dense[5])


def test_hvg_and_sparse_counts(spark):
    df = spark.createDataFrame([(1, [3, 4], [1.0, 2.0]), (2, [4, 5], [0.0, 0.0])], "c long, g array<long>, v array<double>")
    counts = E.long_counts(df, "c", "g", "v")
    assert counts.count() == 4 and {r.cell: r.total for r in E.total_counts(counts).collect()} == {1: 3.0, 2: 1.0}
    logs = E.normalize_log1p(counts)
    assert math.isclose(logs.where("cell = 1 and gene = 4").first().log, math.log1p(2 / 3 * 1e4))
    cells = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "cell long, cond string")
    assert E.pseudobulk(logs, cells, "cond")[1].first().n == 3
    stats = spark.createDataFrame([(str(i), 1.0 + i, (1.0 + i) * (3 if i == 4 else 1)) for i in range(10)], "gene string, mean double, var double")
    assert E.select_hvg(stats, 1, bins=1).first().gene == "4"


def test_summaries(spark):
    df = spark.createDataFrame([("OVER", True, 1.0, 1.0, 10.0, 20.0, 5.0, 0.1, "a"), ("NOT-DETECTABLE", False, 2.0, 0.0, float("inf"), 20.0, 5.0, 0.1, "b"), ("UNDER", True, 3.0, 2.0, 30.0, 20.0, 5.0, 0.1, "c")], "regime string, detectable boolean, m_raw double, m_corr double, n_star double, n_t double, n_c double, m_min double, cond_id string")
    r = S.spectrum_summary(df).first()
    assert math.isclose(r.pct_over, 100 / 3) and r.over_of_detectable == 50 and r.median_n_star == 20.0 and r.n == 3
    none = S.spectrum_summary(df.where("regime = 'NOT-DETECTABLE'")).first()
    assert none.over_of_detectable is None and none.median_n_star is None
    assert S.topk_strong(df, 1).first().cond_id == "c"
    hist = {(x.regime, x.bin): x.n for x in S.log_histogram(df).collect()}
    assert hist == {("OVER", -1): 1, ("UNDER", 1): 1}
    assert 0.9 < S.kde_log10(df).agg((F.sum("density") * 3.1 / 299).alias("a")).first().a <= 1.01


def test_stream_restarts_and_equals_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    half = tmp_path / "in"
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(str(half / "a.parquet"))
    run = lambda: T.merge_batches(T.event_rows(T.shard_stream(spark, f"{half}/*.parquet", T.EVENTS, 1)), ["cond", "line"], 2, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    events.where("event_id % 2 = 1").coalesce(1).write.parquet(str(half / "b.parquet"))
    run()
    run()
    got = sorted((r.cond, r.line, r.n, round(r.s1[0], 6)) for r in T.merged(spark, str(tmp_path / "out"), ["cond", "line"], 2).collect())
    want = sorted((r.cond, r.line, r.n, round(r.s1[0], 6)) for r in M.moments(T.event_rows(events), ["cond", "line"], 2).collect())
    assert got == want


def test_group_covariances_over_shares_and_missing_keys(spark, monkeypatch):
    """Groups that several tasks share, keys with nulls, and groups of one row."""
    monkeypatch.setattr(M, "SHARE", 40)
    rng = np.random.default_rng(7)
    keys = [("a", 1)] * 300 + [("a", None)] * 50 + [(None, 1)] * 30 + [("b", 2)] + [("c", 3)] * 90
    x = rng.normal(size=(len(keys), 12)) @ rng.normal(size=(12, 12))
    df = spark.createDataFrame([(g, h, v.tolist()) for (g, h), v in zip(keys, x)], "g string, h int, x array<double>").repartition(5)
    got = {(r.g, r.h, r.i, r.j): r.value for r in M.group_covariance(df, ["g", "h"], 12).collect()}
    want = {}
    for key in set(keys):
        own = x[[k == key for k in keys]]
        if len(own) > 1:
            cov = np.cov(own.T)
            want |= {(*key, i, j): cov[i, j] for i in range(12) for j in range(i, 12)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_ledoit_wolf_of_many_entries(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 20)) @ rng.normal(size=(20, 20))
    df = spark.createDataFrame([(i % 4, v.tolist()) for i, v in enumerate(x)], "g int, x array<double>")
    res = np.concatenate([x[i::4] - x[i::4].mean(axis=0) for i in range(4)])
    s = res.T @ res / 80
    mu, q = np.trace(s) / 20, ((res**2).sum(axis=1) ** 2).sum()
    delta = (s**2).sum() - 20 * mu * mu
    part = min((q / 80 - (s**2).sum()) / 80, delta) / delta
    got = M.ledoit_wolf(df, ["g"], 20).first()
    assert math.isclose(got.shrinkage, part, rel_tol=1e-9)
    want = (s * (1 - part) + np.eye(20) * part * mu)[np.triu_indices(20)]
    assert np.allclose(got.cov, want)


def test_samples_by_file_open_only_their_files(spark, tmp_path):
    rows = [(i % 30 if i % 30 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "shard int, v int")
    path = f"file://{tmp_path}/t"
    df.repartition("shard").write.partitionBy("shard").parquet(path)
    first, second = I.sampled_shards(spark, path, "shard", 7), I.sampled_shards(spark, path, "shard", 7, second=True)
    key = lambda d: sorted((r.shard or 0, r.v) for r in d.collect())
    assert key(first) == key(I.systematic_sample(df.fillna({"shard": -1}), "shard", 7).replace({-1: 0}, subset=["shard"])) and key(second) == key(I.disjoint_sample(df.fillna({"shard": -1}), "shard", 7).replace({-1: 0}, subset=["shard"]))
    assert not {r[0] for r in key(first)} & {r[0] for r in key(second)}
    assert len({f.rsplit("/", 2)[1] for f in first.inputFiles()}) == 7
    # by file, in order of names
    spark.range(100).repartition(10).write.parquet(f"{path}-files")
    whole, some = spark.read.parquet(f"{path}-files"), I.sampled_shards(spark, f"{path}-files", None, 3)
    assert sorted(some.inputFiles()) == [sorted(whole.inputFiles())[i] for i in I.systematic_indices(len(whole.inputFiles()), 3)]
    assert I.sampled_shards(spark, path, "shard", 0).count() == 0


def test_exact_quantiles_equal_percentile(spark):
    from vectide.operators.quantiles import exact_quantiles

    shares = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    cases = {
        "spread": "rand(1) * exp(rand(2) * 200 - 100)",
        "ties": "if(id % 3 = 0, 5.0, if(id % 5 = 0, -1.0, rand(3)))",
        "two": "cast(id % 2 as double)",
        "one": "7.0",
        "heavy ends": "if(id < 1500, 0.0, if(id > 3500, 1.0, rand(4)))",
        "nulls": "if(id % 2 = 0, null, cast(id as double))",
    }
    for name, form in cases.items():
        df = spark.range(5000).selectExpr(f"{form} as v").cache()
        want = df.agg(F.percentile("v", F.lit(shares)).alias("q")).first().q
        for few in (50_000, 60):
            assert exact_quantiles(df, "v", shares, few) == pytest.approx(want, rel=1e-12), (name, few)
        df.unpersist()
    assert exact_quantiles(spark.range(0).selectExpr("cast(id as double) v"), "v", [0.5]) == [None]


def test_folds_survive_being_stopped(spark, sf, tmp_path):
    """Whatever a fold leaves undone, the moments of all batches come out once."""
    import shutil

    events = spark.read.parquet(f"{sf}/events.parquet")
    folder, out, keys = tmp_path / "in", str(tmp_path / "out"), ["cond", "line"]
    run = lambda: T.merge_batches(T.event_rows(T.shard_stream(spark, f"{folder}/*.parquet", T.EVENTS, 1)), keys, 2, out, str(tmp_path / "ck")).awaitTermination()
    sums = lambda m: sorted((r.cond, r.line, r.n, round(r.s1[0], 6), round(r.s2[1], 4)) for r in m.collect())
    now = lambda: sums(T.merged(spark, out, keys, 2))
    for i in range(3):
        events.where(f"event_id % 4 = {i}").coalesce(1).write.parquet(str(folder / f"{i}.parquet"))
    run()
    want = sums(M.moments(T.event_rows(events.where("event_id % 4 < 3")), keys, 2))
    assert now() == want
    shutil.copytree(f"{out}/parts", tmp_path / "parts")
    # stopped while it writes: no mark of success
    shutil.copytree(f"{out}/parts/batch=0", f"{out}/folded/upto=2")
    (tmp_path / "out/folded/upto=2/_SUCCESS").unlink()
    assert now() == want
    assert T.fold(spark, out, keys, 2) == 2 and now() == want
    assert not list((tmp_path / "out/parts").glob("batch=*")) and len(list((tmp_path / "out/folded").glob("upto=*"))) == 1
    # stopped before it removed what it had folded, or the stream wrote a batch again
    shutil.copytree(tmp_path / "parts", f"{out}/parts", dirs_exist_ok=True)
    assert now() == want
    events.where("event_id % 4 = 3").coalesce(1).write.parquet(str(folder / "3.parquet"))
    run()
    want = sums(M.moments(T.event_rows(events), keys, 2))
    assert now() == want and T.fold(spark, out, keys, 2) == 3 and now() == want and T.fold(spark, out, keys, 2) == 3 and now() == want


def test_nothing_to_fold(spark, tmp_path):
    assert T.fold(spark, str(tmp_path / "none"), ["cond"], 2) == -1
    with pytest.raises(ValueError):
        T.merged(spark, str(tmp_path / "none"), ["cond"], 2)
