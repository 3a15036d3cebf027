"""Sparse list columns against dense algebra, neighbours around pivots against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import embed as E
from vectide.operators import graph as G
from vectide.operators import resample as R
from vectide.operators import sparse as X
from vectide.plans.base import written

SCHEMA = "cell long, lot string, genes array<string>, counts array<int>"


def cells(spark, n=120, genes=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"g{min(int(rng.expovariate(0.15)), genes - 1)}" for _ in range(rng.randrange(30))]  # genes repeat within a cell
        rows.append((i, "ab"[i % 2], own, [rng.randrange(1, 9) for _ in own]))
    rows += [(n, "a", [], []), (n + 1, "b", None, None), (n + 2, None, ["g1", None, "g2"], [3, 4, 5])]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def dense(rows, names, form="log", pick=lambda r: True):
    out = []
    for _, lot, own, counts in rows:
        if pick(lot):
            found = [(g, c) for g, c in zip(own or [], counts or []) if g is not None]
            x, total = np.zeros(len(names)), sum(c for _, c in found) or 1
            for g, c in found:
                if g in names:
                    x[names.index(g)] += c
            out.append({"count": x, "share": x * 1e4 / total, "log": np.log1p(x * 1e4 / total)}[form])
    return np.array(out)


@pytest.mark.parametrize("form", ["count", "share", "log"])
def test_sums_by_gene(spark, monkeypatch, form):
    monkeypatch.setattr(X, "HELD", 10)  # merge and hand on all the time
    df, rows = cells(spark)
    names = sorted({g for r in rows for g in r[2] or [] if g})
    got = {(r.lot, r.gene): (r.n, r.s1, r.s2) for r in X.sum_by_gene(df, ["lot"], "genes", "counts", form=form).collect()}
    for lot in ("a", "b", None):
        x = dense(rows, names, form, lambda other, lot=lot: other == lot)
        for j, g in enumerate(names):
            if (x[:, j] > 0).any():
                assert got.pop((lot, g)) == pytest.approx(((x[:, j] > 0).sum(), x[:, j].sum(), (x[:, j] ** 2).sum()))
    assert not got


def test_sums_by_gene_of_features_only(spark):
    df, _ = cells(spark)
    features = spark.createDataFrame([("g1",), ("g3",), ("g1",), ("none",)], "gene string")
    every = X.sum_by_gene(df, [], "genes", "counts", form="log").where("gene in ('g1', 'g3')").orderBy("gene").collect()
    assert X.sum_by_gene(df, [], "genes", "counts", features, "log").orderBy("gene").collect() == every


@pytest.mark.parametrize("n,k", [(120, 5), (12, 30)])
def test_components_equal_dense_ones(spark, n, k):
    df, rows = cells(spark, n)
    names = X.names_of(df.select(F.explode("genes").alias("gene")).where("gene is not null"))
    logs = written(X.feature_logs(df, "genes", "counts", names))
    w, values, mean, spread, residual = X.components(logs, len(names), k, extra=3)
    x = dense(rows, names.to_pylist())
    want, vectors = np.linalg.eigh(np.cov(x.T))
    assert mean == pytest.approx(x.mean(axis=0)) and spread == pytest.approx(x.var(axis=0, ddof=1)) and residual < 1e-8
    k = min(k, len(names))
    assert values == pytest.approx(want[::-1][:k], abs=1e-7)
    solid = values > 1e-6
    assert np.abs((w * vectors[:, ::-1][:, :k]).sum(axis=0))[solid] == pytest.approx(np.ones(solid.sum()))
    assert np.abs(w.T @ w - np.eye(k)).max() < 1e-8 and (w.max(axis=0) >= -w.min(axis=0)).all()
    loadings, means, info = X.fit_pca(logs, names, k, extra=3)
    assert loadings.count() == len(names) * k and info.agg(F.sum("evr")).first()[0] == pytest.approx(values.sum() / spread.sum())
    assert E.project_lists(df, "cell", "genes", "counts", loadings, means).count() == len(rows)


def test_frozen_features_against_dense_fits(spark):
    df, rows = cells(spark, 300)
    a, b = df.where("lot = 'a'"), df.where("lot = 'b'")
    got = X.frozen_comparison(a, b, "genes", "counts", written, n=12, k=3).first()

    def features(pools):
        stats = X.stats_by_gene(df.where(F.col("lot").isin(pools)), "genes", "counts")
        return sorted(r.gene for r in E.select_hvg(stats, 12).collect())

    def fit(pool, names):
        x = dense(rows, names, "log", lambda lot: lot == pool)
        _, v = np.linalg.eigh(np.cov(x.T))
        return v[:, ::-1][:, :3], (x @ v[:, ::-1][:, :3]).var(axis=0).mean()

    def agree(x, names, y, others):
        every = sorted({*names, *others})
        big = [np.zeros((len(every), 3)) for _ in range(2)]
        for m, w, own in ((big[0], x, names), (big[1], y, others)):
            m[[every.index(g) for g in own]] = w
        s = np.clip(np.linalg.svd(big[0].T @ big[1], compute_uv=False), 0, 1)
        return (s**2).mean(), np.degrees(np.arccos(s)).max()

    fa, fb, both = features(["a"]), features(["b"]), features(["a", "b"])
    (wa, sa), (wb, sb), (va, ta), (vb, tb) = fit("a", fa), fit("b", fb), fit("a", both), fit("b", both)
    own, frozen = agree(wa, fa, wb, fb), agree(va, both, vb, both)
    assert got.shared == len({*fa} & {*fb})
    assert (got.own_cos2, got.own_angle, got.own_sigma2_a, got.own_sigma2_b) == pytest.approx((*own, sa, sb), abs=1e-6)
    assert (got.frozen_cos2, got.frozen_angle, got.frozen_sigma2_a, got.frozen_sigma2_b, got.gain) == pytest.approx((*frozen, ta, tb, frozen[0] - own[0]), abs=1e-6)


def test_no_cells(spark):
    df, _ = cells(spark)
    none = df.where("false")
    assert X.sum_by_gene(none, ["lot"], "genes", "counts").count() == 0
    names = X.names_of(spark.createDataFrame([("g1",), ("g2",)], "gene string"))
    w, values, *_ = X.components(X.feature_logs(none, "genes", "counts", names), 2, 2)
    assert w.shape == (2, 2) and not values.any()


def clustered(spark, seed=3):
    """Tight groups of directions, a crowd of equal ones, and a few lonely nodes."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, 6))
    u = np.vstack([c + 0.05 * rng.standard_normal((40, 6)) for c in centres] + [np.tile(centres[0], (300, 1)), rng.standard_normal((20, 6))])
    return spark.createDataFrame([(f"n{i:04d}", f"e{i % 37}", [float(v) for v in x]) for i, x in enumerate(u)], "id string, entity string, u array<double>").repartition(4)


@pytest.mark.parametrize("block", [64, 2048])
def test_neighbours_around_pivots_equal_all_pairs(spark, block):
    nodes = clustered(spark)
    search = G.PivotSearch(nodes, written, "entity", block=block)
    key = lambda df: sorted((r.src, r["rank"], r.dst, round(r.cos, 9)) for r in df.collect())
    assert key(search.knn(5)) == key(G.knn(nodes, 5, "entity", 256))
    assert search.compared_share() < 0.45
    got = sorted((r.src, r.n, round(r.best, 9)) for r in search.direction_self_join().collect())
    assert got == sorted((r.src, r.n, round(r.best, 9)) for r in G.direction_self_join(nodes, "entity", 256).collect())


def test_pivots_when_one_entity_fills_a_cell(spark):
    """A node whose cell holds none but its own entity has no bound, and looks everywhere."""
    rows = [(f"a{i}", "x", [1.0, 0.001 * i]) for i in range(30)] + [("b", "y", [-1.0, 0.1]), ("c", "z", [0.0, 1.0])]
    nodes = spark.createDataFrame(rows, "id string, entity string, u array<double>")
    key = lambda df: sorted((r.src, r["rank"], r.dst) for r in df.collect())
    assert key(G.PivotSearch(nodes, written, "entity", pivots=4).knn(3, near=1)) == key(G.knn(nodes, 3, "entity"))
    assert G.PivotSearch(nodes.where("false"), written).knn(3).count() == 0


def test_ranks_within_datasets(spark):
    rng = random.Random(6)
    rows = [("abc"[min(2, int(rng.expovariate(1)))], float(rng.choice([rng.random(), 0.5, 0.25]))) for _ in range(500)]
    df = spark.createDataFrame(rows, "dataset string, v double")
    got = sorted(map(tuple, R.ranked_within(df, "dataset", "v", "r", 16).collect()))
    want = []
    for d, v in rows:
        own = [x for e, x in rows if e == d]
        want.append((d, v, sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2))
    assert got == sorted(want)
