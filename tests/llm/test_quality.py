import zlib

import numpy as np
import pyarrow as pa
from vectide.llm.quality import NAMES, classify, isotonic, statistics


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if got[d].held_out]
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.97
    assert np.mean([got[d].predicted for d in held if truth[d]]) > 0.98


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) AS quality")
    a, b = ({r.doc_id: r.score for r in classify(docs, x).collect()} for x in (labels, flipped))
    assert max(abs(a[d] - b[d]) for d in a) < 1e-9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 50_000, 5), (4, "a", 5)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    one_kind = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {r.score for r in classify(docs, one_kind).collect()} == {1.0}
    assert classify(docs.limit(0), none).count() == 0
    both = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (2, 0), (6, 0)], "doc_id long, quality int")
    assert classify(docs, both).count() == 4


def test_isotonic_fit():
    y = np.array([0, 1, 0.5, 0.5, 2, 1.0])
    assert np.allclose(isotonic(np.arange(6), y, np.ones(6)), [0, 2 / 3, 2 / 3, 2 / 3, 1.5, 1.5])
    assert statistics(pa.array(["", "a b"], pa.large_string())).shape == (2, len(NAMES))


def test_the_ridge_solves_its_normal_equations(spark, sf):
    from pyspark.sql import functions as F
    from vectide.llm.quality import BINS, document_statistics, fit, fourier, probability

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    rows = document_statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").select("x", "y")
    model = fit(rows)
    every = rows.withColumn("apart", F.pmod(F.xxhash64("x"), F.lit(5)) == 0).toPandas()
    x, y, apart = np.array(every.x.tolist(), dtype=float), every.y.to_numpy(dtype=float), every.apart.to_numpy()
    assert np.allclose(model["mean"], x.mean(axis=0), atol=1e-5)
    split = apart.sum() >= 100 and 0 < y[apart].mean() < 1
    own = ~apart if split else np.ones(len(y), dtype=bool)
    z = fourier(x[own], model)
    penalty = np.eye(z.shape[1]) * 1e-3 * own.sum() / 10
    penalty[-1, -1] = 1e-9
    assert np.allclose(model["beta"], np.linalg.solve(z.T @ z + penalty, z.T @ y[own]), atol=1e-6)
    # features of the kernel: products approach exp(-|a - b|^2 / 2w^2)
    a = np.clip((x[:60] - model["mean"]) / model["scale"], -6, 6)
    far = ((a[:, None] - a[None]) ** 2).sum(axis=2)
    got = fourier(x[:60], model)[:, :-1]
    assert np.abs(got @ got.T - np.exp(-far / (2 * len(NAMES)))).mean() < 0.08
    p = probability(x, model)
    assert (np.diff(p[np.argsort(fourier(x, model) @ model["beta"], kind="stable")]) >= -1e-12).all() and BINS > len(model["at"])


def test_repeated_and_clashing_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    twice = docs.unionByName(docs).withColumnsRenamed({"lang": "x", "source": "y"})
    got = {}
    for r in classify(twice, labels).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert all(len(s) == 2 and s[0] == s[1] for s in got.values()) and len(got) == docs.count()
