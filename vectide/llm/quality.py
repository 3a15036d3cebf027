"""A quality classifier: random Fourier features, ridge, isotonic calibration.

Document statistics (make-up of signs, words, lines and repeats) are taken in
one scan and kept as a thin table. Random Fourier features of them approximate
a Gaussian kernel; every partition sums its share of the normal equations, and
the ridge solution gives raw scores. Raw scores of a fifth of the labelled rows,
which the ridge has not seen, are binned, and an isotonic fit over the bins
turns them into probabilities. Equal documents are on the same side of that cut;
if the fifth is small or of one kind, all rows calibrate.

At most about ``fit_rows`` labelled rows are used, chosen by a hash of doc_id.
Null and empty texts have all-zero statistics and are scored like any other.
Without labels of both kinds every score is the share of label 1, or 0.5.
Rows with a null label are left out; of repeated labels the largest counts. Very long
texts are read whole. Only doc_id and text are read of the documents, so that other
columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import lists, materialise, shingle_hashes, slices, utf8, word_hashes

# the classes of bytes that are counted
_CLASS = np.full(256, 8, dtype=np.int32)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in " \t"]] = 3
_CLASS[[ord(c) for c in "\r\n"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[ord("!")] = 6
_CLASS[128:] = 7
CLASSES = 9
NAMES = [f"share_{k}" for k in range(CLASSES)] + ["log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "same_as_last", "distinct_shingles", "line_words", "distinct_lines", "solid_words"]
FEATURES = 256
BINS = 512
#: Rows that a calibration apart needs.
CALIBRATE = 100


def statistics(texts: pa.LargeStringArray) -> np.ndarray:
    """A row of document statistics for each text."""
    raw, limits = utf8(texts)
    rows = len(limits) - 1
    n = np.diff(limits)
    out = np.zeros((rows, len(NAMES)))
    if not len(raw):
        return out
    kinds = _CLASS[raw]
    owner = np.repeat(np.arange(rows, dtype=np.int32), n)
    out[:, :CLASSES] = np.bincount(owner * CLASSES + kinds, minlength=rows * CLASSES).reshape(rows, CLASSES) / np.maximum(n, 1)[:, None]
    words, word_limits = word_hashes(texts)
    shingles, shingle_limits = shingle_hashes(texts)
    solid = (kinds <= 1) | (kinds == 7)
    lines = np.flatnonzero(raw == 10)
    for i in range(rows):
        own = words[word_limits[i] : word_limits[i + 1]]
        if not len(own):
            out[i, CLASSES] = np.log1p(n[i])
            continue
        _, counts = np.unique(own, return_counts=True)
        rolled = shingles[shingle_limits[i] : shingle_limits[i + 1]]
        ends = lines[np.searchsorted(lines, limits[i]) : np.searchsorted(lines, limits[i + 1])]
        lengths = np.diff(np.concatenate([[limits[i]], ends, [limits[i + 1]]]))
        mine = solid[limits[i] : limits[i + 1]]
        out[i, CLASSES:] = [
            np.log1p(n[i]),
            np.log1p(len(own)),
            n[i] / len(own),
            len(counts) / len(own),
            counts.max() / len(own),
            (own[1:] == own[:-1]).mean() if len(own) > 1 else 0,
            len(np.unique(rolled)) / len(rolled),
            np.log1p(len(own) / len(lengths)),
            len(np.unique(lengths)) / len(lengths),
            np.count_nonzero(mine[1:] != mine[:-1]) / (2 * len(own)),
        ]
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):  # several numbers are held for each byte
        x = statistics(part.column("text")).astype(np.float32)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(x, len(NAMES), pa.float32())], names=["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the statistics of each document in the order of NAMES."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_statistics, "doc_id long, x array<float>")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), len(NAMES))


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant."""
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    out = np.cos(z @ model["w"] + model["b"]) * np.sqrt(2 / FEATURES)
    return np.hstack([out, np.ones((len(x), 1))])


def _sums(frames: Iterator[pd.DataFrame], model: dict) -> Iterator[pd.DataFrame]:
    d = FEATURES + 1
    gram, target, rows = np.zeros((d, d)), np.zeros(d), 0
    for f in frames:
        z, y = fourier(_matrix(f.x), model), f.y.to_numpy(dtype=float)
        gram += z.T @ z
        target += z.T @ y
        rows += len(f)
    yield pd.DataFrame({"i": np.arange(d), "g": list(gram), "t": target, "rows": rows})


def _add(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": f.i[:1], "g": [np.sum(f.g.tolist(), axis=0)], "t": [f.t.sum()], "rows": [f["rows"].sum()]})


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values to y at rising x, by pooling neighbours."""
    pools: list[list[float]] = []
    for value, weight in zip(y, w):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def raw_scores(x: np.ndarray, model: dict) -> np.ndarray:
    return fourier(x, model) @ model["beta"]


def fit(labelled: DataFrame, ridge: float = 1e-3, width: float = 1.0, seed: int = 11) -> dict:
    """The model of rows ``(x, y)`` with y 0 or 1."""
    spark = labelled.sparkSession
    train = materialise(labelled.select("x", F.col("y").cast("double").alias("y")).repartition(8))
    cells = [F.col("x")[k].cast("double") for k in range(len(NAMES))]
    first = train.agg(F.count("*").alias("n"), F.avg("y").alias("share"), *[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    if not first.n or first.share in (0.0, 1.0):
        return {"constant": 0.5 if not first.n else float(first.share)}
    mean, scale = (np.array(first[2 + k * len(NAMES) : 2 + (k + 1) * len(NAMES)], dtype=float) for k in (0, 1))
    rng = np.random.default_rng(seed)
    model = {
        "mean": mean,
        "scale": np.where(scale > 1e-6, scale, 1.0),
        "w": rng.normal(size=(len(NAMES), FEATURES)) / (width * np.sqrt(len(NAMES))),
        "b": rng.uniform(0, 2 * np.pi, FEATURES),
    }
    apart = F.pmod(F.xxhash64("x"), F.lit(5)) == 0
    held = train.where(apart).agg(F.count("*").alias("n"), F.avg("y").alias("share")).first()
    split = held.n >= CALIBRATE and 0 < held.share < 1
    rows = first.n - (held.n if split else 0)
    learned, judged = (train.where(~apart), train.where(apart)) if split else (train, train)
    parts = learned.select("x", "y").mapInPandas(partial(_sums, model=model), "i int, g array<double>, t double, rows long")
    sums = parts.groupBy("i").applyInPandas(_add, "i int, g array<double>, t double, rows long").toPandas().sort_values("i")
    gram, target = np.array(sums.g.tolist()), sums.t.to_numpy()
    penalty = np.eye(len(gram)) * ridge * rows / 10
    penalty[-1, -1] = 1e-9
    model["beta"] = np.linalg.solve(gram + penalty, target)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = raw_scores(_matrix(f.x), model)
            yield pd.DataFrame({"bin": np.clip(np.floor((s + 0.5) / 2 * BINS), 0, BINS - 1).astype("int32"), "s": s, "y": f.y})

    bins = judged.mapInPandas(scored, "bin int, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("s")
    model["at"], model["p"] = bins.s.to_numpy(), isotonic(bins.s.to_numpy(), bins.y.to_numpy(), bins.n.to_numpy())
    return model


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return np.clip(np.interp(raw_scores(x, model), model["at"], model["p"]), 0, 1)


def score(stats: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score, predicted)`` of a table of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = probability(_matrix(f.x), shared.value)
            yield pd.DataFrame({"doc_id": f.doc_id, "score": p, "predicted": (p >= 0.5).astype("int32")})

    return stats.mapInPandas(scored, "doc_id long, score double, predicted int")


def accepted(text: Column, model: dict) -> Column:
    """Whether a text scores 0.5 or more: statistics and score in one pass, row by row, whatever stands beside it."""

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        parts = [probability(statistics(part.column("text")).astype(np.float32).astype(np.float64), model) >= 0.5 for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=bool))

    return judge(text.cast("string"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learn(stats: DataFrame, labels: DataFrame, fit_rows: int = 100_000) -> dict:
    """The model of the labelled documents that are not held out; ``stats`` has doc_id and x."""
    return fit(stats.join(training_labels(labels, fit_rows), "doc_id").select("x", "y"))


def training_labels(labels: DataFrame, fit_rows: int = 100_000) -> DataFrame:
    """``(doc_id, y)`` of at most about ``fit_rows`` labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y")).where(~held_out())
    rows = known.count()
    if rows > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / rows))
    return known


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = 100_000) -> DataFrame:
    """Learn from the labelled documents that are not held out; score all documents."""
    stats = materialise(document_statistics(docs))
    model = learn(stats, labels, fit_rows)
    return score(stats, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
