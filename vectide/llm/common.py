"""Helpers shared by the corpus operators: tables, work folders, text in numpy.

Everything vectorised here works on slices of an Arrow batch, so a task holds
about a megabyte of text at a time however large its partition is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only where none is set, on a single machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(work_dir, "local", None) or tempfile.mkdtemp(prefix="spark-work-")
        work_dir.local = folder
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: lineage ends here.

    Unlike a local checkpoint the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/vectide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Remove the files of materialised tables that nothing reads any more, and have Spark's cleaner remove the shuffles of finished steps."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("vectide-"):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables and shuffles:
        context._jvm.System.gc()  # the cleaner acts on what the driver's JVM has collected


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row.

    At the end Arrow's pool gives back what is free: Spark keeps a worker for
    later stages, and its memory counts beside theirs.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        batch = batch.set_column(at, text, column.fill_null(""))
        sizes = np.diff(_offsets(batch.column(at)))
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        batch = column = None
    pa.default_memory_pool().release_unused()


def _offsets(column: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]


def utf8(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and where each row starts and ends in them."""
    offsets = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0..n-1 modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=_U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=_U)
        _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    """The inverse of an odd number modulo 2**64."""
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the row limits in them.

    Words are runs without space or the controls 9 to 13.
    """
    raw, limits = utf8(column)
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(len(limits), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[limits] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * powers(_BASE, n), out=total[1:])
    sums = (total[ends] - total[starts]) * powers(inverse(_BASE), n)[starts]
    return mix(sums ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))), np.searchsorted(starts, limits)


_STEP = [0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def shingle_hashes(column: pa.LargeStringArray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``width`` words, and the row limits in them.

    A row with fewer words gives its whole sequence as one shingle; a row
    without words gives none. Repeats within a row are kept.
    """
    words, limits = word_hashes(column)
    n_words = np.diff(limits)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    steps = [_U(_STEP[k % 5] + 2 * (k // 5)) for k in range(width)]
    rolled = np.zeros(len(words), dtype=_U)
    for k in range(width):
        if len(words) > k:
            rolled[: len(words) - k] += words[k:] * steps[k]
    first = np.repeat(limits[:-1] - out[:-1], counts) + np.arange(out[-1])
    shingles = rolled[first] if len(first) else np.zeros(0, _U)
    for row in np.flatnonzero((n_words > 0) & (n_words < width)):
        own = words[limits[row] : limits[row + 1]]
        shingles[out[row]] = (own * np.array(steps[: len(own)], dtype=_U)).sum(dtype=_U) + _U(len(own))
    return mix(shingles), out


def minhashes(shingles: np.ndarray, limits: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` minima under universal hashes ``(a * x + b) >> 32``, a row each.

    Rows without shingles hold the largest value everywhere.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 2**63, count, dtype=np.uint64)
    rows = len(limits) - 1
    out = np.full((rows, count), 2**32 - 1, dtype=np.uint32)
    start = 0
    while start < rows:  # blocks of rows whose shingles stay in cache
        stop = max(start + 1, int(np.searchsorted(limits, limits[start] + 32768, side="right")) - 1)
        x = shingles[limits[start] : limits[stop]]
        full = np.flatnonzero(np.diff(limits[start : stop + 1]) > 0)
        if len(full):
            at = (limits[start:stop] - limits[start])[full]
            y = np.empty_like(x)
            for k in range(count):
                np.multiply(x, a[k], out=y)
                y += b[k]
                out[start + full, k] = np.minimum.reduceat(y, at) >> _U(32)
        start = stop
    return out


def lists(values: np.ndarray, per_row: int, kind: pa.DataType) -> pa.ListArray:
    """A list column from a matrix with ``per_row`` columns."""
    flat = np.ascontiguousarray(values).reshape(-1)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * per_row
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
