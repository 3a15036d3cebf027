"""Downsample and measure: does the direction of fewer rows turn as predicted?

Every row has a number from its md5. A draw turns these numbers into keys by a
linear map modulo a prime, whose two factors come from the depth, the replicate
and the seed, and takes the rows with the least keys: so a draw depends on
nothing else, neither on partitions nor on the engine, and draws are
independent of each other.

A group's rows are packed by chunks of bounded size, once for all its draws. Of
a group of several chunks the last key drawn is found first, from counts and
the few keys that are too close to it to tell without the other chunks; then
only sums leave a task.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from vectide.functions import vec
from vectide.functions.quota import THETA, evidence, perp_trace
from vectide.functions.vec import INF


def depth_grid(n: Column, high: Column, points: int, low: float = 20.0, truncate: bool = False) -> Column:
    """Distinct depths below n on a geometric grid from ``low`` to ``high``."""
    ratio = F.log(high.cast("double") / low) / (points - 1)
    step = lambda i: F.exp(F.log(F.lit(low)) + ratio * i)
    whole = (lambda x: F.floor(x + 1e-9)) if truncate else (lambda x: F.bround(x, 0))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: whole(step(i)).cast("long"))
    return F.array_sort(F.array_distinct(F.filter(grid, lambda d: d < n)))


def half_grid(n: str, points: int) -> Column:
    return depth_grid(F.col(n), F.greatest(F.floor(F.col(n) / 2), F.lit(40)), points)


#: Keys are numbers below this prime.
PRIME = 2**31 - 1
#: Rows of a group that are drawn from together, about, and numbers in their vectors at most.
CHUNK, ENTRIES = 100_000, 1 << 23
#: Keys that are held at once, and of each replicate.
HELD, WIDTH = 1 << 18, 1 << 13
#: Rows of a chunk whose names leave it.
NAMED = 1 << 13
#: Share of a group's rows from which on a product sums a draw faster than its list of rows.
DENSE = 0.02
#: Where a number's upper half lies.
UPPER = int(sys.byteorder == "little")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % PRIME


@lru_cache(maxsize=1 << 10)
def _factors(n: int, reps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two factors of each replicate's keys at a depth, for keys scaled to all 64 bits.

    A key k is scaled to ``(k + 1/2) * 2**64 / PRIME - 2**63``, give or take an eighth of
    the step: multiplying by a rounded ``a * 2**64 / PRIME`` wraps around just
    where the key does, so no remainder has to be taken.
    """
    of = lambda rep, which: int(hashlib.md5(f"{n}|{rep}|{seed}|{which}".encode()).hexdigest()[:8], 16) % PRIME
    scaled = lambda k, more: ((((k << 65) // PRIME + 1) >> 1) + more) % (1 << 64)
    more = {"a": 0, "b": (1 << 32) + (1 << 63)}
    return tuple(np.array([scaled(of(r, which), more[which]) for r in range(reps)], dtype=np.uint64).view(np.int64)[:, None] for which in "ab")


def _top(key: int) -> int:
    """The upper half of the bits of the greatest scaled key of ``key``; that of ``key + 1`` is always above."""
    return max(((2 * key + 1 << 63) // PRIME + (1 << 30) + 1 >> 32) - (1 << 31), -(1 << 31) - 1)


def _key_of(half: np.ndarray) -> np.ndarray:
    """Keys from the upper half of their scaled numbers' bits."""
    twice = (half.astype(np.int64) + (1 << 31)) * 2 + 1
    return (twice.astype(np.uint64) * np.uint64(PRIME) >> np.uint64(33)).astype(np.int64)


def _near(n: int, size: int) -> tuple[int, int]:
    """First and last key of those around the n-th of ``size``, seven standard deviations on either side."""
    margin = 7 * (n * max(0.0, 1 - n / size)) ** 0.5 + 32
    return min(PRIME - 1, max(0, math.ceil(PRIME * (n - margin) / size))), min(PRIME - 1, math.floor(PRIME * (n + margin) / size))


def _scaled_keys(h: np.ndarray, n: int, reps: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First replicate, first row and scaled keys of each block of a depth."""
    a, b = _factors(n, reps, seed)
    width = max(1, min(len(h), WIDTH))
    step = max(1, HELD // width)
    space = np.empty(step * width, dtype=np.int64)  # one for all: new pages would cost as much as the product
    for first in range(0, reps, step):
        for start in range(0, len(h), width):
            part, factor = h[start : start + width], a[first : first + step]
            key = space[: len(factor) * len(part)].reshape(len(factor), len(part))
            np.multiply(part, factor, out=key)
            key += b[first : first + step]
            yield first, start, key


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask holds, by rows, as places in its entries."""
    flat = mask.reshape(-1)
    if flat.size % 8 or np.count_nonzero(flat) > flat.size // 256:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.int64) != 0)  # most words of eight are empty
    return (words[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[words]]


class _Sums:
    """Of each draw the number of its rows and their sum."""

    fields = "number long, s array<double>"

    def __init__(self, more: pa.Scalar, rows: int, reps: int, state: bytes | None = None):
        values = np.frombuffer(more.as_buffer(), dtype=np.float64).reshape(rows, -1)
        self.values = np.concatenate([values, np.ones((rows, 1))], axis=1)  # the last entry counts
        self.sums = np.zeros((reps, self.values.shape[1])) if state is None else np.frombuffer(state, dtype=np.float64).reshape(reps, -1).copy()

    def mask(self, first: int, start: int, mask: np.ndarray) -> None:
        self.sums[first : first + len(mask)] += mask.astype(np.float64) @ self.values[start : start + mask.shape[1]]

    def rows(self, rep: np.ndarray, at: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(rep, prepend=-1))
        if len(edges):
            self.sums[rep[edges]] += np.add.reduceat(self.values[at], edges, axis=0)

    def state(self) -> bytes:
        return self.sums.tobytes()

    def number(self) -> np.ndarray:
        return self.sums[:, -1].astype(np.int64)

    def result(self) -> dict:
        rep, d = np.flatnonzero(self.sums[:, -1]), self.values.shape[1] - 1
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rep) + 1, dtype=np.int32) * d), pa.array(self.sums[rep, :-1].reshape(-1)))
        return {"rep": pa.array(rep.astype(np.int32)), "number": pa.array(self.sums[rep, -1].astype(np.int64)), "s": vectors}


class _Extents:
    """Of each draw the number of its rows, the first and the last name."""

    fields = "rows long, low string, high string"

    def __init__(self, more: pa.Scalar, rows: int, reps: int, state: bytes | None = None):
        self.names = more.values
        self.ends = np.array([[0], [rows], [-1]]).repeat(reps, axis=1) if state is None else np.frombuffer(state, dtype=np.int64).reshape(3, reps).copy()

    def mask(self, first: int, start: int, mask: np.ndarray) -> None:
        here = np.array([np.count_nonzero(m) for m in mask])
        kept = np.flatnonzero(here)
        self._add(kept + first, here[kept], start + mask.argmax(axis=1)[kept], start + mask.shape[1] - 1 - mask[:, ::-1].argmax(axis=1)[kept])

    def rows(self, rep: np.ndarray, at: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(rep, prepend=-1))
        if len(edges):
            self._add(rep[edges], np.diff(edges, append=len(rep)), np.minimum.reduceat(at, edges), np.maximum.reduceat(at, edges))

    def _add(self, rep: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.ends[0, rep] += number
        self.ends[1, rep] = np.minimum(self.ends[1, rep], low)
        self.ends[2, rep] = np.maximum(self.ends[2, rep], high)

    def state(self) -> bytes:
        return self.ends.tobytes()

    def number(self) -> np.ndarray:
        return self.ends[0].copy()

    def result(self) -> dict:
        rep = np.flatnonzero(self.ends[0])
        number, low, high = self.ends[:, rep]
        return {"rep": pa.array(rep.astype(np.int32)), "rows": pa.array(number), "low": self.names.take(pa.array(low)), "high": self.names.take(pa.array(high))}


class _Names(_Extents):
    """The names of each draw's rows."""

    fields = "names array<string>"

    def __init__(self, more: pa.Scalar, rows: int, reps: int, state: bytes | None = None):
        self.names, self.parts, self.reps = more.values, [], reps
        if state:
            self.parts.append(np.frombuffer(state, dtype=np.int64).reshape(2, -1))

    def mask(self, first: int, start: int, mask: np.ndarray) -> None:
        rep, at = np.nonzero(mask)
        self.rows(rep + first, at + start)

    def rows(self, rep: np.ndarray, at: np.ndarray) -> None:
        self.parts.append(np.stack([rep, at]))

    def all(self) -> np.ndarray:
        return np.concatenate([np.empty((2, 0), dtype=np.int64), *self.parts], axis=1)

    def state(self) -> bytes:
        return self.all().tobytes()

    def number(self) -> np.ndarray:
        return np.bincount(self.all()[0], minlength=self.reps)

    def result(self) -> dict:
        rep, at = self.all()
        at, many = at[np.argsort(rep, kind="stable")], np.bincount(rep, minlength=self.reps)
        kept = np.flatnonzero(many)
        limits = np.concatenate([[0], np.cumsum(many[kept])]).astype(np.int32)
        return {"rep": pa.array(kept.astype(np.int32)), "names": pa.ListArray.from_arrays(pa.array(limits), self.names.take(pa.array(at)))}


Open = tuple[np.ndarray, np.ndarray, np.ndarray]


def _draw(h: np.ndarray, n: int, size: int, low: int, high: int, reps: int, seed: int, to: _Sums | _Extents) -> Open:
    """Pass on the rows of keys below ``low``; number, keys and places of each replicate's rows from there to ``high``."""
    dense, halves, places, blocks = n > DENSE * size, [], [], []
    # half of the bits tell keys apart, and cost less to compare
    from_, upto, all_ = np.int32(_top(low - 1) + 1), np.int32(_top(high)), np.int64((_top(high) << 32) + (1 << 32) - 1)
    for first, start, key in _scaled_keys(h, n, reps, seed):
        if dense:
            half = key.view(np.int32)[:, UPPER::2].copy()
            below = half < from_
            to.mask(first, start, below)
            at = _places(below ^ (half <= upto))
            halves.append(half.reshape(-1)[at])
        else:
            at = _places(key <= all_)
            halves.append(key.reshape(-1)[at] >> 32)
        places.append(at)
        blocks.append((first, start, key.shape[1], len(at)))
    first, start, width, many = np.array(blocks).T
    rep, at = np.divmod(np.concatenate(places), width.repeat(many))
    rep, at, number = rep + first.repeat(many), at + start.repeat(many), _key_of(np.concatenate(halves))
    order = np.argsort(rep.astype(np.int32), kind="stable")
    rep, at, number = rep[order], at[order], number[order]
    if not dense:
        sure = number < low
        to.rows(rep[sure], at[sure])
        rep, at, number = rep[~sure], at[~sure], number[~sure]
    return np.bincount(rep, minlength=reps), number.astype(np.uint32), at.astype(np.uint32)


def _pick(need: np.ndarray, parts: list[Open]) -> list[np.ndarray]:
    """Which of the open rows of each chunk are drawn, when each replicate needs so many more.

    Equal keys are equal numbers, which lie in one chunk by name.
    """
    many = np.stack([p[0] for p in parts])
    rep = np.concatenate([np.arange(len(need)).repeat(m) for m in many])
    order = np.argsort((rep << 32) + np.concatenate([p[1] for p in parts]), kind="stable")
    before = np.concatenate([[0], np.cumsum(many.sum(axis=0))])[:-1]
    pick = np.zeros(len(rep), dtype=bool)
    pick[order] = np.arange(len(rep)) - before[rep[order]] < need[rep[order]]
    return np.split(pick, np.cumsum(many.sum(axis=1))[:-1])


def _missed(need: np.ndarray, many: np.ndarray, high: int) -> bool:
    """Whether some n-th key is not between the bounds (names that repeat)."""
    return bool((need < 0).any() or (high < PRIME - 1 and (need > many).any()))


def _draw_whole(h: np.ndarray, n: int, size: int, reps: int, seed: int, new: Callable[[], _Sums | _Extents]) -> _Sums | _Extents:
    """The draws of a group that is here as a whole."""
    to, bounds = new(), _near(n, size)
    found = _draw(h, n, size, *bounds, reps, seed, to)
    if _missed(n - to.number(), found[0], bounds[1]):
        to = new()
        found = _draw(h, n, size, 0, min(PRIME - 1, math.floor(PRIME * (n + 8 * n**0.5 + 32) / size)), reps, seed, to)
    pick = _pick(n - to.number(), [found])[0]
    to.rows(np.arange(reps).repeat(found[0])[pick], found[2][pick].astype(np.int64))
    return to


def _plan(depths: DataFrame, keys: list[str], d: int) -> DataFrame:
    """A row for each group: its size, depths, and the number of its chunks."""
    plan = depths.groupBy(*keys).agg(F.first("size").cast("long").alias("size"), F.sort_array(F.collect_set(F.col("n").cast("long"))).alias("depths"))
    return plan.withColumn("chunks", F.ceil(F.col("size") / _chunk_rows(d)).cast("int"))


def _chunk_rows(d: int) -> int:
    return max(1, min(CHUNK, ENTRIES // max(d, 1)))


def _packed(rows: DataFrame, plan: DataFrame, keys: list[str], row: str, x: str | None) -> DataFrame:
    """A row for each chunk: its rows' numbers ``h`` as bytes, beside their vectors as bytes or, without x, their names.

    Rows of equal numbers lie in one chunk and in the order of their names.
    """

    def pack(table: pa.Table) -> pa.Table:
        by = ["__h", "__row"] if x else ["__row"]
        order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by])
        h = table["__h"].to_numpy()[order.to_numpy()].astype(np.int32).tobytes()
        if x:
            all_ = table[x].combine_chunks()
            values = np.asarray(all_.flatten(), dtype=np.float64).reshape(len(table), -1)[order.to_numpy()]
            more = pa.array([values.tobytes()], pa.binary())
        else:
            names = table["__row"].combine_chunks().take(order)
            more = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        return _with_keys(table, [*keys, "__chunk"], 1, {"h": pa.array([h], pa.binary()), "more": more})

    met = rows.select(*keys, F.col(row).cast("string").alias("__row"), *([x] if x else [])).join(plan.select(*keys, "chunks"), keys)
    met = met.withColumn("__h", _number(F.col("__row"))).withColumn("__chunk", F.pmod("__h", F.col("chunks")).cast("int")).drop("chunks")
    return met.groupBy(*keys, "__chunk").applyInArrow(pack, _schema(met, [*keys, "__chunk"], "h binary, more " + ("binary" if x else "array<string>")))


def _with_keys(table: pa.Table, keys: list[str], rows: int, more: dict) -> pa.Table:
    """A group's keys beside other columns of ``rows`` rows."""
    own = {k: pa.repeat(table[k][0], rows) for k in keys}
    return pa.table({**own, **more})


def _schema(rows: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + more


def _beside(packs: DataFrame, others: DataFrame, keys: list[str], of: Callable[[pa.Table, pa.Table, np.ndarray], Iterator[dict]], more: str) -> DataFrame:
    """What ``of`` makes of each chunk, the other table's rows for it, and its rows' numbers."""
    by, schema = [*keys, "__chunk"], _schema(packs, keys, more)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def meet(chunk: pa.Table, own: pa.Table) -> pa.Table:
        if not len(chunk) or not len(own):
            return arrow.empty_table()
        h = np.frombuffer(chunk["h"][0].as_buffer(), dtype=np.int32).astype(np.int64)
        parts = [_with_keys(chunk, keys, len(next(iter(p.values()))), p) for p in of(chunk, own, h)]
        return pa.concat_tables(parts).select(arrow.names).cast(arrow) if parts else arrow.empty_table()

    return packs.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(meet, schema)


def _has_large(plan: DataFrame) -> bool:
    most = plan.agg(F.max("chunks")).first()[0]
    return most is not None and most > 1


def _binary(**arrays: np.ndarray) -> dict:
    return {name: pa.array([a.tobytes()], pa.binary()) for name, a in arrays.items()}


def _of_draws(rows: DataFrame, depths: DataFrame, keys: list[str], row: str, x: str | None, d: int, reps: int, seed: int, kind: type) -> tuple[DataFrame, bool]:
    """What ``kind`` keeps of each draw, and whether groups of several chunks have it in parts.

    A group of one chunk is drawn from at once. Of several, a chunk passes on what its sure
    rows come to, and the keys and places of rows too close to the n-th key to tell without
    the other chunks: some ten square roots of n for each draw, eight bytes each. They
    meet by depth, and the places of those drawn go back to their chunk.
    """
    plan = _plan(depths, keys, d)
    packs, large, by = _packed(rows, plan, keys, row, x), _has_large(plan), [*keys, "__chunk"]
    of = f"n long, rep int, {kind.fields}"

    def whole(chunk: pa.Table, own: pa.Table, h: np.ndarray) -> Iterator[dict]:
        size = own["size"][0].as_py()
        for n in own["depths"][0].as_py() if own["chunks"][0].as_py() == 1 else []:
            out = _draw_whole(h, n, size, reps, seed, lambda: kind(chunk["more"][0], len(h), reps)).result()
            yield {"n": pa.array(np.full(len(out["rep"]), n)), **out}

    each = plan.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    if not large:
        return _beside(packs, each, keys, whole, of), False

    def open_(chunk: pa.Table, own: pa.Table, h: np.ndarray) -> Iterator[dict]:
        size, chunks = own["size"][0].as_py(), own["chunks"][0].as_py()
        for n in own["depths"][0].as_py():
            to, bounds = kind(chunk["more"][0], len(h), reps), _near(n, size)
            if chunks == 1:
                to, bounds, found = _draw_whole(h, n, size, reps, seed, lambda: kind(chunk["more"][0], len(h), reps)), (0, PRIME - 1), [np.zeros(reps, dtype=np.int64), *[np.empty(0, dtype=np.uint32)] * 2]
            else:
                found = _draw(h, n, size, *bounds, reps, seed, to)
            yield {"__chunk": chunk["__chunk"].combine_chunks(), "n": pa.array([n]), "high": pa.array([bounds[1]]), "state": pa.array([to.state()], pa.binary()), **_binary(sure=to.number(), many=found[0], open=found[1], at=found[2])}

    def pick(table: pa.Table) -> pa.Table:
        n, high = table["n"][0].as_py(), table["high"][0].as_py()
        of = lambda c, kind: [np.frombuffer(v.as_buffer(), dtype=kind) for v in table[c]]
        many, places = of("many", np.int64), of("at", np.uint32)
        need = n - sum(of("sure", np.int64))
        if _missed(need, sum(many), high):
            raise ValueError("names repeat so often that draws of a large group have no bounds: give every row a name of its own")
        picks = _pick(need, list(zip(many, of("open", np.uint32), places)))
        reps_ = [np.bincount(np.arange(reps).repeat(m)[p], minlength=reps).tobytes() for m, p in zip(many, picks)]
        return table.select([*by, "n", "state"]).append_column("many", pa.array(reps_, pa.binary())).append_column("at", pa.array([a[p].tobytes() for a, p in zip(places, picks)], pa.binary()))

    def close(chunk: pa.Table, own: pa.Table, h: np.ndarray) -> Iterator[dict]:
        for n, state, many, at in zip(own["n"].to_pylist(), own["state"], own["many"], own["at"]):
            to = kind(chunk["more"][0], len(h), reps, state.as_buffer())
            to.rows(np.arange(reps).repeat(np.frombuffer(many.as_buffer(), dtype=np.int64)), np.frombuffer(at.as_buffer(), dtype=np.uint32).astype(np.int64))
            out = to.result()
            yield {"n": pa.array(np.full(len(out["rep"]), n)), **out}

    found = _beside(packs, each, keys, open_, "__chunk int, n long, high long, state binary, sure binary, many binary, open binary, at binary")
    picked = found.groupBy(*keys, "n").applyInArrow(pick, _schema(packs, by, "n long, state binary, many binary, at binary"))
    # chunks are dealt out alike both times, so Spark makes them once
    return _beside(packs, picked, keys, close, of), True


def subsample(rows: DataFrame, depths: DataFrame, keys: list[str], row: str, reps: int, seed: int = 0) -> DataFrame:
    """Draws without replacement: the keys, ``n``, ``rep`` and the row's name (as text) of every row drawn.

    depths holds the keys, ``n`` and the group's size ``size``; row names a
    column that tells the rows of a group apart.
    """
    # names leave a task for every draw, so its chunks are small
    drawn = _of_draws(rows, depths, keys, row, None, ENTRIES // NAMED, reps, seed, _Names)[0]
    return drawn.select(*keys, "n", "rep", F.explode("names").alias(row))


def draw_extents(rows: DataFrame, depths: DataFrame, keys: list[str], row: str, reps: int, seed: int = 0) -> DataFrame:
    """Of each draw (see ``subsample``) the number of its rows, the first and the last name: ``rows``, ``low``, ``high``."""
    drawn, large = _of_draws(rows, depths, keys, row, None, 1, reps, seed, _Extents)
    return drawn.groupBy(*keys, "n", "rep").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")) if large else drawn


def drawn_means(rows: DataFrame, depths: DataFrame, keys: list[str], row: str, d: int, reps: int, seed: int = 0, x: str = "x") -> DataFrame:
    """``mu_n``, the mean of the rows of each draw (see ``subsample``): keys, ``n``, ``rep``, ``mu_n``."""
    drawn, large = _of_draws(rows, depths, keys, row, x, d, reps, seed, _Sums)
    group = [*keys, "n", "rep"]
    if large:
        drawn = drawn.groupBy(*group).agg(vec.sums("s", d).alias("s"), F.sum("number").alias("number"))
    return drawn.select(*group, vec.over("s", F.col("number")).alias("mu_n"))


def realized_angles(means: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Append ``angle`` between the drawn direction and the group's own; groups hold mu_c and v."""
    return means.join(groups.select(*keys, "mu_c", "v"), keys).select(*keys, "n", "rep", vec.angle(vec.minus("mu_n", "mu_c"), F.col("v")).alias("angle"))


def predicted_sq(trace: Column, m: Column, n: Column, size: Column) -> Column:
    """The squared angle that a draw of n of ``size`` rows leaves, at least 0."""
    return F.greatest(trace / (m * m) * (F.lit(1.0) / n - F.lit(1.0) / size), F.lit(0.0))


def predicted_points(depths: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``predicted`` and ``xn`` at each depth, which no draw changes; depths holds the keys and ``n``."""
    met = depths.select(*keys, "n").join(groups.select(*keys, "size", "m", "tr_perp"), keys)
    return met.select(*keys, "n", "size", predicted_sq(F.col("tr_perp"), F.col("m"), F.col("n"), F.col("size")).alias("predicted"), (F.lit(1.0) / F.col("n") - F.lit(1.0) / F.col("size")).alias("xn"))


def curve_points(angles: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``realized`` and ``predicted`` squared angles for each depth, with ``xn = 1/n - 1/N``."""
    mean = angles.groupBy(*keys, "n").agg(F.avg(F.col("angle") * F.col("angle")).alias("realized"))
    met = mean.join(groups.select(*keys, "size", "m", "tr_perp"), keys)
    return met.select(*keys, "n", "size", "realized", predicted_sq(F.col("tr_perp"), F.col("m"), F.col("n"), F.col("size")).alias("predicted"), (F.lit(1.0) / F.col("n") - F.lit(1.0) / F.col("size")).alias("xn"))


def origin_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """The slope through the origin and its R squared (1 if the values do not vary)."""
    s = points.groupBy(*keys).agg(
        F.sum(F.col("xn") * F.col("realized")).alias("xy"),
        F.sum(F.col("xn") * F.col("xn")).alias("xx"),
        F.sum(F.col("realized") * F.col("realized")).alias("yy"),
        (F.var_pop("realized") * F.count("*")).alias("tot"),
        F.count("*").alias("points"),
    )
    slope = F.when(F.col("xx") > 0, F.col("xy") / F.col("xx"))
    res = F.col("yy") - slope * F.col("xy")
    return s.select(*keys, "points", slope.alias("fit_slope"), F.when(F.col("tot") > 1e-30, F.lit(1.0) - res / F.col("tot")).otherwise(F.lit(1.0)).alias("r2"))


def rho2(u: Column | str, ell: Column | str, m2: Column, n: Column | None = None) -> Column:
    """Squared length over noise along the signal; with n, over that noise of a mean."""
    along = vec.total(F.zip_with(vec.col(u), vec.col(ell), lambda a, e: a * a * e))
    along = along if n is None else along / n
    return F.when(along > 0, m2 / along).otherwise(F.lit(INF))


def describe_groups(m: DataFrame, control: DataFrame, line: str) -> DataFrame:
    """What curves need of each group: size, mu_c, v, m, u, its own noise, tr_perp and rho2."""
    n = F.col("n").cast("double")
    g = m.join(control, line).withColumn("mu", F.transform("s1", lambda s: s / n))
    g = g.withColumn("ell", F.zip_with("s2", "mu", lambda s, mu: F.greatest((s / n - mu * mu) * n / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))))
    g = g.withColumns({"size": F.col("n"), "v": vec.minus("mu", "mu_c")}).withColumn("m", vec.norm("v")).withColumn("u", vec.unit("v"))
    return g.withColumns({"tr_perp": perp_trace("u", "ell"), "rho2": rho2("u", "ell", F.col("m") * F.col("m"))}).drop("n")


def heldout_curves(rows: DataFrame, groups: DataFrame, keys: list[str], row: str, d: int, points: int = 12, reps: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The curve of every group: its points, and a record with predicted and fitted slope."""
    depths = groups.select(*keys, "size", F.explode(half_grid("size", points)).alias("n"))
    means = drawn_means(rows, depths, keys, row, d, reps, seed)
    curve = curve_points(realized_angles(means, groups, keys), groups, keys)
    slope = F.when(F.col("m") > 0, F.col("tr_perp") / (F.col("m") * F.col("m")))
    record = groups.select(*keys, "size", "m", "rho2", slope.alias("pred_slope")).join(origin_fit(curve, keys), keys)
    return curve, record.withColumn("ratio", F.when(F.col("pred_slope") > 0, F.col("fit_slope") / F.when(F.col("pred_slope") > 0, F.col("pred_slope"))))


def pick_heldout_groups(groups: DataFrame, label: str, tie: str, control: Column, k: int = 3) -> DataFrame:
    """The k strongest groups, and the strongest that is no control, each once."""
    top = groups.orderBy(F.desc("m"), tie).limit(k)
    best = groups.where(~control).orderBy(F.desc("m"), tie).limit(1)
    return top.union(best).dropDuplicates([label])


def mean_relative_error(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    p = points.where("predicted > 0")
    return (p.groupBy(*keys) if keys else p.groupBy()).agg(F.avg(F.abs(F.col("realized") - F.col("predicted")) / F.col("predicted")).alias("error"))


def regime_stratified_summary(records: DataFrame, least_rho2: float = 3.0, strong: float = 4.0) -> DataFrame:
    """Medians over all records, those with a clear signal, and the strong ones."""
    parts = None
    for name, keep in (("all", F.lit(True)), ("in_regime", F.col("rho2") >= least_rho2), ("strong", F.col("m") > strong)):
        own = records.where(keep).agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.percentile("ratio", F.lit(0.5)).alias("median_ratio"), F.percentile("r2", F.lit(0.5)).alias("median_r2"), F.min("m").alias("m_low"), F.max("m").alias("m_high"))
        parts = own if parts is None else parts.unionByName(own)
    return parts


def loglog_agreement(records: DataFrame) -> DataFrame:
    p = records.where("pred_slope > 0 and fit_slope > 0").select(F.log10("pred_slope").alias("x"), F.log10("fit_slope").alias("y"))
    return p.agg(F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("exponent"), F.pow(F.lit(10.0), F.regr_intercept("y", "x")).alias("coefficient"))


def ranked(records: DataFrame, value: str, out: str, tie: str | None = None, ranges: int = 64) -> DataFrame:
    """Append ``out``: ranks from 1 by ``value``, ties sharing their mean, or told apart by ``tie``.

    Values are cut into ranges, counted, and ranked inside each, so no task sees all rows.
    """
    cuts = sorted(set(records.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    at = F.aggregate(F.lit(cuts).cast("array<double>"), F.lit(0), lambda n, cut: n + F.when(F.col(value) > cut, 1).otherwise(0)) if cuts else F.lit(0)
    met = records.withColumn("__at", at)
    sizes = {r["__at"]: r.n for r in met.groupBy("__at").agg(F.count("*").alias("n")).collect()}
    before, seen = {}, 0
    for k in sorted(sizes):
        before[k], seen = seen, seen + sizes[k]
    start = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])[F.col("__at")] if before else F.lit(0)
    if tie:
        inside = F.row_number().over(Window.partitionBy("__at").orderBy(value, tie))
    else:
        inside = F.rank().over(Window.partitionBy("__at").orderBy(value)) + (F.count("*").over(Window.partitionBy("__at", value)) - 1) / 2.0
    return met.withColumn(out, start + inside).drop("__at")


def spearman(records: DataFrame, a: Column, b: Column, ordinal_tie: str | None = None) -> DataFrame:
    """Rank correlation; with a tie column, ranks are ordinal. For records, one a group; they are read several times: write them first."""
    p = records.withColumns({"__a": a, "__b": b}).select("__a", "__b", *([ordinal_tie] if ordinal_tie else []))
    p = ranked(ranked(p, "__a", "__ra", ordinal_tie), "__b", "__rb", ordinal_tie)
    return p.agg(F.corr("__ra", "__rb").alias("spearman"), F.count("*").alias("n"))


def hi_lo_snr_split(records: DataFrame) -> DataFrame:
    mid = records.agg(F.percentile("rho2", F.lit(0.5)).alias("__mid"))
    r = records.crossJoin(F.broadcast(mid))
    return r.agg(F.percentile(F.when(F.col("rho2") > F.col("__mid"), F.col("ratio")), F.lit(0.5)).alias("ratio_high"), F.percentile(F.when(F.col("rho2") <= F.col("__mid"), F.col("ratio")), F.lit(0.5)).alias("ratio_low"))


def halves(rows: DataFrame, row: str, seed: int = 0) -> DataFrame:
    """Append ``half``, 0 or 1, from the row's name."""
    half = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(row).cast("string"), F.lit(f"half{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(2))
    return rows.withColumn("half", half.cast("int"))


def half_sizes(split: DataFrame, keys: list[str]) -> DataFrame:
    return split.groupBy(*keys, "half").agg(F.count("*").alias("size"))


def two_halves(rows: DataFrame, groups: DataFrame, keys: list[str], row: str, d: int, points: int = 6, reps: int = 200, seed: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """Independent estimates from two halves against each other and against the whole.

    ratio is the median over depths of the two root mean square angles' ratio;
    sqrt(2) if the halves are as independent as they should be. ``sizes`` are those
    of ``half_sizes`` if they are written already: they are read several times.
    """
    split = halves(rows, row, seed)
    sizes = half_sizes(split, keys) if sizes is None else sizes
    low = sizes.groupBy(*keys).agg(F.min("size").alias("low"), F.count("*").alias("k")).where("k = 2")
    grid = F.filter(depth_grid(F.col("low"), F.greatest(F.floor(F.col("low") / 2), F.lit(21)), points), lambda n: n >= 10)
    depths = sizes.join(low.select(*keys, F.explode(grid).alias("n")), keys)
    means = drawn_means(split, depths, [*keys, "half"], row, d, reps, seed).join(groups.select(*keys, "mu_c", "v"), keys)
    e = means.select(*keys, "n", "rep", "half", "v", vec.minus("mu_n", "mu_c").alias("e"))
    a = e.where("half = 0").select(*keys, "n", "rep", "v", F.col("e").alias("ea"))
    met = a.join(e.where("half = 1").select(*keys, "n", "rep", F.col("e").alias("eb")), [*keys, "n", "rep"])
    sq = lambda c: F.avg(c * c)
    per = met.groupBy(*keys, "n").agg(F.sqrt(sq(vec.angle("ea", "eb"))).alias("cross"), F.sqrt((sq(vec.angle("ea", "v")) + sq(vec.angle("eb", "v"))) / 2).alias("truth"))
    return per.where("truth > 0").groupBy(*keys).agg(F.percentile(F.col("cross") / F.col("truth"), F.lit(0.5)).alias("ratio"), F.count("*").alias("depths"))


def gate(rows: DataFrame, judged: DataFrame, keys: list[str], row: str, d: int, theta: float = THETA, reps: int = 200, slack: float = 1.05, seed: int = 0) -> DataFrame:
    """Does every OVER group still point the same way at its quota? ``met`` says so.

    Only OVER groups are drawn from; judged holds size, n_star, mu_c, v.
    """
    over = judged.where("regime = 'OVER'").withColumn("n", F.least(F.greatest(F.ceil("n_star"), F.lit(5)), F.col("size") - 1).cast("long"))
    means = drawn_means(rows, over.select(*keys, "n", "size"), keys, row, d, reps, seed)
    rms = realized_angles(means, over, keys).groupBy(*keys).agg(F.sqrt(F.avg(F.col("angle") * F.col("angle"))).alias("rms"))
    return over.select(*keys, "size", "n_star", "n").join(rms, keys).withColumn("met", F.col("rms") <= theta * slack)


def gate_report(gated: DataFrame) -> DataFrame:
    return gated.agg(
        F.count("*").alias("predicted"),
        F.count_if("met").alias("verified"),
        F.coalesce(F.avg(F.col("met").cast("double")), F.lit(1.0)).alias("pass_fraction"),
        F.percentile("rms", F.lit(0.5)).alias("median_rms"),
        F.percentile("rms", F.lit(0.95)).alias("p95_rms"),
        F.max("rms").alias("max_rms"),
    )


def gate_exceptions(gated: DataFrame) -> DataFrame:
    return gated.where("not met").withColumn("rms_deg", F.degrees("rms"))


def over_classification_scan(m: DataFrame, control: DataFrame, line: str, least: int = 100, theta: float = THETA) -> DataFrame:
    """Evidence of groups with enough rows, each with its own diagonal noise (ddof 0)."""
    n = F.col("n").cast("double")
    g = m.where(F.col("n") >= least).join(control, line).withColumn("mu_t", F.transform("s1", lambda s: s / n))
    g = g.withColumns({"ell": F.zip_with("s2", "mu_t", lambda s, mu: F.greatest(s / n - mu * mu, F.lit(0.0))), "n_t": n})
    return evidence(g.drop("n"), theta)


def downsampling_invariance(rows: DataFrame, groups: DataFrame, chosen: DataFrame, neighbours: DataFrame, keys: list[str], row: str, d: int, depth: int, reps: int = 300, seed: int = 0) -> DataFrame:
    """How distance and cosines to near groups drift for the chosen groups at one depth.

    neighbours holds the keys, ``other`` and ``v_other``.
    """
    picked = groups.join(chosen.select(*keys), keys, "left_semi").where(F.col("size") > depth)
    means = drawn_means(rows, picked.select(*keys, "size", F.lit(depth).cast("long").alias("n")), keys, row, d, reps, seed)
    drawn = means.join(picked.select(*keys, "mu_c", "v", "m"), keys).withColumn("e", vec.minus("mu_n", "mu_c"))
    length = drawn.groupBy(*keys).agg(F.avg((vec.norm("e") - F.col("m")) / F.col("m")).alias("drift"), F.stddev_pop(vec.norm("e") / F.col("m")).alias("sd")).withColumn("other", F.lit("length"))
    near = drawn.join(neighbours, keys).groupBy(*keys, "other").agg(F.avg(vec.cosine("e", "v_other") - vec.cosine("v", "v_other")).alias("drift"), F.stddev_pop(vec.cosine("e", "v_other")).alias("sd"))
    return length.select(*keys, "other", "drift", "sd").unionByName(near.select(*keys, "other", "drift", "sd"))


def sigma_confirmation(within: DataFrame, marginal: DataFrame, expected: float, tolerance: float = 0.05, whole: bool = True) -> DataFrame:
    """Both variances against an expected value; no verdict if only a part was read."""
    met = within.select(F.col("sigma2").alias("within")).crossJoin(marginal.select(F.col("sigma2").alias("marginal")))
    ok = F.abs(F.col("within") - expected) <= tolerance
    return met.withColumn("confirmed", ok if whole else F.lit(None).cast("boolean"))


def ranked_within(records: DataFrame, by: str, value: str, out: str, ranges: int = 64) -> DataFrame:
    """Append the average rank of ``value`` inside each ``by``, all of them at once.

    Values are cut into ranges of like counts over all records; a record's rank is
    what its ``by`` holds in ranges before, and its rank inside its own range. So
    no task holds a whole ``by``, however large one is.
    """
    cuts = records.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.001)
    at = F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<double>"), lambda c: c < F.col(value)))
    placed = records.withColumn("__at", at)
    # as many rows as groups times ranges
    counts = placed.groupBy(by, "__at").agg(F.count("*").alias("__k"))
    before = F.sum("__k").over(Window.partitionBy(by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(by, "__at", F.coalesce(before, F.lit(0)).alias("__before"))
    own = Window.partitionBy(by, "__at")
    inside = F.rank().over(own.orderBy(value)) + (F.count("*").over(Window.partitionBy(by, "__at", value)) - 1) / 2.0
    return placed.withColumn("__in", inside).join(counts, [by, "__at"]).withColumn(out, F.col("__before") + F.col("__in")).drop("__at", "__in", "__before")


def heldout_summary(records: DataFrame, datasets: DataFrame, least: int = 400, least_rho2: float = 3.0) -> DataFrame:
    """Held-out records by dataset, over groups of enough rows; a dataset without records has n 0 and nulls.

    Medians over all groups and over those in the regime, and the rank correlation
    of the deficit ``1 - ratio`` with ``1 / rho2`` inside each dataset (null for two groups or fewer).
    Records are read several times: write them first.
    """
    kept = records.where(F.col("size") >= least).select("dataset", "ratio", "r2", "rho2", (1 - F.col("ratio")).alias("__d"), (F.lit(1.0) / F.greatest("rho2", F.lit(1e-9))).alias("__i"))
    inside = F.col("rho2") >= least_rho2
    half = lambda c: F.percentile(c, F.lit(0.5))
    per = kept.groupBy("dataset").agg(F.count("*").alias("n"), half("ratio").alias("median_ratio"), F.count_if(inside).alias("n_in_regime"), half(F.when(inside, F.col("ratio"))).alias("median_ratio_in_regime"), half(F.when(inside, F.col("r2"))).alias("median_r2_in_regime"))
    ranks = ranked_within(ranked_within(kept, "dataset", "__d", "__rd"), "dataset", "__i", "__ri")
    agree = ranks.groupBy("dataset").agg(F.when(F.count("*") > 2, F.corr("__rd", "__ri")).alias("spearman"))
    met = datasets.select("dataset").join(per, "dataset", "left").join(agree, "dataset", "left")
    return met.withColumns({"n": F.coalesce("n", F.lit(0)), "n_in_regime": F.coalesce("n_in_regime", F.lit(0))})
