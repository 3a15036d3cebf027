"""Exact quantiles of any number of rows, by narrowing ranges of values.

``percentile`` holds every distinct value in one buffer. Here each rank is first
enclosed between two cuts of a sketch; one pass counts what lies below, at and
between the cuts, so it is certain where the rank is; and only what lies between
is looked at again, a small share of the rows each time, until its distinct
values are few enough to be counted one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values that are counted one by one.
FEW_VALUES = 50_000
ERROR = 0.001


def exact_quantiles(df: DataFrame, x: str, shares: list[float], few: int = FEW_VALUES) -> list[float | None]:
    """What ``percentile`` gives for each share, neighbours interpolated: nulls are left out, as are NaNs; all None without values."""
    rows = df.select(F.col(x).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = rows.count()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    ranks = sorted({r for at in places for r in (math.floor(at), math.ceil(at))})
    value = values_at(rows, n, ranks, few)
    out = []
    for at in places:
        low, high = math.floor(at), math.ceil(at)
        out.append(value[low] if value[low] == value[high] else (high - at) * value[low] + (at - low) * value[high])
    return out


def values_at(rows: DataFrame, n: int, ranks: list[int], few: int) -> dict[int, float]:
    """The values at 0-based ranks of ``v``, of n rows."""
    if n <= few or rows.agg(F.approx_count_distinct("v")).first()[0] <= few // 2:
        counts, found, seen = rows.groupBy("v").agg(F.count("*").alias("k")).orderBy("v").collect(), {}, 0
        todo = list(ranks)
        for c in counts:
            seen += c.k
            while todo and todo[0] < seen:
                found[todo.pop(0)] = c.v
        return found
    found: dict[int, float] = {}
    margin = 2 * ERROR
    while len(found) < len(ranks):
        open_ = [r for r in ranks if r not in found]
        shares = [s for r in open_ for s in (max(0.0, r / n - margin), min(1.0, r / n + margin))]
        cuts = rows.approxQuantile("v", shares, ERROR)
        ends = sorted(set(zip(cuts[::2], cuts[1::2])))
        of = {r: (cuts[2 * i], cuts[2 * i + 1]) for i, r in enumerate(open_)}
        v = F.col("v")
        sums = rows.agg(*[F.count_if(c).alias(f"{name}{i}") for i, (low, high) in enumerate(ends) for name, c in (("below", v < low), ("low", v <= low), ("high", v < high), ("upto", v <= high))]).first()
        inner: dict[tuple, list[int]] = {}
        for r in open_:
            i = ends.index(of[r])
            if sums[f"below{i}"] <= r < sums[f"low{i}"]:
                found[r] = of[r][0]
            elif sums[f"high{i}"] <= r < sums[f"upto{i}"]:
                found[r] = of[r][1]
            elif sums[f"low{i}"] <= r < sums[f"high{i}"]:
                inner.setdefault((*of[r], sums[f"low{i}"], sums[f"high{i}"]), []).append(r)
        for (low, high, before, after), own in inner.items():
            deeper = values_at(rows.where((v > low) & (v < high)), after - before, [r - before for r in own], few)
            found |= {r: deeper[r - before] for r in own}
        margin *= 4  # a rank outside its cuts is sought between wider ones
    return found
