"""Vectors as ``array<double>`` columns: JVM-side arithmetic without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return F.transform(col(x), lambda v: v.cast("double"))


def total(x: Column | str) -> Column:
    """The sum of a vector's entries."""
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def scaled(a: Column | str, by: Column) -> Column:
    return F.transform(col(a), lambda x: x * by)


def over(a: Column | str, by: Column) -> Column:
    return F.transform(col(a), lambda x: x / by)


def unit(a: Column | str) -> Column:
    """The vector's direction; zeros if it has no length."""
    m = norm(a)
    return F.transform(col(a), lambda x: F.when(m > 0, x / m).otherwise(F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def angle(a: Column | str, b: Column | str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def sums(x: str, d: int, square: bool = False) -> Column:
    """The vector of sums over a group, as ``d`` plain sums that combine before a shuffle."""
    cells = [F.col(x)[k].cast("double") for k in range(d)]
    return F.array(*[F.sum(c * c if square else c) for c in cells])


def means(x: str, d: int) -> Column:
    return F.array(*[F.avg(F.col(x)[k].cast("double")) for k in range(d)])
