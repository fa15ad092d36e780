"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(u: Column, v: Column) -> Column:
    return _total(F.zip_with(u, v, lambda a, b: a * b))


def l1(u: Column, v: Column) -> Column:
    return _total(F.zip_with(u, v, lambda a, b: F.abs(a - b)))


def squared_l2(u: Column, v: Column) -> Column:
    return _total(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)))


METRICS = {"l1": l1, "l2": squared_l2}
