"""Matrix decomposition and a soft-margin support vector machine."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A descent without a number of steps fails after so many, rather than to end early.
GUARD = 100_000
#: Rows of a descent's partition at least, as its passes are many and light.
PARTITION_ROWS = 20_000


def gram(rows: DataFrame) -> DataFrame:
    """(i, j, x), i <= j: M^T M from rows (v), one aggregate over products within rows; no rows are paired."""
    cells = rows.select(F.posexplode("v").alias("i", "a"), "v").select("i", "a", F.posexplode("v").alias("j", "b")).where("i <= j")
    return cells.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("x"))


def singular_values(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(rank, singular value, eigenvalue of M^T M), largest first. The Gram matrix, of the columns' number squared, is solved on the driver."""
    cells = gram(rows).collect()
    n = max(r.j for r in cells) + 1
    m = np.zeros((n, n))
    for r in cells:
        m[r.i, r.j] = m[r.j, r.i] = r.x
    values = np.sort(np.linalg.eigvalsh(m))[::-1]
    return [(i + 1, float(np.sqrt(max(v, 0))), float(v)) for i, v in enumerate(values)]


def _margin(w: list[float], b: float) -> Column:
    return F.col("y") * (_product([F.lit(v) for v in w]) + F.lit(b))


def _product(w: list[Column]) -> Column:
    """x times w in the order of dimensions, as plain sums, which are compiled; functions over arrays are not."""
    return reduce(lambda a, d: a + F.col("x")[d] * w[d], range(len(w)), F.lit(0.0))


def svm_cost(rows: DataFrame, w: list[float], b: float, c: float = 100.0) -> DataFrame:
    """(cost) over rows (x, y): half the squared weights and c times the hinge losses."""
    return rows.agg((F.lit(sum(v * v for v in w) / 2) + c * F.coalesce(F.sum(F.greatest(F.lit(0.0), 1 - _margin(w, b))), F.lit(0.0))).alias("cost"))


def svm_gradient(rows: DataFrame, w: list[float], b: float, c: float = 100.0) -> DataFrame:
    """(d, g): the gradient by weight, and that of the bias at d = -1. Only margins under 1 count."""
    bad = rows.where(_margin(w, b) < 1)
    parts = bad.select(F.posexplode(F.concat(F.array(F.lit(1.0)), "x")).alias("d", "v"), "y").groupBy((F.col("d") - 1).alias("d")).agg(F.sum(-F.col("y") * F.col("v")).alias("s"))
    every = rows.sparkSession.createDataFrame([(-1, 0.0), *enumerate(map(float, w))], "d int, own double")
    return every.join(parts, "d", "left").select("d", (F.col("own") + c * F.coalesce("s", F.lit(0.0))).alias("g"))


def descend(rows: DataFrame, dim: int, eta: float, epsilon: float, c: float = 100.0, batch_size: int | None = None, averaged: bool = False, most: int | None = 50) -> tuple[list[float], list[float], float]:
    """Costs (the first before any step), weights and bias by gradient descent from 0.

    Batches are cyclic slices of rows (place, x, y), place from 0 in a fixed order; None takes all rows. Stops when the
    change of cost in percent, halved with the one before if ``averaged``, is under ``epsilon``, or after ``most`` steps; without ``most``, an error says so if it hasn't after ``GUARD`` steps.
    A step is one pass with one aggregate: the cost over all rows, and over the next slice the gradient at the same weights.
    Weights and slices go in as constant arrays, read at places that only the rows know, so that all steps share their generated code.
    """
    n = rows.count()
    size = max(1, n if batch_size is None else batch_size)
    slices = max(1, -(-n // size))
    held = rows.select("y", F.concat("x", F.array(F.lit(1.0))).alias("x"), F.floor(F.col("place") / size).alias("slice"), F.lit(0).alias("zero")).coalesce(max(1, -(-n // PARTITION_ROWS))).cache()

    def over(w: list[float], part: int) -> tuple[float, list[float]]:
        weights = F.array(*map(F.lit, w))
        margin = F.col("y") * _product([weights[F.col("zero") + d] for d in range(dim + 1)])
        mine = F.when((margin < 1) & F.array_contains(F.array(F.lit(part).cast("long")), F.col("slice")), -F.col("y"))
        sums = held.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), 1 - margin)), F.lit(0.0)), *(F.coalesce(F.sum(mine * F.col("x")[d]), F.lit(0.0)) for d in range(dim + 1))).first()
        return sum(v * v for v in w[:-1]) / 2 + c * sums[0], [c * g + (w[d] if d < dim else 0.0) for d, g in enumerate(sums[1:])]

    w, change = [0.0] * (dim + 1), 0.0
    cost, gradient = over(w, 0)
    costs = [cost]
    for step in range(GUARD if most is None else most):
        w = [x - eta * g for x, g in zip(w, gradient, strict=True)]
        last, (cost, gradient) = cost, over(w, (step + 1) % slices)
        costs.append(cost)
        now = 100 * abs(last - cost) / last if last else 0.0
        change = (change + now) / 2 if averaged else now
        if change < epsilon:
            break
    else:
        if most is None:
            raise RuntimeError(f"the descent did not settle in {GUARD} steps")
    held.unpersist()
    return costs, w[:-1], w[-1]
