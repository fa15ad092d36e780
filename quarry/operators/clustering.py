"""Clustering of points (id, v): k-means under two metrics, and the summaries, representatives and clustroids of BFR, CURE
and GRGPF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import METRICS, squared_l2

Centroids = list[list[float]]


def _nearest_broadcast(points: DataFrame, centroids: Centroids, metric: str) -> DataFrame:
    """(id, v, dist, c). The centroids, k rows, are one constant array that all rows share."""
    spark = points.sparkSession
    held = spark.createDataFrame([([list(map(float, c)) for c in centroids],)], "cs array<array<double>>")
    d = METRICS[metric]
    best = F.array_min(F.transform("cs", lambda c, i: F.struct(d(F.col("v"), c).alias("dist"), i.alias("c"))))
    return points.crossJoin(F.broadcast(held)).select("id", "v", best.alias("b")).select("id", "v", "b.dist", "b.c")  # one row of k vectors


def assign(points: DataFrame, centroids: Centroids, metric: str = "l2") -> DataFrame:
    """(id, c, dist)"""
    return _nearest_broadcast(points, centroids, metric).select("id", "c", "dist")


def kmeans(points: DataFrame, centroids: Centroids, metric: str = "l2", iterations: int | None = 20) -> tuple[list[float], Centroids]:
    """Cost of each iteration, taken with the centroids before its update, and the last centroids.

    Without a number of iterations it goes on until the cost stands still.

    The update is the mean for both metrics; a cluster without points keeps its centroid. An iteration is one pass with
    one aggregate: sums, sizes and cost by cluster and dimension; k times the dimension rows reach the driver.
    """
    points = points.cache()
    costs, now = [], [list(map(float, c)) for c in centroids]
    while len(costs) != iterations and (iterations is not None or len(costs) < 2 or costs[-2] - costs[-1] > 1e-9 * costs[-2]):
        near = _nearest_broadcast(points, now, metric)
        totals = near.select("c", "dist", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.avg("x").alias("mean"), F.sum("dist").alias("cost")).collect()
        costs.append(sum(sorted(r.cost for r in totals if r.d == 0)))
        for r in totals:
            now[r.c][r.d] = r.mean
    points.unpersist()
    return costs, now


def percentage_change(costs: list[float], at: int = 9) -> float:
    return 100 * (costs[0] - costs[at]) / costs[0]


def first_points(points: DataFrame, k: int) -> Centroids:
    return [r.v for r in points.orderBy("id").limit(k).collect()]


def farthest_first(points: DataFrame, k: int, start: int = 0) -> tuple[list[int], Centroids]:
    """Ids and vectors: each next one is the point farthest from those chosen, ties to the smaller id."""
    chosen = _farther(points, [], k, start)
    return [i for i, _ in chosen], [v for _, v in chosen]


def _farther(points: DataFrame, chosen: list[tuple[int, list[float]]], k: int, start: int = 0) -> list[tuple[int, list[float]]]:
    """The first ``k`` points of the order, of which some are known. A pass a point; one row reaches the driver."""
    points, chosen = points.cache(), list(chosen)
    while len(chosen) < k:
        far = _nearest_broadcast(points, [v for _, v in chosen], "l2").orderBy(F.desc("dist"), "id") if chosen else points.where(F.col("id") == start)
        r = far.first()
        chosen.append((r.id, r.v))
    points.unpersist()
    return chosen


def choose_k(points: DataFrame, tolerance: float = 0.1, start: int = 0) -> tuple[int, dict[int, float]]:
    """The smallest k, by doubling and then bisection, beyond which the mean distance to the centroid falls by less than ``tolerance``.

    Each k is clustered from its farthest-first points until the cost stands still; k ends at the number of points. No points: 0.
    """
    most = points.count()
    if most < 2:
        return most, {}
    seen: dict[int, float] = {}
    chosen: list[tuple[int, list[float]]] = []

    def spread(k: int) -> float:
        nonlocal chosen
        if k not in seen:
            chosen = _farther(points, chosen, k, start)
            _, c = kmeans(points, [v for _, v in chosen[:k]], iterations=None)
            seen[k] = assign(points, c).agg(F.avg(F.sqrt("dist"))).first()[0]
        return seen[k]

    falls = lambda a, b: spread(a) - spread(b) > tolerance * spread(a)
    low, high = 0, 1
    while high < most and falls(high, min(2 * high, most)):
        low, high = high, min(2 * high, most)
    while high - low > 1:  # twice ``high`` is no better, while ``low`` is worse
        mid = (low + high) // 2
        low, high = (mid, high) if falls(mid, high) else (low, mid)
    return high, seen


def bfr_summary(assigned: DataFrame) -> DataFrame:
    """(c, d, n, sum, sumsq) from rows (c, v): a cluster's summary by dimension."""
    return assigned.select("c", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def bfr_discard(points: DataFrame, summary: DataFrame, limit: float = 4.0) -> DataFrame:
    """(id, c, distance, discarded): Mahalanobis distance to the nearest summary; under limit*sqrt(d) a point is discarded.

    A summary has a row per cluster and dimension; the clusters are few, and are held in one row.
    """
    mean = F.col("sum") / F.col("n")
    per = summary.withColumn("mean", mean).withColumn("var", F.greatest(F.col("sumsq") / F.col("n") - mean * mean, F.lit(1e-12)))
    one = per.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "mean", "var"))).alias("s")).agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("all"))
    far = F.transform("all", lambda k: F.struct(F.sqrt(F.aggregate(F.zip_with("v", k["s"], lambda x, s: (x - s["mean"]) * (x - s["mean"]) / s["var"]), F.lit(0.0), lambda a, y: a + y)).alias("distance"), k["c"].alias("c")))
    out = points.crossJoin(F.broadcast(one)).select("id", F.size("v").alias("dim"), F.array_min(far).alias("b"))
    return out.select("id", F.col("b.c").alias("c"), F.col("b.distance").alias("distance"), (F.col("b.distance") < limit * F.sqrt("dim")).alias("discarded"))


def cure_representatives(sample: DataFrame, count: int = 4, shrink: float = 0.2) -> list[tuple[int, list[float]]]:
    """(cluster, point): of each cluster of a sample (id, c, v), scattered points moved towards the centroid.

    The first is the farthest from the centroid, each next the farthest from those before; ties to the smaller id. All
    clusters take a step in one pass.
    """
    sample = sample.cache()
    centre = {}
    for r in sample.select("c", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.avg("x").alias("m")).collect():
        centre.setdefault(r.c, {})[r.d] = r.m
    centre = {c: [m[d] for d in sorted(m)] for c, m in centre.items()}
    chosen: dict[int, list[list[float]]] = {c: [] for c in centre}
    spark = sample.sparkSession
    for step in range(count):
        held = spark.createDataFrame([(c, [centre[c]] if not step else chosen[c]) for c in centre], "c int, near array<array<double>>")
        far = F.array_min(F.transform("near", lambda p: squared_l2(F.col("v"), p)))
        best = Window.partitionBy("c").orderBy(F.desc("far"), "id")
        picked = sample.join(F.broadcast(held), "c").withColumn("far", far).withColumn("r", F.row_number().over(best)).where("r = 1").select("c", "v")  # a row per cluster
        for r in picked.collect():
            chosen[r.c].append(r.v)
    sample.unpersist()
    return [(c, [x + shrink * (m - x) for x, m in zip(p, centre[c], strict=True)]) for c in sorted(chosen) for p in chosen[c]]


def cure_assign(points: DataFrame, representatives: list[tuple[int, list[float]]]) -> DataFrame:
    """(id, c): the cluster of the nearest representative."""
    near = _nearest_broadcast(points, [p for _, p in representatives], "l2")
    names = F.array(*(F.lit(c) for c, _ in representatives))
    return near.select("id", F.element_at(names, F.col("c") + 1).alias("c"))


def clustroids(assigned: DataFrame) -> DataFrame:
    """(c, clustroid, rowsum): the point (id, c, v) with the least sum of squared distances to its cluster, ties to the smaller id.

    The sum over y of |x-y|^2 is n|x|^2 - 2 x.S + Q with the cluster's size n, sum S and sum of squared lengths Q, so no
    pair of points is formed.
    """
    sums = assigned.select("c", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = sums.groupBy("c").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("s"), F.sum("q").alias("q"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    cross = F.aggregate(F.zip_with("v", "s", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rows = assigned.join(F.broadcast(total), "c").select("c", "id", F.round(F.col("n") * square - 2 * cross + F.col("q"), 9).alias("rowsum"))  # a row per cluster
    return rows.groupBy("c").agg(F.min(F.struct("rowsum", "id")).alias("m")).select("c", F.col("m.id").alias("clustroid"), F.col("m.rowsum").alias("rowsum"))
