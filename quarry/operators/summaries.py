"""Clustering by summaries: BFR over chunks, CURE from a bounded sample, and clustroids under any distance (GRGPF)."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import clustering as cl
from quarry.storage import materialise

#: Points in a part of the table that has a tree of its own, and trees that are joined at once.
PART_POINTS, TREES = 20_000, 32

Summary = tuple[int, np.ndarray, np.ndarray]  # points, sums, sums of squares


def merged(a: Summary, b: Summary) -> Summary:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def variance(s: Summary) -> np.ndarray:
    return np.maximum(s[2] / s[0] - (s[1] / s[0]) ** 2, 1e-12)


def _summaries(assigned: DataFrame) -> dict[int, Summary]:
    out: dict[int, list] = {}
    for r in cl.bfr_summary(assigned).orderBy("c", "d").collect():  # a row per cluster and dimension
        out.setdefault(r.c, []).append((r.n, r.sum, r.sumsq))
    return {c: (rows[0][0], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) for c, rows in out.items()}


def _frame(spark, summaries: dict[int, Summary]) -> DataFrame:
    return spark.createDataFrame([(c, d, int(n), float(s[d]), float(q[d])) for c, (n, s, q) in summaries.items() for d in range(len(s))], "c int, d int, n long, sum double, sumsq double")


def bfr(points: DataFrame, k: int, chunks: int = 4, limit: float = 4.0, compressed: int = 20, spread: float = 1.0) -> tuple[dict[int, Summary], DataFrame]:
    """Discard-set summaries by cluster, and (id, c) of all points by the nearest of them.

    Points (id, v) come in chunks by the hash of the id. Of each chunk, those within ``limit`` Mahalanobis units (times the
    root of the dimension) of a cluster are added to its summary. The others are clustered into at most ``compressed``
    groups; groups of two and more become summaries of the compression set, and those merge whose common mean variance stays
    under ``spread`` times that of the clusters; single points are retained for the next chunk. After the last chunk,
    what is left goes to the nearest cluster. Retained are no more points than groups; the rest is sums on the executors.
    """
    spark = points.sparkSession
    rows = materialise(points.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "chunks")
    first = rows.where("chunk = 0")
    _, start = cl.kmeans(first.select("id", "v"), cl.farthest_first(first.select("id", "v"), k, first.agg(F.min("id")).first()[0])[1], iterations=5)
    kept = _summaries(cl.assign(first.select("id", "v"), start).select("id", "c").join(first.select("id", "v"), "id"))
    dense: list[Summary] = []
    retained: list[tuple[int, list[float]]] = []
    typical = np.mean([variance(s).mean() for s in kept.values()])
    for chunk in range(1, chunks):
        own = rows.where(F.col("chunk") == chunk).select("id", "v")
        if retained:
            own = own.unionByName(spark.createDataFrame(retained, "id long, v array<double>"))
        near = materialise(cl.bfr_discard(own, _frame(spark, kept), limit).join(own, "id"), "near")
        for c, s in _summaries(near.where("discarded").select("c", "v")).items():
            kept[c] = merged(kept[c], s)
        left = materialise(near.where("not discarded").select("id", "v"), "left")
        n = left.count()
        retained = []
        if n:
            _, centres = cl.kmeans(left, cl.farthest_first(left, min(compressed, n), left.agg(F.min("id")).first()[0])[1], iterations=3)
            groups = materialise(cl.assign(left, centres).select("id", "c").join(left, "id"), "groups")
            found = _summaries(groups)
            dense += [s for s in found.values() if s[0] > 1]
            alone = [c for c, s in found.items() if s[0] == 1]
            retained = [(r.id, r.v) for r in groups.where(F.col("c").isin(alone)).collect()] if alone else []
        dense = _merge_dense(dense, spread * typical)
    for s in [*dense, *((1, np.array(v), np.array(v) ** 2) for _, v in retained)]:
        c = min(kept, key=lambda c: (((s[1] / s[0] - kept[c][1] / kept[c][0]) ** 2).sum(), c))
        kept[c] = merged(kept[c], s)
    names = sorted(kept)
    final = cl.assign(points, [(kept[c][1] / kept[c][0]).tolist() for c in names])
    return kept, final.select("id", F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1).alias("c"))


def _merge_dense(dense: list[Summary], most: float) -> list[Summary]:
    dense = list(dense)
    while len(dense) > 1:
        best = min((variance(merged(a, b)).mean(), i, j) for i, a in enumerate(dense) for j, b in enumerate(dense) if i < j)
        if best[0] > most:
            break
        _, i, j = best
        dense[i] = merged(dense[i], dense.pop(j))
    return dense


def agglomerate(x: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each row: the two clusters with the nearest centroids merge until k are left."""
    member = np.arange(len(x))
    centre, size, live = x.astype(float).copy(), np.ones(len(x)), np.ones(len(x), bool)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - k):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        live[j] = False
        member[member == j] = i
        d[j, :] = d[:, j] = np.inf
        row = np.where(live, ((centre - centre[i]) ** 2).sum(1), np.inf)
        row[i] = np.inf
        d[i, :] = d[:, i] = row
    return np.unique(member, return_inverse=True)[1]


def cure(points: DataFrame, k: int, sample_size: int = 500, count: int = 4, shrink: float = 0.2, merge_under: float = 0.0) -> DataFrame:
    """(id, c): the cluster of the nearest representative.

    A sample of at most ``sample_size`` points (those of the smallest md5 of the id) is clustered hierarchically on the
    driver; representatives are shrunk towards the centroids, and clusters with two of them nearer than ``merge_under``
    become one.
    """
    spark = points.sparkSession
    sample = points.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample_size).collect()
    labels = agglomerate(np.array([r.v for r in sample], float), min(k, len(sample)))
    rows = spark.createDataFrame([(r.id, int(c), r.v) for r, c in zip(sample, labels, strict=True)], "id long, c int, v array<double>")
    found = cl.cure_representatives(rows, count, shrink)
    up = {c: c for c, _ in found}
    for a, x in found:
        for b, y in found:
            if up[a] != up[b] and ((np.array(x) - np.array(y)) ** 2).sum() < merge_under**2:
                low, high = sorted((up[a], up[b]))
                up = {c: low if r == high else r for c, r in up.items()}
    return cl.cure_assign(points, [(up[c], p) for c, p in found])


class ClustroidCluster:
    """A cluster known by its clustroid, and its nearest and farthest points with estimated sums of squared distances."""

    def __init__(self, points: list, distance: Callable, keep: int):
        self.distance, self.keep, self.n = distance, keep, len(points)
        sums = [sum(distance(p, q) ** 2 for q in points) for p in points]
        order = sorted(range(len(points)), key=lambda i: (sums[i], i))
        self.held = [(points[i], sums[i]) for i in order]
        self._trim()

    @property
    def clustroid(self):
        return self.held[0][0]

    @property
    def rowsum(self) -> float:
        return self.held[0][1]

    @property
    def radius(self) -> float:
        return (self.rowsum / self.n) ** 0.5

    def _trim(self) -> None:
        """The clustroid first, then its nearest points and its farthest."""
        self.held.sort(key=lambda x: x[1])
        by = sorted(self.held[1:], key=lambda x: self.distance(self.held[0][0], x[0]))
        self.held = [self.held[0], *(by if len(by) <= 2 * self.keep else by[: self.keep] + by[-self.keep :])]

    def insert(self, p) -> None:
        """A point's own sum is estimated as the clustroid's plus n times the squared distance to it."""
        own = self.rowsum + self.n * self.distance(p, self.clustroid) ** 2
        self.held = [(q, s + self.distance(p, q) ** 2) for q, s in self.held] + [(p, own)]
        self.n += 1
        self._trim()

    def merge(self, other: ClustroidCluster) -> None:
        """Sums in the union by the same right-angle estimate, for the points that either holds."""
        gap = self.distance(self.clustroid, other.clustroid) ** 2
        cross = lambda a, b: [(p, s + b.n * (a.distance(p, a.clustroid) ** 2 + gap) + b.rowsum) for p, s in a.held]
        self.held, self.n = cross(self, other) + cross(other, self), self.n + other.n
        self._trim()

    def split(self) -> list[ClustroidCluster]:
        """Two clusters of the points held, each with its share of the size."""
        held = [p for p, _ in self.held]
        a, b = max(((p, q) for i, p in enumerate(held) for q in held[i + 1 :]), key=lambda x: self.distance(*x))
        sides: tuple[list, list] = ([], [])
        for p in held:
            sides[self.distance(p, b) < self.distance(p, a)].append(p)
        out = [ClustroidCluster(s, self.distance, self.keep) for s in sides if s]
        for c in out:
            grown = self.n * c.n / len(held)
            c.held, c.n = [(p, s * grown / c.n) for p, s in c.held], max(c.n, round(grown))
        return out


class ClustroidTree:
    """Clusters in leaves of at most ``width``; a point goes to the leaf with the nearest sampled clustroid, and there to the
    nearest cluster. Clusters wider than ``limit`` split; with more than ``most`` clusters the limit doubles and the nearest merge."""

    def __init__(self, distance: Callable, limit: float, most: int = 50, width: int = 8, keep: int = 4):
        self.distance, self.limit, self.most, self.width, self.keep = distance, limit, most, width, keep
        self.leaves: list[list[ClustroidCluster]] = []

    def clusters(self) -> list[ClustroidCluster]:
        return [c for leaf in self.leaves for c in leaf]

    def insert(self, p) -> None:
        self._put(p, lambda: ClustroidCluster([p], self.distance, self.keep), lambda near: near.insert(p))

    def absorb(self, other: ClustroidCluster) -> None:
        """A cluster of another tree, as its clustroid would go."""
        self._put(other.clustroid, lambda: other, lambda near: near.merge(other))

    def _put(self, p, new: Callable, into: Callable) -> None:
        if not self.leaves:
            self.leaves = [[new()]]
            return
        leaf = min(self.leaves, key=lambda x: min(self.distance(p, c.clustroid) for c in x[: self.keep]))
        near = min(leaf, key=lambda c: self.distance(p, c.clustroid))
        if self.distance(p, near.clustroid) > 2 * self.limit:
            leaf.append(new())
        else:
            into(near)
            if near.radius > self.limit and len(near.held) > 1:
                leaf.remove(near)
                leaf.extend(near.split())
        if len(leaf) > self.width:
            a, b = leaf[0], max(leaf, key=lambda c: self.distance(leaf[0].clustroid, c.clustroid))
            self.leaves.remove(leaf)
            for mine, other in ((a, b), (b, a)):
                part = [c for c in leaf if (self.distance(c.clustroid, mine.clustroid), mine is b) < (self.distance(c.clustroid, other.clustroid), other is b)]
                if part:
                    self.leaves.append(part)
        while len(self.clusters()) > self.most:
            self.limit *= 2
            every = self.clusters()
            i, j = min(((i, j) for i in range(len(every)) for j in range(i)), key=lambda x: self.distance(every[x[0]].clustroid, every[x[1]].clustroid))
            every[j].merge(every.pop(i))
            self.leaves = [every[a : a + self.width] for a in range(0, len(every), self.width)]


def _euclidean(a, b) -> float:
    return float(np.sqrt(((np.asarray(a) - np.asarray(b)) ** 2).sum()))


def grgpf_tree(points: DataFrame, limit: float, sample_size: int = 2000, most: int = 50) -> ClustroidTree:
    """A tree of all points: it starts from a bounded sample (the smallest md5 of the id, in that order).

    All others are inserted into trees of parts of the table, by the hash of the id, that begin with the limit that the
    sample's tree has come to; their clusters are merged, some trees at a time, and last into the sample's tree.
    """
    order = F.md5(F.col("id").cast("string").cast("binary"))
    sample = points.orderBy(order, "id").limit(sample_size).collect()
    tree = ClustroidTree(_euclidean, limit, most)
    for r in sample:
        tree.insert(np.array(r.v, float))
    first, reached = {r.id for r in sample}, tree.limit
    parts = max(1, -(-points.count() // PART_POINTS))

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        own = ClustroidTree(_euclidean, reached, most)
        for i, v in zip(pdf.id, pdf.v, strict=True):
            if i not in first:
                own.insert(np.array(v, float))
        return pd.DataFrame({"part": [int(pdf.part.iloc[0])], "tree": [pickle.dumps(own.clusters())]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        own = ClustroidTree(_euclidean, reached, most)
        for blob in pdf.sort_values("part").tree:
            for c in pickle.loads(blob):
                own.absorb(c)
        return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // TREES], "tree": [pickle.dumps(own.clusters())]})

    rows = points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), order.alias("h"))
    trees = rows.groupBy("part").applyInPandas(lambda pdf: grown(pdf.sort_values(["h", "id"])), "part long, tree binary")
    while parts > TREES:
        trees = trees.withColumn("up", F.floor(F.col("part") / TREES)).groupBy("up").applyInPandas(lambda pdf: joined(pdf), "part long, tree binary")
        parts = -(-parts // TREES)
    for r in trees.orderBy("part").collect():  # at most TREES rows of ``most`` clusters
        for c in pickle.loads(r.tree):
            tree.absorb(c)
    return tree


def grgpf(points: DataFrame, limit: float, sample_size: int = 2000, most: int = 50) -> DataFrame:
    """(id, c): the nearest clustroid of a tree of all points."""
    return cl.assign(points, [c.clustroid.tolist() for c in grgpf_tree(points, limit, sample_size, most).clusters()]).select("id", "c")
