"""Clustering of a stream in buckets that double in size (BDMO).

A bucket holds clusters (centroid, size, spread bound) of ``base`` times a power of two points. When there are three of a
size, the two oldest merge: clusters are paired with their nearest until at most ``most`` are left. Buckets whose newest
point is older than the window expire. A query over the last m points takes the newest buckets that cover them and merges
their clusters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def merge_clusters(clusters: list[tuple[list[float], int]], most: int) -> list[tuple[list[float], int]]:
    """The nearest two by centroid, first pair on ties, become one until at most ``most`` are left."""
    left = [(np.asarray(c, float), n) for c, n in clusters]
    while len(left) > most:
        x = np.array([c for c, _ in left])
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        d[np.tril_indices(len(left))] = np.inf
        i, j = np.unravel_index(np.argmin(d), d.shape)
        (a, n), (b, m) = left[i], left.pop(j)
        left[i] = ((a * n + b * m) / (n + m), n + m)
    return [(c.tolist(), n) for c, n in left]


@dataclass
class Buckets:
    """State of one stream: full buckets, oldest first, as (points, newest time, clusters), and points not yet in one."""

    base: int
    most: int
    window: float
    full: list = field(default_factory=list)
    waiting: list = field(default_factory=list)

    def add(self, time: float, point: list[float]) -> None:
        self.waiting.append((time, list(map(float, point))))
        if len(self.waiting) == self.base:
            self.full.append((self.base, self.waiting[-1][0], merge_clusters([(p, 1) for _, p in self.waiting], self.most)))
            self.waiting = []
            self._merge()
        while self.full and self.full[0][1] < time - self.window:
            self.full.pop(0)

    def _merge(self) -> None:
        size = self.base
        while len(same := [i for i, b in enumerate(self.full) if b[0] == size]) > 2:
            i, j = same[:2]
            a, b = self.full[i], self.full[j]
            self.full[i] = (a[0] + b[0], max(a[1], b[1]), merge_clusters(a[2] + b[2], self.most))
            del self.full[j]
            size *= 2

    def query(self, m: int) -> list[tuple[list[float], int]]:
        """Clusters of at least the last m points, and of at most twice as many once buckets are full."""
        clusters, seen = [(p, 1) for _, p in self.waiting], len(self.waiting)
        for n, _, c in reversed(self.full):
            if seen >= m:
                break
            clusters, seen = clusters + c, seen + n
        return merge_clusters(clusters, self.most)

    def dump(self) -> str:
        return json.dumps([self.full, self.waiting])

    def load(self, text: str) -> Buckets:
        self.full, self.waiting = json.loads(text)
        return self


OUT = "key string, cluster int, centroid array<double>, size long"


def _rows(key: str, clusters: list[tuple[list[float], int]]) -> pd.DataFrame:
    return pd.DataFrame({"key": [key] * len(clusters), "cluster": range(len(clusters)), "centroid": [c for c, _ in clusters], "size": [n for _, n in clusters]})


class _Processor(StatefulProcessor):
    def __init__(self, base: int, most: int, window: float, m: int):
        self.args, self.m = (base, most, window), m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buckets", "s string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buckets = Buckets(*self.args)
        if self.state.exists():
            buckets.load(self.state.get()[0])
        points = pd.concat(list(rows)).sort_values("time")
        for t, v in zip(points.time, points.v, strict=True):
            buckets.add(float(t), list(v))
        self.state.update((buckets.dump(),))
        yield _rows(key[0], buckets.query(self.m))

    def close(self) -> None:
        pass


def stream_clusters(points: DataFrame, base: int, most: int, window: float, m: int) -> DataFrame:
    """Clusters of the last m points of each key after each micro-batch of a stream (key, time, v).

    Needs a state store with column families, as RocksDB's. A key's points are one sequence by definition; many keys share
    the work.
    """
    return points.groupBy("key").transformWithStateInPandas(_Processor(base, most, window, m), OUT, "Update", "None")


def replay_clusters(points: DataFrame, base: int, most: int, window: float, m: int) -> DataFrame:
    """The same over a table (key, time, v)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buckets = Buckets(base, most, window)
        for t, v in zip(*(pdf.sort_values("time")[c] for c in ("time", "v")), strict=True):
            buckets.add(float(t), list(v))
        return _rows(pdf.key.iloc[0], buckets.query(m))

    return points.groupBy("key").applyInPandas(run, OUT)
