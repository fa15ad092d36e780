"""Largest inner products by collision-counting hashing (query-aware LSH).

Vectors get one more component that makes their lengths equal, so the largest inner products are the nearest points. A
task holds a block of at most about ``BLOCK_ROWS`` vectors and their projections on ``PROJECTIONS`` random lines, each a sorted
array. For a query, a window around its own projection grows on every line alike, each round by the next radius
(virtual rehashing: no bucket is ever built); a vector collides on a line if it lies in the window. As windows hold most of
a line, what is counted is what lies outside of them. Vectors that collide on ``THRESHOLD`` of the lines or more are verified by
exact inner products, once each. The search ends when the k-th best vector verified lies within the radius, which is the
distance at which a vector passes the threshold with the probability ``CONFIDENCE``, or when all lines are used up. How many
vectors are verified follows from that alone. Blocks' results meet in a top-k per query.

Queries are read in blocks of ``QUERY_ROWS``, each against all blocks of vectors. Every row is indexed.

Defined results: vectors that are null, empty, zero, of another dimension than most, or that hold null or non-finite
components take no part, neither do rows with null vec_id; rows repeated are candidates each, but a query's own id is
none; a query that is repeated is answered once per row; ties go to the smaller vec_id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, table

K = 20
QUERY_EVERY = 20
PROJECTIONS = 80
#: Share of the lines on which a vector must collide to be verified.
THRESHOLD = 0.85
CONFIDENCE = 0.8
#: Windows grow by this factor a round.
GROWTH = 1.06
#: The first radius is this share of the distance at which so many of a block's own vectors, in the middle, have their k-th neighbour.
START, TRIALS = 1.0, 32
BLOCK_ROWS = 32_768
QUERY_ROWS = 16_384
SEED = 20240611
_NORMAL = NormalDist()
#: Half-width of the window in radii: a vector at the radius then collides on a line with the chance that CONFIDENCE asks for.
REACH = _NORMAL.inv_cdf((1 + THRESHOLD + _NORMAL.inv_cdf(CONFIDENCE) * (THRESHOLD * (1 - THRESHOLD) / PROJECTIONS) ** 0.5) / 2)


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, PROJECTIONS)).astype(np.float32)


class Block:
    """Vectors with sorted projections. longest: the largest squared length of all vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.longest = ids[by], vectors[by], longest
        lift = np.sqrt(np.maximum(longest - (self.vectors * self.vectors).sum(1), 0))
        shadow = np.ascontiguousarray((np.concatenate([self.vectors, lift[:, None]], axis=1).astype(np.float32) @ lines(vectors.shape[1])).T)
        self.order = np.argsort(shadow, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(shadow, self.order, axis=1)
        self.missed = PROJECTIONS - int(np.ceil(THRESHOLD * PROJECTIONS))
        self.verified = 0

    def _distance(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Between lifted vectors, from the inner product with a query of this length."""
        return np.sqrt(np.maximum(2 * self.longest - 2 * score / length * np.sqrt(self.longest), 0))

    def _start(self, k: int) -> float:
        some = self.vectors[:: -(-len(self.ids) // TRIALS)]
        k = min(k, len(self.ids) - 1)
        score = some @ self.vectors.T
        return START * float(np.median(self._distance(-np.partition(-score, k, axis=1)[:, k], np.sqrt((some * some).sum(1))))) or 1e-3 * float(np.sqrt(self.longest))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, scores): the k best found for each query, its own id left out."""
        lengths = np.sqrt((queries * queries).sum(1))
        shadow = (queries / lengths[:, None] * np.sqrt(self.longest)).astype(np.float32) @ lines(queries.shape[1])[:-1]
        n, start, rounds = len(self.ids), self._start(k), []

        def window(r: int) -> tuple[list[list[int]], list[list[int]]]:
            """For all queries: on each line, where the window begins and ends in that round."""
            while len(rounds) <= r:
                half = REACH * start * GROWTH ** len(rounds)
                rounds.append([np.stack([self.sorted[j].searchsorted(shadow[:, j] + d, side=side) for j in range(PROJECTIONS)], axis=1).tolist() for d, side in ((-half, "left"), (half, "right"))])
            return rounds[r]

        for i in range(len(queries)):
            outside, seen = np.zeros(n, np.uint8), self.ids == own[i]
            places, scores = np.zeros(0, np.int64), np.zeros(0)
            r, lo = 0, None
            while True:
                a, b = (x[i] for x in window(r))
                for j, order in enumerate(self.order):
                    if lo is None:
                        outside[order[: a[j]]] += 1
                        outside[order[b[j] :]] += 1
                        continue
                    if a[j] < lo[j]:
                        outside[order[a[j] : lo[j]]] -= 1
                    if b[j] > hi[j]:
                        outside[order[hi[j] : b[j]]] -= 1
                lo, hi = a, b
                new = np.flatnonzero((outside <= self.missed) & ~seen)
                seen[new] = True
                self.verified += len(new)
                places, scores = np.append(places, new), np.append(scores, self.vectors[new] @ queries[i])
                if len(scores) >= k and self._distance(np.partition(scores, -k)[-k], lengths[i]) <= start * GROWTH**r or (not any(lo) and all(x == n for x in hi)):
                    break
                r += 1
            if len(scores) > k:
                places = places[scores >= np.partition(scores, -k)[-k] - 1e-9 * self.longest]
            score = (self.vectors[places] * queries[i]).sum(1)
            by = np.lexsort((self.ids[places], -score))[:k]
            yield i, self.ids[places[by]], score[by]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with double components, without the rows that take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


_FOUND = "query_id long, query_row long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all other rows."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "vectors")
    facts = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == facts.dim)
    dim, longest = facts.dim, facts.longest * (1 + 1e-9)
    blocks = max(1, -(-facts.n // BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))  # of a table, so that a task that runs again deals alike
    asked = rows.where(is_query).select("vec_id", "v").withColumn("query_row", F.monotonically_increasing_id())
    asked = materialise(asked, "queries")
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_row"), F.lit(groups)).cast("int"))
    # each block of queries meets each block of vectors once: (part, block) pairs, of bounded size
    left = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(own: pa.Table, queries: pa.Table) -> pa.Table:
        ids = own.column("vec_id").to_numpy() if own.num_rows else np.zeros(0, np.int64)
        out = [[], [], [], []]
        if own.num_rows and queries.num_rows:
            held = Block(ids, _matrix(own.column("v").combine_chunks(), dim), longest)
            qid, qrow = queries.column("vec_id").to_numpy(), queries.column("query_row").to_numpy()
            for i, at, score in held.search(_matrix(queries.column("v").combine_chunks(), dim), qid, k):
                for column, x in zip(out, (np.full(len(at), qid[i]), np.full(len(at), qrow[i]), at, score), strict=True):
                    column.append(x)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query_id": cols[0], "query_row": cols[1], "vec_id": cols[2], "score": cols[3].astype(np.float64)})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
