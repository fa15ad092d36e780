"""Collaborative filtering and latent factors."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import dot


def _inverse_roots(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): one over the root of the degree; keys without rows have none, which counts as 0."""
    return rows.groupBy(key).agg((1 / F.sqrt(F.count("*"))).alias(name))


def user_user(r: DataFrame, user: int, items: int | None = None) -> DataFrame:
    """(i, score) of one user: his row of P^-1/2 R R^T P^-1/2 R, from distinct rows (u, i). Only that row is computed."""
    p = _inverse_roots(r, "u", "p")
    own = r.where(F.col("u") == user).select("i")
    alike = r.join(own, "i", "left_semi").groupBy("u").agg(F.count("*").alias("common")).join(p, "u")
    me = p.where(F.col("u") == user).select(F.col("p").alias("mine"))
    near = alike.crossJoin(F.broadcast(me)).select("u", (F.col("common") * F.col("p") * F.col("mine")).alias("w"))  # one row
    wanted = r if items is None else r.where(F.col("i") <= items)
    return wanted.join(near, "u").groupBy("i").agg(F.sum("w").alias("score"))


def item_item(r: DataFrame, user: int, items: int | None = None) -> DataFrame:
    """(i, score) of one user: his row of R Q^-1/2 R^T R Q^-1/2."""
    q = _inverse_roots(r, "i", "q")
    own = r.where(F.col("u") == user).select("i").join(q, "i").select(F.col("i").alias("j"), "q")
    weight = r.join(own, F.col("i") == F.col("j")).groupBy("u").agg(F.sum("q").alias("w"))
    wanted = r if items is None else r.where(F.col("i") <= items)
    return wanted.join(weight, "u").groupBy("i").agg(F.sum("w").alias("s")).join(q, "i").select("i", (F.col("s") * F.col("q")).alias("score"))


def top_items(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.orderBy(F.desc(F.round("score", 9)), "i").limit(k)


def initial_factors(n: int, k: int, seed: int, name: str) -> np.ndarray:
    r = random.Random(f"{seed}:{name}")
    return np.array([[r.uniform(0, (5 / k) ** 0.5) for _ in range(k)] for _ in range(n)])


def sgd_factors(ratings: DataFrame, k: int = 20, lam: float = 0.1, eta: float = 0.02, epochs: int = 40, seed: int = 0, users: int = 0, items: int = 0) -> DataFrame:
    """(epoch, error): the objective after each epoch of stochastic gradient descent in the order of (user, item).

    Of ``users`` and ``items`` in all, those without ratings keep their first factors, which count in the objective, too.

    The result depends on the order of rows, so by definition one task works through all of them; for factors at scale
    use ``als_factors``. Ratings that share neither user nor item with one still waiting before them commute, and are worked
    off together (``waves``).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf.item.to_numpy(), pdf.user.to_numpy()))
        us, its = (c.factorize(sort=True)[0].astype(np.int32)[order] for c in (pdf.user, pdf.item))
        r, errors = pdf.rating.to_numpy()[order], []
        p, q = initial_factors(max(users, us.max() + 1), k, seed, "users"), initial_factors(max(items, its.max() + 1), k, seed, "items")
        order, cuts = waves(us, its)
        us, its, r = us[order], its[order], r[order]
        for _ in range(epochs):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                u, i = us[a:b], its[a:b]
                x, y = p.take(u, axis=0), q.take(i, axis=0)
                e = 2 * (r[a:b] - np.einsum("ij,ij->i", y, x))[:, None]
                for held, at, own, other in ((q, i, y, x), (p, u, x, y)):
                    change = e * other
                    change -= 2 * lam * own
                    change *= eta
                    change += own
                    held[at] = change
            gaps = sum(((r[a : a + 100_000] - np.einsum("ij,ij->i", q[its[a : a + 100_000]], p[us[a : a + 100_000]])) ** 2).sum() for a in range(0, len(r), 100_000))
            errors.append(gaps + lam * ((p * p).sum() + (q * q).sum()))
        return pd.DataFrame({"epoch": range(1, epochs + 1), "error": errors})

    return ratings.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "epoch int, error double")


def waves(us: np.ndarray, its: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ratings and where its waves begin and end: a rating comes one wave after the last before it, in the given
    order, that has its user or its item. In a wave no user and no item is twice, so it gives what the given order gives."""
    last_user, last_item, wave = [0] * (int(us.max()) + 1), [0] * (int(its.max()) + 1), np.empty(len(us), np.int32)
    for start in range(0, len(us), 1_000_000):
        part = slice(start, start + 1_000_000)
        for n, (u, i) in enumerate(zip(us[part].tolist(), its[part].tolist(), strict=True), start):
            a, b = last_user[u], last_item[i]
            wave[n] = last_user[u] = last_item[i] = (a if a > b else b) + 1
    order = np.argsort(wave, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(wave)[1:])])


def als_factors(ratings: DataFrame, k: int = 20, lam: float = 0.1, epochs: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(id, f) of users and of items by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=k, regParam=lam, maxIter=epochs, seed=seed, userCol="user", itemCol="item", ratingCol="rating").fit(ratings.selectExpr("cast(user as int) user", "cast(item as int) item", "rating"))
    shape = lambda df: df.select(F.col("id").cast("long").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("f"))
    return shape(model.userFactors), shape(model.itemFactors)


def hashed_factors(ids: DataFrame, k: int) -> DataFrame:
    """(id, f): starting factors from the id alone, in [0, sqrt(5/k))."""
    u = lambda j: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), j.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: u(j) * F.lit((5 / k) ** 0.5)).alias("f"))


def objective(ratings: DataFrame, users: DataFrame, items: DataFrame, lam: float = 0.1) -> DataFrame:
    """(error): squared errors over all ratings and lam times the squared factors, rated or not."""
    x = ratings.join(users.select(F.col("id").alias("user"), F.col("f").alias("p")), "user").join(items.select(F.col("id").alias("item"), F.col("f").alias("q")), "item")
    gap = F.col("rating") - dot(F.col("p"), F.col("q"))
    weight = users.unionByName(items).agg(F.sum(dot(F.col("f"), F.col("f"))).alias("w"))
    return x.agg(F.sum(gap * gap).alias("e")).crossJoin(F.broadcast(weight)).select((F.col("e") + lam * F.col("w")).alias("error"))  # one row
