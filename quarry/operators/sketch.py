"""Count-min sketches with linear hash functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 123_457
#: Fixed values: (a, b) of the five hash functions.
HASH_PARAMS = [(3, 1561), (17, 277), (38, 394), (61, 13), (78, 246)]


def sizes(delta: float, epsilon: float) -> tuple[int, int]:
    """(rows, buckets) for a failure probability and an error as a share of the stream."""
    return math.ceil(round(math.log(1 / delta), 9)), math.ceil(round(math.e / epsilon, 9))


def buckets(word: Column, n_buckets: int, params: list[tuple[int, int]] | None = None, prime: int = PRIME) -> Column:
    """Array of (j, bucket)."""
    return F.array(*(F.struct(F.lit(j).alias("j"), ((F.pmod(word, F.lit(prime)) * a + b) % prime % n_buckets).alias("bucket")) for j, (a, b) in enumerate(params or HASH_PARAMS)))


def build(stream: DataFrame, n_buckets: int, params: list[tuple[int, int]] | None = None) -> DataFrame:
    """(j, bucket, cnt). Words are counted first, so that the shuffle has a row per word and task, not per hash."""
    words = stream.groupBy("word").agg(F.count("*").alias("f"))
    return words.select(F.explode(buckets(F.col("word"), n_buckets, params)).alias("k"), "f").groupBy("k.j", "k.bucket").agg(F.sum("f").alias("cnt"))


def estimate(words: DataFrame, sketch: DataFrame, n_buckets: int, params: list[tuple[int, int]] | None = None) -> DataFrame:
    """(word, estimate): the least of the word's counters."""
    asked = words.select("word", F.explode(buckets(F.col("word"), n_buckets, params)).alias("k")).select("word", "k.j", "k.bucket")
    return asked.join(sketch, ["j", "bucket"], "left").groupBy("word").agg(F.min(F.coalesce("cnt", F.lit(0))).cast("long").alias("estimate"))


def errors(stream: DataFrame, n_buckets: int, params: list[tuple[int, int]] | None = None) -> DataFrame:
    """(word, f, estimate, error, share): exact and estimated counts, relative error, and the word's share of the stream."""
    exact = stream.groupBy("word").agg(F.count("*").alias("f"))
    total = exact.agg(F.sum("f").alias("t"))
    e = estimate(exact.select("word"), build(stream, n_buckets, params), n_buckets, params)
    return exact.join(e, "word").crossJoin(F.broadcast(total)).select("word", "f", "estimate", ((F.col("estimate") - F.col("f")) / F.col("f")).alias("error"), (F.col("f") / F.col("t")).alias("share"))  # one row


def summary(errs: DataFrame) -> DataFrame:
    """(median, most, under_one): of the relative errors, and the share of words with less than 1."""
    return errs.agg(F.median("error").alias("median"), F.max("error").alias("most"), F.avg((F.col("error") < 1).cast("double")).alias("under_one"))
