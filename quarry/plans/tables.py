"""The test tables, and the inputs that the queries derive from them; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import as_doubles
from quarry.operators.order import with_next


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of consecutive orders, as a directed graph."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", (F.col("o_custkey") + 1).alias("src"))
    pairs = with_next(orders, ["o_orderdate", "o_orderkey"], "src", "dst")
    return pairs.where("dst is not null and src <> dst").select("src", "dst").distinct()


EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey + 1 AS src, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) + 1 AS dst FROM orders) WHERE dst IS NOT NULL AND src <> dst)"""


def dead_end_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph with some nodes' outgoing edges taken away, so that rank leaks."""
    return edges(spark, sf_dir).where(F.col("src") % 10 != 0)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): the brands in each order. They are dealt by basket, so that what is gathered by basket isn't dealt again."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), "l_partkey")
    return lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item")), "l_partkey").select("basket", "item").repartition("basket").distinct()


BASKETS = "baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, i): which customer bought from which supplier."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("i"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("u")).join(lines, "o_orderkey").select("u", "i").distinct()


UTILITY = "utility AS (SELECT DISTINCT o_custkey AS u, l_suppkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating)"""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("item"), "l_quantity")
    joined = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user")).join(lines, "o_orderkey")
    return joined.groupBy("user", "item").agg((F.sum("l_quantity") / F.count(F.lit(1)) / 10).alias("rating"))


RATINGS = 'ratings AS (SELECT o_custkey AS "user", l_suppkey AS item, sum(l_quantity) / count(*) / 10 AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)'


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), as_doubles(F.col("embedding")).alias("v"))


POINTS = "points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
DIMS = POINTS + ", dims AS (SELECT id, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM points)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("word"))


WORDS = "words AS (SELECT l_partkey AS word FROM lineitem)"
