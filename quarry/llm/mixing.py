"""Mixing sources to target weights.

Words are summed per source, a target share per source follows from the weights, and each document is emitted
floor(rate) times plus once more if a uniform number made from its id's hash is below the rate's fraction.
All of it is DataFrame code. The only frame that is broadcast has a row per source and its row count is checked.

Defined results: a null text has size 0; null is a source of its own, the last; a source without words has rate 0, so
its documents are not taken; repeated rows are documents each, with equal copies; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import keeps_columns, materialise, word_count

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"
#: A frame of sources is broadcast up to so many rows (names of 1 KB would make 10 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 10_000


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id); a null id counts as 'null'."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, take ``weights`` in turn. Targets share the total by weight and stop at
    ``max_rate`` times the source's size. In the order of max_rate*size/weight the stopped sources come first, so the
    level of the others is what is left after the k first, over the weights from k on, at the first k that is not stopped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_rate).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (total - before) / left)
    s = s.withColumn("stopped", F.col("cap") <= F.col("weight") * F.col("level"))
    open_level = F.min_by(F.when(~F.col("stopped"), F.col("level")), F.when(~F.col("stopped"), F.col("ratio"))).over(Window.partitionBy())
    return s.select("source", "source_size", F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("weight") * open_level).alias("target"))


@keeps_columns("doc_id", "source", "text")
def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` with the columns mix_size, mix_source_size, mix_target and mix_copies."""
    sized = docs.withColumn("mix_size", word_count(F.col("text")))
    goal = targets(sized.select("source", F.col("mix_size").alias("size")), weights, max_rate).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    goal = materialise(goal, "goals")  # a row per source, from one pass over the texts
    few = goal.count() <= BROADCAST_ROWS
    out = sized.join(F.broadcast(goal) if few else goal, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    more = (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn("mix_copies", F.floor(rate) + more)


@keeps_columns("doc_id", "source", "text")
def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as ``plan`` says, in the columns of ``docs``."""
    return plan(docs, **options).where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"))


#: Rows of (doc_id, source, size) come from the view or expression put in place of {sizes}.
PLAN_SQL = r"""
sizes AS ({sizes}),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM per_source),
weighed AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM placed),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
open_level AS (SELECT arg_min(level, ratio) AS l FROM levels WHERE NOT cap <= weight * level),
goals AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * l END AS target FROM levels, open_level),
rates AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rates)
"""
SIZE_SQL = r"SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents"
SQL = "WITH " + PLAN_SQL.replace("{sizes}", SIZE_SQL) + "SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed"
