"""Queries: streams, run to their end over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.sketch import HASH_PARAMS
from quarry.plans.models import NARROW
from quarry.plans.tables import table
from quarry.storage import scratch
from quarry.streaming import clusters, sketch


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """The stream's whole result after its input is used up, by way of a table of its own; with the number of the batch in
    update mode."""
    out, latest = scratch(spark, "stream-out"), {}

    def keep(batch: DataFrame, number: int) -> None:
        latest["path"] = f"{out}/{number}"
        batch.write.mode("overwrite").parquet(latest["path"])

    run = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "stream-state")).queryName(f"drain-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()
    run.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(latest["path"])
    return spark.read.parquet(f"{out}/*").withColumn("batch", F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("long"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = table(spark, sf_dir, "events")
    return spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parque[t]")


def _sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sketch.build_stream(_events(spark, sf_dir).select(F.col("user_id").alias("word")), NARROW), "complete")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    per_hour = sketch.windowed_counts(events)
    last = _drained(spark, per_hour, "update").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return last.select("start", "event_type", "r.n", F.round("r.total", 4).alias("total"))


def _bdmo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("key"), F.col("vec_id").cast("double").alias("time"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return clusters.replay_clusters(rows, 8, 4, 1e12, 32).select("key", "cluster", "size")


QUERIES = {"stream_cms": _sketch, "stream_windows": _windows, "bdmo_clusters": _bdmo}

SQL = {
    "stream_cms": f"SELECT CAST(j AS INT) AS j, ((user_id % 123457) * a + b) % 123457 % {NARROW} AS bucket, count(*) AS cnt FROM events, (VALUES {', '.join(f'({j}, {a}, {b})' for j, (a, b) in enumerate(HASH_PARAMS))}) p(j, a, b) GROUP BY 1, 2",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
