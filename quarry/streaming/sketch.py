"""Count-min sketch of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.sketch import buckets


def build_stream(words: DataFrame, n_buckets: int, params: list[tuple[int, int]] | None = None) -> DataFrame:
    """(j, bucket, cnt) of a streaming frame (word), for update or complete mode. The state is the sketch: rows times buckets."""
    return words.select(F.explode(buckets(F.col("word"), n_buckets, params)).alias("k")).groupBy("k.j", "k.bucket").agg(F.count("*").alias("cnt"))


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n, total) of a stream (ts, event_type, value), closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")
