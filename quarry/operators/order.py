"""Numbering rows in a global order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import materialise


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with a number from 1 in the given order, which must be total.

    Rows are dealt by ranges, numbered within each range, and shifted by the sizes of the ranges before; only a row per
    range is brought together. The ranges are written first, because their bounds come from a sample.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(sizes.select("range_id", before.alias("shift")))  # a row per partition
    own = F.row_number().over(Window.partitionBy("range_id").orderBy(*order))
    return ranged.withColumn(name, own.cast("long")).join(shift, "range_id").withColumn(name, F.col(name) + F.col("shift")).drop("range_id", "shift")


def with_next(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the value of the next row in a total order, null in the last row.

    As in ``numbered``, rows are dealt by ranges; the last row of each takes the first value of the range after it.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id()), "ranged")
    first = ranged.groupBy("range_id").agg(F.min(F.struct(*order, F.col(value).alias("_first"))).getField("_first").alias("_first"))
    after = F.broadcast(first.select("range_id", F.lead("_first").over(Window.orderBy("range_id")).alias("_after")))  # a row per partition
    own = Window.partitionBy("range_id").orderBy(*order)
    rows = ranged.withColumn(name, F.lead(value).over(own)).withColumn("_inner", F.lead(F.lit(True)).over(own))
    return rows.join(after, "range_id").withColumn(name, F.when(F.col("_inner"), F.col(name)).otherwise(F.col("_after"))).drop("range_id", "_inner", "_after")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if its scan has fewer (one row group, say); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
