"""Readers and writers of the line formats that mining data come in. All are splittable text scans with column parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value)"""
    return spark.read.text(path)


def _filled(df: DataFrame) -> DataFrame:
    return df.where(F.trim("value") != "")


def _fields(pattern: str = r"\s+") -> Column:
    return F.filter(F.split(F.trim("value"), pattern), lambda x: x != "")


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(user, friends): a user, a tab, and a comma-separated list that may be empty or missing."""
    halves = F.split("value", "\t")
    friends = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x) != "")
    return _filled(lines(spark, path)).select(F.trim(F.get(halves, F.lit(0))).cast("long").alias("user"), F.transform(friends, lambda x: F.trim(x).cast("long")).alias("friends"))


def adjacency_edges(lists: DataFrame) -> DataFrame:
    """(src, dst), distinct, of adjacency lists."""
    return lists.select(F.col("user").alias("src"), F.explode("friends").alias("dst")).distinct()


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst), distinct, from two integers a line."""
    f = _fields()
    return _filled(lines(spark, path)).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst")).distinct()


def vectors(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """(v): numbers of each line that isn't blank; ``separator`` is a pattern, a comma for CSV matrices."""
    return _filled(lines(spark, path)).select(F.transform(_fields(separator), lambda x: F.trim(x).cast("double")).alias("v"))


def numbered_vectors(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """(id, v): ids from 0 in the order of lines."""
    return _in_order(_filled(lines(spark, path))).select("id", F.transform(_fields(separator), lambda x: F.trim(x).cast("double")).alias("v"))


def _in_order(df: DataFrame, column: str = "value", value: Column | None = None) -> DataFrame:
    """(id, column) of read lines, or of a value of theirs: ids from 0 in the order of files' names and of lines. A split's lines
    are numbered as they come, and shifted by the sizes of the splits before."""
    from pyspark.sql import Window

    from quarry.storage import materialise

    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    tagged = materialise(df.select((F.col(column) if value is None else value).alias(column), *split, F.monotonically_increasing_id().alias("own")), "lines")
    sizes = tagged.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("own").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("file", "start", (before - F.col("first")).alias("shift"))
    return tagged.join(F.broadcast(shift), ["file", "start"]).select((F.col("own") + F.col("shift")).cast("long").alias("id"), column)  # a row per split


def baskets(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """(basket, item), distinct: items of each line by white space, or by comma for ragged CSV; empty items are dropped."""
    rows = _in_order(_filled(lines(spark, path)))
    return rows.select(F.col("id").alias("basket"), F.explode(F.array_distinct(F.filter(F.transform(F.split("value", separator), lambda x: F.trim(x)), lambda x: x != ""))).alias("item"))


def csv_baskets(spark: SparkSession, path: str) -> DataFrame:
    return baskets(spark, path, ",")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(i, name): a name a line, quotes taken off, numbered from 0; names needn't be unique."""
    return _in_order(_filled(lines(spark, path))).select(F.col("id").alias("i"), F.trim(F.translate(F.trim("value"), '"', "")).alias("name"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, rating) from 'user item rating' with ids from 1, which become ids from 0."""
    f = _fields()
    return _filled(lines(spark, path)).select((f[0].cast("long") - 1).alias("user"), (f[1].cast("long") - 1).alias("item"), f[2].cast("double").alias("rating"))


def integers(spark: SparkSession, path: str) -> DataFrame:
    """(word): an integer a line."""
    return _filled(lines(spark, path)).select(F.trim("value").cast("long").alias("word"))


def integer_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """(word) as a stream, so many files a micro-batch."""
    reader: DataStreamReader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return _filled(reader.text(path)).select(F.trim("value").cast("long").alias("word"))


def utility(spark: SparkSession, path: str) -> DataFrame:
    """(u, i) of the ones in a 0/1 matrix, both from 0. Lines are cut at their ones, so only these become values."""
    from pyspark.sql import Window

    cells = F.array_join(F.transform(_fields(), lambda x: F.when(x.cast("double") != 0, "1").otherwise("0")), " ")
    plain = F.when(F.col("value").rlike("^(?:[01] )*+[01]$"), F.col("value")).otherwise(cells)
    gaps = _in_order(_filled(lines(spark, path)), "gaps", F.transform(F.split(plain, "1"), F.length))
    each = gaps.select(F.col("id").alias("u"), F.size("gaps").alias("n"), F.posexplode("gaps").alias("p", "gap"))
    upto = F.sum(F.col("gap").cast("long")).over(Window.partitionBy("u").orderBy("p")) + F.col("p")
    return each.withColumn("i", (upto / 2).cast("int")).where("p < n - 1").select("u", "i")


def write_lines(df: DataFrame, path: str, separator: str = "\t", compression: str = "none") -> None:
    """Rows as lines of separated columns; what was at the path is replaced."""
    df.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path, compression=compression)


def write_pairs(df: DataFrame, path: str) -> None:
    """Two columns as lines like ('a', 86000)."""
    a, b = df.columns
    df.select(F.format_string("('%s', %d)", F.col(a), F.col(b).cast("long")).alias("value")).write.mode("overwrite").text(path)
