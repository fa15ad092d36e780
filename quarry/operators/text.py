"""Token counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def initial_letter_counts(lines: DataFrame, column: str = "text") -> DataFrame:
    """(letter, n): how many runs of ASCII letters begin with each letter, upper and lower case alike, by letter."""
    words = lines.select(F.explode(F.split(column, "[^a-zA-Z]+")).alias("w")).where("w <> ''")
    return words.groupBy(F.lower(F.substring("w", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("n")).orderBy("letter")
