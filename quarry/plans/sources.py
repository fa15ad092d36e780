"""Queries: the test tables written as the line formats, and read back by their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.tables import BASKETS, EDGES, RATINGS, UTILITY, baskets, edges, ratings, table, utility
from quarry.sources import formats
from quarry.storage import scratch


def _file(df: DataFrame, separator: str = "\t", compression: str = "none") -> str:
    path = scratch(df.sparkSession, "lines")
    formats.write_lines(df, path, separator, compression)
    return path


def _in_files(df: DataFrame, *order: str, compression: str = "none") -> str:
    """Lines in order, for formats whose line numbers are ids: a file per range, with names in the order of ranges."""
    return _file(df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order), " ", compression)


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = edges(spark, sf_dir).groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("f"))
    read = formats.adjacency(spark, _file(lists))
    return read.select("user", F.array_join(F.transform("friends", lambda x: x.cast("string")), ",").alias("friends"))


def _vectors(spark: SparkSession, sf_dir: str, separator: str, pattern: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), separator).alias("v"))
    return formats.numbered_vectors(spark, _in_files(v, "vec_id"), pattern).select("id", F.posexplode("v").alias("d", "x"))


def _baskets(spark: SparkSession, sf_dir: str, separator: str) -> DataFrame:
    lines = baskets(spark, sf_dir).groupBy("basket").agg(F.array_join(F.concat(F.array(F.lit("")), F.collect_list("item"), F.collect_list("item")), separator).alias("l"))
    path = _in_files(lines, "basket")
    return (formats.csv_baskets(spark, path) if separator == "," else formats.baskets(spark, path)).groupBy("basket").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.names(spark, _in_files(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('"')).alias("n")), "p_partkey"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir).select(F.col("user") + 1, F.col("item") + 1, "rating")
    return formats.ratings(spark, _file(r, " ")).withColumn("rating", F.round("rating", 8))


def _integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.integers(spark, _file(table(spark, sf_dir, "events").select("user_id"))).groupBy("word").agg(F.count("*").alias("n"))


def _utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 matrix of customers by suppliers: zeros between two ones are written as one piece, and lines are compressed."""
    n = table(spark, sf_dir, "supplier").count()
    own = utility(spark, sf_dir).where((F.col("i") >= 0) & (F.col("i") < n)).groupBy("u").agg(F.sort_array(F.collect_list("i")).alias("i"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u")).join(own, "u", "left").withColumn("i", F.coalesce("i", F.array().cast("array<bigint>")))
    ends = F.concat(F.array(F.lit(-1).cast("long")), "i"), F.concat("i", F.array(F.lit(n).cast("long")))
    gaps = F.zip_with(*ends, lambda a, b: F.repeat(F.lit("0 "), (b - a - 1).cast("int")))
    return formats.utility(spark, _in_files(rows.select("u", F.rtrim(F.array_join(gaps, "1 ")).alias("l")), "u", compression="gzip"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink of pairs has at its path after two runs."""
    path, counts = scratch(spark, "pairs"), table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    for _ in range(2):
        formats.write_pairs(counts, path)
    return formats.lines(spark, path)


def report(df: DataFrame, title: str) -> DataFrame:
    """(line): a title and a line of 'column = value' per row, for people to read."""
    row = F.array_join(F.array(*(F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns)), ", ")
    return df.sparkSession.createDataFrame([(title,)], "line string").unionByName(df.select(row.alias("line")))


QUERIES = {
    "source_text": lambda s, d: formats.lines(s, _file(table(s, d, "part").select("p_partkey", "p_name"))),
    "source_adjacency": _adjacency,
    "source_edges": lambda s, d: formats.edges(s, _file((e := edges(s, d)).unionByName(e), " ")),
    "source_vectors": lambda s, d: _vectors(s, d, " ", r"\s+"),
    "source_csv_matrix": lambda s, d: _vectors(s, d, ",", ","),
    "source_baskets": lambda s, d: _baskets(s, d, " "),
    "source_csv_baskets": lambda s, d: _baskets(s, d, ","),
    "source_names": _names,
    "source_ratings": _ratings,
    "source_integers": _integers,
    "source_utility": _utility,
    "sink_pairs": _pairs,
    "report_brands": lambda s, d: report(table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), "brands"),
}

_VECTORS = "SELECT id, CAST(d - 1 AS INT) AS d, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)"
_LINES = f"WITH {BASKETS} SELECT row_number() OVER (ORDER BY basket) - 1 AS basket, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM baskets GROUP BY baskets.basket"

SQL = {
    "source_text": "SELECT p_partkey || chr(9) || p_name AS value FROM part",
    "source_adjacency": f"""WITH {EDGES} SELECT src AS "user", string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS friends FROM edges GROUP BY 1""",
    "source_edges": f"WITH {EDGES} SELECT src, dst FROM edges",
    "source_vectors": _VECTORS,
    "source_csv_matrix": _VECTORS,
    "source_baskets": _LINES,
    "source_csv_baskets": _LINES,
    "source_names": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name AS name FROM part",
    "source_ratings": f"""WITH {RATINGS} SELECT "user", item, round(rating, 8) AS rating FROM ratings""",
    "source_integers": "SELECT user_id AS word, count(*) AS n FROM events GROUP BY 1",
    "source_utility": f"WITH {UTILITY} SELECT u, i FROM utility",
    "sink_pairs": "SELECT '(''' || p_brand || ''', ' || count(*) || ')' AS value FROM part GROUP BY p_brand",
    "report_brands": "SELECT 'brands' AS line UNION ALL SELECT 'p_brand = ' || p_brand || ', n = ' || count(*) FROM part GROUP BY p_brand",
}
