"""From raw documents to a training mix: five stages, each over all that the one before it kept.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out of texts, benchmark
passages are cut out and documents with several go, and what is left is mixed to the sources' target weights. Stages that
change texts bring n_chars up to date. Rows whose text is cut to nothing stay, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chunkdedup, decontaminate, mixing, neardup, toxicity
from quarry.llm.common import discard, materialise, settled, table


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` in the columns of ``docs``, n_chars as long as the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.training(spark, sf_dir))
    return toxicity.score(docs, model).where(F.col("tox_score") < toxicity.CUTOFF).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct_documents(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(chunkdedup.dedup(docs), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Nearest examples, signatures and chunks have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        last, docs = docs, settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            discard(last)  # the documents themselves aren't ours
    return docs
