"""What the operators of this subpackage share: table loading, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import discard, materialise, scratch, settled, shared_dir, shuffles_dropped

__all__ = ["bounded_batches", "discard", "fold", "keeps_columns", "materialise", "pieces", "released", "scratch", "settled", "shared_dir", "shuffles_dropped", "table", "texts", "word_count"]

#: Rows of an Arrow batch, so that a batch of texts takes a few MB in the JVM and in Python.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keeps_columns(*needed: str) -> Callable:
    """For functions from documents to documents with some columns more: input columns that the function doesn't need have
    neutral names while it runs, so that none clashes with its own. Of an added and an input column of one name, the added
    one stays.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            names = docs.columns
            inner = [c if c in needed else f"kept_{i}" for i, c in enumerate(names)]
            out = f(docs.toDF(*inner), *args, **options)
            added = [c for c in out.columns if c not in inner]
            taken = {c.lower() for c in added}
            return out.select(*(F.col(i).alias(c) for i, c in zip(inner, names, strict=True) if c.lower() not in taken), *added)

        return run

    return wrap


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
TRIM_EVERY = 16


def released(batches: Iterator) -> Iterator:
    """The batches; after some and at the end, memory that is free goes back to the system, as idle workers live on."""
    for i, batch in enumerate(batches):
        yield batch
        del batch
        if i % TRIM_EVERY == TRIM_EVERY - 1:
            give_back()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    for v in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist():
        yield v or b""


def pieces(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with a total of about ``limit``, one item at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
