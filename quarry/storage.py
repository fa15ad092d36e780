"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Paths of the scratch tables that the innermost ``settled`` has to delete.
_own: ContextVar[list[str] | None] = ContextVar("own", default=None)
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where none is set and driver and executors are one process, as in tests, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if (own := _own.get()) is not None:
        own.append(path)
    return path


def materialise(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, what a query shuffled goes when it ends, not when the driver happens to collect its garbage.

    For tables that are written only: a frame that is collected twice looks for the files of the first time.
    """
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP)
        else:
            spark.conf.set(_DROP, before)


def settled(build: Callable[[], DataFrame], kind: str = "table") -> DataFrame:
    """What ``build`` returns, materialised; the scratch tables that were written for it go."""
    own: list[str] = []
    token = _own.set(own)
    try:
        df = build()
        spark, schema = df.sparkSession, df.schema
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    finally:
        _own.reset(token)
    _written.append((spark, path))
    if (outer := _own.get()) is not None:
        outer.append(path)
    for gone in own:
        _delete(spark, gone)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files below a table that ``materialise`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if any(path.rstrip("/").endswith(p.rpartition("/")[2]) for _, p in _written):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
