"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it names none, one of our own serves a session in one process (as in tests); on a cluster, whose
    executors wouldn't see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed within go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, which also cuts its lineage.

    What was dealt for it is gone then. The table stays until it is `discarded` or the function `within` which it
    was stored has returned.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.parquet(path)
    for scope in _scopes:
        scope.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_scopes: list[list[str]] = []


def discarded(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; only those that `stored` returned itself."""
    for table in tables:
        _deleted(table.sparkSession, table._stored_at)


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def within(name: str):
    """A function whose result, a table or a tuple of tables, is stored, after which all tables go that it has stored on the way."""

    def decorated(make: Callable) -> Callable:
        @functools.wraps(make)
        def run(*args, **options):
            made: list[str] = []
            _scopes.append(made)
            try:
                out = make(*args, **options)
                out = tuple(stored(x, name) for x in out) if isinstance(out, tuple) else stored(out, name)
            finally:
                _scopes[:] = [x for x in _scopes if x is not made]
            kept = {x._stored_at: x for x in (out if isinstance(out, tuple) else (out,))}
            spark = next(iter(kept.values())).sparkSession
            for path in made:
                if path not in kept:
                    _deleted(spark, path)
            return out

        return run

    return decorated
