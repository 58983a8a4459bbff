"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discarded, stored, within  # noqa: F401  for the operators

#: Words: maximal runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_column(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def named(name: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def aside(df: DataFrame, own: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df with every column but `own` under a name that no operator uses, and the new name of each."""
    names = {c: c if c in own else f"__x{i}" for i, c in enumerate(df.columns)}
    return df.select([named(c).alias(n) for c, n in names.items()]), names


def untouched(df: DataFrame, own: tuple[str, ...], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df's columns after apply, which sees those not in `own` under other names and can't replace them."""
    inner, names = aside(df, own)
    return apply(inner).select([F.col(n).alias(c) for c, n in names.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `most` bytes of text, so that numpy's work arrays stay small.

    One row is never cut: a very long text makes a slice of its own.
    """
    for batch in batches:
        array = batch.column(column)
        wide = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
        sizes = pa.compute.fill_null(pa.compute.binary_length(wide), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int = 4 << 20):
    """Arrow batches of about `most` bytes for what is executed within, so that neither side of a worker's pipe holds more.

    The session's own limit is kept where it is lower, and comes back afterwards.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    held = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if held <= 0 or held > most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def feistel(x: Column, a: Column, b: Column, prf, rounds: int = 8) -> Column:
    """A keyed permutation of 0 .. a*b-1: x = left*b + right, each half in turn shifted by a hash of the other.

    prf(round, half) gives a non-negative long.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r")),
        lambda s, i: F.when(i % 2 == 1, F.struct(((s["l"] + prf(i, s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + prf(i, s["l"])) % b).alias("r"))),
        lambda s: s["l"] * b + s["r"],
    )


def walked(x: Column, n: Column, permute, steps: int = 64) -> Column:
    """Cycle walking: permute again until the value is below n, which keeps the permutation within 0 .. n-1.

    With a domain of at most n + 2*sqrt(n) + 1 values, 64 steps suffice for certain up to n = 900; beyond,
    one more step is needed with a chance under (2/30)**64.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), permute(x), lambda s, _: F.when(s < n, s).otherwise(permute(s)))
