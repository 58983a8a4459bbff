"""Base counts by position, `cov: array<struct<a,c,g,t: int>>`, made, written and parsed in Arrow batches.

As Column expressions each letter would be a row of its own within an interpreted function, some microseconds each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FIELDS = pa.struct([(b, pa.int32()) for b in "acgt"])
COV = "cov array<struct<a:int,c:int,g:int,t:int>>"
#: Letters of a slice of rows that is held at once, about.
SLICE = 1 << 20


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and where each value starts, from 0."""
    values = values.cast(pa.large_binary())
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the sizes of a slice's rows sum up to about SLICE."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


def numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of an array of texts with white space between them, and how many each text has; others are an error."""
    data, bounds = buffers(values)
    digit = (data >= 48) & (data <= 57)
    if not (digit | (data == 32) | ((data >= 9) & (data <= 13))).all():
        rows = [x.split() for x in values.cast(pa.binary()).to_pylist()]
        return np.array([int(y) for x in rows for y in x], np.int32), np.array([len(x) for x in rows], np.int64)
    begins = np.zeros(len(data), bool)
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    first = digit & (begins | np.concatenate([[True], ~digit[:-1]])[: len(data)])
    at = np.flatnonzero(first)
    value = data[at].astype(np.int64) - 48
    rest = digit & ~first
    if rest.any():
        stops = np.append(np.flatnonzero(~rest), len(data))  # the first place that doesn't go on with a number
        size = stops[np.searchsorted(stops, at, "right")] - at
        if size.max() > 10:
            raise ValueError("a base count beyond 32 bits")
        for k in range(1, int(size.max())):
            more = size > k
            value[more] = value[more] * 10 + data[at[more] + k] - 48
        if value.max() > np.iinfo(np.int32).max:
            raise ValueError("a base count beyond 32 bits")
    return value.astype(np.int32), np.diff(np.searchsorted(at, bounds))


def coverage(lines: list[pa.Array], pad: bool = False) -> pa.Array:
    """Base counts from four arrays of texts; null where one is missing, and where they aren't of one length.

    pad: shorter ones are filled up with nulls instead.
    """
    there = np.logical_and.reduce([np.asarray(x.is_valid()) for x in lines])
    found = [numbers(pc.if_else(pa.array(there), x, pa.scalar("", x.type))) for x in lines]
    fit = np.logical_and.reduce([n == found[0][1] for _, n in found])
    if pad and not fit.all():
        rows = [np.split(v, np.cumsum(n)[:-1]) for v, n in found]
        return pa.array([[dict(zip("acgt", (None if y is None else int(y) for y in x))) for x in zip_longest(*part)] if ok else None for ok, *part in zip(there, *rows)], pa.list_(FIELDS))
    fit &= there
    base = [pa.array(v[np.repeat(fit, n)]) for v, n in found]
    bounds = np.concatenate([[0], np.cumsum(np.where(fit, found[0][1], 0))])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(base, fields=list(FIELDS)), mask=pa.array(~fit))


def replaced(rows: DataFrame, gone: list[str], added: str, make) -> DataFrame:
    """rows without the columns `gone` and with those that make(slice of a batch) gives, cut by the first of `gone`."""
    fields = [f for f in rows.schema.fields if f.name not in gone]
    names = [x.split()[0] for x in added.split(", ")]

    def stage(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(gone[0])
            size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
            for part in slices(batch, np.asarray(pc.fill_null(size, 0)).astype(np.int64) + 1):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *make(part)], names=[*(f.name for f in fields), *names])

    return rows.mapInArrow(stage, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), added]))


def covered(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """rows (seq, copies, ..) with cov, in which each letter counts as often as there are copies, in place of copies."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        data, bounds = buffers(pc.fill_null(part.column("letters"), ""))
        n = np.repeat(np.asarray(part.column(copies)).astype(np.int32), np.diff(bounds))
        base = [pa.array(np.where(data == ord(b), n, 0).astype(np.int32)) for b in "ACGT"]
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(base, fields=list(FIELDS)), mask=part.column("letters").is_null())]

    return replaced(rows.withColumn("letters", rows["seq"]), ["letters", copies], COV, make)


def parsed(rows: DataFrame) -> DataFrame:
    """rows with the texts a, c, g, t of counts as cov."""
    return replaced(rows, list("acgt"), COV, lambda part: [coverage([part.column(b) for b in "acgt"], pad=True)])


def joined(bounds: np.ndarray, values: pa.Array, sep: str) -> pa.Array:
    """The numbers of each row as one text; nulls are left out."""
    if values.null_count:
        rows = values.to_pylist()
        return pa.array([sep.join(str(x) for x in rows[a:b] if x is not None) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())
    own = np.asarray(values)
    if len(own) and (own.min() < 0 or own.max() > 9):
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values.cast(pa.string())), sep)
    data, size = (own + 48).astype(np.uint8), np.diff(bounds)
    if sep:
        data = np.stack([data, np.full(len(data), ord(sep), np.uint8)], axis=1).ravel()
        stay = np.ones(len(data), bool)
        stay[2 * bounds[1:][size > 0] - 1] = False
        data, size = data[stay], np.maximum(2 * size - 1, 0)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def texts(rows: DataFrame, sep: str, volume: bool = False) -> DataFrame:
    """rows with cov as four texts a, c, g, t of the counts with `sep` (one sign or none) between them, and with volume: the sum of all counts."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        lists = part.column("cov")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        inner = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        base = [inner.field(i) for i in range(4)]
        gone = lists.is_null()
        out = [pc.if_else(gone, pa.scalar(None, pa.string()), joined(bounds - bounds[0], x, sep)) for x in base]
        if volume:
            total = np.concatenate([[0], np.cumsum(sum(np.asarray(x.fill_null(0)).astype(np.int64) for x in base))])
            out.append(pc.if_else(gone, pa.scalar(None, pa.int64()), pa.array(np.diff(total[bounds - bounds[0]]))))
        return out

    return replaced(rows, ["cov"], ", ".join([f"{b} string" for b in "acgt"] + ["volume long"] * volume), make)
