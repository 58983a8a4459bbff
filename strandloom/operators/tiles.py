"""All pairs of two tables of sequences, block by block: nothing that is looked up or met is dealt.

A block holds some ten thousand sequences at two bits a letter. Spark pairs the blocks of one table with those of
another (a product of small tables), a task indexes a block's seeds and looks up those of the other one. So disk
grows with the sequences, memory with a block, and only time with the square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sequences of a block at most, pairs that are compared at once, and pairs that a block's part may hold before it is halved.
BLOCK, AT_ONCE, HELD = 1 << 16, 1 << 19, 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)


def blocks(rows: DataFrame, most: int | None = None, key: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """rows as arrays of up to `most` (BLOCK) each, with the number of the block as `tile`, to be stored: few and large, but enough for all cores.

    key: a column whose equal values stay in one block and next to each other, even where it gets larger by that.
    order: columns by which the rows are ranged, so that a block holds neighbours.
    """
    many, most = rows.count(), most or BLOCK
    files = max(-(-many // most), min(-(-many // 1024), int((2 * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1), 1)

    def stage(batches):
        held, n, last = [], 0, None

        def row():
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = [whole.column(i).chunk(0) for i in range(whole.num_columns)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), c, type=pa.list_(pa.field("element", c.type))) for c in columns], names=whole.schema.names)

        for batch in batches:
            while batch.num_rows:
                cut = max(most - n, 0)
                if key and cut < batch.num_rows:
                    values = np.asarray(batch.column(key))
                    new = np.flatnonzero(values != np.r_[values[:1] if last is None else last, values[:-1]])
                    cut = next(iter(new[new >= cut]), batch.num_rows)
                part, batch = batch.slice(0, cut), batch.slice(cut)
                if part.num_rows:
                    held.append(part)
                    n += part.num_rows
                    last = np.asarray(part.column(key))[-1:] if key else None
                if batch.num_rows and held:
                    yield row()
                    held, n, last = [], 0, None
        if n:
            yield row()

    if order:
        dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    else:
        dealt = rows.repartition(files, key).sortWithinPartitions(key) if key else rows.repartition(files)
    whole = dealt.mapInArrow(stage, ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema.fields))
    return whole.withColumn("tile", F.monotonically_increasing_id())


def paired(one: DataFrame, other: DataFrame, condition: str | None = None) -> DataFrame:
    """Each row of one with each of the other, without an exchange of either."""
    met = one.hint("shuffle_replicate_nl").crossJoin(other)
    return met if condition is None else met.filter(condition)


def numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return np.asarray(batch.column(column)[row].values).astype(np.int64)


def codes(text: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Two bits a letter, by column; other letters share the last code, so equal letters have equal codes."""
    return np.ascontiguousarray(letter[text].T & 3)


def onward(code: np.ndarray) -> np.ndarray:
    """For each place the 32 letters from there on as one number (zeros behind the last one), by place; 32 * 4 more places hold zeros."""
    out = np.zeros((len(code) + 128, code.shape[1]), np.uint64)
    for c in range(len(code) - 1, -1, -1):
        out[c] = out[c + 1] >> np.uint64(2) | code[c].astype(np.uint64) << np.uint64(62)
    return out


def backward(code: np.ndarray) -> np.ndarray:
    """Of letters that are counted from the end: for each number of last letters the first 32 of them as one number."""
    out = np.zeros((len(code) + 1, code.shape[1]), np.uint64)
    for c in range(len(code)):
        out[c + 1] = out[c] >> np.uint64(2) | code[c].astype(np.uint64) << np.uint64(62)
    return out


def unlike(x: np.ndarray, y: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How many of the first letters of two words differ; all 32 count from that number on, none below 1."""
    off = x ^ y
    return np.bitwise_count((off | off >> np.uint64(1)) & FIRST[np.clip(letters, 0, 32)])


def letters_at(words, place: np.ndarray | int, letters: int) -> np.ndarray:
    """So many letters (31 at most) at a place as one number."""
    return words[place] >> np.uint64(64 - 2 * letters) if letters else words[place] * np.uint64(0)


#: Which bits of a word its first letters take, by how many there are.
FIRST = np.array([0] + [(((1 << 2 * n) - 1) << (64 - 2 * n)) & 0x5555555555555555 for n in range(1, 33)], np.uint64)


class Index:
    """Rows by their seed, in twice as many buckets as there are rows or more."""

    def __init__(self, seeds: np.ndarray, rows: np.ndarray):
        bits = max(len(seeds), 1).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        slot = self.slot(seeds)
        order = np.argsort(slot, kind="stable")
        self.rows, self.seeds = rows[order].astype(np.int32), seeds[order]
        self.first = np.searchsorted(slot[order], np.arange((1 << bits) + 1, dtype=np.int32)).astype(np.int32)

    def slot(self, seeds: np.ndarray) -> np.ndarray:
        return ((seeds * _ODD) >> self.shift).astype(np.int32)

    def met(self, seeds: np.ndarray, some: np.ndarray | None = None):
        """(places of seeds, rows) with the same seed, about AT_ONCE at a time; some: which of the seeds count."""
        slot = self.slot(seeds)
        start = self.first[slot]
        many = self.first[1:][slot] - start
        at = np.flatnonzero(many if some is None else many * some)
        if not len(at):
            return
        start, many = start[at], many[at]
        part = np.cumsum(many, dtype=np.int64) // AT_ONCE
        for s in range(int(part[-1]) + 1):
            of = slice(*np.searchsorted(part, [s, s + 1]))
            n = many[of]
            if len(n):
                ends = np.cumsum(n, dtype=np.int64)
                place, row = np.repeat(at[of], n), np.repeat(start[of] - ends + n, n) + np.arange(int(ends[-1]))
                fine = self.seeds[row] == seeds[place]
                yield place[fine], self.rows[row[fine]]
