"""Fuzzy joins of sequences: exact seeds by the pigeonhole principle, then verification of the letters.

An overlap of n letters with at most d mismatches has an exact stretch among any d + 1 stretches of it, so an
equi-join on stretches finds every pair and no frequent short k-mer is ever a key by itself.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S
from ..plans.storage import released, stored
from . import tiles

#: Letters of a contig cut from a longer sequence, the shortest one, and the letters of an end.
WIDTH, LEAST, END = 120, 40, 40


#: Two bits of each letter, 255 for others.
_LETTER = np.full(256, 255, np.uint8)
_LETTER[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def contigs(seqs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(id, doc_id, seq): the whole sequence of each row as consecutive contigs of `width` letters.

    A rest of under `least` letters stays with the contig before it, so every letter is in exactly one contig. Ids
    are doc_id * 2**32 + number of the contig, so doc_id must be below 2**31.
    """
    n = F.length("seq")
    count = F.greatest(F.floor((n + (width - least)) / width), F.lit(1)).cast("long")
    rows = seqs.select("doc_id", "seq", count.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k"))
    size = F.when(F.col("k") == F.col("n") - 1, F.length("seq") - F.col("k") * width).otherwise(F.lit(width)).cast("int")
    return rows.select((F.col("doc_id") * (1 << 32) + F.col("k")).alias("id"), "doc_id", F.substring("seq", (F.col("k") * width + 1).cast("int"), size).alias("seq"))


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """(id, seq, copies): one row for each sequence, under its smallest id; copies are linked by that alone."""
    return rows.groupBy("seq").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "seq", "copies")


def letters(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value starts."""
    values = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def packed(seqs: DataFrame) -> DataFrame:
    """Rows with their column seq as `letters`: two bits each behind a byte that tells how many the last byte has (4: none; bytes as they are, for other letters)."""
    fields = [f for f in seqs.schema.fields if f.name != "seq"]

    def stage(batches):
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                data, starts = letters(batch, "seq")
                data, starts = data[starts[0] : starts[-1]], starts - starts[0]
                n, code = np.diff(starts), _LETTER[data]
                row = np.repeat(np.arange(len(n)), n)
                other = np.bincount(row[code == 255], minlength=len(n)) > 0
                size = 1 + np.where(other, n, (n + 3) // 4)
                ends = np.cumsum(size)
                first, place = ends - size, np.arange(len(data)) - np.repeat(starts[:-1], n)
                out = np.zeros(int(ends[-1]), np.uint8)
                out[first] = np.where(other, 4, n % 4)
                for i in range(4):
                    at = np.flatnonzero((place % 4 == i) & ~other[row])
                    out[first[row[at]] + 1 + place[at] // 4] |= code[at] << (2 * i)
                at = np.flatnonzero(other[row])
                out[first[row[at]] + 1 + place[at]] = data[at]
                found = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), found], names=[*(f.name for f in fields), "letters"])

    return seqs.mapInArrow(stage, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "letters binary"]))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of packed values as rows of bytes, zeros behind each, and how many there are."""
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)
    tag, size = data[offsets[:-1]], np.diff(offsets) - 1
    n = np.where(tag == 4, size, size * 4 - (-tag.astype(np.int64)) % 4)
    wide = max(int(size.max()), 1)
    at = np.minimum(offsets[:-1, None] + 1 + np.arange(wide), len(data) - 1)
    part = np.where(np.arange(wide) < size[:, None], data[at], 0)
    text = np.frombuffer(b"ACGT", np.uint8)[np.stack([part >> i & 3 for i in (0, 2, 4, 6)], axis=2).reshape(len(n), -1)]
    raw = np.flatnonzero(tag == 4)
    text[raw, :wide] = part[raw]
    return np.where(np.arange(text.shape[1]) < n[:, None], text, np.uint8(0))[:, : max(int(n.max()), 1)], n


def compared(rows: DataFrame) -> DataFrame:
    """rows (sa, ia, sb, ib, n, ..) without these and with dist: mismatches of the n letters from sa[ia] and sb[ib] (from 0)."""
    fields = [f for f in rows.schema.fields if f.name not in ("sa", "ia", "sb", "ib", "n")]

    def stage(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, starts_a), (b, starts_b) = letters(batch, "sa"), letters(batch, "sb")
            ia, ib, n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("ia", "ib", "n"))
            ends = np.cumsum(n)
            step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            wrong = a[np.repeat(starts_a[:-1] + ia, n) + step] != b[np.repeat(starts_b[:-1] + ib, n) + step]
            total = np.concatenate([[0], np.cumsum(wrong)])
            dist = total[ends] - total[ends - n]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(dist, pa.int64())], names=[*(f.name for f in fields), "dist"])

    return rows.mapInArrow(stage, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", dist long")


def with_sequences(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """pairs (a, b, ..) with both sequences as sa and sb."""
    a = seqs.select(F.col("id").alias("a"), F.col("seq").alias("sa"))
    b = seqs.select(F.col("id").alias("b"), F.col("seq").alias("sb"))
    return pairs.join(a, "a").join(b, "b")


def hamming_pairs(seqs: DataFrame, share: float = 0.05) -> DataFrame:
    """(a, b, dist): pairs a < b of different sequences (id, seq) of one length within the distance limit.

    Each of d + 1 stretches is dealt with the packed letters, which are compared where a stretch meets, tile by tile,
    first by 32 letters alone; a pair is told at the first stretch that both have. What meets is never dealt.
    """

    def dealing(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text, n = unpacked(batch.column("letters"))
            parts = np.floor(n * share + 0.5).astype(np.int64) + 1
            for many, size in {(int(m), int(x)) for m, x in zip(parts, n, strict=True)}:
                row = np.flatnonzero((parts == many) & (n == size))
                for k in range(many):
                    seed = np.full(len(row), size * 1000003 + k, np.uint64)
                    for letter in text[row, k * (size // many) : size if k == many - 1 else (k + 1) * (size // many)].T:
                        seed = (seed ^ letter) * np.uint64(0x9E3779B97F4A7C15)
                        seed ^= seed >> np.uint64(29)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(row), k)), batch.column("id").take(at), batch.column("letters").take(at)], names=["seed", "k", "id", "letters"])

    def pairs(one, other, same):
        """(a, b, dist) of two lists of one stretch, or of one list with itself."""
        for i in range(0, len(one[0]), 1024):
            for j in range(i if same else 0, len(other[0]), 1024):
                (ids, text, n, k, start), (ids_b, text_b, n_b, k_b, start_b) = (x[i : i + 1024] for x in one), (x[j : j + 1024] for x in other)
                most = np.floor(n * share + 0.5).astype(np.int64)
                off = start[:, None] ^ start_b
                near = np.bitwise_count((off | off >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= most[:, None]
                x, y = np.nonzero(np.triu(near, 1) if same and i == j else near)
                for s in range(0, len(x), 4096):
                    p, q = x[s : s + 4096], y[s : s + 4096]
                    fine = (n[p] == n_b[q]) & (k[p] == k_b[q]) & (ids[p] != ids_b[q])
                    p, q = p[fine], q[fine]
                    wide = min(text.shape[1], text_b.shape[1])
                    total = np.cumsum(text[p, :wide] != text_b[q, :wide], axis=1)
                    total = np.c_[np.zeros(len(p), np.int64), total]
                    each = np.arange(len(p))
                    fine = total[:, -1] <= most[p]
                    parts, size = most[p] + 1, n[p] // (most[p] + 1)
                    for m in range(int(k[p].max()) + 1 if len(p) else 0):  # the first stretch that is equal is this one
                        end = np.where(m == parts - 1, n[p], (m + 1) * size)
                        equal = total[each, np.minimum(end, wide)] == total[each, np.minimum(m * size, wide)]
                        fine &= np.where(m < k[p], ~equal, (m > k[p]) | equal)
                    a, b = ids[p[fine]], ids_b[q[fine]]
                    yield np.minimum(a, b), np.maximum(a, b), total[fine, -1]

    def meeting(batches):
        held, lists, out, many = None, [], [], 0
        names = ["a", "b", "dist"]
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = np.asarray(batch.column("seed"))
            text, n = unpacked(batch.column("letters"))
            code = np.where(_LETTER[text[:, :32]] == 255, 0, _LETTER[text[:, :32]]).astype(np.uint64)
            start = (code << np.uint64(2) * np.arange(code.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            own = np.asarray(batch.column("id")).astype(np.int64), text, n, np.asarray(batch.column("k")).astype(np.int64), start
            new = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])
            ends = np.r_[new[1:], len(seeds)]
            for first, end in zip(new, ends, strict=True):
                if seeds[first] != held:
                    held, lists = seeds[first], []
                elif not lists:
                    continue
                if end - first == 1 and not lists and end < len(seeds):
                    continue  # alone in its list
                part = tuple(x[first:end] for x in own)
                for found in (f for x in [*lists, part] for f in pairs(x, part, x is part)):
                    out.append(found)
                    many += len(found[0])
                if end == len(seeds) or lists:
                    lists.append(tuple(x.copy() for x in part))
                if many > 20000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=names)
                    out, many = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=names)

    dealt = packed(seqs.select("id", "seq")).mapInArrow(dealing, "seed long, k long, id long, letters binary")
    return dealt.repartition("seed").sortWithinPartitions("seed").mapInArrow(meeting, "a long, b long, dist long")


def words(text: np.ndarray, n: np.ndarray, k: int, none: int) -> np.ndarray:
    """The k-mers of rows of letters (n of them count) as numbers, each at its first place, `none` elsewhere; a shorter row is its own single one.

    Up to 8 letters are the number itself, with two bits each if they are A, C, G, T; longer ones a hash of 64 bits.
    """
    wide = max(text.shape[1] - k + 1, 1)
    out, code, other = np.zeros((len(text), wide), np.uint64), np.zeros((len(text), wide), np.uint64), np.zeros((len(text), wide), bool)
    for i in range(min(k, text.shape[1])):
        part = text[:, i : i + wide]
        out = (out << np.uint64(8) | part) if k <= 8 else out * np.uint64(0x9E3779B97F4A7C15) + part
        code, other = code << np.uint64(2) | (_LETTER[part] & 3), other | (_LETTER[part] == 255)
    if k <= 8:
        out = np.where(other, out | (out > 0) * np.uint64(1 << 63), code | np.uint64(1 << 2 * k))
    out[np.arange(wide) > np.maximum(n - k, 0)[:, None]] = 0
    order = np.argsort(out, axis=1, kind="stable")
    ranked = np.take_along_axis(out, order, 1)
    again = np.zeros(out.shape, bool)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    out[again | (out == 0)] = none
    return out


def _slot(word: np.ndarray, bits: int) -> np.ndarray:
    return ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


#: Bits of the slots in which k-mers are counted, and rows of a k-mer's list that one task takes as tails.
SLOTS, LIST = 16, 1 << 14


def end_candidates(seqs: DataFrame, least: int, end: int = END, k: int = 8) -> DataFrame:
    """(a, b, shared): the last `end` letters of a and the first of b have `least` distinct k-mers or more in common.

    Only the rarest k-mers of an end, of which a pair must share one, are dealt, each with the letters of its end
    (two bits each). So whole ends are compared where they meet, first by sketches of 128 bits, and a pair is told
    at the rarest k-mer that both have among theirs: what meets is never dealt. Memory is bounded by tiles; the
    comparisons grow with the lists of the rarest k-mers.
    """
    spark, ends = seqs.sparkSession, seqs.select("id", F.expr(f"right(seq, {end})").alias("tail"), F.expr(f"left(seq, {end})").alias("head"))
    last = np.uint32(0xFFFFFFFF)

    def matrix(batch, column):
        data, starts = letters(batch, column)
        n = np.diff(starts)
        text = np.zeros((len(n), end), np.uint8)
        text[np.arange(end) < n[:, None]] = data[starts[0] : starts[-1]]
        return text, n

    def counting(batches):
        total = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for column in ("tail", "head"):
                found = words(*matrix(batch, column), k, 0)
                total += np.bincount(_slot(found[found > 0], SLOTS), minlength=1 << SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    with released(spark):
        table = ends.mapInArrow(counting, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOTS, np.uint32)
    counts[np.asarray(table.column("slot"))] = np.minimum(np.asarray(table.column("n")), int(last) - 1)
    counts = spark.sparkContext.broadcast(counts)

    def ranked(text, n, none):
        """The k-mers of each row, the rarest first, how many there are and how many of these are dealt."""
        found = words(text, n, k, none)
        much = np.where(found > 1, counts.value[_slot(found, SLOTS)], last)
        found = np.take_along_axis(found, np.lexsort((found, much), axis=-1), 1)
        size = (found > 1).sum(axis=1)
        return found, size, np.where(size >= least, size - least + 1, 0)

    def dealing(batches):
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                ids = np.asarray(batch.column("id")).astype(np.int64)
                for side, column in enumerate(("tail", "head")):
                    text, n = matrix(batch, column)
                    found, _, rare = ranked(text, n, side)
                    code = _LETTER[text]
                    plain = ((code < 4) | (np.arange(end) >= n[:, None])).all(axis=1)
                    code = np.pad(np.where(code < 4, code, 0), ((0, 0), (0, -end % 4))).reshape(len(n), -1, 4)
                    packed = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
                    row, place = np.nonzero(np.arange(found.shape[1]) < rare[:, None])
                    seed = found[row, place]
                    # task: its number, the side, the letters; a long list is dealt to several tasks: its tails by id, its heads to each of them
                    tasks = counts.value[_slot(seed, SLOTS)].astype(np.int64) // LIST + 1
                    if side == 0:
                        task = ids[row] % tasks
                    else:
                        row, seed = np.repeat(row, tasks), np.repeat(seed, tasks)
                        task = np.arange(len(row)) - np.repeat(np.cumsum(tasks) - tasks, tasks)
                    wide = packed.shape[1]
                    data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed[row]))])
                    raw = batch.column(column).take(pa.array(row)).cast(pa.string())
                    raw = pc.if_else(pa.array(plain[row]), pa.scalar(None, pa.string()), raw)
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(task << 33 | side << 32 | n[row]), pa.array(ids[row]), data, raw], names=["seed", "task", "id", "packed", "raw"])

    def side_of(batch, rows, side):
        """Ids, k-mers by rank, how many are dealt, sketches, and how many bits two sketches must have in common."""
        batch = batch.take(pa.array(rows))
        n = np.asarray(batch.column("task")).astype(np.int64) & 0xFFFFFFFF
        wide = (end + 3) // 4
        data = np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.uint8).reshape(-1, wide)
        text = np.frombuffer(b"ACGT", np.uint8)[np.stack([data >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(n), -1)[:, :end]]
        text = np.where(np.arange(end) < n[:, None], text, np.uint8(0))
        for i in np.flatnonzero(np.asarray(batch.column("raw").is_valid())):
            text[i, : n[i]] = np.frombuffer(batch.column("raw")[i].as_py().encode(), np.uint8)
        found, size, rare = ranked(text, n, side)
        sketch = np.zeros((len(n), 2), np.uint64)
        for column in found.T:
            at, fine = _slot(column ^ np.uint64(0x5BD1E995), 7), column > 1
            sketch[np.flatnonzero(fine), at[fine] >> 6] |= np.uint64(1) << (at[fine] & 63).astype(np.uint64)
        lost = size - np.bitwise_count(sketch).sum(axis=1)
        return np.asarray(batch.column("id")).astype(np.int64), found, rare, sketch, np.maximum(least - lost, 0).astype(np.uint8)

    def pairs(tails, heads, seed):
        """(a, b, shared) of tails and heads that met at a seed, which is the first that both deal."""
        for i in range(0, len(tails[0]), 1024):
            for j in range(0, len(heads[0]), 1024):
                (a, ka, ra, sa, na), (b, kb, rb, sb, nb) = (x[i : i + 1024] for x in tails), (x[j : j + 1024] for x in heads)
                common = np.bitwise_count(sa[:, None, 0] & sb[:, 0]) + np.bitwise_count(sa[:, None, 1] & sb[:, 1])
                x, y = np.nonzero((common >= na[:, None]) & (common >= nb) & (a[:, None] != b))
                for s in range(0, len(x), 4096):
                    p, q = x[s : s + 4096], y[s : s + 4096]
                    same = ka[p][:, :, None] == kb[q][:, None, :]
                    dealt = same.any(axis=2) & (np.arange(ka.shape[1]) < ra[p][:, None])
                    fine = np.flatnonzero(ka[p, dealt.argmax(axis=1)] == seed)
                    shared = same[fine].sum(axis=(1, 2))
                    fine, shared = fine[shared >= least], shared[shared >= least]
                    yield a[p[fine]], b[q[fine]], shared

    def meeting(batches):
        held, tails, out, many = None, [], [], 0
        for batch in batches:
            seeds, tasks = (np.asarray(batch.column(c)).astype(np.int64) for c in ("seed", "task"))
            tasks, sides = tasks >> 33, tasks >> 32 & 1
            kept = {s: side_of(batch, np.flatnonzero(sides == s), s) for s in (0, 1) if (sides == s).any()}
            within = np.where(sides == 0, np.cumsum(sides == 0), np.cumsum(sides == 1)) - 1
            new = np.flatnonzero(np.r_[True, (np.diff(seeds) != 0) | (np.diff(tasks) != 0) | (np.diff(sides) != 0)]) if len(seeds) else []
            for first, end_ in zip(new, [*new[1:], len(seeds)], strict=True):
                now, side = (seeds[first], tasks[first]), sides[first]
                held, tails = now, tails if now == held else []
                part = tuple(x[within[first] : within[end_ - 1] + 1] for x in kept[side])
                if side == 0:
                    tails.append(part)
                    continue
                for found in (f for t in tails for f in pairs(t, part, seeds[first : first + 1].view(np.uint64)[0])):
                    out.append(found)
                    many += len(found[0])
                    if many > 20000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["a", "b", "shared"])
                        out, many = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["a", "b", "shared"])

    dealt = ends.mapInArrow(dealing, "seed long, task long, id long, packed binary, raw string")
    return dealt.repartition("seed", F.shiftright("task", 33)).sortWithinPartitions("seed", "task").mapInArrow(meeting, "a long, b long, shared long")


def whole_candidates(seqs: DataFrame, step: int = 4, share: float = 0.05, least: float = 2, common: int = 3) -> DataFrame:
    """(a, b, shared): which sequences b may hold the sequence a (id, seq), of those that are longer, or as long with a smaller id.

    shared counts every step-th 8-mer of a, repeats included, that stands in b or its reverse complement; pairs with
    fewer than `count_limit` of them are left out. A pair of so many has `common` of them (or all that it needs)
    among a's rarest, however many a list of b has: those alone are joined and summed, then whole sequences are
    compared. No list is cut off, so work grows with the lists of a's rarest 8-mers.
    """
    rows = seqs.select("id", "seq", F.length("seq").alias("len"), S.count_limit(F.length("seq"), step, share, least).alias("need"))
    rows = rows.withColumns({"picked": F.filter(S.kmers(F.col("seq")), lambda _, i: i % step == 0), "held": F.array_union(S.kmers(F.col("seq")), S.kmers(S.reverse_complement(F.col("seq"))))}).drop("seq")
    rows = stored(rows.filter("len >= 8"), "picked")
    lists = rows.select(F.col("id").alias("b"), F.col("len").alias("blen"), F.explode("held").alias("kmer"))
    probes = rows.select(F.col("id").alias("a"), "len", "need", F.explode("picked").alias("kmer")).groupBy("a", "len", "need", "kmer").agg(F.count("*").alias("m"))
    enough = F.least("need", F.lit(common))
    # what a pair may have in common behind each of a's 8-mers, the rarest of them first
    behind = F.sum("m").over(Window.partitionBy("a").orderBy(F.desc("df"), F.desc("kmer")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rare = probes.join(lists.groupBy("kmer").agg(F.count("*").alias("df")), "kmer").withColumn("behind", behind).filter(F.col("behind") > F.col("need") - enough)
    met = rare.join(lists, "kmer").filter("blen > len OR (blen = len AND b < a)").groupBy("a", "b").agg(F.sum("m").alias("m"), F.first(enough).alias("enough")).filter("m >= enough")
    pairs = met.select("a", "b").join(rows.select(F.col("id").alias("a"), "picked", "need"), "a").join(rows.select(F.col("id").alias("b"), "held"), "b")
    both = pairs.select("a", "b", "need", "picked", F.array_intersect("picked", "held").alias("both"))
    return both.select("a", "b", F.size(F.filter("picked", lambda x: F.array_contains("both", x))).cast("long").alias("shared"), "need").filter("shared >= need").drop("need")


def limit_steps(shortest: int, longest: int, share: float) -> list[tuple[int, int, int]]:
    """(first length, last length, mismatches allowed) of overlap lengths, by the number allowed."""
    out: list[tuple[int, int, int]] = []
    for n in range(shortest, longest + 1):
        d = int(n * share + 0.5)
        out = [*out[:-1], (out[-1][0], n, d)] if out and out[-1][2] == d else [*out, (n, n, d)]
    return out


#: Letters that the exact stretches of a seed have together, if the overlap is long enough for it.
SELECTIVE = 14


def stretches(low: int, d: int) -> tuple[int, int, int]:
    """(letters of a stretch, stretches, how many of them a seed has) for overlaps of `low` letters or more with d mismatches: the fewest that make a seed of SELECTIVE letters, three at most."""
    fitting = [(low // (d + exact), d + exact, exact) for exact in (1, 2, 3) if exact == 1 or low >= d + exact]
    return next((x for x in fitting if x[0] * x[2] >= SELECTIVE), fitting[-1])


#: Letters of the stretches that most lengths of an overlap share.
GRID = 12


def on_grid(n: int, share: float) -> int:
    """How many stretches of GRID letters from the start of an overlap of n letters on hold one without a mismatch; 0: they don't fit."""
    parts = int(n * share + 0.5) + 1
    return parts if parts * GRID <= n else 0


def tail_head(tails: DataFrame, heads: DataFrame, shortest: int, longest: int, share: float) -> DataFrame:
    """(a, turn_a, b, turn_b, depth, dist): the least overlap of a tail (id, turn, seq) with a head of another id within the distance limit.

    With d mismatches one of d + 1 stretches of the head is exact. Where those of GRID letters fit, one index of
    them serves all lengths, and a tail looks up each of its places once. For the lengths that are left the first
    letters are cut into d + 1 to d + 3 stretches, all but d of them are a seed, and each length is looked up.
    Blocks of heads are indexed and blocks of tails look up (`tiles`), so places are dealt neither before they
    meet nor after it, and a pair is settled in one task. Two turned sequences are left aside, as they overlap
    like the same two as they are.
    """
    share_of = np.array([on_grid(n, share) if n >= shortest else 0 for n in range(longest + 1)])
    limits = np.floor(np.arange(longest + 1) * share + 0.5).astype(np.int64)
    parts, held_at_most = int(share_of.max()), tiles.HELD
    # by letters from a place of the tail to its end and by stretch: whether that length has this stretch
    length = np.arange(longest + 1)[:, None] + np.arange(parts) * GRID
    usable = (length <= longest) & (np.arange(parts) < share_of[np.minimum(length, longest)])
    steps = []
    for low, high, d in limit_steps(shortest, longest, share):
        rest = [n for n in range(low, high + 1) if not share_of[n]]
        if rest:
            size, many, exact = stretches(low, d)
            steps.append((rest, min(size, 31 // exact), [tuple(i * size for i in c) for c in itertools.combinations(range(many), exact)]))

    def code_of(words, place, step, offs, size):
        """The letters of a choice of stretches as one number."""
        code = np.uint64(0)
        for i in offs:
            code = code << np.uint64(2 * size) | tiles.letters_at(words, place + step * i, size)
        return code

    def heads_of(batch, row):
        text, n = unpacked(batch.column("lb")[row].values)
        at = tiles.onward(tiles.codes(text, _LETTER))
        seeds, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k in range(parts):
            rows.append(np.flatnonzero(n >= (k + 1) * GRID))
            seeds.append(tiles.letters_at(at, k * GRID, GRID)[rows[-1]])
            rows[-1] = rows[-1] * parts + k
        index = {(): tiles.Index(np.concatenate(seeds), np.concatenate(rows))}
        for lengths, size, choices in steps:
            own = np.flatnonzero(n >= lengths[0])
            for offs in choices if len(own) else ():
                index[lengths[0], offs] = tiles.Index(code_of(at, 0, 1, offs, size)[own], own)
        other = ((_LETTER[text] == 255) & (text > 0)).any(axis=1)
        return tiles.numbers(batch, "b", row), n, np.ascontiguousarray(at[: text.shape[1] + 128 : 32].T), index, text, other

    def tails_of(batch, row):
        text, n = unpacked(batch.column("la")[row].values)
        other = ((_LETTER[text] == 255) & (text > 0)).any(axis=1)
        return tiles.numbers(batch, "a", row), n, tiles.backward(tiles.codes(text, _LETTER)), text, other

    def least(head, tail, first, last):
        """Rows of tail and head, depth and dist of the least overlap of each pair that has one; None: too many to hold."""
        (b, nb, wb, index, text_b, other_b), (a, na, wa, text_a, other_a) = head, tail
        a, na, wa, found = a[first:last], na[first:last], wa[:, first:last], []

        def kept(t, h, n):
            """Those of places t, h with overlaps of n letters that are within the limit."""
            fine = np.flatnonzero((n <= na[t]) & (n <= nb[h]))
            t, h, n = t[fine], h[fine], n[fine]
            wrong = np.zeros(len(t), np.int64)
            for k in range(0, int(n.max(initial=0)), 32):
                wrong += tiles.unlike(wa[np.maximum(n - k, 0), t], wb[h, np.minimum(k // 32, wb.shape[1] - 1)], n - k)
                fine = np.flatnonzero(wrong <= limits[n])
                t, h, n, wrong = t[fine], h[fine], n[fine], wrong[fine]
            fine = a[t] != b[h]
            found.append((t[fine] + first, h[fine], n[fine], wrong[fine]))
            return len(t)

        many = 0
        for q in range(GRID, len(wa)) if parts else ():
            if usable[q].any():
                for t, h in index[()].met(tiles.letters_at(wa, q, GRID), na >= q):
                    fine = np.flatnonzero(usable[q][h % parts])
                    t, h = t[fine], h[fine]
                    many += kept(t, h // parts, length[q][h % parts])
            if many > held_at_most and last - first > 1:
                return None
        for lengths, size, choices in steps:
            for n in (n for n in lengths if n < len(wa)):
                for offs in choices:
                    if (lengths[0], offs) in index:
                        for t, h in index[lengths[0], offs].met(code_of(wa, n, -1, offs, size), na >= n):
                            many += kept(t, h, np.full(len(t), n))
                if many > held_at_most and last - first > 1:
                    return None
        if not many:
            return ()
        t, h, n, wrong = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        if other_a.any() or other_b.any():  # their codes may be equal where they differ
            odd = np.flatnonzero(other_a[t] | other_b[h])
            for s in range(0, len(odd), 4096):
                rows = odd[s : s + 4096]
                place = np.arange(min(text_a.shape[1], text_b.shape[1]))
                own = np.take_along_axis(text_a[t[rows]], np.maximum(n[rows, None] - 1 - place, 0), 1)
                wrong[rows] = ((own != text_b[h[rows]][:, : len(place)]) & (place < n[rows, None])).sum(axis=1)
            fine = wrong <= limits[n]
            t, h, n, wrong = t[fine], h[fine], n[fine], wrong[fine]
        order = np.argsort((t * len(b) + h) * (longest + 1) + n)
        t, h, n, wrong = t[order], h[order], n[order], wrong[order]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else order
        return t[new], h[new], n[new], wrong[new]

    def stage(batches):
        held, head = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                tile = batch.column("tile")[row].as_py()
                if tile != held:
                    held, head = tile, heads_of(batch, row)
                tail = tails_of(batch, row)
                turn_a, turn_b = (batch.column(c)[row].as_py() for c in ("turn_a", "turn_b"))
                todo = [(0, len(tail[0]))]
                while todo:
                    first, last = todo.pop()
                    found = least(head, tail, first, last)
                    if found is None:
                        todo += [(first, (first + last) // 2), ((first + last) // 2, last)]
                        continue
                    for s in range(0, len(found[0]) if found else 0, 1 << 16):
                        t, h, n, wrong = (x[s : s + (1 << 16)] for x in found)
                        turns = (pa.array(np.full(len(t), x, np.int32)) for x in (turn_a, turn_b))
                        yield pa.RecordBatch.from_arrays([pa.array(tail[0][t]), next(turns), pa.array(head[0][h]), next(turns), pa.array(n), pa.array(wrong)], names=["a", "turn_a", "b", "turn_b", "depth", "dist"])

    def blocks(rows, x, text):
        """The blocks of sequences as they are and of turned ones."""
        way = lambda turn: stored(tiles.blocks(packed(rows.filter(F.col("turn") == turn).select(F.col("id").alias(x), text.alias("seq"))).withColumnRenamed("letters", f"l{x}")), "blocks").withColumn(f"turn_{x}", F.lit(turn))
        return way(0).unionByName(way(1))

    long = F.length("seq") >= shortest
    one = blocks(heads.filter(long), "b", F.expr(f"left(seq, {longest})"))
    other = blocks(tails.filter(long), "a", F.reverse(F.expr(f"right(seq, {longest})"))).drop("tile")
    return tiles.paired(one, other, "turn_a + turn_b < 2").mapInArrow(stage, "a long, turn_a int, b long, turn_b int, depth long, dist long")


def dovetails(seqs: DataFrame, shortest: int = 24, longest: int = 119, share: float = 0.05, both_strands: bool = True) -> DataFrame:
    """(a, b, mode, depth, dist): the least overlap of each ordered pair of sequences (id, seq) in each mode.

    Modes, by what b is to a: 2: a's tail on b's head; 1: a's head on b's tail; with b's reverse complement
    -1: a's head on its tail, -2: a's tail on its head.
    """
    rows = seqs.select("id", F.lit(0).alias("turn"), "seq")
    if both_strands:
        rows = rows.unionByName(seqs.select("id", F.lit(1).alias("turn"), S.reverse_complement(F.col("seq")).alias("seq")))
    found = tail_head(rows, rows, shortest, longest, share)
    # an overlap of two sequences as they are is one of either with the other
    mode = lambda a, b, m: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(m).alias("mode"))
    modes = F.when(F.col("turn_b") == 1, F.array(mode("a", "b", -2))).when(F.col("turn_a") == 1, F.array(mode("b", "a", -1))).otherwise(F.array(mode("a", "b", 2), mode("b", "a", 1)))
    return found.select(F.explode(modes).alias("m"), "depth", "dist").select("m.*", "depth", "dist")


def least_overlaps(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, shortest: int, longest: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(depth, dist) of the least overlap of each row's tail in x with its head in y within the distance limit; depth 0: none."""
    top = np.minimum(np.minimum(nx, ny), longest)
    limits = np.floor(np.arange(longest + 1) * share + 0.5).astype(np.int64)
    depth, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not len(x) or int(top.max()) < shortest:
        return depth, dist
    # places of x, by their distance from its end; the first letters alone rule most of them out
    lengths, some = np.arange(int(top.max()), shortest - 1, -1), min(16, shortest)
    ends = np.zeros((len(x), int(top.max())), np.uint8)
    at = nx[:, None] - ends.shape[1] + np.arange(ends.shape[1])
    ends = np.where(at >= 0, np.take_along_axis(x, np.clip(at, 0, x.shape[1] - 1), 1), np.uint8(0))
    wrong = np.zeros((len(x), len(lengths)), np.uint8)
    for i in range(some):
        wrong += ends[:, i : i + len(lengths)] != y[:, i, None] if i < y.shape[1] else np.uint8(1)
    row, place = np.nonzero((wrong <= limits[lengths]) & (lengths <= top[:, None]))
    n = lengths[place]
    wide = np.arange(min(ends.shape[1], y.shape[1]))
    for s in range(0, len(row), 4096):
        r, m = row[s : s + 4096], n[s : s + 4096]
        own = np.take_along_axis(ends[r], np.clip(ends.shape[1] - m[:, None] + wide, 0, ends.shape[1] - 1), 1)
        bad = ((own != y[r][:, : len(wide)]) & (wide < m[:, None])).sum(axis=1)
        fine = bad <= limits[m]
        depth[r[fine]], dist[r[fine]] = m[fine], bad[fine]  # the shortest of a row comes last
    return depth, dist


def end_overlaps(pairs: DataFrame, seqs: DataFrame, shortest: int, longest: int, share: float, both_strands: bool = True) -> DataFrame:
    """(a, b, pos, dep, dist): the end overlap of each pair (a, b), by the rules of `functions.sequence.prefix_suffix`, over whole Arrow batches; letters are dealt packed."""
    turn = np.zeros(256, np.uint8)
    turn[:] = np.arange(256)
    turn[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)

    def stage(batches):
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                (x, nx), (y, ny) = unpacked(batch.column("la")), unpacked(batch.column("lb"))
                back = np.take_along_axis(turn[y], np.clip(ny[:, None] - 1 - np.arange(y.shape[1]), 0, None), 1)
                found = np.zeros((4, len(x)), np.int64)  # pos, dep, dist, and 1 where pos is not 0
                known = np.zeros(len(x), bool)
                for other, sign in ((y, 1), (back, -1))[: 2 if both_strands else 1]:
                    for head in (True, False):
                        depth, dist = least_overlaps(other, ny, x, nx, shortest, longest, share) if head else least_overlaps(x, nx, other, ny, shortest, longest, share)
                        # an overlap of all of b yields to any later one
                        take = (depth > 0) & (found[3] == 0)
                        pos = sign * (ny - depth)
                        found[:, take] = np.stack([pos, depth if head else -depth, dist, pos != 0])[:, take]
                        known |= depth > 0
                at = np.flatnonzero(known)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in "ab"), *(pa.array(found[i, at]) for i in range(3))], names=["a", "b", "pos", "dep", "dist"])

    rows = packed(seqs.select("id", "seq"))
    side = lambda x: rows.select(F.col("id").alias(x), F.col("letters").alias(f"l{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(stage, "a long, b long, pos long, dep long, dist long")


def contained(short: DataFrame, long: DataFrame, share: float = 0.05, both_strands: bool = True, seed: int = 12) -> DataFrame:
    """(probe_id, id, pos, dist): where each short sequence (id, seq) stands in a longer one within the distance limit.

    pos is the leftmost place (from 1); negative if the short one's reverse complement stands there, which
    counts only where the short one itself does not. Short sequences must have `seed` letters for each stretch.
    """
    n, parts = F.length("seq"), S.distance_limit(F.length("seq"), share) + 1
    key = lambda at: F.xxhash64(F.col("seq").substr(at + 1, F.lit(seed)))
    probes = short.select("id", "seq", F.lit(1).alias("sign"))
    if both_strands:
        probes = probes.unionByName(short.select("id", S.reverse_complement(F.col("seq")).alias("seq"), F.lit(-1).alias("sign")))
    keys = probes.withColumn("pb", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: (k * F.floor(n / parts)).cast("int"))))
    # dealt without letters: those of the places that meet are joined afterwards
    keys = keys.select(F.col("id").alias("probe_id"), "sign", n.alias("nb"), "pb", key(F.col("pb")).alias("key"))
    rows = long.withColumn("pa", F.explode(F.sequence(F.lit(0), n - seed))).select("id", n.alias("na"), "pa", key(F.col("pa")).alias("key"))
    at = F.col("pa") - F.col("pb")
    hits = rows.join(keys, "key").filter((F.col("id") != F.col("probe_id")) & (F.col("na") > F.col("nb")) & (at >= 0) & (at + F.col("nb") <= F.col("na"))).select("probe_id", "sign", "id", at.alias("ia")).distinct()
    hits = hits.join(long.select("id", F.col("seq").alias("sa")), "id").join(short.select(F.col("id").alias("probe_id"), F.col("seq").alias("own")), "probe_id")
    turned = F.when(F.col("sign") < 0, S.reverse_complement(F.col("own"))).otherwise(F.col("own"))
    hits = hits.select("probe_id", "id", "sign", F.col("ia").alias("at"), "sa", "ia", turned.alias("sb"), F.lit(0).alias("ib"), F.length("own").alias("n"), F.length("own").alias("len"))
    found = compared(hits).filter(F.col("dist") <= S.distance_limit(F.col("len"), share))
    best = found.groupBy("probe_id", "id").agg(F.min(F.struct((-F.col("sign")).alias("turned"), "at", "dist")).alias("m"))
    return best.select("probe_id", "id", (-F.col("m.turned") * (F.col("m.at") + 1)).cast("long").alias("pos"), F.col("m.dist").alias("dist"))


def contained_by_blocks(short: DataFrame, long: DataFrame, share: float = 0.05, both_strands: bool = True, seed: int = 12) -> DataFrame:
    """`contained` for many sequences: blocks of short ones are indexed by their stretches and blocks of longer ones look up all their places (`tiles`), so no place is dealt.

    Blocks hold sequences of like length, and only those meet of which one has longer ones than the other's shortest.
    """
    turn = np.arange(256).astype(np.uint8)
    turn[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)
    signs, held_at_most = (1, -1) if both_strands else (1,), tiles.HELD

    def odd(text):
        return ((_LETTER[text] == 255) & (text > 0)).any(axis=1)

    def probes_of(batch, row):
        own, n = unpacked(batch.column("lp")[row].values)
        back = np.where(np.arange(own.shape[1]) < n[:, None], np.take_along_axis(turn[own], np.clip(n[:, None] - 1 - np.arange(own.shape[1]), 0, None), 1), np.uint8(0))
        text = np.concatenate([own, back][: len(signs)])
        n, ids = np.tile(n, len(signs)), np.tile(tiles.numbers(batch, "probe_id", row), len(signs))
        at = tiles.onward(tiles.codes(text, _LETTER))
        limit = np.floor(n * share + 0.5).astype(np.int64)
        many = int(limit.max()) + 1
        start = np.minimum(np.arange(many), limit[:, None]) * (n // (limit + 1))[:, None]
        rows, k = np.nonzero((np.arange(many) <= limit[:, None]) & (start + seed <= n[:, None]))
        index = tiles.Index(tiles.letters_at(at, (start[rows, k], rows), seed), rows * many + k)
        return ids, n, np.ascontiguousarray(at[: text.shape[1] + 31 : 32].T), limit, start, index, text, odd(text)

    def best(probes, ids, text, n, whole):
        """Rows of the longer ones and probes, place (from 0) and distance of each pair's first hit; None: too many to hold."""
        own, m, words, limit, start, index, text_b, odd_b = probes
        at, found, many, parts = tiles.onward(tiles.codes(text, _LETTER)), [], 0, start.shape[1]
        for p in range(text.shape[1] - seed + 1):
            for t, e in index.met(tiles.letters_at(at, p, seed), n >= p + seed):
                h = e // parts
                a = p - start[h, e % parts]
                fine = np.flatnonzero((a >= 0) & (m[h] < n[t]) & (a + m[h] <= n[t]) & (own[h] != ids[t]))
                t, h, a = t[fine], h[fine], a[fine]
                wrong = np.zeros(len(t), np.int64)
                for i in range(words.shape[1]):
                    wrong += tiles.unlike(at[np.minimum(a + 32 * i, len(at) - 1), t], words[h, i], m[h] - 32 * i)
                    fine = np.flatnonzero(wrong <= limit[h])
                    t, h, a, wrong = t[fine], h[fine], a[fine], wrong[fine]
                found.append((t, h.astype(np.int64), a, wrong))
                many += len(t)
            if many > held_at_most and not whole:
                return None
        if not many:
            return ()
        t, h, a, wrong = (np.concatenate(x) for x in zip(*found, strict=True))
        other = np.flatnonzero(odd(text)[t] | odd_b[h])
        for s in range(0, len(other), 4096):  # their codes may be equal where they differ
            r = other[s : s + 4096]
            place = np.arange(text_b.shape[1])
            x = np.take_along_axis(text[t[r]], np.minimum(a[r, None] + place, text.shape[1] - 1), 1)
            wrong[r] = ((x != text_b[h[r]]) & (place < m[h[r], None])).sum(axis=1)
        fine = wrong <= limit[h]
        t, h, a, wrong = t[fine], h[fine], a[fine], wrong[fine]
        size = len(own) // len(signs)
        order = np.lexsort((a, h // size, h % size, t))
        t, h, a, wrong = t[order], h[order], a[order], wrong[order]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] % size != h[:-1] % size)]) if len(t) else order
        return t[new], own[h[new]], np.where(h[new] < size, 1, -1) * (a[new] + 1), wrong[new]

    def stage(batches):
        held, probes = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                tile = batch.column("tile")[row].as_py()
                if tile != held:
                    held, probes = tile, probes_of(batch, row)
                ids, sizes = tiles.numbers(batch, "id", row), tiles.numbers(batch, "na", row)
                todo = [(0, len(ids))]
                while todo:
                    first, last = todo.pop()
                    middle, found = (first + last) // 2, None
                    if last - first == 1 or (last - first) * (int(sizes[first:last].max()) + 128) <= 1 << 23:
                        text, n = unpacked(batch.column("la")[row].values.slice(first, last - first))
                        found = best(probes, ids[first:last], text, n, last - first == 1)
                    if found is None:
                        todo += [(first, middle), (middle, last)]
                    elif found:
                        t, probe, pos, dist = found
                        yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(ids[first:last][t]), pa.array(pos), pa.array(dist)], names=["probe_id", "id", "pos", "dist"])

    n = F.length("seq")
    side = lambda rows, x, size, letters: stored(tiles.blocks(packed(rows.filter(n >= seed).select(F.col("id").alias(x), n.alias(size), "seq")).withColumnRenamed("letters", letters), order=(size, x)), "blocks")
    probes = side(short, "probe_id", "nb", "lp").withColumn("shortest", F.array_min("nb")).drop("nb")
    refs = side(long, "id", "na", "la").withColumn("longest", F.array_max("na")).drop("tile")
    return tiles.paired(probes, refs, "longest > shortest").mapInArrow(stage, "probe_id long, id long, pos long, dist long")


def best_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def longest_run(a: np.ndarray, b: np.ndarray, limits: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For rows of letters a and b: the place (from 0) of the last match before mismatches exceed limits[place], and the mismatches up to it.

    Without any match the run is 0 and the distance 10000. sizes: letters of a row that count.
    """
    wrong = a != b
    total = np.cumsum(wrong, axis=1)
    over = wrong & (total > limits[: a.shape[1]])
    place = np.arange(a.shape[1])
    end = np.where(over.any(axis=1), over.argmax(axis=1), a.shape[1])
    end = end if sizes is None else np.minimum(end, sizes)
    ok = ~wrong & (place < end[:, None])
    last = np.where(ok.any(axis=1), a.shape[1] - 1 - ok[:, ::-1].argmax(axis=1), -1)
    return np.maximum(last, 0), np.where(last >= 0, total[np.arange(len(a)), last], 10000)


def junction(first: bytes, second: bytes, head: bool, least: int, most: int, share: float, enough: int, both_strands: bool = True) -> tuple[int, int, int, int]:
    """(pos, depth, mode, dist) of the longest approximate run of second's head (or tail) in first; zeros and 10000 for none.

    Places wholly inside are tried first, then those that stick out over an end. Of each the first longest run
    counts, and the search ends at a run beyond `enough`. The depth is the place of the last match from 0, so a
    perfect run of seven letters has six. Modes 1 and 2: head and tail as they are; 3 and 4 on the other strand.
    A head is tried as it is first, a tail on the other strand first; with one strand alone, only a head as it
    is and a tail as it is.
    """
    size = min(most, len(first), len(second))
    if size < 1:
        return 0, 0, 0, 10000
    text = np.frombuffer(first, np.uint8)
    own = np.frombuffer(second[:size] if head else second[len(second) - size :], np.uint8)
    flipped = np.frombuffer(own.tobytes().translate(bytes.maketrans(b"ACGT", b"TGCA"))[::-1], np.uint8)
    k = np.arange(max(size, 1))
    limits = np.floor(np.where(k < least, least, k) * share + 0.5).astype(np.int64)
    # onward: read from the end of second that is searched for; backward: towards it
    onward, backward = (own, flipped) if head else (flipped, own)
    turns = [(onward, 1, 1 if head else 4)] if head or both_strands else []
    turns += [(backward, -1, 3 if head else 2)] if not head or both_strands else []
    windows = np.lib.stride_tricks.sliding_window_view(text, size)
    for inside in (True, False):
        if not inside and size < least:
            break
        for pattern, way, mode in turns:
            sizes = None
            if inside:
                a = windows[:, ::way]
            else:
                sizes = np.arange(least, size + 1)
                padded = np.zeros((len(sizes), size), np.uint8)
                for i, n in enumerate(sizes):
                    padded[i, :n] = text[len(text) - n :] if way > 0 else text[:n][::-1]
                a = padded
            run, dist = longest_run(a, np.broadcast_to(pattern[::way], a.shape), limits, sizes)
            stop = np.flatnonzero(run > enough)
            best = int(run[: stop[0] + 1 if len(stop) else len(run)].argmax())
            depth = int(run[best])
            if depth >= least:
                if way > 0:
                    pos = best + 1 if inside else len(text) - least - best + 1
                else:
                    pos = best + size - depth + 1 if inside else least - depth + best + 1
                return pos, depth, mode, int(dist[best])
    return 0, 0, 0, 10000


JUNCTION = "ref_id long, tgt_id long, side int, pos int, depth int, mode int, dist int"


def bounded(rows: DataFrame, blocks: Column, block: Column, start: Column, ref_len: Column, unshared: int, backoff: int) -> DataFrame:
    """Junctions (pos, depth, mode, ref_id, tgt_id) of a block by the boundary rules, with bnd1 and bnd2 on the whole reference.

    block: its number from 0 of `blocks`; start: its first place on the reference (from 1); unshared: letters
    of a block before the next one starts. A junction in the part that the next block has too, or at the first
    place of a later block, belongs to the other block. One that lies inside the reference is drawn back by
    `backoff` letters at its open end. One that touches an end is a connection and kept once, where the larger id is the reference.
    """
    pos, depth = F.col("pos"), F.col("depth")
    rows = rows.filter(~((block < blocks - 1) & (pos > unshared)) & ~((block > 0) & (pos == 1)))
    first, last = pos + start - 1, pos + start - 1 + depth - 1
    inner = (first > 1) & (last < ref_len)
    late = inner & F.col("mode").isin(2, 3)
    rows = rows.withColumns({"bnd1": (first + F.when(late, backoff).otherwise(0)).cast("long"), "bnd2": (last - F.when(inner & ~late, backoff).otherwise(0)).cast("long")})
    end = (F.col("bnd1") == 1) | (F.col("bnd2") == ref_len)
    return rows.filter((F.col("bnd1") < F.col("bnd2")) & (~end | (F.col("ref_id") > F.col("tgt_id"))))
