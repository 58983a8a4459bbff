"""Spectra of k-mers over many sequences, counted within each task before anything is dealt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlaps import letters

#: A, C, G, T as 0 to 3, all else as 4.
CODE = np.full(256, 4, np.uint8)
CODE[list(b"ACGT")] = [0, 1, 2, 3]


def sampled_codes(data: np.ndarray, starts: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of every step-th k-mer of each sequence (its first one included), and which sequence each is of.

    data: letters of all sequences; starts: where each begins, and the end. K-mers with other letters than A, C, G, T are left out.
    """
    base = CODE[data]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        code = code * 4 + (base[i : i + n] & 3)
        bad |= base[i : i + n] == 4
    count = np.maximum(-(-(np.diff(starts) - k + 1) // step), 0)
    owner = np.repeat(np.arange(len(count)), count)
    place = starts[:-1][owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    ok = ~bad[place]
    return code[place[ok]], owner[ok]


def spectrum(seqs: DataFrame, k: int = 8, step: int = 4) -> DataFrame:
    """(kmer, n, n_docs): how often every step-th k-mer (k up to 10) of sequences (seq) occurs, and in how many of them.

    A task holds one count for each of the 4 ** k codes and gives a row for each that it has met, so what is
    dealt by k-mer doesn't grow with the letters.
    """
    size = 4**k

    def stage(batches):
        total, docs = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = letters(batch, "seq")
            for at in range(0, batch.num_rows, 256):
                bounds = offsets[at : at + 257]
                code, owner = sampled_codes(data[bounds[0] : bounds[-1]], bounds - bounds[0], k, step)
                total += np.bincount(code, minlength=size)
                docs += np.bincount(np.unique(owner * size + code) % size, minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met]), pa.array(docs[met])], names=["code", "n", "n_docs"])

    sums = seqs.select("seq").filter("seq IS NOT NULL").mapInArrow(stage, "code long, n long, n_docs long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return sums.select(F.translate(F.lpad(F.conv("code", 10, 4), k, "0"), "0123", "ACGT").alias("kmer"), "n", "n_docs")


def counted(seqs: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, code, n): how often each k-mer's code stands in each sequence (doc_id, seq); counted where the sequence is, so nothing is dealt.

    Sequences have k letters at least; k-mers with other letters than A, C, G, T are left out.
    """
    size = 4**k

    def stage(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = letters(batch, "seq")
            for at in range(0, batch.num_rows, 256):
                bounds = offsets[at : at + 257]
                code, owner = sampled_codes(data[bounds[0] : bounds[-1]], bounds - bounds[0], k, 1)
                both, n = np.unique(owner * size + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at + both // size)), pa.array(both % size), pa.array(n.astype(np.int64))], names=["doc_id", "code", "n"])

    return seqs.select(F.col("doc_id").cast("long"), "seq").filter("seq IS NOT NULL").mapInArrow(stage, "doc_id long, code long, n long")


def strand_counts(seqs: DataFrame, k: int = 8) -> DataFrame:
    """(id, n, n_both): the distinct k-mers of each sequence (id, seq) of k letters or more, and those of it and its reverse complement."""
    size = 4**k

    def stage(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = letters(batch, "seq")
            code, owner = sampled_codes(data[offsets[0] : offsets[-1]], offsets - offsets[0], k, 1)
            other, rest = np.zeros(len(code), np.int64), code.copy()
            for _ in range(k):
                other, rest = other * 4 + (3 - rest % 4), rest // 4
            own = np.unique(owner * size + code)
            both = np.unique(np.concatenate([own, owner * size + other]))
            n, n_both = (np.bincount(x // size, minlength=batch.num_rows).astype(np.int64) for x in (own, both))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(n_both)], names=["id", "n", "n_both"])

    return seqs.select("id", "seq").mapInArrow(stage, "id long, n long, n_both long")
