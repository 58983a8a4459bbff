"""Nucleotide sequences as Column expressions: codes, k-mers, consensus, distances, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(seq: Column) -> Column:
    """A, C, G, T (either case) as the digits 0 to 3; any other sign as N."""
    return F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "01230123")


def undefined(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[ACGTacgt]", "")).cast("long")


def decoded(digits: Column) -> Column:
    return F.translate(digits, "0123", "ACGT")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def kmers(seq: Column, k: int = 8, stretch: int = 256) -> Column:
    """All k-mers in order; a shorter sequence is its own single one.

    A substring is found by counting from the start, so long sequences are cut into stretches first. The
    sequence is bound once, as an expression within a function over stretches would be computed for each.
    """
    own = lambda part: F.transform(F.sequence(F.lit(1), F.greatest(F.length(part) - k + 1, F.lit(1))), lambda i: part.substr(i, F.lit(k)))

    def every(whole: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.length(whole) - k, F.lit(0)), F.lit(stretch))
        return F.flatten(F.transform(first, lambda at: own_of(whole.substr(at + 1, F.lit(stretch + k - 1)))))

    def own_of(part: Column) -> Column:
        return F.transform(F.array(part), own)[0]

    return F.transform(F.array(seq), every)[0]


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, the first base highest."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two sequences of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x).cast("long")


def distance_limit(length: Column, share: float) -> Column:
    return F.floor(length * F.lit(share) + F.lit(0.5)).cast("long")


def count_limit(length: Column, step: int, share: float, least: float) -> Column:
    """Least number of shared down-sampled 8-mers of a candidate, rounded half up."""
    raw = (length - (8 - step)) / step - F.ceil(length * F.lit(share)) * (8 / step)
    return F.floor(F.greatest(raw, F.lit(float(least))) + 0.5).cast("long")


def dovetail(a: Column, b: Column, shortest: int, longest: int, share: float) -> Column:
    """The least overlap length of a's tail with b's head within the distance limit, as struct(depth, dist); null if none."""
    top = F.least(F.length(a), F.length(b), F.lit(longest))
    lengths = F.when(top >= shortest, F.sequence(F.lit(shortest), top)).otherwise(F.array().cast("array<int>"))
    tried = F.transform(lengths, lambda n: F.struct(n.alias("depth"), hamming(F.right(a, n), F.left(b, n)).alias("dist")))
    return F.get(F.filter(tried, lambda x: x["dist"] <= distance_limit(x["depth"], share)), F.lit(0))


def prefix_suffix(a: Column, b: Column, shortest: int, longest: int, share: float, both_strands: bool = True) -> Column:
    """An end overlap of a and b as struct(pos, dep, dist); null if there is none.

    Tried in turn: a's head on b's tail (dep positive), a's tail on b's head (dep negative), then both with b's
    reverse complement (pos negative), each from the shortest length up. An overlap of all of b has pos 0 and
    yields to any later one; if there is none, the last of them stands.
    """
    size = F.length(b)

    def tried(other: Column, sign: int) -> list[Column]:
        head, tail = dovetail(other, a, shortest, longest, share), dovetail(a, other, shortest, longest, share)
        return [F.when(x.isNotNull(), F.struct((sign * (size - x["depth"])).alias("pos"), (way * x["depth"]).alias("dep"), x["dist"].alias("dist"))) for x, way in ((head, 1), (tail, -1))]

    found = F.filter(F.array(*tried(b, 1), *(tried(reverse_complement(b), -1) if both_strands else [])), lambda x: x.isNotNull())
    return F.coalesce(F.get(F.filter(found, lambda x: x["pos"] != 0), F.lit(0)), F.get(found, F.size(found) - 1))


def strand(ref: Column, mode: Column) -> tuple[Column, Column]:
    """(direction, strand) of a neighbour by the connection mode (1, 2; negative: reverse complement)."""
    direction = F.when(F.abs(mode) == 1, -ref).when(F.abs(mode) == 2, ref).otherwise(F.lit(0))
    return direction.cast("long"), (ref * F.signum(mode)).cast("long")


def consensus(a: Column, c: Column, g: Column, t: Column) -> Column:
    """The base of the largest count; the first of A, C, G, T among equals."""
    counts = F.array(a, c, g, t)
    return F.element_at(F.array(*map(F.lit, "ACGT")), F.array_position(counts, F.array_max(counts)).cast("int"))


def trailing_fields(name: Column, sign: str) -> Column:
    """Numeric fields of a name, the last first."""
    return F.transform(F.reverse(F.split(name, sign)), lambda x: x.try_cast("double"))
