"""Fuzzy tails of one base at the ends of sequences, and trimming by them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import reverse_complement

#: Letters in which nearly every run ends.
NEAR = 64


def fuzzy_run(seq: Column, base: str, least: int, share: float) -> Column:
    """Letters of the run of `base` at the start of seq: longer than `least`, mismatches within ceil(length * share).

    A mismatch at the run's end is left out. A run that can't be longer than `least` is 0. A sequence of at
    most `least` letters is a run as a whole or none. Where the run has ended within the first NEAR letters, as
    nearly all have, no further ones are read.
    """
    return F.transform(F.array(seq), lambda whole: _run(whole, base, least, share))[0]


def _run(seq: Column, base: str, least: int, share: float) -> Column:
    n = F.length(seq)
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("wrong"), F.lit(False).alias("ended"), F.lit(0).alias("run"))
    allowed = lambda k: F.ceil(k * F.lit(share))

    def step(s: Column, c: Column) -> Column:
        k, miss = s["k"] + 1, (c != base).cast("int")
        wrong = s["wrong"] + miss
        over = (k >= least) & (wrong > allowed(k))
        ended = s["ended"] | over
        return F.struct(k.alias("k"), wrong.alias("wrong"), ended.alias("ended"), F.when(ended, s["run"]).when(k > least, k - miss).otherwise(s["run"]).alias("run"))

    read = lambda part: F.aggregate(F.split(part, ""), start, step)
    near = F.transform(F.array(read(F.substring(seq, 1, NEAR))), lambda s: F.when(s["ended"] | (n <= NEAR), s["run"]).otherwise(read(seq)["run"]))[0]
    short = F.when(F.length(F.translate(seq, base, "")) <= allowed(n), n).otherwise(0)
    return F.when(n == 0, 0).when(n <= least, short).otherwise(near).cast("long")


def sql_run(name: str, seq: str, base: str, least: int, share: float) -> str:
    """The same for sequences of more than `least` letters, as SQL over a table s (doc_id, seq)."""
    return f"""{name}_c AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS k, unnest(string_split({seq}, '')) AS c FROM s),
{name}_w AS (SELECT doc_id, k, (c <> '{base}')::INT AS miss, sum((c <> '{base}')::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS wrong FROM {name}_c),
{name}_e AS (SELECT doc_id, coalesce(min(k) FILTER (WHERE k >= {least} AND wrong > ceil(k * {share})), max(k) + 1) - 1 AS last FROM {name}_w GROUP BY doc_id),
{name} AS (SELECT doc_id, CAST(CASE WHEN last <= {least} THEN 0 ELSE last - miss END AS BIGINT) AS run FROM {name}_e JOIN {name}_w USING (doc_id) WHERE k = greatest(last, 1))"""


def trimmed(seq: Column, least: int, share: float, turn: bool = True, both: bool = False) -> Column:
    """seq without its poly-A tail or poly-T head but for `least` letters of it; null where nothing else is left.

    The longer run counts. A sequence with a poly-T head is of the other strand: with `turn` it is cut and
    reverse-complemented. both: where both ends have runs both are cut and nothing is turned (the later passes).
    """
    # bound once, as an expression within conditions would be computed in each of them
    ends = F.struct(seq.alias("seq"), fuzzy_run(F.reverse(seq), "A", least, share).alias("f"), fuzzy_run(seq, "T", least, share).alias("b"))
    return F.transform(F.array(ends), lambda s: _cut(s["seq"], s["f"], s["b"], least, turn, both))[0]


def _cut(seq: Column, f: Column, b: Column, least: int, turn: bool, both: bool) -> Column:
    n = F.length(seq)
    tail = F.substring(seq, F.lit(1), (n - f + least).cast("int"))
    head = seq.substr((b - least + 1).cast("int"), n)
    out = F.when((f >= n) | (b >= n), F.lit(None).cast("string"))
    if both:
        out = out.when((f > 0) & (b > 0), seq.substr((b - least + 1).cast("int"), (n - b - f + 2 * least).cast("int")))
    out = out.when((f > 0) & (f > b), tail).when(b > 0, reverse_complement(head) if turn else head)
    return out.otherwise(seq)
