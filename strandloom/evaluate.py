"""Evaluation of assembled transcripts against known ones, from a table of alignment hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_hits(hits: DataFrame, least_cover: float = 0.8, least_length: int = 300) -> DataFrame:
    """Of each subject its best query, then of each query its best subject, by the covered share, then by name."""
    rows = hits.filter((F.col("qcvg") >= least_cover) & (F.col("slen") >= least_length))
    first = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("qcvg"), other))
    rows = rows.withColumn("rank", first("sseqid", "qseqid")).filter("rank = 1")
    return rows.withColumn("rank", first("qseqid", "sseqid")).filter("rank = 1").drop("rank")


def with_names(matches: DataFrame) -> DataFrame:
    """Matches with the numbers in their names, counted from the end.

    A known transcript's name ends in `:expressed share:depth:rate`, an estimate's in `_group size_depth_rate_share of
    its group`. A name with fewer than two or three numbers has none of them, and what is missing counts as 0.
    """

    def field(name: str, sign: str, i: int, least: int) -> Column:
        held = leading_numbers(F.col(name), sign)
        return F.when(F.size(held) >= least, F.coalesce(F.get(held, F.lit(i)), F.lit(0.0))).otherwise(0.0)

    known, found = (lambda i: field("qseqid", ":", i, 2)), (lambda i: field("sseqid", "_", i, 3))
    return matches.select(
        F.col("qseqid").alias("qid"), F.col("sseqid").alias("sid"), "qlen", F.col("length").alias("alen"), "slen", "qcvg", "scvg", found(2).alias("est_abn"), known(1).alias("true_abn"),
        found(1).alias("est_rpkm"), known(0).alias("true_rpkm"), found(3).alias("grp"), F.floor(found(0) + 0.5).cast("double").alias("iso"), known(2).alias("exp_cvg"),
    )


def leading_numbers(name: Column, sign: str) -> Column:
    """The numbers that a name ends in, the last first, 20 at most, up to the first field that is none."""
    fields = F.slice(F.reverse(F.slice(F.split(name, sign), 2, 1 << 30)), 1, 20)
    values = F.transform(fields, lambda x: x.try_cast("double"))
    stop = F.array_position(F.transform(values, lambda x: x.isNull()), True)
    return F.when(stop > 0, F.slice(values, F.lit(1), (stop - 1).cast("int"))).otherwise(values)


def recovered(matches: DataFrame, shares: tuple[float, ...] = (0.8, 0.9, 0.95)) -> DataFrame:
    """(share, n, r2): matches of each covered share, and the linear fit of estimated to true rates."""
    rows = matches.withColumn("share", F.explode(F.filter(F.array(*[F.lit(s) for s in shares]), lambda s: F.col("qcvg") >= s)))
    return rows.groupBy("share").agg(F.count("*").alias("n"), F.regr_r2("est_rpkm", "true_rpkm").alias("r2"))
