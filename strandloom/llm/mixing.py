"""Temperature mixing of sources.

A source's target weight is its token share to the power alpha, normalised. alpha is bisected between 1 (the
natural mixture) and 0 (uniform) so that the entropy of the weights reaches a target, but never so low that a
source would be read more than max_repeats times while the budget lasts. The weights are realised as budgeted
block permutations: each pass over a source visits its blocks in a fresh keyed order; whole blocks are taken
until the source's token budget is used up, and of the block where it ends the documents that still fit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import WORD, documents, named, stored, text_column, untouched

BLOCKS, ENTROPY, MAX_REPEATS, SEED = 64, 0.95, 2.0, 71
#: The entropy that the query asks for, above that of sources that differ by a few per cent already.
EVEN = 0.99999
#: The block in which a budget ends is cut into 2 ** FINE_BITS stretches of its order.
FINE_BITS = 12


def weights(shares: np.ndarray, alpha: float) -> np.ndarray:
    w = np.where(shares > 0, np.power(np.maximum(shares, 1e-300), alpha), 0.0)
    return w / w.sum() if w.sum() else w


def entropy(w: np.ndarray) -> float:
    """In units of the entropy of the uniform mixture; 1 for a single source."""
    w = w[w > 0]
    return 1.0 if len(w) < 2 else float(-(w * np.log(w)).sum() / math.log(len(w)))


def repeats(shares: np.ndarray, alpha: float) -> float:
    """How often the scarcest source is read while the most plentiful one (for its weight) is read once."""
    own = shares > 0
    r = weights(shares, alpha)[own] / shares[own]
    return float(r.max() / r.min()) if own.any() else 1.0


def bisected(low: float, high: float, holds, steps: int = 60) -> float:
    """The largest value up to high for which holds is true, given that it is true at low and monotone."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def exponent(shares: np.ndarray, target: float = ENTROPY, most: float = MAX_REPEATS) -> float:
    """The largest exponent whose entropy meets the target, raised until no source repeats more than `most` times."""
    alpha = bisected(0.0, 1.0, lambda a: entropy(weights(shares, a)) >= target)
    return 1.0 - bisected(0.0, 1.0 - alpha, lambda t: repeats(shares, 1.0 - t) <= most * (1 + 1e-9))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_column(text), F.lit(WORD)).cast("long")


def mixed(df: DataFrame, tokens: Column, source: str = "source", target: float = ENTROPY, most: float = MAX_REPEATS, budget: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """df's rows, each as often as the mixture reads it, with pass (from 0), weight and mix_rank.

    tokens: a row's length. Sorted by mix_rank (0 to 1), every stretch holds the sources by their weights.
    budget: tokens of the mixture; by default the least that reads every source at least once, so no row is
    left out. Null sources are a source; rows without tokens are read once a pass. Equal rows are separate
    rows. An empty table gives no rows. Columns named pass, weight or mix_rank are replaced. The driver holds
    blocks x sources sums, the sources of a mixture being a bounded list.
    """
    spark = df.sparkSession
    held = [c for c in df.columns if c not in ("pass", "weight", "mix_rank")]
    # one struct: as columns under other names, a hash of all makes the optimizer's constraints double with each
    df = df.select(F.struct(*[named(c) for c in held]).alias("__row"), tokens.alias("__tokens"), F.coalesce(named(source).cast("string"), F.lit("\0null")).alias("__source"))
    df = df.withColumn("__place", F.xxhash64(F.lit(seed), "__row")).withColumn("__block", F.pmod("__place", F.lit(blocks)).cast("int"))
    sums = df.groupBy("__source", "__block").agg(F.sum("__tokens").alias("n")).toPandas().sort_values(["__source", "__block"])
    by_source = sums.groupby("__source").n.sum() if len(sums) else sums
    total = float(by_source.sum()) if len(sums) else 0.0
    plan = []
    if total:
        shares = by_source.to_numpy(float) / total
        w = weights(shares, exponent(shares, target, most))
        need = np.divide(by_source.to_numpy(float), w, out=np.zeros(len(w)), where=w > 0).max()
        budget = budget or math.ceil(need)
        for s, n, weight in zip(by_source.index, by_source.to_numpy(), w):
            plan += passes(s, int(n), float(weight), budget, sums[sums["__source"] == s], seed)
    few = len(plan) <= 100_000
    plan = spark.createDataFrame(plan, "__s string, __b int, pass int, weight double, __at long, __goal double, __part boolean")
    out = df.join(F.broadcast(plan) if few else plan, (F.col("__source") == F.col("__s")) & (F.col("__block") == F.col("__b")))
    key = F.xxhash64(F.lit(seed), "pass", "__place")
    out = out.filter(~F.col("__part")).unionByName(fitting(out.filter("__part"), key))
    spread = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    rank = (F.col("__at") + spread * F.col("__tokens")) / F.greatest(F.col("__goal"), F.lit(1.0))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in held], "pass", "weight", F.least(rank, F.lit(1.0)).alias("mix_rank"))


def fitting(part: DataFrame, key: Column) -> DataFrame:
    """Of the block where a pass ends, the rows that still fit, in the keyed order.

    The block is cut into FINE stretches of the order, whose sums tell the one where the budget ends; only that
    one's rows are sorted, whatever the size of the block.
    """
    part = stored(part.withColumn("__key", key), "part")  # read three times
    part = part.withColumn("__fine", F.shiftrightunsigned("__key", 64 - FINE_BITS).cast("int"))
    order = Window.partitionBy("__os", "__op").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(F.col("__source").alias("__os"), F.col("pass").alias("__op"), F.col("__fine").alias("__of")).agg(F.sum("__tokens").alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(order), F.lit(0)))
    part = part.join(sums, (F.col("__source") == F.col("__os")) & (F.col("pass") == F.col("__op")) & (F.col("__fine") == F.col("__of"))).drop("__os", "__op", "__of")
    room = F.col("__goal") - F.col("__at") - F.col("__before")
    within = Window.partitionBy("__source", "pass", "__fine").orderBy("__key", "__row").rowsBetween(Window.unboundedPreceding, 0)
    edge = part.filter((room >= 0) & (F.col("__sum") > room)).withColumn("__in", F.sum("__tokens").over(within)).filter(F.col("__in") <= room).drop("__in")
    return part.filter(F.col("__sum") <= room).unionByName(edge).drop("__key", "__fine", "__sum", "__before")


def passes(source: str, total: int, weight: float, budget: int, sums, seed: int) -> list[tuple]:
    """What a source's passes take: (source, block, pass, weight, tokens before, the source's budget, partly)."""
    goal, out, at, n = weight * budget, [], 0, 0
    blocks, sizes = sums["__block"].to_numpy(), sums["n"].to_numpy()
    slack = 1e-6 * max(goal, 1.0)
    while at < goal - slack and total:
        # seeded by the numbers alone, so that every run deals alike
        order = np.random.default_rng([seed, n, sum(source.encode()) % 2**31]).permutation(len(blocks))
        for b, size in zip(blocks[order], sizes[order]):
            if at >= goal - slack and size:
                break
            out.append((source, int(b), n, weight, int(at), float(goal), bool(at + size > goal + slack)))
            at += int(size)
        n += 1
    return out or [(source, int(b), 0, weight, 0, float(goal), False) for b in blocks if not total]


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at an almost even mixture of their sources, once at least and at most twice."""
    df = documents(spark, sf_dir).select("doc_id", "source", word_count().alias("n_tokens"))
    return mixed(df, F.col("n_tokens"), target=EVEN)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them; null texts and sources are kept, an empty table stays empty.

    The columns are those of the documents, so a document that is read again is a further equal row; packing
    numbers them anew and keeps them apart.
    """
    return untouched(docs, ("text", "source"), lambda df: mixed(df, word_count()))
