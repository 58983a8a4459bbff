"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Input blocks are hash classes of the rows. How many rows of each block go to each shard follows the
multivariate hypergeometric law, so the shards get exactly their sizes and every assignment of rows to shards
is equally likely. Rows are permuted within their block by a keyed hash, dealt to shards by the matrix,
exchanged, and permuted again within the shard by a keyed Feistel permutation of the slots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import documents, feistel, named, text_column, walked

#: Rows of a block, about, and the least and largest number of blocks.
BLOCK_ROWS, FEW, MANY = 1 << 20, 64, 4096
#: Plans up to this many numbers are broadcast (8 bytes each); larger ones are joined.
SMALL_PLAN = 4_000_000


def communication_matrix(block_sizes: np.ndarray, shard_sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows of each block (row) that go to each shard (column); row and column sums are exact.

    Each row first chooses a shard for itself, which makes multinomial counts. Then every shard gives up its
    surplus, rows drawn uniformly from those it has, and all rows given up are dealt in random order to the
    shards that lack some. No step tells rows apart, so all assignments with these sums are equally likely,
    which is the hypergeometric law; and numbers of rows may go to 2**62, where draws of whole margins end at
    10**9. The surplus of a shard of n rows is about sqrt(n), the only list of rows held.
    """
    rng = np.random.default_rng(seed)
    block_sizes, shard_sizes = np.asarray(block_sizes, np.int64), np.asarray(shard_sizes, np.int64)
    out = rng.multinomial(block_sizes, shard_sizes / max(int(shard_sizes.sum()), 1)).astype(np.int64)
    over = out.sum(axis=0) - shard_sizes
    given = []
    for j in np.flatnonzero(over > 0):
        ends = np.cumsum(out[:, j])
        drawn = np.searchsorted(ends, rng.choice(int(ends[-1]), int(over[j]), replace=False), side="right")
        np.subtract.at(out[:, j], drawn, 1)
        given.append(drawn)
    if given:
        takers = np.repeat(np.arange(len(shard_sizes)), np.maximum(-over, 0))
        np.add.at(out, (np.concatenate(given), rng.permutation(takers)), 1)
    return out


def shard(df: DataFrame, n_shards: int = 40, key: list[str] | None = None, blocks: int | None = None, seed: int = 20240229) -> DataFrame:
    """df with shard (0 .. n_shards-1; row counts at most one apart) and slot (gapless from 0 in each shard).

    key: columns that identify a row; equal rows are interchangeable and share a block. Null keys are values
    like others; without a key a row is known by all its columns. Empty input gives an empty result. Columns of
    df named shard or slot are replaced. The result depends on the rows, the key and the seed, not on how Spark
    has dealt the rows. blocks: by default one for each BLOCK_ROWS rows, FEW at least and MANY at most, so the
    driver holds at most MANY x n_shards counts, whatever the number of rows; a block is sorted by one task.
    """
    spark = df.sparkSession
    held = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(F.struct(*[named(c) for c in held]).alias("__row"), *[named(c).alias(f"__k{i}") for i, c in enumerate(key or [])])
    key = [f"__k{i}" for i in range(len(key))] if key else ["__row"]
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(c) for c in key])
    # counted in MANY classes, which fold into fewer blocks by their last digits
    counts = np.zeros(MANY if blocks is None else blocks, np.int64)
    df = df.withColumn("__block", F.pmod(hashed("block"), F.lit(len(counts))).cast("int"))
    for block, n in df.groupBy("__block").count().collect():  # at most MANY (or `blocks`) rows
        counts[block] = n
    total = int(counts.sum())
    if blocks is None:
        blocks = FEW
        while blocks < MANY and blocks * BLOCK_ROWS < total:
            blocks *= 2
        df = df.withColumn("__block", F.pmod("__block", F.lit(blocks)))
    sizes = np.bincount(np.arange(len(counts)) % blocks, counts, blocks).astype(np.int64)
    shard_sizes = np.full(n_shards, total // n_shards) + (np.arange(n_shards) < total % n_shards)
    matrix = communication_matrix(sizes, shard_sizes, seed)
    before = np.cumsum(matrix, axis=0) - matrix  # rows of earlier blocks in each shard
    upto = np.cumsum(matrix, axis=1)
    plan = spark.createDataFrame([(i, upto[i].tolist(), (upto[i] - matrix[i]).tolist(), before[i].tolist()) for i in range(blocks)], "__block int, __upto array<long>, __from array<long>, __before array<long>")
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(hashed("order"), *key)).cast("long") - 1
    df = df.withColumn("__rank", rank).join(F.broadcast(plan) if 3 * matrix.size <= SMALL_PLAN else plan, "__block")
    df = df.withColumn("shard", F.size(F.filter("__upto", lambda c: c <= F.col("__rank"))).cast("int"))
    at = lambda c: F.element_at(c, F.col("shard") + 1)
    n = F.lit(total // n_shards).cast("long") + (F.col("shard") < total % n_shards).cast("long")
    df = df.withColumn("__n", n).withColumn("__slot", F.col("__rank") - at("__from") + at("__before"))
    df = df.withColumn("__side", F.ceil(F.sqrt(F.col("__n"))).cast("long"))
    prf = lambda i, half: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("shard"), i, half), 1)
    permute = lambda x: feistel(x, F.col("__side"), F.col("__side"), prf)
    df = df.withColumn("slot", walked(F.col("__slot"), F.col("__n"), permute))
    part = F.floor(F.col("slot") * 16 / F.greatest(F.col("__n"), F.lit(1)))
    df = df.repartition(F.col("shard"), part).sortWithinPartitions("shard", "slot")
    return df.select(*[F.col("__row").getField(c).alias(c) for c in held], "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`; a null text has 0 bytes, equal texts aren't kept together."""
    text = text_column()
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
