"""Numeric kernels: poly-A tails of one sequence and non-negative LASSO."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lasso(y: np.ndarray, t: np.ndarray, weight: float, penalty: float, step: float, loops: int) -> tuple[np.ndarray, float]:
    """Non-negative LASSO by projected gradient, and the weighted error before the last update.

    The step halves whenever the error is larger than the one before; the first is that of x = 0.
    """
    x, error, before = np.zeros(t.shape[1]), math.inf, math.inf
    for _ in range(loops):
        z = (y - t @ x) * weight
        error = float(z @ z)
        step, before = (step / 2 if error > before else step), error
        x = np.maximum(x + step * (2 * z @ t - penalty), 0)
    return x, error


def lasso_by_label(df: DataFrame, atoms: int = 4) -> DataFrame:
    """For each label, its mean vector as a non-negative mixture of the label's first vectors.

    Only the means and the first vectors of a label come together in a task, whatever its size.
    """
    means = df.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter(F.col("rank") <= atoms)
    first = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "embedding"))), lambda p: p["embedding"]).alias("atoms"))

    def fit(frames):
        for frame in frames:
            rows = []
            for label, mean, vectors in zip(frame["label"], frame["mean"], frame["atoms"]):
                t = np.stack([np.asarray(v, float) for v in vectors]).T
                x, error = lasso(np.asarray(mean), t, 1.0, 0.001, 0.05 / max(1.0, np.linalg.norm(t, 2) ** 2), 200)
                rows.append((label, x.round(6).tolist(), round(error, 6)))
            yield pd.DataFrame(rows, columns=["label", "weights", "error"])

    return means.join(first, "label").mapInPandas(fit, "label int, weights array<double>, error double")


def polya(seq: str, least: int, share: float) -> tuple[int, int]:
    """(A's at the tail, T's at the head): fuzzy runs longer than `least`, mismatches within ceil(length * share)."""
    n = len(seq)
    allowed = lambda k: math.ceil(k * share)
    if n <= least:
        return tuple(n if n and sum(c != base for c in seq) <= allowed(n) else 0 for base in "AT")
    out = []
    for base, chars in (("A", seq[::-1]), ("T", seq)):
        wrong, run = sum(c != base for c in chars[:least]), 0
        if wrong <= allowed(least):
            k = least
            while k < n and wrong + (chars[k] != base) <= allowed(k + 1):
                wrong += chars[k] != base
                k += 1
            run = 0 if k == least else k - (chars[k - 1] != base)
        out.append(run)
    return out[0], out[1]
