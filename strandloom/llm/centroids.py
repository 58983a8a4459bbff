"""Exact k-means over whole numbers, with Drake's adaptive distance bounds.

Of each vector the state holds its cluster, an upper bound on the distance to that centroid, lower bounds for the
several centroids that were next nearest, in that order, and one lower bound for all the rest. When centroids move
the bounds give way by as much. Where the order of the bounds still certifies the nearest centroid nothing is
computed; else the distances of only as many stored centroids as the bounds leave open; and only where even the
bound of the rest doesn't hold, all distances. How many bounds are kept follows from how many were needed.

The state is a table, written once a round, so a lost executor recomputes its part of one round. Only the centroids
(k vectors) and sums over clusters come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discarded, stored

#: Up to this size of components, sums of squares are exact in double precision.
EXACT = 1 << 22
#: Bounds are loosened by this share where they are set, and must differ by these margins to certify an order.
SLACK, MARGIN, LEAST = 1e-12, 1e-9, 1e-6
STATE = "vec_id long, v array<long>, cluster int, upper double, near array<int>, low array<double>, rest double, used int, distance long"


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v and c, as whole numbers."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    y = c.astype(object)
    return np.stack([((y - x) ** 2).sum(1) for x in v.astype(object)])


def pair_squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of v[i] and each of c[i]."""
    exact = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT
    step = c.astype(np.float64 if exact else object) - v[:, None, :]
    return (step * step).sum(2)


def roots(x: np.ndarray, way: float) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 + way * SLACK)


def first_bounds(v: np.ndarray, centers: np.ndarray, keep: int) -> dict[str, np.ndarray]:
    """State of vectors whose distances to all centroids are computed; of equal distances the smaller number is first."""
    k = len(centers)
    dist = squares(v, centers)
    order = np.argsort(dist, axis=1, kind="stable")[:, : keep + 2]
    found = np.take_along_axis(dist, order, axis=1)
    rest = roots(found[:, keep + 1], -1) if k > keep + 1 else np.full(len(v), np.inf)
    return {"cluster": order[:, 0], "upper": roots(found[:, 0], 1), "near": order[:, 1 : keep + 1], "low": roots(found[:, 1 : keep + 1], -1), "rest": rest, "used": np.full(len(v), keep)}


def next_bounds(v: np.ndarray, s: dict[str, np.ndarray], centers: np.ndarray, moved: np.ndarray, keep: int) -> dict[str, np.ndarray]:
    """State after centroids have moved by `moved` (upper bounds), with `keep` lower bounds, no more than before."""
    cluster, near = s["cluster"].copy(), s["near"].copy()
    upper, low, rest = s["upper"] + moved[cluster], s["low"] - moved[near], s["rest"] - moved.max(initial=0)
    if keep < near.shape[1]:
        rest = np.minimum(rest, low[:, keep:].min(axis=1))
        near, low = near[:, :keep].copy(), low[:, :keep].copy()
    used = np.zeros(len(v), np.int64)
    # least bound from each rank on, that of the rest last
    behind = np.minimum.accumulate(np.concatenate([low, rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    certain = lambda u, bound: u * (1 + MARGIN) + LEAST < bound
    open_rows = np.flatnonzero(~certain(upper, behind[:, 0]))
    if len(open_rows):
        own = pair_squares(v[open_rows], centers[cluster[open_rows]][:, None, :])[:, 0]
        upper[open_rows] = roots(own, 1)
        held = certain(upper[open_rows][:, None], behind[open_rows])
        rank = np.where(held.any(axis=1), held.argmax(axis=1), keep + 1)
        used[open_rows] = np.minimum(rank, keep)
        for z in np.unique(rank[rank > 0]):
            rows = open_rows[rank == z]
            if z > keep:
                fresh = first_bounds(v[rows], centers, keep)
                cluster[rows], upper[rows], near[rows], low[rows], rest[rows] = (fresh[c] for c in ("cluster", "upper", "near", "low", "rest"))
                continue
            tried = np.concatenate([cluster[rows][:, None], near[rows, :z]], axis=1)
            tried.sort(axis=1)
            dist = pair_squares(v[rows], centers[tried])
            order = np.argsort(dist, axis=1, kind="stable")
            tried, dist = np.take_along_axis(tried, order, axis=1), np.take_along_axis(dist, order, axis=1)
            cluster[rows], upper[rows] = tried[:, 0], roots(dist[:, 0], 1)
            near[rows, :z], low[rows, :z] = tried[:, 1:], roots(dist[:, 1:], -1)
    return {"cluster": cluster, "upper": upper, "near": near, "low": low, "rest": rest, "used": used}


def matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    """A column of n lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def assigned(rows: DataFrame, centers: np.ndarray, moved: np.ndarray | None, keep: int, last: bool, slice_rows: int = 4096) -> DataFrame:
    """The state after one assignment: rows (vec_id, v) at first, where moved is None, later the state before.

    distance is computed in the last assignment only.
    """

    def stage(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                n = batch.num_rows
                v = matrix(batch.column("v"), n, np.int64)
                if moved is None:
                    s = first_bounds(v, centers, keep)
                else:
                    s = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "rest")}
                    s |= {"near": matrix(batch.column("near"), n, np.int64), "low": matrix(batch.column("low"), n, np.float64)}
                    s = next_bounds(v, s, centers, moved, keep)
                dist = [int(x) for x in pair_squares(v, centers[s["cluster"]][:, None, :])[:, 0]] if last else [None] * n
                ends = pa.array(np.arange(n + 1) * s["near"].shape[1], pa.int32())
                lists = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x.ravel(), kind))  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), batch.column("v"), pa.array(s["cluster"], pa.int32()), pa.array(s["upper"]), lists(s["near"], pa.int32()), lists(s["low"], pa.float64()),
                        pa.array(s["rest"]), pa.array(s["used"], pa.int32()), pa.array(dist, pa.int64()),
                    ],
                    names=[x.split()[0] for x in STATE.split(", ")],
                )

    return rows.mapInArrow(stage, STATE)


def whole_vectors(df: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of vectors with exactly `dim` components, none null, NaN or infinite: floor(scale * x) of each."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter((F.size("e") == dim) & F.coalesce(F.forall("e", sound), F.lit(False)))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def clusters(rows: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors (vec_id, v: array<long>, all of one length).

    The first centroids are the k vectors of the smallest hex sha256 of salt and vec_id (a null id counts as empty;
    rows of one id follow each other by their components), fewer if there are fewer vectors. A vector belongs to the
    nearest centroid, the smaller number among equal distances; a centroid then becomes the floor of its vectors'
    mean, and stays where it has none. After `rounds` of this, vectors are assigned once more. Repeated rows are
    vectors of their own. An empty table gives an empty result. Sums and distances beyond 64 bits are an error, never
    a wrong number.
    """
    spark = rows.sparkSession
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(named.alias("name"), "v").orderBy("name", "v").limit(k).collect()  # at most k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centers = np.array([r.v for r in first], np.int64).reshape(len(first), -1)
    k, dim = centers.shape
    fewest = max(1, k // 8)
    keep = max(fewest, k // 4) if k > 1 else 0
    state = stored(assigned(rows, centers, None, keep, rounds == 0), "bounds")
    for turn in range(rounds):
        # k rows at most
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("used").alias("used"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dim)]).alias("total")).collect()
        after = centers.copy()
        for r in sums:
            after[r.cluster] = [x // r.n for x in r.total]
        moved = roots(pair_squares(after, centers[:, None, :])[:, 0], 1)
        keep = min(keep, max(fewest, *(r.used for r in sums)))
        centers, before = after, state
        state = stored(assigned(before, centers, moved, keep, turn == rounds - 1), "bounds")
        discarded(before)
    inertia = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    whole = sum(inertia.values())
    known = [(i, inertia.get(i, 0), whole, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centers)]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """All sound embeddings in 40 clusters."""
    return clusters(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
