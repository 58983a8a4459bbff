"""Exact clusters with bounds against all distances in every round."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def expected(rows: list[tuple], k: int, rounds: int) -> list[tuple]:
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(np.float32(x)) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [list(c) for _, c in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest(v) for _, v in kept]
    per = {j: sum(d for d, c in last if c == j) for j in range(len(centers))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, per[c], sum(per.values()), name[c]) for (i, _), (d, c) in zip(kept, last)), key=repr)


def found(spark, rows: list[tuple], k: int, rounds: int) -> list[tuple]:
    df = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], SCHEMA)
    return sorted((tuple(r) for r in centroids.clusters(centroids.whole_vectors(df), k, rounds).collect()), key=repr)


def vectors(n: int, spread: float, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 64))
    return [(i, [float(x) for x in (middle[i % 12] + spread * rng.normal(size=64)) * 0.3]) for i in range(n)]


@pytest.mark.parametrize("n, k, rounds, spread", [(300, 40, 5, 0.3), (200, 9, 8, 1.0), (60, 3, 5, 1.0), (50, 1, 2, 1.0), (30, 40, 3, 0.5)])
def test_clusters_are_those_of_all_distances(spark, n, k, rounds, spread):
    rows = vectors(n, spread, n)
    assert found(spark, rows, k, rounds) == expected(rows, k, rounds)


def test_odd_vectors(spark):
    zero, rows = [0.0] * 64, vectors(80, 0.5, 3)
    ties = [(1000 + i, [0.5 if j == i % 4 else 0.0 for j in range(64)]) for i in range(40)]
    odd = [(2000, None), (2001, []), (2002, zero[:63]), (2003, [*zero, 0.0]), (2004, [None, *zero[1:]]), (2005, [math.nan, *zero[1:]]), (2006, [-math.inf, *zero[1:]]), (None, zero), (None, rows[0][1]), (7, zero), (7, zero), (5000, [30000.0] * 64)]
    assert found(spark, rows + ties + odd, 8, 5) == expected(rows + ties + odd, 8, 5)
    assert found(spark, [(i, zero) for i in range(50)], 8, 5) == expected([(i, zero) for i in range(50)], 8, 5)
    assert found(spark, [], 8, 5) == [] and found(spark, odd[:7], 8, 5) == []


def test_bounds_hold_and_spare_most_distances(monkeypatch):
    rng = np.random.default_rng(1)
    middle = rng.integers(-200, 200, (20, 64))
    v = middle[rng.integers(0, 20, 2000)] + rng.integers(-30, 30, (2000, 64))
    centers, keep = middle + rng.integers(-3, 3, (20, 64)), 5
    state = centroids.first_bounds(v, centers, keep)
    asked = []
    plain = centroids.squares
    monkeypatch.setattr(centroids, "squares", lambda a, b: asked.append(len(a)) or plain(a, b))
    for turn in range(6):
        after = centers + rng.integers(-2, 3, (20, 64))
        keep = 5 - turn // 2
        state = centroids.next_bounds(v, state, after, centroids.roots(centroids.pair_squares(after, centers[:, None, :])[:, 0], 1), keep)
        centers, exact = after, np.sqrt(plain(v, after))
        assert (state["cluster"] == exact.argmin(axis=1)).all()
        assert (state["upper"] >= exact[np.arange(2000), state["cluster"]]).all()
        assert (state["low"] <= np.take_along_axis(exact, state["near"], axis=1)).all()
        for i in range(2000):
            others = np.setdiff1d(np.arange(20), [state["cluster"][i], *state["near"][i]])
            assert state["rest"][i] <= exact[i, others].min()
    assert sum(asked) < 600  # of 12,000


def test_large_components_are_exact():
    v = np.array([[1 << 40, -(1 << 40), 3]], np.int64)
    c = np.array([[0, 0, 0], [1 << 40, -(1 << 40), 1]], np.int64)
    assert centroids.squares(v, c).tolist() == [[(1 << 81) + 9, 4]]
    assert centroids.pair_squares(v, c[None, :, :]).tolist() == [[(1 << 81) + 9, 4]]


def test_sound_vectors_only(spark):
    df = spark.createDataFrame([(1, [0.1] * 3, 1, "")], SCHEMA)
    assert centroids.whole_vectors(df).count() == 0
    assert centroids.whole_vectors(df, 3).select(F.element_at("v", 1)).first()[0] == 25
