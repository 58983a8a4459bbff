"""The mixing query bisects and reads twice where sources differ by little, and stays within its limit of repeats where they differ by much."""

import numpy as np

from strandloom.llm import mixing


def test_query_comes_through_its_method(spark, tmp_path):
    rows = [(i, " ".join(["word"] * (20 + i % 5)), f"s{i % 6}") for i in range(600 - 60)] + [(1000 + i, "word " * 9, "s5") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op10_mixing(spark, str(tmp_path)).collect()
    tokens = np.array([sum(len(t.split()) for _, t, s in rows if s == f"s{k}") for k in range(6)], float)
    alpha = mixing.exponent(tokens / tokens.sum(), mixing.EVEN)
    assert 0 < alpha < 1 and {r["pass"] for r in out} == {0, 1}
    assert {r.doc_id for r in out if r["pass"] == 0} == {i for i, _, _ in rows}
    w = mixing.weights(tokens / tokens.sum(), alpha)
    assert mixing.entropy(w) >= mixing.EVEN > mixing.entropy(tokens / tokens.sum())
    got = np.array([sum(r.n_tokens for r in out if r.source == f"s{k}") for k in range(6)], float)
    assert np.abs(got / got.sum() - w).max() < 0.005


def test_repeats_stay_within_the_limit():
    shares = np.array([0.9, 0.06, 0.04])
    alpha = mixing.exponent(shares, mixing.EVEN)
    assert mixing.repeats(shares, alpha) <= 2.0 + 1e-6 and mixing.repeats(shares, alpha - 1e-3) > 2.0
