"""Pairs at the threshold: an unlucky sketch, and the pipeline's own threshold."""

import numpy as np
import pyarrow as pa

from strandloom.llm import near_dedup as N

SCHEMA = "doc_id long, text string, source string, n_chars long"


def sets(text):
    return N.text_sets(pa.array([text]))[0]


def index(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def sketched(a, b):
    a, b = a[: N.SKETCH], b[: N.SKETCH]
    last = np.union1d(a, b)[N.SKETCH - 1]
    return (np.intersect1d(a, b) <= last).sum() / N.SKETCH


def unlucky():
    """Two texts with an index of 0.85 or more, whose sketches have less in common: words of small hashes are changed."""
    words = [f"word{i}" for i in range(1500)]
    base = sets(" ".join(words))
    own, changed = set(base[: N.SKETCH].tolist()), list(words)
    hashes = [int(sets(" ".join(words[i : i + 5]))[0]) in own for i in range(len(words) - 4)]
    for i in sorted(range(4, len(hashes)), key=lambda i: -sum(hashes[i - 4 : i + 1])):
        if any(w.startswith("new") for w in changed[i - 5 : i + 6]):
            continue
        changed[i] = f"new{i}"
        there = sets(" ".join(changed))
        if sketched(base, there) < 0.64:
            assert index(base, there) >= 0.85 and sketched(base, there) >= 0.55
            return " ".join(words), " ".join(changed)


def test_unlucky_sketch(spark):
    a, b = unlucky()
    got = {r.doc_id: r.component_id for r in N.components(spark.createDataFrame([(1, a, "s", 1), (2, b, "s", 1)], SCHEMA)).collect()}
    assert got == {1: 1, 2: 1}


def test_stage_threshold(spark):
    """An index between 0.80 and 0.85: apart in op2's contract, one document in the pipeline."""
    words = [f"word{i}" for i in range(504)]
    changed = [f"new{i}" if i % 50 == 20 else w for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(changed)
    assert 0.80 <= index(sets(a), sets(b)) < 0.85
    docs = spark.createDataFrame([(1, a, "s", 1), (2, b, "s", 1)], SCHEMA)
    assert {r.component_id for r in N.components(docs).collect()} == {1, 2}
    assert [r.doc_id for r in N.near_dedup_stage(spark, docs, "").collect()] == [1]


def test_repeated_rows(spark):
    """Rows with one doc_id and one text, beside near copies that are compared by full sets, give one verdict each."""
    words = [f"w{i}" for i in range(200)]
    other = [*words[:-1], "changed"]
    rows = [(7, " ".join(words)), (7, " ".join(words)), (None, " ".join(other)), (None, " ".join(other)), (9, " ".join(other)), (4, "some other text of more than five words"), (4, "some other text of more than five words")]
    got = N.components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()
    want = [(7, 7, True), (7, 7, True), (None, 7, False), (None, 7, False), (9, 7, False), (4, 4, True), (4, 4, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
