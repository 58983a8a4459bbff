"""Passages against brute force: exact ones behind a shared opening, and changed ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import compact_windows as C

SCHEMA = "doc_id long, text string"


def fresh(r: random.Random, n: int) -> list[str]:
    return [f"w{r.getrandbits(40):x}" for _ in range(n)]


def changed(r: random.Random, words: list[str], every: int) -> list[str]:
    """One word of each `every` replaced, dropped or doubled by another."""
    out = list(words)
    for start in range(len(out) - every, -1, -every):
        i = start + r.randrange(every)
        out[i : i + 1] = r.choice([["changed"], [], [out[i], "put"]])
    return out


def found(spark, texts):
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    return {(r.doc_id, r.other_id) for r in C.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}


def exact(texts):
    """All (b, a) with a common run of C.WORDS words, by brute force."""
    runs = [{tuple(x[i : i + C.WORDS]) for i in range(len(x) - C.WORDS + 1)} for x in texts]
    return {(b, a) for b in range(len(texts)) for a in range(b) if runs[a] & runs[b]}


@pytest.mark.parametrize("opening", [10, 30, 48])
def test_shared_opening(spark, opening):
    """A holds only the first words of what B and C have in common; A is the first of their buckets."""
    r, texts = random.Random(opening), []
    for _ in range(40):
        passage = fresh(r, 50)
        head = [fresh(r, 30) + passage[:opening] + fresh(r, 60)]
        texts += head + [fresh(r, 30) + passage + fresh(r, 40) for _ in range(2)]
    want = exact(texts)
    assert len(want) == 40 and found(spark, texts) == want


def test_opening_of_many(spark):
    """Forty documents with one opening, of which each two neighbours have a longer passage."""
    r = random.Random(5)
    head, texts = fresh(r, 40), []
    for _ in range(20):
        more = fresh(r, 12)
        texts += [fresh(r, 25) + head + more + fresh(r, 25) for _ in range(2)]
    want = exact(texts)
    assert len(want) == 20 and found(spark, texts) >= want


def test_changed_passages(spark):
    """Passages of 100 words with one word in fifty changed: all of them."""
    r, texts = random.Random(9), []
    for _ in range(100):
        passage = fresh(r, 100)
        texts += [fresh(r, 20) + passage + fresh(r, 20), fresh(r, 20) + changed(r, passage, 50) + fresh(r, 20)]
    got = found(spark, texts)
    assert got == {(2 * i + 1, 2 * i) for i in range(100)}


def near(x, y):
    """Some stretches of C.SPAN shingles of both with an index of C.LIKE, by brute force."""
    a, b = ([hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)] for w in (x, y))
    for i in range(len(a) - C.SPAN + 1):
        p = set(a[i : i + C.SPAN])
        for j in range(len(b) - C.SPAN + 1):
            q = set(b[j : j + C.SPAN])
            if len(p & q) >= C.LIKE * len(p | q):
                return True
    return False


@pytest.mark.parametrize(("size", "groups", "words", "changes"), [(2, 60, 100, 2), (2, 60, 70, 1), (12, 4, 100, 1), (12, 4, 100, 2), (40, 1, 100, 2)])
def test_groups(spark, size, groups, words, changes):
    """Groups of copies with own changed words: the share of near pairs whose documents are joined, and no other pairs."""
    r, texts = random.Random(size * 100 + changes), []
    for _ in range(groups):
        passage = fresh(r, words)
        for _ in range(size):
            own = list(passage)
            for i in r.sample(range(words), changes):
                own[i] = f"c{r.getrandbits(40):x}"
            texts.append(fresh(r, 25) + own + fresh(r, 25))
    links = found(spark, texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b, a in links:
        assert b // size == a // size
        parent[root(b)] = root(a)
    # of large groups a part of the pairs, as brute force is slow
    pairs = [(b, a) for b in range(len(texts)) for a in range(b // size * size, b) if size < 40 or (a + b) % 9 == 0]
    want = [(b, a) for b, a in pairs if near(texts[b], texts[a])]
    assert len(want) > 20 and sum(root(b) == root(a) for b, a in want) >= 0.9 * len(want)
    assert sum(any(i in x for x in links) for i in {i for x in want for i in x}) >= 0.9 * len({i for x in want for i in x})


def test_all_places(spark):
    """Both places of a passage that stands twice in a document are told, on either side, and far-apart passages stay apart."""
    r = random.Random(77)
    one, two = fresh(r, 60), fresh(r, 60)
    texts = [fresh(r, 20) + one + fresh(r, 200) + two + fresh(r, 10), fresh(r, 9) + two + fresh(r, 120) + one + fresh(r, 100) + two + fresh(r, 9)]
    got = C.near_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], SCHEMA)).collect()
    assert {(x.start_word, x.end_word, x.other_start, x.other_end) for x in got if x.doc_id == 1 and x.other_id == 0} == {(9, 69, 280, 340), (189, 249, 20, 80), (349, 409, 280, 340)}


def test_odd_texts(spark):
    """Nulls, empty and very long texts, equal rows, texts that repeat one word."""
    r = random.Random(5)
    passage = fresh(r, 80)
    rows = [(None, None), (None, " ".join(passage)), (1, ""), (2, "the " * 5000), (3, "the " * 4000), (4, " ".join(fresh(r, 30_000) + passage)), (5, " ".join(passage)), (5, " ".join(passage))]
    got = {(x.doc_id, x.other_id) for x in C.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(3, 2), (4, -1), (5, -1)} or got == {(3, 2), (4, -1), (5, 4), (5, -1)}


def bucket(keys, texts, blocks):
    """Windows of one bucket, REACH items to each side of the shared one."""
    width = 2 * C.REACH + 1
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * width), len(texts), [None, pa.py_buffer(np.stack(texts).astype(np.uint16).tobytes())]).cast(pa.binary())
    n = len(texts)
    columns = [keys, range(n), [0] * n, [500] * n, [0] * n, [C.REACH * 64 + C.REACH] * n]
    return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in columns), pa.array(list(blocks), pa.int32()), data], names=[*C.COLUMNS[:6], "block", "items"])


def links(batches):
    return [(b, a) for x in C.compared(batches) for b, a in zip(x.column("b_id").to_pylist(), x.column("a_id").to_pylist())]


def triples(n):
    """Windows of which each three neighbours differ in own stretches of two items and others only have the middle in common; no two hold a whole passage."""
    r, out = np.random.default_rng(4), []
    for _ in range(n):
        whole = r.integers(1, 1 << 16, 2 * C.REACH + 1)
        whole[C.REACH - 11 : C.REACH + 5] = np.arange(16)
        for k in range(3):
            own = whole.copy()
            own[C.REACH - 14 - 3 * k :][:2] = r.integers(1, 1 << 16, 2)
            own[C.REACH + 15 + 3 * k :][:2] = r.integers(1, 1 << 16, 2)
            out.append(own)
    return out


def test_every_pair_of_a_bucket():
    """Near windows are linked, each with each other, whatever their number and however they are cut into batches."""
    texts = triples(10)
    want = [(b, a) for b in range(30) for a in range(b // 3 * 3, b)]
    whole = bucket([7] * 30, texts, [0] * 30)
    assert sorted(links([whole])) == want
    assert sorted(links([whole.slice(0, 13), whole.slice(13, 1), whole.slice(14)])) == want
    few = bucket([1, 1, 1, 2, 2, 2], texts[:6], [0] * 6)
    assert sorted(links([few])) == want[:6]


def test_tile_of_two_blocks():
    """A tile of two blocks links windows of different blocks only."""
    got = links([bucket([7] * 30, triples(10), [1 + i % 3 % 2 for i in range(30)])])
    assert sorted(got) == [(b, a) for b in range(30) for a in range(b // 3 * 3, b) if (b % 3 % 2) != (a % 3 % 2)]


def test_tiles(spark, monkeypatch):
    """A bucket that is dealt in tiles links what it links whole."""
    r, texts = random.Random(31), []
    head = fresh(r, 24)
    for _ in range(4):
        more = fresh(r, 64)
        for k in range(3):
            own = list(more)
            own[14 + 3 * k] = f"c{r.getrandbits(40):x}"
            texts.append(fresh(r, 25) + head + own + fresh(r, 25))
    want = found(spark, texts)
    monkeypatch.setattr(C, "TILE", 4)
    assert want and found(spark, texts) == want


def joined(pairs):
    """The groups that pairs join."""
    group = {}
    for b, a in pairs:
        one, other = group.get(b, {b}), group.get(a, {a})
        if one is not other or a not in one:
            whole = one | other
            group.update((x, whole) for x in whole)
    return {frozenset(x) for x in {id(x): x for x in group.values()}.values()}


def test_rows_of_a_group():
    """A bucket of near windows gives one row a window, whatever the number of its links, in the groups that the links join."""
    r = np.random.default_rng(8)
    texts = triples(20)
    near = r.integers(1, 1 << 16, 2 * C.REACH + 1)
    for _ in range(200):
        own = near.copy()
        own[C.REACH - 14 - int(r.integers(0, 3)) * 3 :][:2] = r.integers(1, 1 << 16, 2)
        own[C.REACH + 15 + int(r.integers(0, 3)) * 3 :][:2] = r.integers(1, 1 << 16, 2)
        texts.append(own)
    whole = bucket([7] * 260, texts, [0] * 260)
    every = links([whole])
    assert len(every) > 10_000
    got = [(b, a) for x in C.grouped([whole.slice(0, 99), whole.slice(99)]) for b, a in zip(x.column("doc_id").to_pylist(), x.column("root_id").to_pylist())]
    assert len(got) == len({b for b, _ in got}) <= 260
    groups = joined(every)
    assert joined(got) == groups and {a for _, a in got} == {min(x) for x in groups}


@pytest.mark.parametrize("tile", [512, 16])
def test_classes(spark, monkeypatch, tile):
    """Groups of near copies have a row for each passage, not for each pair; classes and places are those of the links."""
    monkeypatch.setattr(C, "TILE", tile)
    r, texts = random.Random(12), []
    for size in (2, 3, 60):
        passage = fresh(r, 100)
        for _ in range(size):
            own = list(passage)
            own[r.randrange(100)] = f"c{r.getrandbits(40):x}"
            texts.append(fresh(r, 25) + own + fresh(r, 25))
    texts += [texts[0], fresh(r, 90), *(fresh(r, 30) + texts[2][20:100] + fresh(r, 60) + texts[9][20:100] for _ in range(2))]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)] + [(None, None), (90, ""), (91, "the " * 500), (92, "the " * 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, got = C.near_passages(df).collect(), C.passage_classes(df).collect()
    assert len(pairs) > 1000 and len(got) <= len(rows) + 2
    place = lambda doc, start: next((doc, x.start_word) for x in got if x.doc_id == doc and x.start_word <= start < x.end_word)
    want = joined([(place(x.doc_id, x.start_word), place(x.other_id, x.other_start)) for x in pairs])
    classes = {}
    for x in got:
        classes.setdefault(x.class_id, set()).add((x.doc_id, x.start_word))
    assert want == {frozenset(x) for x in classes.values()}
