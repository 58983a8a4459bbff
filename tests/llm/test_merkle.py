"""The Merkle manifest against a tree built whole, and the traversal against its runs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple, text: str | None) -> str:
    values = [row[0], row[1], row[2], row[3], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], int]]]]:
    """The top, and of each leaf its (run, place) level by level."""
    paths, level, where = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, at in enumerate(where):
            paths[i].append((runs[at // 8], at % 8))
        where = [at // 8 for at in where]
        level = [digest("".join(r)) for r in runs]
    return level[0], paths


def expected(rows: list[tuple]) -> list[tuple]:
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row, row[4]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    root, upper = tree([trees[g][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for (doc_id, own, row), path in zip(groups[g], trees[g][1]):
            path = path + upper[i]
            node = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and row[4] is not None:
                node = leaf(row, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]))
            for run, place in path:
                node = digest("".join([*run[:place], node, *run[place + 1 :]]))
            proof = digest("".join(n for run, place in path for j, n in enumerate(run) if j != place))
            out.append((doc_id, own, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def found(spark, rows: list[tuple], height: int = merkle.HEIGHT) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", leaf string, root string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER))
    return sorted((tuple(r) for r in merkle.manifest(merkle.leaves_of(df, tampered), height).collect()), key=repr)


@pytest.mark.parametrize("n, height", [(1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (513, 4), (700, 4)])
def test_traversal_gives_each_leaf_its_runs(n, height):
    leaves = [digest(str(i)) for i in range(n)]
    top, paths = tree(leaves)
    assert merkle.height_of(n) == height and merkle.top(leaves, height) == top
    for i, runs in enumerate(merkle.traversed(leaves, height)):
        assert [list(r) for r in runs] == [run for run, _ in paths[i]]


def test_traversal_holds_few_nodes(monkeypatch):
    held, made = [], []
    first = merkle.Treehash.__init__

    def noted(self, *args):
        made.append(self)
        first(self, *args)

    monkeypatch.setattr(merkle.Treehash, "__init__", noted)
    for runs in merkle.traversed([digest(str(i)) for i in range(4096)], 4):
        held.append(sum(map(len, runs)) + sum(len(s) for t in made[-12:] for s in t.stack if t.at < t.end))
    assert max(held) <= 4 * 8 + 12 * 4 * 8


def test_manifest_is_the_whole_tree(spark):
    rows = [(i, f"s{i % 3}", ["en", None, "de", "é", ""][i % 5 if i % 7 else 0], i, f"Text {i} ABC é") for i in range(300)]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, ""), (5, "s", "en", 3, "Same"), (5, "s", "en", 3, "Same"), (12, "s", "en", 3, None), (-3, "s", "zz", 0, "X" * 20000)]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, 1) == expected(rows)  # several tables of tops


def test_small_manifests(spark):
    assert found(spark, []) == []
    for rows in ([(1, "a", "en", 1, "A")], [(1, "a", None, 1, None)], [(i, "a", "en", 1, "A") for i in range(9)], [(1, "a", "en", 1, "A"), (1, "a", "de", 1, "A")]):
        assert found(spark, rows) == expected(rows)
