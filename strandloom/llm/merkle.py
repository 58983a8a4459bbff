"""A Merkle manifest of a dataset: every row's authentication path in a tree of hashes, by traversal scheduling.

Rows are leaves, grouped by language and in the order of doc_id; runs of eight nodes hash into their parent, and the
groups' tops into one root. Spark ranks the leaves and cuts them into aligned blocks of 4096. A task walks through
one block at a time: for each level of the block one treehash stack computes the run of nodes that is needed next,
a bounded number of leaves ahead with every step, so the path of a leaf follows from that of the leaf before it
while only a run, its successor and a stack are held for each level. What lies above a block is the same for all its
leaves; it comes from the same traversal of the blocks' tops, one level of tables for each factor of 4096.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import discarded, documents, stored

#: Nodes of a run, levels of a block (of 4096 leaves).
ARITY, HEIGHT = 8, 4
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODES = "grp string, rank long, count long, node string"
PATHS = "grp string, rank long, runs array<array<string>>, places array<int>, subroot string, root string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
RUNS = pa.list_(pa.list_(pa.string()))


def leaf_digest(values: list[Column]) -> Column:
    """Hex sha256 of the values: `-` for a null, else the number of UTF-8 bytes, a colon and the value in decimal or as it is."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in values]), 256)


def parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


class Treehash:
    """The run of nodes of one level that starts at a leaf, computed leaf by leaf with one stack of unfinished runs.

    stack[k] holds the nodes of level k that wait for their run to be full; the last run of a level may have fewer.
    """

    def __init__(self, leaves: list[str], level: int, start: int) -> None:
        self.leaves, self.level, self.at = leaves, level, start
        self.end = min(start + ARITY ** (level + 1), len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def step(self, n: int) -> None:
        """Takes the next n leaves."""
        stack, level = self.stack, self.level
        for _ in range(min(n, self.end - self.at)):
            stack[0].append(self.leaves[self.at])
            self.at += 1
            for k in range(level):
                if len(stack[k]) < ARITY and self.at < self.end:
                    break
                if stack[k]:
                    stack[k + 1].append(parent(stack[k]))
                    stack[k] = []

    def run(self) -> list[str]:
        """All nodes, once the last leaf is taken."""
        self.step(self.end - self.at)
        return self.stack[self.level]


def traversed(leaves: list[str], height: int) -> Iterator[list[list[str]]]:
    """For each leaf in turn the runs that hold it or its ancestor, one for each level below `height`.

    For each level the run in use and the Treehash of its successor are held. Each Treehash takes one leaf with every
    leaf that is left, and a run lasts for as many leaves as its successor needs, so each is ready in time.
    """
    runs = [Treehash(leaves, k, 0).run() for k in range(height)]
    ahead = [Treehash(leaves, k, ARITY ** (k + 1)) for k in range(height)]
    for i in range(len(leaves)):
        for k in range(height):
            width = ARITY ** (k + 1)
            if i and i % width == 0:
                runs[k] = ahead[k].run()
                ahead[k] = Treehash(leaves, k, i + width)
            ahead[k].step(1)
        yield runs


def top(leaves: list[str], height: int) -> str:
    """The one node at `height` over some leaves."""
    return leaves[0] if height == 0 else parent(Treehash(leaves, height - 1, 0).run())


def folded(leaf: str, places: list[int], runs: list[list[str]]) -> str:
    """The root that a leaf gives with the other nodes of its runs; places: where it, then its ancestors, stand in them."""
    node = leaf
    for run, place in zip(runs, places):
        node = parent([*run[:place], node, *run[place + 1 :]])
    return node


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (grp, ..) with rank (from 0 within the group, ascending, nulls first) and count (of the group), stored.

    Rows are dealt by ranges of group and order, so no group is sorted by one task, whatever its size; the number of
    rows of each group in each range gives the offsets. Only rows equal in group and order stay together.
    """
    held = stored(nodes.repartitionByRange("grp", *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("grp", "__part").agg(F.count("*").alias("__n"))
    own = Window.partitionBy("grp")  # a row for each range
    before = F.sum("__n").over(own.orderBy("__part")) - F.col("__n")
    offsets = sizes.select("grp", "__part", before.alias("__before"), F.sum("__n").over(own).alias("count"))
    place = F.row_number().over(Window.partitionBy("grp", "__part").orderBy(*order)).cast("long") - 1
    rows = held.withColumn("__place", place).join(offsets, ["grp", "__part"])
    out = stored(rows.withColumn("rank", F.col("__place") + F.col("__before")).drop("__part", "__place", "__before"), "ranked")
    discarded(held)
    return out


def height_of(count: int) -> int:
    """Levels between the leaves and the top of a tree; a lone leaf is its own top."""
    levels = 0
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


def by_block(nodes: DataFrame, height: int):
    return nodes.groupBy("grp", F.floor(F.col("rank") / ARITY**height).cast("long").alias("__block"))


def tops(nodes: DataFrame, height: int) -> DataFrame:
    """The nodes (grp, rank, count, node) over aligned blocks of nodes of the same form."""

    block = ARITY**height

    def stage(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        count, rank = table.column("count")[0].as_py(), table.column("rank")[0].as_py()
        node = top(table.column("node").to_pylist(), min(height, height_of(count)))
        return pa.table({"grp": table.column("grp")[:1], "rank": pa.array([rank // block], pa.int64()), "count": pa.array([-(-count // block)], pa.int64()), "node": [node]})

    return by_block(nodes.select("grp", "rank", "count", "node"), height).applyInArrow(stage, NODES)


def climbed(nodes: DataFrame, height: int) -> list[DataFrame]:
    """nodes, the tops of their blocks, the tops of these, and so on to one node for each group."""
    levels, most = [nodes], nodes.agg(F.max("count")).first()[0] or 0
    while len(levels) == 1 or most > 1:
        levels.append(stored(tops(levels[-1], height), "tops"))
        most = -(-most // ARITY**height)
    return levels


def walked_blocks(lower: pa.Table, above: pa.Table, height: int) -> Iterator[tuple[list[list[str]], list[int]]]:
    """For each of a block's nodes, sorted by rank, its runs and places up to the root."""
    runs, places = above.column("runs")[0].as_py(), above.column("places")[0].as_py()
    height = min(height, height_of(lower.column("count")[0].as_py()))
    first = lower.column("rank")[0].as_py()
    for i, own in enumerate(traversed(lower.column("node").to_pylist(), height)):
        yield [*own, *runs], [(first + i) // ARITY**k % ARITY for k in range(height)] + places


def paths(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """Paths of nodes: upper holds those of their blocks, which are appended."""

    def stage(lower: pa.Table, above: pa.Table) -> pa.Table:
        lower = lower.sort_by("rank")
        found = [(list(runs), places) for runs, places in walked_blocks(lower, above, height)] if lower.num_rows else []
        same = lambda c: pa.array([above.column(c)[0].as_py()] * len(found), pa.string())
        return pa.table({
            "grp": lower.column("grp"), "rank": lower.column("rank"), "runs": pa.array([x[0] for x in found], RUNS),
            "places": pa.array([x[1] for x in found], pa.list_(pa.int32())), "subroot": same("subroot"), "root": same("root"),
        })

    return by_block(nodes, height).cogroup(by_rank(upper)).applyInArrow(stage, PATHS)


def by_rank(upper: DataFrame):
    return upper.groupBy("grp", F.col("rank").alias("__block"))


def proofs(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """The rows of the manifest: of each leaf the hash of its siblings, and the root that it (or `shown`) gives with them."""

    def stage(lower: pa.Table, above: pa.Table) -> pa.Table:
        lower = lower.sort_by("rank")
        n = lower.num_rows
        root = above.column("root")[0].as_py()
        proof, fold = [], []
        leaves = lower.column("node").to_pylist()
        for (runs, places), leaf, shown in zip(walked_blocks(lower, above, height) if n else (), leaves, lower.column("shown").to_pylist()):
            siblings = [node for run, place in zip(runs, places) for j, node in enumerate(run) if j != place]
            proof.append(parent(siblings))
            fold.append(folded(leaf if shown is None else shown, places, runs))
        same = lambda c: pa.array([above.column(c)[0].as_py()] * n, pa.string())
        return pa.table({
            "doc_id": lower.column("doc_id"), "leaf": lower.column("node"), "subroot": same("subroot"), "root": same("root"),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(fold, pa.string()), "verified": pa.array([x == root for x in fold], pa.bool_()),
        })

    return by_block(nodes, height).cogroup(by_rank(upper)).applyInArrow(stage, PROOFS)


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (doc_id, lang, leaf, shown).

    shown: another digest that is folded in the leaf's place, or null. Leaves of one language (null is one, and the
    first) ascend by doc_id, nulls first, then by their digests, so repeated rows stand side by side, each a leaf.
    proof_sha256 is the hash of all siblings up to the root, and verified whether the folded root is the root. A lone
    leaf is its language's top, and a lone language's top the root; without siblings the proof is the hash of nothing.
    An empty table gives an empty result. Languages may be many and of any size: blocks of 8 ** height leaves are the
    unit of work, and don't change the result.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first
    rows = stored(leaves.select(name.alias("grp"), "doc_id", F.col("leaf").alias("node"), "shown"), "leaves")
    nodes = ranked(rows, ["doc_id", "node"])
    discarded(rows)
    levels = climbed(nodes, height)
    crowns = ranked(levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "node"), ["lang"])
    above = climbed(crowns, height)
    none = "CAST(array() AS array<array<string>>)", "CAST(array() AS array<int>)"
    upper = above[-1].selectExpr("grp", "rank", f"{none[0]} AS runs", f"{none[1]} AS places", "CAST(NULL AS string) AS subroot", "node AS root")
    for level in reversed(above[:-1]):
        upper = stored(paths(level, upper, height), "paths")
    upper = crowns.join(upper.drop("grp"), "rank").select(F.col("lang").alias("grp"), F.lit(0).cast("long").alias("rank"), "runs", "places", F.col("node").alias("subroot"), "root")
    for level in reversed(levels[1:-1]):
        upper = stored(paths(level, upper, height), "paths")
    return proofs(nodes, upper, height)


def leaves_of(df: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, shown) of rows with FIELDS; shown: the digest with another text, where that is not null."""
    fields = [F.col(c) for c in FIELDS]
    shown = F.when(text.isNotNull(), leaf_digest([*fields[:-1], text])) if text is not None else F.lit(None).cast("string")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_digest(fields).alias("leaf"), shown.alias("shown"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against copies of which every third (by CRC) has its A-Z in lower case."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER))
    return manifest(leaves_of(documents(spark, sf_dir), tampered))
