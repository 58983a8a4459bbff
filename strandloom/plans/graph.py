"""Graph algorithms as rounds of joins and aggregates."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored, within


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by an exchange of both sides: stored tables of nodes are small as files, so that Spark would send whole ones through the driver."""
    return df.hint("merge")


@within("components")
def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst: long); component is the smallest node reachable.

    Each round contracts every node into the neighbour of the lowest keyed priority, if that is lower than its
    own. Priorities are hashed anew each round, so long chains shrink by a constant factor, too. Null ends are
    dropped; a loop makes its node a component of its own.
    """
    pairs = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).dropna()
    pairs = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels, turn = None, 0
    live = pairs
    while labels is None or not live.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731,B023
        best = live.groupBy("u").agg(F.min_by("v", rank("v")).alias("best"))
        moves = stored(best.select("u", F.when(rank("best") < rank("u"), F.col("best")).otherwise(F.col("u")).alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            labels = labels.join(dealt(moves), F.col("label") == F.col("u"), "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = stored(labels, "labels")
        left = moves.select("u", F.col("to").alias("a"))
        right = moves.select(F.col("u").alias("w"), F.col("to").alias("b"))
        live = live.join(dealt(left), "u").join(dealt(right), F.col("v") == F.col("w")).filter("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        live = stored(live, "edges")
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(dealt(least), "label").select("node", "component")


def resolved(pointers: DataFrame) -> DataFrame:
    """(node, root) of (node, parent) by pointer jumping: a node that points to itself or 0 is a root.

    Chains of length n take about log2(n) rounds. Pointers to nodes that don't exist resolve to null, and so do
    nodes on a ring or leading to one: after as many rounds as the longest possible chain needs, what still
    doesn't point to a root never will.
    """
    parent = F.when((F.col("parent") == 0) | (F.col("parent") == F.col("node")), F.col("node")).otherwise(F.col("parent"))
    now = stored(pointers.select("node", parent.alias("root"), (parent == F.col("node")).alias("done")), "roots")
    for _ in range(now.count().bit_length() + 1):
        there = now.select(F.col("node").alias("n"), F.col("root").alias("r"), F.col("done").alias("d"))
        then = now.join(dealt(there), F.col("root") == F.col("n"), "left").select("node", F.col("r").alias("root"), F.coalesce("d", F.col("r").isNull()).alias("done"))
        now = stored(then, "roots")
        if now.filter(~F.col("done")).isEmpty():
            break
    return now.select("node", F.when(F.col("done"), F.col("root")).alias("root"))


def signed_components(edges: DataFrame) -> DataFrame:
    """(node, root, strand, conflict) of edges (src, dst, sign: 1 or -1; a loop with sign 1 names a single node).

    Components of the double cover: node v has the copies 2v (as its root) and 2v+1 (reversed), and a negative
    edge crosses over. strand is the product of the signs on the way to the root, the smallest node of the
    group. Where two ways disagree, both copies meet: conflict holds for the whole group and strand is 1.
    Node ids must be below 2**62.
    """
    rows = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"), (F.col("sign") < 0).cast("long").alias("cross")).dropna()
    copies = rows.select(F.explode(F.array(*[F.struct((2 * F.col("u") + side).alias("src"), (2 * F.col("v") + (F.lit(side).bitwiseXOR(F.col("cross")))).alias("dst")) for side in (0, 1)])).alias("e")).select("e.*")
    found = connected_components(copies).withColumn("v", F.floor(F.col("node") / 2).cast("long"))
    both = found.groupBy("v").agg(F.min_by("component", "node").alias("own"), F.count_distinct("component").alias("n"))
    root, conflict = F.floor(F.col("own") / 2).cast("long"), F.col("n") == 1
    return both.select(F.col("v").alias("node"), root.alias("root"), F.when(conflict | (F.col("own") % 2 == 0), 1).otherwise(-1).alias("strand"), conflict.alias("conflict"))


#: Edges of a group above its cap that one task cuts down; larger groups lose their weakest edges in rounds until they are smaller.
IN_TASK = 1 << 20


def capped_components(edges: DataFrame, cap: int = 40, safe: float = 50) -> DataFrame:
    """(node, component) of edges (src, dst, score) whose groups have been cut down towards `cap` nodes.

    Every group above the cap loses all edges of its lowest score, if that is below `safe` or the group has more
    than 1.33 * cap nodes, again and again until nothing is lost. Nodes without edges left stay as groups of their
    own. A null score counts as 0.
    """
    return pruned(edges, cap, safe)[0]


def pruned(edges: DataFrame, cap: int = 40, safe: float = 50) -> tuple[DataFrame, DataFrame]:
    """The groups of `capped_components`, and the edges (src, dst, score) that are left in them."""
    start = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).dropna()
    live, done = stored(start, "scored"), []
    most = round(1.33 * cap)
    while True:
        groups = stored(connected_components(live), "groups")
        placed = live.join(dealt(groups), F.col("src") == F.col("node")).select("component", "src", "dst", "score")
        sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
        weights = placed.groupBy("component").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        sizes = stored(sizes.join(dealt(weights), "component").withColumn("final", (F.col("size") <= cap) | (F.col("low") >= safe) & (F.col("size") <= most)), "sizes")
        final = placed.join(dealt(sizes.filter("final")), "component", "left_semi")
        inner = placed.join(dealt(sizes.filter(f"NOT final AND n <= {IN_TASK}")), "component", "left_semi")
        inner = inner.groupBy("component").applyInArrow(lambda t: _cut_table(t, cap, safe), placed.schema)
        done.append(stored(final.unionByName(inner), "kept"))
        large = sizes.filter(f"NOT final AND n > {IN_TASK}")
        if large.isEmpty():
            break
        live = stored(placed.join(dealt(large), "component").filter("score > low").select("src", "dst", "score"), "scored")
    kept = functools.reduce(DataFrame.unionByName, done)
    named = kept.select("component", F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = start.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(dealt(named), "node", "left")
    return nodes.select("node", F.coalesce("component", "node").alias("component")), kept.select("src", "dst", "score")


def _cut_table(table: pa.Table, cap: int, safe: float) -> pa.Table:
    src, dst, score = (table.column(c).to_pylist() for c in ("src", "dst", "score"))
    rows = [(group, src[i], dst[i], score[i]) for group, i in cut_down(src, dst, score, cap, safe)]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["component", "src", "dst", "score"])


def cut_down(src: list[int], dst: list[int], score: list[float], cap: int, safe: float) -> list[tuple[int, int]]:
    """(group, number of the edge) for all edges that are left when groups above the cap lose their weakest edges.

    Edges join sets in descending order of score, which gives a tree of sets, each with the score at which it came
    about. From the top down a set that may stay is a group, known by its smallest node; else all its edges of that
    score go and its parts are looked at.
    """
    sets: list[tuple[float, int, list[int], list[int]]] = []  # score, number of nodes, parts that are sets, lone nodes
    parent: dict[int, int] = {}
    held: dict[int, int | None] = {}  # of a root its set, None for a lone node

    def root(x: int) -> int:
        if x not in parent:
            parent[x], held[x] = x, None
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = lambda x: 1 if held[x] is None else sets[held[x]][1]
    for i in sorted(range(len(src)), key=lambda i: -score[i]):
        a, b = root(src[i]), root(dst[i])
        if a != b:
            a, b = (b, a) if size(a) < size(b) else (a, b)
            sets.append((score[i], size(a) + size(b), [held[x] for x in (a, b) if held[x] is not None], [x for x in (a, b) if held[x] is None]))
            parent[b], held[a] = a, len(sets) - 1
    group: dict[int, tuple[int, float, float]] = {}  # of a node its group, the score up to which edges were lost, and the least one kept
    roots = [x for x in parent if parent[x] == x]
    group |= {x: (x, float("-inf"), float("-inf")) for x in roots if held[x] is None}  # only loops
    todo = [(held[x], float("-inf")) for x in roots if held[x] is not None]
    while todo:
        top, lost = todo.pop()
        level, n, *_ = sets[top]
        stays = n <= cap or (n <= round(1.33 * cap) and level >= safe)
        nodes, inner = [], [top]
        while inner:
            at, _, parts, lone = sets[inner.pop()]
            nodes += lone
            for part in parts:
                if stays or sets[part][0] == level:
                    inner.append(part)
                else:
                    todo.append((part, level))
        if stays:
            group |= dict.fromkeys(nodes, (min(nodes), lost, float("-inf") if n <= cap else safe))
        else:
            group |= {x: (x, level, float("-inf")) for x in nodes}
    out = []
    for i in range(len(src)):
        g = group.get(src[i])
        if g is not None and g == group.get(dst[i]) and score[i] > g[1] and score[i] >= g[2]:
            out.append((g[0], i))
    return out


def unary_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, head, depth) for every node (node: long): its place in the chain of unary edges that it lies on.

    An edge (src, dst) is unary if src has no other way out and dst no other way in; equal edges count once.
    A ring of unary edges is opened at its smallest node. Chains of length n take about log2(n) rounds.
    """
    once = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna().distinct()
    out = once.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("dst")).filter("n = 1").select("src", "dst")
    entered = once.groupBy("dst").agg(F.count("*").alias("n")).filter("n = 1").select("dst")
    unary = stored(out.join(dealt(entered), "dst", "left_semi").filter("src <> dst").select("src", "dst"), "unary")
    # a group of unary edges is a path, with one node that has no edge in, or a ring
    groups = connected_components(unary)
    rings = groups.join(dealt(unary), F.col("node") == F.col("dst"), "left").groupBy("component").agg(F.count_if(F.col("dst").isNull()).alias("heads")).filter("heads = 0")
    unary = unary.join(dealt(rings), F.col("dst") == F.col("component"), "left_anti")
    now = nodes.select(F.col("node").cast("long").alias("node")).distinct().join(dealt(unary), F.col("node") == F.col("dst"), "left")
    now = stored(now.select("node", F.coalesce("src", "node").alias("head"), F.col("src").isNotNull().cast("long").alias("depth")), "chains")
    while True:
        there = now.filter("depth > 0").select(F.col("node").alias("n"), F.col("head").alias("h"), F.col("depth").alias("d"))
        then = now.join(dealt(there), F.col("head") == F.col("n"), "left")
        then = stored(then.select("node", F.coalesce("h", "head").alias("head"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("h").isNotNull().alias("moved")), "chains")
        now = then.drop("moved")
        if then.filter("moved").isEmpty():
            return now


def compacted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains (head, n_nodes, cover) of nodes (node, cover: array) joined along unary edges, and the edges left between heads.

    A null cover counts as empty. A chain's cover is its nodes' covers in order, one row, as it is one segment.
    """
    place = unary_chains(nodes, edges)
    rows = nodes.select("node", "cover").join(dealt(place), "node")
    chains = rows.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("cover", F.array()).alias("cover")))).alias("parts"))
    chains = chains.select("head", F.size("parts").cast("long").alias("n_nodes"), F.flatten(F.transform("parts", lambda x: x["cover"])).alias("cover"))
    ends = lambda n, h, d: place.select(F.col("node").alias(n), F.col("head").alias(h), F.col("depth").alias(d))
    held = edges.select("src", "dst").distinct().join(dealt(ends("src", "src_head", "d")), "src").join(dealt(ends("dst", "dst_head", "e")), "dst")
    inner = (F.col("src_head") == F.col("dst_head")) & (F.col("e") == F.col("d") + 1)
    return chains, held.filter(~inner).select(F.col("src_head").alias("src"), F.col("dst_head").alias("dst")).distinct()
