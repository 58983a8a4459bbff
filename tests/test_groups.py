"""Groups cut down to a cap against the rounds that define them."""

import random

import pytest

from strandloom.plans import graph


def components(edges):
    of = {}
    for a, b, _ in edges:
        of.setdefault(a, {a})
        of.setdefault(b, {b})
        if of[a] is not of[b]:
            both = of[a] | of[b]
            of.update(dict.fromkeys(both, both))
    return {min(s): s for s in of.values()}, of


def expected(edges, cap, safe):
    """Round after round, as stated."""
    live = list(edges)
    while True:
        groups, of = components(live)
        low = {}
        for a, _, s in live:
            k = min(of[a])
            low[k] = min(low.get(k, s), s)
        weak = {k for k, s in groups.items() if len(s) > cap and (low[k] < safe or len(s) > round(1.33 * cap))}
        if not weak:
            break
        live = [(a, b, s) for a, b, s in live if min(of[a]) not in weak or s > low[min(of[a])]]
    named = {x: k for k, s in groups.items() for x in s}
    return {(x, named.get(x, x)) for a, b, _ in edges for x in (a, b)}, sorted(live)


def drawn(seed, nodes, n, scores):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes), float(r.choice(scores))) for _ in range(n)]


CASES = [drawn(1, 60, 90, range(100)), drawn(2, 200, 150, [10, 20, 60]), drawn(3, 30, 200, [49, 50, 51]), drawn(4, 40, 40, [5]), drawn(5, 120, 130, [60, 70, 80]), drawn(6, 80, 100, [0, 55, 56, 57])]


@pytest.mark.parametrize("edges", CASES)
@pytest.mark.parametrize("cap, safe", [(4, 50), (10, 50), (30, 0)])
def test_cut_down_in_one_task(edges, cap, safe):
    groups, live = expected(edges, cap, safe)
    got = graph.cut_down(*map(list, zip(*edges)), cap, safe)
    assert sorted(edges[i] for _, i in got) == live
    assert {(x, g) for g, i in got for x in edges[i][:2]} == {(x, g) for x, g in groups if any(x in e[:2] for e in live)}


@pytest.mark.parametrize("in_task", [1 << 20, 30])
def test_pruned(spark, monkeypatch, in_task):
    monkeypatch.setattr(graph, "IN_TASK", in_task)
    edges = CASES[1] + [(a + 1000, b + 1000, s) for a, b, s in CASES[5]]
    groups, live = expected(edges, 10, 50)
    nodes, kept = graph.pruned(spark.createDataFrame(edges, "src long, dst long, score double"), 10, 50)
    assert {tuple(r) for r in nodes.collect()} == groups and sorted(map(tuple, kept.collect())) == live


def test_no_edges(spark):
    nodes, kept = graph.pruned(spark.createDataFrame([], "src long, dst long, score double"))
    assert nodes.count() == kept.count() == 0


def test_nothing_is_sent_through_the_driver(spark):
    """Tables of nodes and groups are joined by exchanges: a session that broadcasts no more than 100 bytes gives the same groups."""
    edges = spark.createDataFrame([(i, i // 2, float(i % 4)) for i in range(2, 2000)], "src long, dst long, score double")
    name = "spark.sql.maxBroadcastTableSize"
    want = {(r.node, r.component) for r in graph.capped_components(edges, 40, 2).collect()}
    spark.conf.set(name, "100b")
    try:
        got = {(r.node, r.component) for r in graph.capped_components(edges, 40, 2).collect()}
    finally:
        spark.conf.unset(name)
    assert got == want and len(want) == 1999
