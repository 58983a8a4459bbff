"""Fuzzy joins, junctions, merging and positions against plain loops on small random sequences."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions import tails
from strandloom.operators import merging, numeric
from strandloom.operators import overlaps as O

TURN = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x.translate(TURN)[::-1]


def limit(n):
    return int(n * 0.05 + 0.5)


def wrong(x, y):
    return sum(a != b for a, b in zip(x, y))


@pytest.fixture(scope="module")
def words():
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))

    def changed(x, k):
        x = list(x)
        for i in r.sample(range(len(x)), k):
            x[i] = r.choice("ACGT")
        return "".join(x)

    base = letters(600)
    out = [changed(base[i : i + 100], r.randrange(5)) for i in range(0, 500, 37)]
    out += [rc(changed(base[i : i + 90], 3)) for i in range(20, 480, 61)]
    out += [changed(out[0], k) for k in (1, 3, 5, 9)] + [base[130:175], rc(changed(base[300:352], 2)), "A" * 60, "A" * 60 + letters(40)]
    return list(dict.fromkeys(out))


@pytest.fixture(scope="module")
def seqs(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "id long, seq string")


def test_contigs(spark):
    rows = [(i, "ACGT" * n) for i, n in enumerate((10, 30, 39, 40, 70))]
    got = {}
    for r in O.contigs(spark.createDataFrame(rows, "doc_id long, seq string")).orderBy("id").collect():
        got.setdefault(r.doc_id, []).append(r.seq)
    assert all("".join(got[i]) == s for i, s in rows) and all(40 <= len(x) < 160 for v in got.values() for x in v)


def test_hamming_pairs(seqs, words):
    want = {(a, b, wrong(words[a], words[b])) for b in range(len(words)) for a in range(b) if len(words[a]) == len(words[b]) and wrong(words[a], words[b]) <= limit(len(words[a]))}
    assert {tuple(r) for r in O.hamming_pairs(seqs).collect()} == want and len(want) > 3


def test_end_candidates(seqs, words):
    kmers = lambda x: {x[i : i + 8] for i in range(len(x) - 7)}
    shared = lambda a, b: len(kmers(words[a][-40:]) & kmers(words[b][:40]))
    want = {(a, b, shared(a, b)) for a in range(len(words)) for b in range(len(words)) if a != b and shared(a, b) >= 12}
    assert {tuple(r) for r in O.end_candidates(seqs, 12).collect()} == want and want


def test_dovetails(seqs, words):
    def least(x, y):
        for n in range(24, min(len(x), len(y), 119) + 1):
            if wrong(x[-n:], y[:n]) <= limit(n):
                return n, wrong(x[-n:], y[:n])

    want = set()
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            if a != b:
                for mode, hit in ((2, least(x, y)), (1, least(y, x)), (-2, least(x, rc(y))), (-1, least(rc(y), x))):
                    if hit:
                        want.add((a, b, mode, *hit))
    got = {tuple(r) for r in O.dovetails(seqs).collect()}
    assert got == want and {m for _, _, m, _, _ in want} == {1, 2, -1, -2}


def test_contained(spark, seqs, words):
    want = set()
    for p, x in enumerate(words):
        for i, y in enumerate(words):
            if p != i and len(y) > len(x):
                at = [(k, wrong(x, y[k : k + len(x)])) for k in range(len(y) - len(x) + 1)]
                at = [(k + 1, d) for k, d in at if d <= limit(len(x))]
                back = [(-k - 1, wrong(rc(x), y[k : k + len(x)])) for k in range(len(y) - len(x) + 1)]
                back = [(k, d) for k, d in back if d <= limit(len(x))]
                if at or back:
                    want.add((p, i, *(at or back)[0]))
    assert {tuple(r) for r in O.contained(seqs, seqs).collect()} == want and {k > 0 for _, _, k, _ in want} == {True, False}


def plain_junction(s1, s2, head, least, most, share, enough, both):
    """The search letter by letter."""

    def run(x, y):
        last, dist, acc = 0, 10000, 0
        for k, (a, b) in enumerate(zip(x, y)):
            if a == b:
                last, dist = k, acc
            else:
                acc += 1
                if acc > int(max(k, least) * share + 0.5):
                    break
        return last, dist

    n = min(most, len(s1), len(s2))
    end = s2[:n] if head else s2[-n:]
    turns = [("on", 1 if head else 4)] * (head or both) + [("back", 3 if head else 2)] * ((not head) or both)
    for inside in (True, False):
        if not inside and n < least:
            continue
        for way, mode in turns:
            best = (-1, 0, 0)
            starts = range(len(s1) - n + 1) if inside else range(n - least + 1)
            for k in starts:
                if way == "on":
                    text = s1[k : k + n] if inside else s1[len(s1) - least - k :]
                    found = run(text, end if head else rc(end))
                else:
                    text = s1[k : k + n] if inside else s1[: least + k]
                    found = run(text[::-1], (rc(end) if head else end)[::-1])
                if found[0] > best[0]:
                    best = (found[0], k, found[1])
                if found[0] > enough:
                    break
            depth, k, dist = best
            if depth >= least:
                if way == "on":
                    return (k + 1 if inside else len(s1) - least - k + 1), depth, mode, dist
                return (k + n - depth + 1 if inside else least - depth + k + 1), depth, mode, dist
    return 0, 0, 0, 10000


def test_junction(words):
    assert O.junction(b"TTTACGTACG", b"ACGTACGGGG", True, 4, 100, 0.0, 50) == (4, 6, 1, 0)
    seen = set()
    for x in words:
        for y in words:
            for head in (True, False):
                for both in (True, False):
                    got = O.junction(x.encode(), y.encode(), head, 20, 100, 0.05, 50, both)
                    assert got == plain_junction(x, y, head, 20, 100, 0.05, 50, both)
                    seen.add(got[2])
    assert seen == {0, 1, 2, 3, 4}


def test_boundary_rules(spark):
    rows = [(1, 2, 0, 10, 30, 1, 0), (1, 2, 0, 10, 30, 2, 0), (1, 2, 0, 1, 30, 1, 0), (2, 1, 0, 1, 30, 1, 0), (1, 2, 0, 150, 30, 1, 0), (1, 2, 0, 10, 8, 1, 0)]
    got = O.bounded(spark.createDataFrame(rows, O.JUNCTION), F.lit(2), F.lit(0), F.lit(1), F.lit(400), 144, 12).collect()
    assert [(r.ref_id, r.mode, r.bnd1, r.bnd2) for r in got] == [(1, 1, 10, 27), (1, 2, 22, 39), (2, 1, 1, 30)]


def test_tails(spark):
    r = random.Random(8)
    rows = [("".join(r.choice("AAAAACGT") for _ in range(n)) + "A" * r.randrange(9),) for n in range(0, 60)]
    for row in spark.createDataFrame(rows, "s string").withColumn("f", tails.fuzzy_run(F.reverse("s"), "A", 4, 0.1)).withColumn("b", tails.fuzzy_run(F.col("s"), "T", 4, 0.1)).collect():
        assert (row.f, row.b) == numeric.polya(row.s, 4, 0.1)
    cut = lambda s, **k: spark.range(1).select(tails.trimmed(F.lit(s), 3, 0.0, **k).alias("x")).first().x
    assert cut("CCGGAAAAAA") == "CCGGAAA" and cut("TTTTTGCC") == "GGCAAA" and cut("AAAAA") is None and cut("ACGTC") == "ACGTC"
    assert cut("TTTTTGCCAAAAA", both=True, turn=False) == "TTTGCCAAA"


def test_lasso():
    import numpy as np

    x, error = numeric.lasso(np.array([2.0]), np.array([[1.0]]), 1.0, 0.0, 0.25, 1)
    assert (x[0], error) == (1.0, 4.0)
    x, error = numeric.lasso(np.array([2.0]), np.array([[1.0]]), 1.0, 0.0, 0.25, 2)
    assert (x[0], error) == (1.5, 1.0)
    # a first step that overshoots halves the step: 2 -> error 36 after 4 at x = 0
    x, _ = numeric.lasso(np.array([2.0]), np.array([[1.0]]), 1.0, 0.0, 2.0, 2)
    assert x[0] == 0.0  # 8 - 1 * 12, clamped


def plain_assembly(words, both):
    """Rounds of mutually best overlaps on lists; a sequence is (letters, counts by position)."""
    start = lambda x: [tuple(int(c == b) for b in "ACGT") for c in x]
    flip = lambda c: [x[::-1] for x in c[::-1]]
    letters = lambda c: "".join("ACGT"[x.index(max(x))] for x in c)
    now = {i: start(x) for i, x in enumerate(words)}
    while True:
        nodes = {(i, t): flip(c) if t else c for i, c in now.items() for t in ((0, 1) if both else (0,))}
        text = {k: letters(c) for k, c in nodes.items()}
        edges = {}
        for u, x in text.items():
            for v, y in text.items():
                if u[0] != v[0]:
                    for n in range(24, min(len(x), len(y), 119) + 1):
                        if wrong(x[-n:], y[:n]) <= limit(n):
                            edges[u, v] = (wrong(x[-n:], y[:n]) * 76 - n, n)
                            break
        out, into = {}, {}
        for (u, v), (score, _) in edges.items():
            out[u] = min(out.get(u, ((1 << 60,), None)), ((score, v[0], v[1]), v))
            into[v] = min(into.get(v, ((1 << 60,), None)), ((score, u[0], -u[1]), u))
        links = {u: v for u, (_, v) in out.items() if into[v][1] == u}
        if not links:
            return {i: (letters(c), c) for i, c in now.items()}
        after, seen = {}, set()
        for name in sorted(now):
            if name in seen:
                continue
            back = {v: u for u, v in links.items()}
            head = (name, 0)
            while head in back and back[head] != (name, 0):
                head = back[head]
            if head in back:
                head = (name, 0)  # a ring
            chain = [head]
            while chain[-1] in links and links[chain[-1]] != head:
                chain.append(links[chain[-1]])
            seen |= {i for i, _ in chain}
            total, at = [], 0
            for k, u in enumerate(chain):
                at = at + len(nodes[chain[k - 1]]) - edges[chain[k - 1], u][1] if k else 0
                for j, c in enumerate(nodes[u]):
                    if at + j < len(total):
                        total[at + j] = tuple(a + b for a, b in zip(total[at + j], c))
                    else:
                        total.append(c)
            after[name] = total
        now = after


@pytest.mark.parametrize("both", [True, False])
def test_assembled(spark, both):
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    bases = [letters(400), letters(260)]
    rows = [b[i : i + 100] for b in bases for i in range(0, len(b) - 60, 63)]
    rows = [rc(x) if r.random() < 0.4 else x for x in rows]
    r.shuffle(rows)
    ring = letters(200)
    rows += [ring[:110], ring[70:180], ring[150:] + ring[:50], letters(70)]
    want = plain_assembly(rows, both)
    got = {x.id: x for x in merging.assembled(spark.createDataFrame(list(enumerate(rows)), "id long, seq string"), both_strands=both).collect()}
    assert {i: (x.seq, [tuple(c) for c in x.cover]) for i, x in got.items()} == {i: (x, [tuple(c) for c in y]) for i, (x, y) in want.items()}
    if both:
        assert len(want) <= 6 and max(len(x) for x, _ in want.values()) >= 380


def test_joined(spark, words):
    r = random.Random(3)
    base = "".join(r.choice("ACGT") for _ in range(300))
    rows = [(1, base[:120]), (2, base[80:200]), (3, base[160:300]), (9, base[5:90][::-1])]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {r.id: r for r in merging.assembled(df).collect()}
    assert got[1].seq == base and set(got) == {1, 9} and got[9].seq == rows[3][1]
    assert sum(got[1].cover[100]) == 2 and sum(got[1].cover[0]) == 1
    none = F.lit(None).cast("array<struct<a:int,c:int,g:int,t:int>>")
    df = spark.createDataFrame([(1, base[:120]), (2, base[30:60]), (3, rc(base[50:90]))], "id long, seq string").withColumn("cover", none)
    hits = spark.createDataFrame([(2, 1, 31), (3, 1, -51)], "probe_id long, id long, pos long")
    got = merging.absorbed(df, hits).collect()
    assert len(got) == 1 and got[0].seq == base[:120] and sum(got[0].cover[55]) == 3 and got[0].n == 3


def test_whole_candidates(spark):
    """Against a loop over all pairs: parts, turned and changed ones, repeats, equal lengths, short and empty ones."""
    rng = random.Random(11)
    base = ["".join(rng.choices("ACGT", k=200)) for _ in range(4)] + ["A" * 150, "ACGTACGTAA" * 14]
    seqs = base + [base[0][30:110], rc(base[1][5:90]), base[2][:100] + "G" + base[2][101:], "A" * 60, "A" * 60 + "C" * 20, "ACGTACGTAA" * 6, "ACG", "", base[3]]
    seqs += [s[:70] + rng.choice("ACGT") + s[71:] for s in base[:3]]
    rows = list(enumerate(seqs))

    def need(n):
        return int(max((n - 4) / 4 - -(-n * 5 // 100) * 2, 2) + 0.5)

    want = set()
    for a, s in rows:
        picked = [s[i : i + 8] for i in range(0, len(s) - 7, 4)]
        for b, t in rows:
            if len(t) > len(s) or (len(t) == len(s) and b < a):
                held = {x[i : i + 8] for x in (t, rc(t)) for i in range(len(x) - 7)}
                n = sum(x in held for x in picked)
                if n >= need(len(s)):
                    want.add((a, b, n))
    assert len(want) > 8
    for common in (1, 3, 50):
        got = O.whole_candidates(spark.createDataFrame(rows, "id long, seq string"), common=common)
        assert {tuple(r) for r in got.collect()} == want


def test_containment_deals_no_letters(spark, capsys):
    """What is dealt by stretches holds numbers only."""
    rows = spark.createDataFrame([(1, "ACGT" * 12), (2, "ACGT" * 30)], "id long, seq string")
    O.contained(rows, rows).explain("formatted")
    plan = capsys.readouterr().out
    inputs = [x.split("\n")[1] for x in plan.split("\n\n") if "Exchange\n" in x and "hashpartitioning(key" in x]
    assert len(inputs) == 2 and not any("sb#" in x or "seq#" in x for x in inputs)


def test_overlaps_of_few_letters():
    """Seeds of overlaps hold as many letters as fit, within the shortest overlap of each number of mismatches."""
    for shortest, longest, share in ((24, 119, 0.05), (1, 30, 0.05), (3, 20, 0.3)):
        for low, _, d in O.limit_steps(shortest, longest, share):
            size, parts, exact = O.stretches(low, d)
            assert parts == d + exact and size * parts <= low and size == low // parts
            assert shortest < 24 or size * exact >= O.SELECTIVE


def test_overlaps_deal_few_places(spark, monkeypatch):
    """Of texts without overlaps hardly any place is dealt; it was one for each place and number of mismatches."""
    import random

    r, sizes, whole = random.Random(3), [], O.stored
    monkeypatch.setattr(O, "stored", lambda df, name: sizes.append((out := whole(df, name)).count()) or out)
    seqs = [("".join(r.choices("ACGT", k=120))) for _ in range(40)]
    seqs.append(seqs[0][-60:] + "".join(r.choices("ACGT", k=60)))
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    assert {tuple(x) for x in O.dovetails(rows).collect()} == {(0, 40, 2, 60, 0), (40, 0, 1, 60, 0)}
    assert 0 < sizes[0] < 1000


def test_end_candidates_of_long_lists(spark, monkeypatch, tmp_path):
    """A list that goes to several tasks, ends with other letters, short ones and rearranged ones give the pairs of a loop, and what meets is not dealt."""
    r = random.Random(11)
    letters = lambda n, of="ACGT": "".join(r.choice(of) for _ in range(n))
    base = letters(40)
    rows = [letters(30) + base[i % 5 :] + letters(i % 5) for i in range(60)] + [base[i % 4 :] + letters(30) for i in range(70)]
    rows += [base[:14] + base[26:] + base[13:25] + letters(20), letters(9) + base[20:] + base[:20], letters(60, "ACGTN"), "ACGTA", "AC" * 40, base.replace("A", "N"), base.replace("A", "N") * 2]
    rows = list(enumerate(rows))

    def has(x):
        return {x[i : i + 8] for i in range(max(len(x) - 7, 1))}

    want = {(a, b, n) for a, x in rows for b, y in rows if a != b and (n := len(has(x[-40:]) & has(y[:40]))) >= 20}
    monkeypatch.setattr(O, "LIST", 16)
    seqs = spark.createDataFrame(rows, "id long, seq string")
    found = O.end_candidates(seqs, 20)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want) and len(want) > 3000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_hamming_pairs_of_long_lists(spark):
    """Lists of over 1024 and over several batches, other letters, equal and empty sequences; what meets is not dealt."""
    r = random.Random(5)
    base = "".join(r.choice("ACGT") for _ in range(60))
    rows = [base[:i] + x + base[i + 1 :] for i in range(60) for x in "ACGTN"] * 4 + ["", "", "A", base[:59], base[:30] + "NNNN" + base[34:]]
    rows = list(enumerate(rows))
    want = {(a, b, n) for a, x in rows for b, y in rows if a < b and len(x) == len(y) and (n := wrong(x, y)) <= limit(len(x))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = O.hamming_pairs(spark.createDataFrame(rows, "id long, seq string"))
        got = [tuple(x) for x in found.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_end_overlaps_are_those_of_the_expression(spark, seqs, words):
    """Every pair of test sequences, short ones, other letters and overlaps of a whole one, on one strand and both."""
    more = [words[0][-30:], words[0][:26], rc(words[1][:28]), "ACG", "", words[2][:50] + "NN" + words[2][52:], "AC" * 30]
    rows = spark.createDataFrame([*enumerate([*words, *more])], "id long, seq string")
    pairs = rows.select(F.col("id").alias("a")).crossJoin(rows.select(F.col("id").alias("b"))).filter("a <> b")
    for both in (True, False):
        m = S.prefix_suffix(F.col("sa"), F.col("sb"), 24, 119, 0.05, both).alias("m")
        want = O.with_sequences(pairs, rows).select("a", "b", m).filter("m IS NOT NULL").select("a", "b", "m.pos", "m.dep", "m.dist")
        found = O.end_overlaps(pairs, rows, 24, 119, 0.05, both)
        want = {tuple(x) for x in want.collect()}
        assert {tuple(x) for x in found.collect()} == want and len(want) > 20


def test_overlaps_by_blocks(spark, words, monkeypatch):
    """Small blocks, parts that are halved, other letters, short and equal sequences and other limits give the pairs of a loop; neither places nor what meets is dealt."""
    monkeypatch.setattr(O.tiles, "BLOCK", 7)
    monkeypatch.setattr(O.tiles, "HELD", 40)
    more = [words[0][-50:] + "N" * 9, words[1][:40] + "NN" + words[1][42:], "N" * 50, "N" * 40 + "A", "ACG", "", "AC" * 40, "AC" * 40, words[3]]
    rows = [*enumerate([*words, *more])]
    table = spark.createDataFrame([(i, 0, x) for i, x in rows] + [(i, 1, rc(x)) for i, x in rows], "id long, turn int, seq string")
    for shortest, longest, share in ((24, 119, 0.05), (30, 60, 0.1), (20, 40, 0.0)):
        want = set()
        for i, x in rows:
            for j, y in rows:
                for p, q in ((0, 0), (0, 1), (1, 0)):
                    if i != j:
                        s, t = (rc(x) if p else x), (rc(y) if q else y)
                        hit = next(((n, wrong(s[-n:], t[:n])) for n in range(shortest, min(len(s), len(t), longest) + 1) if wrong(s[-n:], t[:n]) <= int(n * share + 0.5)), None)
                        want |= {(i, p, j, q, *hit)} if hit else set()
        found = O.tail_head(table, table, shortest, longest, share)
        assert sorted(tuple(x) for x in found.collect()) == sorted(want) and len(want) > 10
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_index_of_seeds(monkeypatch):
    """Every row of an equal seed is met, a few at a time."""
    import numpy as np

    monkeypatch.setattr(O.tiles, "AT_ONCE", 5)
    r = np.random.default_rng(2)
    seeds, asked = r.integers(0, 40, 300).astype(np.uint64), r.integers(0, 60, 200).astype(np.uint64)
    some = asked % np.uint64(3) > 0
    for which in (None, some):
        got = [x for t, h in O.tiles.Index(seeds, np.arange(300)).met(asked, which) for x in zip(t.tolist(), h.tolist(), strict=True)]
        assert sorted(got) == sorted((i, j) for i in range(200) for j in range(300) if asked[i] == seeds[j] and (which is None or some[i]))
    assert not list(O.tiles.Index(seeds[:0], np.arange(0)).met(asked))


def test_contained_by_blocks(spark, words, monkeypatch):
    """Small blocks, parts that are halved, other letters and equal lengths give what joins by stretches give; nothing is dealt for it."""
    monkeypatch.setattr(O.tiles, "BLOCK", 7)
    monkeypatch.setattr(O.tiles, "HELD", 5)
    more = [words[0][10:70], rc(words[0][5:66]), words[1][:40] + "N" + words[1][41:60], words[2][:30] + "NN" + words[2][32:], words[2][:30] + "NA" + words[2][32:70], "N" * 50, "N" * 45, "ACG", "", "AC" * 40, "AC" * 30]
    rows = spark.createDataFrame([*enumerate([*words, *more])], "id long, seq string")
    for both in (True, False):
        found = O.contained_by_blocks(rows, rows, both_strands=both)
        want = sorted(tuple(x) for x in O.contained(rows.filter("length(seq) >= 36"), rows, both_strands=both).collect())
        got = sorted(tuple(x) for x in found.collect() if len([*words, *more][x.probe_id]) >= 36)
        assert got == want and len(want) > 10
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
