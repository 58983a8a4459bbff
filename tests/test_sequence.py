"""Hand-traced vectors of the sequence functions, and graph rounds against plain loops."""

import collections
import random

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions import tails
from strandloom.operators import kmers, numeric
from strandloom.plans.graph import capped_components, compacted, connected_components, resolved, signed_components, unary_chains
from strandloom.sources.formats import read_contigs, read_edges, read_group_round_trip, read_read_map, read_segments, write_edges, write_segments


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_kmer_codes(spark):
    assert one(spark, F.transform(S.kmers(F.lit("ACGTAC"), 4), S.kmer_code)) == [27, 108, 177]
    assert one(spark, F.transform(S.kmers(F.lit("AC"), 4), S.kmer_code)) == [1]


def test_codes_and_consensus(spark):
    assert one(spark, S.encoded(F.lit("acNT"))) == "01N3"
    assert one(spark, S.undefined(F.lit("acNT"))) == 1
    assert one(spark, S.consensus(*map(F.lit, (0, 3, 1, 0)))) == "C"
    assert one(spark, S.consensus(*map(F.lit, (2, 2, 0, 0)))) == "A"
    assert one(spark, S.count_limit(F.lit(24), 4, 0.05, 2)) == 2
    assert one(spark, S.strand(F.lit(-1), F.lit(-2))[1]) == 1


def test_dovetail(spark):
    assert tuple(one(spark, S.dovetail(F.lit("AAACGT"), F.lit("CGTTTT"), 3, 5, 0.0))) == (3, 0)


def test_polya():
    assert numeric.polya("CCGGAAAAA", 4, 0) == (5, 0)
    assert numeric.polya("CCGGGAAAA", 4, 0) == (0, 0)
    assert numeric.polya("AAAA", 4, 0) == (4, 0)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[101] == 100
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 20)], "node long, parent long")
    assert {r.root for r in resolved(chain).collect()} == {1}


def test_prefix_suffix(spark):
    """The vectors traced by hand, and all pairs of short words against a plain loop."""
    hit = lambda a, b, lo, hi: one(spark, S.prefix_suffix(F.lit(a), F.lit(b), lo, hi, 0.0))
    assert tuple(hit("CGTAA", "TTCGT", 3, 5)) == (2, 3, 0)
    assert tuple(hit("ACG", "ACG", 3, 3)) == (0, -3, 0)
    assert hit("AAAA", "CCCC", 2, 4) is None
    words = ["ACGTA", "TACGG", "CCGTA", "GGGTT", "AACCC", "ACG", "CGTAC"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in rows.withColumn("x", S.prefix_suffix(F.col("a"), F.col("b"), 2, 4, 0.0)).collect():
        want = None
        for b, sign in ((r.b, 1), (r.b[::-1].translate(str.maketrans("ACGT", "TGCA")), -1)):
            for way in (1, -1):
                for n in range(2, min(4, len(r.a), len(b)) + 1):
                    if (r.a[:n] == b[-n:]) if way == 1 else (r.a[-n:] == b[:n]):
                        if not want or want[0] == 0:
                            want = (sign * (len(b) - n), way * n, 0)
                        break
        assert (tuple(r.x) if r.x else None) == want, r


def test_signed_components(spark):
    rows = [(1, 2, -1), (2, 3, -1), (3, 4, 1), (4, 9, -1), (20, 21, 1), (21, 22, 1), (20, 22, -1), (30, 30, 1), (None, 5, 1)]
    got = {r.node: (r.root, r.strand, r.conflict) for r in signed_components(spark.createDataFrame(rows, "src long, dst long, sign int")).collect()}
    assert got == {1: (1, 1, False), 2: (1, -1, False), 3: (1, 1, False), 4: (1, 1, False), 9: (1, -1, False), 20: (20, 1, True), 21: (20, 1, True), 22: (20, 1, True), 30: (30, 1, False)}


def test_capped_components(spark):
    rows = [(i, i + 1, 10 if i % 4 == 0 else 60) for i in range(1, 12)] + [(50, 51, 1)]
    got = {r.node: r.component for r in capped_components(spark.createDataFrame(rows, "src long, dst long, score int"), 6).collect()}
    assert got == {i: (i - 1) // 4 * 4 + 1 for i in range(1, 13)} | {50: 50, 51: 50}


def test_contigs_and_segments(spark, tmp_path):
    counts = ["1 0 0 0", "0 2 0 0", "0 0 3 0", "0 0 0 4"]
    (tmp_path / "x.cntg").write_text("\n".join([">c v1 7 5 9", "ACGT", *counts, ">c v1 8 1 2", "ACGT", *counts]) + "\n")
    rows = read_contigs(spark, str(tmp_path / "x.cntg")).orderBy("cntg_id").collect()
    assert [(r.cntg_id, r.n_valid, r.n_total, r.seq, r.depth) for r in rows] == [(7, 5, 9, "ACGT", 2.5), (8, 1, 2, "ACGT", 2.5)]
    segments = read_contigs(spark, str(tmp_path / "x.cntg")).selectExpr("cntg_id as seg_id", "1 as group_id", "seq", "cov")
    write_segments(segments, str(tmp_path / "s"))
    back = read_segments(spark, str(tmp_path / "s")).orderBy("seg_id").collect()
    assert [(r.seg_id, r.group_id, r.len, r.seq, r.cov) for r in back] == [(7, 1, 4, "ACGT", rows[0].cov), (8, 1, 4, "ACGT", rows[0].cov)]


def test_read_map(spark, tmp_path):
    path = tmp_path / "a.rcmap"
    path.write_text("3\n0\n1 -1\n2\n1 3\n\n2 0\n9 9\n")
    contigs, reads = read_read_map(spark, str(path))
    assert sorted(map(tuple, contigs.collect())) == [(1, 0), (2, 1), (3, -1)]
    assert sorted(map(tuple, reads.collect())) == [(1, 1, 3), (2, 2, 0)]
    many = tmp_path / "b.rcmap"
    many.write_text("0\n4000\n" + "".join(f"{i}\n{i + 7}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_read_map(spark, str(many))[1].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, rows)) == [(i + 1, i, i + 7) for i in range(4000)]


def test_headed_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "from_seg long, to_seg long")
    write_edges(edges, str(tmp_path / "e"), 3, 1, 2, 2)
    parts = sorted((tmp_path / "e").glob("part-*"))
    assert "".join(x.read_text() for x in parts).splitlines()[0] == "3 1 2 2"
    assert sorted(map(tuple, read_edges(spark, str(tmp_path / "e")).collect())) == [(1, 2), (2, 3)]
    groups = spark.createDataFrame([(1, 4, 0), (2, 4, 5)], "read_id long, group1 long, group2 long")
    assert sorted(map(tuple, read_group_round_trip(groups).collect())) == [(1, 4, 0), (2, 4, 5)]


def test_unary_chains(spark):
    # a path of 5, a branch at its end, a ring of 3, a node alone, a loop
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (5, 7), (21, 22), (22, 23), (23, 21), (40, 40)]
    nodes = [(i, [i]) for i in (1, 2, 3, 4, 5, 6, 7, 21, 22, 23, 30, 40)]
    e, n = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "node long, cover array<long>")
    assert {r.node: (r["head"], r.depth) for r in unary_chains(n, e).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 4), 6: (6, 0), 7: (7, 0), 21: (21, 0), 22: (21, 1), 23: (21, 2), 30: (30, 0), 40: (40, 0)}
    chains, left = compacted(n, e)
    assert {r["head"]: r.cover for r in chains.collect()} == {1: [1, 2, 3, 4, 5], 6: [6], 7: [7], 21: [21, 22, 23], 30: [30], 40: [40]}
    assert sorted(map(tuple, left.collect())) == [(1, 6), (1, 7), (21, 21), (40, 40)]
    assert unary_chains(n.limit(0), e.limit(0)).count() == 0


def test_kmers_counted_in_place(spark):
    """Counts within each sequence and on both strands as loops have them, without dealing any k-mer."""
    rng = random.Random(11)
    rows = [(i, "".join(rng.choices("ACGT", k=rng.choice([8, 9, 40, 700])))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, seq string").coalesce(1)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    own = lambda s: [s[i : i + 8] for i in range(len(s) - 7)]
    code = lambda w: int(w.translate(str.maketrans("ACGT", "0123")), 4)
    out = kmers.counted(df)
    assert {(r.doc_id, r.code): r.n for r in out.collect()} == {(i, code(w)): n for i, s in rows for w, n in collections.Counter(own(s)).items()}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    both = kmers.strand_counts(df.withColumnRenamed("doc_id", "id"))
    assert {tuple(r) for r in both.collect()} == {(i, len(set(own(s))), len(set(own(s)) | set(own(turn(s))))) for i, s in rows}


def test_tail_beyond_the_near_letters(spark):
    """A run that goes on behind the letters that are read first counts as a whole, and one that ends there stays."""
    for n in (tails.NEAR - 1, tails.NEAR, tails.NEAR + 1, 3 * tails.NEAR):
        for rest in ("", "CGCGCGCGCGCGCGCGCG"):
            got = spark.range(1).select(tails.fuzzy_run(F.lit("A" * n + rest), "A", 3, 0.0).alias("f")).first().f
            assert got == n
