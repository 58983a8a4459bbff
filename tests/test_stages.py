"""Contigs of a file to transcripts, end to end, and the numbering of rows."""

import random

from pyspark.sql import functions as F

from strandloom import __main__ as command
from strandloom import stages
from strandloom.operators import merging
from strandloom.plans.numbering import numbered
from strandloom.sources import formats

TURN = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x.translate(TURN)[::-1]


def test_end_to_end(spark, tmp_path):
    """A gene with an exon that one form lacks, on mixed strands, and another gene, from contigs that were cut out of them."""
    r = random.Random(21)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    one, two, three, other = letters(220), letters(130), letters(240), letters(400)
    long, short = one + two + three, one + three
    # the short form's junction as a contig of its own, the rest in overlapping pieces
    pieces = [(long[i : i + 160], 6) for i in range(0, len(long) - 100, 90)] + [(short[140:300], 3)] + [(other[i : i + 150], 4) for i in range(0, 300, 100)] + [(other[30:110], 2), ("ACGT" * 3, 1)]
    records = []
    for i, (seq, depth) in enumerate(pieces, 1):
        seq = rc(seq) if i % 3 == 0 else seq
        records += [f">Contig v1 {i} 1 1", seq, *(" ".join(str(depth * (c == b)) for c in seq) for b in "ACGT")]
    (tmp_path / "x.cntg").write_text("\n".join(records) + "\n")
    (tmp_path / "x.par").write_text("NOMINAL_READ_LENGTH 76\nNORM_DIST_THRESHOLD 0.05\nMIN_TRANSCRIPT_LENGTH 150\nMIN_TLEN_PERCENT_WRT_MAX 10\n")
    command.main(["--log", str(tmp_path / "log"), "assemble", str(tmp_path / "x.cntg"), str(tmp_path / "out"), str(tmp_path / "x.par")])
    segments = {x.seg_id: x for x in formats.read_segments(spark, str(tmp_path / "out" / "segments")).collect()}
    edges = {(e.from_seg, e.to_seg) for e in formats.read_edges(spark, str(tmp_path / "out" / "edges")).collect()}
    assert sorted(segments) == list(range(1, len(segments) + 1)) and edges and all(a in segments and b in segments for a, b in edges)
    assert all(len(s.seq) == s.len == len(s.cov) for s in segments.values())
    found = [t.seq for t in formats.read_transcripts(spark, str(tmp_path / "out" / "transcripts")).collect()]
    # both forms of the one gene and what was covered of the other, on either strand
    assert {min(x, rc(x)) for x in found} == {min(x, rc(x)) for x in (long, short, other[:350])} and len(found) == 3
    log = (tmp_path / "log").read_text()
    assert f"segments: {len(segments)}" in log and f"edges: {len(edges)}" in log


def test_cut_tails(spark):
    rows = [(1, "CCGG" * 5 + "A" * 9), (2, "T" * 9 + "CCGA" * 5), (3, "ACGTC" * 5), (4, "A" * 30), (5, "T" * 8 + "CCGG" * 5 + "A" * 9), (6, "ACG")]
    df = spark.createDataFrame(rows, "id long, seq string").withColumn("cover", merging.once(F.col("seq")))
    first = {r.id: r for r in stages.cut_tails(df, 3, 0.0).collect()}
    assert first[1].seq == "CCGG" * 5 + "AAA" and first[2].seq == rc("TTT" + "CCGA" * 5) and first[3].seq == rows[2][1] and 4 not in first and 6 not in first
    assert all("".join("ACGT"[list(x).index(1)] for x in r.cover) == r.seq for r in first.values())
    later = {r.id: r.seq for r in stages.cut_tails(df, 3, 0.0, True).collect()}
    assert later[5] == "TTT" + "CCGG" * 5 + "AAA" and later[2] == "TTT" + "CCGA" * 5


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x long").repartition(7)
    got = [(r.x, r.n) for r in numbered(df, ["x"], "n").orderBy("n").collect()]
    assert got == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), ["x"], "n").count() == 0
