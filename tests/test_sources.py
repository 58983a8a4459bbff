"""Files: FASTQ with any quality letters, transcripts by threshold, settings, the command line, the shared folder."""

import pytest

from strandloom import __main__ as command
from strandloom import evaluate
from strandloom.plans.graph import resolved
from strandloom.sources import config, formats


def test_fastq(spark, tmp_path):
    for mate in (1, 2):
        (tmp_path / f"r{mate}.fastq").write_text(f"@r1/{mate}\nACGT\n+\n@@II\n@r2/{mate}\nGG\n+r2\n+@\n")
    rows = formats.read_fastq(spark, str(tmp_path / "r1.fastq")).orderBy("read_id").collect()
    assert [tuple(r) for r in rows] == [(0, "r1/1", "ACGT", "@@II"), (1, "r2/1", "GG", "+@")]
    pairs = formats.read_fastq_pairs(spark, str(tmp_path / "r1.fastq"), str(tmp_path / "r2.fastq"))
    assert pairs.filter("read_id = 1 and mate = 2").first().name == "r2/2" and pairs.count() == 4
    assert formats.file_kind(spark, str(tmp_path / "r1.fastq")) == "fastq" and formats.line_count(spark, str(tmp_path / "r1.fastq")) == 8


def test_fastq_over_splits(spark, tmp_path):
    text = "".join(f"@read{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@' * (4 * (i % 7 + 1))}\n" for i in range(500))
    (tmp_path / "long.fastq").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = formats.read_fastq(spark, str(tmp_path / "long.fastq"))
        assert spark.read.text(str(tmp_path / "long.fastq")).rdd.getNumPartitions() > 1
        got = {r.name: (r.seq, r.qual) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"read{i}": ("ACGT" * (i % 7 + 1), "@" * (4 * (i % 7 + 1))) for i in range(500)}


def test_transcripts(spark, tmp_path):
    path = tmp_path / "t.fasta"
    path.write_text(">t1 5 2 999 3.5 10 7 100\nACGT\n>t2 6 2 1 0.5 1 1 1\nAC\nGG\nTT\n>t3 1 1 1 9 1 1 1\n")
    rows = formats.read_transcripts(spark, str(path))
    assert [(r.name, r.len, r.abn) for r in rows.orderBy("name").collect()] == [("t1", 4, 3.5), ("t2", 6, 0.5)]
    assert tuple(formats.fasta_counts(spark, str(path), 5).first()) == (3, 1)
    command.main(["--log", str(tmp_path / "log"), "filter", str(path), str(tmp_path / "out"), "--thresholds", "0,2,4"])
    back = formats.read_transcripts(spark, str(tmp_path / "out" / "MinCvgDepth=2")).collect()
    assert [(r.name, r.idx, r.len, r.seq) for r in back] == [("t1", 5, 4, "ACGT")] and not (tmp_path / "out" / "MinCvgDepth=4").exists()


def test_evaluation(spark, tmp_path):
    hit = lambda q, s, n: "\t".join(map(str, (q, s, 400, n, 500, 1, n, 1, n, n, 0, 0, 90, 90, 500)))
    # a known name ends in share, depth, rate; an estimate's in group size, depth, rate, share of its group
    known, found = "ref:95.0:7.5:40.0", "asm_12_3.5_41.2_0.7"
    rows = [hit(known, found, 390), hit(known, "asm_1_9_5_3", 350), hit("r:2:1", "asm_1_9_5_3", 340), hit("u:1:1", "v_1_1_1", 100), hit("bare", "x_2_y_3_4", 400)]
    (tmp_path / "h.tblst").write_text("\n".join(rows) + "\n")
    hits = formats.read_hits(spark, str(tmp_path / "h.tblst"))
    best = {r.qid: r for r in evaluate.with_names(evaluate.best_hits(hits)).collect()}
    r = best[known]
    assert r.sid == found and (r.true_rpkm, r.true_abn, r.exp_cvg) == (40.0, 7.5, 95.0) and (r.iso, r.est_rpkm, r.est_abn, r.grp) == (1.0, 41.2, 3.5, 12.0)
    assert (r.alen, r.qcvg, r.scvg) == (390, 0.975, 0.78) and set(best) == {known, "bare"}
    assert (best["bare"].true_rpkm, best["bare"].est_rpkm, best["bare"].grp) == (0, 0, 0)
    (tmp_path / "t.fasta").write_text(">a\n" + "ACGT" * 100 + "\n>b\nACGT\n")
    command.main(["evaluate", str(tmp_path / "h.tblst"), str(tmp_path / "matches"), "--transcripts", str(tmp_path / "t.fasta")])
    back = spark.read.csv(str(tmp_path / "matches"), sep="\t", header=True)
    assert back.columns == formats.MATCH_COLUMNS and {x.true_rpkm for x in back.collect()} == {"40.0", "0.0"}
    assert spark.read.text(str(tmp_path / "matches.count")).first()[0] == "@ 1"


def test_fit(spark):
    """The fit is linear in the rates as they are."""
    rows = [(float(x), 2.0 * x + (x % 3), 0.85 if x % 2 else 0.97) for x in range(40)]
    got = {r.share: r for r in evaluate.recovered(spark.createDataFrame(rows, "true_rpkm double, est_rpkm double, qcvg double")).collect()}
    assert {k: r.n for k, r in got.items()} == {0.8: 40, 0.9: 20, 0.95: 20}
    mx, my = (sum(r[i] for r in rows) / 40 for i in (0, 1))
    sxy, sxx, syy = (sum((r[i] - m) * (r[j] - k) for r in rows) for i, m, j, k in ((0, mx, 1, my), (0, mx, 0, mx), (1, my, 1, my)))
    assert abs(got[0.8].r2 - sxy**2 / sxx / syy) < 1e-9


def test_config(spark, tmp_path):
    path = tmp_path / "a.par"
    path.write_text("NOMINAL_READ_LENGTH 76 # rl\nUNKNOWN 3\nNORM_DIST_THRESHOLD 0.05\nSYSTEM_MEMORY_SIZE_GB 8\nINPUT_FILE_PAIRED_2 b.fq\n")
    c = config.read_config(spark, str(path))
    assert (c.norm_dist_threshold, c.min_read_length, c.min_cntg_length_js, c.min_seg_length, c.min_tail_length) == (0.05, 46, 61, 52, 22)
    assert (c.proc_unit_size, c.max_pipeline, c.mean_frag_length, c.paired, c.lasso_step_size) == (7500, 30000, 228, True, 0.5 / 400)
    with pytest.raises(ValueError):
        config.parse_config("MIN_READ_LENGTH 3")


def test_rings(spark):
    """A ring of three never settles; what leads into it resolves to null, like a pointer to nowhere."""
    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 5), (7, 99), (8, 0)]
    got = {r.node: r.root for r in resolved(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: 5, 6: 5, 7: None, 8: 8}


def test_shared_folder():
    """On a cluster without a shared folder nothing is written to a local one."""
    from types import SimpleNamespace

    from strandloom.plans.storage import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session)
