"""Queries that follow contigs from their junctions to segments and transcripts, each on the tables of those before it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalog, evaluate, stages
from .operators import junctions as J
from .operators import alignment, merging, overlaps, transcripts
from .plans.storage import shared_dir, within
from .sources import counts, formats, records
from .sources.config import Config, defaults


def junction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All junctions of contigs with each other; equal contigs are one class. Not stored, as there are many times more of them than contigs."""
    rows = catalog.classes(spark, sf_dir)
    return J.table(J.searched(rows, rows), rows, rows)


def q54(spark, d):
    return junction_table(spark, d)


def long_contigs(spark, d):
    return catalog.spread(overlaps.distinct_sequences(overlaps.contigs(catalog.sequences(spark, d), 480, 160)))


def q58(spark, d):
    """Junctions of contigs of 480 letters, that are searched in two to four blocks, with the ends of their first kind."""
    rows = long_contigs(spark, d)
    return J.table(J.searched(rows, rows), rows, rows)


def pairs(spark, d):
    return J.best_pairs_together(junction_table(spark, d))


def q59(spark, d):
    return pairs(spark, d).select("ref_id", "tgt_id", "head_block", "tail_block", "head", "tail", "score")


def q60(spark, d):
    return J.connections(pairs(spark, d))


def covered(rows: DataFrame) -> DataFrame:
    """(id, seq, cover) of contig classes: each letter counted as often as there are copies."""
    deep = F.transform(merging.once(F.col("seq")), lambda x: F.struct(*[(x[b] * F.col("copies")).cast("int").alias(b) for b in "acgt"]))
    return rows.select("id", "seq", deep.alias("cover"))


SETTINGS = defaults(Config(76, norm_dist_threshold=0.05, min_tr_length=100))


def oriented(spark, d):
    """The contigs, turned, with their groups, and the junctions that stand."""
    rows = catalog.classes(spark, d)
    found = J.table(J.searched(rows, rows), rows, rows)
    return stages.oriented(covered(rows), found, SETTINGS, J.best_pairs_together(found))


def q61(spark, d):
    """Each contig's group of about 40 at most, and the strand that its connections give it."""
    return oriented(spark, d)[0].select(F.col("id").alias("node"), "grp", "strand", "conflict")


def q62(spark, d):
    """The standing junctions on turned contigs."""
    return oriented(spark, d)[1]


def laid(spark, d):
    return stages.laid(*oriented(spark, d))


def q63(spark, d):
    """How many positions are joined with others, stand alone, or had an equality left out, in each group of several contigs."""
    rows = laid(spark, d)
    size = Window.partitionBy("cls_seq", "cls_pos")
    rows = rows.withColumn("n", F.count("*").over(size)).groupBy("grp").agg(F.count_distinct("seq_id").alias("contigs"), F.count("*").alias("positions"), F.count_if(F.col("n") > 1).alias("joined"), F.count_if("cut").alias("cut"))
    return rows.filter("contigs > 1")


def q64(spark, d):
    """The segments with their letters, mean depth and members."""
    return stages.graph(laid(spark, d))[0].select("grp", "node", "length", "seq", "depth", "members")


def q65(spark, d):
    """Which segments follow each other."""
    return stages.graph(laid(spark, d))[1]


@within("assembled")
def q68(spark, d):
    """Contigs joined along their best overlaps on both strands in one round: letters, and how deep they are covered.

    `assemble` goes on until nothing joins; every round searches all overlaps anew.
    """
    rows = catalog.classes(spark, d)
    out = merging.assembled(covered(rows), rounds=1)
    depth = F.aggregate("cover", F.lit(0).cast("long"), lambda n, x: n + x["a"] + x["c"] + x["g"] + x["t"])
    return out.select("id", "seq", F.length("seq").cast("long").alias("length"), depth.alias("volume"))


@within("transcripts")
def q69(spark, d):
    """Transcripts of each group of contigs, with their depth, share and rates."""
    out = transcripts.with_rates(transcripts.transcripts(*stages.graph(laid(spark, d)), SETTINGS))
    return out.select("grp", "iso", "n_isoforms", F.array_join("nodes", " ").alias("nodes"), "length", "seq", "depth", "share", F.round("rpkm", 4).alias("rpkm"), F.round("tpm", 4).alias("tpm"))


def q76(spark, d):
    """The best local alignment of each pair of contigs that have 19 letters in common, from 40 bits on."""
    rows = catalog.classes(spark, d).select("id", "seq")
    return alignment.aligned(rows, rows, 40.0)


@within("candidates")
def q79(spark, d):
    """Which contigs may hold which others, by 8-mers of both strands."""
    return overlaps.whole_candidates(catalog.classes(spark, d))


#: The smallest ranges, so that even these tables are read in several.
SMALL_RANGE = 1 << 16


def q77(spark, d):
    """Whole sequences written as FASTQ and read by byte ranges; quality lines begin with @ or +."""
    path = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    rows = catalog.sequences(spark, d)
    formats.write_fastq(rows.select(F.concat(F.lit("read"), "doc_id").alias("name"), "seq", F.translate("seq", "ACGT", "@+HG").alias("qual")), path)
    return records.records(spark, "fastq", path, records.split_size(path, SMALL_RANGE)).select("name", "seq", "qual")


def q78(spark, d):
    """Contigs with coverage written as six-line records and read by byte ranges, with their mean depth."""
    path = f"{shared_dir(spark)}/contigs-{uuid.uuid4().hex}"
    copies = F.col("doc_id") % 5 + 1
    rows = catalog.sequences(spark, d).select(F.col("doc_id").alias("cntg_id"), copies.alias("n_valid"), F.length("seq").cast("long").alias("n_total"), "seq", copies.cast("int").alias("copies"))
    formats.write_contigs(counts.covered(rows), path)
    back = counts.texts(records.records(spark, "contigs", path, records.split_size(path, SMALL_RANGE)).select("cntg_id", "n_valid", "n_total", "seq", "cov"), "", volume=True)
    return back.select(F.col("cntg_id").cast("long").alias("cntg_id"), "n_valid", "n_total", "seq", *"acgt", (F.col("volume") / F.length("seq")).alias("depth"))


NAMED_HITS = "SELECT concat('ref', l_orderkey, ':', l_orderkey % 97, ':', l_orderkey % 50, ':', l_orderkey % 1000) AS qseqid, concat('asm', l_partkey, '_', l_partkey % 7 + 1, '_', l_partkey % 40, '_', l_partkey % 900, '_', l_partkey % 100) AS sseqid, 400 AS qlen, CAST(250 + 3 * l_quantity AS INT) AS length, CAST(280 + l_partkey % 200 AS INT) AS slen, CAST(249 + 3 * l_quantity AS INT) AS nident, 1 AS mismatch FROM lineitem"


@within("matches")
def matches(spark, d):
    """Best matches of a stored table of hits: order lines stand in for alignments, orders for known transcripts, parts for estimates."""
    hits = formats.hits_round_trip(catalog.relational(NAMED_HITS)(spark, d))
    return evaluate.with_names(evaluate.best_hits(hits))


def q66(spark, d):
    return matches(spark, d)


def q67(spark, d):
    return evaluate.recovered(matches(spark, d), (0.7, 0.8, 0.9, 0.95)).withColumn("r2", F.round("r2", 6))


def sql_junctions(name: str, seqs: str, least: int = 24, most: int = 100, enough: int = 50, backoff: int = 12) -> str:
    """Tables up to `name`, the junctions of sequences (id, seq): every diagonal on which one half of the first 24 letters is equal, read letter by letter."""
    size, step = J.block_sizes()
    half = least // 2
    other = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
    limit = lambda place: f"floor(greatest({place}, {least}) * 0.05 + 0.5)"
    return f"""counted AS (SELECT id, seq, length(seq) AS len, CAST(greatest(ceil((length(seq) - {size}) / {step}) + 1, 1) AS BIGINT) AS blocks FROM {seqs}),
    spread_blocks AS (SELECT id, seq, len, blocks, unnest(range(0, blocks)) AS block FROM counted),
    one_way AS (SELECT id, len AS ref_len, blocks, block, block * {step} + 1 AS start, substr(seq, block * {step} + 1, CASE WHEN block = blocks - 1 THEN len ELSE {size} END) AS t FROM spread_blocks),
    ways AS (SELECT *, 0 AS turned FROM one_way UNION ALL SELECT * REPLACE ({other('t')} AS t), 1 AS turned FROM one_way),
    ends AS (SELECT id AS tgt_id, len AS tgt_len, 0 AS side, seq AS p FROM counted UNION ALL SELECT id, len, 1, {other('seq')} FROM counted),
    halves AS (SELECT tgt_id, side, 0 AS off, substr(p, 1, {half}) AS w FROM ends WHERE tgt_len >= {least} UNION ALL SELECT tgt_id, side, {half}, substr(p, {half + 1}, {half}) FROM ends WHERE tgt_len >= {least}),
    places AS (SELECT id, block, turned, unnest(range(0, length(t) - {half - 1})) AS k, unnest(list_transform(range(1, length(t) - {half - 2}), lambda i: substr(t, i, {half}))) AS w FROM ways),
    met AS (SELECT DISTINCT id, block, turned, tgt_id, side, k - off AS s FROM places JOIN halves USING (w) WHERE id <> tgt_id AND k >= off),
    laid AS (SELECT met.*, ref_len, tgt_len, blocks, start, length(t) AS len, least({most}, length(t), tgt_len) AS size, t, p FROM met JOIN ways USING (id, block, turned) JOIN ends USING (tgt_id, side)),
    cut_runs AS (SELECT * EXCLUDE (t, p), least(size, len - s) AS n, substr(t, s + 1, least(size, len - s)) AS a, p AS b FROM laid WHERE least(size, len - s) >= {least} AND hamming(substr(t, s + 1, {least}), substr(p, 1, {least})) <= {limit(0)}),
    unlike AS (SELECT *, list_filter(range(0, n), lambda i: a[i + 1] <> b[i + 1]) AS m FROM cut_runs),
    stopped AS (SELECT *, coalesce(m[list_filter(range(1, len(m) + 1), lambda i: i > {limit('m[i]')})[1]], n) AS stop FROM unlike),
    measured AS (SELECT *, list_max(list_filter(range(0, stop), lambda i: NOT list_contains(m, i))) AS depth FROM stopped),
    counted_runs AS (SELECT id, block, turned, tgt_id, side, s, ref_len, tgt_len, blocks, start, len, depth, len(list_filter(m, lambda i: i < depth)) AS dist, CASE WHEN s + size > len THEN 1 ELSE 0 END AS out_over FROM measured WHERE depth >= {least}),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY id, block, tgt_id, side ORDER BY out_over, turned, CASE WHEN depth > {enough} THEN 0 ELSE 1 END, CASE WHEN depth > {enough} THEN 0 ELSE -depth END, CASE WHEN out_over = 1 OR turned = 1 THEN -s ELSE s END) AS k FROM counted_runs),
    placed_runs AS (SELECT *, CASE WHEN turned = 1 THEN len - s - depth + 1 ELSE s + 1 END AS pos, CASE WHEN side = 0 THEN CASE WHEN turned = 1 THEN 3 ELSE 1 END WHEN turned = 1 THEN 2 ELSE 4 END AS mode FROM ordered WHERE k = 1),
    kept_runs AS (SELECT *, pos + start - 1 AS first_pos, pos + start - 1 + depth - 1 AS last_pos FROM placed_runs WHERE NOT (block < blocks - 1 AND pos > {step}) AND NOT (block > 0 AND pos = 1)),
    drawn AS (SELECT *, first_pos + CASE WHEN first_pos > 1 AND last_pos < ref_len AND mode IN (2, 3) THEN {backoff} ELSE 0 END AS b1, last_pos - CASE WHEN first_pos > 1 AND last_pos < ref_len AND mode IN (1, 4) THEN {backoff} ELSE 0 END AS b2 FROM kept_runs),
    {name} AS (SELECT id AS ref_id, CAST(block AS INT) AS block, tgt_id, side, CASE WHEN mode <= 2 THEN 1 ELSE -1 END AS turned, b2 - b1 + 1 AS size, b1 AS ref_start, b2 AS ref_end, ref_len, CASE WHEN side = 0 THEN 1 ELSE tgt_len - (b2 - b1 + 1) + 1 END AS tgt_start, CASE WHEN side = 0 THEN b2 - b1 + 1 ELSE tgt_len END AS tgt_end, tgt_len, mode, CAST(dist AS INT) AS dist FROM drawn WHERE b1 < b2 AND (NOT (b1 = 1 OR b2 = ref_len) OR id > tgt_id))"""


JUNCTIONS = catalog.CLASSES + ", " + sql_junctions("junc", "c")
LONG = catalog.SEQS + ", cut_long AS (SELECT doc_id, seq, greatest((length(seq) + 320) // 480, 1) AS n FROM s), spread_long AS (SELECT doc_id, seq, n, unnest(range(0, n)) AS k FROM cut_long), long_c AS (SELECT min(doc_id * 4294967296 + k) AS id, seq FROM (SELECT doc_id, k, substr(seq, k * 480 + 1, CASE WHEN k = n - 1 THEN length(seq) - k * 480 ELSE 480 END) AS seq FROM spread_long) GROUP BY seq)"
#: The verdict on a head and a tail junction of one pair, as head, tail, onward, back.
VERDICT = """CASE WHEN hm = 1 AND tm = 2 AND hp < tp THEN [1, 1, 2, 1] WHEN hm = 3 AND tm = 4 AND hp > tp THEN [1, 1, -2, -2]
    WHEN hm = 1 AND tm = 2 THEN CASE WHEN hs > ts THEN [1, 0, 2, 1] ELSE [0, 1, 1, 2] END WHEN hm = 1 AND tm = 4 THEN CASE WHEN hs > ts THEN [1, 0, 2, 1] ELSE [0, 1, 1, 2] END
    WHEN hm = 3 AND tm = 2 THEN CASE WHEN hs > ts THEN [1, 0, -1, -1] ELSE [0, 1, -2, -2] END WHEN hm = 3 AND tm = 4 THEN CASE WHEN hs > ts THEN [1, 0, -1, -1] ELSE [0, 1, -2, -2] END
    WHEN hm = 1 THEN [1, 0, 2, 1] WHEN hm = 3 THEN [1, 0, -1, -1] WHEN tm = 2 THEN [0, 1, 1, 2] WHEN tm = 4 THEN [0, 1, -2, -2] END"""
BEST = JUNCTIONS + f""", hj AS (SELECT ref_id, tgt_id, block AS hb, mode AS hm, ref_start AS hp, size - dist AS hs FROM junc WHERE side = 0), tj AS (SELECT ref_id, tgt_id, block AS tb, mode AS tm, ref_start AS tp, size - dist AS ts FROM junc WHERE side = 1),
    judged AS (SELECT *, {VERDICT} AS v FROM hj FULL JOIN tj USING (ref_id, tgt_id)), valued AS (SELECT *, coalesce(hs, 0) * v[1] + coalesce(ts, 0) * v[2] AS score FROM judged),
    best AS (SELECT *, row_number() OVER (PARTITION BY ref_id, tgt_id ORDER BY score DESC, tb NULLS FIRST, hb NULLS FIRST) AS k FROM valued)"""
MATCHES = f"""named_hits AS ({NAMED_HITS}), fitting AS (SELECT *, length / slen AS scvg, length / qlen AS qcvg FROM named_hits WHERE length / qlen >= 0.8 AND slen >= 300),
    of_subject AS (SELECT *, row_number() OVER (PARTITION BY sseqid ORDER BY qcvg DESC, qseqid) AS k FROM fitting), of_query AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY qseqid ORDER BY qcvg DESC, sseqid) AS k FROM of_subject WHERE k = 1),
    named AS (SELECT *, string_split(qseqid, ':') AS q, string_split(sseqid, '_') AS s FROM of_query WHERE k = 1),
    match AS (SELECT qseqid AS qid, sseqid AS sid, CAST(qlen AS DOUBLE) AS qlen, CAST(length AS DOUBLE) AS alen, CAST(slen AS DOUBLE) AS slen, qcvg, scvg, CAST(s[3] AS DOUBLE) AS est_abn, CAST(q[3] AS DOUBLE) AS true_abn, CAST(s[4] AS DOUBLE) AS est_rpkm, CAST(q[4] AS DOUBLE) AS true_rpkm, CAST(s[2] AS DOUBLE) AS grp, CAST(s[5] AS DOUBLE) AS iso, CAST(q[2] AS DOUBLE) AS exp_cvg FROM named)"""

OWN = {
    "q66_match_info": (q66, f"WITH {MATCHES} SELECT * FROM match"),
    "q67_recovered": (q67, f"WITH {MATCHES}, shares(share) AS (VALUES (CAST(0.7 AS DOUBLE)), (0.8), (0.9), (0.95)) SELECT share, count(*) AS n, round(regr_r2(est_rpkm, true_rpkm), 6) AS r2 FROM match JOIN shares ON qcvg >= share GROUP BY share"),
    "q54_junctions": (q54, f"WITH {JUNCTIONS} SELECT * FROM junc"),
    "q58_block_junctions": (q58, f"WITH {LONG}, {sql_junctions('junc', 'long_c')} SELECT * FROM junc"),
    "q59_best_junctions": (q59, f"WITH {BEST} SELECT ref_id, tgt_id, hb AS head_block, tb AS tail_block, v[1] AS head, v[2] AS tail, CAST(score AS BIGINT) AS score FROM best WHERE k = 1"),
    "q60_connections": (q60, f"WITH {BEST} SELECT ref_id AS a, tgt_id AS b, v[3] AS mode, CAST(score AS BIGINT) AS score FROM best WHERE k = 1 UNION ALL SELECT tgt_id, ref_id, v[4], CAST(score AS BIGINT) FROM best WHERE k = 1"),
    "q61_group_strands": (q61, None),
    "q62_oriented_junctions": (q62, None),
    "q63_position_classes": (q63, None),
    "q64_segments": (q64, None),
    "q65_segment_edges": (q65, None),
    "q68_merged_round": (q68, None),
    "q69_transcripts": (q69, None),
    "q76_alignments": (q76, None),
    "q79_whole_candidates": (q79, f"WITH {catalog.CLASSES}, picked AS (SELECT id AS a, length(seq) AS len, unnest(list_transform(range(0, (length(seq) - 8) // 4 + 1), lambda i: substr(seq, i * 4 + 1, 8))) AS kmer FROM c), strands AS (SELECT id, seq FROM c UNION ALL SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) FROM c), held AS (SELECT DISTINCT id AS b, length(seq) AS blen, unnest(list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8))) AS kmer FROM strands) SELECT a, b, count(*) AS shared FROM picked JOIN held USING (kmer) WHERE blen > len OR (blen = len AND b < a) GROUP BY a, b, len HAVING count(*) >= floor(greatest((len - 4) / 4 - ceil(len * 0.05) * 2, 2) + 0.5)"),
    "q77_fastq_ranges": (q77, f"WITH {catalog.SEQS} SELECT concat('read', doc_id) AS name, seq, translate(seq, 'ACGT', '@+HG') AS qual FROM s"),
    "q78_contig_ranges": (q78, f"WITH {catalog.SEQS} SELECT doc_id AS cntg_id, doc_id % 5 + 1 AS n_valid, length(seq) AS n_total, seq, " + ", ".join(f"array_to_string(list_transform(string_split(seq, ''), lambda x: CASE WHEN x = '{b}' THEN doc_id % 5 + 1 ELSE 0 END), '') AS {b.lower()}" for b in "ACGT") + ", CAST(doc_id % 5 + 1 AS DOUBLE) AS depth FROM s"),
}


def queries() -> dict:
    return {k: v[0] for k, v in OWN.items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in OWN.items() if v[1]}
