"""The registered queries of the sequence-analytics operators and the SQL that states each of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import sequence as S
from .functions import tails
from .operators import kmers, numeric, overlaps
from .plans.graph import capped_components, compacted, connected_components, resolved, signed_components
from .plans.storage import stored
from .sources import counts, formats

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, seq): whole texts as stand-ins of assembled sequences; short ones are dropped (P5)."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), LETTERS, BASES)
    # a filter would be pushed below the projection, and each sequence made twice
    long = F.filter(F.array(seq), lambda x: F.length(x) >= 40)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(long).alias("seq"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc_id, seq): the contigs that all sequences are cut into."""
    return overlaps.contigs(sequences(spark, sf_dir))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, copies): the distinct contigs, stored once; equal ones are one class, known by its smallest id."""
    return spread(overlaps.distinct_sequences(pieces(spark, sf_dir)))


def spread(contigs: DataFrame) -> DataFrame:
    """Contigs stored in as many files as there are shuffle partitions: each becomes hundreds of seeds, so few large files would make few tasks."""
    return stored(contigs.repartition(int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"), "contigs")


def relational(text: str):
    """A query that both engines state alike."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in set(re.findall(r"\w+", text)) & set(TABLES):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return query


SEQS = f"seqs AS (SELECT doc_id, lang, source, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents), s AS (SELECT * FROM seqs WHERE length(seq) >= 40)"
KMERS = SEQS + ", k AS (SELECT doc_id, unnest(range(0, length(seq) - 7)) AS pos, unnest(list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8))) AS kmer FROM s)"
PIECES = SEQS + ", cut AS (SELECT doc_id, seq, greatest((length(seq) + 80) // 120, 1) AS n FROM s), spread AS (SELECT doc_id, seq, n, unnest(range(0, n)) AS k FROM cut), contigs AS (SELECT doc_id * 4294967296 + k AS id, doc_id, substr(seq, k * 120 + 1, CASE WHEN k = n - 1 THEN length(seq) - k * 120 ELSE 120 END) AS seq FROM spread)"
CLASSES = PIECES + ", c AS (SELECT min(id) AS id, seq, count(*) AS copies FROM contigs GROUP BY seq), rc AS (SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM c)"
ENDS = CLASSES + ", tails AS (SELECT DISTINCT id AS a, unnest(list_transform(range(1, 34), lambda i: substr(right(seq, 40), i, 8))) AS kmer FROM c), heads AS (SELECT DISTINCT id AS b, unnest(list_transform(range(1, 34), lambda i: substr(seq, i, 8))) AS kmer FROM c), cand AS (SELECT a, b, count(*) AS shared FROM tails JOIN heads USING (kmer) WHERE a <> b GROUP BY a, b HAVING count(*) >= 20)"


def sql_tail_head(name: str, tails: str, heads: str) -> str:
    """Tables of the least overlaps of tails with heads, 24 to 119 letters, by stretches as the operator takes them."""
    parts = []
    for low, high, d in overlaps.limit_steps(24, 119, 0.05):
        size = low // (d + 1)
        keys = f"SELECT id AS b, seq AS sb, unnest(range(0, {d + 1})) * {size} AS pb, unnest(list_transform(range(0, {d + 1}), lambda i: substr(seq, i * {size} + 1, {size}))) AS stretch FROM {heads} WHERE length(seq) >= {low}"
        first = f"greatest(length(seq) - {high}, 0)"
        places = f"SELECT id AS a, seq AS sa, unnest(range({first}, length(seq) - {size} + 1)) AS pa, unnest(list_transform(range({first}, length(seq) - {size} + 1), lambda i: substr(seq, i + 1, {size}))) AS stretch FROM {tails} WHERE length(seq) >= {low}"
        parts.append(f"SELECT DISTINCT a, b, sa, sb, length(sa) - pa + pb AS depth FROM ({places}) JOIN ({keys}) USING (stretch) WHERE a <> b AND length(sa) - pa + pb BETWEEN {low} AND least({high}, length(sa), length(sb))")
    return f"{name}_d AS ({' UNION '.join(parts)}), {name}_h AS (SELECT a, b, depth, hamming(right(sa, depth), left(sb, depth)) AS dist FROM {name}_d), {name} AS (SELECT a, b, min(depth) AS depth, min_by(dist, depth) AS dist FROM {name}_h WHERE dist <= floor(depth * 0.05 + 0.5) GROUP BY a, b)"


DOVE = CLASSES + ", " + ", ".join(sql_tail_head(*x) for x in (("fwd", "c", "c"), ("out2", "c", "rc"), ("in2", "rc", "c"))) + ", t AS (SELECT a, b, 2 AS mode, depth, dist FROM fwd UNION ALL SELECT b, a, 1, depth, dist FROM fwd UNION ALL SELECT a, b, -2, depth, dist FROM out2 UNION ALL SELECT b, a, -1, depth, dist FROM in2)"
LINKS = "links AS (SELECT DISTINCT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b FROM (SELECT l_orderkey, l_partkey * 64 + CAST(l_quantity AS BIGINT) AS c FROM lineitem WHERE l_linenumber = 1) x JOIN (SELECT l_orderkey, l_partkey * 64 + CAST(l_quantity AS BIGINT) AS c FROM lineitem WHERE l_linenumber = 2) y ON x.l_orderkey = y.l_orderkey WHERE x.c <> y.c)"
CHAIN = "chain AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 16 = 1 OR p_partkey = 0 THEN 0 ELSE p_partkey - 1 END AS parent FROM part)"
STEPS = "steps AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events), edges AS (SELECT DISTINCT event_type AS src, following AS dst FROM steps WHERE following IS NOT NULL AND following <> event_type)"
BLOCKS = "b AS (SELECT user_id, event_id, ts, value, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM b), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) AS BIGINT) AS place FROM r)"
HITS = "hits AS (SELECT l_orderkey AS qid, l_partkey AS sid, l_quantity / 50 AS qcvg, l_extendedprice AS slen FROM lineitem)"

#: Queries of which one text runs on both engines.
SHARED = {
    "q01_multi_threshold_filter": "WITH t AS (SELECT l_partkey, sum(l_quantity) / 100 AS abn FROM lineitem GROUP BY l_partkey), h AS (SELECT CAST(0 AS DOUBLE) AS th UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 6 UNION ALL SELECT 8 UNION ALL SELECT 12 UNION ALL SELECT 16) SELECT th, count(*) AS n FROM t JOIN h ON abn >= th GROUP BY th",
    "q08_len_stats": "WITH l AS (SELECT length(text) AS n FROM documents), m AS (SELECT avg(n) AS mean, min(n) AS least FROM l) SELECT round(max(mean), 6) AS avg_len, CAST(max(n) AS BIGINT) AS max_len, CAST(min(n) AS BIGINT) AS min_len, round(100 * avg(CAST(CASE WHEN n < mean THEN 1 ELSE 0 END AS DOUBLE)), 4) AS below_avg, round(100 * avg(CAST(CASE WHEN n = least THEN 1 ELSE 0 END AS DOUBLE)), 4) AS at_min FROM l CROSS JOIN m",
    "q17_read_pair_neighbours": f"WITH {LINKS} SELECT a, b FROM links UNION ALL SELECT b, a FROM links",
    "q22_topk_per_group": "WITH r AS (SELECT c_nationkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS k FROM orders JOIN customer ON o_custkey = c_custkey) SELECT c_nationkey, o_orderkey, o_totalprice, k FROM r WHERE k <= 60",
    "q23_best_junction_per_end": "WITH r AS (SELECT l_partkey, l_linenumber, l_orderkey, l_quantity, CAST(row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_quantity DESC, l_orderkey, l_extendedprice) AS BIGINT) AS k FROM lineitem) SELECT l_partkey, l_linenumber, l_orderkey, l_quantity FROM r WHERE k = 1",
    "q24_compat_case": "WITH j AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS head, l_partkey % 5 AS tail, l_quantity AS p1, l_tax * 500 AS p2, l_extendedprice AS s1, 900 * l_quantity AS s2 FROM lineitem), m AS (SELECT *, CASE WHEN s1 > s2 THEN 1 ELSE 2 END AS larger FROM j) SELECT head, tail, CASE WHEN head = 1 AND tail = 2 AND p1 < p2 THEN 'both' WHEN head = 3 AND tail = 4 AND p1 > p2 THEN 'both' WHEN head IN (1, 3) AND tail IN (2, 4) THEN CASE WHEN larger = 1 THEN 'head' ELSE 'tail' END WHEN head IN (1, 3) AND tail = 0 THEN 'head' WHEN head = 0 AND tail IN (2, 4) THEN 'tail' ELSE 'none' END AS verdict, count(*) AS n FROM m GROUP BY 1, 2, 3",
    "q26_junction_flip": "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS ref, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE 51 - (l_quantity + l_linenumber - 1) + 1 END AS start_pos, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity + l_linenumber - 1 ELSE 51 - l_quantity + 1 END AS end_pos FROM lineitem",
    "q28_boundaries": f"WITH {BLOCKS} SELECT user_id, event_id, CAST(fresh AS BIGINT) AS boundary, CAST(segment AS BIGINT) AS segment FROM r",
    "q29_splice_edges": f"WITH {STEPS} SELECT src, dst FROM edges",
    "q30_segment_coverage": f"WITH {BLOCKS} SELECT event_type, place, round(sum(value), 4) AS cover, count(*) AS n FROM z GROUP BY event_type, place",
    "q31_unary_degrees": f"WITH {STEPS}, o AS (SELECT src, count(*) AS out_n FROM edges GROUP BY src), i AS (SELECT dst, count(*) AS in_n FROM edges GROUP BY dst) SELECT coalesce(src, dst) AS node, coalesce(out_n, 0) AS out_n, coalesce(in_n, 0) AS in_n FROM o FULL OUTER JOIN i ON src = dst",
    "q35_semi_valid": "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "q36_anti_evidence": "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)",
    "q37_hit_filter_cov": f"WITH {HITS} SELECT CAST(sum(CASE WHEN qcvg >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS n80, CAST(sum(CASE WHEN qcvg >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS n90, CAST(sum(CASE WHEN qcvg >= 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n95 FROM hits WHERE slen >= 300",
    "q38_best_hit": f"WITH {HITS}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY sid ORDER BY qcvg DESC, qid, slen) AS BIGINT) AS k FROM hits WHERE qcvg >= 0.8 AND slen >= 300), q AS (SELECT qid, sid, qcvg, CAST(row_number() OVER (PARTITION BY qid ORDER BY qcvg DESC, sid) AS BIGINT) AS k FROM s WHERE k = 1) SELECT qid, sid, qcvg FROM q WHERE k = 1",
    "q39_swap_qs": f"WITH {HITS} SELECT sid AS qid, qid AS sid, slen AS qlen, qcvg AS scvg FROM hits",
    "q40_r2": "SELECT l_returnflag, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "q47_rpkm_tpm": "WITH r AS (SELECT l_partkey, count(*) AS reads, sum(l_quantity) AS len FROM lineitem GROUP BY l_partkey), t AS (SELECT sum(reads) AS total, sum(reads / len) AS rate FROM r) SELECT l_partkey, round(1e9 * reads / (len * total), 4) AS rpkm, round(1e6 * (reads / len) / rate, 4) AS tpm FROM r CROSS JOIN t",
}


def q02(spark, d):
    s = F.col("text")
    return table(spark, d, "documents").select("doc_id", S.encoded(s).alias("codes"), S.undefined(s).alias("n_undef"))


def q03(spark, d):
    return sequences(spark, d).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


def q04(spark, d):
    return kmers.spectrum(sequences(spark, d), 8, 4)


def q05(spark, d):
    """How often each 8-mer's code stands in each sequence."""
    return kmers.counted(sequences(spark, d))


def coverage(spark, d):
    p = sequences(spark, d).select("lang", F.posexplode(F.split("seq", "")).alias("pos", "base"))
    return p.groupBy("lang", "pos").agg(*[F.sum((F.col("base") == x).cast("long")).alias(x.lower()) for x in "ACGT"])


def q06(spark, d):
    return coverage(spark, d).select("lang", F.col("pos").cast("long").alias("pos"), S.consensus(*map(F.col, "acgt")).alias("base"))


def q07(spark, d):
    depth = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    out = coverage(spark, d).groupBy("lang").agg(F.round(F.avg(depth), 6).alias("mean_depth"), F.sum(depth).alias("volume"))
    return out.filter("volume > 152")


def q09(spark, d):
    """Fuzzy tails of A and heads of T with one mismatch in twenty."""
    out = sequences(spark, d).select("doc_id", tails.fuzzy_run(F.reverse("seq"), "A", 3, 0.05).alias("f"), tails.fuzzy_run(F.col("seq"), "T", 3, 0.05).alias("b"))
    return out.filter("f > 0 or b > 0")


def q10(spark, d):
    return overlaps.hamming_pairs(classes(spark, d))


def q11(spark, d):
    return overlaps.end_candidates(classes(spark, d), 20)


def q12(spark, d):
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    return q11(spark, d).withColumn("k", rank.cast("long")).filter("k <= 3")


def dovetailed(spark, d):
    return overlaps.dovetails(classes(spark, d))


def q14(spark, d):
    """Contigs in longer ones."""
    rows = classes(spark, d)
    return overlaps.contained_by_blocks(rows, rows)


def q15(spark, d):
    scored = dovetailed(spark, d).withColumn("score", F.col("dist") * 76 - F.col("depth"))
    best = scored.groupBy("b").agg(F.min(F.struct("score", "a", "mode")).alias("m"))  # tasks deal one row for each b
    return best.select("m.a", "b", "m.mode", "m.score")


def q16(spark, d):
    hits = q14(spark, d).join(classes(spark, d).select("id", F.length("seq").alias("len")), "id")
    return overlaps.best_per(hits, "probe_id", F.desc("len"), "id").select("probe_id", F.col("id").alias("container"), "pos")


def links(spark, d):
    return relational(f"WITH {LINKS} SELECT a, b FROM links")(spark, d)


def chain(spark, d):
    return relational(f"WITH {CHAIN} SELECT node, parent FROM chain")(spark, d)


def q18(spark, d):
    return resolved(chain(spark, d)).select("node", "root")


def q19(spark, d):
    return connected_components(links(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def q20(spark, d):
    return q19(spark, d).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def q21(spark, d):
    cap = 4
    weighted = links(spark, d).withColumn("w", (F.col("a") * 7 + F.col("b") * 3) % 101)
    parts = q19(spark, d)
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    rows = weighted.join(parts.withColumnRenamed("node", "a"), "a").join(sizes, "component")
    low = rows.groupBy("component").agg(F.min("w").alias("low"))
    return rows.join(low, "component").filter(f"size <= {cap} or w > low").select("a", "b", "w")


def q25(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1).alias("ref"), F.element_at(F.array(*map(F.lit, (1, 2, -1, -2))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("mode"))
    direction, strand = S.strand(F.col("ref"), F.col("mode"))
    return rows.select("l_orderkey", "l_linenumber", direction.alias("direction"), strand.alias("strand"))


def q27(spark, d):
    """Blocks of 2 * round(1.5 * rl), step block - round(1.1 * rl), for rl 76; the last one reaches the end."""
    block, step, n = 228, 144, F.col("n_chars")
    count = F.greatest(F.ceil((n - block) / step) + 1, F.lit(1)).cast("long")
    rows = table(spark, d, "documents").select("doc_id", n, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"), count.alias("__n"))
    end = F.when(F.col("block") == F.col("__n") - 1, n).otherwise(F.col("block") * step + block)
    return rows.select("doc_id", "block", (F.col("block") * step + 1).alias("start_pos"), end.alias("end_pos"))


def q32(spark, d):
    return resolved(chain(spark, d)).groupBy("root").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node")), "-").alias("path"))


PLACED = "placed AS (SELECT DISTINCT x.l_orderkey AS read_id, x.l_partkey * 64 + CAST(x.l_quantity AS BIGINT) AS c1, y.l_partkey * 64 + CAST(y.l_quantity AS BIGINT) AS c2 FROM lineitem x LEFT JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = 2 WHERE x.l_linenumber = 1)"


def reads(spark, d):
    return relational(f"WITH {PLACED} SELECT read_id, c1, c2 FROM placed")(spark, d)


def q34(spark, d):
    parts = q19(spark, d)
    g1, g2 = (parts.select(F.col("node").alias(f"c{i}"), F.col("component").alias(f"g{i}")) for i in (1, 2))
    return reads(spark, d).join(g1, "c1", "left").join(g2, "c2", "left").select("read_id", "c1", "c2", F.coalesce("g1", F.lit(0)).alias("group1"), F.coalesce("g2", F.lit(0)).alias("group2")).filter("group1 > 0 or group2 > 0")


def q33(spark, d):
    r = q34(spark, d)
    one = lambda c: F.sum(F.expr(c).cast("long"))
    return r.agg(F.count("*").alias("mapped"), one("(group1 = 0) <> (group2 = 0)").alias("single"), one("group1 > 0 and group2 > 0 and group1 <> group2").alias("wrong"), one("group1 > 0 and group1 = group2").alias("same"))


def q41(spark, d):
    name = F.concat_ws(":", F.col("c_name"), F.col("c_nationkey"), F.round("c_acctbal", 1))
    f = S.trailing_fields(name, ":")
    return table(spark, d, "customer").select("c_custkey", F.get(f, F.lit(0)).alias("last"), F.get(f, F.lit(1)).alias("second"), F.get(f, F.lit(2)).alias("third"))


def q42(spark, d):
    return dovetailed(spark, d).select("a", "b", "mode", (F.col("dist") <= 0.05 * F.col("depth")).alias("valid"))


def q43(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "n_chars")


def q44(spark, d):
    """Paths of at most four edges over the graph of event types, without a node twice."""
    e = relational(f"WITH {STEPS} SELECT src, dst FROM edges")(spark, d)
    level = e.select(F.array("src", "dst").alias("path"))
    out = level
    for _ in range(3):
        level = level.join(e, F.element_at("path", -1) == F.col("src")).filter("NOT array_contains(path, dst)").select(F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(level)
    return out.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("n_edges"))


CC = LINKS + ", both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT DISTINCT a AS node, a AS r FROM both_ways UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.node), cc AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"
ROOTS = CHAIN + ", walk AS (SELECT node, CASE WHEN parent = 0 THEN node ELSE parent END AS root FROM chain UNION SELECT walk.node, CASE WHEN chain.parent = 0 THEN chain.node ELSE chain.parent END FROM walk JOIN chain ON chain.node = walk.root), roots AS (SELECT node, min(root) AS root FROM walk GROUP BY node)"
READS = CC + ", " + PLACED + ", g AS (SELECT read_id, c1, c2, coalesce(p.component, 0) AS group1, coalesce(q.component, 0) AS group2 FROM placed LEFT JOIN cc p ON p.node = c1 LEFT JOIN cc q ON q.node = c2)"
def sql_contained(name: str, probes: str) -> str:
    """Hits of `probes` in longer contigs, by the last 11 letters of each of their stretches, that are counted from the end."""
    keys = f"SELECT id AS probe_id, seq AS sb, unnest(list_transform(range(0, d + 1), lambda k: length(seq) - k * (length(seq) // (d + 1)) - 11)) AS pb, unnest(list_transform(range(0, d + 1), lambda k: substr(seq, length(seq) - k * (length(seq) // (d + 1)) - 10, 11))) AS stretch FROM (SELECT id, seq, CAST(floor(length(seq) * 0.05 + 0.5) AS BIGINT) AS d FROM {probes})"
    places = "SELECT id, seq AS sa, unnest(range(0, length(seq) - 10)) AS pa, unnest(list_transform(range(1, length(seq) - 9), lambda i: substr(seq, i, 11))) AS stretch FROM c"
    return f"{name}_d AS (SELECT DISTINCT probe_id, id, sa, sb, pa - pb AS ia FROM ({places}) JOIN ({keys}) USING (stretch) WHERE pa >= pb AND length(sb) < length(sa) AND probe_id <> id AND pa - pb + length(sb) <= length(sa)), {name} AS (SELECT probe_id, id, ia, length(sa) AS len, hamming(substr(sa, ia + 1, length(sb)), sb) AS dist, length(sb) AS n FROM {name}_d WHERE hamming(substr(sa, ia + 1, length(sb)), sb) <= floor(length(sb) * 0.05 + 0.5))"


CONT = CLASSES + ", " + sql_contained("same", "c") + ", " + sql_contained("turned", "rc") + ", every AS (SELECT probe_id, id, len, 0 AS turn, ia, dist FROM same UNION ALL SELECT probe_id, id, len, 1, ia, dist FROM turned), hit AS (SELECT probe_id, id, any_value(len) AS len, min({'turn': turn, 'ia': ia, 'dist': dist}) AS m FROM every GROUP BY probe_id, id)"
COVER = SEQS + ", b AS (SELECT lang, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM s), v AS (SELECT lang, pos, sum((base = 'A')::INT) AS a, sum((base = 'C')::INT) AS c, sum((base = 'G')::INT) AS g, sum((base = 'T')::INT) AS t FROM b GROUP BY ALL)"

#: name: (query, its SQL or None).
OWN = {
    "q02_encode_undef": (q02, "SELECT doc_id, regexp_replace(translate(regexp_replace(text, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', '01230123'), 'x', 'x') AS codes, CAST(length(regexp_replace(text, '[ACGTacgt]', '', 'g')) AS BIGINT) AS n_undef FROM documents"),
    "q03_revcomp": (q03, f"WITH {SEQS} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM s"),
    "q04_kmer_spectrum": (q04, f"WITH {KMERS} SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k WHERE pos % 4 = 0 GROUP BY kmer"),
    "q05_kmer_code": (q05, f"WITH {KMERS}, g AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY doc_id, kmer) SELECT doc_id, CAST(list_sum(list_transform(range(1, 9), lambda i: (instr('ACGT', substr(kmer, i, 1)) - 1) * CAST(pow(4, 8 - i) AS BIGINT))) AS BIGINT) AS code, n FROM g"),
    "q06_consensus": (q06, f"WITH {COVER} SELECT lang, pos, CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS base FROM v"),
    "q07_mean_depth_volume": (q07, f"WITH {COVER} SELECT lang, round(avg(a + c + g + t), 6) AS mean_depth, CAST(sum(a + c + g + t) AS BIGINT) AS volume FROM v GROUP BY lang HAVING sum(a + c + g + t) > 152"),
    "q09_polya_tail": (q09, f"WITH {SEQS}, {tails.sql_run('tail', 'reverse(seq)', 'A', 3, 0.05)}, {tails.sql_run('head', 'seq', 'T', 3, 0.05)} SELECT doc_id, tail.run AS f, head.run AS b FROM tail JOIN head USING (doc_id) WHERE tail.run > 0 OR head.run > 0"),
    "q10_hamming_pairs": (q10, f"WITH {CLASSES}, z AS (SELECT id, seq, length(seq) AS len, CAST(floor(length(seq) * 0.05 + 0.5) AS BIGINT) AS d FROM c), st AS (SELECT id, seq, len, unnest(range(0, d + 1)) AS k, unnest(list_transform(range(0, d + 1), lambda k: substr(seq, k * (len // (d + 1)) + 1, len // (d + 1)))) AS stretch FROM z) SELECT DISTINCT x.id AS a, y.id AS b, CAST(hamming(x.seq, y.seq) AS BIGINT) AS dist FROM st x JOIN st y ON x.len = y.len AND x.k = y.k AND x.stretch = y.stretch AND x.id < y.id WHERE hamming(x.seq, y.seq) <= floor(x.len * 0.05 + 0.5)"),
    "q11_kmer_candidates": (q11, f"WITH {ENDS} SELECT a, b, shared FROM cand"),
    "q12_topk_candidates": (q12, f"WITH {ENDS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM cand) SELECT a, b, shared, k FROM r WHERE k <= 3"),
    "q13_dovetail_overlap": (dovetailed, f"WITH {DOVE} SELECT a, b, mode, depth, CAST(dist AS BIGINT) AS dist FROM t"),
    "q14_containment": (q14, f"WITH {CONT} SELECT probe_id, id, CASE WHEN m.turn = 1 THEN -(m.ia + 1) ELSE m.ia + 1 END AS pos, CAST(m.dist AS BIGINT) AS dist FROM hit"),
    "q15_best_connection": (q15, f"WITH {DOVE}, r AS (SELECT a, b, mode, dist * 76 - depth AS score, row_number() OVER (PARTITION BY b ORDER BY dist * 76 - depth, a, mode) AS k FROM t) SELECT a, b, mode, CAST(score AS BIGINT) AS score FROM r WHERE k = 1"),
    "q16_containment_merge": (q16, f"WITH {CONT}, r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY len DESC, id) AS k FROM hit) SELECT probe_id, id AS container, CASE WHEN m.turn = 1 THEN -(m.ia + 1) ELSE m.ia + 1 END AS pos FROM r WHERE k = 1"),
    "q18_pointer_resolve": (q18, f"WITH RECURSIVE {ROOTS} SELECT node, root FROM roots"),
    "q19_connected_components": (q19, f"WITH RECURSIVE {CC} SELECT node, component FROM cc"),
    "q20_group_sizes": (q20, f"WITH RECURSIVE {CC}, z AS (SELECT component, count(*) AS size FROM cc GROUP BY component) SELECT size, count(*) AS n FROM z GROUP BY size"),
    "q21_weak_edge_prune": (q21, f"WITH RECURSIVE {CC}, z AS (SELECT component, count(*) AS size FROM cc GROUP BY component), w AS (SELECT a, b, (a * 7 + b * 3) % 101 AS w, component, size FROM links JOIN cc ON node = a JOIN z USING (component)), m AS (SELECT component, min(w) AS low FROM w GROUP BY component) SELECT a, b, w FROM w JOIN m USING (component) WHERE size <= 4 OR w > low"),
    "q25_strand_sign": (q25, "WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END AS ref, CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE -2 END AS mode FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN abs(mode) = 1 THEN -ref ELSE ref END AS BIGINT) AS direction, CAST(ref * sign(mode) AS BIGINT) AS strand FROM r"),
    "q27_sliding_blocks": (q27, "WITH n AS (SELECT doc_id, n_chars, CAST(greatest(ceil((n_chars - 228) / 144) + 1, 1) AS BIGINT) AS n FROM documents), b AS (SELECT doc_id, n_chars, n, unnest(range(0, n)) AS block FROM n) SELECT doc_id, block, block * 144 + 1 AS start_pos, CASE WHEN block = n - 1 THEN n_chars ELSE block * 144 + 228 END AS end_pos FROM b"),
    "q32_chain_compaction": (q32, f"WITH RECURSIVE {ROOTS} SELECT root, count(*) AS n, string_agg(CAST(node AS VARCHAR), '-' ORDER BY node) AS path FROM roots GROUP BY root"),
    "q33_read_map_stats": (q33, f"WITH RECURSIVE {READS} SELECT count(*) AS mapped, CAST(sum(((group1 = 0) <> (group2 = 0))::INT) AS BIGINT) AS single, CAST(sum((group1 > 0 AND group2 > 0 AND group1 <> group2)::INT) AS BIGINT) AS wrong, CAST(sum((group1 > 0 AND group1 = group2)::INT) AS BIGINT) AS same FROM g WHERE group1 > 0 OR group2 > 0"),
    "q34_read_group_map": (q34, f"WITH RECURSIVE {READS} SELECT read_id, c1, c2, group1, group2 FROM g WHERE group1 > 0 OR group2 > 0"),
    "q41_name_fields": (q41, "SELECT c_custkey, CAST(round(c_acctbal, 1) AS DOUBLE) AS last, CAST(c_nationkey AS DOUBLE) AS second, try_cast(c_name AS DOUBLE) AS third FROM customer"),
    "q42_integrity": (q42, f"WITH {DOVE} SELECT a, b, mode, dist <= 0.05 * depth AS valid FROM t"),
    "q43_sorts": (q43, "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50"),
    "q44_paths": (q44, f"WITH RECURSIVE {STEPS}, p AS (SELECT [src, dst] AS path FROM edges UNION ALL SELECT list_append(path, dst) FROM p JOIN edges ON src = path[-1] AND NOT list_contains(path, dst) WHERE len(path) <= 4) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS n_edges FROM p"),
    "q45_nn_lasso": (lambda spark, d: numeric.lasso_by_label(table(spark, d, "embeddings")), None),
    "q46_multi_format_roundtrip": (lambda spark, d: formats.round_trip(sequences(spark, d)), f"WITH {SEQS} SELECT doc_id, seq FROM s"),
}



def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands along customers' halving trees, cut at multiples of 7; a negative balance turns the strand."""
    c = F.col("c_custkey")
    root = (c % 7 == 0) | (c == 1)
    edges = table(spark, sf_dir, "customer").select(c.alias("src"), F.when(root, c).otherwise(F.floor(c / 2)).alias("dst"), F.when(~root & (F.col("c_acctbal") < 0), -1).otherwise(1).alias("sign"))
    return signed_components(edges).select("node", "root", F.col("strand").cast("int").alias("strand"), "conflict")


def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' halving tree cut down to groups of about 40 along edges of the lowest score."""
    edges = table(spark, sf_dir, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"), ((F.col("p_size") % 4 + 1) * 15).alias("score"))
    return capped_components(edges, 40, 50)


BRANCHES = "step AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 16 <> 0 UNION SELECT p_partkey, p_partkey + 5 FROM part WHERE p_partkey % 11 = 0), branch AS (SELECT src, dst FROM step WHERE dst IN (SELECT p_partkey FROM part))"
CHAINS = BRANCHES + ", counted AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o, count(*) OVER (PARTITION BY dst) AS i FROM branch), unary_edge AS (SELECT src, dst FROM counted WHERE o = 1 AND i = 1), walk AS (SELECT p_partkey AS head, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey NOT IN (SELECT dst FROM unary_edge) UNION ALL SELECT head, dst, depth + 1 FROM walk JOIN unary_edge ON src = node)"


def parts_compacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of 16 parts with branches, each part with two counts, compacted."""
    edges = relational(f"WITH {BRANCHES} SELECT src, dst FROM branch")(spark, sf_dir)
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 7).alias("cover"))
    return compacted(nodes, edges)


def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_compacted(spark, sf_dir)[0].select("head", "n_nodes", F.array_join(F.col("cover").cast("array<string>"), " ").alias("cover"))


def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_compacted(spark, sf_dir)[1]


def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.read_group_round_trip(q34(spark, sf_dir))


def sql_pruned(rounds: int = 4, cap: int = 40, safe: int = 50) -> str:
    """q49 in SQL: a parent is smaller than its part, so a group is known by the part at its top; there are as many rounds as scores."""
    steps = ["e0 AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, (p_size % 4 + 1) * 15 AS score FROM part WHERE p_partkey > 1)", "nodes AS (SELECT src AS node FROM e0 UNION SELECT dst FROM e0)"]
    for t in range(rounds + 1):
        steps.append(f"r{t} AS (SELECT node, node AS top FROM nodes WHERE node NOT IN (SELECT src FROM e{t}) UNION ALL SELECT e{t}.src, r{t}.top FROM e{t} JOIN r{t} ON e{t}.dst = r{t}.node)")
        if t < rounds:
            steps.append(f"w{t} AS (SELECT top, size, low FROM (SELECT top, count(*) AS size FROM r{t} GROUP BY top) JOIN (SELECT top, min(score) AS low FROM e{t} JOIN r{t} ON src = node GROUP BY top) USING (top))")
            steps.append(f"e{t + 1} AS (SELECT src, dst, score FROM e{t} JOIN r{t} ON src = node JOIN w{t} USING (top) WHERE NOT (size > {cap} AND (low < {safe} OR size > {round(1.33 * cap)}) AND score <= low))")
    return f"WITH RECURSIVE {', '.join(steps)} SELECT node, top AS component FROM r{rounds}"


OWN |= {
    "q50_unary_compaction": (q50, f"WITH RECURSIVE {CHAINS} SELECT head, count(*) AS n_nodes, string_agg(concat(p_size, ' ', p_partkey % 7), ' ' ORDER BY depth) AS cover FROM walk JOIN part ON node = p_partkey GROUP BY head"),
    "q51_compacted_edges": (q51, f"WITH RECURSIVE {CHAINS} SELECT DISTINCT x.head AS src, y.head AS dst FROM branch b JOIN walk x ON b.src = x.node JOIN walk y ON b.dst = y.node WHERE NOT (x.head = y.head AND y.depth = x.depth + 1)"),
    "q52_read_group_file": (q52, f"WITH RECURSIVE {READS} SELECT read_id, group1, group2 FROM g WHERE group1 > 0 OR group2 > 0"),
    "q48_strand_propagation": (q48, "WITH RECURSIVE t AS (SELECT c_custkey AS node, c_custkey AS root, 1 AS strand FROM customer WHERE c_custkey % 7 = 0 OR c_custkey = 1 UNION ALL SELECT c.c_custkey, t.root, t.strand * CASE WHEN c.c_acctbal < 0 THEN -1 ELSE 1 END FROM customer c JOIN t ON c.c_custkey // 2 = t.node WHERE c.c_custkey % 7 <> 0 AND c.c_custkey > 1) SELECT node, root, CAST(strand AS INT) AS strand, false AS conflict FROM t"),
    "q49_capped_components": (q49, sql_pruned()),
}


def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("doc_id", tails.trimmed(F.col("seq"), 3, 0.05).alias("seq"))


def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 8-mers of each contig on either strand and on both."""
    return kmers.strand_counts(classes(spark, sf_dir))


PAIRED = """junc AS (SELECT l_orderkey AS ref, l_suppkey % 4 AS tgt, l_linenumber AS line, l_partkey AS k, l_extendedprice AS pos, l_quantity - 100 * l_tax AS ov, CASE WHEN l_linenumber % 2 = 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 3 END ELSE CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 4 END END AS mode FROM lineitem),
pairing AS (SELECT h.ref, h.tgt, h.line AS head, h.k AS head_k, h.pos AS head_pos, t.line AS tail, t.k AS tail_k, t.pos AS tail_pos, h.ov AS ov1, t.ov AS ov2, CASE WHEN h.mode = 1 AND t.mode = 2 AND h.pos < t.pos THEN 'both' WHEN h.mode = 3 AND t.mode = 4 AND h.pos > t.pos THEN 'both' WHEN h.ov > t.ov THEN 'head' ELSE 'tail' END AS verdict FROM junc h JOIN junc t ON h.ref = t.ref AND h.tgt = t.tgt WHERE h.mode IN (1, 3) AND t.mode IN (2, 4)),
scored AS (SELECT *, CASE verdict WHEN 'both' THEN ov1 + ov2 WHEN 'head' THEN ov1 ELSE ov2 END AS score FROM pairing),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ref, tgt ORDER BY score DESC, head, head_k, head_pos, tail, tail_k, tail_pos) AS place FROM scored)"""
SHARED |= {
    "q55_best_junction_pair": f"WITH {PAIRED} SELECT ref, tgt, head, head_k, tail, tail_k, verdict, round(score, 4) + 0.0 AS score FROM ranked WHERE place = 1",
    "q56_junction_stats": "SELECT l_suppkey AS grp, count(*) AS n, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, max(l_quantity) AS max_ovlp, min(l_quantity) AS min_ovlp, min(CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS first_match FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, grp",
}
OWN |= {
    "q53_polya_trim": (q53, f"WITH {SEQS}, {tails.sql_run('tail', 'reverse(seq)', 'A', 3, 0.05)}, {tails.sql_run('head', 'seq', 'T', 3, 0.05)} SELECT doc_id, CASE WHEN tail.run >= length(seq) OR head.run >= length(seq) THEN NULL WHEN tail.run > 0 AND tail.run > head.run THEN substr(seq, 1, length(seq) - tail.run + 3) WHEN head.run > 0 THEN reverse(translate(substr(seq, head.run - 2), 'ACGT', 'TGCA')) ELSE seq END AS seq FROM s JOIN tail USING (doc_id) JOIN head USING (doc_id)"),
    "q57_both_strand_kmers": (q57, f"WITH {CLASSES}, both_k AS (SELECT c.id, list_distinct(list_transform(range(1, length(c.seq) - 6), lambda i: substr(c.seq, i, 8))) AS k, list_transform(range(1, length(c.seq) - 6), lambda i: substr(rc.seq, i, 8)) AS r FROM c JOIN rc USING (id)) SELECT id, CAST(len(k) AS BIGINT) AS n, CAST(len(list_distinct(list_concat(k, r))) AS BIGINT) AS n_both FROM both_k"),
}


def q70(spark, d):
    """Every contig with the class that stands for it and its copies elsewhere, and the shared 8-mers that a candidate for it needs."""
    known = classes(spark, d).select(F.col("id").alias("class_id"), "seq", "copies", S.count_limit(F.length("seq"), 4, 0.05, 2).alias("need"))
    return pieces(spark, d).join(known, "seq").select("class_id", "id", "doc_id", "copies", "need")


def q71(spark, d):
    """Reads of two mates written as FASTQ and read again; quality lines may begin with @."""
    reads = sequences(spark, d).select("doc_id", F.substring("seq", 1, 76).alias("first"), S.reverse_complement(F.expr("right(seq, 76)")).alias("second"))
    return formats.fastq_round_trip(reads)


def q72(spark, d):
    """Segments with their counts written and read again."""
    copies = (F.col("doc_id") % 5 + 1).cast("int")
    rows = counts.covered(sequences(spark, d).select(F.col("doc_id").alias("seg_id"), (F.length("seq") % 7).alias("group_id"), "seq", copies.alias("copies")))
    back = counts.texts(formats.segment_round_trip(rows), "")
    return back.select(F.col("seg_id").cast("long").alias("seg_id"), F.col("group_id").cast("long").alias("group_id"), F.col("len").cast("long").alias("len"), "seq", *"acgt")


def q73(spark, d):
    """Edges under a line of four numbers, written and read again."""
    return formats.edge_round_trip(relational(f"WITH {BRANCHES} SELECT src AS from_seg, dst AS to_seg FROM branch")(spark, d))


def q74(spark, d):
    """The end overlap of each pair of contigs that have 20 8-mers of their ends in common, on either strand."""
    rows = classes(spark, d)
    return overlaps.end_overlaps(stored(overlaps.end_candidates(rows, 20), "pairs"), rows, 24, 119, 0.05)


def q75(spark, d):
    """Later trimming passes: both tails are cut, nothing is turned; codes and letters back and forth."""
    cut = tails.trimmed(F.col("seq"), 3, 0.05, turn=False, both=True)
    return sequences(spark, d).select("doc_id", S.decoded(S.encoded(cut)).alias("seq"))


def sql_first(x: str, y: str) -> str:
    """The least overlap of x's tail with y's head."""
    return f"list_filter(range(24, least(length({x}), length({y}), 119) + 1), lambda n: hamming(right({x}, n), left({y}, n)) <= floor(n * 0.05 + 0.5))[1]"


ENDPAIR = f"""WITH {ENDS}, pairs AS (SELECT a, b, x.seq AS sa, y.seq AS sb, reverse(translate(y.seq, 'ACGT', 'TGCA')) AS rb FROM cand JOIN c x ON x.id = a JOIN c y ON y.id = b),
    tried AS (SELECT *, {sql_first('sb', 'sa')} AS n1, {sql_first('sa', 'sb')} AS n2, {sql_first('rb', 'sa')} AS n3, {sql_first('sa', 'rb')} AS n4 FROM pairs),
    listed AS (SELECT a, b, list_filter([[length(sb) - n1, n1, hamming(right(sb, n1), left(sa, n1))], [length(sb) - n2, -n2, hamming(right(sa, n2), left(sb, n2))], [n3 - length(sb), n3, hamming(right(rb, n3), left(sa, n3))], [n4 - length(sb), -n4, hamming(right(sa, n4), left(rb, n4))]], lambda x: x[1] IS NOT NULL) AS l FROM tried)
    SELECT a, b, m[1] AS pos, m[2] AS dep, m[3] AS dist FROM (SELECT a, b, coalesce(list_filter(l, lambda x: x[1] <> 0)[1], l[-1]) AS m FROM listed) WHERE m IS NOT NULL"""
OWN |= {
    "q70_contig_classes": (q70, f"WITH {CLASSES} SELECT c.id AS class_id, contigs.id AS id, doc_id, copies, CAST(floor(greatest((length(c.seq) - 4) / 4 - ceil(length(c.seq) * 0.05) * 2, 2) + 0.5) AS BIGINT) AS need FROM contigs JOIN c USING (seq)"),
    "q71_fastq_pairs": (q71, f"WITH {SEQS}, r AS (SELECT doc_id, 1 AS mate, left(seq, 76) AS seq FROM s UNION ALL SELECT doc_id, 2, reverse(translate(right(seq, 76), 'ACGT', 'TGCA')) FROM s) SELECT concat('read', doc_id) AS name, mate, seq, translate(seq, 'ACGT', '@IHG') AS qual FROM r"),
    "q72_segment_file": (q72, f"WITH {SEQS} SELECT doc_id AS seg_id, length(seq) % 7 AS group_id, length(seq) AS len, seq, " + ", ".join(f"array_to_string(list_transform(string_split(seq, ''), lambda x: CASE WHEN x = '{b}' THEN doc_id % 5 + 1 ELSE 0 END), '') AS {b.lower()}" for b in "ACGT") + " FROM s"),
    "q73_edge_file": (q73, f"WITH {BRANCHES} SELECT src AS from_seg, dst AS to_seg FROM branch"),
    "q74_end_overlaps": (q74, ENDPAIR),
    "q75_later_trimming": (q75, f"WITH {SEQS}, {tails.sql_run('tail', 'reverse(seq)', 'A', 3, 0.05)}, {tails.sql_run('head', 'seq', 'T', 3, 0.05)} SELECT doc_id, CASE WHEN tail.run >= length(seq) OR head.run >= length(seq) THEN NULL WHEN tail.run > 0 AND head.run > 0 THEN substr(seq, head.run - 2, length(seq) - head.run - tail.run + 6) WHEN tail.run > 0 THEN left(seq, length(seq) - tail.run + 3) WHEN head.run > 0 THEN substr(seq, head.run - 2) ELSE seq END AS seq FROM s JOIN tail USING (doc_id) JOIN head USING (doc_id)"),
}


def queries() -> dict:
    return dict(sorted({**{k: relational(v) for k, v in SHARED.items()}, **{k: v[0] for k, v in OWN.items()}}.items()))


def oracle_sql() -> dict:
    return dict(sorted({**SHARED, **{k: v[1] for k, v in OWN.items() if v[1]}}.items()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents' sequences."""
    return q10(spark, sf_dir)
