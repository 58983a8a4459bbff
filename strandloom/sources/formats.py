"""Text formats of sequence data: FASTA and FASTQ records, contigs, segments, read maps, alignment hits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import shared_dir, stored
from . import counts


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of multi-line FASTA: each record starts at a line with >."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    parts = F.split("v", "\n", 2)
    return text.select(F.get(parts, F.lit(0)).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq")).filter("header <> '' or seq <> ''")


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.text(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines of text files with their numbers from 0 in each file.

    Lines are counted within each split of a file; the driver holds one count for each split.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    starts, at, last = [], 0, None
    for file, split, n in rows.groupBy("file", "split").count().orderBy("file", "split").collect():
        at = 0 if file != last else at
        starts.append((file, split, at))
        at, last = at + n, file
    known = spark.createDataFrame(starts, "file string, split long, start long")
    number = F.row_number().over(Window.partitionBy("file", "split").orderBy("line")) - 1
    return rows.withColumn("number", number).join(known, ["file", "split"]).select("file", (F.col("start") + F.col("number")).alias("at"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq, qual) of records of four lines each, whatever their quality lines start with; read_id from 0 in each file."""
    rows = lines(spark, path).withColumn("read_id", F.floor(F.col("at") / 4).cast("long"))
    line = lambda i: F.max(F.when(F.col("at") % 4 == i, F.col("value")))
    rows = rows.groupBy("file", "read_id").agg(line(0).alias("name"), line(1).alias("seq"), line(3).alias("qual"))
    return rows.filter(F.col("name").startswith("@")).select("read_id", F.substring("name", 2, 1 << 30).alias("name"), "seq", "qual")


def read_fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(read_id, mate, name, seq, qual) of two files whose records belong together by their numbers."""
    side = lambda path, mate: read_fastq(spark, path).withColumn("mate", F.lit(mate))
    return side(first, 1).unionByName(side(second, 2)).select("read_id", "mate", "name", "seq", "qual")


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def file_kind(spark: SparkSession, path: str) -> str:
    """fasta or fastq by a file's first letter, else what follows the last dot of its name, in lower case."""
    first = spark.read.text(path).first()
    start = (first.value if first else "")[:1]
    return {">": "fasta", "@": "fastq"}.get(start) or (path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")


def fasta_counts(spark: SparkSession, path: str, least: int = 300) -> DataFrame:
    """One row (n, n_long): the records of a FASTA file and those of at least `least` letters, the last one included."""
    return read_fasta(spark, path).agg(F.count("*").alias("n"), F.count_if(F.length("seq") >= least).alias("n_long"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(name, idx, grp, len, abn, tpm, nrv, nrb, seq) of FASTA headers with these fields; len is that of the sequence.

    Records without a sequence or a header are left out; missing numbers are null.
    """
    words = F.split(F.trim("header"), r"\s+")
    word = lambda i, kind: F.get(words, F.lit(i)).try_cast(kind)
    rows = read_fasta(spark, path).filter("header <> '' and seq <> ''")
    return rows.select(word(0, "string").alias("name"), word(1, "int").alias("idx"), word(2, "int").alias("grp"), F.length("seq").alias("len"), word(4, "double").alias("abn"), word(5, "double").alias("tpm"), word(6, "int").alias("nrv"), word(7, "int").alias("nrb"), "seq")


def write_transcripts(df: DataFrame, path: str) -> None:
    head = F.concat_ws("\t", "name", "idx", "grp", F.length("seq"), "abn", "tpm", "nrv", "nrb")
    write_fasta(df.select(head.alias("header"), "seq"), path)


def write_by_threshold(df: DataFrame, path: str, thresholds: list[float]) -> DataFrame:
    """Transcripts of at least each depth, a folder MinCvgDepth=<threshold> for each; returns (threshold, n)."""
    limits = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("abn") >= t))
    rows = df.withColumn("threshold", limits)
    head = F.concat_ws("\t", "name", "idx", "grp", F.length("seq"), "abn", "tpm", "nrv", "nrb")
    out = rows.select(F.round("threshold").cast("long").alias("MinCvgDepth"), F.concat(F.lit(">"), head, F.lit("\n"), "seq").alias("value"))
    out.write.partitionBy("MinCvgDepth").text(path)
    return rows.groupBy("threshold").agg(F.count("*").alias("n"))


#: Columns of the match table, each under its own label.
MATCH_COLUMNS = "qid sid qlen alen slen qcvg scvg est_abn true_abn est_rpkm true_rpkm grp iso exp_cvg".split()


def write_matches(df: DataFrame, path: str, found: int | None = None) -> None:
    """Matches as tab-separated rows under a header, every value under its own label.

    found: the number of transcripts that were looked for, which goes to a table of one line, `@ n`, beside it.
    """
    df.select(MATCH_COLUMNS).write.csv(path, sep="\t", header=True)
    if found is not None:
        df.sparkSession.createDataFrame([(f"@ {found}",)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}.count")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignment hits with the coverage of subject and query."""
    # fixed values: the columns of the tabular hit format
    names = "qseqid sseqid qlen length slen qstart qend sstart send nident mismatch gapopen qcovs qcovhsp bitscore".split()
    schema = ", ".join(f"{n} {'string' if i < 2 else 'double'}" for i, n in enumerate(names))
    return spark.read.csv(path, sep="\t", schema=schema).withColumns({"scvg": F.col("length") / F.col("slen"), "qcvg": F.col("length") / F.col("qlen")})


def round_trip(seqs: DataFrame) -> DataFrame:
    """Sequences written as FASTA and read again."""
    path = f"{shared_dir(seqs.sparkSession)}/fasta-{uuid.uuid4().hex}"
    write_fasta(seqs.select(F.col("doc_id").cast("string").alias("header"), "seq"), path)
    return read_fasta(seqs.sparkSession, path).select(F.col("header").cast("long").alias("doc_id"), "seq")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(head, body): records that start at a line with >, the head's words and the lines after it."""
    lines = F.split(F.regexp_replace("value", "^>|\n+$", ""), "\n")
    rows = spark.read.option("lineSep", "\n>").text(path).select(lines.alias("l"))
    return rows.select(F.split(F.trim(F.get("l", F.lit(0))), r"\s+").alias("head"), F.slice("l", 2, 5).alias("body"))


def _counted(rows: DataFrame, *columns) -> DataFrame:
    """The columns of records and cov, the base counts by position from the four lines after the sequence."""
    return counts.parsed(rows.select(*columns, *[F.get("body", F.lit(i)).alias(b) for i, b in enumerate("acgt", 1)]))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(cntg_id, n_valid, n_total, seq, cov, depth) of six-line contig records; depth is the mean over positions."""
    rows = _records(spark, path)
    word = lambda i, t: F.get("head", F.lit(i)).cast(t)
    rows = _counted(rows, word(2, "int").alias("cntg_id"), word(3, "long").alias("n_valid"), word(4, "long").alias("n_total"), F.get("body", F.lit(0)).alias("seq"))
    total = F.aggregate("cov", F.lit(0).cast("long"), lambda s, x: s + x["a"] + x["c"] + x["g"] + x["t"])
    return rows.withColumn("depth", total / F.length("seq"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(seg_id, group_id, len, seq, cov) of six-line segment records."""
    rows = _records(spark, path)
    word = lambda i: F.get("head", F.lit(i)).cast("int")
    return _counted(rows, word(1).alias("seg_id"), word(2).alias("group_id"), word(3).alias("len"), F.get("body", F.lit(0)).alias("seq"))


def write_segments(df: DataFrame, path: str) -> None:
    """Segments (seg_id, group_id, seq, cov) as six-line records; the length is that of the sequence."""
    head = F.concat_ws("\t", F.lit(">Segment"), "seg_id", "group_id", F.length("seq"))
    counts.texts(df.select("seg_id", "group_id", "seq", "cov"), " ").select(F.concat_ws("\n", head, "seq", *"acgt").alias("value")).write.text(path)


def write_contigs(df: DataFrame, path: str) -> None:
    """Contigs (cntg_id, n_valid, n_total, seq, cov) as six-line records."""
    head = F.concat_ws("\t", F.lit(">Contig"), "cntg_id", "cntg_id", "n_valid", "n_total")
    counts.texts(df.select("cntg_id", "n_valid", "n_total", "seq", "cov"), "\t").select(F.concat_ws("\n", head, "seq", *"acgt").alias("value")).write.text(path)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the whole numbers of one text file in order, at from 0.

    Lines are counted within each split of the file; the driver holds one sum per split.
    """
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), words.alias("words"))
    sums, starts, at = rows.groupBy("split").agg(F.sum(F.size("words")).alias("n")).orderBy("split").collect(), [], 0
    for split, n in sums:
        starts.append((split, at))
        at += n
    window = Window.partitionBy("split").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.sum(F.size("words")).over(window) - F.size("words")).join(F.broadcast(spark.createDataFrame(starts, "split long, start long")), "split")
    rows = rows.select((F.col("start") + F.col("before")).alias("first"), F.posexplode("words").alias("i", "word"))
    return rows.select((F.col("first") + F.col("i")).alias("at"), F.col("word").cast("long").alias("value"))


def read_read_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contigs (cntg_id, parent_id) and reads (read_id, cntg1, cntg2), ids from 1, of one read-map file.

    The file: the number of contigs, a pointer for each, the number of reads, two contigs for each. Reads
    beyond the number that the file names are left aside.
    """
    numbers = stored(_numbered(spark, path), "numbers")
    held = lambda at: (numbers.filter(F.col("at") == at).first() or [0, 0])[1]
    n = held(0)
    reads = held(n + 1)
    contigs = numbers.filter(F.col("at").between(1, n)).select(F.col("at").alias("cntg_id"), F.col("value").alias("parent_id"))
    place = F.col("at") - (n + 2)
    pairs = numbers.filter((place >= 0) & (place < 2 * reads)).withColumn("read_id", F.floor(place / 2).cast("long") + 1)
    mate = lambda i: F.max(F.when(F.pmod(place, F.lit(2)) == i, F.col("value"))).alias(f"cntg{i + 1}")
    return contigs, pairs.groupBy("read_id").agg(mate(0), mate(1))


def _write_headed(head: DataFrame, rows: DataFrame, path: str) -> None:
    """A header line, then tab-separated rows; the header is the first part, so the parts in order are the file."""
    lines = rows.select(F.concat_ws("\t", *rows.columns).alias("value"))
    head.coalesce(1).unionByName(lines).write.text(path)


def write_read_groups(df: DataFrame, path: str) -> None:
    """Rows (read_id, group1, group2) after a line with their number."""
    rows = df.select("read_id", "group1", "group2")
    _write_headed(rows.agg(F.count("*").cast("string").alias("value")), rows, path)


def write_edges(df: DataFrame, path: str, n_segments: int, n_groups: int, n_valid: int, n_total: int) -> None:
    """Rows (from_seg, to_seg) after a line with the four numbers."""
    head = df.sparkSession.range(1).select(F.lit(f"{n_segments} {n_groups} {n_valid} {n_total}").alias("value"))
    _write_headed(head, df.select("from_seg", "to_seg"), path)


def _fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The lines that have as many numbers as names; a header has more or fewer."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).filter(F.size("w") == len(names))
    return rows.select(*[F.get("w", F.lit(i)).cast("long").alias(n) for i, n in enumerate(names)])


def read_read_groups(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, ["read_id", "group1", "group2"])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, ["from_seg", "to_seg"])


def read_group_round_trip(groups: DataFrame) -> DataFrame:
    """Read groups written with their header and read again."""
    path = f"{shared_dir(groups.sparkSession)}/groups-{uuid.uuid4().hex}"
    write_read_groups(groups, path)
    return read_read_groups(groups.sparkSession, path)


def hits_round_trip(hits: DataFrame) -> DataFrame:
    """Hits (qseqid, sseqid, qlen, length, slen, nident, mismatch) written as a table of hits and read again."""
    path = f"{shared_dir(hits.sparkSession)}/hits-{uuid.uuid4().hex}"
    zero = F.lit(0)
    hits.select("qseqid", "sseqid", "qlen", "length", "slen", F.lit(1), "length", F.lit(1), "length", "nident", "mismatch", zero, zero, zero, zero).toDF(*map(str, range(15))).write.csv(path, sep="\t")
    return read_hits(hits.sparkSession, path)


def write_fastq(df: DataFrame, path: str) -> None:
    """Reads (name, seq, qual) as records of four lines."""
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value")).write.text(path)


def fastq_round_trip(reads: DataFrame) -> DataFrame:
    """(name, mate, seq, qual) of reads (doc_id, first, second) written as two tables of FASTQ and read again."""
    path = f"{shared_dir(reads.sparkSession)}/reads-{uuid.uuid4().hex}"
    for mate in ("first", "second"):
        write_fastq(reads.select(F.concat(F.lit("read"), "doc_id").alias("name"), F.col(mate).alias("seq"), F.translate(mate, "ACGT", "@IHG").alias("qual")), f"{path}/{mate}")
    return read_fastq_pairs(reads.sparkSession, f"{path}/first", f"{path}/second").select("name", "mate", "seq", "qual")


def segment_round_trip(rows: DataFrame) -> DataFrame:
    """Segments written as six-line records and read again."""
    path = f"{shared_dir(rows.sparkSession)}/segments-{uuid.uuid4().hex}"
    write_segments(rows, path)
    return read_segments(rows.sparkSession, path)


def edge_round_trip(edges: DataFrame) -> DataFrame:
    """Edges (from_seg, to_seg) written under a header with their nodes' number and their own, and read again."""
    path = f"{shared_dir(edges.sparkSession)}/edges-{uuid.uuid4().hex}"
    n = edges.select(F.explode(F.array("from_seg", "to_seg")).alias("node")).agg(F.count_distinct("node").alias("nodes"), F.count("*").alias("ends")).first()
    write_edges(edges, path, n.nodes, 1, n.ends // 2, n.ends // 2)
    return read_edges(edges.sparkSession, path)
