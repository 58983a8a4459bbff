"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, white space collapsed) and hashed. For each host (here: source) the number
of distinct documents that hold a line is counted; a whole-document copy counts once, as copies are the
business of deduplication. Lines in more than LIMIT_SHARE of a host's distinct documents, and in more than
LIMIT_DOCS, are boilerplate and are removed, as are those in more than LIMIT_MANY documents of any host, however
large. A document of which too little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import WORD, aside, documents, stored, text_column

#: A line is boilerplate of a host above this share of its distinct documents, and above this number of them.
LIMIT_SHARE, LIMIT_DOCS = 0.1, 10
#: Above this number of a host's distinct documents a line is boilerplate whatever its share.
LIMIT_MANY = 10_000
#: A document is depleted with fewer words left, or a smaller share of its words left.
LEAST_WORDS, LEAST_SHARE = 10, 0.2
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words that stand twice or more in the text, the first place included."""
    window = lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(width)])
    hashes = F.when(F.size(words) > width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), window)).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        # sorted by hash, then place: neighbours of one hash are repeats
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(ordered, lambda o: F.array_sort(F.transform(F.filter(F.transform(o, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"])).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))
        total = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(width), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
        return F.when(F.size(F.array_distinct(h)) < F.size(h), total).otherwise(F.lit(0).cast("long"))

    return let(hashes, covered)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_hashes(text: Column) -> Column:
    """A hash of each line; 0 for a line without words."""
    return F.transform(F.split(text, "\n", -1), lambda x: let(normalised(x), lambda y: F.when(y == "", F.lit(0).cast("long")).otherwise(F.xxhash64(y))))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", share: float = LIMIT_SHARE, least: int = LIMIT_DOCS, many: int = LIMIT_MANY) -> DataFrame:
    """(__host, __line, n_docs): the lines of each host above the limits."""
    rows = df.select(F.col(host).alias("__host"), F.xxhash64(text_column(text)).alias("__doc"), F.array_distinct(F.filter(line_hashes(text_column(text)), lambda h: h != 0)).alias("__lines"))
    counts = rows.select("__host", "__doc").distinct().groupBy("__host").agg(F.count("*").alias("__docs"))
    lines = rows.select("__host", "__doc", F.explode("__lines").alias("__line")).distinct().groupBy("__host", "__line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > least)
    lines = lines.join(counts.withColumnRenamed("__host", "__of"), F.col("__host").eqNullSafe(F.col("__of")))
    return lines.filter((F.col("n_docs") > share * F.col("__docs")) | (F.col("n_docs") > many)).select("__host", "__line", "n_docs")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base measures of its texts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.col("__text")
    df = df.withColumn("__text", text_column(text)).withColumn("__words", F.regexp_extract_all(t, F.lit(WORD), 0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(F.col("__words")),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__text", "__words")


def flagged(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(__doc, __host, __flagged): for each distinct text of a host with boilerplate, the hashes of those lines."""
    found = boilerplate(df, host, text)
    rows = df.select(F.col(host).alias("__host"), F.xxhash64(text_column(text)).alias("__doc"), F.explode(F.array_distinct(F.filter(line_hashes(text_column(text)), lambda h: h != 0))).alias("__line"))
    found = found.select(F.coalesce(F.col("__host"), F.lit("")).alias("__h"), F.col("__host").isNull().alias("__null"), F.col("__line").alias("__l"))
    rows = rows.join(found, (F.coalesce(F.col("__host"), F.lit("")) == F.col("__h")) & (F.col("__host").isNull() == F.col("__null")) & (F.col("__line") == F.col("__l")))
    return rows.groupBy("__doc", "__host").agg(F.collect_set("__line").alias("__flagged"))


def judged(df: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df with the measures, the number of words in boilerplate lines, kept, and (where text is carried) the cleaned text.

    Null or empty texts have no words, so base_failed holds and kept is false. A null host is a host of its
    own. Equal rows get equal verdicts. carry: columns to return besides; with text among them, `cleaned` is
    the text without its boilerplate lines. A carried column with the name of a measure is replaced.
    """
    carry = df.columns if carry is None else carry
    df, names = aside(df, (host, text))
    rows = _judged(df, host, text, [names[c] for c in carry])
    results = [c for c in MEASURES if c in rows.columns]
    return rows.select(*[F.col(names[c]).alias(c) for c in carry if c not in results], *results)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept", "cleaned")


def _judged(df: DataFrame, host: str, text: str, carry: list[str]) -> DataFrame:
    marks = flagged(df, host, text).select(F.col("__doc").alias("__d"), F.coalesce(F.col("__host"), F.lit("")).alias("__h"), F.col("__host").isNull().alias("__null"), "__flagged")
    lines = F.split(text_column(text), "\n", -1)
    counts = F.transform(lines, lambda x: let(normalised(x), lambda y: F.struct(F.when(y == "", F.lit(0).cast("long")).otherwise(F.xxhash64(y)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))))
    rows = measured(df, text).withColumn("__doc", F.xxhash64(text_column(text)))
    whole = text in carry
    rows = rows.select(*[c for c in dict.fromkeys([*carry, host])], *([] if whole else [counts.alias("__counts")]), "__doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = rows.join(marks, (F.col("__doc") == F.col("__d")) & (F.coalesce(F.col(host), F.lit("")) == F.col("__h")) & (F.col(host).isNull() == F.col("__null")), "left")
    gone = F.aggregate(F.filter(counts if whole else F.col("__counts"), lambda x: F.array_contains("__flagged", x["h"])), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = rows.withColumn("n_removed_words", F.when(F.col("__flagged").isNull(), F.lit(0).cast("long")).otherwise(gone))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~depleted)
    if whole:
        kept_lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: ~let(normalised(x), lambda y: F.array_contains("__flagged", F.xxhash64(y)) & (y != "")))
        rows = rows.withColumn("cleaned", F.when(F.col("__flagged").isNull(), F.col(text)).otherwise(F.array_join(kept_lines, "\n")))
    return rows.drop("__doc", "__d", "__h", "__null", "__flagged", "__counts")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of the line rules."""
    df = documents(spark, sf_dir).select("doc_id", "text", "source")
    out = judged(df, carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their boilerplate lines.

    Null and empty texts are rejected, a null source is a host of its own, an empty table stays empty.
    """
    # written before the filter: pushed below the measures, it would have every word of a text extract all words
    rows, names = aside(docs, ("text", "source"))
    columns = [x for c, x in names.items() if c != "text"]
    out = stored(judged(rows).select(*columns, "cleaned", "kept"), "judged").filter("kept")
    return out.select([(F.col("cleaned") if c == "text" else F.char_length("cleaned").cast("long") if c == "n_chars" else F.col(x)).alias(c) for c, x in names.items()])
