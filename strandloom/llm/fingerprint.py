"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every distinct shingle hash (five words, in lower case) below a fixed fraction of the hash
range. Sketches of one fraction merge by union, and the share of one sketch that stands in another estimates
containment, however unequal the documents are. A text whose hashes all lie above the fraction keeps its
smallest one, so only a text without words has an empty sketch; this rule also survives a merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import GAP, aside, documents, shuffle_partitions, text_column

#: Hashes are 40 bits; a sketch keeps those below 2**40 / SCALE.
BITS, SCALE, WIDTH = 40, 4, 5


def hashes(text: Column, width: int = WIDTH) -> Column:
    """40-bit hashes of the distinct shingles, unordered; a shorter text has one shingle, no words none."""
    words = F.filter(F.split(F.lower(text), GAP), lambda w: w != "")
    return F.transform(F.array(words), lambda w: _shingle_hashes(w, width))[0]


def _shingle_hashes(words: Column, width: int) -> Column:
    mask = F.lit((1 << BITS) - 1)
    one = F.array(F.xxhash64(F.array_join(words, " ")).bitwiseAND(mask))
    many = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(width)]).bitwiseAND(mask))
    return F.when(F.size(words) >= width, many).when(F.size(words) > 0, one).otherwise(F.array().cast("array<bigint>"))


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The ascending retained hashes of one text."""
    return F.transform(F.array(hashes(text)), lambda h: retained(h, scale))[0]


def retained(values: Column, scale: int = SCALE) -> Column:
    limit = F.lit((1 << BITS) // scale)
    return F.transform(F.array(F.filter(values, lambda h: h < limit)), lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(values) > 0, F.array(F.array_min(values))).otherwise(low))[0]


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two documents' shingles."""
    return retained(F.array_union(a, b), scale)


def resemblance(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard likeness; two empty sketches are alike (1), an empty and another are not (0)."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def rendered(a: Column) -> Column:
    """A sketch as text: ten hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def with_next(df: DataFrame, key: str = "doc_id", values: tuple[str, ...] = ("text",), derived: dict[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """df with next_<value>: the value of the row that follows by descending key; after the last row the first.

    derived: further columns, made after the exchange, that get a next_<name> too. Rows with a null key follow
    all others; equal keys are ordered by the values. Other columns are kept. Only one exchange moves the
    values. Bounds between buckets are keys that occur, from approximate percentiles of the key alone; each
    bucket also gets the row just below it, so a window per bucket finds every follower. The driver holds the
    bounds, `buckets` numbers whatever the number of rows.
    """
    spark = df.sparkSession
    df, names = aside(df, (key, *values))
    buckets = buckets or 8 * shuffle_partitions(spark)
    at = F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("bounds")
    found = df.agg(at, F.max(key).alias("most")).first()
    bounds = sorted(set(found["bounds"] or []) - {found["most"]})
    step = max(1, int(len(bounds) ** 0.5))
    groups = F.array(*[F.array(*[F.lit(x) for x in bounds[i : i + step]]) for i in range(0, max(len(bounds), 1), step)]).cast("array<array<bigint>>")
    # two levels of comparison: first with every step-th bound, then within that stretch
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(key)))
    head = below(F.array(*[F.lit(x) for x in bounds[::step]]).cast("array<bigint>"))
    bucket = F.when(F.col(key).isNull() | (head == 0), 0).otherwise((head - 1) * step + below(F.get(groups, head - 1)))
    # the row at a bound is the first of its bucket; the bucket above ends with a copy of it
    own, at = F.col("__bucket"), F.col("__bucket").cast("long")
    closing = F.get(F.get(groups, F.floor(at / step).cast("int")), (at % step).cast("int"))
    most = F.lit(found["most"]).cast("bigint")
    copies = F.when(F.col(key) == most, F.array(own, F.lit(-1))).when(F.col(key) == closing, F.array(own, own + 1)).otherwise(F.array(own))
    df = df.withColumn("__bucket", bucket.cast("int")).withColumn("__at", F.explode(copies))
    # -1 marks the copy of the very first row that ends bucket 0
    df = df.withColumn("__copy", F.col("__at") != F.col("__bucket")).withColumn("__at", F.greatest("__at", F.lit(0)))
    order = [F.col("__copy"), F.col(key).desc_nulls_last(), *[F.col(v) for v in values]]
    own = (*values, *(derived or ()))
    df = df.repartition("__at").withColumns(derived or {})
    window = Window.partitionBy("__at").orderBy(*order)
    # without any key there is no copy that ends the order: after the last row comes the window's first
    start = (lambda v: F.first(v).over(window)) if found["most"] is None else F.col
    df = df.withColumns({f"__next_{v}": F.lead(v).over(window) for v in own} | {f"__first_{v}": start(v) for v in own} | {"__end": F.lead(F.lit(1)).over(window)})
    first = [F.coalesce(F.col(f"__next_{v}"), F.when(F.col("__end").isNull(), F.col(f"__first_{v}"))).alias(f"next_{v}") for v in own]
    made = {*(derived or ()), *(f"next_{v}" for v in own)}
    return df.filter(~F.col("__copy")).select(*[F.col(n).alias(c) for c, n in names.items() if c not in made], *(derived or ()), *first)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and of its edited text, and their likeness.

    Null texts count as empty. near_edited and near_next are Jaccard estimates; edited_containment and
    next_containment say what share of the text's own sketch the other has.
    """
    df = documents(spark, sf_dir).select("doc_id", text_column().alias("text"))
    df = with_next(df, derived={"sketch": sketch(F.col("text"))})
    n = F.char_length("text").cast("long")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    df = df.select("doc_id", n.alias("n_chars"), edited.alias("edited"), F.col("sketch").alias("text"), F.col("next_sketch").alias("next_text"))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", sketch(F.col("edited")).alias("edited"), "next_text")
    near = [resemblance(F.col("text"), F.col(c)) for c in ("edited", "next_text")] + [containment(F.col("text"), F.col(c)) for c in ("edited", "next_text")]
    return df.select("doc_id", "n_chars", "edited_sha256", rendered(F.col("text")).alias("fingerprint"), rendered(F.col("edited")).alias("edited_fingerprint"), near[0].alias("near_edited"), near[1].alias("near_next"), near[2].alias("edited_containment"), near[3].alias("next_containment"))
