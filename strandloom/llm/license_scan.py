"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined with the positions of the same k-grams in license
templates. A match votes for its diagonal (text position less template position); neighbouring diagonals are
merged, so single inserted or lost words don't split a span, and a span counts where enough of its template's
k-grams are met and, by comparison of the words themselves, enough of its words. Fixed phrases are found as
consecutive words beside that. Texts are scanned once; only those with a span are read again to verify it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .license_texts import TEMPLATES
from .util import documents, pieces, stored, text_column

GRAM, DRIFT, LEAST = 4, 3, 0.6
#: Templates of up to this many k-grams together (a few MB) are broadcast; more are joined.
SMALL = 100_000

#: Bytes of a word: 0-9, a-z and all beyond ASCII (after A-Z are lower-cased).
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow column, and per text the index of its first."""
    data, bounds = K.utf8(column)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, bounds, IS_WORD)
    return K.span_hashes(data, starts, ends), first


def template_grams(templates: dict = TEMPLATES, k: int = GRAM) -> list[tuple]:
    """(gram, template, label, position, n_grams) of every template; a short template has fewer positions."""
    out, number = [], 0
    for label, texts in templates.items():
        for text in texts:
            words, _ = word_hashes(pa.array([text]))
            grams = K.chained(words, k).view(np.int64)
            out += [(int(g), number, label, i, len(grams)) for i, g in enumerate(grams)]
            number += 1
    return out


def scan(k: int = GRAM, phrases: dict = PHRASES):
    """Per text: the phrases' places and labels, and all k-gram hashes."""
    known = [(label, word_hashes(pa.array([phrase]))[0]) for phrase, label in phrases.items()]

    def stage(batches):
        for batch in pieces(batches):
            hashes, first = word_hashes(batch.column("text"))
            n = len(first) - 1
            owner = np.repeat(np.arange(n), np.diff(first))
            counts, low, high, labels = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1), [[] for _ in range(n)]
            for label, words in known:
                size = len(hashes) - len(words) + 1
                if size < 1:
                    continue
                hit = np.ones(size, bool)
                for i, w in enumerate(words):
                    hit &= hashes[i : i + size] == w
                at = np.flatnonzero(hit)
                at = at[owner[at] == owner[at + len(words) - 1]]
                np.add.at(counts, owner[at], 1)
                np.minimum.at(low, owner[at], at - first[owner[at]])
                np.maximum.at(high, owner[at], at - first[owner[at]])
                for i in np.unique(owner[at]):
                    labels[i].append(label)
            every = K.chained(hashes, k).view(np.int64)
            sizes = np.maximum(np.diff(first) - k + 1, 0)
            # each list starts with a null, which is the row of the text's measures
            ends = np.concatenate([[0], np.cumsum(sizes + 1)])
            grams, head = np.zeros(ends[-1], np.int64), np.zeros(ends[-1], bool)
            head[ends[:-1]] = True
            grams[~head] = every[K.ragged(first[:-1], sizes)]
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams, mask=head))
            none = counts == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), pa.array(np.diff(first)), pa.array(counts), pa.array(low, mask=none), pa.array(high.astype(np.int64), mask=none), pa.array(labels, pa.list_(pa.string())), grams],
                names=["doc_id", "place", "n_words", "n_base", "first_word", "last_word", "found", "grams"],
            )

    return stage


def checked(templates: dict, least: float):
    """Over texts with their candidate spans: the spans of which enough of the template's words stand where its diagonals say."""
    known = [(label, _words(text)) for label, texts in templates.items() for text in texts]

    def stage(batches):
        for batch in pieces(batches):
            rows = []
            for doc_id, place, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "text", "asked"))):
                at: dict = {}
                for i, w in enumerate(_words(text)):
                    at.setdefault(w, []).append(i)
                for x in asked:
                    label, words = known[x["template"]]
                    met = 0
                    for i, w in enumerate(words):
                        own = at.get(w, [])
                        j = bisect_left(own, i + x["low"])
                        met += j < len(own) and own[j] <= i + x["high"]
                    if met >= least * len(words):
                        rows.append((doc_id, place, x["template"], label, x["first"], x["last"], met / len(words)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "place", "template", "label", "first", "last", "coverage"])

    return stage


def _words(text: str) -> list[bytes]:
    """The words themselves, A-Z in lower case."""
    data, bounds = K.utf8(pa.array([text]))
    data = K.LOWER[data]
    starts, ends, _ = K.words(data, bounds, IS_WORD)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def scanned(df: DataFrame, templates: dict = TEMPLATES, k: int = GRAM, drift: int = DRIFT, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """The texts' measures, and the verified spans (doc_id, place, template, label, first, last, coverage in words).

    A null text counts as empty; texts shorter than k words have no k-grams. Equal rows have equal results; a
    row is known by doc_id and place, a hash of its text. Other columns are left aside.
    """
    spark = df.sparkSession
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.xxhash64(text_column()).alias("place"))
    schema = "doc_id long, place long, n_words long, n_base long, first_word long, last_word long, found array<string>, grams array<long>"
    grams = template_grams(templates, k)
    known = spark.createDataFrame(grams, "gram long, template int, label string, at long, n_grams long")
    rows = texts.mapInArrow(scan(k), schema)
    rows = rows.select(*(c for c in rows.columns if c != "grams"), F.posexplode("grams").alias("pos", "gram")).withColumn("pos", F.col("pos") - 1)
    # one pass over the texts: their measures (position -1) and the k-grams that a template has
    marks = stored(rows.join(F.broadcast(known) if len(grams) <= SMALL else known, "gram", "left").filter("pos < 0 OR template IS NOT NULL"), "marks")
    measures = marks.filter("pos < 0").select("doc_id", "place", "n_words", "n_base", "first_word", "last_word", "found")
    own = ["doc_id", "place", "template", "label", "n_grams"]
    votes = marks.filter("pos >= 0").select(*own, "pos", "at").distinct().withColumn("diagonal", F.col("pos") - F.col("at"))
    lines = votes.groupBy(*own, "diagonal").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id", "place", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > drift) | F.lag("diagonal").over(order).isNull()
    lines = lines.withColumn("span", F.sum(fresh.cast("int")).over(order))
    # the share of the template's k-grams that the merged diagonals meet
    spans = votes.join(lines.select("doc_id", "place", "template", "diagonal", "span").withColumnsRenamed({"doc_id": "d", "place": "p", "template": "t", "diagonal": "g"}), votes.doc_id.eqNullSafe(F.col("d")) & (votes.place == F.col("p")) & (votes.template == F.col("t")) & (votes.diagonal == F.col("g")))
    spans = spans.groupBy(*own, "span").agg(F.count_distinct("at").alias("met"), F.min("pos").cast("long").alias("first"), (F.max("pos") + k - 1).cast("long").alias("last"), F.min("diagonal").cast("long").alias("low"), F.max("diagonal").cast("long").alias("high"))
    spans = spans.filter(F.col("met") >= least * F.col("n_grams"))
    asked = spans.groupBy(F.col("doc_id").alias("d"), F.col("place").alias("p")).agg(F.collect_list(F.struct("template", "first", "last", "low", "high")).alias("asked"))
    found = texts.join(asked, texts.doc_id.eqNullSafe(F.col("d")) & (texts.place == F.col("p"))).select("doc_id", "place", "text", "asked")
    verified = found.mapInArrow(checked(templates, least), "doc_id long, place long, template int, label string, first long, last long, coverage double").distinct()
    return measures, verified


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and the best template coverage of every document.

    score is the largest coverage of a verified span; without one, 0.5 where a phrase was found, else 0.
    """
    measures, spans = scanned(documents(spark, sf_dir))
    best = spans.groupBy("doc_id", "place").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage")).withColumnsRenamed({"doc_id": "d", "place": "p"})
    rows = measures.join(best, measures.doc_id.eqNullSafe(F.col("d")) & (measures.place == F.col("p")), "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = joined(F.col("found"))
    labels = joined(F.concat("found", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.coalesce(F.col("coverage"), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", base.alias("base_labels"), labels.alias("labels"), score.cast("double").alias("score"))
