"""Exact substring dedup by a sparse enhanced suffix array.

Every string of LENGTH bytes holds the smallest hash of its GRAM-byte grams, wherever it stands. So only the
suffixes that start at such anchors are sorted, in one bucket per gram. Within a bucket an enhanced suffix
array (sorted right contexts with their common prefix lengths) is scanned with a stack into its common-prefix
intervals; members of an interval are told apart by their left extensions, and intervals that extend
differently to the left are the maximal repeats. Each repeat is output with all its occurrences; every one but
the first is removable. Occurrences of one whole context (GRAM's window to both sides) are one class from the
start, known by two 64-bit hashes (of the gram and of the context).

A gram with more than HOT classes (a passage in very many surroundings) is not sorted by one task: the strings of
LENGTH bytes around it are dealt by their own hashes instead, and all but the first place of each are removable,
which is the same result by as many light rows as a suffix has places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .util import documents, pieces, stored, text_column

LENGTH, GRAM = 100, 40
LEFT, RIGHT = LENGTH - GRAM, LENGTH
#: Classes of one gram that are sorted together.
HOT = 1024
#: The place in the order of rows without doc_id: after all others.
LAST = np.iinfo(np.int64).max


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > ends[:-1]
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions of one text, their gram hashes and hashes of their whole contexts."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = K.gram_hashes(text, GRAM)
    grams &= ~K.U64(1)  # odd keys are those of whole strings
    at = K.sliding_minima(grams, LENGTH - GRAM + 1)
    low, high = np.maximum(at - LEFT, 0), np.minimum(at + RIGHT, len(text))
    context = K.mix(K.range_hashes(text, low, high) + (at - low).astype(np.uint64))
    return at, grams[at], context


def scanned(kind: str):
    """Per slice of rows: the first occurrence of each (gram, context), the spans of the others ("gone"), or all ("every")."""

    def stage(batches):
        for batch in pieces(batches):
            data, bounds = K.utf8(batch.column("text"))
            ids = np.asarray(batch.column("doc_id").fill_null(LAST))
            places = np.asarray(batch.column("place"))
            found = [anchors(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            sizes = np.array([len(x[0]) for x in found], np.int64)
            row = np.repeat(np.arange(len(ids)), sizes)
            at, key, context = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
            size = np.diff(bounds)[row]
            order = np.lexsort((at, places[row], ids[row], context, key))
            row, at, key, context, size = row[order], at[order], key[order], context[order], size[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            same = (ids[row] == ids[row[head]]) & (places[row] == places[row[head]]) & (at == at[head])
            if kind == "gone":
                away = np.flatnonzero(~same)
                away = away[np.argsort(row[away], kind="stable")]
                start, end = np.maximum(at[away] - LEFT, 0), np.minimum(at[away] + RIGHT, size[away])
                # one merge for all rows: their spans are moved apart
                shift = row[away] * (int(size.max(initial=0)) + 2)
                start, end = merged(start + shift, end + shift)
                owner = start // (int(size.max(initial=0)) + 2)
                shift = owner * (int(size.max(initial=0)) + 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(places[owner]), pa.array(start - shift), pa.array(end - shift)], names=["doc_id", "place", "start", "end"])
            else:
                fresh |= kind == "every"
                r = row[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(key[fresh].view(np.int64)), pa.array(context[fresh].view(np.int64)), pa.array(ids[r]), pa.array(places[r]), pa.array(at[fresh]), pa.array(size[fresh])], names=["key", "context", "doc_id", "place", "at", "size"])

    return stage


def classes(batches):
    """Over rows sorted by (key, context, doc_id, place, at): the spans of all but the first of a class (key null),
    and the first of each class where a gram has several classes (start is its place). Only one row is carried on."""
    last = None  # the class's first row: key, context, doc_id, place, at
    waiting = None  # the gram's first class, until a second one comes
    for batch in batches:
        if not batch.num_rows:
            continue
        key, context, ids, places, at, size = (np.asarray(batch.column(c)) for c in ("key", "context", "doc_id", "place", "at", "size"))
        fresh, other = np.ones(len(key), bool), np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
        other[1:] = key[1:] != key[:-1]
        if last is not None:
            fresh[0] = (key[0], context[0]) != last[:2]
            other[0] = key[0] != last[0]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
        same = (ids == ids[head]) & (places == places[head]) & (at == at[head])
        early = head < 0
        if early.any():
            same[early] = (ids[early] == last[2]) & (places[early] == last[3]) & (at[early] == last[4])
        away = ~same
        firsts = np.flatnonzero(fresh)
        begins = other[firsts]
        several = ~begins  # belongs to a gram with a second class
        several[:-1] |= ~begins[1:]
        out = firsts[several]
        columns = [key[out], ids[out], places[out], at[out]]
        if len(firsts):
            if waiting is not None and not begins[0]:
                columns = [np.concatenate([[w], c]) for w, c in zip(waiting, columns)]
            i = firsts[-1]
            waiting = (key[i], ids[i], places[i], at[i]) if begins[-1] else None
            last = (key[i], context[i], ids[i], places[i], at[i])
        n = int(away.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([columns[0], np.zeros(n, np.int64)]), mask=np.arange(len(columns[0]) + n) >= len(columns[0]))]
            + [pa.array(np.concatenate(x)) for x in ((columns[1], ids[away]), (columns[2], places[away]), (columns[3], np.maximum(at - LEFT, 0)[away]), (columns[3], np.minimum(at + RIGHT, size)[away]))],
            names=["key", "doc_id", "place", "start", "end"],
        )


FIELDS = ["key", "doc_id", "place", "at", "left", "right", "before", "after"]
CONTEXTS = "key long, doc_id long, place long, at long, left long, right long, before binary, after binary"


def strings(batch, row, bounds, data, at):
    """The strings of LENGTH bytes that hold the gram at each place: their hashes as keys, their own places."""
    for i in np.unique(row):
        text = data[bounds[i] : bounds[i + 1]]
        own = at[row == i]
        low, high = np.maximum(own - LEFT, 0), np.minimum(own, len(text) - LENGTH)
        start = np.unique(K.ragged(low, np.maximum(high - low + 1, 0)))
        key = K.range_hashes(text, start, start + LENGTH) | K.U64(1)
        n = len(start)
        same = lambda c: pa.array(np.full(n, np.asarray(batch.column(c))[i]))  # noqa: E731,B023
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), same("doc_id"), same("place"), pa.array(start), *[pa.array(np.full(n, -1, np.int64))] * 2, *[pa.nulls(n, pa.binary())] * 2], names=FIELDS)


def contexts(batches):
    """Left (reversed) and right contexts of the asked anchors of each text; for hot grams their strings (left is -1)."""
    for batch in pieces(batches):
        data, bounds = K.utf8(batch.column("text"))
        lists = batch.column("asked")
        offsets = np.asarray(lists.offsets)
        asked = lists.flatten()
        key, at, hot = (np.asarray(asked.field(c)) for c in ("key", "at", "hot"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        hot = hot.astype(bool)
        yield from strings(batch, row[hot], bounds, data, at[hot])
        key, at, row = key[~hot], at[~hot], row[~hot]
        start, end = bounds[:-1][row], bounds[1:][row]
        here = start + at
        left, right = np.minimum(at, LEFT), np.minimum(end - here, RIGHT)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(RIGHT, np.uint8)])
        for i in range(0, len(at), 1 << 14):
            p = slice(i, i + (1 << 14))
            window = padded[here[p, None] + np.arange(LEFT + RIGHT)[None, :]]
            before = window[:, :LEFT][:, ::-1] * (np.arange(LEFT) < left[p, None])
            after = window[:, LEFT:] * (np.arange(RIGHT) < right[p, None])
            take = lambda c: np.asarray(batch.column(c))[row[p]]  # noqa: E731,B023
            fixed = lambda m, n: pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(m), [None, pa.py_buffer(np.ascontiguousarray(m, dtype=np.uint8).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(take("doc_id")), pa.array(take("place")), pa.array(at[p]), pa.array(left[p]), pa.array(right[p]), fixed(before, LEFT), fixed(after, RIGHT)], names=FIELDS)


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows, at most `most`."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def intervals(prefix: np.ndarray) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a suffix array, inner ones first, by a stack scan.

    prefix[i] is the common prefix length of suffixes i and i + 1.
    """
    out, stack = [], []
    for i, n in enumerate([*prefix.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            out.append((length, first, i))
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, first))
    return out


def repeats(doc: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Maximal repeats of LENGTH or more around one gram: (left length, right length, members).

    doc: the order of occurrences. Members are row numbers; all occurrences of a repeat are among them. The
    rows must be sorted by `after`.
    """
    prefix = common(after[:-1], after[1:], np.minimum(right[:-1], right[1:]))
    by_left = np.lexsort(_words(before))
    place = np.empty(len(by_left), np.int64)
    place[by_left] = np.arange(len(by_left))
    # common left extensions of neighbours among all rows: those of any two are the least between them
    shared = common(before[by_left[:-1]], before[by_left[1:]], np.minimum(left[by_left[:-1]], left[by_left[1:]]))
    out = []
    for length, first, last in intervals(prefix):
        order = np.sort(place[first : last + 1])
        # the least extension between neighbours of the interval
        least = np.minimum.reduceat(shared[: order[-1]], order[:-1])
        if least.max() + length < LENGTH:
            continue
        for extension, a, b in intervals(least):
            if extension + length >= LENGTH:
                # left-extension diversity: beyond `extension` the members' left contexts differ
                out.append((extension, length, by_left[order[a : b + 1]]))
    return out


def _words(rows: np.ndarray) -> tuple:
    """Sort keys, the first bytes last, of a byte matrix in big-endian words."""
    n = rows.shape[1]
    return tuple(np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -n % 8)))).view(">u8").T[::-1])


SPAN_NAMES = ["doc_id", "place", "start", "end"]


def bucket_spans(batch: pa.RecordBatch):
    """Spans of all but the first occurrence of each maximal repeat in whole buckets."""
    key = np.asarray(batch.column("key"))
    ids, places, at, left, right = (np.asarray(batch.column(c)) for c in ("doc_id", "place", "at", "left", "right"))
    before, after = _matrix(batch, "before", LEFT), _matrix(batch, "after", RIGHT)
    order = np.lexsort((*_words(after), key))
    key, ids, places, at, left, right, before, after = (x[order] for x in (key, ids, places, at, left, right, before, after))
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((at, places, ids))] = np.arange(len(key))
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(heads, len(key)))
    gone, low, high = [], [], []
    # buckets of two: one interval
    i = heads[sizes == 2]
    if len(i):
        r = common(after[i], after[i + 1], np.minimum(right[i], right[i + 1]))
        n = common(before[i], before[i + 1], np.minimum(left[i], left[i + 1]))
        late = np.where(rank[i] > rank[i + 1], i, i + 1)[n + r >= LENGTH]
        gone.append(late)
        low.append(at[late] - n[n + r >= LENGTH])
        high.append(at[late] + r[n + r >= LENGTH])
    for a, n in zip(heads[sizes > 2], sizes[sizes > 2]):
        s = slice(a, a + n)
        best = np.full(n, -1)
        for extension, length, members in repeats(rank[s], left[s], right[s], before[s], after[s]):
            away = members[members != members[rank[s][members].argmin()]]
            away = away[best[away] < extension]  # inner intervals come first and reach further right
            best[away] = extension
            gone.append(a + away)
            low.append(at[a + away] - extension)
            high.append(at[a + away] + length)
    if gone:
        g = np.concatenate(gone)
        yield pa.RecordBatch.from_arrays([pa.array(ids[g]), pa.array(places[g]), pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=SPAN_NAMES)


def bucketed(batches, string_spans, bucket_results, rows: int = 20_000):
    """Rows sorted by (key, doc_id, place, at): results of hot grams' strings as they come, of other buckets as a whole, some at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = np.asarray(batch.column("left")) < 0
        if whole.any():
            own = batch.filter(pa.array(whole))
            key = np.asarray(own.column("key"))
            yield from string_spans(own, np.concatenate([[key[0] == last], key[1:] == key[:-1]]))
            last, batch = key[-1], batch.filter(pa.array(~whole))
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.asarray(table.column("key"))
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if cut:
            yield from bucket_results(table.slice(0, cut).combine_chunks().to_batches()[0])
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from bucket_results(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def again(batch: pa.RecordBatch, repeated: np.ndarray):
    """The spans of strings that have stood before."""
    ids, places, at = (np.asarray(batch.column(c))[repeated] for c in FIELDS[1:4])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, places, at, at + LENGTH)], names=SPAN_NAMES)


def removable(batches):
    """Spans of all but the first occurrence of each repeat."""
    return bucketed(batches, again, bucket_spans)


def bucket_groups(batch: pa.RecordBatch):
    """The maximal repeats of whole buckets, a row for each class that holds one (twice, where it has several occurrences)."""
    key = np.asarray(batch.column("key"))
    at, left, right, context, count = (np.asarray(batch.column(c)) for c in ("at", "left", "right", "context", "count"))
    before, after = _matrix(batch, "before", LEFT), _matrix(batch, "after", RIGHT)
    # a class of several occurrences repeats itself: it is there twice
    order = np.repeat(np.arange(len(key)), np.minimum(count, 2))
    order = order[np.lexsort((*_words(after[order]), key[order]))]
    key, at, left, right, context, before, after = (x[order] for x in (key, at, left, right, context, before, after))
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            s = slice(a, b)
            for extension, length, members in repeats(np.arange(b - a), left[s], right[s], before[s], after[s]):
                own = np.unique(context[s][members])
                text = before[a + members[0], :extension][::-1].tobytes() + after[a + members[0], :length].tobytes()
                name = int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True)
                rows += [(name, int(key[a]), int(c), int(extension), int(extension + length)) for c in own]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["repeat", "key", "context", "before", "length"])


def _matrix(batch: pa.RecordBatch, column: str, n: int) -> np.ndarray:
    return np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[2], np.uint8)[: batch.num_rows * n].reshape(batch.num_rows, n)


def kept(batches):
    """The digest of each text without its spans."""
    for batch in batches:
        data, bounds = K.utf8(batch.column("text"))
        spans = batch.column("spans")
        rows = []
        for i in range(batch.num_rows):
            text = data[bounds[i] : bounds[i + 1]]
            own = spans[i].as_py()
            gone, n = np.zeros(len(text) + 1, np.int32), 0
            if own:
                start, end = merged(np.array([x["start"] for x in own]), np.array([x["end"] for x in own]))
                n = len(start)
                gone[start] += 1
                gone[end] -= 1
            stay = text[np.cumsum(gone[:-1]) == 0]
            rows.append((len(text), len(text) - len(stay), n, hashlib.sha256(stay.tobytes()).hexdigest(), stay.tobytes()))
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


SPANS = "doc_id long, place long, start long, end long"


def spans(texts: DataFrame) -> DataFrame:
    """(doc_id, place, start, end): byte spans that repeat an earlier occurrence; they may overlap."""
    local = texts.mapInArrow(scanned("gone"), SPANS)
    rows = texts.mapInArrow(scanned("first"), "key long, context long, doc_id long, place long, at long, size long")
    rows = rows.repartition("key").sortWithinPartitions("key", "context", "doc_id", "place", "at")
    found = stored(rows.mapInArrow(classes, f"key long, {SPANS}"), "classes")
    later = found.filter("key is null").drop("key")
    around = surrounded(texts, found.filter("key is not null").select("key", "doc_id", "place", F.col("start").alias("at")))
    return local.unionByName(later).unionByName(around.mapInArrow(removable, SPANS))


def surrounded(texts: DataFrame, asked: DataFrame, hot: int = HOT) -> DataFrame:
    """The contexts of the asked anchors (key, doc_id, place, at), or their strings where a key has more than `hot`, dealt and sorted by key."""
    many = asked.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key", F.lit(True).alias("hot"))
    asked = asked.join(many, "key", "left").groupBy(F.col("doc_id").alias("d"), F.col("place").alias("p")).agg(F.collect_list(F.struct("key", "at", F.coalesce("hot", F.lit(False)).cast("int").alias("hot"))).alias("asked"))
    known = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(LAST))))
    known = known.join(asked, (known.doc_id == F.col("d")) & (known.place == F.col("p"))).select("doc_id", "place", "text", "asked")
    around = known.mapInArrow(contexts, CONTEXTS)
    return around.repartition("key").sortWithinPartitions("key", "doc_id", "place", "at")


def repeat_groups(df: DataFrame) -> DataFrame:
    """(repeat, length, doc_id, place, start) of every occurrence of every maximal repeat of LENGTH bytes or more.

    A repeat is known by a hash of its bytes. It is maximal within the context of an anchor (LEFT bytes before
    and RIGHT bytes after): longer ones have several rows, shifted along. Null texts count as empty, null
    doc_ids as the largest number. Texts are known by doc_id and place, a hash of the text; of equal rows one
    counts. All classes of a gram are held by one task here; the removal above needs no such bound.
    """
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.xxhash64(text_column()).alias("place")).dropDuplicates(["doc_id", "place"])
    every = stored(texts.mapInArrow(scanned("every"), "key long, context long, doc_id long, place long, at long, size long"), "anchors")
    classes_ = every.groupBy("key", "context").agg(F.min(F.struct("doc_id", "place", "at")).alias("first"), F.count("*").alias("count"))
    several = classes_.groupBy("key").agg(F.sum("count").alias("n")).filter("n > 1").select("key")
    classes_ = stored(classes_.join(several, "key").select("key", "context", "count", "first.*"), "repeated")
    around = surrounded(texts, classes_.select("key", "doc_id", "place", "at"), 1 << 62)
    around = around.join(classes_, ["key", "doc_id", "place", "at"]).repartition("key").sortWithinPartitions("key")
    groups = around.mapInArrow(lambda batches: bucketed(batches, again, bucket_groups), "repeat long, key long, context long, before long, length long")
    rows = groups.join(every, ["key", "context"])
    return rows.select("repeat", "length", "doc_id", "place", (F.col("at") - F.col("before")).alias("start")).distinct()


def deduplicated(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of df (doc_id long, text).

    The order of occurrences is by doc_id (null ids last), a hash of the text, and place. A null text counts as
    empty, and texts under LENGTH bytes lose nothing. Rows with one doc_id and one text count as one document
    and have one result. kept has the remaining bytes.
    """
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.xxhash64(text_column()).alias("place"))
    found = spans(texts).groupBy("doc_id", "place").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "d", "place": "p"})
    rows = texts.join(found, (F.coalesce("doc_id", F.lit(int(LAST))) == F.col("d")) & (F.col("place") == F.col("p")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier occurrences of its 100-byte strings."""
    return deduplicated(documents(spark, sf_dir)).drop("kept")
