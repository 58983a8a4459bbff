"""Near-duplicate passages by compact windows.

Items are five-word shingles. Under each of HASHES hash functions, every subsequence of SPAN items or more has
one smallest item; all subsequences that share it form one compact window (left, place, right), a node of the
Cartesian tree of the hashes, here cut to the REACH items that a passage of SPAN items around the place can
hold. A window stands in two buckets at most: that of its smallest item with the SIDE items before it, and that
with the SIDE items after it. Windows with equal items are one class, linked with its first. Where a bucket has
several classes, the intervals of their first windows are joined, aligned at the shared item, and their items
compared, each with each other. A bucket of more than TILE of them is dealt in tiles, each the windows of one block
or of two, so that a task holds 2 * TILE of a bucket at most. Windows that have a whole passage in common hold
copies of it, and as many links are made as join them; of windows that are near each other every pair is a link.
Intervals of two documents, from all functions, that overlap are one passage. Where classes of passages are asked
for, the same windows are compared, but a bucket gives one row for each window that any other one is near.

Exact passages of WORDS words always meet: their smallest item has SIDE equal items on one side at least. Near
ones meet under a function if their smallest item is common and has an unchanged side, so several functions are
used; the tests measure the recall against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import connected_components, dealt
from . import kernels as K
from .util import discarded, documents, pieces, stored, text_column, within

WIDTH, WORDS, HASHES = 5, 50, 3
SPAN = WORDS - WIDTH + 1
REACH, SIDE = SPAN - 1, 11
#: First windows of a bucket that a block holds.
TILE = 512
SEEDS = [K.U64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
#: Likeness: a Jaccard index of 4/5, i.e. of two stretches of n items GAIN * matched >= COST * n.
LIKE, GAIN, COST = 0.8, 9, 8
#: Items that one stretch may be shifted against the other, by words put in or left out.
DRIFT = 6
#: Unmatched items between intervals of one passage: two changed words, each in WIDTH shingles.
BREAK = 2 * WIDTH + 2


def items(column) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each text in order, and bounds."""
    data, bounds = K.utf8(column)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, bounds)
    return K.shingles(K.span_hashes(data, starts, ends), first, WIDTH)


def cartesian(values: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a minimum, how far it stays the smallest among the minima to its left and right."""
    left, right, stack = np.zeros(len(at), np.int64), np.full(len(at), n - 1), []
    own = values[at].tolist()
    for i, v in enumerate(own):
        while stack and own[stack[-1]] > v:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    return left, right


def stretches(values: np.ndarray):
    """A function low, high -> hashes of values[low:high]; equal items, equal hash."""
    n = len(values)
    total, inverse = np.zeros(n + 1, np.uint64), np.full(n + 1, K.INVERSE, np.uint64)
    np.cumsum(values * K.powers(n), out=total[1:])
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    return lambda low, high: K.mix((total[high] - total[low]) * inverse[low] + (high - low).astype(np.uint64) * K.MIX_2)


COLUMNS = ["key", "doc_id", "place", "at", "run", "ends", "same"]


def windows(batches):
    """The compact windows of at least SPAN items, a row for each of their buckets.

    key: the bucket, its last bits the function and the side. ends: 64 * items to the left + items to the right.
    run: where a text repeats itself, how much further the last of overlapping equal windows stands. Of
    overlapping windows of one text and bucket only the widest has a row.
    """
    for batch in pieces(batches):
        values, bounds = items(batch.column("text"))
        hashed, out = stretches(values), [[] for _ in range(6)]
        for j, seed in enumerate(SEEDS[:HASHES]):
            ranked = K.mix(values ^ seed)
            for i in np.flatnonzero(np.diff(bounds) >= SPAN):
                own = ranked[bounds[i] : bounds[i + 1]]
                at = K.sliding_minima(own, SPAN)
                left, right = cartesian(own, at, len(own))
                for c, x in zip(out, (np.full(len(at), i), np.full(len(at), j), own[at], at, np.minimum(at - left, REACH), np.minimum(right - at, REACH))):
                    c.append(x)
        if not out[0]:
            continue
        row, function, smallest, at, left, right = map(np.concatenate, out)
        here = at + bounds[row]
        whole = hashed(here - left, here + right + 1) + left.astype(np.uint64) * K.MIX_1
        signature = K.mix(smallest * K.BASE + function.astype(np.uint64))
        # overlapping equal windows of one text are one row
        order = np.lexsort((at, whole, signature, row))
        far = np.ones(len(order), bool)
        x, y = order[1:], order[:-1]
        far[1:] = (row[x] != row[y]) | (signature[x] != signature[y]) | (whole[x] != whole[y]) | (at[x] - at[y] > SPAN)
        head = order[far]
        run = at[order[np.append(np.flatnonzero(far)[1:] - 1, len(order) - 1)]] - at[head]
        row, function, signature, at, left, right, here, whole = (c[head] for c in (row, function, signature, at, left, right, here, whole))
        for side, has in ((0, left >= SIDE), (1, right >= SIDE)):
            p = np.flatnonzero(has)
            beside = hashed(here[p] - SIDE, here[p]) if side == 0 else hashed(here[p] + 1, here[p] + SIDE + 1)
            key = (K.mix(signature[p] ^ (beside * K.BASE + K.U64(side))) & ~K.U64(7)) | K.U64(side) | (function[p].astype(np.uint64) << K.U64(1))
            # windows of one text and bucket that overlap (it repeats itself within them) are one, the widest
            order = np.lexsort((at[p], key, row[p]))
            p, key = p[order], key[order]
            chain = np.cumsum(np.concatenate([[True], (row[p][1:] != row[p][:-1]) | (key[1:] != key[:-1]) | (at[p][1:] - at[p][:-1] > SPAN)]))[: len(p)]
            order = np.lexsort((at[p], -(left[p] + right[p] + run[p]), chain))
            order = order[np.concatenate([[True], chain[order][1:] != chain[order][:-1]])[: len(p)]]
            p, key = p[order], key[order]
            take = lambda c: batch.column(c).take(pa.array(row[p]))  # noqa: E731,B023
            narrow = [pa.array(x.astype(np.int32)) for x in (at[p], run[p], 64 * left[p] + right[p], (whole[p] >> K.U64(32)).astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), take("doc_id"), take("place"), *narrow], names=COLUMNS)


def classed(batches):
    """Over windows sorted by (key, same, doc_id, place, at): links of windows with the first of their class, and that
    first one (without a link, with its number in the bucket) where a bucket has several classes. One row of each kind is carried on."""
    last, waiting = None, None  # the class's first row; the bucket's first class until a second one comes
    numbered = (None, 0)  # the last bucket with several classes, and how many of them have been told
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in COLUMNS])
        key, same = rows[0], rows[6]
        other, fresh = np.ones(len(key), bool), np.ones(len(key), bool)
        other[1:] = key[1:] != key[:-1]
        fresh[1:] = other[1:] | (same[1:] != same[:-1])
        if last is not None:
            other[0] = key[0] != last[0]
            fresh[0] = other[0] or same[0] != last[6]
        joined = rows if last is None else np.concatenate([last[:, None], rows], axis=1)
        shift = joined.shape[1] - rows.shape[1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)) + shift, 0))
        first = joined[:, head]
        # exact links come from one function, and from the side before wherever there is one
        once = ((key >> 1) & 3 == 0) & ((key & 1 == 0) | (rows[5] >> 6 < SIDE))
        linked = once & ((rows[1] != first[1]) | (rows[2] != first[2]))
        begins = np.flatnonzero(fresh)
        several = ~other[begins]
        several[:-1] |= ~other[begins][1:]
        asks = rows[:, begins[several]]
        if len(begins):
            if waiting is not None and not other[begins[0]]:
                asks = np.concatenate([waiting[:, None], asks], axis=1)
            waiting = rows[:, begins[-1]] if other[begins[-1]] else None
            last = rows[:, begins[-1]]
        a, b = first[:, linked], rows[:, linked]
        n = asks.shape[1]
        begin = np.maximum.accumulate(np.where(np.diff(asks[0], prepend=asks[0, :1] + 1) != 0, np.arange(n), 0))
        number = np.arange(n) - begin
        if n:
            number[begin == 0] += numbered[1] if numbered[0] == asks[0, 0] else 0
            numbered = (asks[0, -1], int(number[-1]) + 1)
        none = np.arange(n + b.shape[1]) < n
        both = [np.concatenate([asks[i], b[i]]) for i in range(6)]
        of = [np.concatenate([np.zeros(n, np.int64), a[i]]) for i in (1, 2, 3, 4)]
        number = np.concatenate([number, np.zeros(b.shape[1], np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in both] + [pa.array(x, mask=none) for x in of] + [pa.array(number)], names=[*COLUMNS[:6], "a_id", "a_place", "a_at", "a_run", "number"])


def contexts(batches):
    """The items of the asked windows, 16 bits of each, in REACH places to both sides of the smallest one."""
    for batch in pieces(batches):
        values, bounds = items(batch.column("text"))
        lists = batch.column("asked")
        offsets, asked = np.asarray(lists.offsets), lists.flatten()
        key, at, run, ends, block = (np.asarray(asked.field(c)) for c in ("key", "at", "run", "ends", "block"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        padded = np.concatenate([np.zeros(REACH, np.uint16), values.astype(np.uint16), np.zeros(REACH, np.uint16)])
        for i in range(0, len(at), 1 << 13):
            p = slice(i, i + (1 << 13))
            around = padded[(bounds[:-1][row[p]] + at[p])[:, None] + np.arange(2 * REACH + 1)[None, :]]
            take = lambda c: np.asarray(batch.column(c))[row[p]]  # noqa: E731,B023
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * REACH + 2), len(around), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(take("doc_id")), pa.array(take("place")), pa.array(at[p]), pa.array(run[p]), pa.array(ends[p]), pa.array(block[p]), fixed], names=[*COLUMNS[:6], "block", "items"])


class Rows:
    """Windows with their items as arrays."""

    def __init__(self, key, doc, place, at, run, left, right, block, items):
        self.columns = (key, doc, place, at, run, left, right, block, items)
        self.key, self.doc, self.place, self.at, self.run, self.left, self.right, self.block, self.items = self.columns

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        key, doc, place, at, run, ends, block = (np.asarray(batch.column(c)).astype(np.int64) for c in (*COLUMNS[:6], "block"))
        data = batch.column("items").cast(pa.large_binary())
        offset = np.frombuffer(data.buffers()[1], np.int64)[data.offset]
        width = 2 * REACH + 1
        raw = np.frombuffer(data.buffers()[2], np.uint8)[offset : offset + 2 * width * len(data)].view(np.uint16).reshape(len(data), width)
        return Rows(key, doc, place, at, run, ends >> 6, ends & 63, block, raw)

    def __len__(self) -> int:
        return len(self.key)

    def take(self, i) -> Rows:
        return Rows(*(c[i] for c in self.columns))

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate(c) for c in zip(*(x.columns for x in parts))))


def alike(b: Rows, a: Rows) -> tuple[np.ndarray, np.ndarray, int]:
    """For pairs of windows row by row: which are like, (first and last item of b, of a, likeness in millionths) of these, and how many, the first ones, have a whole passage in common.

    Windows of one document are no pair. Equal items around the shared one that make a passage are one; where
    there are fewer, but enough in place or further on with a shift, the longest near stretch is looked for.
    """
    at = np.flatnonzero((b.doc != a.doc) | (b.place != a.place))
    left, right = np.minimum(b.left[at], a.left[at]), np.minimum(b.right[at], a.right[at])
    equal = b.items[at] == a.items[at]
    onward = np.minimum(_run(equal[:, REACH + 1 :]), right)
    back = np.minimum(_run(equal[:, :REACH][:, ::-1]), left)
    exact = back + onward + 1 >= SPAN
    place = np.arange(2 * REACH + 1) - REACH
    rest = np.flatnonzero(~exact)
    held = equal[rest] & (place >= -left[rest, None]) & (place <= right[rest, None])
    maybe = GAIN * held.sum(axis=1) >= COST * SPAN
    for way, run, reach in ((1, onward, right), (-1, back, left)):
        few = np.flatnonzero(~maybe)
        maybe[few] = _goes_on(b.items[at[rest[few]]], a.items[at[rest[few]]], run[rest[few]], reach[rest[few]], way)
    near, values = stretched(b.take(at[rest[maybe]]), a.take(at[rest[maybe]]))
    i, k = at[exact], at[rest[maybe]][near]
    whole = np.stack([b.at[i] - back[exact], b.at[i] + b.run[i] + onward[exact], a.at[i] - back[exact], a.at[i] + a.run[i] + onward[exact], np.full(len(i), 1_000_000)])
    return np.concatenate([i, k]), np.concatenate([whole, values], axis=1), len(i)


def _run(equal: np.ndarray) -> np.ndarray:
    """How many columns of each row are true from the first on."""
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))


def _goes_on(b: np.ndarray, a: np.ndarray, run: np.ndarray, reach: np.ndarray, way: int) -> np.ndarray:
    """Whether behind the first unequal items, as many as two changed words have, two items of b stand in a with one shift."""
    first = run + WIDTH + 2
    out = np.zeros(len(b), bool)
    i = np.flatnonzero(first + 2 + DRIFT <= REACH)
    i = i[first[i] + 2 <= reach[i]]
    for d in range(-DRIFT, DRIFT + 1):
        x, y = REACH + way * first[i], REACH + way * (first[i] + d)
        out[i] |= (b[i, x] == a[i, y]) & (b[i, x + 2 * way] == a[i, y + 2 * way])
    return out


def stretched(b: Rows, a: Rows) -> tuple[np.ndarray, np.ndarray]:
    """As alike, by near stretches: an item of b is matched if a has it at most DRIFT items off; the longest
    stretch around the shared item is taken that has SPAN items and an index of LIKE."""
    n, width = b.items.shape
    place = np.arange(width) - REACH
    inside = (place >= -b.left[:, None]) & (place <= b.right[:, None])
    there = (place >= -a.left[:, None]) & (place <= a.right[:, None])
    shift = np.full((n, width), 99, np.int8)
    for d in sorted(range(-DRIFT, DRIFT + 1), key=abs, reverse=True):
        low, high = max(0, -d), width - max(0, d)
        hit = (b.items[:, low:high] == a.items[:, low + d : high + d]) & there[:, low + d : high + d]
        np.copyto(shift[:, low:high], np.int8(d), where=hit)
    met = (shift != 99) & inside
    met[:, REACH], shift[:, REACH] = True, 0
    ok = np.flatnonzero(GAIN * met.sum(axis=1) >= COST * SPAN)
    if not len(ok):
        return ok, np.zeros((5, 0), np.int64)
    met, shift, inside = met[ok], shift[ok], inside[ok]
    gain = np.where(inside, np.where(met, GAIN - COST, -COST), -9999).astype(np.int32)
    none = np.zeros((len(ok), 1), np.int32)
    # stretches end at matched items
    sums_left = np.concatenate([none, np.where(met[:, :REACH][:, ::-1], np.cumsum(gain[:, :REACH][:, ::-1], axis=1), -9999)], axis=1)
    sums_right = np.concatenate([none, np.where(met[:, REACH + 1 :], np.cumsum(gain[:, REACH + 1 :], axis=1), -9999)], axis=1)
    # for each extent to the left, the furthest one to the right that the balance allows
    best, x, y = np.full(len(ok), -1), np.zeros(len(ok), np.int64), np.zeros(len(ok), np.int64)
    for k in range(REACH + 1):
        fine = sums_right + (sums_left[:, k] + (GAIN - COST))[:, None] >= 0
        far = REACH - fine[:, ::-1].argmax(axis=1)
        better = fine.any(axis=1) & (k + far > best)
        best, x, y = np.where(better, k + far, best), np.where(better, k, x), np.where(better, far, y)
    i = np.arange(len(ok))
    from_, to = -x + shift[i, REACH - x], y + shift[i, REACH + y]
    total = np.concatenate([none, np.cumsum(met, axis=1)], axis=1)
    both = np.minimum(total[i, REACH + y + 1] - total[i, REACH - x], to - from_ + 1)
    like = both / np.maximum((x + y + 1) + (to - from_ + 1) - both, 1)
    good = (x + y + 1 >= SPAN) & (like >= LIKE - 1e-9)
    ok, x, y, from_, to, like = ok[good], x[good], y[good], from_[good], to[good], like[good]
    return ok, np.stack([b.at[ok] - x, b.at[ok] + b.run[ok] + y, a.at[ok] + from_, a.at[ok] + a.run[ok] + to, np.round(like * 1e6).astype(np.int64)])


def joining(later: list[int], earlier: list[int]) -> list[int]:
    """Of links (later, earlier) in their order, those that join different groups."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (j, i) in enumerate(zip(later, earlier)):
        a, b = root(j), root(i)
        if a != b:
            parent[a] = b
            out.append(k)
    return out


def met(rows: Rows):
    """(later, earlier): all pairs of windows of one bucket or tile, some thousands at a time; in a tile of two blocks those of different ones."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(rows.key)) + 1, [len(rows)]])
    size = np.diff(bounds)
    end = np.repeat(bounds[1:], size)
    held, n, i = [], 0, np.arange(len(rows))
    for step in range(1, int(size.max(initial=1))):
        i = i[i + step < end[i]]
        pairs = i[(rows.block[i] == 0) | (rows.block[i] != rows.block[i + step])]
        held.append((pairs + step, pairs))
        n += len(pairs)
        if n >= 2048:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def linked(rows: Rows):
    """(b, a, values): the links within whole buckets or tiles, which are sorted by document."""
    copies = []
    for later, earlier in met(rows):
        for p in range(0, len(later), 2048):
            x, y = later[p : p + 2048], earlier[p : p + 2048]
            ok, values, exact = alike(rows.take(x), rows.take(y))
            copies.append((x[ok[:exact]], y[ok[:exact]], values[:, :exact]))
            near = ok[exact:]
            if len(near):
                yield rows.take(x[near]), rows.take(y[near]), values[:, exact:]
    if not copies:
        return
    later, earlier, found = (np.concatenate(c, axis=-1) for c in zip(*copies))
    order = np.lexsort((earlier, later))
    keep = order[joining(later[order].tolist(), earlier[order].tolist())]
    if len(keep):
        yield rows.take(later[keep]), rows.take(earlier[keep]), found[:, keep]


LINK = ["b_id", "b_place", "a_id", "a_place", "b_lo", "b_hi", "a_lo", "a_hi", "like"]


def compared(batches):
    """Over windows sorted by (key, doc_id, place, at): the links within each bucket or tile."""
    for rows in buckets(batches):
        for b, a, values in linked(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.doc, b.place, a.doc, a.place, *values)], names=LINK)


def buckets(batches):
    """Windows sorted by key as whole buckets or tiles; the last one's windows, 2 * TILE at most, are carried on."""
    held = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1 << 13):
            rows = Rows.of(batch.slice(start, 1 << 13))
            rows = rows if held is None else Rows.joined([held, rows])
            cuts = np.flatnonzero(np.diff(rows.key))
            cut = int(cuts[-1]) + 1 if len(cuts) else 0
            held = rows.take(slice(cut, None))
            if cut:
                yield rows.take(slice(0, cut))
    if held is not None:
        yield held


MEMBER = ["doc_id", "place", "lo", "hi", "like", "root_id", "root_place", "root_at"]


def grouped(batches):
    """Over windows as in compared: each window that has a link, with all items that its links hold, the least likeness and the first window of its group.

    Groups are what the links join, so a bucket or tile has no more rows than windows, however many links.
    """
    for rows in buckets(batches):
        n = len(rows)
        parent = np.arange(n)
        low, high, least = np.full(n, 1 << 40), np.full(n, -1), np.full(n, 1_000_000)
        for later, earlier in met(rows):
            for p in range(0, len(later), 2048):
                x, y = later[p : p + 2048], earlier[p : p + 2048]
                ok, values, _ = alike(rows.take(x), rows.take(y))
                x, y = x[ok], y[ok]
                for i, lo, hi in ((x, values[0], values[1]), (y, values[2], values[3])):
                    np.minimum.at(low, i, lo)
                    np.maximum.at(high, i, hi)
                    np.minimum.at(least, i, values[4])
                united(parent, x, y)
        i = np.flatnonzero(high >= 0)
        if len(i):
            columns = (rows.doc[i], rows.place[i], low[i], high[i], least[i], rows.doc[parent[i]], rows.place[parent[i]], rows.at[parent[i]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=MEMBER)


def united(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the groups of x[i] and y[i] in place; parent[i] is the first of i's group."""
    a, b = parent[x], parent[y]
    while len(apart := np.flatnonzero(a != b)):
        a, b = a[apart], b[apart]
        # the larger first one goes to the least one it meets
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        a, b = parent[a], parent[b]


FOUND = "doc_id long, other_id long, start_word long, end_word long, other_start long, other_end long, similarity double"


def passages(batches):
    """Over links sorted by both documents: overlapping intervals of about one shift are one passage."""
    held: list[np.ndarray] = []

    def merged():
        rows = np.concatenate(held, axis=1)
        pair = np.concatenate([[0], np.cumsum((np.diff(rows[:4], axis=1) != 0).any(axis=0))])
        shift = rows[6] - rows[4]
        order = np.lexsort((shift, pair))
        rows, pair, shift = rows[:, order], pair[order], shift[order]
        line = np.concatenate([[0], np.cumsum((np.diff(pair) != 0) | (np.diff(shift) > BREAK))])
        order = np.lexsort((rows[4], line))
        rows, line = rows[:, order], line[order]
        apart = int(rows[5].max()) + BREAK + 2
        low, high = rows[4] + line * apart, np.maximum.accumulate(rows[5] + line * apart)
        head = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (low[1:] > high[:-1] + BREAK)]))
        top, least = lambda x: np.maximum.reduceat(x, head), lambda x: np.minimum.reduceat(x, head)
        columns = [rows[0][head], rows[2][head], least(rows[4]), top(rows[5]) + WIDTH, least(rows[6]), top(rows[7]) + WIDTH]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(least(rows[8]) / 1e6)], names=[x.split()[0] for x in FOUND.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in LINK])
        cut = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut or (held and (held[-1][:4, -1] != rows[:4, 0]).any()):
            held.append(rows[:, :cut])
            yield merged()
            held = []
        held.append(rows[:, cut:])
    if held:
        yield merged()


def classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, place, text), and of their windows the links within classes and the first ones of classes that share a bucket."""
    texts = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc_id"), text_column().alias("text"), F.xxhash64(text_column()).alias("place"))
    rows = texts.mapInArrow(windows, "key long, doc_id long, place long, at int, run int, ends int, same int")
    rows = rows.repartition("key").sortWithinPartitions("key", "same", "doc_id", "place", "at")
    return texts, stored(rows.mapInArrow(classed, "key long, doc_id long, place long, at long, run long, ends long, a_id long, a_place long, a_at long, a_run long, number long"), "classes")


def around(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The first windows of the classes that share a bucket, with their items, sorted by bucket or tile."""
    large = stored(found.filter(f"a_id IS NULL AND number >= {TILE}").groupBy("key").agg(F.max(F.expr(f"number div {TILE}")).alias("last")), "large")
    # a window of a large bucket goes to the tiles of its block with itself (block 0) and with each other one (1 or 2)
    tile = lambda own, other: F.struct(F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("key"), F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("block"))
    tiles = F.when(F.col("last").isNull(), F.array(F.struct("key", F.lit(0).alias("block")))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda k: tile(F.expr(f"number div {TILE}"), k)))
    asked = found.filter("a_id IS NULL").join(large, "key", "left").select("doc_id", "place", "at", "run", "ends", F.explode(tiles).alias("t"))
    asked = asked.groupBy(F.col("doc_id").alias("d"), F.col("place").alias("p")).agg(F.collect_list(F.struct("t.key", "at", "run", "ends", "t.block")).alias("asked"))
    known = texts.join(asked, (texts.doc_id == F.col("d")) & (texts.place == F.col("p"))).select("doc_id", "place", "text", "asked")
    rows = known.mapInArrow(contexts, "key long, doc_id long, place long, at long, run long, ends long, block int, items binary")
    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "place", "at")


def near_passages(df: DataFrame) -> DataFrame:
    """Passages of WORDS words or more that a document has in common with an earlier one, in words (end excluded).

    Rows: doc_id, other_id (the smaller id), start_word, end_word, other_start, other_end, similarity (the least
    Jaccard index of the shingles in a stretch of it). A passage that stands in many documents is a class: each
    of its documents is linked with a representative of it, not with all others, and all representatives that are
    near each other are linked as well. Every place has a row of its own, but for repeats that overlap, which
    are one place. A null text counts as empty; texts under WORDS words have none; null ids count as -1. Rows
    of one doc_id and one text are one document. Other columns are left aside.
    """
    texts, found = classes(df)
    left, right = F.floor(F.col("ends") / 64), F.col("ends") % 64
    exact = found.filter("a_id IS NOT NULL").select(F.col("doc_id").alias("b_id"), F.col("place").alias("b_place"), "a_id", "a_place", (F.col("at") - left).alias("b_lo"), (F.col("at") + F.col("run") + right).alias("b_hi"), (F.col("a_at") - left).alias("a_lo"), (F.col("a_at") + F.col("a_run") + right).alias("a_hi"), F.lit(1_000_000).cast("long").alias("like"))
    near = around(texts, found).mapInArrow(compared, ", ".join(f"{c} long" for c in LINK))
    links = exact.unionByName(near).repartition("b_id", "b_place", "a_id", "a_place").sortWithinPartitions("b_id", "b_place", "a_id", "a_place")
    return links.mapInArrow(passages, FOUND)


@within("passages")
def passage_classes(df: DataFrame) -> DataFrame:
    """Passages that a document has in common with another one or is near to, each with the class of passages that links join.

    Rows: doc_id, start_word, end_word (excluded), similarity (the least Jaccard index of a stretch of it), class_id.
    The links are those of near_passages, every two representatives compared, but none is a row. Places of one
    document that overlap are one passage. Rows grow with the windows of the texts, not with pairs.
    """
    texts, found = classes(df)
    left, right = F.floor(F.col("ends") / 64), F.col("ends") % 64
    exact = found.filter("a_id IS NOT NULL")
    root = [F.col(c).alias(m) for c, m in zip(("a_id", "a_place", "a_at"), MEMBER[5:])]
    side = lambda doc, place, at, run: exact.select(F.col(doc).alias("doc_id"), F.col(place).alias("place"), (F.col(at) - left).alias("lo"), (F.col(at) + F.col(run) + right).alias("hi"), F.lit(1_000_000).cast("long").alias("like"), *root)
    near = around(texts, found).mapInArrow(grouped, ", ".join(f"{c} long" for c in MEMBER))
    rows = side("doc_id", "place", "at", "run").unionByName(side("a_id", "a_place", "a_at", "a_run").distinct()).unionByName(near)
    order = Window.partitionBy("doc_id", "place").orderBy("lo")
    past = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("head", F.when(F.coalesce(F.col("lo") > past + BREAK, F.lit(True)), F.col("lo")))
    rows = rows.withColumn("start", F.max("head").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    members = stored(rows.select("doc_id", "start", "hi", "like", F.xxhash64("doc_id", "place", "start").alias("node"), F.xxhash64(*MEMBER[5:]).alias("root")), "members")
    discarded(found)
    # passages with one root are one class
    roots = members.select("node", "root").distinct()
    edges = roots.join(roots.groupBy("root").agg(F.min("node").alias("dst")), "root").select(F.col("node").alias("src"), "dst").distinct()
    spans = members.groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start_word"), (F.max("hi") + WIDTH).alias("end_word"), (F.min("like") / 1e6).alias("similarity"))
    return spans.join(dealt(connected_components(edges)), "node").select("doc_id", "start_word", "end_word", "similarity", F.col("component").alias("class_id"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages among all documents, and their classes."""
    return passage_classes(documents(spark, sf_dir))
