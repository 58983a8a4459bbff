"""Alignments against a plain table of scores for each pair, and spectra of k-mers against loops."""

import math
import random

import numpy as np
import pytest

from strandloom.operators import alignment as A
from strandloom.operators import kmers

TURN = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x.translate(TURN)[::-1]


def plain(a, b):
    """Score by score: (score, length, first and last places, identities, mismatches, gaps)."""
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    way = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            options = [(0, 0), (score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -4), 1), (score[i - 1][j] - 5, 2), (score[i][j - 1] - 5, 3)]
            top = max(x for x, _ in options)
            score[i][j], way[i][j] = next(o for o in options if o[0] == top)
            if top > best[0]:
                best = (top, i, j)
    top, i, j = best
    stop, size, same, wrong, gaps, last = (i, j), 0, 0, 0, 0, 1
    while way[i][j]:
        first, step = (i, j), way[i][j]
        size += 1
        if step == 1:
            same, wrong = same + (a[i - 1] == b[j - 1]), wrong + (a[i - 1] != b[j - 1])
        else:
            gaps += step != last
        i, j, last = i - (step != 3), j - (step != 2), step
    return top, size, first, stop, same, wrong, gaps


@pytest.fixture(scope="module")
def words():
    r = random.Random(6)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    base = letters(260)
    out = [base[:120], base[60:190], rc(base[100:230]), letters(90), base[20:70] + "ACG" + base[70:140], base[150:200] + base[206:260], letters(20) + base[30:80] + letters(20), rc(base[10:60] + base[62:110])]
    for k in (2, 5):
        x = list(base[40:150])
        for i in r.sample(range(len(x)), k):
            x[i] = r.choice("ACGT")
        out.append("".join(x))
    return [*out, "ACGT", ""]


def test_alignments(spark, words):
    df = spark.createDataFrame(list(enumerate(words)), "id long, seq string")
    got = {(r.qseqid, r.sseqid): r for r in A.aligned(df, df, band=24).collect()}
    seeds = lambda x: {x[i : i + 16] for i in range(0, len(x) - 15, 4)}
    every = lambda x: {x[i : i + 16] for i in range(len(x) - 15)}
    turned = 0
    for q, x in enumerate(words):
        for s, y in enumerate(words):
            ways = [w for w in (0, 1) if q != s and seeds(rc(x) if w else x) & every(y)]
            assert bool(ways) == ((q, s) in got)
            if len(ways) == 1:
                w, r = ways[0], got[q, s]
                top, size, first, stop, same, wrong, gaps = plain(rc(x) if w else x, y)
                assert (r.length, r.nident, r.mismatch, r.gapopen) == (size, same, wrong, gaps)
                assert r.bitscore == round((1.28 * top / 2 - math.log(0.46)) / math.log(2), 1)
                place = (first[0], stop[0], first[1], stop[1]) if not w else (len(x) - stop[0] + 1, len(x) - first[0] + 1, stop[1], first[1])
                assert (r.qstart, r.qend, r.sstart, r.send) == place
                assert r.qcovs == r.qcovhsp == int(100 * (r.qend - r.qstart + 1) / len(x) + 0.5) and (r.qlen, r.slen) == (len(x), len(y))
                turned += w
    assert turned > 4 and any(r.gapopen for r in got.values())
    assert A.aligned(df.limit(0), df).count() == 0


def test_slices_of_pairs(monkeypatch, words):
    pairs = [(x, y) for x in words[:6] for y in words[:6]]
    grid = lambda rows: np.array([list(x.encode().ljust(max(map(len, rows)), b"\0")) for x in rows], np.uint8)
    size = lambda rows: np.array([len(x) for x in rows])
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    whole = A.extended(grid(a), size(a), grid(b), size(b), np.zeros(len(pairs), np.int64), 16)
    one = [A.extended(grid([x]), size([x]), grid([y]), size([y]), np.zeros(1, np.int64), 16)[0] for x, y in pairs]
    assert whole == one


def test_spectrum(spark):
    r = random.Random(1)
    rows = ["".join(r.choice("ACGTN" if i % 3 == 0 else "ACGT") for _ in range(r.randrange(0, 60))) for i in range(700)] + [None, "", "ACGTACG", "ACGTACGT"]
    want = {}
    for x in rows:
        own = [x[i : i + 4] for i in range(0, len(x) - 3, 3) if "N" not in x[i : i + 4]] if x else []
        for k in own:
            want.setdefault(k, [0, 0])[0] += 1
        for k in set(own):
            want[k][1] += 1
    got = {x.kmer: [x.n, x.n_docs] for x in kmers.spectrum(spark.createDataFrame([(x,) for x in rows], "seq string"), 4, 3).collect()}
    assert got == want
