"""Every operator against plain Python loops (or its DuckDB SQL) on small tables."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.llm import fingerprint, license_scan, line_rules, mixing, near_dedup, oracles, packing, pseudonyms, sharding, substring_dedup, util
from strandloom.llm.license_texts import MIT

SCHEMA = "doc_id long, text string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def fresh(r, n):
    return [f"w{r.getrandbits(40):x}" for _ in range(n)]


def replaced(r, words, k):
    out = list(words)
    for i in r.sample(range(len(out)), k):
        out[i] = f"c{r.getrandbits(40):x}"
    return out


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, repeated passages and lines, odd white space, no words, nulls, one very long text."""
    r = random.Random(11)
    base, line = fresh(r, 120), "Read our  TERMS before use of this page"
    texts = [" ".join(base), " ".join(base), " ".join(replaced(r, base, 1)), " ".join(replaced(r, base, 3)), " ".join(replaced(r, base, 9))]
    texts += [" ".join(fresh(r, 30) + base[20:90] + fresh(r, 30)) for _ in range(6)]
    texts += [" ".join(fresh(r, 40)) + "\n" + (line if i % 2 else line.lower()) + f"\n{i} & # end" for i in range(16)]
    texts += [None, "", " \n\t ", "one", "two words", "Ünïcödé Ωmega ÀB c \U0001f600 " * 6, ("again and again the same " * 40).strip(), " ".join(fresh(r, 9)) + "\n\n" + line]
    texts += [" ".join(r.choice(base) for _ in range(12_000))]
    source = lambda i, t: "a" if "terms before" in (t or "").lower() else "abc"[i % 3] if i % 11 else None
    return [(i * 3 + 1, t, source(i, t), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shingle_sets(rows, width=5):
    out = {}
    for doc_id, text, *_ in rows:
        words = re.findall(SPACE.encode(), (text or "").encode().lower())
        out[doc_id] = {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()
    return out


def sql(rows, text):
    documents = pd.DataFrame([x[:3] for x in rows], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("given", documents)
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM given")
    return con.execute(text)


def same(frame, rows, text):
    found = sql(rows, text)
    names = sorted(x[0] for x in found.description)
    order = [[x[0] for x in found.description].index(n) for n in names]
    want = sorted(tuple(r[i] for i in order) for r in found.fetchall())
    assert sorted(frame.columns) == names and sorted(map(tuple, frame.select(names).collect())) == want


def test_line_rules_sql(docs, rows):
    out = line_rules.judged(docs, carry=["doc_id"])
    same(out, rows, oracles.LINE_RULES)
    assert out.filter("n_removed_words > 0").count() >= 16


def test_boilerplate_limits(spark):
    """A line in 30 of 400 documents of a host is under the share; it goes by the number alone where that is the limit."""
    r = random.Random(2)
    rows = [(i, " ".join(fresh(r, 20)) + ("\nthe same line everywhere" if i < 30 else ""), "h", 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert line_rules.boilerplate(df).count() == 0
    assert [x.n_docs for x in line_rules.boilerplate(df, many=25).collect()] == [30]


def test_near_dedup_sql(docs, rows):
    same(near_dedup.components(docs).select("doc_id", "n_shingles", "component_id", "kept"), rows, oracles.NEAR_DEDUP)


def linked(rows, percent):
    sets, parent = shingle_sets(rows), {}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i in sorted(sets):
        for j, n in collections.Counter(j for s in sets[i] for j in inverted[s]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            inverted[s].append(i)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_clouds(spark, monkeypatch, percent):
    """Hot lists: versions of one text about the threshold, a common template, with lists and tiles made small."""
    monkeypatch.setattr(near_dedup, "SHORT", 3)
    monkeypatch.setattr(near_dedup, "TILE", 8)
    r = random.Random(percent)
    base, template = fresh(r, 200), fresh(r, 150)
    texts = [replaced(r, base, r.choice([1, 2, 3, 4])) for _ in range(70)]
    texts += [template + fresh(r, r.choice([12, 20, 60])) for _ in range(40)]
    near = template + fresh(r, 70)
    texts += [near[:-k] + fresh(r, k) for k in range(1, 7)]
    # pairs at the threshold itself: 17 of 20 shingles in common, and one fewer
    for n in (17, 16):
        common = fresh(r, n + 4)
        texts += [common + fresh(r, 3), common] if n == 17 else [common + fresh(r, 4), common]
    rows = [(i, " ".join(x), "s", 0) for i, x in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in near_dedup.components(spark.createDataFrame(rows, SCHEMA), percent).collect()}
    assert got == linked(rows, percent)


def test_substrings_sql(docs, rows):
    same(substring_dedup.deduplicated(docs).drop("kept"), rows, oracles.SUBSTRINGS)


def test_hot_grams_and_groups(spark, monkeypatch, rows):
    """With every gram taken for hot the rows are the same, and repeat groups hold all places of every repeated string."""
    rows = rows[:-1]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(x) for x in substring_dedup.deduplicated(df).drop("kept").collect()}
    monkeypatch.setattr(substring_dedup.surrounded, "__defaults__", (1,))
    assert {tuple(x) for x in substring_dedup.deduplicated(df).drop("kept").collect()} == want
    data = {i: (t or "").encode() for i, t, *_ in rows}
    places, groups = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in data.items():
        for k in range(len(t) - 99):
            places[t[k : k + 100]].add((i, k))
    for x in substring_dedup.repeat_groups(df).collect():
        groups[x.repeat, x.length].add((x.doc_id, x.start))
    whole = set()
    for (_, length), at in groups.items():
        assert len({data[i][s : s + length] for i, s in at}) == 1 and len(at) > 1
        i, s = next(iter(at))
        for k in range(length - 99):
            string = data[i][s + k : s + k + 100]
            if {(j, t + k) for j, t in at} == places[string]:
                whole.add(string)
    assert whole == {s for s, at in places.items() if len(at) > 1} and whole


def test_fingerprints(spark, docs, rows):
    """Sketches by plain loops over Spark's hash of each shingle; likeness, containment and merging from these."""
    words = {i: re.findall(SPACE, (t or "").lower()) for i, t, *_ in rows}
    order = sorted(words, reverse=True)
    texts = {i: t or "" for i, t, *_ in rows}
    edited = {}
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % len(order)]]
        half = len(texts[i]) // 2
        edited[i] = texts[i][: len(texts[i]) - half] + after[:half]

    def parts(text):
        w = re.findall(SPACE, text.lower())
        return [w[i : i + 5] for i in range(len(w) - 4)] if len(w) > 4 else [[" ".join(w)]] if w else []

    need = {tuple(p) for t in [*texts.values(), *edited.values()] for p in parts(t)}
    frame = spark.createDataFrame([(list(p),) for p in need], "p array<string>")
    hashed = frame.select("p", F.when(F.size("p") == 5, F.xxhash64(*[F.col("p")[k] for k in range(5)])).otherwise(F.xxhash64(F.col("p")[0])).bitwiseAND(F.lit((1 << 40) - 1)).alias("h"))
    known = {tuple(x.p): x.h for x in hashed.collect()}

    def sketch(text):
        every = {known[tuple(p)] for p in parts(text)}
        low = {h for h in every if h < (1 << 40) // fingerprint.SCALE}
        return low or ({min(every)} if every else set())

    def jaccard(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    def within(a, b):
        return len(a & b) / len(a) if a else 1.0

    df = docs.select("doc_id", util.text_column().alias("text"))
    df = fingerprint.with_next(df, derived={"sketch": fingerprint.sketch(F.col("text"))}, buckets=5)
    got = {x.doc_id: x for x in df.collect()}
    assert len(got) == len(rows)
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        assert set(got[i].sketch) == sketch(texts[i]) and got[i].next_text == texts[after] and set(got[i].next_sketch) == sketch(texts[after])
    rows_ = [(sorted(sketch(texts[a])), sorted(sketch(edited[b]))) for a, b in zip(order, order[::-1])]
    pairs = spark.createDataFrame(rows_, "a array<long>, b array<long>")
    for x in pairs.withColumns({"j": fingerprint.resemblance(F.col("a"), F.col("b")), "c": fingerprint.containment(F.col("a"), F.col("b")), "m": fingerprint.merged(F.col("a"), F.col("b"))}).collect():
        a, b = set(x.a), set(x.b)
        low = {h for h in a | b if h < (1 << 40) // fingerprint.SCALE}
        assert (x.j, x.c, set(x.m)) == (jaccard(a, b), within(a, b), low or ({min(a | b)} if a | b else set()))


def test_fingerprint_query(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: t or "" for i, t, *_ in rows}
    order = sorted(texts, reverse=True)
    got = {x.doc_id: x for x in fingerprint.op1_fingerprint(spark, str(tmp_path)).collect()}
    for k, i in enumerate(order):
        after, half = texts[order[(k + 1) % len(order)]], len(texts[i]) // 2
        want = texts[i][: len(texts[i]) - half] + after[:half]
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[i].near_next == 1 or texts[i] != after


@functools.cache
def tokenizer():
    return packing.Units(packing.tokenizer_path()).tokenizer


def tokens(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, rows):
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) hold every id of every row once, without a gap."""
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        want[doc_id] += 1
    ids = {}
    for doc_id, text, *_ in rows:
        ids.setdefault(doc_id, tokens(text))
    cover = collections.Counter()
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        cover.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
    assert all(cover[i, k] == n for i, n in want.items() for k in range(len(ids[i]))) and sum(cover.values()) == sum(n * len(ids[i]) for i, n in want.items())
    at = sorted((p.sequence_id * 2048 + p.offset, p.length) for p in pieces)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and all(a % 2048 + n <= 2048 for a, n in at)


@pytest.mark.parametrize("block_tokens", [1 << 20, 5000])
def test_packing(docs, rows, block_tokens):
    check_pieces(packing.packed(docs, packing.tokenizer_path(), block_tokens=block_tokens).collect(), rows)


def test_packing_mixes_and_keeps_copies_apart(spark):
    """Windows hold the sources' shares; two copies of a document never share a window."""
    r = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(60)), "ab"[i % 4 == 0], 0) for i in range(600)]
    twice = rows + rows[:300]
    pieces = packing.packed(spark.createDataFrame(twice, SCHEMA), packing.tokenizer_path()).collect()
    check_pieces(pieces, twice)
    starts = collections.Counter((p.doc_id, p.sequence_id) for p in pieces if p.start == 0)
    assert max(starts.values()) == 1
    by, share = collections.Counter(), collections.Counter()
    for p in pieces:
        share[p.source] += p.length
        by[p.sequence_id, p.source] += p.length
    total = sum(share.values())
    full = max(p.sequence_id for p in pieces)
    # a window is off by a chunk at most, and what it owes is made good: so are all windows up to any one together
    owed = np.array([by[k, "b"] - 2048 * share["b"] / total for k in range(full - 3)])
    assert np.abs(owed).max() <= packing.CHUNK + 1 and np.abs(np.cumsum(owed)).max() <= 2 * packing.CHUNK


@pytest.mark.parametrize("kind", ["packing", "sharding"])
def test_same_rows_whatever_the_partitions(spark, docs, kind):
    run = {"packing": lambda df: packing.packed(df, packing.tokenizer_path(), block_tokens=3000), "sharding": lambda df: sharding.shard(df, 7, ["doc_id"])}[kind]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(repr, run(docs.repartition(int(n))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_matrix():
    """Exact sums for 10**11 rows, and the hypergeometric law for few."""
    blocks, shards = np.full(512, 10**11 // 512), np.full(40, 10**11 // 512 * 512 // 40)
    shards[: blocks.sum() - shards.sum()] += 1
    found = sharding.communication_matrix(blocks, shards, 5)
    assert (found.sum(axis=1) == blocks).all() and (found.sum(axis=0) == shards).all() and found.min() > 0
    seen = collections.Counter(int(sharding.communication_matrix(np.array([3, 4]), np.array([3, 4]), i)[0, 0]) for i in range(6000))
    for k, p in enumerate((4, 18, 12, 1)):  # of 35
        assert abs(seen[k] / 6000 - p / 35) < 0.03


def test_licenses(spark, docs, rows):
    """Base places by a plain search; a whole license with changed words is found, half of one isn't."""
    r = random.Random(1)
    words = MIT.split()
    changed = list(words)
    for i in range(10, len(changed), 17):
        changed[i] = "other"
    extra = [(900, " ".join(fresh(r, 20) + changed + fresh(r, 20)), "s", 0), (901, " ".join(words[: len(words) // 3]), "s", 0), (902, "The MIT license and the Apache-License, mit\nLICENSE; CC BY 4.0", "s", 0)]
    df = spark.createDataFrame([*rows, *extra], SCHEMA)
    measures, spans = license_scan.scanned(df)
    got = {x.doc_id: x for x in measures.collect()}
    for doc_id, text, *_ in [*rows, *extra]:
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.encode().split()]
        x = got[doc_id]
        assert (x.n_words, x.n_base, set(x.found)) == (len(own), len(places), {p[1] for p in places})
        assert (x.first_word, x.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    found = {(x.doc_id, x.label): x for x in spans.collect()}
    assert found[900, "mit-notice"].first <= 20 + 10 and found[900, "mit-notice"].coverage > 0.9 and (901, "mit-notice") not in found


def test_pseudonym_permutations(spark):
    """Dates, addresses and numbers are permuted within their format; equal values stay linked, different ones apart."""
    days = [str(np.datetime64("1999-12-20") + i) for i in range(800)]
    ips = [f"10.{i % 7}.{i % 251}.{i % 256}" for i in range(500)]

    def luhn(digits):
        every = [int(c) for c in digits][::-1]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(every)) % 10

    cards = [c for n in range(5000) if luhn(c := f"41111111{n:08d}") == 0][:300]
    mails = [f"User{i}@mail{i % 9}.example.com" for i in range(300)]
    values = days + ips + cards + mails
    df = spark.createDataFrame([(i, f"see {v} now", "s") for i, v in enumerate(values)] + [(10_000, f"{days[3]} and {days[3]}; USER7@MAIL7.EXAMPLE.COM user7@mail7.example.com", "s"), (10_001, None, "s")], "doc_id long, text string, source string")
    got = {x.doc_id: x for x in pseudonyms.pseudonymised(df, key="k").collect()}
    new = [got[i].text[4:-4] for i in range(len(values))]
    assert len(set(new)) == len(set(values)) and sum(a == b for a, b in zip(values, new)) <= 3
    for old, x in zip(values, new):
        assert len(x) == len(old) or "." in old
        if old in days:
            np.datetime64(x)
        elif old in cards:
            assert luhn(x) == 0 and x.isdigit()
        elif "@" in old:
            assert re.fullmatch(r"[A-Za-z0-9]+@[a-z0-9]+\.[a-z]{7}\.[a-z]{3}", x)
        else:
            assert all(0 <= int(p) < 256 for p in x.split("."))
    first, second = got[10_000].text.split(";")[0].split(" and ")
    upper, lower = got[10_000].text.split("; ")[1].split()
    assert first == second == new[3] and upper.lower() == lower == got[len(days) + len(ips) + len(cards) + 7].text[4:-4].lower()
    assert got[10_001].text is None and got[10_001].n_replaced == 0
    other = {x.doc_id: x.text for x in pseudonyms.pseudonymised(df, key="another").collect()}
    assert sum(other[i] != got[i].text for i in range(len(values))) > 0.99 * len(values)


def test_pseudonym_key(spark):
    spark.conf.set(pseudonyms.SETTING, "own key")
    try:
        assert pseudonyms.key_of(spark) == "own key"
    finally:
        spark.conf.unset(pseudonyms.SETTING)


def test_mixing(spark):
    """The exponent against a fine search, and sources' shares, budgets and passes of what is realised."""
    r = random.Random(3)
    sizes = {"a": 4000, "b": 900, "c": 300}
    rows = [(i, " ".join(["x"] * r.randrange(5, 40)), s, 0) for i, s in enumerate(itertools.chain(*[[s] * n for s, n in sizes.items()]))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(df, mixing.word_count(), blocks=16).withColumn("n", mixing.word_count()).collect()
    own = collections.Counter()
    for _, text, s, _ in rows:
        own[s] += len(text.split())
    shares = np.array([own[s] for s in "abc"]) / sum(own.values())
    fits = [a for a in np.linspace(0, 1, 20001) if mixing.entropy(mixing.weights(shares, a)) >= mixing.ENTROPY]
    plain = max(max(fits), min(a for a in np.linspace(0, 1, 20001) if mixing.repeats(shares, a) <= mixing.MAX_REPEATS + 1e-6))
    assert abs(mixing.exponent(shares) - plain) < 1e-3
    w = mixing.weights(shares, mixing.exponent(shares))
    read = collections.Counter()
    copies = collections.Counter()
    for x in got:
        read[x.source] += x.n
        copies[x.doc_id] += 1
    total = sum(read.values())
    assert all(abs(read[s] / total - p) < 0.005 for s, p in zip("abc", w)) and len(copies) == len(rows)
    assert max(copies.values()) == 2 and all(x["pass"] in (0, 1) for x in got) and len({(x.doc_id, x["pass"]) for x in got}) == len(got)
    ranked = sorted(got, key=lambda x: x.mix_rank)
    half = collections.Counter()
    for x in ranked[: len(ranked) // 2]:
        half[x.source] += x.n
    assert all(abs(half[s] / sum(half.values()) - p) < 0.05 for s, p in zip("abc", w))


def test_pipeline(spark, rows, tmp_path):
    """Each stage on what the one before kept, by plain loops; then all of run()."""
    import corpus_pipeline

    r = random.Random(12)
    more = [(1000 + i, " ".join(fresh(r, 40)) + f" call 555-123-{1000 + i} or a{i}@example.com", "abc"[i % 3], 0) for i in range(60)]
    own = [(i, t, s, len(t or "")) for i, t, s, _ in rows[:-1] + more]
    docs = spark.createDataFrame(own, SCHEMA)
    stage = dict(corpus_pipeline.STAGES)
    judged = stage["quality rules"](spark, docs, "").collect()
    kept = {x[0] for x in sql(own, f"SELECT doc_id FROM ({oracles.LINE_RULES}) WHERE kept").fetchall()}
    assert {x.doc_id for x in judged} == kept
    left = [tuple(x) for x in judged]
    single = stage["near duplicates"](spark, spark.createDataFrame(left, SCHEMA), "").collect()
    group = linked(left, 80)
    assert {x.doc_id for x in single} == {i for i, g in group.items() if i == g}
    hidden = stage["pseudonyms"](spark, spark.createDataFrame([tuple(x) for x in single], SCHEMA), "").collect()
    for x in hidden:
        if x.doc_id >= 1000:
            assert f"555-123-{x.doc_id}" not in x.text and f"a{x.doc_id - 1000}@example.com" not in x.text
        elif "@" not in (x.text or ""):
            assert (x.doc_id, x.text) in {(y.doc_id, y.text) for y in single}
    mixed = stage["mixing"](spark, spark.createDataFrame([tuple(x) for x in hidden], SCHEMA), "").collect()
    times = collections.Counter(x.doc_id for x in mixed)
    assert set(times) == {x.doc_id for x in hidden} and max(times.values()) <= 2 and {tuple(x) for x in mixed} == {tuple(x) for x in hidden}
    check_pieces(stage["packing"](spark, spark.createDataFrame([tuple(x) for x in mixed], SCHEMA), "").collect(), [tuple(x) for x in mixed])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), [tuple(x) for x in mixed])
