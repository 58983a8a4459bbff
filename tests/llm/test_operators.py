"""Small cases of every operator: nulls, empty and repeated texts, empty tables."""

import hashlib

import pytest

from strandloom.llm import compact_windows, fingerprint, license_scan, line_rules, mixing, near_dedup, packing, pseudonyms, sharding, substring_dedup

WORDS = " ".join(f"word{i}" for i in range(80))
ROWS = [
    (0, WORDS + ".", "a", 1),
    (1, WORDS + ".", "a", 1),
    (2, WORDS.replace("word3 ", "other "), "b", 1),
    (3, None, None, None),
    (4, "", "b", 0),
    (5, "mail me@example.com or 4111111111111111 under the MIT License, released under the MIT license", "b", 0),
    (6, " ".join(f"own{i}" for i in range(300)), None, 0),
]
SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_dedup(docs, empty):
    got = {r.doc_id: r for r in near_dedup.components(docs).collect()}
    assert got[1].component_id == 0 and not got[1].kept and got[2].component_id == 0
    assert got[3].n_shingles == 0 and got[3].kept and got[4].kept
    assert near_dedup.components(empty).count() == 0


def test_substring_dedup(docs, empty):
    got = {r.doc_id: r for r in substring_dedup.deduplicated(docs).collect()}
    seen = set()
    for doc_id, text, *_ in ROWS:
        b = (text or "").encode()
        gone = set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(b[i : i + 100])
        stay = bytes(x for i, x in enumerate(b) if i not in gone)
        assert (got[doc_id].n_removed, got[doc_id].kept_sha256) == (len(gone), hashlib.sha256(stay).hexdigest())
    assert substring_dedup.deduplicated(empty).count() == 0


def test_passages(docs, empty):
    assert {(r.doc_id, r.other_id) for r in compact_windows.near_passages(docs).collect()} >= {(1, 0), (2, 0)}
    assert compact_windows.near_passages(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard(docs, 3, ["doc_id"]).collect()
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(3)]
    assert sorted(map(len, counts)) == [2, 2, 3] and all(c == list(range(len(c))) for c in counts)
    assert sharding.shard(empty, 3, ["doc_id"]).count() == 0


def test_line_rules(docs, empty):
    got = {r.doc_id: r for r in line_rules.judged(docs, carry=["doc_id"]).collect()}
    assert got[0].kept and got[6].kept and not got[3].kept and got[4].n_words == 0
    assert line_rules.judged(empty, carry=["doc_id"]).count() == 0


def test_pseudonyms(docs, empty):
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs).collect()}
    assert got[3].text is None and got[0].text == ROWS[0][1] and got[5].n_replaced == 2
    assert "me@example.com" not in got[5].text and len(got[5].text) == len(ROWS[5][1])
    assert pseudonyms.pseudonymised(empty).count() == 0


def test_licenses(docs, empty):
    _, spans = license_scan.scanned(docs)
    assert {(r.doc_id, r.label) for r in spans.collect()} == {(5, "mit-notice")}
    assert license_scan.scanned(empty)[0].count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    got = packing.packed(docs, path).collect()
    tokenizer = Tokenizer.from_file(path)
    for doc_id, text, *_ in ROWS:
        own = [r for r in got if r.doc_id == doc_id]
        assert sum(r.length for r in own) == len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    at = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    assert packing.packed(empty, path).count() == 0


def test_mixing(docs, empty):
    got = mixing.mixed(docs, mixing.word_count()).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert mixing.mixed(empty, mixing.word_count()).count() == 0


def test_fingerprint(docs):
    got = {r.doc_id: r for r in fingerprint.with_next(docs.select("doc_id", "text"), derived={"s": fingerprint.sketch(line_rules.text_column())}).collect()}
    assert got[1].next_text == ROWS[0][1] and got[0].next_text == ROWS[6][1] and got[0].s == got[1].s


#: Names that operators use for columns of their own, and the results' names.
CLASHES = "__id __place place n cls component node kept label least __d __h __null __doc __host __l __line cleaned n_words base_failed n_removed_words __text __words __flagged n_replaced pass weight mix_rank __tokens __source __block __s __b n_tokens ids __key __order shard slot v a b src dst".split()
RUNS = {
    "line rules": lambda df: line_rules.judged(df),
    "near duplicates": lambda df: near_dedup.components(df),
    "pseudonyms": lambda df: pseudonyms.pseudonymised(df),
    "mixing": lambda df: mixing.mixed(df, mixing.word_count()),
    "packing": lambda df: packing.packed(df, packing.tokenizer_path()),
    "sharding": lambda df: sharding.shard(df, 3, ["doc_id"]),
    "substrings": lambda df: substring_dedup.deduplicated(df),
    "passages": lambda df: compact_windows.near_passages(df),
    "licenses": lambda df: license_scan.scanned(df)[0],
    "fingerprint": lambda df: fingerprint.with_next(df, values=("text",)),
}


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns(docs, name):
    """Extra columns with an operator's own names change nothing in its rows."""
    wide = docs.selectExpr("*", *[f"doc_id + {i} AS `{c}`" for i, c in enumerate(CLASHES)])
    plain = RUNS[name](docs)
    got = RUNS[name](wide)
    if name in ("line rules", "pseudonyms", "mixing", "sharding"):  # these return the table's other columns as well
        assert set(wide.columns) <= set(got.columns)
        extra = [c for c in CLASHES if c not in plain.columns]
        assert all(r[c] == r.doc_id + CLASHES.index(c) for r in got.collect() for c in extra)
    if name not in ("mixing", "sharding"):  # there the extra values count as part of a row and deal it elsewhere
        assert sorted(map(repr, got.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, empty, stage):
    """Each stage keeps the columns of documents, whatever else the table holds, and takes an empty table."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    extra = docs.selectExpr("*", *[f"doc_id + {i} AS `{c}`" for i, c in enumerate(CLASHES)])
    out = run(spark, extra, "")
    if stage < 4:
        assert out.columns == extra.columns
        assert all(r[c] == r.doc_id + i for r in out.collect() for i, c in enumerate(CLASHES))
    assert out.count() > 0 and run(spark, empty, "").count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (None, WORDS, None, None), (None, WORDS, None, None)], SCHEMA)
    run(spark, nulls, "").collect()
