r"""DuckDB SQL for the results that SQL can express: near duplicates, exact substrings and line rules.

Hash-bound results (fingerprints, shards, mixtures, pseudonyms), tokens and near passages have none; their tests
compare them with plain loops.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: Sets of five-word shingles, pairs by common shingles, components by their smallest reachable document.
NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS r FROM w UNION SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.node),
least AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) JOIN least ON node = w.doc_id"""

#: All strings of 100 bytes as hexadecimal text; spans are runs of repeated ones, and what stays lies between them.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)),
f AS (SELECT s, min({'doc_id': doc_id, 'i': i}) AS first FROM g GROUP BY s),
again AS (SELECT g.doc_id, g.i FROM g JOIN f USING (s) WHERE {'doc_id': g.doc_id, 'i': g.i} <> f.first),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS stay FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(stay, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

LINE_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{WORD}') AS words, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, CAST(sum(least(5, i - coalesce(prev, -5))) AS BIGINT) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM twice) GROUP BY doc_id),
each_line AS (SELECT doc_id, source, t, unnest(lines) AS line FROM w),
known AS (SELECT doc_id, source, t, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM each_line),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
counts AS (SELECT source, norm, count(DISTINCT t) AS n FROM known WHERE norm <> '' GROUP BY source, norm),
flagged AS (SELECT c.source, c.norm FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n > 10 AND (n > 0.1 * docs OR n > 10000)),
gone AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '{WORD}'))) AS BIGINT) AS n FROM known k JOIN flagged f ON k.source IS NOT DISTINCT FROM f.source AND k.norm = f.norm GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
len(list_filter(lines, lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.2 * n_words)) AS kept, n_removed_words FROM j"""


def url_filter() -> str:
    """SQL of op12: every rule and every listed URL is tried against every page by equality or prefix, without a filter."""
    from .url_filter import SPAM_WORDS, TRACKING

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = ", ".join(f"'{w}'" for w in SPAM_WORDS)
    names = ", ".join(f"'{w}'" for w in TRACKING)
    bare = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\\.$', ''), '^www\\.(.)', '\\1')"
    return f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(tail, '^[^?#]*[?]([^#]*)', 1), '&') AS asked FROM cut),
    forms AS (SELECT page_id, host, path, CASE WHEN {bare} <> '' THEN {bare} || regexp_replace(path, '/+$', '') || '/?' || array_to_string(list_sort(list_filter(asked, lambda p: p <> '' AND NOT list_contains([{names}], string_split(p, '=')[1]) AND NOT starts_with(p, 'utm_'))), '&') END AS form FROM parts),
    spam AS (SELECT DISTINCT form FROM forms WHERE form IS NOT NULL AND list_has_any(regexp_split_to_array(host, '[.-]'), [{words}])),
    rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    fits AS (SELECT page_id, host AS h, path AS p, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, v := rule_verdict)) AS best FROM forms JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, host, path)
    SELECT page_id, host, path, best.rule AS rule, form IS NOT NULL AND form IN (SELECT form FROM spam) AS listed, CASE WHEN best.v IS NOT NULL THEN best.v WHEN form IS NOT NULL AND form IN (SELECT form FROM spam) THEN 'block' ELSE 'allow' END AS verdict
    FROM forms LEFT JOIN (SELECT page_id AS fit_id, best FROM fits) ON page_id = fit_id"""


def centroids(k: int = 40, rounds: int = 5) -> str:
    """SQL of op13: all distances in every round, as whole numbers."""
    squares = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "named AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS place, v FROM kept)",
        f"c0 AS (SELECT CAST(place - 1 AS INT) AS cluster, v AS c FROM named WHERE place <= {k})",
        "rows AS (SELECT row_number() OVER () AS n, vec_id, v FROM kept)",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT n, vec_id, v, min(struct_pack(d := CAST({squares} AS BIGINT), i := cluster)) AS m FROM rows, c{t} GROUP BY n, vec_id, v)")
        if t < rounds:
            steps.append(f"m{t} AS (SELECT m.i AS cluster, pos, CAST(floor(sum(x)::HUGEINT // count(*) - CASE WHEN sum(x)::HUGEINT < 0 AND sum(x)::HUGEINT % count(*) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS x FROM (SELECT m, unnest(v) AS x, unnest(range(64)) AS pos FROM a{t}) GROUP BY m.i, pos)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(f.v, c.c) AS c FROM c{t} c LEFT JOIN (SELECT cluster, list(x ORDER BY pos) AS v FROM m{t} GROUP BY cluster) f ON f.cluster = c.cluster)")
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, m.i AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.i) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON cluster = m.i"
    )


def merkle(levels: int = 6) -> str:
    """SQL of op11, for languages of up to 8 ** levels rows and as many languages."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {byte}), 4294967295)"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {digest('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {digest(small)} ELSE {digest('text')} END AS shown FROM documents)",
        "t0 AS MATERIALIZED (SELECT doc_id, g, leaf, shown, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)",
        "n0 AS (SELECT g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM t0)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY g, pos // 8))")

    climb("n")
    steps.append(f"s0 AS MATERIALIZED (SELECT g AS lang, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, d, count(*) OVER () AS n FROM n{levels})")
    steps.append("u0 AS (SELECT g, pos, d, n FROM s0)")
    climb("u")
    side = lambda way: f"(SELECT coalesce(string_agg(d, '' ORDER BY pos), '') FROM {{t}} x WHERE x.g = {{g}} AND x.n > 1 AND x.pos // 8 = {{pos}} // 8 AND x.pos {way} {{pos}})"
    steps.append("f0 AS MATERIALIZED (SELECT t0.*, s0.pos AS top, s0.d AS subroot, shown AS node, '' AS proof FROM t0 JOIN s0 ON s0.lang = t0.g)")
    row = 0
    for name, g, pos, way in [(f"n{k}", "f.g", f"(f.pos // {8**k})", k) for k in range(levels)] + [(f"u{k}", "0", f"(f.top // {8**k})", k) for k in range(levels)]:
        before, after = (side(w).format(t=name, g=g, pos=pos) for w in ("<", ">"))
        steps.append(f"j{row} AS MATERIALIZED (SELECT f.*, {before} AS b, {after} AS a, EXISTS (SELECT 1 FROM {name} x WHERE x.g = {g} AND x.n > 1) AS more FROM f{row} f)")
        steps.append(f"f{row + 1} AS MATERIALIZED (SELECT * EXCLUDE (a, b, more, node, proof), CASE WHEN more THEN sha256(b || node || a) ELSE node END AS node, proof || b || a AS proof FROM j{row})")
        row += 1
    return "WITH " + ", ".join(steps) + f" SELECT doc_id, leaf, subroot, (SELECT d FROM u{levels}) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT d FROM u{levels}) AS verified FROM f{row}"
