"""URL rules and lists against plain loops, and the filter's errors."""

import re

import pytest

from strandloom.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/es/x", "allow"), ("EXAMPLE.net", "/q", "block"), ("EXAMPLE.net", "/q", "allow"), (None, "/", "block"), ("", "/", "block"), ("org", "x", "block"), ("org", None, "block"), ("net", "/", "maybe")]
LISTED = ["http://www.Bad.example:80/Page/?b=2&utm_source=x&a=1#top", "https://u:p@bad.example/other//", "no url", None, "http://twice.example", "https://twice.example/"]
URLS = [
    None, "", "no scheme", "http://", "://host/path", "http://x.org", "http://x.org/", "http://X.ORG/a?b=/c#d", "https://example.org/es/1", "https://www.example.org/es/1", "https://notexample.org/es/1",
    "https://example.org/es", "https://a.example.org/es/x1", "https://example.org/en/123/", "https://example.org/en/21", "http://b.com/fr/", "http://b.com/de/?x", "http://b.com#/de/", "http://b.com?/de/", "http://com/de/",
    "http://example.net/qq", "http://bad.example/Page?a=1&b=2", "https://bad.example/Page/?b=2&a=1&ref=z", "http://bad.example/page?a=1&b=2", "http://bad.example/other", "http://bad.example:8080/other", "https://www.twice.example/?utm_medium=q",
    "http://é.org/ü", "http://b.com/de/" + "x" * 100000, "http://" + ".".join("abc" for _ in range(3000)) + ".org/", "http://x.org/a\nb", "ftp://bad.example/other/#", "http://b.com/fr/", "http://b.com/fr/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def form(url):
    host, path = parts(url)
    host = re.sub(r"^www\.(?=.)", "", re.sub(r"\.$", "", re.sub(r":(80|443)?$", "", host.split("@")[-1])))
    if not host:
        return None
    asked = re.search(r"\?([^#]*)", url.split("://", 1)[1].split("#")[0])
    asked = asked[1].split("&") if asked else []
    asked = sorted(p for p in asked if p and p.split("=")[0] not in url_filter.TRACKING and not p.split("=")[0].startswith("utm_"))
    return host, path.rstrip("/"), "&".join(asked)


def expected(urls, rules, listed):
    known = {form(u) for u in listed} - {None}
    out = []
    for i, url in enumerate(urls):
        host, path = parts(url)
        fits = [(len(h) + len(p), len(h), h.lower() + p, v == "block") for h, p, v in rules if h and p and p.startswith("/") and v in ("allow", "block") and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=None)
        on_list = form(url) in known
        out.append((i, url, host, path, best[2] if best else None, on_list, "block" if (best[3] if best else on_list) else "allow"))
    return sorted(out)


@pytest.mark.parametrize("bits_each", [16, 1])
def test_verdicts(spark, bits_each):
    pages = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(URLS)], "page_id long, url string, host string, kind string")
    out = url_filter.judged(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in LISTED], "url string"), bits_each)
    assert set(out.columns) == {"page_id", "url", "kind", "host", "path", "rule", "listed", "verdict"}
    rows = out.select("page_id", "url", "host", "path", "rule", "listed", "verdict").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == expected(URLS, RULES, LISTED)


def test_empty_tables(spark):
    none, pages = spark.createDataFrame([], "url string"), spark.createDataFrame([(1, "http://bad.example/other")], "page_id long, url string")
    no_rules = spark.createDataFrame([], "host string, path string, verdict string")
    some = spark.createDataFrame([(u,) for u in LISTED], "url string")
    assert [tuple(r) for r in url_filter.judged(pages, no_rules, none).select("rule", "listed", "verdict").collect()] == [(None, False, "allow")]
    assert [tuple(r) for r in url_filter.judged(pages, no_rules, some).select("rule", "listed", "verdict").collect()] == [(None, True, "block")]
    assert url_filter.judged(pages.limit(0), no_rules, some).count() == 0


def test_filter_lets_all_entries_and_few_others_through(spark):
    listed = spark.range(2000).selectExpr("1 AS kind", "concat('h', id) AS host", "'/?' AS rest")
    others = spark.range(20000).selectExpr("1 AS kind", "concat('g', id) AS host", "'/?' AS rest")
    blocks, n = url_filter.bloom(listed)
    assert url_filter.possible(listed, blocks, n).count() == 2000
    assert url_filter.possible(others, blocks, n).count() < 200


def test_large_filters_are_joined_by_block(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SMALL_FILTER", 0)
    test_verdicts(spark, 16)
