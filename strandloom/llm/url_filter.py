"""URL filters: rules for hosts and paths and a list of URLs, behind one blocked Bloom filter.

Every entry of the list, a rule or a canonical URL, sets eight bits of one 512-bit block, one in each of its eight
words. A page's URL has a few keys: its canonical form, and its host's endings with its path's beginnings in the
lengths that rules have. Only keys whose eight bits are all set go on to the exact join with the list, which drops
what the filter let through by chance; so the list itself never meets the keys that aren't on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import aside, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for each entry, and of a block: eight words of 64.
BITS_EACH, BLOCK_BITS = 16, 512
#: A filter of up to so many bytes is broadcast; a larger one is joined by block.
SMALL_FILTER = 32 << 20
#: Query parameters that say where a visitor came from, not which page it is: these names, and utm_ with anything.
TRACKING = ("ref", "fbclid", "gclid", "msclkid", "mc_eid", "igshid")
#: Hosts with one of these words in a label are listed by the query.
SPAM_WORDS = ("spam", "pills", "casino", "farm")
ENTRY = ("kind", "host", "rest")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL; both empty if there is no `://`."""
    rest = after_scheme(url)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and rest of a URL's canonical form; null without a host.

    Scheme, user, default port, a leading `www.`, a last dot of the host, the last slash of the path, the fragment
    and tracking parameters go; the other parameters are sorted.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), "\\.$", ""), "^www\\.(?=.)", "")
    asked = F.split(F.regexp_extract(after_scheme(url), "^[^?#]*\\?([^#]*)", 1), "&")
    name = lambda p: F.substring_index(p, "=", 1)
    asked = F.array_sort(F.filter(asked, lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~name(p).startswith("utm_")))
    rest = F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/?"), F.array_join(asked, "&"))
    return F.when(host != "", host), F.when(host != "", rest)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(kind, host, rest, blocked) of rules (host, path, verdict) and listed URLs (url), each once.

    Rules without a host or path, or with another verdict than allow or block, and URLs without a host are no
    entries; of two verdicts of one rule, block stands.
    """
    host, rest = canonical(F.col("url"))
    urls = listed.select(host.alias("host"), rest.alias("rest")).filter("host IS NOT NULL").distinct().select(F.lit(1).alias("kind"), "host", "rest", F.lit(True).alias("blocked"))
    sound = rules.filter((F.translate("host", UPPER, LOWER) != "") & F.col("path").startswith("/") & F.col("verdict").isin("allow", "block"))
    sound = sound.groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("rest")).agg(F.max(F.col("verdict") == "block").alias("blocked"))
    return sound.select(F.lit(0).alias("kind"), "host", "rest", "blocked").unionByName(urls)


def key_block(blocks: int, key: tuple[str, ...] = ENTRY) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), *key), F.lit(blocks)).alias("block")


def key_words(key: tuple[str, ...] = ENTRY) -> list[Column]:
    """The bit of each of a block's eight words that a key sets, by six bits of a second hash each."""
    second = "xxhash64(29, " + ", ".join(key) + ")"
    return [F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({second}, {6 * i}) & 63 AS int))") for i in range(8)]


def bloom(listed: DataFrame, bits_each: int = BITS_EACH, key: tuple[str, ...] = ENTRY) -> tuple[DataFrame, int]:
    """The filter (block, w0 .. w7) over entries, blocks without a bit left out, and its number of blocks."""
    blocks = max(1, -(-listed.count() * bits_each // BLOCK_BITS))
    set_bits = listed.select(key_block(blocks, key), *[w.alias(f"w{i}") for i, w in enumerate(key_words(key))])
    return set_bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]), blocks


def small(blocks: int) -> bool:
    """Whether a filter of so many blocks may be broadcast."""
    return blocks * (BLOCK_BITS // 8 + 8) <= SMALL_FILTER


def possible(keys: DataFrame, filtered: DataFrame, blocks: int, key: tuple[str, ...] = ENTRY) -> DataFrame:
    """Those of keys (kind, host, rest, .., or what `key` names) whose bits are all set."""
    filtered = F.broadcast(filtered) if small(blocks) else filtered
    met = keys.withColumn("block", key_block(blocks, key)).join(filtered, "block")
    for i, word in enumerate(key_words(key)):
        met = met.filter(F.col(f"w{i}").bitwiseAND(word) != 0)
    return met.drop("block", *[f"w{i}" for i in range(8)])


def url_keys(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, kind, host, rest): the keys of each page's URL.

    Rules are tried in the shapes that they have: pairs of a host's number of labels and a path's length, one row in
    all, with as many pairs as there are such shapes among the rules.
    """
    shape = F.struct(F.size(F.split("host", "\\.")).alias("labels"), F.length("rest").alias("length"))
    shapes = listed.filter("kind = 0").agg(F.collect_set(shape).alias("shapes"))
    host, path = host_and_path(F.col("url"))
    own_host, own_rest = canonical(F.col("url"))
    rows = pages.filter("url IS NOT NULL").select("url", host.alias("h"), path.alias("p"), F.struct(F.lit(1).alias("kind"), own_host.alias("host"), own_rest.alias("rest")).alias("own"))
    rows = rows.filter("h <> ''").crossJoin(F.broadcast(shapes))
    fits = F.filter("shapes", lambda s: (s["labels"] <= F.size(F.split("h", "\\."))) & (s["length"] <= F.length("p")))
    ruled = F.transform(fits, lambda s: F.struct(F.lit(0).alias("kind"), F.call_function("substring_index", F.col("h"), F.lit("."), -s["labels"]).alias("host"), F.col("p").substr(F.lit(1), s["length"]).alias("rest")))
    keys = F.filter(F.array_append(ruled, F.col("own")), lambda x: x["host"].isNotNull())
    return rows.select("url", F.explode(keys).alias("key")).select("url", "key.*")


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, bits_each: int = BITS_EACH) -> DataFrame:
    """pages (url, ..) with host, path, rule, listed and verdict, other columns as they are (those of the new names are replaced).

    The longest of the rules (host, path, verdict) that fit decides, by host and path together; then whether the URL's
    canonical form is that of a listed one (url): block, else allow. A URL that is null, or has no `://`, or no host
    is allowed and has no rule. Repeated rows stay, empty tables give what they must. Only URLs that the filter lets
    through are dealt out with their keys; the verdicts on distinct URLs come back by a join that Spark broadcasts
    where they are few and splits where one URL has many pages.
    """
    pages = pages.drop("host", "path", "rule", "listed", "verdict")
    rows, names = aside(pages, ("url",))
    found = stored(entries(rules, listed), "entries")
    filtered, blocks = bloom(found, bits_each)
    hits = possible(url_keys(rows.select("url"), found), filtered, blocks).distinct()
    exact = hits.join(found, list(ENTRY))
    ruled = F.when(F.col("kind") == 0, F.struct((F.length("host") + F.length("rest")).alias("n"), F.length("host").alias("h"), F.concat("host", "rest").alias("rule"), "blocked"))
    verdicts = exact.groupBy("url").agg(F.max(ruled).alias("best"), F.max(F.col("kind") == 1).alias("on_list"))
    host, path = host_and_path(F.col("url"))
    out = rows.join(verdicts, "url", "left")
    on_list = F.coalesce("on_list", F.lit(False))
    blocked = F.coalesce(F.col("best.blocked"), on_list)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), on_list.alias("listed"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def spam_urls(pages: DataFrame) -> DataFrame:
    """(url): the pages' URLs on hosts that have a spam word in one of their labels."""
    host, _ = host_and_path(F.col("url"))
    return pages.select("url").filter(F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, SPAM_WORDS))))


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages by the fixed rules, and where none fits by the list of spam URLs."""
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spam_urls(pages))
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")
