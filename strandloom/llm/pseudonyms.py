"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Validated numbers and dates are replaced by other values of the same format: card numbers that pass the Luhn
check stay valid, IPv4 addresses stay addresses, dates stay dates, phone numbers keep their country code and
punctuation. Mail addresses and access secrets keep the class of every character. Each map is a permutation of
its format under the key, so equal values stay linked across documents and different ones stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import aside, documents, feistel, text_column, untouched, walked

#: The session's setting with the secret key, and the key of tests and demonstrations where it is unset.
SETTING, KEY = "strandloom.pseudonyms.key", "strandloom-demo-key"

#: The formats, most specific first.
FORMATS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "access": r"\bAKIA[0-9A-Z]{16}\b|(?<=password=)[^\s\"']+|(?<=token = \")[0-9a-fA-F]{20,}(?=\")",
    "date": r"(?<![\d.-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(f"(?:{x})" for x in FORMATS.values())
#: A text without any of these has none of them; keys and tokens can be of letters alone.
HINT = r"[0-9@]|password=|AKIA|token = "


def key_of(spark: SparkSession) -> str:
    """The key that the session names; whoever has it can undo the pseudonyms."""
    return spark.conf.get(SETTING, KEY)


def prf(key: str):
    """Non-negative 56-bit values from SHA-256 under the key."""
    return lambda i, half: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")


def shifted(text: Column, digest: Column, letters: int = 26) -> Column:
    """Each letter or digit moved within its class by a byte of the digest (hexadecimal)."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (i % 32) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int") + i
        turn = lambda low, n: F.char(((F.ascii(c) - F.lit(low) + by) % n + F.lit(low)).cast("int"))
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, letters)).when(c.between("A", "Z"), turn(65, letters)).otherwise(c)

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), move), ""))


def permuted(text: Column, key: str, rounds: int = 6, letters: int = 26) -> Column:
    """A keyed permutation of the texts of one pattern of classes: a Feistel network over the two halves."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.char_length(text)).alias("r"))
    digest = lambda i, other: F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), other), 256)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, i: F.when(i % 2 == 1, F.struct(shifted(s["l"], digest(i, s["r"]), letters).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], digest(i, s["l"]), letters).alias("r"))), lambda s: F.concat(s["l"], s["r"]))


def recased(text: Column, pattern: Column) -> Column:
    """The text's letters, upper case where the pattern has upper case."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(pattern, ""), lambda c, p: F.when(p.between("A", "Z"), F.upper(c)).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is not doubled."""
    n = F.char_length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def refilled(pattern: Column, digits: Column) -> Column:
    """The pattern with its digits replaced in order."""
    chars = F.split(pattern, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(chars, start, lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))), lambda s: s["out"])


def card(value: Column, key: str) -> Column:
    """A Luhn-valid number becomes another one of its length; any other is left as it is."""
    digits = F.regexp_replace(value, r"\D", "")
    body = permuted(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key)
    check = (F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(digits) % 10 == 0, refilled(value, F.concat(body, check.cast("string")))).otherwise(value)


def ip(value: Column, key: str) -> Column:
    n = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    out = F.transform(F.array(feistel(n, F.lit(65536), F.lit(65536), prf(key))), lambda m: F.concat_ws(".", *[(F.shiftright(m, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
    return out[0]


def date(value: Column, key: str) -> Column:
    """A date of 1900 to 2099 becomes another; an impossible one (as 30 February) is left as it is."""
    days = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")).cast("long")
    permute = lambda x: feistel(x, F.lit(271), F.lit(271), prf(key))  # noqa: E731  271 * 271 = 73441; there are 73049 days
    moved = walked(days, F.lit(73049).cast("long"), permute)
    return F.coalesce(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), moved.cast("int")), "yyyy-MM-dd"), value)


def phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)
    rest = F.substring(value, F.char_length(country) + 1, F.char_length(value))
    return F.concat(country, refilled(rest, permuted(F.regexp_replace(rest, r"\D", ""), key)))


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value, by its format."""
    whole = lambda kind: value.rlike(f"^(?:{FORMATS[kind]})$")
    # addresses in other case are one address: permuted in lower case, the value's own case put back
    out = F.when(value.contains("@"), recased(permuted(F.lower(value), f"{key}|mail"), value))
    out = out.when(whole("date"), date(value, f"{key}|date")).when(whole("ip"), ip(value, f"{key}|ip"))
    out = out.when(whole("phone") | whole("ssn"), phone(value, f"{key}|phone"))
    out = out.when(value.rlike(r"^\d(?:[ -]?\d){12,18}$"), card(value, f"{key}|card"))
    return out.otherwise(F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), permuted(F.substring(value, F.lit(5), F.char_length(value)), f"{key}|access"))).when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), permuted(value, f"{key}|access", letters=6)).otherwise(permuted(value, f"{key}|access")))


def pseudonymised(df: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """df with the text's values replaced and n_replaced, their number; a null text stays null with 0.

    Texts without such a value come back unchanged, byte for byte. Equal rows have equal results. A column
    named n_replaced is replaced.
    """
    held = [c for c in df.columns if c != "n_replaced"]
    df, names = aside(df, (text,))
    own = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__found", F.coalesce(own, F.array().cast("array<string>")))
    df = df.withColumn("__parts", F.when(F.size("__found") > 0, F.split(F.col(text), ANY, -1)))
    df = df.withColumn("__new", F.transform("__found", lambda v: pseudonym(v, key)))
    joined = F.concat(F.array_join(F.zip_with(F.slice("__parts", F.lit(1), F.size("__new")), "__new", lambda a, b: F.concat(a, b)), ""), F.element_at("__parts", -1))
    n = F.size(F.filter(F.arrays_zip("__found", "__new"), lambda x: x["__found"] != x["__new"])).cast("long")
    out = df.withColumns({text: F.when(F.size("__found") > 0, joined).otherwise(F.col(text)), "n_replaced": n})
    return out.select(*[F.col(names[c]).alias(c) for c in held], "n_replaced")


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal numbers, addresses, dates and secrets under pseudonyms."""
    df = documents(spark, sf_dir).select("doc_id", "text", F.sha2(text_column(), 256).alias("before"))
    out = pseudonymised(df, key=key_of(spark))
    return out.select("doc_id", "text", "n_replaced", (F.sha2(text_column(), 256) != F.col("before")).alias("changed"))


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their values under pseudonyms of the session's key; null and empty texts stay as they are."""
    return untouched(docs, ("text",), lambda df: pseudonymised(df, key=key_of(spark)))
