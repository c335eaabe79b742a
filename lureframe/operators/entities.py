"""Entity extraction: each operator adds one array column, in first-seen order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import text as tx
from ..functions.bind import let, unnest
from ..functions.literals import empty_strings, sql_str, str_array

# FIXED VALUES: entity patterns, currency marks and month names.
URL = r"(?iU)\b(?:(?:https?|ftp)://|www\.)[^\s<>()\[\]{}\"'`\\]+"
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = (
    r"(?:\+\d{1,3}[\s.-]?\d{2,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{3,4})?"
    r"|(?:\(\d{2,5}\)[\s.-]?|\d{2,5}[\s.-]?)?\d{3}[\s.-]?\d{4}"
    r"|\d{3}[\s.-]?\d{3}[\s.-]?\d{3,4})"
)
MONEY = (
    r"(?:[$€£₹¥₩₦₱]\s?\d[\d,]*(?:\.\d{1,2})?"
    r"|\d[\d,]*(?:\.\d{1,2})?\s*(?:(?:USD|EUR|GBP|INR|JPY|CNY|AUD|CAD|SGD|HKD|NGN|RUB|TRY|ZAR|BRL|MXN|KRW|PKR|BDT"
    r"|VND|PHP|MYR|THB)|dollars?|euros?|pounds?|rupees?|yen|yuan|bucks?))"
)
MONTHS = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATE = (
    r"(?iU)(?:\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"
    rf"|\b\d{{1,2}}(?:st|nd|rd|th)?\s{MONTHS}(?:\s\d{{4}})?\b"
    rf"|\b{MONTHS}\s\d{{1,2}}(?:st|nd|rd|th)?,?\s\d{{4}}\b)"
)
CODE_TRIGGER = (
    r"\b(?:otp|one[- ]time(?: password| pin| code)?|verification code|security code|auth(?:entication)? code|pin"
    r"|confirmation code|login code)\b"
)
CODE = r"(?<!\d)\d{4,8}(?!\d)"

# FIXED VALUES: entity buckets in reporting order.
BUCKETS = ["urls", "emails", "phones", "companies", "banks", "organizations", "amounts", "dates", "other"]


def _around(text: Column, pattern: str, reach: int) -> tuple[Column, Column, Column]:
    """Matches of ``pattern`` with up to ``reach`` characters of context on each side.

    The context is captured by look-around, so it never consumes text that a
    later match needs.
    """
    regex = f"(?s)(?={pattern})(?<=(\\A.{{0,{reach - 1}}}|.{{{reach}}}))({pattern})(?=(.{{0,{reach}}}))"
    return tuple(F.regexp_extract_all(text, F.lit(regex), F.lit(g)) for g in (2, 1, 3))


def urls_in(text: Column) -> Column:
    low = F.lower(text)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")
    )
    full = F.transform(found, lambda u: F.when(F.lower(F.left(u, F.lit(4))) == "www.", F.concat(F.lit("http://"), u)).otherwise(u))
    return F.when(low.contains("://") | low.contains("www."), F.array_distinct(full)).otherwise(empty_strings())


def emails_in(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda e: F.rtrim(e, F.lit(".")))
    return F.when(text.contains("@"), found).otherwise(empty_strings())


def deobfuscate(text: Column) -> Column:
    """First URL after undoing ``[.]``, ``hxxp`` and spaced-out schemes, null when there is none."""
    c = text
    for old, new in [("[.]", "."), ("(.)", "."), ("{.}", "."), ("hxxp://", "http://"), ("hxxps://", "https://"),
                     ("http ://", "http://"), ("https ://", "https://"), ("http:// ", "http://"), ("https:// ", "https://")]:
        c = F.replace(c, F.lit(old), F.lit(new))
    low = F.lower(c)
    first = F.regexp_replace(F.regexp_extract(c, URL, 0), "[.,;:!?]+$", "")
    return F.when((low.contains("http://") | low.contains("https://")) & (first != ""), first)


def decode_url(url: Column) -> Column:
    """Percent-decoded URL; ``+`` stays, malformed escapes leave the URL as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def extract_urls(df: DataFrame, text: str = "body") -> DataFrame:
    return df.withColumn("found_urls", urls_in(F.col(text)))


def merge_explicit_urls(df: DataFrame) -> DataFrame:
    """URLs of the text followed by submitted ones not already among them (in extracted form)."""
    extra = F.transform(
        let(lambda x: F.filter(x["urls"], lambda u: ~F.array_contains(x["found"], u)), urls="urls", found="found_urls"),
        lambda u: F.coalesce(F.get(urls_in(u), F.lit(0)), u),
    )
    return df.withColumn("all_urls", F.concat("found_urls", extra))


def extract_emails(df: DataFrame, text: str = "body") -> DataFrame:
    """Distinct ignoring case; the first spelling is kept."""
    return (
        df.withColumn("_e", emails_in(F.col(text)))
        .withColumn("_k", F.transform("_e", F.lower))
        .withColumn("emails", tx.first_by(F.col("_e"), F.col("_k")))
        .drop("_e", "_k")
    )


def _with_context(df: DataFrame, text: str, name: str, pattern: str, key, keep=None, extra=None, reach: int = 40) -> DataFrame:
    value, left, right = _around(F.col(text), pattern, reach)
    has_digit = F.col(text).rlike(r"[0-9]")
    items = F.transform(
        F.arrays_zip(F.col("_v"), F.col("_l"), F.col("_r")),
        lambda m: F.struct(
            tx.strip(m["_v"]).alias("value"),
            F.replace(F.concat(m["_l"], m["_v"], m["_r"]), F.lit("\n"), F.lit(" ")).alias("context"),
            *([extra(m["_v"]).alias("normalized")] if extra else []),
        ),
    )
    if keep:
        items = F.filter(items, keep)
    none = empty_strings()
    return (
        df.withColumn("_v", F.when(has_digit, value).otherwise(none))
        .withColumns({"_l": F.when(F.size("_v") > 0, left).otherwise(none), "_r": F.when(F.size("_v") > 0, right).otherwise(none)})
        .withColumn("_i", items)
        .withColumn("_k", F.transform("_i", lambda m: key(m["value"])))
        .withColumn(name, tx.first_by(F.col("_i"), F.col("_k")))
        .drop("_v", "_l", "_r", "_i", "_k")
    )


def extract_phones(df: DataFrame, text: str = "body") -> DataFrame:
    """Seven to fifteen digits in a phone shape, with 40 characters of context."""
    digits = lambda v: F.length(F.regexp_replace(v, r"\D", ""))
    return _with_context(df, text, "phones", rf"(?<![\d+]){PHONE}(?!\d)", lambda v: v,
                         keep=lambda m: digits(m["value"]).between(7, 15))


def extract_amounts(df: DataFrame, text: str = "body") -> DataFrame:
    return _with_context(df, text, "amounts", f"(?iU:{MONEY})", F.lower,
                         extra=lambda v: F.regexp_replace(v, r"(?U)[,\s]", ""))


def extract_dates(df: DataFrame, text: str = "body") -> DataFrame:
    found = F.regexp_extract_all(F.col(text), F.lit(DATE), F.lit(0))
    return (
        df.withColumn("_d", F.when(F.col(text).rlike("[0-9]"), found).otherwise(empty_strings()))
        .withColumn("_k", F.transform("_d", F.lower))
        .withColumn("dates", tx.first_by(F.col("_d"), F.col("_k")))
        .drop("_d", "_k")
    )


def extract_codes(df: DataFrame, text: str = "body", reach: int = 25) -> DataFrame:
    """Numbers of four to eight digits within ``reach`` characters of a word for a one-time code."""
    trigger, left, right = _around(F.col(text), f"(?iU:{CODE_TRIGGER})", reach)
    has_digits = F.col(text).rlike(r"[0-9]{4}")
    none = empty_strings()
    near = F.flatten(F.transform(
        F.arrays_zip(F.col("_t"), F.col("_l"), F.col("_r")),
        lambda m: F.transform(
            F.regexp_extract_all(F.concat(m["_l"], m["_t"], m["_r"]), F.lit(CODE), F.lit(0)),
            lambda v: F.struct(v.alias("value"), F.concat(F.lit("near '"), m["_t"], F.lit("'")).alias("context")),
        ),
    ))
    return (
        df.withColumn("_t", F.when(has_digits, trigger).otherwise(none))
        .withColumns({"_l": F.when(F.size("_t") > 0, left).otherwise(none), "_r": F.when(F.size("_t") > 0, right).otherwise(none)})
        .withColumn("_n", near)
        .withColumn("codes", tx.first_by(F.col("_n"), F.col("_n.value")))
        .drop("_t", "_l", "_r", "_n")
    )


def brand_terms(lex: lx.Lexicon) -> list[str]:
    return [k for k, _, _ in lex.brands]


def _brand_table(lex: lx.Lexicon) -> Column:
    bucket = {"company": "companies", "bank": "banks"}
    rows = [
        f"{sql_str(key)}, named_struct('key', {sql_str(key)}, 'kind', {sql_str(kind)}, "
        f"'value', {sql_str(key.upper() if kind != 'company' and len(key) <= 4 else key.title())}, "
        f"'bucket', {sql_str(bucket.get(kind, 'organizations'))}, 'context', 'claimed organization in message')"
        for key, kind, _ in _by_length(lex)
    ]
    return F.expr("map(" + ", ".join(rows) + ")")


def _by_length(lex: lx.Lexicon) -> list:
    return sorted(lex.brands, key=lambda b: len(b[0]), reverse=True)


def extract_brands(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT, compat: bool = False, text: str = "lower_body") -> DataFrame:
    """Known organisations, longest name first, then aliases of brands not yet found.

    ``hits`` (from the shared term pass) names the candidates; only those pay for
    the exact word-boundary test.  ``compat`` matches aliases inside words too.
    """
    low = F.col(text)
    table = _brand_table(lex)
    candidates = tx.listed([b[0] for b in _by_length(lex)], F.col("hits"))
    known = let(lambda x: F.transform(
        F.filter(x["keys"], lambda k: F.rlike(x["low"], F.concat(F.lit(r"(?U)\b"), k, F.lit(r"\b")))),
        lambda k: F.element_at(table, k)), keys=candidates, low=low)
    df = df.withColumn("brands", known)
    kinds = {k: kind for k, kind, _ in lex.brands}
    seen_aliases: dict[str, Column] = {}
    extra = []
    for alias, key in lex.aliases:
        here = low.contains(alias) if compat else low.contains(alias) & low.rlike(rf"(?U)\b{alias}\b")
        fresh = ~F.array_contains("brands.key", key)
        if key in seen_aliases:
            fresh = fresh & ~seen_aliases[key]
        extra.append(F.when(
            here & fresh,
            F.struct(F.lit(key).alias("key"), F.lit(kinds[key]).alias("kind"), F.lit(alias).alias("value"),
                     F.lit("companies").alias("bucket"), F.lit("obfuscated brand name in message").alias("context")),
        ))
        seen_aliases[key] = seen_aliases[key] | here if key in seen_aliases else here
    return df.withColumn("brands", F.concat("brands", F.array_compact(F.array(*extra))))


def _item(bucket: str, kind: Column | str, value: Column, context: Column | str, **metadata: Column) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    if metadata:
        meta = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v)])
    else:
        meta = F.expr("cast(map() as map<string,string>)")
    return F.struct(lit(bucket).alias("bucket"), lit(kind).alias("entity_type"), value.alias("value"),
                    lit(context).alias("context"), meta.alias("metadata"))


def collect_entities(df: DataFrame) -> DataFrame:
    """All entity columns as one array of structs, in bucket order."""
    def url_items(x):
        source = lambda u: F.when(F.array_contains(x["found"], u), "message text").otherwise("explicit submission")
        return F.transform(x["all"], lambda u: _item("urls", "url", u, source(u)))


    def named(bucket):
        return F.transform(F.filter("brands", lambda b: b["bucket"] == bucket),
                           lambda b: _item(bucket, b["kind"], b["value"], b["context"], canonical_key=b["key"]))

    brands = [named(b) for b in ("companies", "banks", "organizations")]
    return df.withColumn("entities", F.concat(
        let(url_items, all="all_urls", found="found_urls"),
        F.transform("emails", lambda e: _item("emails", "email", e, "message text")),
        F.transform("phones", lambda p: _item("phones", "phone", p["value"], p["context"])),
        *brands,
        F.transform("amounts", lambda a: _item("amounts", "amount", a["value"], a["context"], normalized=a["normalized"])),
        F.transform("dates", lambda d: _item("dates", "date", d, "message text")),
        F.transform("codes", lambda c: _item("other", "code", c["value"], c["context"])),
    ))


def entities_long(df: DataFrame) -> DataFrame:
    return unnest(df, "entities", "msg_id")


def entity_counts(df: DataFrame) -> DataFrame:
    """Number of entities per message and bucket; counted inside the row, without a shuffle."""
    counts = let(lambda x: F.transform(str_array(BUCKETS), lambda b: F.struct(
        b.alias("bucket"), F.size(F.filter(x["buckets"], lambda y: y == b)).alias("n"))), buckets="entities.bucket")
    return unnest(df, counts, "msg_id").drop("ord")
