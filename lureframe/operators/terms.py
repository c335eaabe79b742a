"""Phrases, rule keywords and brand names from tables of any size.

A table of up to two thousand terms becomes one prefix-tree regex of the plan, which reads each text once; a hundred
thousand cannot.  Of a larger one each term is listed under its rarest pair of neighbouring tokens (a term of one token under
that), the tokens and pairs of a text are joined to that list, and what meets is verified in place.  A term with
boundaries at both ends holds only whole tokens of the text, in the same order, so nothing is missed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bind import unnest
from ..functions.text import term_hits
from ..sources.derived import SMALL_ROWS, derived, if_small
from .reputation import estimated_bytes, feed_join

#: An estimate from here on says that the size is not known.
UNKNOWN_BYTES = 1 << 50

#: A run of letters and digits, or one other visible character (for terms of another alphabet).
TOKEN = r"[a-z0-9]+|[^a-z0-9\s]"
#: Terms that one regex may hold, the characters of the longest, and bytes of their table (as the plan estimates them, if it can) up to which they are tried.
LITERAL_TERMS, LITERAL_LENGTH, LITERAL_BYTES = 2_000, 200, 4 * 1024 * 1024
#: Index rows that a task may hash while the texts' tokens stream by; beyond, both sides are sorted.
HASHED_ROWS = 500_000


def tokens_of(lower: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TOKEN), F.lit(0)))


def pairs_of(lower: Column) -> Column:
    """Neighbouring tokens with what stands between them: every other pair of the text, then every other one after its first token."""
    word, other = "[a-z0-9]++", r"[^a-z0-9\s]"
    pair = rf"(?:(?<![a-z0-9]){word}|{other})\s*+(?:{word}|{other})"  # a match ends with a token, so the next one starts with one
    rest = F.regexp_extract(lower, rf"(?s)\A\s*+(?:{word}|{other})(.*)\z", 1)
    parts = lambda c: F.regexp_extract_all(c, F.lit(pair), F.lit(0))
    return F.array_distinct(F.concat(parts(lower), parts(rest)))


def keys_of(lower: Column) -> Column:
    """All that a text's terms may be listed under."""
    return F.concat(tokens_of(lower), pairs_of(lower))


def stands_in(lower: Column, term: Column) -> Column:
    """The term occurs between characters other than ASCII letters and digits."""
    exact = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return lower.contains(term) & F.rlike(lower, exact)


def term_index(texts: DataFrame, terms: DataFrame, text: str = "lower_body", pairs: bool = False) -> DataFrame:
    """token, term, sure: every term under the token of it that the fewest texts hold.

    ``pairs``: terms of several tokens stand under pairs of neighbouring tokens instead, which far fewer texts share.
    Texts are read only for terms with a choice of keys: what these may be listed under is counted, and those with a token that no
    text holds are left out.  ``sure``: the term is its key, so a text with the key holds it.
    """
    of_term, of_text = tokens_of(F.col("term")), tokens_of(F.col(text))
    if pairs:  # a term of one token has one key
        of_term, of_text = F.when(F.size(pairs_of(F.col("term"))) > 0, pairs_of(F.col("term"))).otherwise(of_term), pairs_of(F.col(text))
    keyed = derived(terms.select("term").where("term is not null").distinct().withColumn("keys", of_term).where(F.size("keys") > 0), "keyed-terms")
    sure = ((F.col("term") == F.col("token")) & F.rlike("term", F.lit(r"(?s)^[a-z0-9](.*[a-z0-9])?\z"))).alias("sure")
    index = keyed.where(F.size("keys") == 1).select(F.get("keys", F.lit(0)).alias("token"), "term").select("token", "term", sure)
    several = keyed.where(F.size("keys") > 1)
    if several.isEmpty():
        return index
    parts = derived(unnest(several, "keys", "term", item="token").select("term", "token"), "term-tokens")
    asked = if_small(derived(parts.groupBy("token").agg(F.count(F.lit(1)).alias("terms")), "asked-tokens"))
    held = unnest(texts, of_text, item="token").select("token")
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).join(asked, "token")
    ranked = parts.join(if_small(derived(counts, "token-counts")), "token", "left")
    best = ranked.groupBy("term").agg(F.min_by("token", F.struct("texts", "terms", "token")).alias("token"), F.bool_and(F.col("texts").isNotNull()).alias("possible"))
    return index.unionByName(best.where("possible").select("token", "term").select("token", "term", sure))


def few_terms(terms: DataFrame, most: int = LITERAL_TERMS) -> list[str] | None:
    """The distinct terms with a visible character, if they are at most ``most`` and short enough for one regex; else None."""
    if not most or LITERAL_BYTES < estimated_bytes(terms) < UNKNOWN_BYTES:
        return None
    found = [r[0] for r in terms.select("term").where(F.rlike("term", F.lit(r"\S"))).distinct().limit(most + 1).collect()]
    return found if len(found) <= most and max(map(len, found), default=0) <= LITERAL_LENGTH else None


def find_terms(texts: DataFrame, terms: DataFrame, key: str = "msg_id", text: str = "lower_body", small: int = SMALL_ROWS,
               literal: int = LITERAL_TERMS) -> DataFrame:
    """key, term: every term that stands in a text (lower-cased), each once.

    ``terms``: term (lower case).  Up to ``literal`` terms are one regex, and each text is read once.  An index of up to ``small`` rows is broadcast
    and verified while the text is at hand: no text moves.  Beyond, tokens meet the index by a join, and the texts that have a
    candidate follow it to be verified, where the key is not the term itself; a key that fills many rows is dealt to several tasks
    (by adaptive execution where the key is the term, else by salts).  Terms without a visible character occur nowhere; null texts hold nothing.
    """
    few = few_terms(terms, min(small, literal))
    if few is not None:
        return _literal_hits(texts, few, key, text).select(key, "term")
    index = derived(term_index(texts, terms, text, pairs=True), "term-index")
    alone = F.rlike("token", F.lit(rf"\A(?:{TOKEN})\z"))
    rows, tokens, certain = index.agg(F.count(F.lit(1)), F.count_if(alone), F.count_if("sure")).head()
    lower = F.col(text)
    keys = pairs_of(lower) if not tokens else tokens_of(lower) if tokens == rows else keys_of(lower)  # no kind that nothing is listed under
    held = unnest(texts, keys, key, text, item="token")
    stands = stands_in(F.col(text), F.col("term"))
    if rows <= small:
        return held.join(F.broadcast(index), "token").where(F.col("sure") | stands).select(key, "term")
    sure = index.where("sure").select("token", "term")  # one row a token
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    how = "shuffle_hash" if certain <= HASHED_ROWS * tasks else "merge"
    found = held.select(key, "token").join(sure.hint(how), "token").select(key, "term")
    if certain == rows:
        return found
    rest = derived(index.where("not sure").select("token", "term"), "open-terms")
    open_ = feed_join(held.select(key, "token"), rest, "token", F.col(key), "inner").select(key, "term")
    return found.unionByName(texts.select(key, text).join(open_, key).where(stands).select(key, "term"))


def _literal_hits(texts: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """key, text, term of every term in every text, by one regex."""
    found = term_hits(F.col(text), terms) if terms else F.expr("cast(array() as array<string>)")
    return unnest(texts, found, key, text, item="term").select(key, text, "term")


def _listed(found: DataFrame, dim: DataFrame, key: str, group: str, name: str) -> DataFrame:
    """``found`` terms under the groups that list them, in the order of the list (``ord``); a group may list a term twice."""
    rows = found.join(if_small(derived(dim.groupBy(group, "term").agg(F.min("ord").alias("ord")), "listed-terms")), "term")
    items = F.transform(F.sort_array(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"])
    return rows.groupBy(key, group).agg(items.alias(name))


def phrases_by_table(texts: DataFrame, phrases: DataFrame, key: str = "msg_id", text: str = "lower_body", **options) -> DataFrame:
    """msg_id, phrase_group, phrases: the literal phrases of each group, in list order.  ``phrases``: phrase_group, ord, term."""
    return _listed(find_terms(texts, phrases, key, text, **options), phrases, key, "phrase_group", "phrases")


def rules_by_table(texts: DataFrame, keywords: DataFrame, key: str = "msg_id", text: str = "lower_body", **options) -> DataFrame:
    """msg_id, rule_id, keywords: the keywords of each rule that matches.  ``keywords``: rule_id, ord, term."""
    return _listed(find_terms(texts, keywords, key, text, **options), keywords, key, "rule_id", "keywords")


def brands_by_table(texts: DataFrame, brands: DataFrame, key: str = "msg_id", text: str = "lower_body", **options) -> DataFrame:
    """msg_id, term and the brand's columns, of names that stand between word boundaries of any alphabet.  ``brands``: term, ..."""
    whole = F.rlike(F.col(text), F.concat(F.lit(r"(?U)\b\Q"), F.col("term"), F.lit(r"\E\b")))
    few = few_terms(brands, min(options.get("small", SMALL_ROWS), options.get("literal", LITERAL_TERMS)))
    if few is None:
        found = if_small(derived(find_terms(texts, brands, key, text, **options), "brand-hits"))
        kept = texts.select(key, text).join(found, key).where(whole).select(key, "term")
    else:  # hits are judged while the text is at hand
        hits = derived(_literal_hits(texts, few, key, text).select(key, "term", whole.alias("whole")), "brand-hits")
        kept = hits.where("whole").select(key, "term").join(if_small(hits.select(key, "term")), [key, "term"])
    return kept.join(if_small(derived(brands, "brands")), "term")


# -- nearest name -------------------------------------------------------------------------------------------------------------

def deletions(name: Column) -> Column:
    """The name and every string that one or two deletions leave of it."""
    def once(s: Column) -> Column:
        spots = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(spots, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    one = F.array_distinct(once(name))
    return F.array_distinct(F.concat(F.array(name), one, F.flatten(F.transform(one, once))))


def nearest_name(names: DataFrame, brands: DataFrame, name: str = "name", edits: int = 2) -> DataFrame:
    """name, brand: of the brands within two edits the nearest, the last in ``ord`` of the best; names without one are left out.

    ``names``: distinct lower-cased names; ``brands``: key, ord.  Two strings within two edits share a string that at most two deletions
    leave of each: these are joined, what meets is verified by Levenshtein.  Only names short enough to have a partner are
    spelt out, so the index grows with the names, not with names times brands.
    """
    longest = brands.agg(F.max(F.length("key"))).head()[0] or 0
    listed = unnest(brands.select("key", F.col("ord").alias("place")), deletions(F.col("key")), "key", "place", item="left").drop("ord")
    asked = unnest(names.where(F.length(name) <= longest + edits), deletions(F.col(name)), name, item="left").select(name, "left")
    met = feed_join(asked, derived(listed, "deletions"), "left", F.col(name), "inner").select(name, "key", "place").distinct()
    near = met.withColumn("d", F.levenshtein(F.col(name), F.col("key"), edits)).where("d >= 0")
    return near.groupBy(name).agg(F.min_by("key", F.struct("d", -F.col("place"))).alias("brand"))


def fuzzy_brand_by_table(df: DataFrame, brands: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``df`` with ``brand``: exact name, alias, else the nearest brand within two edits.  ``brands``: key, ord; ``aliases``: alias, key.

    Distinct names are looked up; a name that a third of all rows has is spread when the rows meet what was found.
    """
    from ..functions.text import normalize

    low = df.withColumn("_low", F.lower(normalize(F.col(name))))
    names = derived(low.select("_low").distinct(), "names")
    exact = brands.select(F.col("key").alias("_low"), F.col("key").alias("exact"))
    alias = aliases.groupBy(F.col("alias").alias("_low")).agg(F.min("key").alias("other"))
    found = names.join(exact, "_low", "left").join(alias, "_low", "left").join(nearest_name(names, brands, "_low"), "_low", "left").select(
        "_low", F.coalesce("exact", "other", "brand").alias("brand")).where("brand is not null")
    return feed_join(low, derived(found, "found-names"), "_low", F.struct(*df.columns)).drop("_low").select(*df.columns, "brand")
