"""URL facts per message (array form) and per URL table, brand checks and URL evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import urls as uf
from ..functions.bind import let, unnest
from ..functions.literals import array_map, str_array
from ..functions.rounding import percent
from ..functions.steps import derive, derive_array
from ..functions.text import normalize
from .signals import evidence


def analyze_urls(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT, url: str = "url") -> DataFrame:
    """A table of URLs with one column per fact (stays inside whole-stage code generation)."""
    rest = [c for c in df.columns if c != url]
    wide = derive(df.withColumnRenamed(url, "raw_url"), uf.url_steps(lex))
    return wide.select(*rest, *uf.URL_FIELDS)


def url_facts(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """``url_facts``: the same facts as an array inside the message row, so nothing is shuffled."""
    start = F.transform("all_urls", lambda u: F.struct(u.alias("raw_url")))
    facts = derive_array(start, uf.url_steps(lex), uf.URL_FIELDS)
    empty = F.filter(facts, lambda _: F.lit(False))
    return df.withColumn("url_facts", F.when(F.size("all_urls") > 0, facts).otherwise(empty))


def severity_of_risk(risk: Column) -> Column:
    return F.when(risk >= 0.7, "critical").when(risk >= 0.4, "high").when(risk < 0.15, "low").otherwise("medium")


def url_evidence() -> Column:
    return F.transform("url_facts", lambda u: evidence(
        "url_analysis", F.when(u["risk"] >= 0.4, "url_risk").otherwise("url_checked"), severity_of_risk(u["risk"]),
        F.least(F.lit(0.95), F.lit(0.4) + u["risk"]),
        F.concat(F.lit("Structure of "), u["host"], F.lit(" scores "), percent(u["risk"]), F.lit(": "),
                 F.when(F.size(u["signals"]) > 0, F.array_join(u["signals"], ", ")).otherwise("nothing notable")),
        url=u["url"], domain=u["domain"], risk_score=u["risk"], signals=F.array_join(u["signals"], ","),
    ))


def official_pairs(lex: lx.Lexicon = lx.DEFAULT) -> list[tuple[int, str, str]]:
    """(order, brand, official domain) rows of the brand dimension."""
    return [(i, k, h) for i, (k, _, hosts) in enumerate(lex.brands) for h in hosts]


def brand_of_host(host: Column, suffixes: Column, lex: lx.Lexicon = lx.DEFAULT) -> Column:
    """Owner of the host's official domain, else the first brand whose name is inside the host.

    The brand list is a constant of the plan; only official domains that are a
    suffix of the host are looked at, in brand order.
    """
    owners: dict[str, str] = {}
    for _, k, h in official_pairs(lex):
        owners.setdefault(h, k)
    names = [k for k, _, _ in lex.brands]
    owned = F.transform(F.array_intersect(str_array(owners), suffixes), lambda d: F.try_element_at(array_map(
        {h: [k] for h, k in owners.items()}), d)[0])
    first_owner = F.get(F.array_intersect(str_array(names), owned), F.lit(0))
    inside = F.get(F.filter(str_array(names), lambda k: F.contains(host, k)), F.lit(0))
    return F.coalesce(first_owner, inside)


def is_official(suffixes: Column, brand: Column, lex: lx.Lexicon = lx.DEFAULT) -> Column:
    official = array_map({k: hosts for k, _, hosts in lex.brands if hosts})
    return F.coalesce(F.arrays_overlap(F.try_element_at(official, brand), suffixes), F.lit(False))


def official_owners(hosts: DataFrame, lex: lx.Lexicon = lx.DEFAULT, host: str = "host") -> DataFrame:
    """(host, brand) for every host on an official domain of a brand: an equi-join on exploded suffixes.

    The broadcast side is the brand dimension (about a hundred rows by construction).
    """
    dim = hosts.sparkSession.createDataFrame([(k, h) for _, k, h in official_pairs(lex)], "brand string, entry string")
    keyed = unnest(hosts, uf.suffixes_of(F.col(host)), host, item="entry")
    return keyed.join(F.broadcast(dim), "entry").select(host, "brand").distinct()


def brand_impersonation(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT, compat: bool = False) -> DataFrame:
    """``impersonation``: claimed brand x non-official host pairs that invoke the brand.

    ``compat`` leaves the list empty, as a run in which brand and URL analysis
    happen side by side does.
    """
    hosts = F.filter("url_facts", lambda u: u["host"] != "")

    def judge(u, brand):
        official = is_official(u["suffixes"], brand, lex)
        invoked = u["host_brand"] == brand
        return F.when(~official & invoked, F.lit("brand_lookalike_host")).when(
            ~official & F.contains(u["host"], brand), F.lit("brand_mention_in_host"))

    named = F.transform(hosts, lambda u: F.struct(
        u["host"].alias("host"), u["suffixes"].alias("suffixes"), brand_of_host(u["host"], u["suffixes"], lex).alias("host_brand")))
    pairs = F.flatten(let(lambda x: F.transform(F.array_distinct(x["keys"]), lambda b: F.transform(
        x["hosts"], lambda u: F.struct(b.alias("brand"), u["host"].alias("host"), judge(u, b).alias("signal")))),
        keys="brands.key", hosts="_hosts"))
    hit = F.filter(pairs, lambda p: p["signal"].isNotNull())
    if compat:
        hit = F.filter(hit, lambda _: F.lit(False))
    needed = (F.size("brands") > 0) & (F.size("url_facts") > 0)
    df = df.withColumn("_hosts", F.when(needed, named).otherwise(F.filter(named, lambda _: F.lit(False))))
    df = df.withColumn("impersonation", F.when(needed, hit).otherwise(F.filter(hit, lambda _: F.lit(False)))).drop("_hosts")
    return df.withColumn("brand_notes", F.concat_ws("; ", F.array_compact(F.array(
        F.when((F.size("brands") > 0) & (F.size("impersonation") == 0), "Organizations are named, but no other host backs up an impersonation."),
        F.when(F.size("brands") == 0, "No well-known organization is named."),
    ))))


def impersonation_evidence() -> Column:
    strong = lambda p: p["signal"] == "brand_lookalike_host"
    return F.transform("impersonation", lambda p: evidence(
        "entity_analysis", p["signal"], F.when(strong(p), "high").otherwise("medium"),
        F.when(strong(p), 0.8).otherwise(0.6),
        F.concat(F.lit("Host '"), p["host"], F.when(strong(p), "' presents itself as '").otherwise("' carries the name '"),
                 p["brand"], F.lit("' outside its official domains.")),
        hostname=p["host"], claimed_brand=p["brand"]))


def fuzzy_brand(df: DataFrame, name: str = "name", lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """``brand``: exact name, alias, else the nearest brand within two edits (the last of the best)."""
    low = F.lower(normalize(F.col(name)))
    keys = [k for k, _, _ in lex.brands]
    alias = array_map({a: [k] for a, k in dict(lex.aliases).items()})
    near = F.filter(
        F.transform(str_array(keys), lambda k, i: F.struct(
            F.levenshtein(F.col("_low"), k, 2).alias("d"), (-i).alias("back"), k.alias("key"))),
        lambda c: c["d"] >= 0,
    )
    return (
        df.withColumn("_low", low)
        .withColumn("brand", F.when(F.col("_low").isin(keys), F.col("_low")).otherwise(
            F.coalesce(F.get(F.try_element_at(alias, F.col("_low")), F.lit(0)), F.get(F.array_sort(near), F.lit(0))["key"])))
        .drop("_low")
    )
