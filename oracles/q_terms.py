"""Queries for term and name tables of any size: the lexicon as tables, and tables of many terms taken from the documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from lureframe import lexicon as lx
from lureframe.functions.bind import unnest
from lureframe.operators import terms

from . import ctes as c
from .registry import joined, register, stages

q = c.query


def lower_bodies(spark, d):
    return stages(spark, d).body.select("msg_id", F.lower("body").alias("lower_body"))


@register("t1_phrases_by_table", q(" UNION ALL ".join(
    f"SELECT msg_id, {c.s(g)} AS phrase_group, array_to_string({c.found_in(ps, 'hits')}, '|') AS phrases FROM hits WHERE len({c.found_in(ps, 'hits')}) > 0"
    for g, ps in lx.PHRASE_GROUPS.items()), "hits"))
def t1_by_table(spark, d):
    dim = spark.createDataFrame([(g, i, p) for g, ps in lx.PHRASE_GROUPS.items() for i, p in enumerate(ps)], "phrase_group string, ord int, term string")
    return terms.phrases_by_table(lower_bodies(spark, d), dim).select("msg_id", "phrase_group", joined("phrases").alias("phrases"))


@register("r1_rules_by_table", q("SELECT msg_id, id AS rule_id, array_to_string(kws, '|') AS keywords FROM raw_matches WHERE len(kws) > 0", "raw_matches"))
def r1_by_table(spark, d):
    dim = spark.createDataFrame([(r.id, i, k) for r in lx.RULES for i, k in enumerate(r.keywords)], "rule_id string, ord int, term string")
    return terms.rules_by_table(lower_bodies(spark, d), dim).select("msg_id", "rule_id", joined("keywords").alias("keywords"))


@register("e8_brands_by_table", q("SELECT msg_id, unnest(keys) AS brand FROM bnames", "bnames"))
def e8_by_table(spark, d):
    dim = spark.createDataFrame([(k, kind) for k, kind, _ in lx.BRANDS], "term string, kind string")
    return terms.brands_by_table(lower_bodies(spark, d), dim).select("msg_id", F.col("term").alias("brand"))


#: Every fifth pair of neighbouring words of every document is a term.
PAIR_TERMS = """SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS term FROM (SELECT ws, unnest(range(1, len(ws), 5)) AS i FROM (
 SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents) WHERE len(ws) > 1)"""


def pair_terms(spark, d):
    words = stages(spark, d).table("documents").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("ws")).where(F.size("ws") > 1)
    at = words.select("ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1, F.lit(5))).alias("i"))
    return at.select(F.concat_ws(" ", F.get("ws", F.col("i") - 1), F.get("ws", F.col("i"))).alias("term")).distinct()


@register("t1_many_terms", q(f"""SELECT msg_id, count(*) AS n, md5(string_agg(term, '|' ORDER BY term)) AS terms_md5 FROM (
 SELECT DISTINCT msg_id, toks[i] || ' ' || toks[i + 1] AS term FROM (SELECT msg_id, toks, seps, unnest(range(1, len(toks))) AS i FROM (
 SELECT msg_id, regexp_extract_all(lower(body), '[a-z0-9]+') AS toks, regexp_split_to_array(lower(body), '[a-z0-9]+') AS seps FROM acc) WHERE len(toks) > 1) WHERE seps[i + 1] = ' ')
 SEMI JOIN ({PAIR_TERMS}) USING (term) GROUP BY msg_id""", "acc"))
def t1_many(spark, d):
    """Some ten thousand terms at sf0.01, some hundred thousand at sf0.1, against all messages."""
    found = terms.find_terms(lower_bodies(spark, d), pair_terms(spark, d))
    return found.groupBy("msg_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), "|")).alias("terms_md5"))


@register("u8_fuzzy_by_table", q(f"""SELECT name, coalesce(exact, alias, (SELECT arg_min(key, dist * 1000 - ord) FROM (SELECT o.key, o.ord, levenshtein(name, o.key) AS dist FROM official o) WHERE dist <= 2)) AS brand FROM (
 SELECT name, CASE WHEN list_contains({c.lst(k for k, _, _ in lx.BRANDS)}, name) THEN name END AS exact,
 CASE name {' '.join(f"WHEN {c.s(a)} THEN {c.s(k)}" for a, k in dict(lx.BRAND_ALIASES).items())} END AS alias
 FROM (SELECT DISTINCT unnest(regexp_split_to_array(host, '[.-]')) AS name FROM u2) WHERE name <> '')""", "u2", "official"))
def u8_by_table(spark, d):
    names = unnest(stages(spark, d).host_rows, F.split("host", "[.-]"), item="name").select("name").where("name <> ''").distinct()
    brands = spark.createDataFrame([(k, i) for i, (k, _, _) in enumerate(lx.BRANDS)], "key string, ord int")
    aliases = spark.createDataFrame(list(dict(lx.BRAND_ALIASES).items()), "alias string, key string")
    return terms.fuzzy_brand_by_table(names, brands, aliases).select("name", "brand")


@register("u8_nearest_of_many", """WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS name FROM conversations),
 brands AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS key FROM benchmark)
 SELECT name, arg_min(key, levenshtein(name, key) * 10000000000 - CAST('0x' || substr(md5(key), 1, 8) AS BIGINT)) AS brand FROM names, brands
 WHERE abs(length(name) - length(key)) <= 2 AND levenshtein(name, key) <= 2 GROUP BY name""")
def u8_many(spark, d):
    """Every word of the conversations against the words of the benchmark, as a table of names."""
    def words(t, name):
        return unnest(stages(spark, d).table(t), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)), item=name).select(name).distinct()

    brands = words("benchmark", "key").withColumn("ord", F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long"))
    return terms.nearest_name(words("conversations", "name"), brands)
