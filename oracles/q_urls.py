"""Queries for URL analysis and reputation."""
from __future__ import annotations

from pyspark.sql import functions as F

from lureframe import lexicon as lx
from lureframe.functions.bind import unnest
from lureframe.functions import urls as uf
from lureframe.operators import reputation as rep, urls

from . import ctes as c
from .registry import joined, n, register, stages

q = c.query
DIST = ("uf",)


@register("u1_parse_urls", q("SELECT raw_url, url, host, path, array_to_string(params, '|') AS params, is_https, CAST(url_length AS BIGINT) AS url_length FROM uf", *DIST))
def u1(spark, d):
    return stages(spark, d).url_table.select("raw_url", "url", "host", "path", joined("params").alias("params"), "is_https", n(F.col("url_length")).alias("url_length"))


@register("u2_registrable_domain", q("SELECT DISTINCT host, domain, tld FROM uf", *DIST))
def u2(spark, d):
    return stages(spark, d).url_table.select("host", "domain", "tld").distinct()


@register("u3_url_flags", q("SELECT raw_url, array_to_string(signals, '|') AS signals, array_to_string(keywords, '|') AS keywords, array_to_string(symbols, '|') AS symbols, CAST(special_chars AS BIGINT) AS special_chars FROM uf", *DIST))
def u3(spark, d):
    return stages(spark, d).url_table.select("raw_url", joined("signals").alias("signals"), joined("keywords").alias("keywords"),
                                             joined("symbols").alias("symbols"), n(F.col("special_chars")).alias("special_chars"))


@register("u4_url_risk", q("SELECT raw_url, risk FROM uf", *DIST))
def u4(spark, d):
    return stages(spark, d).url_table.select("raw_url", "risk")


@register("u5_brand_lookalike_hosts", q("SELECT DISTINCT host, lookalike FROM uf", *DIST))
def u5(spark, d):
    return stages(spark, d).url_table.select("host", "lookalike").distinct()


@register("u6_official_host", q("SELECT DISTINCT h.host, o.key AS brand FROM (SELECT DISTINCT host, suffixes FROM u2) h JOIN official o ON list_has_any(h.suffixes, o.hosts)", "u2", "official"))
def u6(spark, d):
    return urls.official_owners(stages(spark, d).host_rows.select("host").distinct())


@register("u7_brand_for_host", q("""SELECT host, coalesce((SELECT arg_min(o2.key, o2.ord) FROM official o2 WHERE list_has_any(u.suffixes, o2.hosts)), (SELECT arg_min(o3.key, o3.ord) FROM official o3 WHERE contains(u.host, o3.key))) AS brand
 FROM (SELECT DISTINCT host, suffixes FROM u2) u""", "u2", "official"))
def u7(spark, d):
    hosts = stages(spark, d).host_rows.select("host").distinct()
    return hosts.select("host", urls.brand_of_host(F.col("host"), uf.suffixes_of(F.col("host"))).alias("brand"))


@register("u8_fuzzy_brand", q(f"""SELECT name, coalesce(exact, alias, (SELECT arg_min(key, dist * 1000 - ord) FROM (SELECT o.key, o.ord, levenshtein(name, o.key) AS dist FROM official o) WHERE dist <= 2)) AS brand FROM (
 SELECT name, CASE WHEN list_contains({c.lst(k for k, _, _ in lx.BRANDS)}, name) THEN name END AS exact,
 CASE name {' '.join(f"WHEN {c.s(a)} THEN {c.s(k)}" for a, k in dict(lx.BRAND_ALIASES).items())} END AS alias
 FROM (SELECT DISTINCT unnest(regexp_split_to_array(host, '[.-]')) AS name FROM u2) WHERE name <> '')""", "u2", "official"))
def u8(spark, d):
    names = unnest(stages(spark, d).host_rows, F.split("host", "[.-]"), item="name").select("name").where("name <> ''").distinct()
    return urls.fuzzy_brand(names).select("name", "brand")


@register("u9_url_evidence", q("SELECT msg_id, CAST(i AS BIGINT) AS ord, signal, severity, round(confidence, 6) AS confidence FROM uev", "uev"))
def u9(spark, d):
    df = unnest(stages(spark, d).urls, urls.url_evidence(), "msg_id")
    return df.select("msg_id", n(F.col("ord")).alias("ord"), "signal", "severity", F.round("confidence", 6).alias("confidence"))


@register("u10_brand_impersonation", q("SELECT msg_id, key AS brand, host, signal FROM imp", "imp"))
def u10(spark, d):
    return unnest(stages(spark, d).impersonated, "impersonation", "msg_id").drop("ord")


LABEL = "[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?"


@register("i1_lookupable_urls", q(f"""SELECT raw_url, coalesce(length(u) BETWEEN 1 AND 2000 AND NOT regexp_matches(u, '\\s') AND regexp_matches(lower(u), '^https?://') AND host <> ''
 AND (is_ip OR regexp_matches(host, '^{LABEL}(\\.{LABEL})+$')), FALSE) AS lookupable FROM (SELECT raw_url, {c.trim('raw_url')} AS u, host, is_ip FROM u2)""", "u2"))
def i1(spark, d):
    return rep.split_lookupable(stages(spark, d).url_table, "raw_url").select("raw_url", "lookupable")


HOST_ROWS = ("SELECT m.msg_id * 100 + m.ord AS url_id, m.host, m.suffixes FROM mu m")
PAGE_HOSTS = "SELECT page_id, url, lower(split_part(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':', 1)) AS host FROM pages"


@register("i2_blocklist_join", q(f"""SELECT url_id, host, CASE WHEN listed THEN 'suspicious' ELSE 'unknown' END AS verdict, CASE WHEN listed THEN 0.85e0 ELSE 0e0 END AS risk_score, CAST(listed AS BIGINT) AS hits
 FROM (SELECT url_id, host, list_has_any(suffixes, (SELECT list(entry) FROM feed)) AS listed FROM hr)""", "mu",
    extra={"hr": HOST_ROWS, "feed": f"SELECT DISTINCT host AS entry FROM ({PAGE_HOSTS}) WHERE page_id % 5 = 0 UNION SELECT unnest({c.lst(lx.DEMO_BLOCKLIST)})"}))
def i2(spark, d):
    st = stages(spark, d)
    feed = st.page_hosts.where("page_id % 5 = 0").select(F.col("host").alias("entry"), F.lit("listed").alias("category"))
    demo = spark.createDataFrame([(h, "demo_blocklist") for h in lx.DEMO_BLOCKLIST], "entry string, category string")
    out = rep.blocklist_join(st.host_rows, feed.unionByName(demo))
    return out.select("url_id", "host", "verdict", "risk_score", n(F.col("hits")).alias("hits"))


@register("i3_threatlist_verdicts", q(f"""SELECT h.url_id, h.host, CASE WHEN t.n IS NULL THEN 'safe' ELSE 'malicious' END AS verdict, CASE WHEN t.n IS NULL THEN 0.05e0 ELSE 0.95e0 END AS risk_score,
 coalesce(t.cats, '') AS categories, CAST(coalesce(t.n, 0) AS BIGINT) AS hits FROM hr h LEFT JOIN (SELECT host, array_to_string(list(DISTINCT threat ORDER BY threat), '|') AS cats, count(*) AS n FROM (
 SELECT host, CASE page_id % 3 WHEN 0 THEN 'MALWARE' WHEN 1 THEN 'SOCIAL_ENGINEERING' ELSE 'UNWANTED_SOFTWARE' END AS threat FROM ({PAGE_HOSTS}) WHERE page_id % 4 < 3) GROUP BY host) t USING (host)""", "mu", extra={"hr": HOST_ROWS}))
def i3(spark, d):
    st = stages(spark, d)
    kind = F.when(F.col("page_id") % 3 == 0, "MALWARE").when(F.col("page_id") % 3 == 1, "SOCIAL_ENGINEERING").otherwise("UNWANTED_SOFTWARE")
    found = st.page_hosts.where("page_id % 4 < 3").select("host", kind.alias("threat_type"))
    out = rep.threatlist_verdicts(st.host_rows, found)
    return out.select("url_id", "host", "verdict", "risk_score", joined("categories").alias("categories"), n(F.col("hits")).alias("hits"))


@register("i4_engine_stats_verdicts", q(f"""SELECT url_id, host, CASE WHEN mal IS NULL THEN 'unknown' WHEN mal >= 2 THEN 'malicious' WHEN mal >= 1 OR sus >= 1 THEN 'suspicious' ELSE 'safe' END AS verdict,
 CASE WHEN mal IS NULL THEN 0.1e0 ELSE {c.rnd('least(0.98e0, CASE WHEN mal >= 1 OR sus >= 2 THEN 0.5e0 + 0.08e0 * least(mal + sus, 6) WHEN mal + sus = 1 THEN 0.45e0 ELSE 0.1e0 END)', 2)} END AS risk_score, CAST(coalesce(mal + sus, 0) AS BIGINT) AS hits
 FROM hr LEFT JOIN (SELECT host, max(page_id % 4) AS mal, max(page_id % 3) AS sus FROM ({PAGE_HOSTS}) WHERE page_id % 2 = 0 GROUP BY host) st USING (host)""", "mu", extra={"hr": HOST_ROWS}))
def i4(spark, d):
    st = stages(spark, d)
    i = F.col("page_id")
    stats = st.page_hosts.where("page_id % 2 = 0").select("host", (i % 4).alias("malicious"), (i % 3).alias("suspicious"), F.lit(60).alias("harmless"), F.lit(10).alias("undetected"))
    out = rep.engine_stats_verdicts(st.host_rows, stats)
    return out.select("url_id", "host", "verdict", "risk_score", n(F.col("hits")).alias("hits"))


@register("i5_provider_status", """SELECT event_id, CAST(http AS BIGINT) AS http, CASE WHEN http = 429 THEN 'rate_limited' WHEN http BETWEEN 500 AND 599 THEN 'unavailable' ELSE 'error' END AS status
 FROM (SELECT event_id, 400 + event_id % 250 AS http FROM events)""")
def i5(spark, d):
    http = F.col("event_id") % 250 + 400
    return stages(spark, d).table("events").select("event_id", http.alias("http"), rep.provider_status(http).alias("status"))


@register("i6_url_lookup_key", "SELECT page_id, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') AS lookup_key FROM pages")
def i6(spark, d):
    return stages(spark, d).table("pages").select("page_id", uf.lookup_key(F.col("url")).alias("lookup_key"))


RESULTS_SQL = f"""SELECT url, page_id * 3 AS provider_ord, 'p1' AS provider, CASE WHEN page_id % 5 = 0 THEN 'malicious' WHEN page_id % 5 = 1 THEN 'safe' ELSE 'unknown' END AS verdict,
 CASE WHEN page_id % 5 IN (0, 1) THEN 'ok' WHEN page_id % 2 = 0 THEN 'error' ELSE 'rate_limited' END AS status, CASE page_id % 5 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.05e0 ELSE 0e0 END AS risk_score, CASE WHEN page_id % 5 = 0 THEN 'A|B' ELSE '' END AS cats, page_id % 3 AS hits FROM pages
 UNION ALL SELECT url, page_id * 3 + 1, 'p2', CASE WHEN page_id % 3 = 0 THEN 'suspicious' ELSE 'unknown' END, CASE WHEN page_id % 3 = 0 THEN 'ok' WHEN page_id % 3 = 1 THEN 'unavailable' ELSE 'ok' END, CASE WHEN page_id % 3 = 0 THEN 0.85e0 ELSE 0e0 END, CASE WHEN page_id % 3 = 0 THEN 'B|C' ELSE '' END, page_id % 2 FROM pages
 UNION ALL SELECT url, page_id * 3 + 2, 'p3', CASE WHEN page_id % 4 = 0 THEN 'suspicious' ELSE 'safe' END, 'ok', CASE WHEN page_id % 4 = 0 THEN 0.85e0 ELSE 0.1e0 END, CASE WHEN page_id % 4 = 0 THEN 'D' ELSE '' END, 0 FROM pages WHERE page_id % 2 = 0"""
VR = "CASE verdict WHEN 'safe' THEN 0 WHEN 'suspicious' THEN 2 WHEN 'malicious' THEN 3 ELSE 1 END"
SR = "CASE status WHEN 'ok' THEN 0 WHEN 'unavailable' THEN 2 WHEN 'rate_limited' THEN 3 ELSE 1 END"


@register("i7_merge_verdicts", q(f"""SELECT url, provider, verdict, status, risk_score, hits, array_to_string(list_filter(cl, lambda x, i: list_position(cl, x) = i), '|') AS categories FROM merged""", extra={"results": RESULTS_SQL, "merged": f"""SELECT url, provider, verdict, status, risk_score, hits, list_filter(string_split(cj, '|'), lambda x: x <> '') AS cl FROM (SELECT url, array_to_string(list(provider ORDER BY provider_ord), '+') AS provider, arg_max(verdict, {{'v': {VR}, 'r': risk_score, 'o': -provider_ord}}) AS verdict,
 CASE WHEN bool_or(status = 'ok' AND verdict <> 'unknown') THEN 'ok' ELSE coalesce(arg_max(status, {SR}) FILTER (WHERE status <> 'ok'), 'ok') END AS status,
 {c.rnd(f"arg_max(risk_score, {{'v': {VR}, 'r': risk_score, 'o': -provider_ord}})", 2)} AS risk_score, CAST(sum(hits) AS BIGINT) AS hits,
 array_to_string(list(cats ORDER BY provider_ord), '|') AS cj FROM results GROUP BY url)"""}))
def i7(spark, d):
    p = stages(spark, d).table("pages").select("page_id", "url")
    i = F.col("page_id")
    listed = lambda x: F.filter(F.split(x, r"\|"), lambda v: v != "")
    def provider(k, name, verdict, status, risk, cats, hits, where=None):
        df = p.where(where) if where else p
        return df.select("url", (i * 3 + k).alias("provider_ord"), F.lit(name).alias("provider"), verdict.alias("verdict"), status.alias("status"), risk.alias("risk_score"),
                         listed(cats).alias("categories"), hits.alias("hits"), F.lit(None).cast("string").alias("reputation"), F.lit(None).cast("string").alias("error"),
                         F.lit(None).cast("timestamp").alias("checked_at"), F.lit(False).alias("is_mock"))
    m5, m3, m4 = i % 5, i % 3, i % 4
    res = provider(0, "p1", F.when(m5 == 0, "malicious").when(m5 == 1, "safe").otherwise("unknown"), F.when(m5.isin(0, 1), "ok").when(i % 2 == 0, "error").otherwise("rate_limited"),
                   F.when(m5 == 0, 0.95).when(m5 == 1, 0.05).otherwise(0.0), F.when(m5 == 0, "A|B").otherwise(""), i % 3)
    res = res.unionByName(provider(1, "p2", F.when(m3 == 0, "suspicious").otherwise("unknown"), F.when(m3 == 1, "unavailable").otherwise("ok"), F.when(m3 == 0, 0.85).otherwise(0.0),
                                   F.when(m3 == 0, "B|C").otherwise(""), i % 2))
    res = res.unionByName(provider(2, "p3", F.when(m4 == 0, "suspicious").otherwise("safe"), F.lit("ok"), F.when(m4 == 0, 0.85).otherwise(0.1), F.when(m4 == 0, "D").otherwise(""),
                                   F.lit(0).cast("bigint"), "page_id % 2 = 0"))
    out = rep.merge_verdicts(res)
    return out.select("url", "provider", "verdict", "status", "risk_score", n(F.col("hits")).alias("hits"), joined("categories").alias("categories"))


@register("i8_intel_evidence", q("SELECT msg_id, CAST(ord AS BIGINT) AS ord, 'threat_intel_' || verdict AS signal, CASE WHEN verdict = 'suspicious' THEN 'high' ELSE 'info' END AS severity, round(least(0.95e0, 0.3e0 + risk_score), 6) AS confidence FROM intel", "intel"))
def i8(spark, d):
    df = unnest(rep.attach_reputation(stages(spark, d).urls, None), rep.intel_evidence(), "msg_id")
    return df.select("msg_id", n(F.col("ord")).alias("ord"), "signal", "severity", F.round("confidence", 6).alias("confidence"))


@register("i8_reputation_feed", q(f"""SELECT m.msg_id, CAST(m.ord AS BIGINT) AS ord, coalesce(f.verdict, 'unknown') AS verdict, coalesce(f.risk_score, 0e0) AS risk_score
 FROM mu m LEFT JOIN feed f ON m.host = f.entry""", "mu", extra={"feed": f"SELECT host AS entry, 'malicious' AS verdict, 0.95e0 AS risk_score FROM ({PAGE_HOSTS}) WHERE page_id % 5 = 0 GROUP BY host"}))
def i8_feed(spark, d):
    st = stages(spark, d)
    feed = st.page_hosts.where("page_id % 5 = 0").select(
        F.col("host").alias("entry"), F.lit("malicious").alias("verdict"), F.lit("ok").alias("status"), F.lit(0.95).alias("risk_score"),
        F.lit(False).alias("is_mock"), F.lit("feed").alias("provider"), F.lit("listed").alias("reputation")).distinct()
    df = unnest(rep.attach_reputation(st.urls.select("msg_id", "url_facts"), feed), "intel", "msg_id")
    return df.select("msg_id", n(F.col("ord")).alias("ord"), "verdict", "risk_score")


@register("i9_severity_from_score", q("SELECT raw_url, risk, CASE WHEN risk >= 0.7e0 THEN 'critical' WHEN risk >= 0.45e0 THEN 'high' WHEN risk >= 0.2e0 THEN 'medium' ELSE 'low' END AS severity FROM uf", *DIST))
def i9(spark, d):
    return stages(spark, d).url_table.select("raw_url", "risk", rep.severity_from_score(F.col("risk")).alias("severity"))
