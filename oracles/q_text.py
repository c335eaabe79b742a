"""Queries for ingest, entities, signals and rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from lureframe import lexicon as lx
from lureframe.functions import text as tx
from lureframe.functions.bind import let, unnest
from lureframe.operators import entities as en, ingest, rules, signals

from . import ctes as c
from .registry import joined, n, register, stages

q = c.query


@register("p1_normalize_text", q(f"SELECT msg_id, md5({c.norm('text')}) AS body_md5, CAST(length({c.norm('text')}) AS BIGINT) AS n_chars FROM messages", "messages"))
def p1(spark, d):
    body = tx.normalize(F.col("text"))
    return stages(spark, d).messages.select("msg_id", F.md5(body).alias("body_md5"), n(F.length(body)).alias("n_chars"))


@register("p2_derive_title", q(f"""SELECT msg_id, CASE WHEN coalesce(title, '') <> '' THEN title[1:255] WHEN t = '' THEN 'Untitled investigation'
 WHEN length(t) > 60 THEN t[1:59] || '…' ELSE t END AS title FROM (SELECT *, {c.norm('text')} AS t FROM messages)""", "messages"))
def p2(spark, d):
    return stages(spark, d).messages.select("msg_id", tx.derive_title(F.col("title"), F.col("text")).alias("title"))


@register("p3_fingerprint", q(f"""SELECT msg_id, CASE WHEN {c.trim("coalesce(text, '')")} <> '' THEN md5({c.trim('text')}) END AS fingerprint,
 CASE WHEN t = '' THEN NULL WHEN length(t) > 1000 THEN t[1:999] || '…' ELSE t END AS preview FROM (SELECT *, {c.norm('text')} AS t FROM messages)""", "messages"))
def p3(spark, d):
    return stages(spark, d).messages.select("msg_id", tx.fingerprint(F.col("text")).alias("fingerprint"), tx.preview(F.col("text")).alias("preview"))


@register("p4_validate_submissions", q(f"""SELECT msg_id, coalesce(reject_reason, 'accepted') AS outcome, CAST(len(urls) AS BIGINT) AS n_urls,
 array_to_string({c.LIMIT_FLAGS}, '|') AS limit_flags FROM checked""", "checked"))
def p4(spark, d):
    checked = ingest.validate_submissions(stages(spark, d).messages, **c.FORM_LIMITS)
    return checked.select("msg_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"), n(F.size("urls")).alias("n_urls"),
                          joined("limit_flags").alias("limit_flags"))


@register("p5_input_types", q("SELECT msg_id, array_to_string(list_filter([CASE WHEN body <> '' THEN 'text' END, CASE WHEN len(urls) > 0 THEN 'url' END], lambda x: x IS NOT NULL), '|') AS input_types FROM acc", "acc"))
def p5(spark, d):
    return stages(spark, d).body.select("msg_id", joined("input_types").alias("input_types"))


@register("p6_combine_text", f"""SELECT conv_id, turn, md5(b) AS body_md5, CAST(length(b) AS BIGINT) AS n_chars FROM (
 SELECT conv_id, turn, {c.trim(c.norm('c.text') + " || chr(10) || " + c.norm('b.text'))} AS b FROM conversations c LEFT JOIN benchmark b ON c.conv_id = b.item_id)""")
def p6(spark, d):
    st = stages(spark, d)
    ocr = st.table("benchmark").select(F.col("item_id").alias("conv_id"), F.col("text").alias("ocr_text"))
    rows = st.table("conversations").select("conv_id", "turn", "text").join(ocr, "conv_id", "left")
    return ingest.combine_text(rows).select("conv_id", "turn", F.md5("body").alias("body_md5"), n(F.length("body")).alias("n_chars"))


@register("p7_merge_explicit_urls", q("SELECT msg_id, array_to_string(all_urls, '|') AS all_urls, CAST(len(found) AS BIGINT) AS n_found FROM urls1", "urls1"))
def p7(spark, d):
    df = en.merge_explicit_urls(en.extract_urls(stages(spark, d).body))
    return df.select("msg_id", joined("all_urls").alias("all_urls"), n(F.size("found_urls")).alias("n_found"))


@register("e1_extract_urls", q("SELECT msg_id, unnest(found) AS url, CAST(generate_subscripts(found, 1) - 1 AS BIGINT) AS ord FROM urls0", "urls0"))
def e1(spark, d):
    df = en.extract_urls(stages(spark, d).body)
    return unnest(df, "found_urls", "msg_id", item="url").select("msg_id", "url", n(F.col("ord")).alias("ord"))


@register("e2_extract_emails", q("SELECT msg_id, unnest(emails) AS email, CAST(generate_subscripts(emails, 1) - 1 AS BIGINT) AS ord FROM emails", "emails"))
def e2(spark, d):
    df = en.extract_emails(stages(spark, d).body)
    return unnest(df, "emails", "msg_id", item="email").select("msg_id", "email", n(F.col("ord")).alias("ord"))


@register("e3_extract_phones", q("SELECT msg_id, value, context FROM phones", "phones"))
def e3(spark, d):
    return unnest(en.extract_phones(stages(spark, d).body), "phones", "msg_id").drop("ord")


@register("e4_extract_amounts", q("SELECT msg_id, a AS amount, regexp_replace(a, '[,\\s]', '', 'g') AS normalized, ord FROM (SELECT msg_id, unnest(amounts) AS a, CAST(generate_subscripts(amounts, 1) - 1 AS BIGINT) AS ord FROM amounts)", "amounts"))
def e4(spark, d):
    df = en.extract_amounts(stages(spark, d).body)
    return unnest(df, "amounts", "msg_id").select(
        "msg_id", F.col("value").alias("amount"), "normalized", n(F.col("ord")).alias("ord"))


@register("e5_extract_dates", q("SELECT msg_id, unnest(dates) AS date_text, CAST(generate_subscripts(dates, 1) - 1 AS BIGINT) AS ord FROM dates", "dates"))
def e5(spark, d):
    df = en.extract_dates(stages(spark, d).body)
    return unnest(df, "dates", "msg_id", item="date_text").select("msg_id", "date_text", n(F.col("ord")).alias("ord"))


@register("e6_extract_codes", q("SELECT msg_id, value, context FROM codes", "codes"))
def e6(spark, d):
    return unnest(en.extract_codes(stages(spark, d).body), "codes", "msg_id").drop("ord")


ORACLE_BUCKETS = ["urls", "emails", "phones", "companies", "banks", "organizations", "amounts", "dates"]


@register("e7_entity_counts", q("""SELECT * FROM (SELECT msg_id, 'urls' AS bucket, CAST(len(all_urls) AS BIGINT) AS n FROM urls1 UNION ALL SELECT msg_id, 'emails', len(emails) FROM emails
 UNION ALL SELECT msg_id, 'amounts', len(amounts) FROM amounts UNION ALL SELECT msg_id, 'dates', len(dates) FROM dates UNION ALL SELECT msg_id, 'phones', count(*) FROM phones GROUP BY msg_id
 UNION ALL SELECT msg_id, bucket, count(*) FROM brands GROUP BY ALL) WHERE n > 0""", "urls1", "emails", "phones", "amounts", "dates", "brands"))
def e7(spark, d):
    counts = en.entity_counts(stages(spark, d).entities)
    return counts.where(F.col("bucket").isin(ORACLE_BUCKETS) & (F.col("n") > 0)).select("msg_id", "bucket", n(F.col("n")).alias("n"))


@register("e7_extract_all", q("""SELECT msg_id, 'urls' AS bucket, 'url' AS entity_type, unnest(all_urls) AS value FROM urls1 UNION ALL SELECT msg_id, 'emails', 'email', unnest(emails) FROM emails
 UNION ALL SELECT msg_id, 'phones', 'phone', value FROM phones UNION ALL SELECT msg_id, bucket, kind, value FROM brands UNION ALL SELECT msg_id, 'amounts', 'amount', unnest(amounts) FROM amounts
 UNION ALL SELECT msg_id, 'dates', 'date', unnest(dates) FROM dates UNION ALL SELECT msg_id, 'other', 'code', value FROM codes""", "urls1", "emails", "phones", "brands", "amounts", "dates", "codes"))
def e7_all(spark, d):
    return en.entities_long(stages(spark, d).entities).select("msg_id", "bucket", "entity_type", "value")


@register("e8_extract_brands", q("SELECT msg_id, key AS brand, kind, bucket, value FROM brands", "brands"))
def e8(spark, d):
    df = en.extract_brands(stages(spark, d).scanned)
    return unnest(df, "brands", "msg_id").drop("ord").select("msg_id", F.col("key").alias("brand"), "kind", "bucket", "value")


def _clean_sql() -> str:
    x = "text"
    for old, new in [("[.]", "."), ("(.)", "."), ("{.}", "."), ("hxxp://", "http://"), ("hxxps://", "https://"), ("http ://", "http://"),
                     ("https ://", "https://"), ("http:// ", "http://"), ("https:// ", "https://")]:
        x = f"replace({x}, {c.s(old)}, {c.s(new)})"
    return x


@register("e9_deobfuscate_urls", q(f"""SELECT msg_id, u AS url FROM (SELECT msg_id, regexp_replace(regexp_extract(t, {c.s(c.URL_RX)}), '[.,;:!?]+$', '') AS u, lower(t) AS l
 FROM (SELECT msg_id, {_clean_sql()} AS t FROM messages)) WHERE (contains(l, 'http://') OR contains(l, 'https://')) AND u <> ''""", "messages"))
def e9(spark, d):
    df = stages(spark, d).messages.select("msg_id", en.deobfuscate(F.col("text")).alias("url"))
    return df.where("url is not null")


@register("e10_decode_urls", "SELECT page_id, url_decode(url) AS url, url_decode(replace(url, '=', '%3D')) AS again FROM pages")
def e10(spark, d):
    u = F.col("url")
    return stages(spark, d).table("pages").select(
        "page_id", en.decode_url(u).alias("url"), en.decode_url(F.replace(u, F.lit("="), F.lit("%3D"))).alias("again"))


@register("t1_phrase_hits", q(" UNION ALL ".join(
    f"SELECT msg_id, {c.s(g)} AS phrase_group, array_to_string(g_{g}, '|') AS phrases FROM grp WHERE len(g_{g}) > 0" for g in lx.PHRASE_GROUPS), "grp"))
def t1(spark, d):
    df = signals.phrase_hits(signals.scan_terms(stages(spark, d).body))
    rows = F.array(*[F.struct(F.lit(g).alias("phrase_group"), joined(F.col(f"phrases.{g}")).alias("phrases")) for g in lx.PHRASE_GROUPS])
    return unnest(df, F.filter(rows, lambda x: x["phrases"] != ""), "msg_id").drop("ord")


@register("t2_signal_scores", q("SELECT msg_id, urgency_score, fear_threat_score, reward_score, pressure_score FROM sig", "sig"))
def t2(spark, d):
    return stages(spark, d).scanned.select("msg_id", *[f"{g}_score" for g in signals.SCORED])


@register("t3_requestive_intent", q("SELECT msg_id, ask AS requestive FROM pats", "pats"))
def t3(spark, d):
    low = F.lower("body")
    return stages(spark, d).body.select("msg_id", tx.requestive(low, lx.REQUESTIVE_PATTERNS, lx.NEGATIONS, lx.NEGATION_REACH).alias("requestive"))


FLAGS = ["payment_request", "credential_request", "otp_request", "sensitive_request", "instructions", "authority", "protective", "reassurance"]


@register("t4_request_flags", q(f"SELECT msg_id, {', '.join(FLAGS)} FROM sig", "sig"))
def t4(spark, d):
    return stages(spark, d).scanned.select("msg_id", *FLAGS)


@register("t5_language_evidence", q("SELECT msg_id, signal, severity, confidence FROM lang", "lang"))
def t5(spark, d):
    df = unnest(stages(spark, d).scanned, signals.language_evidence(), "msg_id").drop("ord")
    return df.select("msg_id", "signal", "severity", "confidence")


@register("r1_match_rules", q("SELECT msg_id, id AS rule_id, array_to_string(kws, '|') AS keywords, array_to_string(pts, ' ~ ') AS patterns FROM raw_matches", "raw_matches"))
def r1(spark, d):
    df = unnest(rules.rule_hits(stages(spark, d).scanned), "raw_matches", "msg_id").drop("ord")
    return df.select("msg_id", F.col("id").alias("rule_id"), joined("keywords").alias("keywords"), joined("patterns", " ~ ").alias("patterns"))


@register("r2_required_entity_gate", q("SELECT msg_id, id AS rule_id, NOT needs_url OR has_url_entity AS passes FROM raw_matches JOIN gates USING (msg_id)", "raw_matches", "gates"))
def r2(spark, d):
    df = stages(spark, d).matched
    gated = let(lambda x: F.transform(x["raw"], lambda m: F.struct(m["id"].alias("rule_id"), rules.entity_gate(m, x["types"]).alias("passes"))),
                raw="raw_matches", types="entity_types")
    return unnest(df, gated, "msg_id").drop("ord")


@register("r3_request_context_gate", q("SELECT msg_id, request_context FROM gates", "gates"))
def r3(spark, d):
    return stages(spark, d).scanned.select("msg_id", rules.request_context().alias("request_context"))


@register("r4_alarm_suppression", q("SELECT msg_id, alarm_silenced FROM gates", "gates"))
def r4(spark, d):
    return stages(spark, d).scanned.select("msg_id", rules.alarm_silenced().alias("alarm_silenced"))


@register("r5_rule_evidence", q("SELECT msg_id, id AS signal, severity, confidence, array_to_string(kws, ', ') AS keywords, weight FROM matches", "matches"))
def r5(spark, d):
    df = unnest(stages(spark, d).matched, rules.rule_evidence(), "msg_id").drop("ord")
    return df.select("msg_id", "signal", "severity", "confidence", F.col("detail")["matched_keywords"].alias("keywords"), F.col("detail")["weight"].cast("double").alias("weight"))


@register("r6_classify_categories", q("SELECT msg_id, primary_category, array_to_string(alternatives, '|') AS alternatives, round(confidence, 6) AS confidence FROM cls", "cls"))
def r6(spark, d):
    return stages(spark, d).classified.select("msg_id", F.col("primary").alias("primary_category"), joined("alternatives").alias("alternatives"), F.round("class_confidence", 6).alias("confidence"))


@register("r7_is_ambiguous", q("SELECT msg_id, primary_category IN ('unknown', 'other') OR confidence < 0.5e0 AS ambiguous FROM cls", "cls"))
def r7(spark, d):
    return stages(spark, d).classified.select("msg_id", rules.is_ambiguous().alias("ambiguous"))


@register("r8_classify_from_urls", q("SELECT msg_id, 'phishing' AS primary_category, confidence, claim FROM ucls", "ucls"))
def r8(spark, d):
    df = rules.classify_from_urls(stages(spark, d).urls).where("url_class is not null")
    return df.select("msg_id", F.col("url_class.primary").alias("primary_category"), F.col("url_class.confidence").alias("confidence"), F.col("url_class.claim").alias("claim"))


@register("r9_adjudicate_labels", q("""SELECT msg_id, CASE WHEN use_s THEN sug WHEN use_u THEN 'phishing' ELSE primary_category END AS primary_category, rejected,
 CASE WHEN use_s THEN 'hybrid(rules+llm)' WHEN use_u THEN 'url_analysis' ELSE 'rules' END AS method,
 round(CASE WHEN use_s THEN 0.8e0 WHEN use_u THEN uconf ELSE confidence END, 6) AS confidence FROM (
 SELECT *, ambiguous AND sug IS NOT NULL AND NOT rejected AS use_s, ambiguous AND NOT (sug IS NOT NULL AND NOT rejected) AND uconf IS NOT NULL AS use_u FROM (
 SELECT *, ambiguous AND coalesce(sug <> 'unknown', FALSE) AND uconf IS NULL AND NOT proof AS rejected FROM (
 SELECT c.msg_id, c.primary_category, c.confidence, primary_category IN ('unknown', 'other') OR c.confidence < 0.5e0 AS ambiguous, u.confidence AS uconf,
  CASE c.msg_id % 7 WHEN 1 THEN 'phishing' WHEN 2 THEN 'unknown' WHEN 3 THEN 'job_scam' END AS sug,
  m.msg_id IS NOT NULL OR payment_request OR credential_request OR otp_request OR sensitive_request OR instructions AS proof
 FROM cls c JOIN sig USING (msg_id) LEFT JOIN ucls u USING (msg_id) LEFT JOIN (SELECT DISTINCT msg_id FROM matches) m USING (msg_id))))""", "cls", "sig", "ucls", "matches"))
def r9(spark, d):
    from lureframe.plans.triage import refine_stage

    st = stages(spark, d)
    k = F.col("msg_id") % 7
    offered = st.messages.select("msg_id", F.when(k == 1, "phishing").when(k == 2, "unknown").when(k == 3, "job_scam").alias("suggested_category"),
                                 F.lit(0.8).alias("suggested_confidence")).where("suggested_category is not null")
    df = refine_stage(st.impersonated, offered)
    return df.select("msg_id", F.col("primary").alias("primary_category"), F.col("suggestion_rejected").alias("rejected"),
                     F.col("class_method").alias("method"), F.round("class_confidence", 6).alias("confidence"))
