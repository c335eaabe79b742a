"""Queries for features, model, labelled data, correlation and risk."""
from __future__ import annotations

from pyspark.sql import functions as F

from lureframe import lexicon as lx
from lureframe.functions.bind import unnest
from lureframe.operators import datasets as ds, evaluate as ev, model as ml, risk

from . import ctes as c
from .registry import joined, n, register, stages

q = c.query
SHOWN = list(lx.FEATURES)


@register("m1_features", q("SELECT msg_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in SHOWN) + " FROM feat", "feat"))
def m1(spark, d):
    return stages(spark, d).featured.select("msg_id", *[F.round(F.col("features")[f], 6).alias(f) for f in SHOWN])


@register("m2_heuristic_probability", q("SELECT msg_id, probability, label FROM ml", "ml"))
def m2(spark, d):
    return stages(spark, d).predicted.select("msg_id", "probability", F.col("ml_label").alias("label"))


@register("m3_train_classifier")
def m3(spark, d):
    st = stages(spark, d)
    return ev.model_metrics(ml.predict_model(st.training.where("split = 'test'"), st.model))


@register("m4_score_classifier")
def m4(spark, d):
    st = stages(spark, d)
    scored = ml.predict_model(st.training.where("split <> 'train'"), st.model)
    return scored.select("id", "split", "label", "probability", "ml_label")


@register("m4_feature_importance")
def m4_importance(spark, d):
    return ml.feature_importance(spark, stages(spark, d).model)


@register("m5_ml_evidence", q("SELECT msg_id, CASE WHEN probability >= 0.5e0 THEN 'ml_probability_high' ELSE 'ml_probability_low' END AS signal, CASE WHEN probability >= 0.5e0 THEN 'medium' ELSE 'info' END AS severity, round(least(0.9e0, 0.4e0 + probability), 6) AS confidence FROM ml", "ml"))
def m5(spark, d):
    df = unnest(stages(spark, d).predicted, ml.ml_evidence(), "msg_id").drop("ord")
    return df.select("msg_id", "signal", "severity", F.round("confidence", 6).alias("confidence"))


LABELLED = f"""SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || CAST(doc_id % 500 AS VARCHAR) ELSE '' END AS id, {c.trim("CASE WHEN doc_id % 11 = 1 THEN '' ELSE text END")} AS text,
 CASE WHEN doc_id % 22 = 1 THEN 'http://a.example' ELSE '' END AS urls,
 CASE WHEN doc_id % 11 = 2 THEN '' WHEN doc_id % 11 = 3 THEN 'junk' WHEN coalesce(toxic, doc_id % 2) = 1 THEN 'scam' ELSE 'benign' END AS label,
 CASE WHEN doc_id % 11 = 4 THEN 'no_such' WHEN doc_id % 11 = 5 THEN 'phishing' WHEN doc_id % 4 = 0 THEN '' ELSE 'unknown' END AS scam_category, source, lang AS language,
 CASE WHEN doc_id % 11 = 6 THEN 'high' WHEN doc_id % 11 = 7 THEN '1.5' WHEN doc_id % 2 = 0 THEN '0.9' ELSE '' END AS conf FROM documents LEFT JOIN labels USING (doc_id)"""
KNOWN = c.lst(ds.KNOWN_CATEGORIES)
CHECKED = f"""SELECT *, list_filter([CASE WHEN text = '' AND urls = '' THEN 'no content' END, CASE WHEN label = '' THEN 'missing label' WHEN label NOT IN ('scam', 'benign') THEN 'invalid label' END,
 CASE WHEN scam_category <> '' AND NOT list_contains({KNOWN}, scam_category) THEN 'unknown scam_category' WHEN scam_category <> '' AND label = 'benign' AND scam_category NOT IN ('benign', 'unknown', 'other') THEN 'benign row has scam category' END,
 CASE WHEN scam_category = '' AND label = 'scam' THEN 'scam row missing scam_category' END,
 CASE WHEN conf <> '' AND try_cast(conf AS DOUBLE) IS NULL THEN 'annotation_confidence not numeric' WHEN conf <> '' AND NOT try_cast(conf AS DOUBLE) BETWEEN 0 AND 1 THEN 'annotation_confidence out of range' END], lambda x: x IS NOT NULL) AS errors FROM labelled"""
COLLAPSED = f"trim(regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\xA0]+', ' ', 'g'))"
KEPT = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN id <> '' THEN 'id:' || id WHEN {COLLAPSED} <> '' THEN 'text:' || {COLLAPSED} ELSE 'row:' || CAST(ord AS VARCHAR) END ORDER BY ord) AS rn FROM valid) WHERE rn = 1"""
BASE = {"labelled": LABELLED, "row_checks": CHECKED, "valid": "SELECT * FROM row_checks WHERE len(errors) = 0", "kept": KEPT}


@register("d1_validate_dataset", q("SELECT ord, array_to_string(errors, '|') AS errors FROM row_checks", extra=BASE))
def d1(spark, d):
    return stages(spark, d).checked_rows.select("ord", joined("errors").alias("errors"))


@register("d2_contamination_guard", q("SELECT ord, id, CASE WHEN id IN (SELECT 'doc-' || CAST(item_id * 3 AS VARCHAR) FROM benchmark) THEN 'rejected' ELSE 'clean' END AS outcome FROM valid", extra=BASE))
def d2(spark, d):
    st = stages(spark, d)
    ids = st.table("benchmark").select(F.concat(F.lit("doc-"), (F.col("item_id") * 3).cast("string")).alias("id"))
    clean, bad = ds.contamination_guard(st.valid_rows, ids)
    out = lambda df, w: df.select("ord", "id", F.lit(w).alias("outcome"))
    return out(clean, "clean").unionByName(out(bad, "rejected"))


@register("d3_dedup_first", q("SELECT ord, id, label FROM kept", extra=BASE))
def d3(spark, d):
    return ds.dedup_first(stages(spark, d).valid_rows).select("ord", "id", "label")


@register("d4_dataset_stats", q("""SELECT * FROM (SELECT 'label' AS dimension, label AS value, count(*) AS n FROM kept GROUP BY label UNION ALL SELECT 'scam_category', scam_category, count(*) FROM kept GROUP BY scam_category
 UNION ALL SELECT 'language', language, count(*) FROM kept GROUP BY language UNION ALL SELECT 'source', source, count(*) FROM kept GROUP BY source) WHERE value <> ''""", extra=BASE))
def d4(spark, d):
    return ds.dataset_stats(ds.dedup_first(stages(spark, d).valid_rows))


@register("d4_dataset_totals", q("""SELECT (SELECT count(*) FROM labelled) AS total_rows, (SELECT count(*) FROM valid) AS valid_rows, count(*) AS rows_after_dedup, count(*) FILTER (WHERE urls <> '') AS url_present,
 count(*) FILTER (WHERE id <> '') AS id_present, (SELECT count(*) FROM valid) - count(*) AS duplicates_removed FROM kept""", extra=BASE))
def d4_totals(spark, d):
    st = stages(spark, d)
    return ds.dataset_totals(st.labelled, st.valid_rows, ds.dedup_first(st.valid_rows)).drop("malformed_rows")


@register("d5_stratified_split", q("""SELECT ord, label, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM (
 SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42:' || CAST(ord AS VARCHAR)), 1, 15))::BIGINT, ord) AS r,
 ceil(count(*) OVER (PARTITION BY label) * 0.2e0) AS t, ceil(count(*) OVER (PARTITION BY label) * 0.1e0) AS v FROM valid)""", extra=BASE))
def d5(spark, d):
    return ds.stratified_split(stages(spark, d).valid_rows, key="ord").select("ord", "label", "split")


@register("d6_best_threshold", q(f"""SELECT score AS threshold, round(f1, 6) AS f1 FROM (SELECT score, 2e0 * tp / (tp + fp + p) AS f1 FROM (
 SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p FROM (
 SELECT probability AS score, count(*) FILTER (WHERE is_scam) AS pos, count(*) FILTER (WHERE NOT is_scam) AS neg FROM ml JOIN acc USING (msg_id) WHERE is_scam IS NOT NULL GROUP BY 1))) ORDER BY f1 DESC, score LIMIT 1""", "ml", "acc"))
def d6(spark, d):
    return ds.best_threshold(stages(spark, d).outcomes, "probability", F.col("is_scam"))


@register("c1_union_evidence", q("SELECT msg_id, CAST(ord AS BIGINT) AS ord, source, signal, severity, round(confidence, 6) AS confidence FROM ev", "ev"))
def c1(spark, d):
    df = risk.evidence_long(stages(spark, d).triaged)
    return df.select("msg_id", n(F.col("ord")).alias("ord"), "source", "signal", "severity", F.round("confidence", 6).alias("confidence"))


@register("c2_dedup_evidence", q("SELECT msg_id, source, signal, severity, round(confidence, 6) AS confidence FROM uniq_ev", "uniq_ev"))
def c2(spark, d):
    df = risk.evidence_long(stages(spark, d).triaged, "unique_evidence")
    return df.select("msg_id", "source", "signal", "severity", F.round("confidence", 6).alias("confidence"))


@register("c3_themes", q("SELECT msg_id, theme, CAST(worst AS BIGINT) AS worst, items, worst >= 2 AS corroborates FROM themes", "themes"))
def c3(spark, d):
    df = unnest(stages(spark, d).triaged, "themes", "msg_id").drop("ord")
    return df.select("msg_id", "theme", n(F.col("worst")).alias("worst"), n(F.col("items")).alias("items"), (F.col("worst") >= 2).alias("corroborates"))


@register("c4_consistency", q("SELECT msg_id, consistency, array_to_string(corroborating, '|') AS corroborating FROM corr", "corr"))
def c4(spark, d):
    return stages(spark, d).triaged.select("msg_id", "consistency", joined("corroborating").alias("corroborating"))


LABEL_SQL = "CASE r.primary_category " + " ".join(f"WHEN {c.s(k)} THEN {c.s(v)}" for k, v in lx.CATEGORY_LABELS.items()) + " END"


@register("c5_conclusion", q(f"""SELECT msg_id, CASE WHEN level = 'LOW' AND sufficiency IN ('INSUFFICIENT', 'PARTIAL') THEN 'There was too little evidence for a confident assessment: nothing provided points to a scam, but this is not a verified clean result.'
 WHEN level = 'LOW' THEN 'The checked evidence shows no significant sign of a scam.' WHEN len(corroborating) = 0 THEN 'There are some signs of risk, but insufficient evidence for a confident conclusion.'
 ELSE level || ' probability of a scam: the ' || {LABEL_SQL} || ' pattern rests on corroborating evidence from ' || array_to_string(corroborating[1:3], ', ') || CASE WHEN len(corroborating) > 3 THEN ' and ' || CAST(len(corroborating) - 3 AS VARCHAR) || ' more' ELSE '' END
  || '. No single signal decides; the combined weight does.' END AS conclusion FROM scored JOIN refined r USING (msg_id)""", "scored", "refined"))
def c5(spark, d):
    return stages(spark, d).triaged.select("msg_id", "conclusion")


NUMERIC = ["ml_score", "url_risk", "threat_intel", "pattern_score", "entity_impersonation", "urgency", "payment_request", "credential_request", "otp_request",
           "sensitive_info", "suspicious_instructions", "consistency"]
COUNTS = ["evidence_count", "high_severity_count", "distinct_sources"]
BOOLS = ["has_text", "has_url", "intel_informative", "url_anchor"]


@register("k1_risk_inputs", q("SELECT msg_id, " + ", ".join([f"round({x}, 6) AS {x}" for x in NUMERIC] + [f"CAST({x} AS BIGINT) AS {x}" for x in COUNTS] + BOOLS) + " FROM inputs", "inputs"))
def k1(spark, d):
    return stages(spark, d).triaged.select("msg_id", *[F.round(F.col(x).cast("double"), 6).alias(x) for x in NUMERIC], *[n(F.col(x)).alias(x) for x in COUNTS], *BOOLS)


@register("k2_risk_score", q("SELECT msg_id, round(raw_score, 6) AS raw_score, score FROM scored", "scored"))
def k2(spark, d):
    return stages(spark, d).triaged.select("msg_id", F.round("raw_score", 6).alias("raw_score"), "score")


@register("k3_risk_level", q("SELECT msg_id, level FROM scored", "scored"))
def k3(spark, d):
    return stages(spark, d).triaged.select("msg_id", "level")


@register("k4_sufficiency", q("SELECT msg_id, sufficiency, confidence FROM scored", "scored"))
def k4(spark, d):
    return stages(spark, d).triaged.select("msg_id", "sufficiency", "confidence")


@register("k5_contributors", q(" UNION ALL ".join(
    f"SELECT msg_id, {c.s(label)} AS name, {c.rnd(f'{k} * 2e0 - 1e0', 3)} AS impact, {c.s(lx.CHANNEL_SOURCES.get(k, 'text_analysis'))} AS source FROM scored WHERE {k} >= 0.2e0"
    for k, label in lx.CHANNEL_LABELS.items()) + " UNION ALL SELECT msg_id, 'Evidence volume', 0e0, 'text_analysis' FROM scored WHERE evidence_count = 0 AND "
    + " AND ".join(f"{k} < 0.2e0" for k in lx.CHANNEL_LABELS), "scored"))
def k5(spark, d):
    return unnest(stages(spark, d).triaged, "contributors", "msg_id").drop("ord").select("msg_id", "name", "impact", "source")
