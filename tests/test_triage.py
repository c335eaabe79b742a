"""Bands, categories and relations of the whole plan, and the risk engine on its own."""
from pyspark.sql import functions as F

from lureframe import lexicon as lx
from lureframe.operators import risk


def test_every_row_comes_out(assessed):
    assert {k for k, r in assessed.items() if r["reject_reason"]} == {"empty"} and assessed["empty"]["reject_reason"] == "no_content"
    assert assessed["long_scam"]["primary"] == "banking_scam" and assessed["long_scam"]["level"] != "LOW"
    assert len(assessed["many_urls"]["all_urls"]) == 50 and assessed["many_urls"]["level"] != "LOW"


def test_hard_negatives_stay_low(assessed):
    for name in ("meeting", "warning", "two_factor", "receipt", "official", "parcel_notice", "sparse"):
        assert assessed[name]["level"] == "LOW", name
    assert "not a verified safe/clean result" in assessed["sparse"]["summary"]
    assert "not a verified clean result" in assessed["sparse"]["conclusion"]


def test_scams_reach_band_and_category(assessed):
    assert assessed["otp_scam"]["primary"] == "banking_scam" and assessed["otp_scam"]["level"] in ("MEDIUM", "HIGH", "CRITICAL")
    assert assessed["gift_card"]["primary"] == "payment_scam" and assessed["gift_card"]["level"] != "LOW"
    assert assessed["lookalike"]["primary"] == "phishing" and assessed["lookalike"]["level"] == "HIGH"
    assert assessed["punycode"]["primary"] == "phishing" and assessed["punycode"]["level"] != "LOW"


def test_strong_url_is_not_diluted_by_neutral_text(assessed):
    assert assessed["anchored"]["url_anchor"] and assessed["anchored"]["level"] in ("HIGH", "CRITICAL")


def test_gates(assessed):
    ids = lambda name: {m["id"] for m in assessed[name]["matches"]}
    assert "bank_otp_request" not in ids("warning") and "bank_otp_request" in ids("otp_scam")
    assert "delivery_undeliverable" not in ids("parcel_notice") and "delivery_undeliverable" in ids("parcel_scam")
    assert "phishing_shared_document" not in ids("document") and "phishing_shared_document" in ids("document_link")


def test_flags_need_requestive_intent(assessed):
    assert not assessed["warning"]["otp_request"] and assessed["warning"]["protective"]
    assert assessed["otp_scam"]["otp_request"] and assessed["gift_card"]["payment_request"]
    assert not assessed["receipt"]["payment_request"]


def test_evidence_and_report(assessed):
    row = assessed["otp_scam"]
    assert row["evidence"][0]["source"] == "input_parser" and row["evidence_count"] == len(row["evidence"])
    assert row["objective"] == "credential theft" and row["objective_confidence"] == "high"
    assert any("one-time codes" in r for r in row["recommendations"])
    assert [s["title"] for s in row["sections"]][-1] == "Recommended actions"
    ranks = [{"low": 0, "high": 2, "critical": 3}.get(e["severity"], 1) for e in row["ranked"]]
    assert ranks == sorted(ranks, reverse=True)


def _score(spark, weights=None, **values):
    """Risk of hand-set channel values."""
    base = {**{k: 0.0 for k in lx.CHANNEL_WEIGHTS}, "consistency": 0.75, "has_text": True, "has_url": True, "intel_informative": False,
            "url_anchor": False, "evidence_count": 4, "distinct_sources": 3, "high_severity_count": 1, "live_ml": False, "live_intel": False}
    base.update(values)
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()])
    df = risk.contributors(risk.sufficiency(risk.risk_score(df, weights))).withColumn("level", risk.risk_level(F.col("raw_score")))
    return df.head()


def _reference(w, v, has_text, has_url, informative, anchor):
    """The same formula in plain Python."""
    def on(k):
        if k == "consistency":
            return True
        ok = has_url if k == "url_risk" else (has_url and informative) if k == "threat_intel" else has_text
        return ok and (not (anchor and has_url) or min(1.0, max(0.0, v[k])) >= 0.2)

    total = sum(w[k] for k in w if on(k))
    s = sum(w[k] * min(1.0, max(0.0, v[k])) for k in w if on(k) and k != "consistency")
    s += w["consistency"] * (v["consistency"] - 0.5) * 2.0 * (s / 100.0)
    return s / total * 100.0


def test_score_formula(spark):
    for anchor in (False, True):
        v = {**{k: 0.0 for k in lx.CHANNEL_WEIGHTS}, "url_risk": 0.69, "pattern_score": 0.5, "ml_score": 0.1, "consistency": 0.9}
        got = _score(spark, url_anchor=anchor, **v)["raw_score"]
        assert abs(got - _reference(lx.CHANNEL_WEIGHTS, v, True, True, False, anchor)) < 1e-9


def test_anchoring_is_monotone(spark):
    assert _score(spark, url_risk=0.7, url_anchor=True)["raw_score"] > _score(spark, url_risk=0.7)["raw_score"]
    assert _score(spark, url_risk=0.7, url_anchor=True, pattern_score=0.5)["raw_score"] <= 100


def test_levels_use_the_unrounded_score(spark):
    df = spark.createDataFrame([(24.96,), (25.0,), (49.99,), (50.0,), (75.0,)], "s double")
    assert [r[0] for r in df.select(risk.risk_level(F.col("s"))).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]


def test_no_evidence_contributor(spark):
    got = _score(spark, evidence_count=0)["contributors"]
    assert [c["name"] for c in got] == ["Evidence volume"]


def test_compat_leaves_impersonation_out(spark):
    from lureframe.plans.triage import triage

    df = spark.createDataFrame([(1, "PayPal: log in at http://paypal-help.example.org/x", [])], "msg_id int, text string, urls array<string>")
    assert len(triage(df, with_report=False).select("impersonation").head()[0]) == 1
    assert len(triage(df, compat=True, with_report=False).select("impersonation").head()[0]) == 0


def test_equal_contents_are_assessed_once_and_every_message_keeps_its_row(spark):
    from lureframe.plans import triage as plan

    texts = ["Send the code 123456 to verify your account", None, "hello there", ""]
    rows = [(i, texts[i % 4], [] if i % 8 else ["http://paypa1-login.example/verify"], f"mine {i}" if i % 3 else None, i % 5) for i in range(40)]
    frame = spark.createDataFrame(rows + rows[:2], "msg_id long, text string, urls array<string>, title string, user_id int")
    seen = []
    plan.per_content(frame, lambda c: seen.append(c.count()) or plan.ingest_stage(c))
    assert seen == [5]
    once, each = plan.triage(frame), plan._assess(frame, lx.DEFAULT, None, None, None, False, True)
    assert once.schema.names == each.schema.names
    as_text = lambda df: sorted(r[0] for r in df.selectExpr("to_json(struct(*))").collect())
    assert as_text(once) == as_text(each) and len(as_text(once)) == 42


def test_contents_are_dealt_to_two_tasks_a_core_that_stay_apart(spark):
    from lureframe.plans import triage as plan

    rows = spark.range(200).selectExpr("id as msg_id", "concat('text ', id % 50) as text", "cast(array() as array<string>) as urls")
    met = plan.per_content(rows, plan.ingest_stage)
    met.write.format("noop").mode("overwrite").save()
    assert met.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert met.count() == 200 and met.select("body").distinct().count() == 50


def test_contents_of_unknown_size_are_not_dealt_to_thousands_of_tasks(spark):
    from lureframe.plans import triage as plan

    frame = spark.createDataFrame([(i, "ab"[i % 2] * (1 + i % 2)) for i in range(12)], "msg_id long, text string")  # rows of an RDD have no size
    met = plan.per_content(frame, lambda rows: rows.withColumns({"title": F.lit("t"), "n": F.length("text")}))
    assert f"{plan.MOST_TASKS})" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.msg_id, r.n) for r in met.collect()) == [(i, 1 + i % 2) for i in range(12)]
