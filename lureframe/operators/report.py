"""Deterministic report text per message."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bind import unnest
from .risk import severity_rank
from .rules import category_label

# FIXED VALUES: severity order of the report; unknown severities (info) rank as medium.
REPORT_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def ranked_evidence(df: DataFrame) -> DataFrame:
    """``ranked``: evidence by (severity, confidence) descending, stable."""
    keyed = F.transform("evidence", lambda e, i: F.struct(
        (-severity_rank(e["severity"], REPORT_RANK, 1)).alias("r"), (-e["confidence"]).alias("c"), i.alias("i"),
        F.struct(*[e[f].alias(f) for f in ("source", "signal", "severity", "confidence", "description")]).alias("e")))
    return df.withColumn("ranked", F.transform(F.array_sort(keyed), lambda x: x["e"]))


def top_evidence(df: DataFrame, k: int) -> DataFrame:
    """Long form of the first ``k`` ranked items per message."""
    top = unnest(ranked_evidence(df), F.slice("ranked", 1, k), "msg_id", pos="pos")
    return top.withColumn("rank", F.col("pos") + 1).drop("pos")


def _signal(prefix: str) -> Column:
    return F.exists("evidence.signal", lambda s: s.startswith(prefix))


def objective(df: DataFrame) -> DataFrame:
    options = [
        (F.col("otp_request") | F.col("credential_request"), "credential theft", 3),
        (F.col("payment_request") | F.array_contains("evidence.signal", "payment_upfront_fee"), "financial fraud", 3),
        (_signal("techsupport_"), "malware delivery / remote access", 3),
        (F.col("sensitive_request") | _signal("identity_"), "identity theft", 2),
        (_signal("account_"), "account takeover", 2),
        (_signal("lottery_") | _signal("romance_"), "advance-fee fraud", 2),
    ]
    name, sure = F.lit(None).cast("string"), F.lit("low")
    for cond, text, weight in reversed(options):
        name, sure = F.when(cond, text).otherwise(name), F.when(cond, "high" if weight >= 3 else "medium").otherwise(sure)
    return df.withColumns({"objective": name, "objective_confidence": sure})


def recommendations(df: DataFrame) -> DataFrame:
    risky_url = F.exists("url_facts", lambda u: u["risk"] >= 0.4) | F.exists("intel", lambda t: t["verdict"].isin("suspicious", "malicious"))
    named = F.exists("brands.bucket", lambda b: b.isin("companies", "banks"))
    texts = F.array_compact(F.array(
        F.when(risky_url, "Leave the link and any attachment alone; they may be malicious."),
        F.when(F.col("payment_request"), "Do not pay or transfer anything because of this message."),
        F.when(F.col("otp_request"), "Keep one-time codes to yourself, whoever asks."),
        F.when(F.col("credential_request"), "Do not enter or pass on passwords or login details."),
        F.when(F.col("sensitive_request"), "Do not send identity papers, bank details or personal identifiers."),
        F.when(_signal("techsupport_"), "Do not install remote-control software or run commands you are given."),
        F.when(named, "Ask the organization itself, through contact details you looked up on your own."),
        F.when(F.col("raw_score") >= 60, "Report the message to the platform and, where it applies, to the authorities."),
    ))
    default = F.array(F.lit("Nothing urgent follows from this evidence. When in doubt, ask through official channels."))
    return df.withColumn("recommendations", F.when(F.size(texts) > 0, texts).otherwise(default))


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("int").cast("string")


def limitations(df: DataFrame) -> DataFrame:
    parts = F.array_compact(F.array(
        F.when((F.size("intel") == 0) | F.exists("intel", lambda t: t["is_mock"]), "no live reputation feed was consulted (demo mode)"),
        F.when(F.col("ml_is_mock"), "the model estimate is heuristic"),
        F.when(F.col("confidence") < 0.5, "sparse evidence limits the confidence"),
        F.when((F.size("url_facts") > 0) & (F.size("intel") == 0), "URL reputation could not be checked"),
    ))
    none = F.array(F.lit("the sender could not be verified independently"))
    return df.withColumn("limitations", F.concat(F.lit("Limitations: "), F.array_join(F.when(F.size(parts) > 0, parts).otherwise(none), "; ")))


def summary(df: DataFrame) -> DataFrame:
    top = F.transform(F.slice("ranked", 1, 4), lambda e: F.concat(e["description"], F.lit(" ("), e["severity"], F.lit(")")))
    opening = (
        F.when((F.col("level") == "LOW") & F.col("sufficiency").isin("INSUFFICIENT", "PARTIAL"),
               "Insufficient evidence for a confident assessment: the low score means that little was provided, "
               "it is not a verified safe/clean result.")
        .when(F.col("level") == "LOW", "Low risk: the checked signals show no significant sign of a scam.")
        .otherwise(F.concat(F.lit("The evidence points to a "), F.col("level"), F.lit(" probability of a scam (score "),
                            _whole(F.col("score")), F.lit("/100, confidence "), _whole(F.col("confidence") * 100), F.lit("%).")))
    )
    category = F.when(F.col("primary") != "unknown", F.concat(
        F.lit("The strongest pattern is '"), category_label(F.col("primary")), F.lit("' (confidence "),
        _whole(F.col("class_confidence") * 100), F.lit("%).")))
    key = F.when(F.size("ranked") > 0, F.concat(F.lit("Key evidence: "), F.array_join(top, "; "), F.lit(".")))
    model = F.concat(F.when(F.col("ml_is_mock"), "A heuristic estimate").otherwise("The model"), F.lit(" puts the probability of a scam at "),
                     _whole(F.col("probability") * 100), F.lit("%."))
    return df.withColumn("summary", F.concat_ws(" ", opening, category, key, model))


def suspicious_indicators(k: int) -> Column:
    """The first ``k`` ranked items in words."""
    return F.transform(F.slice("ranked", 1, k), lambda e: F.concat(
        e["description"], F.lit(" (severity "), e["severity"], F.lit(", confidence "), _whole(e["confidence"] * 100), F.lit("%)")))


def sections(df: DataFrame) -> DataFrame:
    lines = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat(F.lit("- "), s)), "\n")
    flagged = suspicious_indicators(8)
    section = lambda title, content, kind: F.struct(F.lit(title).alias("title"), content.alias("content"), F.lit(kind).alias("kind"))
    steps = "1. Submission received\n2. Entities extracted\n3. Evidence gathered\n4. Evidence correlated\n5. Risk assessed\n6. Report written"
    return df.withColumn("sections", F.array_compact(F.array(
        section("Summary", F.col("summary"), "paragraph"),
        section("How the conclusion was reached", F.lit(
            "Entities, wording, URL structure, model and reputation each yield evidence; the weighted sum of all channels "
            "gives the score."), "paragraph"),
        section("Investigation timeline", F.lit(steps), "list"),
        F.when(F.size("ranked") > 0, section("Suspicious indicators", lines(flagged), "list")),
        F.when(F.col("level") != "LOW", section("Recommended actions", lines(F.col("recommendations")), "list")),
    )))


def report(df: DataFrame) -> DataFrame:
    return sections(summary(limitations(recommendations(objective(ranked_evidence(df))))))
