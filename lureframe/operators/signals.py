"""Phrase signals: what the wording asks for and how hard it pushes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import text as tx
from .entities import brand_terms

SCORED = ["urgency", "fear_threat", "reward", "pressure"]


def scan_terms(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT, text: str = "body") -> DataFrame:
    """The only pass over the text for literals: adds ``lower_body``, ``hits`` and ``pattern_hits``.

    Every phrase, keyword and brand that occurs lands in ``hits``; every regex
    variant in ``pattern_hits``.  All later operators look up these two arrays.
    """
    patterns = [p for ps in lex.group_patterns.values() for p in ps] + [p for r in lex.rules for p in r.patterns]
    terms = sorted(set(lex.terms()) | set(brand_terms(lex)))
    df = df.withColumn("lower_body", F.lower(F.col(text)))
    low = F.col("lower_body")
    return df.withColumns({
        "hits": tx.term_hits(low, terms),
        "pattern_hits": tx.pattern_hits(low, patterns),
        "requestive": tx.requestive(low, lx.REQUESTIVE_PATTERNS, lx.NEGATIONS, lx.NEGATION_REACH),
    })


def _group(lex: lx.Lexicon, name: str) -> Column:
    literal = tx.listed(lex.phrases[name], F.col("hits"))
    patterns = lex.group_patterns.get(name)
    return F.concat(literal, tx.listed(patterns, F.col("pattern_hits"))) if patterns else literal


def phrase_hits(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """``phrases``: struct with one array of hits per phrase group."""
    return df.withColumn("phrases", F.struct(*[_group(lex, g).alias(g) for g in lex.phrases]))


def score(hits: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.25) * F.size(hits))


def signal_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{g}_score": score(F.col(f"phrases.{g}")) for g in SCORED})


def request_flags(df: DataFrame) -> DataFrame:
    some = lambda g: F.size(f"phrases.{g}") > 0
    ask = F.col("requestive")
    return df.withColumns({
        "payment_request": some("payment") | (some("payment_mention") & ask),
        "credential_request": some("credential") & ask,
        "otp_request": some("otp") & ask,
        "sensitive_request": some("sensitive") & ask,
        "instructions": some("instructions"),
        "authority": some("authority"),
        "protective": some("protective"),
        "reassurance": some("reassurance"),
    })


def text_signals(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    return request_flags(signal_scores(phrase_hits(scan_terms(df, lex), lex)))


EVIDENCE_TYPE = (
    "struct<source:string,signal:string,severity:string,confidence:double,description:string,"
    "detail:map<string,string>>"
)


def evidence(source: str, signal: Column | str, severity: Column | str, confidence: Column | float,
             description: Column | str, **detail: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        lit(source).alias("source"), lit(signal).alias("signal"), lit(severity).alias("severity"),
        lit(confidence).cast("double").alias("confidence"), lit(description).alias("description"),
        (F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")).alias("detail"),
    )


def no_evidence() -> Column:
    return F.expr(f"cast(array() as array<{EVIDENCE_TYPE}>)")


def language_evidence() -> Column:
    """Evidence rows of the wording, as an array."""
    joined = lambda *gs: F.array_join(F.concat(*[F.col(f"phrases.{g}") for g in gs]), ", ")
    ev = lambda *a, **k: evidence("text_analysis", *a, **k)
    rows = [
        F.when(F.col("urgency_score") >= 0.5, ev(
            "urgency_language", "medium", F.col("urgency_score"),
            F.concat(F.lit("The wording pushes for speed in "), F.size("phrases.urgency").cast("string"), F.lit(" place(s).")),
            phrases=joined("urgency"))),
        F.when(F.col("fear_threat_score") >= 0.5, ev(
            "fear_threat_language", "high", F.col("fear_threat_score"),
            "The wording threatens a loss, closure or legal step.", phrases=joined("fear_threat"))),
        F.when(F.col("payment_request"), ev(
            "payment_request", "high", 0.8, "The reader is asked to pay or transfer money.",
            phrases=joined("payment", "payment_mention"))),
        F.when(F.col("credential_request"), ev(
            "credential_request", "high", 0.8, "The reader is asked for login details or to confirm an account.",
            phrases=joined("credential"))),
        F.when(F.col("otp_request"), ev("otp_request", "critical", 0.9, "The reader is asked for a one-time code.")),
        F.when(F.col("sensitive_request"), ev(
            "sensitive_info_request", "high", 0.75, "The reader is asked for personal or financial data.")),
        F.when(F.col("instructions"), ev(
            "suspicious_instructions", "high", 0.7,
            "The reader is told to do something risky, such as granting remote access or buying gift cards.")),
        F.when(F.col("reward_score") >= 0.5, ev(
            "reward_language", "medium", F.col("reward_score"), "The wording promises a prize or reward.",
            phrases=joined("reward"))),
    ]
    return F.array_compact(F.array(*rows))
