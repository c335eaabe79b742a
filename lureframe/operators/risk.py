"""Correlation of evidence and the deterministic risk assessment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions.bind import let, unnest
from ..functions.literals import str_map
from ..functions.rounding import clamp
from ..functions.text import first_by
from .reputation import ANCHORING, INFORMATIVE
from .rules import category_label

# FIXED VALUES: severity order for correlation (anything else counts as low).
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def severity_rank(c: Column, order: dict[str, int] = SEVERITY_RANK, default: int = 1) -> Column:
    out = F.lit(default)
    for name, rank in order.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def union_evidence(df: DataFrame, **parts: Column) -> DataFrame:
    """``evidence``: the evidence of all stages appended in stage order, duplicates kept."""
    names = [f"_ev_{k}" for k in parts]
    df = df.withColumns(dict(zip(names, parts.values())))
    return df.withColumn("evidence", F.concat(*names)).drop(*names)


def evidence_long(df: DataFrame, column: str = "evidence") -> DataFrame:
    return unnest(df, column, "msg_id")


def dedup_evidence(df: DataFrame) -> DataFrame:
    """``unique_evidence``: the first item per (source, signal)."""
    return (
        df.withColumn("_k", F.transform("evidence", lambda e: F.concat_ws("|", e["source"], e["signal"])))
        .withColumn("unique_evidence", first_by(F.col("evidence"), F.col("_k"))).drop("_k")
    )


def theme_of(source: Column) -> Column:
    return F.coalesce(F.try_element_at(str_map(lx.THEME_OF_SOURCE), source), source)


def theme_label(theme: Column) -> Column:
    return F.coalesce(F.try_element_at(str_map(lx.THEME_LABELS), theme), F.initcap(F.replace(theme, F.lit("_"), F.lit(" "))))


def themes(df: DataFrame) -> DataFrame:
    """``themes``: worst severity and item count per theme, first-seen order; ``corroborating``: labels of
    the themes whose worst severity is at least medium."""
    df = df.withColumn("_t", F.transform("unique_evidence", lambda e: F.struct(
        theme_of(e["source"]).alias("theme"), severity_rank(e["severity"]).alias("rank"))))
    def gather(rows):
        def one(t):
            mine = F.filter(rows, lambda x: x["theme"] == t)
            return F.struct(t.alias("theme"), F.array_max(F.transform(mine, lambda x: x["rank"])).alias("worst"), F.size(mine).alias("items"))

        return F.transform(F.array_distinct(rows["theme"]), one)

    df = df.withColumn("themes", let(lambda x: gather(x["rows"]), rows="_t"))
    return df.withColumn("corroborating", F.transform(
        F.filter("themes", lambda t: t["worst"] >= 2), lambda t: theme_label(t["theme"]))).drop("_t")


def consistency(df: DataFrame) -> DataFrame:
    n = F.size("corroborating")
    known = F.filter("intel.verdict", lambda v: v != "unknown")
    return df.withColumns({
        "consistency": F.when(n == 0, 0.4).when(n == 1, 0.75).when(n == 2, 0.9).otherwise(1.0),
        "conflicts": F.when(
            (F.size(known) > 0) & F.forall(known, lambda v: v == "safe") & (n > 0),
            F.array(F.lit("Reputation calls the URL safe while other evidence is suspicious.")),
        ).otherwise(F.expr("cast(array() as array<string>)")),
    })


def correlate(df: DataFrame) -> DataFrame:
    return consistency(themes(dedup_evidence(df)))


def conclusion(df: DataFrame) -> DataFrame:
    """Closing sentence.  A LOW level never reads as a verified clean result."""
    n = F.size("corroborating")
    more = F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" more"))).otherwise("")
    return df.withColumn(
        "conclusion",
        F.when((F.col("level") == "LOW") & F.col("sufficiency").isin("INSUFFICIENT", "PARTIAL"),
               "There was too little evidence for a confident assessment: nothing provided points to a scam, "
               "but this is not a verified clean result.")
        .when(F.col("level") == "LOW", "The checked evidence shows no significant sign of a scam.")
        .when(n == 0, "There are some signs of risk, but insufficient evidence for a confident conclusion.")
        .otherwise(F.concat(
            F.col("level"), F.lit(" probability of a scam: the "), category_label(F.col("primary")),
            F.lit(" pattern rests on corroborating evidence from "), F.array_join(F.slice("corroborating", 1, 3), ", "), more,
            F.lit(". No single signal decides; the combined weight does."))),
    )


def _total(arr: Column | str, value) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + value(x))


def _max0(arr: Column | str) -> Column:
    return F.coalesce(F.array_max(arr), F.lit(0.0))


def risk_inputs(df: DataFrame) -> DataFrame:
    """Twelve channel values and the evidence counts of a message, all from arrays of its own row."""
    t_ok = lambda verdicts: F.exists("intel", lambda t: (t["status"] == "ok") & t["verdict"].isin(verdicts))
    return df.withColumns({
        "ml_score": F.col("probability"),
        "url_risk": _max0(F.col("url_facts.risk")),
        "threat_intel": _max0(F.col("intel.risk_score")),
        "pattern_score": F.least(F.lit(1.0), _total("matches", lambda m: m["weight"]) / 4.0),
        "entity_impersonation": F.least(F.lit(1.0), F.size("impersonation") / 2.0),
        "urgency": F.greatest("urgency_score", "fear_threat_score", "pressure_score"),
        "sensitive_info": F.col("sensitive_request"),
        "suspicious_instructions": F.col("instructions"),
        "evidence_count": F.size("evidence"),
        "high_severity_count": F.size(F.filter("evidence.severity", lambda s: s.isin("high", "critical"))),
        "distinct_sources": F.size(F.array_distinct("evidence.source")),
        "has_text": F.col("body") != "",
        "has_url": F.size("url_facts") > 0,
        "intel_informative": t_ok(INFORMATIVE),
        "live_ml": ~F.col("ml_is_mock"),
        "live_intel": F.exists("intel", lambda t: ~t["is_mock"]),
        "url_anchor": (F.size("url_facts") > 0)
        & (F.exists("url_facts", lambda u: u["risk"] >= lx.URL_ANCHOR_MIN) | t_ok(ANCHORING)),
    })


def _channels(weights: dict[str, float]) -> Column:
    def value(k):
        return F.col(k).cast("double")

    def applies(k):
        if k == "consistency":
            return F.lit(True)
        if k == "url_risk":
            return F.col("has_url")
        if k == "threat_intel":
            return F.col("has_url") & F.col("intel_informative")
        return F.col("has_text")

    anchored = F.col("url_anchor") & F.col("has_url")
    return F.array(*[
        F.struct(
            F.lit(k).alias("key"), value(k).alias("value"), F.lit(float(weights.get(k, 0.0))).alias("weight"),
            (applies(k) & (~anchored | F.lit(k == "consistency") | (clamp(value(k)) >= lx.CHANNEL_SILENT_MAX))).alias("on"),
        )
        for k in lx.CHANNEL_WEIGHTS
    ])


def risk_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``channels``, ``raw_score`` (unrounded, 0-100) and ``score``.

    Only channels that apply take part in the denominator; with strong URL
    evidence silent channels drop out too.  Consistency is added last because
    its share depends on the sum before it.
    """
    df = df.withColumn("channels", _channels(weights or lx.CHANNEL_WEIGHTS))
    active = F.filter("channels", lambda c: c["on"])
    base = _total(F.filter("channels", lambda c: c["on"] & (c["key"] != "consistency")), lambda c: c["weight"] * clamp(c["value"]))
    df = df.withColumns({"_w": _total(active, lambda c: c["weight"]), "_base": base})
    term = F.lit(float((weights or lx.CHANNEL_WEIGHTS)["consistency"])) * (F.col("consistency") - 0.5) * 2.0 * (F.col("_base") / 100.0)
    return df.withColumn("raw_score", F.when(F.col("_w") > 0, (F.col("_base") + term) / F.col("_w") * 100.0).otherwise(0.0)) \
        .withColumn("score", F.bround("raw_score", 1)).drop("_w", "_base")


def risk_level(score: Column) -> Column:
    out = F.when(score >= lx.LEVELS[0][1], lx.LEVELS[0][0])
    for name, threshold in lx.LEVELS[1:-1]:
        out = out.when(score >= threshold, name)
    return out.otherwise(lx.LEVELS[-1][0])


def sufficiency(df: DataFrame) -> DataFrame:
    providers = F.lit(0.5) * F.col("live_ml").cast("double") + F.lit(0.5) * F.col("live_intel").cast("double")
    s = (
        F.lit(0.30) * F.least(F.lit(1.0), F.col("evidence_count") / 6.0)
        + F.lit(0.25) * F.least(F.lit(1.0), F.col("distinct_sources") / 5.0)
        + F.lit(0.20) * F.least(F.lit(1.0), F.col("high_severity_count") / 2.0)
        + F.lit(0.15) * clamp(F.col("consistency"))
        + F.lit(0.10) * providers
    )
    df = df.withColumn("sufficiency_score", clamp(s))
    v = F.col("sufficiency_score")
    return df.withColumns({
        "sufficiency": F.when(v < lx.INSUFFICIENT_MAX, "INSUFFICIENT").when(v < lx.SUFFICIENT_MIN, "PARTIAL").otherwise("SUFFICIENT"),
        "confidence": F.bround(clamp(F.lit(0.2) + F.lit(0.8) * v, 0.0, 0.97), 2),
    })


def contributors(df: DataFrame) -> DataFrame:
    """Channels worth naming, with impact on a -1..1 scale and the evidence source behind them."""
    labels, sources = str_map(lx.CHANNEL_LABELS), str_map(lx.CHANNEL_SOURCES)
    found = F.transform(
        F.filter("channels", lambda c: (c["key"] != "consistency") & (c["value"] >= lx.CHANNEL_SILENT_MAX)),
        lambda c: F.struct(
            F.element_at(labels, c["key"]).alias("name"), F.bround(c["value"] * 2.0 - 1.0, 3).alias("impact"),
            F.lit(None).cast("string").alias("detail"),
            F.coalesce(F.try_element_at(sources, c["key"]), F.lit("text_analysis")).alias("source")),
    )
    nothing = F.array(F.struct(F.lit("Evidence volume").alias("name"), F.lit(0.0).alias("impact"),
                               F.lit("Insufficient evidence").alias("detail"), F.lit("text_analysis").alias("source")))
    return df.withColumn("contributors", F.when((F.size(found) == 0) & (F.col("evidence_count") == 0), nothing).otherwise(found))


def assess(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    df = risk_score(df, weights).withColumn("level", risk_level(F.col("raw_score")))
    return conclusion(contributors(sufficiency(df)))
