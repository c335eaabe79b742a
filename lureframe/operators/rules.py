"""Declarative rules and the category vote."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions.bind import let
from ..functions.literals import sql_array, sql_str, str_array, str_map
from .signals import evidence


def _rule_table(lex: lx.Lexicon) -> Column:
    rows = [
        "named_struct("
        f"'id', {sql_str(r.id)}, 'category', {sql_str(r.category)}, 'name', {sql_str(r.name)}, "
        f"'description', {sql_str(f'[{lx.CATEGORY_LABELS.get(r.category, r.category)}] {r.description}')}, "
        f"'weight', {r.weight}D, 'severity', {sql_str(r.severity)}, 'confidence', {r.confidence}D, "
        f"'required', {sql_array(r.required_entities)}, 'needs_request', {str(r.needs_request).lower()}, "
        f"'alarm', {str(r.id in lex.alarm_rules).lower()}, "
        f"'keywords', {sql_array(r.keywords)}, 'patterns', {sql_array(r.patterns)})"
        for r in lex.rules
    ]
    return F.expr("array(" + ", ".join(rows) + ")")


def _rule_index(lex: lx.Lexicon) -> Column:
    """Constant map from keyword or pattern to the positions of the rules that use it."""
    at: dict[str, list[int]] = {}
    for i, rule in enumerate(lex.rules):
        for w in (*rule.keywords, *rule.patterns):
            at.setdefault(w, []).append(i + 1)
    return F.expr("map(" + ", ".join(f"{sql_str(w)}, array({', '.join(map(str, ix))})" for w, ix in at.items()) + ")")


def rule_hits(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """``raw_matches``: rules with at least one keyword or pattern in the text, before any gate."""
    fields = ("id", "category", "name", "description", "weight", "severity", "confidence", "required", "needs_request", "alarm")
    table, index = _rule_table(lex), _rule_index(lex)
    words = [k for r in lex.rules for k in r.keywords]
    patterns = [p for r in lex.rules for p in r.patterns]

    def build(x):
        at = F.array_sort(F.array_distinct(F.flatten(F.transform(x["found"], lambda w: F.element_at(index, w)))))
        return F.transform(at, lambda i: let(lambda y: F.struct(
            *[y["rule"][f].alias(f) for f in fields],
            F.array_intersect(y["rule"]["keywords"], x["found"]).alias("keywords"),
            F.array_intersect(y["rule"]["patterns"], x["found"]).alias("patterns"),
        ), rule=F.element_at(table, i)))

    found = F.concat(F.array_intersect("hits", str_array(words)), F.array_intersect("pattern_hits", str_array(patterns)))
    return df.withColumn("raw_matches", let(build, found=found))


def entity_gate(m: Column, entity_types: Column) -> Column:
    return (F.size(m["required"]) == 0) | F.arrays_overlap(m["required"], entity_types)


def request_context() -> Column:
    """The message asks for something or applies pressure."""
    return (
        F.col("payment_request") | F.col("credential_request") | F.col("otp_request") | F.col("sensitive_request")
        | F.col("instructions") | (F.col("urgency_score") > 0) | (F.col("fear_threat_score") > 0)
    )


def alarm_silenced() -> Column:
    """Protective or reassuring wording with nothing asked for."""
    return (F.col("protective") | F.col("reassurance")) & ~(
        F.col("credential_request") | F.col("otp_request") | F.col("sensitive_request")
    )


def apply_gates(df: DataFrame) -> DataFrame:
    """``matches``: the raw matches that pass the entity, request-context and alarm gates."""
    df = df.withColumns({
        "entity_types": F.array_distinct("entities.entity_type"),
        "request_context": request_context(),
        "alarm_silenced": alarm_silenced(),
    })
    return df.withColumn("matches", let(lambda x: F.filter(x["raw"], lambda m: (
        entity_gate(m, x["types"]) & (~m["needs_request"] | x["asks"]) & ~(m["alarm"] & x["silenced"])
    )), raw="raw_matches", types="entity_types", asks="request_context", silenced="alarm_silenced"))


def match_rules(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    return apply_gates(rule_hits(df, lex))


def rule_evidence() -> Column:
    return F.transform("matches", lambda m: evidence(
        "scam_pattern", m["id"], m["severity"], m["confidence"], m["description"],
        rule_name=m["name"], category=m["category"], matched_keywords=F.array_join(m["keywords"], ", "),
        matched_patterns=F.array_join(m["patterns"], ", "), weight=m["weight"],
    ))


def _boosts() -> list[tuple[str, Column, float]]:
    return [("banking_scam", F.col("otp_request"), 1.0), ("phishing", F.col("credential_request"), 0.75),
            ("payment_scam", F.col("payment_request"), 0.5)]


def classify_categories(df: DataFrame) -> DataFrame:
    """Rank categories by summed rule weight; ties by number of hits, then first appearance."""
    boosted = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(c).alias("category"), F.lit(w).alias("weight"), F.lit(0).alias("n")))
                                        for c, cond, w in _boosts()]))
    votes = F.concat(
        F.transform("matches", lambda m: F.struct(
            m["category"].alias("category"), m["weight"].alias("weight"), (F.size(m["keywords"]) + F.size(m["patterns"])).alias("n"))),
        boosted,
    )
    df = df.withColumn("votes", votes)

    def tally(votes):
        def one(c, i):
            mine = F.filter(votes, lambda v: v["category"] == c)
            return F.struct(
                (-F.aggregate(mine, F.lit(0.0), lambda a, v: a + v["weight"])).alias("neg_score"),
                (-F.aggregate(mine, F.lit(0), lambda a, v: a + v["n"])).alias("neg_hits"),
                i.alias("ord"), c.alias("category"),
            )

        return F.transform(F.array_distinct(votes["category"]), one)

    df = df.withColumn("ranking", F.array_sort(let(lambda x: tally(x["votes"]), votes="votes")))
    n = F.size("ranking")
    first = F.get(F.col("ranking"), F.lit(0))
    total = F.aggregate("ranking", F.lit(0.0), lambda a, x: a + x["neg_score"])
    return df.withColumns({
        "primary": F.coalesce(first["category"], F.lit("unknown")),
        "alternatives": F.when(n > 1, F.transform(F.slice("ranking", F.lit(2), n), lambda x: x["category"]))
        .otherwise(F.expr("cast(array() as array<string>)")),
        "class_score": F.coalesce(-first["neg_score"], F.lit(0.0)),
        "class_confidence": F.when(n == 0, 0.0)
        .when(n == 1, F.least(F.lit(0.9), F.lit(0.4) + F.lit(0.1) * -first["neg_score"]))
        .otherwise(F.bround(F.least(F.lit(0.95), first["neg_score"] / total), 2)),
        "class_method": F.lit("rules"),
    })


def is_ambiguous() -> Column:
    return F.col("primary").isNull() | F.col("primary").isin("unknown", "other") | (F.col("class_confidence") < 0.5)


def classify_from_urls(df: DataFrame) -> DataFrame:
    """``url_class``: phishing verdict for submissions that carry URLs but no text, else null."""
    intent, trusted = str_array(lx.CREDENTIAL_INTENT), str_array(lx.TRUSTED_DOMAINS)

    def claims(u):
        official = F.arrays_overlap(u["domain_suffixes"], trusted)
        return F.array_compact(F.array(
            u["lookalike"],
            F.when(~official & (F.arrays_overlap(u["keywords"], intent) | (u["risk"] >= 0.5)), u["domain"]),
        ))

    from ..functions.urls import suffixes_of

    slim = F.transform("url_facts", lambda u: F.struct(
        u["lookalike"].alias("lookalike"), u["keywords"].alias("keywords"), u["risk"].alias("risk"), u["domain"].alias("domain"),
        suffixes_of(u["domain"]).alias("domain_suffixes")))
    df = df.withColumn("_claims", F.when(F.col("body") == "", F.flatten(F.transform(slim, claims))))
    strong = F.size(F.filter("url_facts", lambda u: u["risk"] >= 0.4))
    return df.withColumn("url_class", F.when(
        F.size("_claims") > 0,
        F.struct(
            F.lit("phishing").alias("primary"),
            F.bround(F.least(F.lit(0.75), F.lit(0.45) + F.lit(0.15) * strong), 2).alias("confidence"),
            F.col("_claims")[0].alias("claim"),
        ),
    )).drop("_claims")


def adjudicate_labels(df: DataFrame) -> DataFrame:
    """Settle ambiguous rows with the URL verdict or an externally suggested label.

    Expects ``suggested_category`` / ``suggested_confidence`` (null when nothing
    was suggested).  A suggestion may pick which scam an ambiguous row is, never
    that it is one: without deterministic evidence or a URL verdict it is
    rejected and recorded.
    """
    named = F.coalesce(~F.col("suggested_category").isin("unknown", "other"), F.lit(False))
    has_evidence = (
        (F.size("matches") > 0) | F.col("payment_request") | F.col("credential_request") | F.col("otp_request")
        | F.col("sensitive_request") | F.col("instructions")
    )
    df = df.withColumn("ambiguous", is_ambiguous())
    offered = F.col("ambiguous") & F.col("suggested_category").isNotNull()
    df = df.withColumn("suggestion_rejected", offered & named & F.col("url_class").isNull() & ~has_evidence)
    use_suggestion = offered & ~F.col("suggestion_rejected")
    use_url = F.col("ambiguous") & ~use_suggestion & F.col("url_class").isNotNull()
    df = df.withColumns({"_s": use_suggestion, "_u": use_url})
    new_primary = F.when(F.col("_s"), F.col("suggested_category")).when(F.col("_u"), F.lit("phishing")).otherwise(F.col("primary"))
    new_conf = (
        F.when(F.col("_s"), F.coalesce(F.col("suggested_confidence"), F.lit(0.0)))
        .when(F.col("_u"), F.col("url_class.confidence")).otherwise(F.col("class_confidence"))
    )
    method = F.when(F.col("_s"), F.lit("hybrid(rules+llm)")).when(F.col("_u"), F.lit("url_analysis")).otherwise(F.lit("rules"))
    df = df.withColumns({"_p": new_primary, "_c": new_conf, "_m": method, "refined": new_primary != F.col("primary")})
    df = df.withColumn("refine_evidence", F.array_compact(F.array(
        F.when(F.col("suggestion_rejected"), evidence(
            "llm_classification", "classification_suggestion_rejected", "info", 0.4,
            F.concat(F.lit("The suggested category '"), F.col("suggested_category"),
                     F.lit("' was not adopted: no rule matched and nothing was asked for.")),
            suggested_primary=F.col("suggested_category"))),
        F.when(F.col("refined"), evidence(
            F.when(F.col("_u"), F.lit("url_classification")).otherwise(F.lit("llm_classification")),
            "classification_refined", "info", F.greatest(F.col("_c"), F.lit(0.4)),
            F.concat(F.lit("The rules left the category open; "), F.col("_m"), F.lit(" points to '"), F.col("_p"), F.lit("'.")),
            method=F.col("_m"))),
    )))
    empty = F.expr("cast(array() as array<string>)")
    return df.withColumns({
        "alternatives": F.when(F.col("_u"), F.array(F.lit("impersonation_scam")))
        .when(F.col("_s"), empty).otherwise(F.col("alternatives")),
        "primary": F.col("_p"), "class_confidence": F.col("_c"), "class_method": F.col("_m"),
    }).drop("_p", "_c", "_m", "_s", "_u")


def category_label(c: Column) -> Column:
    return F.coalesce(F.try_element_at(str_map(lx.CATEGORY_LABELS), c), c)
