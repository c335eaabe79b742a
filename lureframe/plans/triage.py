"""The whole triage plan: one message row in, one assessed row out.

Every stage works on columns of the message's own row, so the plan is a chain of
projections.  Campaigns send one text many times: the chain runs over distinct
contents, and messages meet the assessment of theirs in one merge join.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from .. import lexicon as lx
from ..functions import text as tx
from ..operators import entities as en, ingest, model as ml, report as rp, reputation as rep, risk, rules, signals, urls
from ..sources.derived import derived, if_small

#: What an assessment depends on; all other columns of a message only name and place it.
CONTENT = ("text", "urls", "ocr_text", "image_ref")
#: Bytes of messages (as the plan estimates them) a task assesses, and the most tasks that an estimate asks for.
TASK_BYTES, MOST_TASKS = 64 * 1024 * 1024, 10_000
#: An estimate from here on says that the size is not known (rows from an RDD or a stream without statistics).
UNKNOWN_BYTES = 1 << 50


def per_content(messages: DataFrame, assess: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``assess(messages)`` with the work done once for each distinct content; every message keeps a row of its own.

    ``assess`` sees one row per content, with a digest of it as ``msg_id``, and may use no other column of the messages; it may drop rows.
    Contents are dealt by the digest to two tasks a core (more where they are large) and deduplicated in its order, which the merge join
    reads as it comes: assessed rows are neither shuffled nor sorted, and no core waits for the one with the last task.  Where no size
    is known, Spark deals them to its shuffle partitions and joins small ones.
    """
    have = [c for c in CONTENT if c in messages.columns]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*have), {"ignoreNullFields": "false"}), 256))  # a column without a value counts too
    keyed = messages.withColumn("_content", F.coalesce(digest, F.lit(b"")))
    size = rep.estimated_bytes(messages)
    tasks = [] if size >= UNKNOWN_BYTES else [max(2 * messages.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, size // TASK_BYTES))]
    dealt = lambda *columns: keyed.select("_content", *columns).repartition(*tasks, "_content")
    done = assess(dealt(*have).withColumnRenamed("_content", "msg_id").dropDuplicates(["msg_id"]))
    own = [c for c in messages.columns if c not in have]
    made = [c for c in done.columns if c not in ("msg_id", "title") and c not in own]
    title = F.col("title") if "title" in own else F.lit(None).cast("string")
    met = dealt(*[c for c in own if c != "title"], title.alias("_given")).join(
        done.select(F.col("msg_id").alias("_content"), F.col("title").alias("_title"), *made).hint("merge"), "_content")
    met = met.withColumn("title", F.coalesce(tx.given_title(F.col("_given")), F.col("_title")))
    return met.select(*messages.columns, *[c for c in ("title", *made) if c not in messages.columns])


def ingest_stage(messages: DataFrame) -> DataFrame:
    """Every message, with ``reject_reason`` where there is nothing to assess."""
    return ingest.describe_submissions(ingest.combine_text(ingest.validate_submissions(messages)))


def entity_stage(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT, compat: bool = False) -> DataFrame:
    """Needs ``hits`` from :func:`signals.scan_terms`."""
    df = en.merge_explicit_urls(en.extract_urls(df))
    for step in (en.extract_emails, en.extract_phones, en.extract_amounts, en.extract_dates, en.extract_codes):
        df = step(df)
    return en.collect_entities(en.extract_brands(df, lex, compat))


def text_stage(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT, compat: bool = False) -> DataFrame:
    df = entity_stage(signals.text_signals(df, lex), lex, compat)
    return rules.classify_categories(rules.match_rules(df, lex))


def url_stage(df: DataFrame, lex: lx.Lexicon = lx.DEFAULT, compat: bool = False) -> DataFrame:
    return urls.brand_impersonation(urls.url_facts(df, lex), lex, compat)


def refine_stage(df: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    df = rules.classify_from_urls(df)
    if suggestions is None:
        df = df.withColumns({"suggested_category": F.lit(None).cast("string"), "suggested_confidence": F.lit(None).cast("double")})
    else:
        # one suggestion for a message: the most confident, ties by category
        best = F.struct("suggested_confidence", F.col("suggested_category").alias("category"))
        offered = suggestions.groupBy("msg_id").agg(F.max(best).alias("s")).select(
            "msg_id", F.col("s.category").alias("suggested_category"), F.col("s.suggested_confidence").alias("suggested_confidence"))
        df = df.join(if_small(derived(offered, "suggestions")), "msg_id", "left")
    return rules.adjudicate_labels(df)


def evidence_stage(df: DataFrame) -> DataFrame:
    received = F.when(F.col("body") != "", F.array(signals.evidence(
        "input_parser", "input_received", "info", 1.0,
        F.concat(F.lit("Received "), F.size("input_types").cast("string"), F.lit(" input type(s) with "),
                 F.size("entities").cast("string"), F.lit(" entities."))))).otherwise(signals.no_evidence())
    return risk.union_evidence(
        df, parse=received, rules=rules.rule_evidence(), language=signals.language_evidence(),
        brand=urls.impersonation_evidence(), refine=F.col("refine_evidence"), ml=ml.ml_evidence(),
        url=urls.url_evidence(), intel=rep.intel_evidence(),
    )


def triage(
    messages: DataFrame, *, lex: lx.Lexicon = lx.DEFAULT, reputation: DataFrame | None = None,
    suggestions: DataFrame | None = None, model: PipelineModel | None = None, compat: bool = False,
    with_report: bool = True,
) -> DataFrame:
    """Assess every message: one row out for each row in, whatever its length.

    A message without content has ``reject_reason`` set; its assessment says nothing and stays out of the result tables.

    ``messages``: msg_id, text, urls and optionally user_id, ts, title, source_label, ocr_text, image_ref.
    ``compat`` reproduces reference behaviour that looks unintended (see README).
    Equal contents are assessed once, unless each message has suggestions of its own or arrives in a stream.
    """
    assess = lambda rows: _assess(rows, lex, reputation, suggestions, model, compat, with_report)
    return assess(messages) if suggestions is not None or messages.isStreaming else per_content(messages, assess)


def _assess(messages: DataFrame, lex: lx.Lexicon, reputation: DataFrame | None, suggestions: DataFrame | None,
            model: PipelineModel | None, compat: bool, with_report: bool) -> DataFrame:
    df = url_stage(text_stage(ingest_stage(messages), lex, compat), lex, compat)
    df = refine_stage(df, suggestions)
    df = ml.features(df)
    df = ml.predict_heuristic(df) if model is None else ml.predict_model(df, model)
    if reputation is not None:  # two branches read it: computed once, and a branch reads only the columns it needs
        df = derived(df, "stage")
    df = rep.attach_reputation(df, reputation)
    df = risk.assess(risk.risk_inputs(risk.correlate(evidence_stage(df))), lex.weights)
    return rp.report(df) if with_report else df
