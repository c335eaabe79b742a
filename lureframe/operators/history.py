"""Queries over stored results: history, single view, purge, timeline, dashboard."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import lexicon as lx
from ..functions.bind import unnest
from .report import suspicious_indicators
from .rules import category_label

CHILD_TABLES = ["evidence", "entities", "analyses", "risk", "reports"]


def between_days(table: DataFrame, days: tuple[str, str] | None) -> DataFrame:
    """Rows of the days from first to last; a filter on the partition column, which skips the folders of all other days."""
    return table if days is None else table.where(F.col("day").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))


def result_tables(triaged: DataFrame, weights: dict[str, float] | None = None, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The six result tables (or those in ``names``) of a triaged batch, keyed on (day, msg_id); rejected messages have no rows.

    ``weights``: the channel weights that the scores were made with.  Stages of
    one batch run together: they carry the time of the run and no duration.
    """
    if "reject_reason" in triaged.columns:
        triaged = triaged.where("reject_reason is null")
    keep = [c for c in ("msg_id", "user_id", "ts", "title", "source_label") if c in triaged.columns]
    day = F.to_date("ts").alias("day") if "ts" in triaged.columns else F.current_date().alias("day")
    long = lambda column: unnest(triaged, column, "msg_id", day)
    def analyses():
        ran = F.array_compact(F.array(
            F.lit("parse"), F.lit("analyze"), F.when(F.col("ambiguous"), F.lit("llm_classify")),
            F.when(F.size("url_facts") > 0, F.lit("url_analysis")), F.when(F.size("brands") > 0, F.lit("entity_analysis")),
            F.when(F.size("url_facts") > 0, F.lit("threat_intel")), F.lit("ml"), F.lit("correlate"), F.lit("risk"),
            F.lit("explain"), F.lit("report")))
        label = F.create_map(*[F.lit(x) for pair in lx.STAGES for x in pair])
        stages = F.transform(ran, lambda s: F.struct(
            s.alias("stage"), label[s].alias("label"), F.current_timestamp().alias("at"), F.lit(0).cast("bigint").alias("duration_ms")))
        return unnest(triaged, stages, "msg_id", day)

    used = F.create_map(*[x for k, v in (weights or lx.CHANNEL_WEIGHTS).items() for x in (F.lit(k), F.lit(float(v)))])
    make = {
        "investigations": lambda: warnings(triaged).select(*keep, day, "input_types", "preview", "fingerprint", F.lit("completed").alias("status"),
                                                           "sufficiency", "probability", "ml_label", "ml_model", "ml_is_mock", "warnings"),
        "evidence": lambda: long("evidence"),
        "entities": lambda: long("entities"),
        "analyses": analyses,
        "risk": lambda: triaged.select("msg_id", day, "score", "raw_score", "level", "confidence", "contributors", used.alias("weights_used")),
        "reports": lambda: triaged.select("msg_id", day, "primary", "alternatives", "class_confidence", "summary", "objective",
                                          "objective_confidence", "recommendations", suspicious_indicators(8).alias("suspicious_indicators"),
                                          "limitations", "conclusion", "sections"),
    }
    return {name: table() for name, table in make.items() if names is None or name in names}


def history(investigations: DataFrame, risk: DataFrame, reports: DataFrame, user_id, *, search: str | None = None,
            risk_level: str | None = None, scam_type: str | None = None, input_type: str | None = None,
            days: tuple[str, str] | None = None) -> DataFrame:
    """The owner's submissions that pass the filters, unordered (filters reach the scans).

    Tables meet on (run, day, msg_id): the partitions of the owner's rows prune the scans of the other two, and
    ``days`` (first, last) prunes all three.
    """
    rows = between_days(investigations, days).where(F.col("user_id") == user_id)
    if search:
        rows = rows.where(F.col("title").ilike(f"%{search}%"))
    if input_type:
        rows = rows.where(F.array_contains("input_types", input_type.lower()))
    keys = _keys(investigations, risk)
    r = between_days(risk, days).select(*keys, "score", "level")
    p = between_days(reports, days).select(*keys, "primary")
    if risk_level:
        r = r.where(F.col("level") == risk_level.upper())
    if scam_type:
        p = p.where(F.col("primary") == scam_type)
    return rows.join(r, keys, "inner" if risk_level else "left").join(p, keys, "inner" if scam_type else "left")


def history_page(found: DataFrame, page: int = 1, page_size: int = 20, after: tuple | None = None) -> DataFrame:
    """One page, newest first (ties by id), planned as a top-k.

    ``after`` (ts, msg_id of the last row seen) continues from there and holds one page only, however deep; ``page``
    counts pages from the start and holds all rows before it as well.
    """
    cols = [c for c in ("msg_id", "title", "status", "score", "level", "primary", "input_types", "sufficiency", "ts") if c in found.columns]
    rows = found.select(*cols).withColumn("scam_type", category_label(F.col("primary")))
    if after is not None:
        ts, msg_id = F.lit(after[0]), F.lit(after[1])
        return rows.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("msg_id") > msg_id))).orderBy(
            F.col("ts").desc(), "msg_id").limit(page_size)
    return rows.orderBy(F.col("ts").desc(), "msg_id").offset((page - 1) * page_size).limit(page_size)


def history_total(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


def investigation_view(tables: dict[str, DataFrame], user_id, msg_id=None, days: tuple[str, str] | None = None) -> DataFrame:
    """One nested row per owned submission (all of them when ``msg_id`` is None); ``days`` prunes all six scans."""
    tables = {name: between_days(t, days) for name, t in tables.items() if name != "triaged"}
    keys = [c for c in ("run", "day") if c in tables["investigations"].columns] + ["msg_id"]
    own = tables["investigations"].where(F.col("user_id") == user_id)
    if msg_id is not None:
        own = own.where(F.col("msg_id") == msg_id)
    ids = own.select(*keys)

    def nested(name, fields):
        t = tables[name] if msg_id is None else tables[name].where(F.col("msg_id") == msg_id)
        items = F.sort_array(F.collect_list(F.struct("ord", *fields)))
        return t.join(ids, keys, "left_semi").groupBy(*keys).agg(items.alias(name))

    out = own
    out = out.join(nested("evidence", ["source", "signal", "severity", "confidence", "description"]), keys, "left")
    out = out.join(nested("entities", ["bucket", "entity_type", "value", "context"]), keys, "left")
    out = out.join(nested("analyses", ["stage", "label", "at", "duration_ms"]), keys, "left")
    out = out.join(tables["risk"], keys, "left")
    return out.join(tables["reports"], keys, "left").drop("run", "day")


def purge(tables: dict[str, DataFrame], ids: DataFrame, user_id) -> dict[str, DataFrame]:
    """All six tables without the given submissions, as far as the user owns them."""
    doomed = tables["investigations"].where(F.col("user_id") == user_id).join(ids.select("msg_id").distinct(), "msg_id", "left_semi").select("msg_id")
    return {name: t.join(doomed, "msg_id", "left_anti") for name, t in tables.items()}


def stage_timeline(log: DataFrame) -> DataFrame:
    """First run of each known stage per submission, with display order and label.

    ``log``: msg_id, stage, at, duration_ms.  The first run is found by an
    aggregate that combines on the map side.
    """
    order = F.create_map(*[x for i, (s, _) in enumerate(lx.STAGES) for x in (F.lit(s), F.lit(i))])
    label = F.create_map(*[x for s, t in lx.STAGES for x in (F.lit(s), F.lit(t))])
    known = log.where(F.col("stage").isin([s for s, _ in lx.STAGES]))
    first = known.groupBy("msg_id", "stage").agg(F.min(F.struct("at", "duration_ms")).alias("f"))
    return first.select("msg_id", "stage", order[F.col("stage")].alias("stage_order"), label[F.col("stage")].alias("label"),
                        F.col("f.at").alias("at"), F.col("f.duration_ms").alias("duration_ms"))


def merge_metadata(current: Column, update: Column) -> Column:
    """Key-wise merge of two ``map<string, map<string,string>>`` values; the later value wins."""
    empty = F.expr("cast(map() as map<string,map<string,string>>)")
    return F.map_zip_with(
        F.coalesce(current, empty), F.coalesce(update, empty),
        lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(
            F.map_zip_with(a, b, lambda k2, x, y: F.coalesce(y, x))))


def fold_metadata(updates: DataFrame) -> DataFrame:
    """All updates of a submission merged in order: the last value per (section, key).

    ``updates``: msg_id, ord, section, key, value.
    """
    return updates.groupBy("msg_id", "section", "key").agg(F.max_by("value", "ord").alias("value"))


def _keys(left: DataFrame, right: DataFrame) -> list[str]:
    """What identifies a submission in stored tables: its run and day as well, where both have them."""
    return [c for c in ("run", "day") if c in left.columns and c in right.columns] + ["msg_id"]


def dashboard_kpis(investigations: DataFrame, risk: DataFrame, today: Column) -> DataFrame:
    """Counted from the result rows; :func:`dashboard_from_summary` gives the same without reading them."""
    keys = _keys(investigations, risk)
    joined = investigations.select(*keys, "ts").join(risk.select(*keys, "score", "level"), keys, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("high_risk"),
        F.bround(F.coalesce(F.avg("score"), F.lit(0.0)), 0).cast("int").alias("mean_score"),
        F.count_if(F.to_date("ts") == today).alias("today"))


def _counted(where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("long")


def dashboard_from_summary(summary: DataFrame, today: Column, user_id=None) -> DataFrame:
    """:func:`dashboard_kpis` (of one owner, if given) from the counts that the store keeps per day, user, level and category."""
    rows = summary if user_id is None else summary.where(F.col("user_id") == user_id)
    mean = F.sum("score_sum").cast("double") / F.sum("n")
    return rows.agg(_counted(F.lit(True)).alias("total"), _counted(F.col("level").isin("HIGH", "CRITICAL")).alias("high_risk"),
                    F.bround(F.coalesce(mean, F.lit(0.0)), 0).cast("int").alias("mean_score"), _counted(F.col("day") == today).alias("today"))


def total_from_summary(summary: DataFrame, user_id, *, risk_level: str | None = None, scam_type: str | None = None) -> DataFrame:
    """:func:`history_total` for the filters that the summary knows."""
    rows = summary.where(F.col("user_id") == user_id)
    if risk_level:
        rows = rows.where(F.col("level") == risk_level.upper())
    if scam_type:
        rows = rows.where(F.col("primary") == scam_type)
    return rows.agg(_counted(F.lit(True)).alias("total"))


def _shares(counts: DataFrame) -> DataFrame:
    return counts.withColumn("percent", F.bround(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))), 2))  # four rows


def level_distribution(risk: DataFrame) -> DataFrame:
    return _shares(risk.groupBy("level").agg(F.count(F.lit(1)).alias("n")))


def levels_from_summary(summary: DataFrame) -> DataFrame:
    return _shares(summary.groupBy("level").agg(F.sum("n").alias("n")))


def top_categories(reports: DataFrame, k: int = 6) -> DataFrame:
    """``reports``: rows of reports, or a summary (``n`` of each row)."""
    rows = F.sum("n") if "n" in reports.columns else F.count(F.lit(1))
    return (
        reports.groupBy(F.coalesce("primary", F.lit("unclassified")).alias("category")).agg(rows.alias("n"))
        .orderBy(F.col("n").desc(), "category").limit(k)
    )


def evidence_by_source(evidence: DataFrame, sources: list[str]) -> DataFrame:
    return evidence.where(F.col("source").isin(sources))


def flagged_evidence(evidence: DataFrame, severities: tuple[str, ...] = ("high", "critical")) -> DataFrame:
    return evidence.where(F.col("severity").isin(list(severities)))


def warnings(df: DataFrame) -> DataFrame:
    """``warnings``: reputation warnings plus a note when an image came without its text."""
    from .reputation import intel_warnings

    image = F.array_contains("input_types", "image")
    read = F.col("ocr_text").isNotNull() if "ocr_text" in df.columns else F.lit(False)
    note = F.array_compact(F.array(F.when(image & ~read, "Screenshot received but OCR did not run.")))
    return df.withColumn("warnings", F.concat(intel_warnings(), note))
