"""Detection quality against expected outcomes.

Input rows: is_scam, expected_category, acceptable (array), min_level, input_type,
and the outcome columns level, primary (null level = the case failed).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx


def level_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in lx.LEVEL_ORDER]), c).cast("int") - 1, F.lit(0))


def predicted_scam() -> Column:
    return F.coalesce(F.col("level") != "LOW", F.lit(False))


def case_verdict(df: DataFrame) -> DataFrame:
    failed = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    band = level_rank(F.coalesce("level", F.lit("LOW"))) >= level_rank(F.coalesce("min_level", F.lit("LOW")))
    return df.withColumn(
        "verdict",
        F.when(failed.isNotNull(), "error").when(F.col("is_scam") & ~predicted_scam(), "fn")
        .when(~F.col("is_scam") & predicted_scam(), "fp").when(F.col("is_scam") & ~band, "band_miss").otherwise("ok"),
    )


def binary_metrics(df: DataFrame, by: str | None = "input_type", overall: str = "overall") -> DataFrame:
    """Accuracy, precision, recall and F1, overall and per ``by``, in one pass (grouping sets)."""
    flags = df.select(
        *([F.col(by)] if by else []),
        (F.col("is_scam") & predicted_scam()).alias("_tp"), (~F.col("is_scam") & predicted_scam()).alias("_fp"),
        (F.col("is_scam") & ~predicted_scam()).alias("_fn"), (~F.col("is_scam") & ~predicted_scam()).alias("_tn"))
    counts = [F.count_if(f"_{k}").alias(k) for k in ("tp", "fp", "fn", "tn")]
    if by:
        out = flags.rollup(by).agg(*counts, F.grouping(by).alias("_g"))
        out = out.withColumn("segment", F.when(F.col("_g") == 1, F.lit(overall)).otherwise(F.col(by))).drop("_g", by)
    else:
        out = flags.agg(*counts).withColumn("segment", F.lit(overall))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return out.select(
        "segment", "tp", "fp", "fn", "tn", F.bround(ratio(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"),
        F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"),
        F.bround(ratio(F.lit(2.0) * precision * recall, precision + recall), 4).alias("f1"))


def category_accuracy(df: DataFrame) -> DataFrame:
    right = (F.col("primary") == F.col("expected_category")) | F.coalesce(F.array_contains("acceptable", F.col("primary")), F.lit(False))
    return df.where("is_scam").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct")
    ).withColumn("accuracy", F.bround(F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0), 4))


def confusion_matrix(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Expected x predicted counts of scam rows, zero filled; one column per category."""
    cats = categories or [c for c in lx.CATEGORY_LABELS if c != "unknown"]
    scam = df.where(F.col("is_scam") & F.col("expected_category").isin(cats))
    return scam.groupBy("expected_category").pivot("primary", cats).agg(F.count(F.lit(1))).na.fill(0)


def band_compliance(df: DataFrame) -> DataFrame:
    judged = case_verdict(df) if "verdict" not in df.columns else df
    return judged.where("is_scam").agg(
        F.count(F.lit(1)).alias("band_total"), F.count_if(F.col("verdict") != "band_miss").alias("band_compliant"))


def misses(df: DataFrame) -> DataFrame:
    """Rows that are not ``ok``: false positives, false negatives, band misses, errors."""
    judged = case_verdict(df) if "verdict" not in df.columns else df
    return judged.where(F.col("verdict") != "ok")


def assert_baseline(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics that differ from the stored baseline.  Both tables: ``metric``, ``value``."""
    b = baseline.select("metric", F.col("value").alias("expected"))
    return b.join(measured.select("metric", "value"), "metric", "left").where(~F.col("value").eqNullSafe(F.col("expected")))


def corpus_composition(df: DataFrame) -> DataFrame:
    """Cases by input type, class and kind of note."""
    note = F.coalesce(F.col("note"), F.lit(""))
    kind = F.when(note.contains("HARD NEGATIVE"), "hard_negative").when(note.contains("HARD POSITIVE"), "hard_positive").otherwise("plain")
    return df.groupBy("input_type", "is_scam", "expected_category", kind.alias("note_kind")).agg(F.count(F.lit(1)).alias("n"))


def model_metrics(df: DataFrame, label: str = "label", score: str = "probability", threshold: float = 0.5) -> DataFrame:
    """Confusion counts and rates of a scored hold-out set, with ROC AUC."""
    from .datasets import roc_auc

    judged = df.select((F.col(label) == "scam").alias("is_scam"), F.when(F.col(score) >= threshold, "HIGH").otherwise("LOW").alias("level"),
                       F.col(score).alias("score_"))
    auc = roc_auc(judged, "score_", F.col("is_scam"))
    return binary_metrics(judged, by=None).drop("segment").withColumn("_one", F.lit(1)).join(
        auc.withColumn("_one", F.lit(1)), "_one").drop("_one")
