"""Labelled data: validation, contamination guard, de-duplication, statistics, splits, thresholds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import lexicon as lx
from ..functions.text import collapse_key, strip
from .reputation import feed_join

# FIXED VALUES: accepted labels and category names a benign row may carry.
VALID_LABELS = ["scam", "benign"]
BENIGN_CATEGORIES = ["benign", "unknown", "other"]
KNOWN_CATEGORIES = [*lx.CATEGORY_LABELS, "benign", "other"]


def field(df: DataFrame, *names: str) -> Column:
    """The first non-blank value among column aliases, stripped; '' when there is none."""
    present = [n for n in names if n in df.columns]
    values = [F.when(strip(F.col(n).cast("string")) != "", strip(F.col(n).cast("string"))) for n in present]
    return F.coalesce(*values, F.lit(""))


def canonical_rows(df: DataFrame) -> DataFrame:
    """Resolve column aliases and lower-case the label; other columns pass through."""
    cols = {c: field(df, c) for c in lx.DATASET_COLUMNS}
    cols["label"] = F.lower(field(df, "label"))
    cols["scam_category"] = field(df, "scam_category", "category")
    cols["urls"] = field(df, "urls", "url")
    rest = [c for c in df.columns if c not in cols and c not in ("category", "url")]
    return df.select(*rest, *[v.alias(k) for k, v in cols.items()])


def validate_dataset(df: DataFrame, require_categories: bool = True) -> DataFrame:
    """``errors``: what is wrong with each row (empty when it is valid).  Expects canonical rows."""
    label, category, conf = F.col("label"), F.col("scam_category"), F.col("annotation_confidence")
    number = conf.try_cast("double")
    missing_category = F.when((category == "") & (label == "scam"), "scam row missing scam_category") if require_categories \
        else F.lit(None).cast("string")
    return df.withColumn("errors", F.array_compact(F.array(
        F.when((F.col("text") == "") & (F.col("urls") == ""), "no content"),
        F.when(label == "", "missing label").when(~label.isin(VALID_LABELS), "invalid label"),
        F.when((category != "") & ~category.isin(KNOWN_CATEGORIES), "unknown scam_category")
        .when((category != "") & (label == "benign") & ~category.isin(BENIGN_CATEGORIES), "benign row has scam category"),
        missing_category,
        F.when((conf != "") & number.isNull(), "annotation_confidence not numeric")
        .when((conf != "") & ~number.between(0.0, 1.0), "annotation_confidence out of range"),
    )))


def contamination_guard(df: DataFrame, evaluation_ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(clean rows, rows whose id belongs to the evaluation set)."""
    ids = evaluation_ids.select(F.col(evaluation_ids.columns[0]).cast("string").alias(key)).where(F.col(key) != "").distinct()
    spread = F.struct(*df.columns)  # rows that share an id, or have none, must not meet in one task
    flagged = feed_join(df, ids.withColumn("_seen", F.lit(True)), key, spread, "left")
    return flagged.where("_seen is null").select(df.columns), flagged.where("_seen").select(df.columns)


def refuse_evaluation_path(path: str, evaluation_dir: str) -> None:
    import posixpath

    norm = lambda p: posixpath.normpath(p.split("://", 1)[-1])
    if (norm(path) + "/").startswith(norm(evaluation_dir) + "/"):
        raise ValueError("the evaluation corpus must never be loaded as training data")


def dedup_key(order: str) -> Column:
    text = collapse_key(F.col("text"))
    return (
        F.when(F.col("id") != "", F.sha2(F.concat(F.lit("id:"), F.col("id")), 256))
        .when(text != "", F.sha2(F.concat(F.lit("text:"), text), 256))
        .otherwise(F.concat(F.lit("row:"), F.col(order).cast("string")))
    )


def dedup_first(df: DataFrame, order: str = "ord") -> DataFrame:
    """Keep the first row per id, or per normalised text where there is no id.  ``order`` is unique.

    Only keys and order values are aggregated (hashed, combined on the map side);
    whole rows are neither sorted nor shuffled for it.
    """
    first = df.groupBy(dedup_key(order).alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def dataset_stats(df: DataFrame) -> DataFrame:
    """Row counts by label, category, language and source, one line per value; blanks are left out."""
    keys = ["label", "scam_category", "language", "source"]
    sets = df.select(*keys).groupingSets([[F.col(k)] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"g_{k}") for k in keys])
    kind = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.lit(k)) for k in keys])
    value = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.col(k)) for k in keys])
    return sets.select(kind.alias("dimension"), value.alias("value"), "n").where(F.col("value") != "")


def dataset_totals(raw: DataFrame, valid: DataFrame, kept: DataFrame, malformed: int = 0) -> DataFrame:
    """One line: totals before and after validation and de-duplication."""
    t = raw.agg(F.count(F.lit(1)).alias("total_rows"))
    v = valid.agg(F.count(F.lit(1)).alias("valid_rows"))
    k = kept.agg(F.count(F.lit(1)).alias("rows_after_dedup"), F.count_if(F.col("urls") != "").alias("url_present"),
                 F.count_if(F.col("id") != "").alias("id_present"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(t).join(one(v), "_one").join(one(k), "_one").drop("_one").withColumns({
        "duplicates_removed": F.col("valid_rows") - F.col("rows_after_dedup"), "malformed_rows": F.lit(malformed)})


def split_hash(key: str, seed: int) -> Column:
    """60 hash bits of a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, key: str = "ord", label: str = "label", test: float = 0.2, val: float = 0.1,
                     seed: int = 42, bits: int = 16) -> DataFrame:
    """``split``: train / val / test with exact shares per label, reproducible for a seed.

    ``key`` is unique and never blank.  Rows are ordered by a seeded hash.  A
    histogram over the leading hash bits finds the one bin per label in which each
    cut falls, the rows of those bins give the exact cut, and the split itself is a
    comparison with the label's two cuts: no row is moved for it.
    """
    rows = df.withColumn("_h", split_hash(key, seed)).withColumn("_bin", F.shiftright("_h", 60 - bits))
    bins = rows.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("n"))
    by_bin = W.partitionBy(label).orderBy("_bin")  # at most 2^bits rows per label
    cum = bins.withColumns({"upto": F.sum("n").over(by_bin), "total": F.sum("n").over(W.partitionBy(label))})
    cum = cum.withColumn("before", F.col("upto") - F.col("n"))
    cut_test = F.ceil(F.col("total") * F.lit(test))
    cut_val = cut_test + F.ceil(F.col("total") * F.lit(val))
    holds = lambda c: (F.col("before") < c) & (F.col("upto") >= c)
    near = cum.groupBy(label).agg(
        F.max(F.when(holds(cut_test), F.struct("_bin", (cut_test - F.col("before")).alias("need")))).alias("t"),
        F.max(F.when(holds(cut_val), F.struct("_bin", (cut_val - F.col("before")).alias("need")))).alias("v"),
    )
    edge = rows.select(label, "_h", "_bin", key).join(F.broadcast(near), label).where(  # one row per label
        (F.col("_bin") == F.col("t._bin")) | (F.col("_bin") == F.col("v._bin")))
    ranked = edge.withColumn("_rank", F.row_number().over(W.partitionBy(label, "_bin").orderBy("_h", key)))
    here = lambda c: (F.col("_bin") == F.col(f"{c}._bin")) & (F.col("_rank") == F.col(f"{c}.need"))
    cuts = ranked.groupBy(label).agg(*[F.max(F.when(here(c), F.struct("_h", key))).alias(f"_{c}") for c in ("t", "v")])
    at = F.struct("_h", F.col(key))
    return rows.join(F.broadcast(cuts), label, "left").withColumn(
        "split", F.when(at <= F.col("_t"), "test").when(at <= F.col("_v"), "val").otherwise("train")).drop("_h", "_bin", "_t", "_v")


def sequence_numbers(df: DataFrame, order: str, name: str = "seq", width: int = 1 << 20) -> DataFrame:
    """1, 2, 3, ... in the order of an integer column, without a global sort.

    Rows are ranked within ranges of ``width`` order values; the number of rows
    in earlier ranges is added from a small table.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_rank", rank).join(offsets, "_range").withColumn(
        name, F.col("_offset") + F.col("_rank")).drop("_range", "_rank", "_offset")


def score_ranks(df: DataFrame, score: str, positive: Column, slots: int = 1 << 14) -> DataFrame:
    """Positives and negatives at each distinct score, of all lower scores (``pos_below``, ``neg_below``) and of all, exactly.

    Scores in 0..1 are dealt into slots; a small table of slot totals carries the sums over, so no task orders all scores.
    """
    at = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    at = at.withColumn("_slot", F.floor(F.col("score") * slots))
    per = at.groupBy("_slot").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    lower = W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)  # at most slots + 1 rows
    zero = F.lit(0)
    every = W.partitionBy(F.lit(1))
    carried = per.select("_slot", F.coalesce(F.sum("p").over(lower), zero).alias("p"), F.coalesce(F.sum("n").over(lower), zero).alias("n"),
                         F.sum("p").over(every).alias("all_pos"), F.sum("n").over(every).alias("all_neg"))
    inside = W.partitionBy("_slot").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    return at.join(F.broadcast(carried), "_slot").select(
        "score", "pos", "neg", (F.col("p") + F.coalesce(F.sum("pos").over(inside), zero)).alias("pos_below"),
        (F.col("n") + F.coalesce(F.sum("neg").over(inside), zero)).alias("neg_below"), "all_pos", "all_neg")


def best_threshold(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """The score threshold (predict positive at or above it) with the highest F1; lowest one on ties."""
    curve = score_ranks(df, score, positive)
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    f1 = F.lit(2.0) * tp / (tp + fp + F.col("all_pos"))
    best = curve.select(f1.alias("f1"), "score").agg(F.max(F.struct("f1", (-F.col("score")).alias("low"))).alias("b"))
    return best.where("b is not null").select((-F.col("b.low")).alias("threshold"), F.bround("b.f1", 6).alias("f1"))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve from rank sums; ties count half."""
    return score_ranks(df, score, positive).agg(F.bround(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg")), 6).alias("roc_auc"))
