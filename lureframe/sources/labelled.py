"""Readers for labelled data and evaluation cases."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import collapse_key, strip
from ..operators.datasets import sequence_numbers

EVAL_SCHEMA = (
    "id string, input_type string, text string, urls array<string>, "
    "expected struct<is_scam boolean, primary_category string, minimum_risk_level string, "
    "acceptable_categories array<string>, note string>"
)


#: Rows of one file split that keep numbers of their own.
SPLIT_ROWS = 1 << 33


def in_reading_order(rows: DataFrame, within=None, name: str = "ord") -> DataFrame:
    """``name``: rising in the order of file names, file splits and rows, whatever tasks the splits went to.

    ``rows`` come straight from a file scan.  The running id of a task rises inside a split; splits are numbered in a
    table of one row each.  ``within`` replaces the running id where a row of the scan holds several.
    """
    at = {"_file": F.input_file_name(), "_block": F.input_file_block_start(), "_row": F.monotonically_increasing_id()}
    placed = rows.withColumns(at)
    splits = placed.select("_file", "_block").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file", "_block")) - 1)
    row = F.col("_row").bitwiseAND(SPLIT_ROWS - 1) if within is None else within
    return placed.join(F.broadcast(splits), ["_file", "_block"]).withColumn(
        name, F.col("_no").cast("bigint") * SPLIT_ROWS + row).drop(*at, "_no")


def _spread(rows: DataFrame, names: list[str]) -> DataFrame:
    """Object texts -> one string column per name, plus ``malformed`` for non-objects."""
    parsed = rows.withColumn("_m", F.from_json("item", T.MapType(T.StringType(), T.StringType())))
    cols = [F.coalesce(F.col("_m")[n], F.lit("")).alias(n) for n in names]
    return parsed.select("ord", F.col("_m").isNull().alias("malformed"), *cols)


def read_labelled(spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None,
                  multiline: bool = True) -> DataFrame:
    """CSV, JSON (a list, or an object with ``rows``) or JSON lines, every value as text.

    Adds ``ord`` (reading order) and ``malformed``.  ``multiline=False`` lets Spark
    split CSV files; a JSON list is one document and is read by one task, so use
    JSON lines for large data.
    """
    from ..lexicon import DATASET_COLUMNS

    names = columns or [*DATASET_COLUMNS, "category", "url"]
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, multiLine=multiline, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False)
        named = [(c, c.replace("\ufeff", "").strip()) for c in raw.columns]
        cols = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in named if n]
        return in_reading_order(raw.select(F.lit(False).alias("malformed"), *cols)).select(
            "ord", "malformed", *[n for _, n in named if n])
    if fmt == "json":
        docs = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", T.ArrayType(T.StringType()))
        inside = F.from_json(F.get_json_object("value", "$.rows"), T.ArrayType(T.StringType()))
        files = in_reading_order(docs, F.lit(0))  # one row each
        items = files.select("ord", F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(inside)).alias("_pos", "item"))
        return _spread(items.withColumn("ord", F.col("ord") + F.col("_pos")), names)
    if fmt in ("jsonl", "ndjson"):
        lines = in_reading_order(spark.read.text(path)).where(strip(F.col("value")) != "")
        return _spread(lines.select("ord", F.col("value").alias("item")), names)
    raise ValueError(f"unsupported dataset format: {fmt} (use csv, json or jsonl)")


# FIXED VALUES: label names of the SMS corpus and the id format of its rows.
SMS_LABELS = {"ham": "benign", "spam": "scam"}
SMS_ID = "sms-uci-%05d"


def parse_tsv_labelled(lines: DataFrame, label_map: dict[str, str] = SMS_LABELS, id_format: str = SMS_ID,
                       line: str = "value", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """``label<TAB>text`` lines -> (rows with sequential ids, malformed lines).  Exact copies are dropped."""
    cut = F.instr(F.col(line), "\t")
    parts = lines.where(strip(F.col(line)) != "").select(
        F.col(order), F.col(line),
        F.when(cut > 0, strip(F.substring_index(F.col(line), "\t", 1))).alias("raw_label"),
        F.when(cut > 0, strip(F.expr(f"substring({line}, instr({line}, '\\t') + 1)"))).alias("text"),
    )
    good = F.coalesce(F.col("raw_label").isin(list(label_map)) & (F.col("text") != ""), F.lit(False))
    first = parts.where(good).groupBy(F.sha2(collapse_key(F.col("text")), 256).alias("_key")).agg(F.min(order).alias(order)).select(order)
    numbered = sequence_numbers(parts.where(good).join(first, order, "left_semi"), order)
    mapping = F.create_map(*[x for k, v in label_map.items() for x in (F.lit(k), F.lit(v))])
    rows = numbered.select(
        F.format_string(id_format, F.col("seq")).alias("id"), "text", mapping[F.col("raw_label")].alias("label"),
        F.lit("").alias("scam_category"), F.lit("sms").alias("source"), F.lit("en").alias("language"), F.lit("").alias("timestamp"),
        F.lit("").alias("annotation_confidence"), F.lit("SMS spam corpus").alias("notes"), order)
    return rows, parts.where(~good)


def read_tsv_labelled(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    lines = in_reading_order(spark.read.text(path)).select("value", "ord")
    return parse_tsv_labelled(lines, **options)


def read_eval_corpus(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Evaluation cases (a JSON list, or JSON lines with ``multiline=False``) with the expectation flattened."""
    cases = spark.read.schema(EVAL_SCHEMA).json(path, multiLine=multiline)
    if cases.isEmpty():
        raise ValueError(f"evaluation corpus is empty: {path}")
    return cases.select(
        "id", "input_type", "text", F.coalesce("urls", F.expr("cast(array() as array<string>)")).alias("urls"),
        F.col("expected.is_scam").alias("is_scam"), F.col("expected.primary_category").alias("expected_category"),
        F.col("expected.minimum_risk_level").alias("min_level"), F.col("expected.acceptable_categories").alias("acceptable"),
        F.col("expected.note").alias("note"))
