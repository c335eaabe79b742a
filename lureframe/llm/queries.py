"""One query per operator: the Spark side and, where SQL can say it, the DuckDB side."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, filter_audit, hard_negatives, html_text, oracles, packing, quality, quality_fm, sharding, simhash, substring_dedup,
               suffix_tree_lm, token_files, url_reputation)
from .common import shared_path, stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return add


@register("op4_quality_cascade", oracles.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    order = [m.rule for m in quality.measure_rules(docs)]
    found = quality.measured(docs, keep=["doc_id"])
    base = quality.rejected(quality.BASE_RULES, quality.Rule.on_measures)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~quality.rejected(order, quality.Rule.on_measures)).alias("kept"), "n_lines", "n_capitals")


@register("op7_simple8b_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.token_ranges(stored(token_files.read_token_files(spark, path), "token-rows"))


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@register("op8_url_reputation", oracles.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of a page's number tells its outcome: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@register("op9_virtual_slots")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40, shared_path(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "vslot")


@register("op10_spaced_seeds", oracles.op10_sql(decontaminate.MASKS, decontaminate.MIN_SCORE))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "score")


@register("op5_simhash_anchors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


@register("op6_local_search_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op2_unit_hash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), removed="removed")
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return found.select("doc_id", "text", F.array_join(spans, ",").alias("removed_spans"),
                        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"))


@register("op3_suffix_tree_lm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = suffix_tree_lm.score_documents(spark, docs, ~held)
    return scored.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op1_nearest_url_differencing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@register("op11_factorisation_machine")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"), ~held)
    # only the id travels beside the text, and no score sees it
    narrow = docs.select("doc_id", held.alias("held_out"), "text", "n_chars")
    scored = quality_fm.score_quality(narrow, machine, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op12_l2ap_negatives", oracles.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


@register("op13_path_counting", oracles.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
