"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a window of words: hashes take the masked positions
and ignore the others, so a replaced word at an ignored position does not break
the hit.  Seeds of benchmark and documents are joined; a diagonal with a hit
is compared word by word, and the best stretch of matches (a mismatch costs one
match) must be long enough.

An overlap of score 10 with m replaced words holds a stretch of 10 + m matches and m
mismatches between a match at either end.  The first two masks were found by a search over
all masks of weight 5 for the smallest family that hits every such stretch with m up to 4;
they hit 99.85 % of those with 5 and 99.6 % of those with 6 (tests count them).  The third hits texts with
every third word replaced, at any length.  Items of fewer words than the score count where
all their words stand in a row, by a hash of the whole item.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bind import let
from .common import if_small, row_keys, stored

#: Masks: 1 counts, 0 is ignored.
MASKS = ("110111", "10001111", "11011011")
#: Matches less mismatches of the best stretch that make an overlap.
MIN_SCORE = 10
#: Benchmark seeds up to this many rows are broadcast (about 32 bytes each); more are joined by shuffle.
BROADCAST_SEEDS = 500_000


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _seed(hashes: Column, number: int, mask: str):
    taken = [k for k, c in enumerate(mask) if c == "1"]

    def at(i: Column) -> Column:
        return F.struct(i.alias("place"), F.xxhash64(F.lit(number), *[F.get(hashes, i + k) for k in taken]).alias("hash"))

    return at


def seeds(words: Column, masks: Sequence[str] = MASKS, runs: Sequence[int] = ()) -> Column:
    """Array of (place, hash) for every place of every mask; texts shorter than a mask have none of it.

    ``runs``: lengths of whole items, each a mask without ignored positions (its hash differs from that of any mask in ``masks``).
    """
    every = [*enumerate(masks), *((1000 + n, "1" * n) for n in runs)]

    def of(b: Column) -> Column:
        hashes = b["h"]
        parts = []
        for m, mask in every:
            last = F.size(hashes) - len(mask)
            empty = F.expr("cast(array() as array<struct<place:int,hash:bigint>>)")
            parts.append(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), _seed(hashes, m, mask))).otherwise(empty))
        return F.concat(*parts)

    return let(of, h=F.transform(words, lambda w: F.xxhash64(w)))


def best_stretch(a: Column, b: Column) -> Column:
    """Highest (matches - mismatches) of any stretch of two aligned word arrays, with the words it spans: (score, start, end)."""

    def of(x: Column) -> Column:
        pairs = F.zip_with(x["a"], x["b"], lambda p, q: F.when(p == q, F.lit(1)).otherwise(F.lit(-1)))
        zero = F.lit(0)
        state = F.struct(zero.alias("run"), zero.alias("from"), zero.alias("at"), zero.alias("score"), zero.alias("start"), zero.alias("end"))

        def step(s: Column, v: Column) -> Column:
            run = F.greatest(s["run"], zero) + v
            begin = F.when(s["run"] > 0, s["from"]).otherwise(s["at"])
            better = run > s["score"]
            return F.struct(run.alias("run"), begin.alias("from"), (s["at"] + 1).alias("at"),
                            F.when(better, run).otherwise(s["score"]).alias("score"),
                            F.when(better, begin).otherwise(s["start"]).alias("start"),
                            F.when(better, s["at"] + 1).otherwise(s["end"]).alias("end"))

        return F.aggregate(pairs, state, step, lambda s: F.struct(s["score"], s["start"], s["end"]))

    return let(of, a=a, b=b)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, min_score: int = MIN_SCORE,
             id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """k1, k2 (key of the row's id and text), doc_id, item_id, score, doc_from, doc_to, item_from: verified overlaps.

    Places are word numbers, ends exclusive; one row per (document, item, diagonal) that has a hit and reaches ``min_score``.
    An item of fewer words than that needs all of them in a row; its score is their number.  Empty and null texts and items
    have no words and no overlaps.  Equal rows share one key.  An item without an id counts like any other.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(*row_keys("doc_id", "text"), "doc_id", "text")
    items = benchmark.select(F.col(item_id).alias("item_id"), normal_words(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0).distinct()
    items = stored(items.withColumn("item_key", F.xxhash64("item_id", "item_words")), "items")
    short = F.size("item_words") < min_score
    runs = sorted(r["n"] for r in items.where(short).select(F.size("item_words").alias("n")).distinct().collect())  # fewer than min_score
    whole = [F.when(F.size("item_words") == n, seeds(F.col("item_words"), (), [n])) for n in runs]
    keys = items.select("item_key", F.explode(F.coalesce(*whole, F.when(~short, seeds(F.col("item_words"), masks)), F.expr("cast(null as array<struct<place:int,hash:bigint>>)"))).alias("s"))
    keys = stored(keys.select("item_key", F.col("s.place").alias("item_place"), F.col("s.hash").alias("hash")), "seeds")
    few = keys.count() <= BROADCAST_SEEDS
    spots = rows.select("k1", "k2", F.explode(seeds(normal_words(F.col("text")), masks, runs)).alias("s")).select(
        "k1", "k2", F.col("s.place").alias("place"), F.col("s.hash").alias("hash"))
    hits = spots.join(F.broadcast(keys) if few else keys, "hash").select(
        "k1", "k2", "item_key", (F.col("place") - F.col("item_place")).alias("shift"))
    found = stored(hits.distinct(), "hits")
    # only texts with a hit are opened again; each is cut to the stretch beside the item
    near = rows.join(if_small(stored(found.select("k1", "k2").distinct(), "near")), ["k1", "k2"], "left_semi").select(
        "k1", "k2", "doc_id", normal_words(F.col("text")).alias("words"))
    pairs = near.join(found, ["k1", "k2"]).join(items, "item_key")
    low = F.greatest(F.col("shift"), F.lit(0))
    span = F.least(F.size("words") - low, F.size("item_words") - (low - F.col("shift")))
    cut = pairs.select("k1", "k2", "doc_id", "item_id", F.least(F.size("item_words"), F.lit(min_score)).alias("least"), low.alias("low"), (low - F.col("shift")).alias("item_low"),
                       F.slice("words", low + 1, span).alias("a"), F.slice("item_words", low - F.col("shift") + 1, span).alias("b"))
    best = cut.select("k1", "k2", "doc_id", "item_id", "least", "low", "item_low", best_stretch(F.col("a"), F.col("b")).alias("s"))
    return best.where(F.col("s.score") >= F.col("least")).select(
        "k1", "k2", "doc_id", "item_id", F.col("s.score").alias("score"), (F.col("low") + F.col("s.start")).alias("doc_from"),
        (F.col("low") + F.col("s.end")).alias("doc_to"), (F.col("item_low") + F.col("s.start")).alias("item_from")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, score (of the best overlap), doc_from, doc_to: one row per document and benchmark item that overlap.

    Documents that share an id count as one.  Ties of the score: the earliest place.
    """
    best = F.max_by(F.struct("score", "doc_from", "doc_to"), F.struct("score", -F.col("doc_from"), -F.col("doc_to")))
    return overlaps(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without any overlap, columns unchanged."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = stored(overlaps(docs, benchmark, **options).select("k1", "k2").distinct(), "leaks")
    names = docs.columns
    key1, key2 = (k for k in row_keys(id_col, text_col))
    keyed = docs.select("*", key1.alias("_k1"), key2.alias("_k2"))
    return keyed.join(if_small(bad), (F.col("_k1") == bad["k1"]) & (F.col("_k2") == bad["k2"]), "left_anti").select(*[F.col(f"`{c}`") for c in names])
