"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes and rows are summed per slot;
a small versioned table maps slots to shards.  Rebalancing edits that table and
never rehashes a record.
"""
from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

#: Fixed for good: a record's slot must not change.
SLOTS = 8192
#: Bytes that a record costs besides its text.
OVERHEAD = 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + OVERHEAD; null text: OVERHEAD), text_crc32 (null text: 0), vslot.

    A row without an id goes by its text, so that such rows do not share one slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.when(F.col(id_col).isNotNull(), slot_of(F.col(id_col), slots)), slot_of(text, slots)).alias("vslot"))


def slot_weights(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any: at most SLOTS rows reach the driver."""
    return {r[0]: (r[1], r[2]) for r in recs.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()}


def first_map(weights: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: the heaviest slot first, always to the lightest shard; empty slots are dealt in turn."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        if not weights.get(slot):
            out[slot] = slot % shards
            continue
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return out


def rebalance(old: dict[int, int], weights: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The edited map: few slots move, each from the fullest shard to the emptiest, until none is emptier than ``tolerance`` below the mean.

    A new shard (``shards`` one more than before) therefore takes slots only into itself, since the others start above the mean.
    Slots of shards that no longer exist move first.  Stops where no single move narrows the gap.
    """
    new = dict(old)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    load = dict.fromkeys(range(shards), 0)
    orphans = []
    for slot, shard in sorted(old.items()):
        if shard < shards:
            held[shard].append(slot)
            load[shard] += weights.get(slot, 0)
        else:
            orphans.append(slot)

    def give(slot: int, to: int) -> None:
        new[slot] = to
        held[to].append(slot)
        load[to] += weights.get(slot, 0)

    for slot in sorted(orphans, key=lambda s: (-weights.get(s, 0), s)):
        give(slot, min(load, key=lambda s: (load[s], s)))
    mean = sum(load.values()) / shards
    while True:
        low, high = min(load, key=lambda s: (load[s], s)), max(load, key=lambda s: (load[s], -s))
        gap = load[high] - load[low]
        if load[low] >= (1 - tolerance) * mean:
            return new
        fits = [s for s in held[high] if 0 < weights.get(s, 0) < gap]
        if not fits:
            return new
        slot = min(fits, key=lambda s: (abs(weights[s] - gap / 2), s))
        held[high].remove(slot)
        load[high] -= weights[slot]
        give(slot, low)


def save_map(spark: SparkSession, mapping: dict[int, int], version: int, path: str) -> None:
    """Add a version (slots rows) to the stored map; saving a version again replaces it."""
    spark.createDataFrame(sorted(mapping.items()), "vslot int, shard int").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """vslot, shard, version of one version (default: the newest)."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).head()[0]
    return every.where(F.col("version") == version)


def shard_starts(mapping: dict[int, int], rows: dict[int, int]) -> list[tuple[int, int, int]]:
    """vslot, shard, rows of the same shard in earlier slots."""
    seen: dict[int, int] = {}
    out = []
    for slot, shard in sorted(mapping.items()):
        out.append((slot, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + rows.get(slot, 0)
    return out


def place(spark: SparkSession, recs: DataFrame, mapping: dict[int, int], rows: dict[int, int]) -> DataFrame:
    """Records with shard and slot (their gapless place in it, from 0).

    Places are numbered inside virtual slots, thousands of small groups, and
    shifted by the rows of earlier slots; no shard is ever sorted as a whole.
    The broadcast map has exactly SLOTS rows.  Records that tie (same id, size
    and text) take neighbouring places in any order.
    """
    starts = spark.createDataFrame(shard_starts(mapping, rows), "vslot int, shard int, start long")
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return recs.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("start") + F.row_number().over(order) - 1).drop("start")


def shard_documents(docs: DataFrame, shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot: shards of near-equal bytes by a map stored as version 1 under ``map_path``.

    Records hash by id, so a hot source or group of equal texts spreads over all slots.  Empty table: no rows.
    """
    spark, recs = docs.sparkSession, records(docs, id_col, text_col)
    weights = slot_weights(recs)
    save_map(spark, first_map({s: w[0] for s, w in weights.items()}, shards), 1, map_path)
    mapping = {r["vslot"]: r["shard"] for r in load_map(spark, map_path, 1).collect()}  # SLOTS rows
    return place(spark, recs, mapping, {s: w[1] for s, w in weights.items()})
