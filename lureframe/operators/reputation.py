"""Reputation feeds as joins.

Feeds are tables of any size.  A small feed is broadcast.  Of a larger one, only the
entries that some row may ask for are taken (a bloom filter of the asked keys tells),
and what is left is broadcast if that is small by count.  Else the two sides are
shuffled, and keys that a frequency sketch finds in too many rows are cut in parts: only
their rows get a salt, and only their entries are copied, once for each part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as uf
from ..functions.bind import unnest
from ..sources.derived import SMALL_ROWS, derived, if_small
from .signals import evidence

BROADCAST_LIMIT = 64 * 1024 * 1024
#: Rows of one key that a task may have; keys that the sketch follows, and the most that it reports.
KEY_ROWS, TRACKED, REPORTED = 1_000_000, 10_000, 1_000
#: Bits of a block of the bloom filter (a bitmap), bits set for a key, keys of a block, and blocks at most (8 MB in all).
BLOCK_BITS, KEY_BITS, BLOCK_KEYS, MAX_BLOCKS = 32_768, 4, 2_000, 2_048

# FIXED VALUES: verdict and status order, informative and anchoring verdicts.
VERDICT_RANK = {"safe": 0, "unknown": 1, "suspicious": 2, "malicious": 3}
STATUS_RANK = {"ok": 0, "error": 1, "unavailable": 2, "rate_limited": 3}
INFORMATIVE = ["safe", "suspicious", "malicious"]
ANCHORING = ["suspicious", "malicious"]


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame, from file sizes and plan statistics (huge when unknown)."""
    plan = getattr(df, "_jdf", None)
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes())) if plan is not None else 1 << 62


def hot_keys(left: DataFrame, on: str, most: int = KEY_ROWS) -> DataFrame:
    """key, parts: keys with more than ``most`` rows, by a mergeable sketch of frequent items; at most ``REPORTED`` of them.

    One pass over the key column with map-side sketches.  The sketch never underrates a key by more than rows / TRACKED.
    """
    found = left.where(F.col(on).isNotNull()).select(F.expr(f"approx_top_k(`{on}`, {REPORTED}, {TRACKED})").alias("top"))
    return found.select(F.explode("top").alias("t")).select(F.col("t.item").alias("key"), F.ceil(F.col("t.count") / most).cast("int").alias("parts")).where("parts > 1")


def _bloom_place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks)).cast("int"), [
        F.pmod(F.xxhash64(F.lit(k + 1), key), F.lit(BLOCK_BITS)) for k in range(KEY_BITS)]


def key_filter(keys: DataFrame, on: str) -> tuple[DataFrame, int]:
    """A blocked bloom filter of a key column as a table (block, bits) of at most 2,048 bitmaps of 4 KB, and its number of blocks.

    Bitmaps are built on the map side and merged, so the keys themselves are not shuffled.  Beyond four million keys the filter
    lets more pass; it never holds a key back.
    """
    distinct = keys.select(F.approx_count_distinct(on)).head()[0]
    blocks = max(1, min(MAX_BLOCKS, distinct // BLOCK_KEYS + 1))
    block, bits = _bloom_place(F.col(on), blocks)
    marks = keys.where(F.col(on).isNotNull()).select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    return marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), blocks


def may_be_asked(feed: DataFrame, on: str, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``feed`` whose key may be in the filter (all that are, and few others)."""
    block, bits = _bloom_place(F.col(on), blocks)

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    found = feed.withColumn("block", block).join(F.broadcast(bitmaps), "block")  # 8 MB at most
    for bit in bits:
        found = found.where(is_set(bit))
    return found.select(feed.columns)


def feed_join(left: DataFrame, feed: DataFrame, on: str, spread: Column, how: str = "left",
              limit: int = BROADCAST_LIMIT, small: int = SMALL_ROWS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Join a fact table to a feed on one key without a hot task, whatever the sizes are (``how``: left, inner or left_anti).

    ``spread`` is any evenly distributed column of the fact side (its row id).  A feed above ``limit`` bytes is first cut down
    to what is asked for and written; up to ``small`` rows of that are broadcast.  Beyond, a key with more than ``key_rows`` rows
    of the fact side is cut into parts of that size and its feed rows are copied that often; all other feed rows are there once.
    """
    if estimated_bytes(feed) <= limit:
        return left.join(F.broadcast(feed), on, how)
    asked = derived(may_be_asked(feed, on, *key_filter(left, on)), "asked-feed")
    if asked.count() <= small:
        return left.join(F.broadcast(asked), on, how)
    hot = derived(hot_keys(left, on, key_rows), "hot-keys").withColumnRenamed("key", on)  # REPORTED rows at most
    parts = F.coalesce(F.col("parts"), F.lit(1))
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts")
    return salted.join(copied(asked, hot, on), [on, "_salt"], how).drop("_salt")


def copied(feed: DataFrame, hot: DataFrame, on: str) -> DataFrame:
    """Feed rows with ``_salt``: those of hot keys once for each part, all others once."""
    parts = F.coalesce(F.col("parts"), F.lit(1))
    return feed.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")


def rank_of(c: Column, order: dict[str, int], default: int = 1) -> Column:
    out = F.lit(default)
    for name, rank in order.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def severity_from_score(score: Column) -> Column:
    return F.when(score >= 0.7, "critical").when(score >= 0.45, "high").when(score >= 0.2, "medium").otherwise("low")


def provider_status(http: Column) -> Column:
    return F.when(http == 429, "rate_limited").when((http >= 500) & (http < 600), "unavailable").otherwise("error")


def split_lookupable(df: DataFrame, url: str = "url") -> DataFrame:
    """``lookup_status`` / ``lookup_verdict``: malformed URLs are errors, never clean results."""
    ok = uf.lookupable(F.col(url))
    return df.withColumns({
        "lookupable": ok,
        "lookup_status": F.when(ok, "ok").otherwise("error"),
        "lookup_verdict": F.lit("unknown"),
    })


def _listed_hosts(urls: DataFrame, feed: DataFrame) -> DataFrame:
    """host and category of the distinct hosts that the feed lists, by themselves or by the nearest parent domain."""
    hosts = urls.select("host").where("host is not null").distinct()
    keyed = unnest(hosts, uf.suffixes_of(F.col("host")), "host", pos="depth", item="entry")
    return feed_join(keyed, feed, "entry", F.struct("host", "depth"), how="inner").groupBy("host").agg(
        F.min_by("category", "depth").alias("category"))


def blocklist_join(urls: DataFrame, blocklist: DataFrame, id_col: str = "url_id") -> DataFrame:
    """Verdict per URL: suspicious when the host or any parent domain is listed, else unknown.

    ``blocklist`` has columns ``entry`` (domain) and ``category``.  Distinct hosts
    are looked up; occurrences then meet the listed hosts only.
    """
    feed = blocklist.groupBy("entry").agg(F.min("category").alias("category"))  # of several rows of one entry: the first by name
    out = feed_join(urls, _listed_hosts(urls, feed), "host", F.col(id_col))
    listed = F.col("category").isNotNull()
    return out.withColumns({
        "provider": F.lit("mock"), "is_mock": F.lit(True),
        "verdict": F.when(listed, "suspicious").otherwise("unknown"), "status": F.lit("ok"),
        "risk_score": F.when(listed, 0.85).otherwise(0.0),
        "reputation": F.when(listed, "listed in demo blocklist").otherwise("no demo reputation record"),
        "categories": F.when(listed, F.array("category")).otherwise(F.expr("cast(array() as array<string>)")),
        "hits": F.when(listed, 1).otherwise(0),
    }).drop("category")


def threatlist_verdicts(urls: DataFrame, matches: DataFrame, key: str = "host", id_col: str = "url_id") -> DataFrame:
    """Any match on the list is malicious; none is safe.  ``matches``: ``key``, ``threat_type``."""
    per_key = matches.groupBy(key).agg(
        F.sort_array(F.collect_set("threat_type")).alias("categories"), F.count(F.lit(1)).cast("int").alias("hits"))
    out = feed_join(urls, per_key, key, F.col(id_col))
    listed = F.col("hits").isNotNull()
    return out.withColumns({
        "provider": F.lit("threat_list"), "is_mock": F.lit(False), "status": F.lit("ok"),
        "verdict": F.when(listed, "malicious").otherwise("safe"),
        "risk_score": F.when(listed, 0.95).otherwise(0.05),
        "categories": F.coalesce("categories", F.expr("cast(array() as array<string>)")),
        "hits": F.coalesce("hits", F.lit(0)),
    })


def engine_stats_verdicts(urls: DataFrame, stats: DataFrame, key: str = "host", id_col: str = "url_id") -> DataFrame:
    """Verdict from engine counts.  ``stats``: ``key``, malicious, suspicious, harmless, undetected."""
    one = stats.groupBy(key).agg(*[F.max(c).alias(c) for c in ("malicious", "suspicious", "harmless", "undetected")])
    out = feed_join(urls, one, key, F.col(id_col))
    mal, sus = F.col("malicious"), F.col("suspicious")
    hits = mal + sus
    strong = (mal >= 1) | (sus >= 2)
    score = F.when(strong, F.lit(0.5) + F.lit(0.08) * F.least(hits, F.lit(6))).when(hits == 1, 0.45).otherwise(0.1)
    return out.withColumns({
        "provider": F.lit("engine_stats"), "is_mock": F.lit(False), "status": F.lit("ok"),
        "verdict": F.when(mal.isNull(), "unknown").when(strong & (mal >= 2), "malicious")
        .when(strong | (hits == 1), "suspicious").otherwise("safe"),
        "risk_score": F.when(mal.isNull(), 0.1).otherwise(F.bround(F.least(F.lit(0.98), score), 2)),
        "hits": F.coalesce(hits, F.lit(0)),
        "reputation": F.when(mal.isNull(), "not seen").otherwise(F.concat(
            mal.cast("string"), F.lit(" malicious / "), sus.cast("string"), F.lit(" suspicious out of "),
            (mal + sus + F.col("harmless") + F.col("undetected")).cast("string"), F.lit(" engines"))),
    })


def merge_verdicts(results: DataFrame, key: str = "url", order: str = "provider_ord") -> DataFrame:
    """One verdict per key from all providers: the worst by (verdict, risk), first provider on ties.

    Of several rows of one key and provider the worst counts, so the lists
    collected here are bounded by the number of feeds.  Failures never count as clean: the status is ``ok`` once any provider gave a
    real verdict, otherwise the worst failure.
    """
    ranked = results.withColumns({"_v": rank_of(F.col("verdict"), VERDICT_RANK), "_s": rank_of(F.col("status"), STATUS_RANK)})
    worst = F.struct("_v", "risk_score", "_s", "hits", "verdict", "status")
    ranked = ranked.groupBy(key, order).agg(F.max_by(F.struct(*[c for c in ranked.columns if c not in (key, order)]), worst).alias("r")).select(
        key, order, "r.*")
    best = F.struct("_v", "risk_score", (-F.col(order)).alias("_o"))
    informative = (F.col("status") == "ok") & F.col("verdict").isin(INFORMATIVE)
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "provider", "verdict", "status", "risk_score", "categories")))
    out = ranked.groupBy(key).agg(
        F.max_by(F.struct("verdict", "risk_score", "reputation", "error"), best).alias("worst"),
        F.bool_or(informative).alias("_ok"),
        F.max(F.when(F.col("status") != "ok", F.struct("_s", (-F.col(order)).alias("_o"), "status"))).alias("_failed"),
        F.sum("hits").alias("hits"), F.max("checked_at").alias("checked_at"),
        (~F.bool_or(~F.col("is_mock"))).alias("is_mock"), listed.alias("providers"),
    )
    return out.select(
        key,
        F.array_join("providers.provider", "+").alias("provider"),
        F.col("worst.verdict").alias("verdict"),
        F.when(F.col("_ok"), "ok").otherwise(F.coalesce("_failed.status", F.lit("ok"))).alias("status"),
        F.bround("worst.risk_score", 2).alias("risk_score"),
        F.col("worst.reputation").alias("reputation"), F.col("worst.error").alias("error"),
        F.array_distinct(F.flatten("providers.categories")).alias("categories"),
        "hits", "checked_at", "is_mock", "providers",
    )


def worst_per_entry(reputation: DataFrame) -> DataFrame:
    """entry, r: one verdict per feed entry, the worst by (verdict, risk, status), ties by provider and wording: no row order decides."""
    r = F.struct("verdict", "status", "risk_score", "is_mock", "provider", "reputation")
    worst = F.struct(rank_of(F.col("verdict"), VERDICT_RANK), F.col("risk_score"), rank_of(F.col("status"), STATUS_RANK), r)
    return reputation.groupBy("entry").agg(F.max_by(r, worst).alias("r"))


def attach_reputation(df: DataFrame, reputation: DataFrame | None, blocklist: list[str] | None = None) -> DataFrame:
    """``intel``: one verdict per URL of the message, aligned with ``url_facts``.

    Without a feed the constant ``blocklist`` is tested inside the row.  With a
    feed (``entry``, verdict, status, risk_score, is_mock, provider) only the
    URLs that are listed leave the row: they are joined, gathered per message and
    joined back on the message id.
    """
    from .. import lexicon as lx
    from ..functions.literals import str_array

    if reputation is None:
        listed = str_array(lx.DEMO_BLOCKLIST if blocklist is None else blocklist)

        def local(u):
            hit = F.arrays_overlap(u["suffixes"], listed)
            return F.struct(
                u["url"].alias("url"), u["host"].alias("host"), F.when(hit, "suspicious").otherwise("unknown").alias("verdict"),
                F.lit("ok").alias("status"), F.when(hit, 0.85).otherwise(0.0).alias("risk_score"), F.lit(True).alias("is_mock"),
                F.lit("mock").alias("provider"),
                F.when(hit, "listed in demo blocklist").otherwise("no demo reputation record").alias("reputation"),
            )

        return df.withColumn("intel", F.transform("url_facts", local))

    feed = worst_per_entry(reputation)
    per_link = unnest(df, F.col("url_facts.suffixes"), "msg_id", pos="i", item="s")
    asked = unnest(per_link, "s", "msg_id", "i", pos="depth", item="entry")
    listed = feed_join(asked, feed, "entry", F.struct("msg_id", "i"), how="inner")
    per_url = listed.groupBy("msg_id", "i").agg(F.min_by("r", "depth").alias("r"))
    per_msg = per_url.groupBy("msg_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("_intel"))
    # messages with a listed URL are few: their ids travel, whole messages only where those are too many
    joined = df.join(if_small(derived(per_msg, "listed-messages")), "msg_id", "left")

    def fed(u, i):
        r = F.try_element_at(F.col("_intel"), i)
        return F.struct(
            u["url"].alias("url"), u["host"].alias("host"), F.coalesce(r["verdict"], F.lit("unknown")).alias("verdict"),
            F.coalesce(r["status"], F.lit("ok")).alias("status"), F.coalesce(r["risk_score"], F.lit(0.0)).alias("risk_score"),
            F.coalesce(r["is_mock"], F.lit(False)).alias("is_mock"), F.coalesce(r["provider"], F.lit("feed")).alias("provider"),
            r["reputation"].alias("reputation"),
        )

    return joined.withColumn("intel", F.transform("url_facts", fed)).drop("_intel")


def intel_severity(verdict: Column) -> Column:
    return F.when(verdict == "malicious", "critical").when(verdict == "suspicious", "high").when(verdict == "safe", "low").otherwise("info")


def intel_evidence() -> Column:
    return F.transform("intel", lambda t: evidence(
        "threat_intelligence", F.concat(F.lit("threat_intel_"), t["verdict"]), intel_severity(t["verdict"]),
        F.least(F.lit(0.95), F.lit(0.3) + t["risk_score"]),
        F.concat(F.lit("Reputation"), F.when(t["is_mock"], " [DEMO]").otherwise(""), F.lit(" of "), t["host"], F.lit(": "),
                 t["verdict"], F.lit(" (provider "), t["provider"], F.lit(", status "), t["status"], F.lit(").")),
        url=t["url"], provider=t["provider"], verdict=t["verdict"], status=t["status"], risk_score=t["risk_score"]))


def intel_warnings() -> Column:
    failed = F.transform(F.filter("intel", lambda t: t["status"].isin("error", "unavailable")),
                         lambda t: F.concat(F.lit("Reputation lookup for "), t["host"], F.lit(" failed ("), t["status"], F.lit(").")))
    limited = F.transform(F.filter("intel", lambda t: t["status"] == "rate_limited"),
                          lambda t: F.concat(F.lit("Provider "), t["provider"], F.lit(" is rate-limited; no verdict for "), t["host"], F.lit(".")))
    demo = F.filter(F.array(F.when((F.size("intel") > 0) & F.forall("intel", lambda t: t["is_mock"]),
                            F.lit("Demo mode: verdicts come from the bundled blocklist, not from a live feed."))), lambda w: w.isNotNull())
    return F.concat(failed, limited, demo)
