"""Feeds, labelled data, stored results, streams: small fixtures against brute force."""
import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lureframe import lexicon as lx
from lureframe.operators import datasets as ds, evaluate as ev, history as hi, reputation as rep
from lureframe.sources import labelled as lab, results as res, synthetic as syn
from lureframe.streaming import rate_limit, triage_stream


def test_feed_join_gives_the_same_result_on_every_path(spark):
    left = spark.createDataFrame([(i, None if i % 50 == 7 else "hot" if i % 3 else f"k{i}") for i in range(300)], "id int, key string")
    feed = spark.createDataFrame([("hot", 1), ("k0", 2), ("unused", 3), ("k0", 4), (None, 5)], "key string, v int")
    for how in ("left", "inner", "left_anti"):
        small = rep.feed_join(left, feed, "key", F.col("id"), how)
        want = sorted(map(str, small.collect()))
        for options in (dict(limit=0), dict(limit=0, small=0), dict(limit=0, small=0, key_rows=40)):
            assert sorted(map(str, rep.feed_join(left, feed, "key", F.col("id"), how, **options).select(small.columns).collect())) == want, (how, options)


def test_feed_copies_follow_the_hot_keys(spark):
    left = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7000).cast("string"))).alias("key"))
    feed = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", -1)], "key string, v long"))
    hot = rep.hot_keys(left, "key", 1000)
    assert [tuple(r) for r in hot.collect()] == [("hot", 10)]
    bitmaps, blocks = rep.key_filter(left, "key")
    asked = rep.may_be_asked(feed, "key", bitmaps, blocks)
    assert left.join(asked, "key", "left_semi").count() == left.join(feed, "key", "left_semi").count()
    assert bitmaps.count() == blocks and asked.count() < 7001 + 0.01 * 200_000  # of 200,001 entries
    copies = rep.copied(asked, hot.withColumnRenamed("key", "key"), "key")
    assert copies.count() == asked.count() + 9 and copies.where("_salt > 0").select("key").distinct().count() == 1
    out = rep.feed_join(left, feed, "key", F.col("id"), limit=0, small=0, key_rows=1000)
    assert out.count() == 30_000 and out.where("key = 'hot' and v = -1").count() == 10_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = out.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) > 1 and max(r["count"] for r in rows) < 9000  # the hot key is in several tasks


def test_several_feed_rows_of_one_host(spark):
    from lureframe.plans.triage import triage

    msgs = spark.createDataFrame([(1, "see http://a.listed.example/x", [])], "msg_id int, text string, urls array<string>")
    rows = [("listed.example", v, "ok", s, False, p, "r") for v, s, p in (("safe", 0.05, "a"), ("malicious", 0.95, "b"), ("suspicious", 0.6, "c"))]
    for order in (rows, rows[::-1]):
        feed = spark.createDataFrame(order, "entry string, verdict string, status string, risk_score double, is_mock boolean, provider string, reputation string")
        got = triage(msgs, reputation=feed, with_report=False).select("intel").head()["intel"]
        assert [(t["verdict"], t["provider"]) for t in got] == [("malicious", "b")]
        block = spark.createDataFrame([(r[0], r[5]) for r in order], "entry string, category string")
        urls = spark.createDataFrame([(1, "a.listed.example")], "url_id int, host string")
        assert rep.blocklist_join(urls, block).head()["categories"] == ["a"]


def test_blocklist_covers_subdomains(spark):
    urls = spark.createDataFrame([(1, "a.bad.example"), (2, "bad.example"), (3, "notbad.example"), (4, "")], "url_id int, host string")
    block = spark.createDataFrame([("bad.example", "x"), ("bad.example", "x")], "entry string, category string")
    got = {r["url_id"]: r["verdict"] for r in rep.blocklist_join(urls, block).collect()}
    assert got == {1: "suspicious", 2: "suspicious", 3: "unknown", 4: "unknown"}


def test_merge_verdicts_failures_never_look_clean(spark):
    rows = [("u", 0, "p1", "unknown", "error", 0.0, [], 0), ("u", 1, "p2", "unknown", "rate_limited", 0.0, [], 0),
            ("v", 0, "p1", "safe", "ok", 0.05, [], 0), ("v", 1, "p2", "malicious", "ok", 0.95, ["A"], 2)]
    df = spark.createDataFrame(rows, "url string, provider_ord int, provider string, verdict string, status string, risk_score double, categories array<string>, hits int")
    df = df.withColumns({"reputation": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "checked_at": F.lit(None).cast("timestamp"), "is_mock": F.lit(False)})
    got = {r["url"]: r for r in rep.merge_verdicts(df).collect()}
    assert (got["u"]["verdict"], got["u"]["status"], got["u"]["risk_score"]) == ("unknown", "rate_limited", 0.0)
    assert (got["v"]["verdict"], got["v"]["status"], got["v"]["categories"], got["v"]["hits"]) == ("malicious", "ok", ["A"], 2)


def test_reputation_reaches_the_score(spark):
    from lureframe.plans.triage import triage

    msgs = spark.createDataFrame([(1, "see http://a.listed.example/x", []), (2, "see http://fine.example/x", [])], "msg_id int, text string, urls array<string>")
    feed = spark.createDataFrame([("listed.example", "malicious", "ok", 0.95, False, "f", "r")],
                                 "entry string, verdict string, status string, risk_score double, is_mock boolean, provider string, reputation string")
    got = {r["msg_id"]: r for r in triage(msgs, reputation=feed, with_report=False).select("msg_id", "level", "threat_intel").collect()}
    assert got[1]["threat_intel"] == 0.95 and got[1]["level"] != "LOW" and got[2]["threat_intel"] == 0.0


@pytest.mark.parametrize("fmt", ["csv", "json", "rows", "jsonl"])
def test_read_labelled(spark, tmp_path, fmt):
    data = [{"id": "1", "text": "a, \"b\"\nc", "label": "scam"}, {"id": "2", "text": "d", "label": "benign"}]
    path = tmp_path / f"x.{'json' if fmt == 'rows' else fmt}"
    if fmt == "csv":
        path.write_text('﻿id, text,label\n1,"a, ""b""\nc",scam\n2,d,benign\n', encoding="utf-8")
    elif fmt == "jsonl":
        path.write_text("\n".join(json.dumps(r) for r in data) + '\n\n"junk"\n')
    else:
        items = data + [5]
        path.write_text(json.dumps({"rows": items} if fmt == "rows" else items))
    got = lab.read_labelled(spark, str(path))
    good = sorted((r["id"], r["text"], r["label"]) for r in got.where("not malformed").collect())
    assert good == [(r["id"], r["text"], r["label"]) for r in data]
    assert got.where("malformed").count() == (0 if fmt == "csv" else 1)
    with pytest.raises(ValueError):
        lab.read_labelled(spark, "x.xml")


def test_tsv_ids_and_copies(spark, tmp_path):
    p = tmp_path / "sms"
    p.write_text("ham\tHello there\nspam\tWIN now\tplease\n\nham\t hello   THERE\nother\tx\nspam\t  \nno tab\n")
    rows, bad = lab.read_tsv_labelled(spark, str(p))
    got = sorted((r["id"], r["label"], r["text"]) for r in rows.collect())
    assert got == [("sms-uci-00001", "benign", "Hello there"), ("sms-uci-00002", "scam", "WIN now\tplease")]
    assert bad.count() == 3


def test_sequence_numbers_across_ranges(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(100)], "ord long").repartition(5)
    got = [r["seq"] for r in ds.sequence_numbers(df, "ord", width=50).orderBy("ord").collect()]
    assert got == list(range(1, 101))


def test_reading_order_follows_files_and_lines(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for k in range(9):  # sizes differ, so Spark packs the splits in another order
        lines = [f"{k:02d}-{i:04d} " + "x" * (k % 4) * 50 for i in range(30 + 400 * (k % 3))]
        (folder / f"f{k}.jsonl").write_text("\n".join(json.dumps({"id": x.split()[0], "text": x}) for x in lines) + "\n")
        want += [x.split()[0] for x in lines]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = lab.read_labelled(spark, str(folder), "jsonl").select("ord", "id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["id"] for r in sorted(rows, key=lambda r: r["ord"])] == want and len({r["ord"] for r in rows}) == len(rows)


def test_dedup_keeps_the_first(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "", "Same  Text"), (4, "", "same text"), (5, "", ""), (6, "", "")]
    df = spark.createDataFrame(rows, "ord long, id string, text string")
    assert sorted(r["ord"] for r in ds.dedup_first(df).collect()) == [1, 3, 5, 6]


def test_split_is_exact_stratified_and_reproducible(spark):
    df = spark.createDataFrame([(f"r{i}", "scam" if i % 4 == 0 else "benign") for i in range(400)], "id string, label string")
    a, b = ds.stratified_split(df, "id", bits=4), ds.stratified_split(df.repartition(7), "id", bits=4)
    sizes = {(r["label"], r["split"]): r["count"] for r in a.groupBy("label", "split").count().collect()}
    assert sizes == {("scam", "test"): 20, ("scam", "val"): 10, ("scam", "train"): 70, ("benign", "test"): 60, ("benign", "val"): 30, ("benign", "train"): 210}
    pick = lambda d: {(r["id"], r["split"]) for r in d.select("id", "split").collect()}
    assert pick(a) == pick(b)


def test_threshold_and_auc_against_brute_force(spark):
    rng = random.Random(3)
    data = [(round(rng.random(), 2), rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(data, "s double, y boolean")

    def f1(t):
        tp = sum(1 for s, y in data if s >= t and y)
        return 2 * tp / (sum(1 for s, _ in data if s >= t) + sum(y for _, y in data))

    best = max(sorted({s for s, _ in data}), key=lambda t: (round(f1(t), 12), -t))
    assert ds.best_threshold(df, "s", F.col("y")).head()["threshold"] == best
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(ds.roc_auc(df, "s", F.col("y")).head()[0] - auc) < 1e-6


def test_validation_and_guard(spark):
    rows = [("", "", "scam", "phishing", ""), ("t", "", "", "", ""), ("t", "", "spam", "", ""), ("t", "", "benign", "phishing", ""), ("t", "", "scam", "", ""),
            ("t", "", "scam", "zzz", ""), ("t", "", "benign", "", "x"), ("t", "", "benign", "", "2"), ("t", "u", "scam", "phishing", "0.5")]
    df = spark.createDataFrame(rows, "text string, url string, label string, category string, annotation_confidence string")
    checked = ds.validate_dataset(ds.canonical_rows(df))
    assert sorted(len(r["errors"]) for r in checked.select("errors").collect()) == [0] + [1] * 8
    with pytest.raises(ValueError):
        ds.refuse_evaluation_path("/data/evaluation/x.json", "/data/evaluation")


def test_submission_rate_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), rng.randrange(0, 600_000_000)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, user_id int, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"]: r["recent"] for r in rate_limit.submission_rate(df, limit=5).collect()}
    assert got == {i: sum(1 for _, v, t in rows if v == u and us - 60_000_000 < t <= us) for i, u, us in rows}


def test_exact_limiter_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), i * 4_000_000 + rng.randrange(1000)) for i in range(200)]
    src = tmp_path / "in"
    frame = spark.createDataFrame(rows, "msg_id long, user_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    frame.where("msg_id < 100").coalesce(1).write.parquet(str(src / "a"))
    frame.where("msg_id >= 100").coalesce(1).write.parquet(str(src / "b"))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    run = rate_limit.limit_stream(stream, limit=3).writeStream.format("memory").queryName("limited").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["id"]: r["accepted"] for r in spark.table("limited").collect()}
    want = limited_by_hand([(i, u, us) for i, u, us in rows], 3)
    assert got == want and not all(want.values())


def limited_by_hand(rows, limit, width=60_000_000):
    want, kept = {}, {}
    for i, u, us in sorted(rows, key=lambda r: (r[2], r[0])):
        recent = [t for t in kept.get(u, []) if us - t < width]
        want[i] = len(recent) < limit
        kept[u] = recent + [us] if want[i] else recent
    return want


@pytest.mark.parametrize("limit", [1, 3])
def test_limiter_over_a_table_against_brute_force(spark, limit):
    rng = random.Random(limit)
    rows, t = [], 0
    for i in range(900):                                     # bursts, quiet stretches and gaps; one address has a third of all
        t += rng.choice([0, 1, 5, 20, 20, 40]) * 1_000_000 if i % 150 < 120 else rng.choice([30, 45, 200]) * 1_000_000
        rows.append((f"id{i:04d}", "10.0.0.1" if i % 3 == 0 else f"10.0.1.{rng.randrange(6)}", t + rng.randrange(3)))
    rows += [("x1", None, 5), ("x2", None, 6), ("x3", None, 7), ("x4", None, 8)]
    df = spark.createDataFrame(rows, "sid string, address string, us long").withColumn("ts", F.timestamp_micros("us")).repartition(5)
    out = rate_limit.limit_batch(df, key="address", row_id="sid", limit=limit)
    got = {r["id"]: r["accepted"] for r in out.collect()}
    assert got == limited_by_hand(rows, limit) and len(got) == 904 and 100 < sum(got.values()) < 900
    unknown = rate_limit.limit_batch(df.withColumn("ts", F.lit(None).cast("timestamp")), key="address", row_id="sid").collect()
    assert len(unknown) == 904 and all(r["accepted"] is None for r in unknown)
    assert rate_limit.limit_batch(df.limit(0), key="address", row_id="sid").count() == 0


def test_busy_segments_start_after_calm_slots(spark):
    slots = spark.createDataFrame([("a", s, s in (3, 6)) for s in (1, 2, 3, 4, 5, 6, 9, 10)] + [("b", 4, False)], "client string, slot long, calm boolean")
    assert sorted(tuple(r) for r in rate_limit.busy_segments(slots).select("client", "slot", "segment").collect()) == [
        ("a", 1, 1), ("a", 2, 1), ("a", 4, 4), ("a", 5, 4), ("a", 9, 9), ("a", 10, 9), ("b", 4, 4)]


def test_stream_limiter_flags_late_rows_and_takes_any_key(spark, tmp_path):
    src = tmp_path / "in"
    day = 86_400_000_000
    parts = [[("m1", "10.0.0.1", day), ("m2", "10.0.0.1", day + 1), ("m3", "10.0.0.1", day + 2)], [("m4", "fe80::1", 3 * day)],
             [("m5", "10.0.0.1", day + 70_000_000), ("m6", "10.0.0.1", 3 * day + 1)], [("m7", "10.0.0.1", 3 * day - 30_000_000), ("m8", "10.0.0.1", 3 * day + 2), ("m9", "10.0.0.1", None)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "sid string, address string, us long").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(src / f"p{k}"))
    schema = spark.read.parquet(str(src / "p0")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    run = rate_limit.limit_stream(stream, key="address", row_id="sid", limit=2).writeStream.format("memory").queryName("late").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["id"]: (r["accepted"], r["late"]) for r in spark.table("late").collect()}
    assert got == {"m1": (True, False), "m2": (True, False), "m3": (False, False), "m4": (True, False), "m5": (False, True), "m6": (True, False),
                   "m7": (True, False), "m8": (False, False), "m9": (None, False)}


def test_stream_equals_batch_and_results_can_be_queried(spark, tmp_path):
    from lureframe.plans.triage import triage

    texts = ["Hi Bo, lunch at noon?", "Your card will be blocked, verify your account and reply with the otp 123456 immediately",
             "You have won a prize, pay the processing fee to release it", "see https://bit.ly/x"]
    rows = [(i, i % 2, texts[i % 4]) for i in range(12)]
    frame = spark.createDataFrame(rows, "msg_id long, user_id long, text string").withColumns(
        {"urls": F.expr("cast(array() as array<string>)"), "ts": F.timestamp_seconds(F.col("msg_id") * 3600 + 1_700_000_000)})
    frame.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    triage_stream.score_stream(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
    t = res.read_results(spark, out)
    batch = {(r["msg_id"], r["score"], r["level"]) for r in triage(frame, with_report=False).select("msg_id", "score", "level").collect()}
    assert {(r["msg_id"], r["score"], r["level"]) for r in t["risk"].select("msg_id", "score", "level").collect()} == batch
    own = hi.history(t["investigations"], t["risk"], t["reports"], 1)
    assert hi.history_total(own).head()[0] == 6 and {r["user_id"] for r in own.collect()} == {1}
    page = hi.history_page(own, 1, 2).collect()
    assert [r["msg_id"] for r in page] == [11, 9]
    view = hi.investigation_view(t, 1, 1).collect()
    assert len(view) == 1 and view[0]["evidence"][0]["signal"] == "input_received"
    assert hi.investigation_view(t, 0, 1).count() == 0
    left = hi.purge(t, spark.createDataFrame([(1,), (2,)], "msg_id long"), 1)
    assert left["investigations"].count() == 11 and left["evidence"].where("msg_id = 1").count() == 0 and left["evidence"].where("msg_id = 2").count() > 0


def test_eval_corpus_and_verdicts(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"id": "a", "input_type": "text", "text": "x", "expected": {"is_scam": True, "primary_category": "phishing", "minimum_risk_level": "HIGH"}}]))
    cases = lab.read_eval_corpus(spark, str(p))
    judged = {lv: ev.case_verdict(cases.withColumns({"level": F.lit(lv), "primary": F.lit("phishing")})).head()["verdict"] for lv in lx.LEVEL_ORDER}
    assert judged == {"LOW": "fn", "MEDIUM": "band_miss", "HIGH": "ok", "CRITICAL": "ok"}
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        lab.read_eval_corpus(spark, str(tmp_path / "e.json"))


def test_weights(spark, tmp_path):
    p = tmp_path / "w.json"
    p.write_text('{"url_risk": 0.5}')
    assert res.load_weights(spark, str(p))["url_risk"] == 0.5 and res.load_weights(spark, None) == lx.CHANNEL_WEIGHTS
    p.write_text("not json")
    assert res.load_weights(spark, str(p)) == lx.CHANNEL_WEIGHTS


def test_synthetic_shares(spark):
    rows = syn.generate_synthetic(spark.range(3000), seed=7).collect()
    again = syn.generate_synthetic(spark.range(3000).repartition(5), seed=7).collect()
    assert {(r["id"], r["text"]) for r in rows} == {(r["id"], r["text"]) for r in again}
    scam = [r for r in rows if r["label"] == "scam"]
    assert 0.82 < len(scam) / len(rows) < 0.90 and len({r["category"] for r in scam}) == 10
    assert not any(re.search(r"\{[a-z]+\}", r["text"].lower()) for r in rows)
    assert 0.4 < sum(r["text"].isupper() for r in scam) / len(scam) < 0.6


def test_contamination_guard_broadcast_and_salted(spark, monkeypatch):
    df = spark.createDataFrame([(i, "" if i % 3 else f"e{i}") for i in range(60)], "ord int, id string")
    ids = spark.createDataFrame([("e0",), ("e3",), ("",)], "id string")
    for limit, small in ((1 << 40, 1), (0, 100), (0, 0)):
        monkeypatch.setattr(rep.feed_join, "__defaults__", ("left", limit, small, 10))
        clean, bad = ds.contamination_guard(df, ids)
        assert sorted(r["ord"] for r in bad.collect()) == [0, 3] and clean.count() == 58


_ASSESSED: list = []


def small_batch(spark, ids):
    """Assessed messages with the given ids (below 40): four texts, the last one without content, two owners."""
    import tempfile

    from lureframe.plans.triage import triage

    if not _ASSESSED:  # once a session
        texts = ["Hi Bo, lunch at noon?", "Your card will be blocked, verify your account and reply with the otp 123456 immediately", "see https://bit.ly/x", "  "]
        frame = spark.createDataFrame([(i, i % 2, texts[i % 4]) for i in range(40)], "msg_id long, user_id long, text string").withColumns(
            {"urls": F.expr("cast(array() as array<string>)"), "ts": F.timestamp_seconds(F.col("msg_id") * 40_000 + 1_700_000_000)})
        _ASSESSED.append(tempfile.mkdtemp(prefix="lureframe-test-"))
        triage(frame).write.mode("overwrite").parquet(_ASSESSED[0])
    return spark.read.parquet(_ASSESSED[0]).where(F.col("msg_id").isin(list(ids)))


def test_results_append_and_replace(spark, tmp_path):
    out = str(tmp_path / "store")
    first = res.write_results(small_batch(spark, range(8)), out)
    res.write_results(small_batch(spark, range(8, 16)), out)
    res.write_results(small_batch(spark, range(4)), out, first)
    t = res.read_results(spark, out)
    ids = {r["msg_id"] for r in t["risk"].select("msg_id").collect()}
    assert ids == {i for i in [*range(4), *range(8, 16)] if i % 4 != 3}  # rejected rows stay out, both runs are there
    assert not list((tmp_path / "store" / "_staged").rglob("*.parquet"))
    row = t["risk"].where("msg_id = 9").head()
    assert row["weights_used"] == lx.CHANNEL_WEIGHTS
    assert t["reports"].where("msg_id = 9").head()["suspicious_indicators"]
    stages = t["analyses"].where("msg_id = 10").orderBy("ord").collect()
    assert [s["stage"] for s in stages][:2] == ["parse", "analyze"] and all(s["label"] and s["at"] for s in stages)
    assert t["investigations"].where("msg_id = 10").head()["warnings"]


def test_reads_of_the_store_skip_other_days(spark, tmp_path):
    out = str(tmp_path / "store")
    res.write_results(small_batch(spark, range(24)), out)
    t = res.read_results(spark, out)
    days = ("2023-11-16", "2023-11-17")
    found = hi.history(t["investigations"], t["risk"], t["reports"], 0, days=days)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert len(scans) >= 3 and all("PartitionFilters: [isnotnull(day" in x for x in scans) and "dynamicpruning" in plan
    every = hi.history(t["investigations"], t["risk"], t["reports"], 0)
    inside = [r["msg_id"] for r in every.where(F.col("day").between(*[F.lit(d).cast("date") for d in days])).collect()]
    assert sorted(r["msg_id"] for r in found.collect()) == sorted(inside) and 0 < len(inside) < every.count()
    whole = [(r["ts"], r["msg_id"]) for r in hi.history_page(every, 1, 100).collect()]
    pages, after = [], None
    while True:
        page = [(r["ts"], r["msg_id"]) for r in hi.history_page(every, 1, 4, after=after).collect()]
        if not page:
            break
        pages += page
        after = page[-1]
    assert pages == whole


def contents(t):
    return {name: sorted(r["msg_id"] for r in x.select("msg_id").collect()) for name, x in t.items()}


def same_dashboard(spark, out):
    t, summary, day = res.read_results(spark, out), res.read_summary(spark, out), F.lit("2023-11-15").cast("date")
    assert hi.dashboard_from_summary(summary, day).collect() == hi.dashboard_kpis(t["investigations"], t["risk"], day).collect()
    assert sorted(hi.levels_from_summary(summary).collect()) == sorted(hi.level_distribution(t["risk"]).collect())
    assert hi.top_categories(summary).collect() == hi.top_categories(t["reports"]).collect()
    for user in (0, 1):
        own = hi.history(t["investigations"], t["risk"], t["reports"], user, risk_level="low")
        assert hi.total_from_summary(summary, user, risk_level="low").collect() == hi.history_total(own).collect()
    return hi.dashboard_from_summary(summary, day).head()["total"]


def test_a_run_is_visible_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    out, batch = str(tmp_path / "store"), small_batch(spark, range(8))
    whole, calls = res._write_table, []

    def dies(table, path, name, *attempt):
        calls.append(name)
        if name == "risk":
            raise RuntimeError("lost")
        whole(table, path, name, *attempt)

    monkeypatch.setattr(res, "_write_table", dies)
    with pytest.raises(RuntimeError):
        res.write_results(batch, out)
    assert "evidence" in calls and list((tmp_path / "store" / "evidence").rglob("*.parquet"))
    with pytest.raises(ValueError):
        res.read_results(spark, out)
    monkeypatch.setattr(res, "_write_table", whole)
    res.write_results(batch, out)
    first = contents(res.read_results(spark, out))
    monkeypatch.setattr(res, "_write_table", dies)
    with pytest.raises(RuntimeError):
        res.write_results(small_batch(spark, range(8, 12)), out)
    assert contents(res.read_results(spark, out)) == first and first["risk"] == [0, 1, 2, 4, 5, 6]
    monkeypatch.setattr(res, "_write_table", whole)
    monkeypatch.setattr(res, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        res.write_results(small_batch(spark, range(8, 12)), out)
    assert contents(res.read_results(spark, out)) == first


def test_repeated_runs_and_newer_runs_of_a_message(spark, tmp_path):
    out, batch = str(tmp_path / "store"), small_batch(spark, range(8))
    res.write_results(batch, out)
    once = contents(res.read_results(spark, out))
    res.write_results(batch, out)                                     # the job ran again under another name
    assert contents(res.read_results(spark, out)) == once and same_dashboard(spark, out) == 6
    newest = res.write_results(small_batch(spark, [2, 4, 20]), out)
    t = res.read_results(spark, out)
    assert {r["run"] for r in t["risk"].where("msg_id in (2, 4, 20)").collect()} == {newest}
    assert contents(t)["risk"] == [0, 1, 2, 4, 5, 6, 20] and same_dashboard(spark, out) == 7
    assert contents(res.read_results(spark, out, upto=1)) == once     # an older snapshot


def test_purge_of_the_store(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "store")
    res.write_results(small_batch(spark, range(24)), out)
    before = contents(res.read_results(spark, out))
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    ids = spark.createDataFrame([(2,), (2,), (3,), (5,)], "msg_id long")
    with monkeypatch.context() as m:
        m.setattr(res, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            res.purge_results(spark, out, ids, 0)
    assert contents(res.read_results(spark, out)) == before and same_dashboard(spark, out) == 18
    assert res.purge_results(spark, out, ids, 0) == 1 and res.purge_results(spark, out, ids, 0) == 0
    after = {name: [i for i in rows if i != 2] for name, rows in before.items()}
    assert contents(res.read_results(spark, out)) == after and same_dashboard(spark, out) == 17
    assert all(p.stat().st_mtime_ns == at for p, at in stamp.items())  # no result file is touched
    assert hi.investigation_view(res.read_results(spark, out), 0, 2).count() == 0
    res.write_results(small_batch(spark, [2]), out)                   # sent again later: there again
    assert 2 in contents(res.read_results(spark, out))["risk"] and same_dashboard(spark, out) == 18


def test_compaction_and_vacuum(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "store")
    first = res.write_results(small_batch(spark, range(8)), out)
    res.write_results(small_batch(spark, range(4, 16)), out)
    res.purge_results(spark, out, spark.createDataFrame([(1,), (9,)], "msg_id long"), 1)
    whole = contents(res.read_results(spark, out))
    put, raced = res._put, []

    def beaten(spark_, path, text):                                   # another writer commits while the compaction works
        if json.loads(text)["kind"] == "compact" and not raced:
            raced.append(1)
            monkeypatch.setattr(res, "_put", put)
            res.purge_results(spark_, out, spark_.createDataFrame([(4,)], "msg_id long"), 0)
        return put(spark_, path, text)

    monkeypatch.setattr(res, "_put", beaten)
    res.compact_results(spark, out)
    assert raced and contents(res.read_results(spark, out)) == {name: [i for i in rows if i != 4] for name, rows in whole.items()}
    assert same_dashboard(spark, out) == 9 and len(res.snapshot(spark, out).live) == 1 and not res.snapshot(spark, out).tombstones
    res.write_results(small_batch(spark, [0, 30]), out, first)        # a run that was compacted is written again
    kept = contents(res.read_results(spark, out))
    assert kept["risk"] == [0, 5, 6, 8, 10, 12, 13, 14, 30]            # 2 stood in that run only
    total = same_dashboard(spark, out)
    assert res.vacuum_results(spark, out, older_than_hours=1) == 0
    assert res.vacuum_results(spark, out, older_than_hours=-1) > 10
    assert contents(res.read_results(spark, out)) == kept and same_dashboard(spark, out) == total
    assert len(list((tmp_path / "store" / "risk").glob("attempt=*"))) == 2


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "store")
    res.write_results(small_batch(spark, range(4)), out)
    put, raced = res._put, []

    def beaten(spark_, path, text):
        if not raced:
            raced.append(1)
            res.write_results(small_batch(spark_, [2, 6]), out, "other")
        return put(spark_, path, text)

    monkeypatch.setattr(res, "_put", beaten)
    res.write_results(small_batch(spark, [2, 5]), out, "mine")
    t = res.read_results(spark, out)
    assert contents(t)["risk"] == [0, 1, 2, 5, 6] and t["risk"].where("msg_id = 2").head()["run"] == "mine" and same_dashboard(spark, out) == 5


def test_keyed_reads_open_few_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    out = str(tmp_path / "store")
    monkeypatch.setattr(res, "ROW_GROUP", 16 * 1024)
    texts = spark.range(12_000).select(F.col("id").alias("msg_id"), (F.xxhash64("id") % 200).alias("user_id"), F.lit("Hi Bo, lunch at noon?").alias("text"),
                                       F.expr("cast(array() as array<string>)").alias("urls"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    from lureframe.plans.triage import triage

    res.write_results(triage(texts), out)
    groups = [(g.column(k).statistics, g.column(k).path_in_schema) for f in (tmp_path / "store" / "investigations").rglob("*.parquet")
              for meta in [pq.ParquetFile(f).metadata] for i in range(meta.num_row_groups) for g in [meta.row_group(i)] for k in range(g.num_columns)
              if g.column(k).path_in_schema in ("user_id",)]
    holding = [s for s, _ in groups if s.min <= 77 <= s.max]
    assert len(groups) >= 20 and len(holding) <= 0.2 * len(groups)
    own = hi.history(*[res.read_results(spark, out)[t] for t in ("investigations", "risk", "reports")], 77)
    assert own.count() == texts.where("user_id = 77").count()


def test_messages_delivered_again_count_once(spark, tmp_path):
    from lureframe.plans.triage import triage

    texts = ["Hi Bo, lunch at noon?", "Your card will be blocked, verify your account and reply with the otp 123456 immediately", "see https://bit.ly/x"]
    rows = [(i, i % 2, texts[i % 3]) for i in range(9)]
    frame = spark.createDataFrame(rows, "msg_id long, user_id long, text string").withColumns(
        {"urls": F.expr("cast(array() as array<string>)"), "ts": F.timestamp_seconds(F.col("msg_id") * 3600 + 1_700_000_000)})
    frame.unionByName(frame.where("msg_id < 3")).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))     # twice in one batch
    frame.where("msg_id >= 2").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))                       # and in the next
    res.write_results(triage(frame), str(tmp_path / "batch"), "r")
    plain = lambda path: {name: sorted(str([v for v in r.asDict().items() if v[0] not in ("run", "at", "day")]) for r in t.collect())
                          for name, t in res.read_results(spark, path).items()}
    batch = plain(str(tmp_path / "batch"))
    for k, redelivery in enumerate((None, "30 days")):
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{k}")
        triage_stream.score_stream(stream, out, str(tmp_path / f"cp{k}"), once=True, redelivery=redelivery).awaitTermination()
        assert plain(out) == batch, redelivery
        dead = res.snapshot(spark, out).tombstones
        assert bool(dead) == (redelivery is None)


def test_entry_without_the_training_data_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "oracles", "lureframe", "corpus_pipeline.py"):
        if os.path.exists(f"{here}/{name}"):
            (shutil.copytree if os.path.isdir(f"{here}/{name}") else shutil.copy)(f"{here}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(tmp_path / "lureframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_terms_by_table_equal_the_regex(spark):
    from lureframe.operators import signals, terms
    from lureframe.operators.entities import brand_terms

    every = sorted(set(lx.DEFAULT.terms()) | set(brand_terms(lx.DEFAULT)))
    rng = random.Random(8)
    bodies = [" ".join(rng.choice([*every, "x", "of", "Pay-pal", "..."]) + rng.choice(["", "", "s", ".", "!", " - "]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    bodies += ["", None, "  ", "a\\Eb", "verify" * 300, "VERIFY your ACCOUNTé", "₿₿ now"]
    df = spark.createDataFrame(list(enumerate(bodies)), "msg_id long, body string")
    scanned = signals.scan_terms(df.where("body is not null"))
    want = {(r["msg_id"], t) for r in scanned.select("msg_id", "hits").collect() for t in r["hits"]}
    dim = spark.createDataFrame([(t,) for t in [*every, "no such term at all", " ", None]], "term string")
    low = scanned.select("msg_id", "lower_body")
    for options in ({}, dict(small=0)):
        found = [tuple(r) for r in terms.find_terms(low, dim, **options).collect()]
        assert set(found) == want and len(found) == len(want), options
    odd = spark.createDataFrame([("a\\eb",), ("₿",), ("vers",)], "term string")
    assert sorted(tuple(r) for r in terms.find_terms(low, odd).collect()) == [(153, "a\\eb"), (156, "₿")]
    index = {r["term"]: r["token"] for r in terms.term_index(low, spark.createDataFrame([("of verify",), ("verify",), ("zzz verify",)], "term string")).collect()}
    counts = {t: sum(t in re.findall("[a-z0-9]+", (b or "").lower()) for b in bodies) for t in ("of", "verify")}
    assert index == {"of verify": min(counts, key=counts.get), "verify": "verify"}


def test_nearest_names_against_all_pairs(spark):
    from lureframe.operators import terms

    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(200)]
    names, brands = sorted(set(words[:120]) | {"x" * 5000}), list(dict.fromkeys(w for w in words[80:] if w))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    want = {}
    for name in names:
        near = [(d, -k, b) for k, b in enumerate(brands) if abs(len(name) - len(b)) < 3 for d in [edits(name, b)] if d <= 2]
        if near:
            want[name] = min(near)[2]
    dim = spark.createDataFrame([(b, k) for k, b in enumerate(brands)], "key string, ord int")
    got = {r["name"]: r["brand"] for r in terms.nearest_name(spark.createDataFrame([(x,) for x in names], "name string"), dim).collect()}
    assert got == want
    many = spark.range(100_000).select(F.concat(F.lit("brand"), F.conv(F.col("id"), 10, 36)).alias("key"), F.col("id").alias("ord"))
    asked = spark.createDataFrame([("BRAND7PS",), ("brandzz9x",), ("nothing like it",), ("brand 1",)], "name string")
    alias = spark.createDataFrame([("nothing like it", "other")], "alias string, key string")
    found = {r["name"]: r["brand"] for r in terms.fuzzy_brand_by_table(asked, many.withColumn("key", F.lower("key")), alias).collect()}
    assert found["BRAND7PS"] == "brand7ps" and found["nothing like it"] == "other" and found["brand 1"].startswith("brand")


def test_terms_are_listed_under_pairs_of_tokens(spark, tmp_path):
    from lureframe.operators import terms as tm

    texts = ["pay the fee now", "the  fee", "fee the pay", "a$5 now", "$5 now, pay", "epay the fees", "x", "", "now now now"]
    listed = ["pay the", "the fee", "the  fee", "$5", "$5 now", "now", "now now", "pay the fee", "5 now, pay", ", ", "x", "feez"]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_id long, lower_body string")
    dim = spark.createDataFrame([(t,) for t in listed], "term string")
    import re
    want = {(i, t) for i, x in enumerate(texts) for t in listed if re.search(r"(?<![a-z0-9])" + re.escape(t) + r"(?![a-z0-9])", x) and t.strip()}
    for small in (100, 0):
        assert sorted(map(tuple, tm.find_terms(rows, dim, small=small).collect())) == sorted(want)
    index = {r["term"]: r["token"] for r in tm.term_index(rows, dim, pairs=True).collect()}
    assert index["pay the"] == "pay the" and index["the  fee"] == "the  fee" and index["now"] == "now"


def test_dense_client_is_counted_and_walked_in_linear_time(spark):
    import random
    import time
    from collections import deque

    from lureframe.streaming import rate_limit as rl

    rng, n, width, limit = random.Random(5), 60_000, 3_600, 3
    times = sorted(rng.randrange(0, 2 * width) for _ in range(n))
    frame = spark.createDataFrame([("c", i, t) for i, t in enumerate(times)], "user_id string, msg_id long, s long").selectExpr("user_id", "msg_id", "timestamp_seconds(s) ts")
    began = time.time()
    got = {r["id"]: r["accepted"] for r in rl.limit_batch(frame, window_seconds=width, limit=limit).collect()}
    took = time.time() - began
    taken, want = deque(), {}
    for i, t in enumerate(times):
        while taken and t - taken[0] >= width:
            taken.popleft()
        want[i] = len(taken) < limit
        if want[i]:
            taken.append(t)
    assert got == want
    assert took < 60


def test_a_stored_batch_is_not_staged_again(spark, tmp_path):
    batch = small_batch(spark, range(12))
    one, two = str(tmp_path / "staged"), str(tmp_path / "stored")
    res.write_results(batch, one, "r")
    res.write_results(batch, two, "r", stored=True)
    assert not (tmp_path / "stored" / "_staged").exists()
    a, b = res.read_results(spark, one), res.read_results(spark, two)
    for name in ("investigations", "evidence", "risk", "reports"):
        rows = lambda t: sorted(r[0] for r in t.selectExpr("to_json(struct(*))").collect())
        assert rows(a[name]) == rows(b[name])


def test_small_files_have_small_bloom_filters(spark, tmp_path):
    rows = spark.range(100).selectExpr("id * 37 as msg_id", "date'2024-01-01' as day")
    res._write_table(rows, str(tmp_path), "t", "a1", "r")
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert files and all(f.stat().st_size < 300_000 for f in files)
    assert spark.read.parquet(str(tmp_path / "t")).where("msg_id = 37").count() == 1


def test_a_staged_batch_has_only_what_the_tables_read(spark, tmp_path):
    small_batch(spark, range(12)).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    slim = res.stored_columns(batch)
    assert not {"text", "urls", "body", "hits", "phrases", "matches"} & set(slim.columns)
    res.write_results(slim, str(tmp_path / "slim"), "r", stored=True)
    res.write_results(batch, str(tmp_path / "whole"), "r", keep_staged=True)
    a, b = res.read_results(spark, str(tmp_path / "slim")), res.read_results(spark, str(tmp_path / "whole"))
    rows = lambda t: sorted(r[0] for r in t.selectExpr("to_json(struct(*))").collect())
    for name in ("investigations", "evidence", "entities", "risk", "reports"):
        assert a[name].columns == b[name].columns and rows(a[name]) == rows(b[name])
    staged = lambda t: spark.read.parquet(f"{tmp_path}/{t}/_staged/run=r").columns
    assert "body" in staged("whole")


def test_evaluation_assesses_the_template_messages_only(spark, monkeypatch):
    from oracles import registry
    from lureframe.plans import triage as plan

    seen, whole = [], plan.triage
    monkeypatch.setattr(registry.plan, "triage", lambda m, **k: seen.append(m) or whole(m, **k))
    there = registry.Stages(spark, "/root/testdata/sf0.001")
    judged = there.judged
    assert seen and seen[0].where("is_scam is null").count() == 0
    assert judged.count() == there.templates.join(there.body.select("msg_id"), "msg_id").count()
    assert "stored" not in there._plans and "assessed" not in there._plans


def test_a_store_may_hold_only_the_tables_that_are_read(spark, tmp_path):
    small_batch(spark, range(12)).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    rows = lambda t: sorted(r[0] for r in t.drop("run").selectExpr("to_json(struct(*))").collect())
    out = {name: str(tmp_path / name) for name in ("whole", "some", "none")}
    for name, tables in (("whole", res.TABLES), ("some", ("risk",)), ("none", ())):
        slim = res.stored_columns(batch, tables)
        assert ("evidence" in slim.columns) == (name == "whole")
        res.write_results(slim, out[name], stored=True, tables=tables)
        res.write_results(slim.where("msg_id % 3 <> 0"), out[name], tables=tables)
        res.purge_results(spark, out[name], spark.range(0, 6).withColumnRenamed("id", "msg_id"), 1)
        res.compact_results(spark, out[name])
    summaries = [rows(res.read_summary(spark, path)) for path in out.values()]
    assert summaries[0] and summaries[0] == summaries[1] == summaries[2]
    whole, some = res.read_results(spark, out["whole"]), res.read_results(spark, out["some"])
    assert list(some) == ["risk"] and rows(some["risk"]) == rows(whole["risk"]) and res.read_results(spark, out["none"]) == {}
    with pytest.raises(ValueError):
        res.write_results(batch, out["some"], tables=("evidence",))


def test_only_attempts_with_many_tombstones_are_shuffled(spark, tmp_path, monkeypatch):
    out, tables = str(tmp_path / "store"), ("risk",)
    small_batch(spark, range(24)).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    res.write_results(batch, out, stored=True, tables=tables)
    res.write_results(batch.where("msg_id % 3 <> 0"), out, stored=True, tables=tables)
    res.write_results(small_batch(spark, [40, 41]), out, tables=tables)
    res.purge_results(spark, out, spark.createDataFrame([(2,), (6,)], "msg_id long"), 0)
    want = [r.msg_id for r in res.read_results(spark, out)["risk"].orderBy("msg_id").collect()]
    joins = lambda df: [df._jdf.queryExecution().executedPlan().toString().count(x) for x in ("BroadcastHashJoin", "SortMergeJoin")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, plan in ((100, [1, 0]), (5, [1, 1]), (0, [0, 1])):   # one lost most of its rows, one a row, one none
            monkeypatch.setattr(res, "SMALL_ROWS", few)
            rows = res.read_results(spark, out)["risk"]
            assert joins(rows) == plan and [r.msg_id for r in rows.orderBy("msg_id").collect()] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_terms_are_one_regex_and_terms_with_one_key_read_no_text(spark):
    import re

    from lureframe.operators import terms as tm

    texts = ["pay the fee now", "the  fee", "fee, the pay", "a$5 now", "$5 now, pay", "epay the fees", "x", "", None, "now now now", ", pay the", "x" * 3000, "$$5 now"]
    listed = ["pay", "pay the", "pay the fee", "the fee", "the  fee", "$5", "$5 now", "now", "now now", "5 now, pay", ", ", "\\E", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_id long, lower_body string")
    dim = spark.createDataFrame([(t,) for t in [*listed, "now", None]], "term string")
    want = sorted((i, t) for i, x in enumerate(texts) for t in listed if x and t.strip() and re.search(r"(?<![a-z0-9])" + re.escape(t) + r"(?![a-z0-9])", x))
    for options in ({}, {"literal": 5}, {"literal": 0}, {"small": 0}):  # five: fewer than there are
        found = tm.find_terms(rows, dim, **options)
        assert sorted(map(tuple, found.collect())) == want, options
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == bool(options), options
    unread = rows.select("msg_id", F.raise_error(F.lit("texts were read")).cast("string").alias("lower_body"))
    one_key = spark.createDataFrame([("pay the",), ("now",), ("x x x",)], "term string")
    assert sorted(map(tuple, tm.term_index(unread, one_key, pairs=True).collect())) == [("now", "now", True), ("pay the", "pay the", True), ("x x", "x x x", False)]
    twice = spark.createDataFrame([(1, "alder bank"), (1, "alder bank"), (2, "alderé"), (None, "alder")], "msg_id long, lower_body string")
    brands = spark.createDataFrame([("alder", "banks")], "term string, kind string")
    for options in ({}, {"literal": 0}):
        assert sorted(map(tuple, tm.brands_by_table(twice, brands, **options).collect())) == [("alder", 1, "banks")] * 4


def test_tens_of_thousands_of_tombstones_are_not_collected_in_the_driver(spark, tmp_path):
    out, n = str(tmp_path / "store"), 45_000
    batch = spark.range(n).selectExpr("id as msg_id", "id % 7 as user_id", "timestamp'2024-01-15 00:00:00' as ts", "cast(null as string) as reject_reason",
                                      "'LOW' as level", "'unknown' as primary", "cast(id % 100 as double) as score")
    for part in (batch, batch.where("msg_id > 0")):
        res.write_results(part, out, stored=True, tables=())
    left = res._rows(spark, out, res.INDEX, res.snapshot(spark, out))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == left.select("msg_id").distinct().count() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
