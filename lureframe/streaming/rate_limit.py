"""Submission rate per client: a windowed count, and an exact limiter over tables and over streams."""
from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def submission_rate(df: DataFrame, key: str = "user_id", ts: str = "ts", window_seconds: int = 60, limit: int = 30) -> DataFrame:
    """``recent``: submissions of the client in the window ending now; ``over_limit`` when above the limit.

    Counts every submission.  Rows are split into time slots one window long and
    each row is also shown to the next slot, so a client with a huge share of
    the traffic is spread over as many tasks as it has slots.  In the next slot a
    row enters and expires again, so the count is a running sum: linear in the rows, however many a window holds.
    """
    width = window_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slotted = df.withColumn("_us", micros).withColumn("_slot", F.floor(F.col("_us") / width))
    step = lambda slot, at, by, own: F.struct(slot.alias("slot"), at.alias("at"), F.lit(by).alias("by"), F.lit(own).alias("own"))
    us, slot = F.col("_us"), F.col("_slot")
    shown = slotted.where("_us is not null").withColumn("_e", F.explode(F.array(
        step(slot, us, 1, True), step(slot + 1, us, 1, False), step(slot + 1, us + width, -1, False))))
    w = W.partitionBy(key, "_e.slot").orderBy("_e.at").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = shown.withColumn("recent", F.sum("_e.by").over(w)).where("_e.own")
    return counted.withColumn("over_limit", F.col("recent") > limit).drop("_us", "_slot", "_e")


# -- exact limiter over a table ----------------------------------------------------------------------------------------------

def busy_segments(slots: DataFrame) -> DataFrame:
    """client, slot, segment: runs of neighbouring slots that are not calm, named by their first slot.

    A window over slots, not over events: a client has as many as its time has windows.
    """
    order = W.partitionBy("client").orderBy("slot")
    starts = F.when(F.lag("slot").over(order) == F.col("slot") - 1, 0).otherwise(1)
    numbered = slots.where(~F.col("calm")).select("client", "slot").withColumn("_start", starts)
    return numbered.withColumn("segment", F.max(F.when(F.col("_start") == 1, F.col("slot"))).over(order)).drop("_start")


def limit_batch(df: DataFrame, key: str = "user_id", ts: str = "ts", row_id: str = "msg_id", window_seconds: int = 60, limit: int = 30) -> DataFrame:
    """client, id, ts, accepted: what a sliding-window limiter says to every row, rejected ones not counting towards the window.

    Rows of a client come in order of (ts, id); key and id may be of any type that sorts.  Time is cut into slots one window
    long.  A slot is calm if no window that ends in it holds more rows than the limit: all its rows are accepted, whatever was
    before, and they are all that the next slot needs to know.  A gap of a window is a calm slot without rows.  Only runs of busy slots are
    walked, each on its own with the calm slot before it; a walk streams over sorted rows and keeps ``limit`` times.
    Rows without a client count as one client; rows without a time are not limited (accepted is null).
    """
    width = window_seconds * 1_000_000
    rows = df.select(F.col(key).alias("client"), F.col(row_id).alias("id"), F.col(ts).alias("ts")).withColumn(
        "us", F.unix_micros(F.col("ts").cast("timestamp")))
    timed = rows.where("us is not null").withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("client").cast("string")), F.lit("")))
    counted = submission_rate(timed, "_key", "ts", window_seconds, limit).withColumn("slot", F.floor(F.col("us") / width))
    slots = counted.groupBy(F.col("_key").alias("client"), "slot").agg((F.max("recent") <= limit).alias("calm"))
    segments = busy_segments(slots)
    named = segments.select(F.col("client").alias("_key"), "slot", "segment")
    before = segments.where("slot = segment").select(F.col("client").alias("_key"), (F.col("slot") - 1).alias("slot"), F.col("segment").alias("_next"))
    met = counted.join(named, ["_key", "slot"], "left").join(before, ["_key", "slot"], "left")
    judge = met.where("segment is not null").select("_key", "segment", "us", "id", "client", "ts", F.lit(True).alias("asked"))
    known = met.where("segment is null and _next is not null").select("_key", F.col("_next").alias("segment"), "us", "id", "client", "ts", F.lit(False).alias("asked"))
    walked = judge.unionByName(known).repartition("_key", "segment").sortWithinPartitions("_key", "segment", "us", "id").mapInPandas(
        _walker(width, limit), judge.select("client", "id", "ts").withColumn("accepted", F.lit(True)).schema)
    calm = met.where("segment is null").select("client", "id", "ts", F.lit(True).alias("accepted"))
    return walked.unionByName(calm).unionByName(rows.where("us is null").select("client", "id", "ts", F.lit(None).cast("boolean").alias("accepted")))


def _walker(width: int, limit: int):
    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = None, deque()
        for rows in chunks:
            keys, segments, us = rows["_key"].to_numpy(), rows["segment"].to_numpy(), rows["us"].to_numpy()
            ok = np.zeros(len(rows), bool)
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(rows)]):
                if lo == hi:
                    continue
                if (keys[lo], segments[lo]) != at:
                    at, taken = (keys[lo], segments[lo]), deque()
                while lo < hi:
                    now = us[lo]
                    while taken and now - taken[0] >= width:
                        taken.popleft()
                    if len(taken) < limit:
                        taken.append(now)
                        ok[lo] = True
                        lo += 1
                    elif taken:  # full: nothing is accepted before the oldest leaves
                        lo += int(np.searchsorted(us[lo:hi], taken[0] + width))
                    else:
                        break
            yield rows[["client", "id", "ts"]].assign(accepted=ok)[rows["asked"].to_numpy()]

    return run


# -- exact limiter over a stream ---------------------------------------------------------------------------------------------

def limit_stream(df: DataFrame, key: str = "user_id", ts: str = "ts", row_id: str = "msg_id", window_seconds: int = 60,
                 limit: int = 30, delay: str = "10 minutes") -> DataFrame:
    """client, id, us, accepted, late: accept or reject each submission; rejected ones do not count towards the window.

    Key and id may be of any type.  State per client: the times it accepted in the last window and ``delay``.  Rows of one
    micro-batch are put in time order per client; a row older than others that were judged before it is held against the
    accepted times around it.  Rows behind the watermark come out too, flagged ``late`` and not accepted, and change nothing.
    Rows without a time are not limited (accepted is null).  No timer is set: an event-time one makes Spark drop late rows
    unseen, a processing-time one never lets a bounded run end; an idle client keeps its few times until it comes back.
    The source's batch size (``maxFilesPerTrigger``) bounds what a task holds.
    """
    width = window_seconds * 1_000_000
    kinds = dict(df.dtypes)

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = max(state.getCurrentWatermarkMs(), 0) * 1000
        accepted = sorted(state.get[0]) if state.exists else []
        rows = pd.concat(list(chunks)).sort_values(["us", "id"], kind="stable")
        verdicts, late = [], []
        for us in rows["us"].tolist():
            behind = us < mark
            ok = not behind and _fits(accepted, us, width, limit)
            if ok:
                insort(accepted, us)
            verdicts.append(ok)
            late.append(behind)
        accepted = accepted[bisect_right(accepted, mark - width):]  # no row on time can meet older ones
        if accepted:
            state.update((accepted,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"client": [k[0]] * len(rows), "id": rows["id"].values, "us": rows["us"].values, "accepted": verdicts, "late": late})

    slim = df.withWatermark(ts, delay).select(
        F.col(key).alias("client"), F.col(row_id).alias("id"), F.unix_micros(F.col(ts)).alias("us"), F.col(ts))
    judged = slim.where("us is not null").groupBy("client").applyInPandasWithState(
        step, f"client {kinds[key]}, id {kinds[row_id]}, us long, accepted boolean, late boolean", "accepted array<long>", "append",
        GroupStateTimeout.NoTimeout)
    return judged.unionByName(slim.where("us is null").select("client", "id", "us", F.lit(None).cast("boolean").alias("accepted"), F.lit(False).alias("late")))


def _fits(accepted: list[int], us: int, width: int, limit: int) -> bool:
    """Whether ``us`` may join the sorted accepted times: no window around it would then hold more than the limit."""
    lo, hi = bisect_right(accepted, us - width), bisect_right(accepted, us + width - 1)
    near = accepted[lo:hi]
    if len(near) < limit:
        return True
    at = bisect_right(near, us)
    near.insert(at, us)
    return all(near[i + limit] - near[i] >= width for i in range(max(0, at - limit), min(at, len(near) - 1 - limit) + 1))
