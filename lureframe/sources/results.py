"""Result store: runs that become visible at once, tombstones, summaries; canonical CSV; the weights file.

Every write goes to a folder of its own (``attempt``) below each table, and counts
from the moment its marker is in ``_commits``: one small numbered file, put there last
by a rename that fails where the number is taken.  A reader takes the markers first and
then reads the attempts that they name, so it sees all tables of a run or none.

Rows never change in place.  Rows that a purge or a newer run takes away are named in
``_tombstones``, which reads leave out; ``compact_results`` writes what is left anew.
``summary`` holds additive counts of each run and day; what tombstones took is
subtracted from it, so a dashboard reads no result rows.
"""
from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import lexicon as lx
from ..operators.history import between_days, result_tables
from .derived import shared_folder  # noqa: F401

TABLES = ["investigations", "evidence", "entities", "analyses", "risk", "reports"]
#: What a purge and a newer run look rows up in, and what dashboards add up.
INDEX, SUMMARY = "keys", "summary"
GROUPS = ["user_id", "level", "primary"]
#: Tombstones that a table is broadcast: some 6 MB in the driver for each table that is read, and a compaction reads eight.
SMALL_ROWS = 40_000
#: Bytes of a row group, the least that a keyed read opens.
ROW_GROUP = 16 * 1024 * 1024


def _place(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever the cluster's file system has it."""
    place = _place(spark, path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# -- markers ---------------------------------------------------------------------------------------------------------------

@dataclass
class Snapshot:
    """What the markers up to ``number`` make visible: attempts, each with the runs that a later attempt replaced."""

    number: int = 0
    live: dict[str, set[str]] = field(default_factory=dict)
    runs: dict[str, str | None] = field(default_factory=dict)     # attempt: its run (None: several, from a compaction)
    tombstones: dict[str, int] = field(default_factory=dict)       # folder: rows
    schemas: dict[str, str] = field(default_factory=dict)
    taken: dict[str, int] | None = None                            # attempt: its rows with a tombstone, once they were counted

    def apply(self, m) -> None:
        self.number = m["number"]
        if m["kind"] == "compact":
            self.live, self.runs, self.tombstones = {}, {}, {}
        if m["kind"] == "write":
            for old in [a for a, r in self.runs.items() if r == m["run"]]:
                del self.live[old], self.runs[old]
            for old, r in self.runs.items():
                if r is None:
                    self.live[old].add(m["run"])
        if m["kind"] in ("write", "compact"):
            self.live[m["attempt"]], self.runs[m["attempt"]] = set(), m["run"]
            self.schemas = m["schemas"]
        if m["dead"]:
            self.tombstones[m["attempt"]] = m["dead"]

    def visible(self) -> Column:
        """Of rows with attempt and run: those of attempts that count."""
        out = F.col("attempt").isin(list(self.live))
        for attempt, hidden in self.live.items():
            if hidden:
                out &= (F.col("attempt") != attempt) | ~F.col("run").isin(list(hidden))
        return out


def snapshot(spark: SparkSession, path: str, upto: int | None = None) -> Snapshot:
    """The state of a store by its markers (``upto``: as it was after that marker)."""
    found, place = Snapshot(), _place(spark, f"{path}/_commits")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        schema = "number long, kind string, run string, attempt string, dead long, schemas map<string,string>"
        for m in sorted(spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/_commits").collect(), key=lambda m: m["number"]):
            if upto is None or m["number"] <= upto:  # one short row a commit, from the last compaction on after a vacuum
                found.apply(m)
    return found


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content; False where it is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, draft = _place(spark, path), _place(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(draft, target, plain)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _commit(spark: SparkSession, path: str, prepare: Callable[[Snapshot], dict | None]) -> dict | None:
    """Add the marker that ``prepare`` makes from the state; if another came first, prepare again from the new state."""
    while True:
        now = snapshot(spark, path)
        marker = prepare(now)
        if marker is None or _put(spark, f"{path}/_commits/{now.number + 1:012d}.json", json.dumps({"number": now.number + 1, **marker})):
            return marker


# -- reading ---------------------------------------------------------------------------------------------------------------

def _raw(spark: SparkSession, path: str, name: str, now: Snapshot) -> DataFrame:
    """Rows of the attempts that count, with attempt, run and day; tombstones not yet looked at."""
    if not now.live:
        raise ValueError(f"no run has been committed to {path}")
    schema = T.StructType.fromJson(json.loads(now.schemas[name]))
    for c, kind in (("attempt", T.StringType()), ("run", T.StringType()), ("day", T.DateType())):
        schema = schema.add(c, kind)
    folders = [f"{path}/{name}/attempt={a}" for a in now.live]
    rows = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*folders)
    return rows.where(now.visible()) if any(now.live.values()) else rows


def _dead(spark: SparkSession, path: str, now: Snapshot) -> DataFrame | None:
    """Tombstones of rows that would else be visible: attempt, run, day, msg_id and what the summary counts."""
    if not now.tombstones:
        return None
    rows = spark.read.parquet(*[f"{path}/_tombstones/{t}" for t in now.tombstones]).where(now.visible())
    return F.broadcast(rows) if sum(now.tombstones.values()) <= SMALL_ROWS else rows


def _rows(spark: SparkSession, path: str, name: str, now: Snapshot) -> DataFrame:
    """Rows that count.  Only attempts that lost many rows are shuffled to meet their tombstones; the few of all others are broadcast."""
    rows, dead = _raw(spark, path, name, now), _dead(spark, path, now)
    if dead is None:
        return rows
    left = lambda some, gone: some.join(gone.select("attempt", "msg_id"), ["attempt", "msg_id"], "left_anti").select(rows.columns)
    if sum(now.tombstones.values()) <= SMALL_ROWS:
        return left(rows, dead)
    if now.taken is None:  # one number for each attempt, the same for all tables
        now.taken = {r["attempt"]: r["count"] for r in dead.groupBy("attempt").count().collect()}
    few, many, total = [], [], 0
    for attempt in sorted(now.taken, key=now.taken.get):
        total += now.taken[attempt]
        (few if total <= SMALL_ROWS else many).append(attempt)
    if not many:
        return left(rows, F.broadcast(dead))
    of = lambda df, attempts: df.where(F.col("attempt").isin(attempts))
    out = left(of(rows, many), of(dead, many))
    if set(now.live) - set(many):
        kept = rows.where(~F.col("attempt").isin(many))
        out = out.unionByName(left(kept, F.broadcast(of(dead, few))) if few else kept)
    return out


def read_results(spark: SparkSession, path: str, upto: int | None = None) -> dict[str, DataFrame]:
    """The tables of one snapshot (six, or those that the store holds): committed runs only, of a message in several runs the latest, purged rows left out."""
    now = snapshot(spark, path, upto)
    if not now.live:
        raise ValueError(f"no run has been committed to {path}")
    return {t: _rows(spark, path, t, now).drop("attempt") for t in TABLES if t in now.schemas}


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """day, user_id, level, primary, n, score_sum of the visible rows, from the summaries and tombstones alone."""
    now = snapshot(spark, path)
    parts = _raw(spark, path, SUMMARY, now).select("day", *GROUPS, "n", "score_sum")
    dead = _dead(spark, path, now)
    if dead is not None:
        score = F.col("score").cast("decimal(20,6)")
        parts = parts.unionByName(dead.select("day", *GROUPS, F.lit(-1).cast("long").alias("n"), (-score).cast("decimal(38,6)").alias("score_sum")))
    total = parts.groupBy("day", *GROUPS).agg(F.sum("n").alias("n"), F.sum("score_sum").cast("decimal(38,6)").alias("score_sum"))
    return total.where("n > 0")


# -- writing ---------------------------------------------------------------------------------------------------------------

def _index_tables(batch: DataFrame) -> dict[str, DataFrame]:
    if "reject_reason" in batch.columns:
        batch = batch.where("reject_reason is null")
    user = F.col("user_id") if "user_id" in batch.columns else F.lit(None).cast("long")
    day = F.to_date("ts") if "ts" in batch.columns else F.current_date()
    keys = batch.select("msg_id", day.alias("day"), user.alias("user_id"), "level", "primary", "score")
    return {INDEX: keys, SUMMARY: summarised(keys)}


def summarised(keys: DataFrame, *more: str) -> DataFrame:
    return keys.groupBy(*more, "day", *GROUPS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("score").cast("decimal(20,6)")).cast("decimal(38,6)").alias("score_sum"))


def _write_tombstones(spark: SparkSession, path: str, doomed: DataFrame, folder: str) -> int:
    doomed.select("attempt", "run", "day", "msg_id", *GROUPS, "score").write.mode("overwrite").parquet(f"{path}/_tombstones/{folder}")
    return spark.read.parquet(f"{path}/_tombstones/{folder}").count()


def _ids(df: DataFrame) -> DataFrame:
    return df.select("msg_id").distinct()


#: What every store reads of an assessed batch (for its index and summary), and what each table reads besides.
KEY_COLUMNS = ("msg_id", "user_id", "ts", "reject_reason", "level", "primary", "score")
TABLE_COLUMNS = {
    "investigations": ("title", "source_label", "ocr_text", "input_types", "preview", "fingerprint", "sufficiency", "probability", "ml_label",
                       "ml_model", "ml_is_mock", "intel"),
    "evidence": ("evidence",),
    "entities": ("entities",),
    "analyses": ("ambiguous", "url_facts", "brands"),
    "risk": ("raw_score", "confidence", "contributors"),
    "reports": ("alternatives", "class_confidence", "summary", "objective", "objective_confidence", "recommendations", "ranked", "limitations",
                "conclusion", "sections"),
}


def stored_columns(triaged: DataFrame, tables: Sequence[str] = TABLES) -> DataFrame:
    """An assessed batch without what no table of a store (with these tables) reads (texts, hits, details of the URLs): a fraction of its bytes.

    A batch that is without it already stays as it is.
    """
    counted = {c: F.col(f"{c}.{one}").alias(c) for c, one in (("url_facts", "risk"), ("brands", "key"))  # only their number
               if c in triaged.columns and isinstance(triaged.schema[c].dataType.elementType, T.StructType)}
    read = [*KEY_COLUMNS, *(c for t in TABLES if t in tables for c in TABLE_COLUMNS[t])]
    return triaged.select(*[counted.get(c, F.col(c)) for c in read if c in triaged.columns])


def write_results(triaged: DataFrame, path: str, run: str | None = None, *, weights: dict[str, float] | None = None,
                  keep_staged: bool = False, stored: bool = False, tables: Sequence[str] = TABLES) -> str:
    """Add an assessed batch to the store as one run; gives the run's name.

    Nothing of it is visible until all tables are written and the marker stands; then all is.  A run written again under its name
    replaces itself; a message that other runs hold as well counts with the newest run only (their rows get tombstones), so a
    job repeated under a new name doubles nothing.  The batch is computed once into ``_staged`` (removed after
    success; whole with ``keep_staged``, else the columns that the tables read) and the tables are projections of it, so losing an executor never repeats the analysis of finished parts.
    ``stored``: the batch is read from a written table, so it is not staged again.
    ``tables``: those of the six that the store is to hold (the same for all its runs).  Index and summary are always written, so a store
    for dashboards alone needs none of them, and purges, newer runs and compactions work as in a whole store.
    Rows are rebalanced by day: a day's files follow its size, not the number of tasks, and a huge day is split.
    """
    run = run or f"r{uuid.uuid4().hex[:16]}"
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError("a run's name has letters, digits, dots and dashes")
    if not set(tables) <= set(TABLES):
        raise ValueError(f"a store has the tables {', '.join(TABLES)}")
    spark, attempt = triaged.sparkSession, f"a{uuid.uuid4().hex[:16]}"
    staged = f"{path}/_staged/run={run}/attempt={attempt}"
    batch = triaged
    if not stored:
        batch = triaged if keep_staged else stored_columns(triaged, tables)
        batch.write.parquet(staged)
        batch = spark.read.schema(batch.schema).parquet(staged)
    schemas = {}
    for name, table in {**result_tables(batch, weights, tuple(tables)), **_index_tables(batch)}.items():
        _write_table(table, path, name, attempt, run)
        schemas[name] = table.drop("day").schema.json()

    def prepare(now: Snapshot) -> dict:
        if now.live and set(now.schemas) != set(schemas):
            raise ValueError(f"this store holds {', '.join(t for t in TABLES if t in now.schemas) or 'no result tables'}")
        others = {a: hidden | {run} for a, hidden in now.live.items() if now.runs[a] != run}
        dead = 0
        if others:
            before = Snapshot(now.number, others, now.runs, now.tombstones, now.schemas)
            mine = spark.read.schema(T.StructType.fromJson(json.loads(schemas[INDEX]))).parquet(f"{path}/{INDEX}/attempt={attempt}")
            dead = _write_tombstones(spark, path, _rows(spark, path, INDEX, before).join(_ids(mine), "msg_id", "left_semi"), attempt)
        return {"kind": "write", "run": run, "attempt": attempt, "dead": dead, "schemas": schemas}

    _commit(spark, path, prepare)
    if not stored and not keep_staged:
        remove_folder(spark, staged)
    return run


def _write_table(table: DataFrame, path: str, name: str, attempt: str, run: str | None = None) -> None:
    """Files by run (the given one, else by column) and day: rows with an owner are ranged by owner and time, others ordered by message.

    Row groups then hold few owners, and a bloom filter tells whether one holds a message, so a keyed read skips most of them.
    """
    folders = ["day"] if run else ["run", "day"]
    if "user_id" in table.columns and name != SUMMARY:
        order = [*folders, *(c for c in ("user_id", "ts", "msg_id") if c in table.columns)]
        dealt = table.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        order = [*folders, *(["msg_id"] if "msg_id" in table.columns else [])]
        dealt = table.hint("rebalance", *folders).sortWithinPartitions(*order)
    writer = dealt.write.partitionBy(*folders)
    if "msg_id" in table.columns:
        writer = writer.option("parquet.bloom.filter.enabled#msg_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{name}/attempt={attempt}" + (f"/run={run}" if run else ""))


def purge_results(spark: SparkSession, path: str, ids: DataFrame, user_id, days: tuple[str, str] | None = None) -> int:
    """Take the given submissions, as far as the user owns them, out of all six tables; gives how many.

    One table of tombstones is written and becomes valid with its marker: no result file is touched, and a
    crash at any point leaves all rows or takes all of them.  ``days`` (first, last) narrows the search.
    """
    gone = 0

    def prepare(now: Snapshot) -> dict | None:
        nonlocal gone
        own = between_days(_rows(spark, path, INDEX, now), days).where(F.col("user_id") == user_id)
        folder = f"p{uuid.uuid4().hex[:16]}"
        dead = _write_tombstones(spark, path, own.join(_ids(ids), "msg_id", "left_semi"), folder)
        gone = _ids(spark.read.parquet(f"{path}/_tombstones/{folder}")).count() if dead else 0
        return {"kind": "purge", "attempt": folder, "dead": dead} if dead else None

    _commit(spark, path, prepare)
    return gone


def compact_results(spark: SparkSession, path: str) -> None:
    """Write what is visible anew as one attempt without tombstones; runs and days stay apart.  Reads go on meanwhile.

    Old attempts stay until ``vacuum_results``.  If another writer commits first, the work is done again from its state.
    """

    def prepare(now: Snapshot) -> dict | None:
        if not now.live:
            return None
        attempt = f"c{uuid.uuid4().hex[:16]}"
        for name in [*(t for t in TABLES if t in now.schemas), INDEX]:
            _write_table(_rows(spark, path, name, now).drop("attempt"), path, name, attempt)
        _write_table(summarised(_rows(spark, path, INDEX, now), "run"), path, SUMMARY, attempt)
        return {"kind": "compact", "run": None, "attempt": attempt, "dead": 0, "schemas": now.schemas}

    _commit(spark, path, prepare)


def vacuum_results(spark: SparkSession, path: str, older_than_hours: float = 24) -> int:
    """Delete attempts, tombstones and markers that no snapshot needs any more, if older than that; gives how many.

    The age protects writers at work and readers of an older snapshot.
    """
    now, fs_of = snapshot(spark, path), lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = spark._jvm.System.currentTimeMillis() - older_than_hours * 3_600_000
    needed = {f"attempt={a}" for a in now.live} | set(now.tombstones)
    schema = "number long, kind string"
    place = _place(spark, f"{path}/_commits")
    if fs_of(place).exists(place):
        compactions = [m["number"] for m in spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/_commits").where("kind = 'compact'").collect()]
        needed |= {f"{n:012d}.json" for n in range(max(compactions, default=1), now.number + 1)}
    removed = 0
    for name in [*TABLES, INDEX, SUMMARY, "_tombstones", "_commits"]:
        place = _place(spark, f"{path}/{name}")
        if fs_of(place).exists(place):
            for s in fs_of(place).listStatus(place):
                if s.getPath().getName() not in needed and s.getModificationTime() < limit:
                    removed += bool(fs_of(place).delete(s.getPath(), True))
    return removed


def write_canonical_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or [c for c in lx.DATASET_COLUMNS if c in df.columns])).write.mode("overwrite").csv(
        path, header=True, escape='"', quoteAll=False)


def load_weights(spark: SparkSession, path: str | None) -> dict[str, float]:
    """Channel weights: defaults overridden by a small JSON object; an unreadable file means defaults."""
    merged = dict(lx.CHANNEL_WEIGHTS)
    if path:
        try:
            text = spark.read.text(path, wholetext=True).head()[0]
            merged.update({k: float(v) for k, v in json.loads(text).items()})
        except Exception:  # a bad override must not stop a run
            return dict(lx.CHANNEL_WEIGHTS)
    return merged


def weights_table(spark: SparkSession, overrides: DataFrame) -> DataFrame:
    """The weights dimension as a table: defaults, overridden by (``channel``, ``weight``) rows."""
    base = spark.createDataFrame(list(lx.CHANNEL_WEIGHTS.items()), "channel string, base double")
    return base.join(overrides.select("channel", "weight"), "channel", "left").select(
        "channel", F.coalesce("weight", "base").alias("weight"))
