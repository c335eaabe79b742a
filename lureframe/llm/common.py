"""Helpers shared by the operators: words, row keys, derived tables, caches of worker processes."""
from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.
SPACE_SET = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_keys(*cols: str) -> list[Column]:
    """Two 64-bit hashes of a row's columns: a key that is never null, equal only for equal rows."""
    return [F.xxhash64(F.lit(1), *cols).alias("k1"), F.xxhash64(F.lit(2), *cols).alias("k2")]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset in local mode (tests) a temporary folder becomes the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="lureframe-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back: a short lineage that lost executors do not touch."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that may be broadcast: some tens of MB at most.
SMALL_ROWS = 400_000


def if_small(derived: DataFrame) -> DataFrame:
    """A stored narrow table for the small side of a join: broadcast if it has few rows, by count, else joined by shuffle.

    The other side then holds whole texts, which stay where they are in the first case.
    """
    return F.broadcast(derived) if derived.count() <= SMALL_ROWS else derived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def process_cache(key, make):
    """``make()`` once in a worker process, whichever task asks first."""
    kept = sys.__dict__.setdefault("_lureframe_llm_cache", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
