"""Derived tables: written once to the shared folder and read back."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Rows of a narrow table that may be broadcast: some tens of MB at most.
SMALL_ROWS = 400_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for derived tables: below the cluster's shared folder, else (local runs) a temporary one."""
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="lureframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def derived(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a written table: a short lineage, and nothing is computed twice."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written narrow table for one side of a join: broadcast where it has few rows, by count."""
    return F.broadcast(table) if table.count() <= rows else table
