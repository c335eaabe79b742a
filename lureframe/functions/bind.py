"""Evaluate computed arrays once: inside lambdas and when they are unnested."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(body: Callable[[Column], Column], **values: Column | str) -> Column:
    """``body`` of a struct of ``values``, each evaluated once per row.

    A column used inside a lambda may be replaced by the expression that defines
    it when projections are merged, and would then run once per array element.
    A lambda variable cannot be replaced.
    """
    bound = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(bound), body), F.lit(0))


def unnest(df: DataFrame, array: Column | str, *keep: Column | str, pos: str = "ord", item: str | None = None) -> DataFrame:
    """One row per element of a computed array: ``keep``, the position, and the element.

    Structs are spread into columns; other elements become the column ``item``.
    The outer generator is used on purpose: for the plain one Spark infers a
    filter on the array and pushes its whole expression down to the scan, where
    it would be evaluated a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, "_item")).where(F.col(pos).isNotNull())
    names = [c for c in rows.columns if c != "_item"]
    return rows.select(*names, F.col("_item").alias(item) if item else "_item.*")
