"""Derive fields level by level, either as table columns or inside an array of structs.

A *step* is a list of ``(name, fn)`` where ``fn(get)`` builds the new field from
earlier ones through ``get(name)``.  Fields of one step may use only fields of
earlier steps, so every intermediate value is computed once.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Step = Sequence[tuple[str, Callable[[Callable[[str], Column]], Column]]]


def derive(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.withColumns({name: fn(F.col) for name, fn in step})
    return df


def derive_array(arr: Column, steps: Sequence[Step], keep: Sequence[str] | None = None) -> Column:
    """The same steps applied to each struct of ``arr``."""
    for step in steps:
        arr = F.transform(arr, _grow(step))
    if keep is None:
        return arr
    return F.transform(arr, lambda x: F.struct(*[x[f].alias(f) for f in keep]))


def _grow(step: Step):
    def grow(x):
        out = x
        for name, fn in step:
            out = out.withField(name, fn(lambda n: x[n]))
        return out

    return grow
