"""Spark SQL literals for small dimension data (folded to constants by Catalyst)."""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def sql_str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: Iterable[str]) -> str:
    items = ", ".join(sql_str(v) for v in values)
    return f"array({items})" if items else "cast(array() as array<string>)"


def str_array(values: Iterable[str]) -> Column:
    return F.expr(sql_array(values))


def str_map(pairs: Mapping[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_str(k)}, {sql_str(v)}" for k, v in pairs.items()) + ")")


def array_map(pairs: Mapping[str, Iterable[str]]) -> Column:
    if not pairs:
        return F.expr("cast(map() as map<string, array<string>>)")
    return F.expr("map(" + ", ".join(f"{sql_str(k)}, {sql_array(v)}" for k, v in pairs.items()) + ")")


def empty_strings() -> Column:
    return F.expr("cast(array() as array<string>)")
