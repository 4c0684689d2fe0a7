"""Registered queries: every operator on the given tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pastframe.queries import folding, history, people, quotes, relational, rest, scoring, ticks

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (relational, history, ticks, scoring, folding, people, quotes, rest)


def queries() -> dict[str, Query]:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
