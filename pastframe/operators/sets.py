"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from pastframe.operators.topk import latest_per_key


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all frames, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, keep: str = "last") -> DataFrame:
    """Distinct rows, or one row per key, the first or last by an explicit order."""
    return df.distinct() if keys is None else latest_per_key(df, keys, order, first=keep == "first")


def diff_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def common_keys(*dfs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that all frames have."""
    return reduce(lambda a, b: a.join(b, keys, "left_semi"), [d.select(*keys).distinct() for d in dfs])
