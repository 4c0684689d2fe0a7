"""Leakage and data-quality audits (Q1-Q7)."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastframe.operators.splits import FoldSpec, fold_bounds


def assert_no_columns(df: DataFrame, patterns: list[str], allowed: tuple[str, ...] = ()) -> None:
    """Q1: no column fits a banned pattern."""
    if bad := [c for c in df.columns if c not in allowed and any(re.search(p, c) for p in patterns)]:
        raise ValueError(f"closing values among the features: {bad}")


def assert_no_leak(df: DataFrame, outcomes: list[str]) -> None:
    """Q3: no outcome among the columns, in whatever case."""
    if bad := sorted({c.lower() for c in outcomes} & {c.lower() for c in df.columns}):
        raise ValueError(f"outcomes among the features: {bad}")


def audit_reconstruction(df: DataFrame, target: str, features: list[str], high: float = 0.999, mid: float = 0.5, tol: float = 1e-6, least: int = 100) -> DataFrame:
    """Q2: features that are the target in disguise: those of |corr| above `high`, and pairs that add up to it within tol.

    Two aggregates: all correlations, then all sums of the pairs of features above `mid`.
    """
    spark = df.sparkSession
    both = {c: F.col(c).isNotNull() & F.col(target).isNotNull() for c in features}
    one = df.agg(*[x for c in features for x in (F.corr(c, target).alias(f"r_{c}"), F.count_if(both[c]).alias(f"n_{c}"))]).first()
    r = {c: one[f"r_{c}"] for c in features if one[f"n_{c}"] >= least and one[f"r_{c}"] is not None}
    out = [(c, None, float(v), one[f"n_{c}"]) for c, v in r.items() if abs(v) > high]
    pairs = list(combinations([c for c, v in r.items() if abs(v) > mid], 2))
    if pairs:
        gap = lambda a, b: F.abs(F.col(a) + F.col(b) - F.col(target))
        got = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.max(gap(a, b)).alias(f"g{i}"), F.count(gap(a, b)).alias(f"n{i}"))]).first()
        out += [(a, b, None, got[f"n{i}"]) for i, (a, b) in enumerate(pairs) if got[f"n{i}"] >= least and got[f"g{i}"] is not None and got[f"g{i}"] <= tol]
    return spark.createDataFrame(out, "feature string, partner string, corr double, n long")


def leak_probe(build: Callable[[DataFrame], DataFrame], df: DataFrame, target: str, late: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Q4: the rows of the built features that differ when the target of late rows (a SQL condition) is changed; there should be none."""
    changed = df.withColumn(target, F.when(F.expr(late), F.col(target) * -7 + 1001).otherwise(F.col(target)))
    a, b = (build(x).drop(target, *ignore) for x in (df, changed))
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def frame_differences(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-9) -> DataFrame:
    """Q5: keys on one side only, and values that differ by more than rtol (null equals null)."""
    cols = [c for c in a.columns if c not in keys and c in b.columns]
    j = a.select(*keys, F.struct(*cols).alias("__a")).join(b.select(*keys, F.struct(*cols).alias("__b")), keys, "full")

    def differs(c: str):
        x, y = F.col("__a")[c], F.col("__b")[c]
        if dict(a.dtypes)[c] in ("double", "float", "int", "bigint") or dict(a.dtypes)[c].startswith("decimal"):
            return ~F.coalesce(F.abs(x - y) <= rtol * F.greatest(F.abs(x), F.abs(y), F.lit(1.0)), x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    what = F.when(F.col("__a").isNull(), F.array(F.lit("only right"))).when(F.col("__b").isNull(), F.array(F.lit("only left"))).otherwise(F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in cols])))
    return j.select(*keys, what.alias("differs")).where(F.size("differs") > 0)


def assert_frames_equal(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-9) -> None:
    """Q5: fails with the first differences."""
    if set(a.columns) != set(b.columns):
        raise AssertionError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    if bad := frame_differences(a, b, keys, rtol).limit(5).collect():
        raise AssertionError(f"frames differ: {bad}")


def diagnose(games: DataFrame, schedule: DataFrame, game: str, home: str, start: str, minutes: float = 60) -> DataFrame:
    """Q6: games that don't have one row of each side, and those whose start is off the schedule's by more than that."""
    sides = games.groupBy(game).agg(F.count_if(F.col(home)).alias("n_home"), F.count_if(~F.col(home)).alias("n_away"), F.min(start).alias("start")).join(schedule.select(game, F.col(start).alias("planned")), game, "left")
    off = F.abs(F.unix_timestamp("start") - F.unix_timestamp("planned")) / 60
    why = F.array_compact(F.array(F.when((F.col("n_home") != 1) | (F.col("n_away") != 1), F.lit("sides")), F.when(off > minutes, F.lit("start"))))
    return sides.select(game, "n_home", "n_away", off.alias("minutes_off"), why.alias("problems")).where(F.size("problems") > 0)


def preflight(df: DataFrame, date: str, specs: dict[str, FoldSpec], required: list[str]) -> DataFrame:
    """Q7: per spec the folds that the data allow against those asked for, and the share of rows that have all required values."""
    days = [(r.d, r.n) for r in df.groupBy(F.to_date(date).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    keep = df.agg(F.avg(F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in [*required, required[0]]]) == 0, 1.0).otherwise(0.0))).first()[0]
    rows = [(name, s.folds, len(fold_bounds(days, s)), keep) for name, s in specs.items()]
    return df.sparkSession.createDataFrame(rows, "spec string, folds_wanted int, folds_possible int, rows_complete double")
