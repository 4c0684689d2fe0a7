"""Sorts, limits and top-k (K1-K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastframe.sources.ordered import running_total


def topk_by_group(df: DataFrame, keys: list[str], value: str, k: int, meets: str | None = None, ascending: bool = False, tie: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """K1: per group, slots 1..k (rows that meet the threshold first, then by value), padded with null, and sum and mean of all non-zero values."""
    order: list[Column] = [F.expr(meets).desc()] if meets else []
    order += [F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last(), *([F.col(tie)] if tie else [])]
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    slots = [F.max(F.when(F.col("__r") == i, F.col(c))).alias(f"{c}_top_{i}") for i in range(1, k + 1) for c in (value, *carry)]
    real = F.when(F.col(value) != 0, F.col(value))
    return ranked.groupBy(*keys).agg(*slots, F.sum(real).alias(f"{value}_sum"), F.avg(real).alias(f"{value}_mean"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """K2: the last (or first) row of each key by `order`: a partial aggregation, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min_by if first else F.max_by)(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def most_recent(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """K3: the n latest rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def last_n_rows(df: DataFrame, n: int, date: str, order: list[str]) -> DataFrame:
    """K4: the last n rows by date and order: whole dates by their counts, only the oldest date is ranked."""
    counts = df.groupBy(F.to_date(date).alias("__day")).agg(F.count("*").alias("__n"))
    later = F.sum("__n").over(Window.orderBy(F.col("__day").desc()).rowsBetween(Window.unboundedPreceding, -1))
    room = counts.withColumn("__room", n - F.coalesce(later, F.lit(0))).where("__room > 0")
    got = df.withColumn("__day", F.to_date(date)).join(room, "__day")
    split = got.where("__n > __room")
    kept = split.withColumn("__r", F.row_number().over(Window.partitionBy("__day").orderBy(*[F.col(c).desc() for c in order]))).where("__r <= __room").drop("__r")
    return got.where("__n <= __room").unionByName(kept).select(*df.columns)


def last_n_dates(df: DataFrame, n: int, date: str) -> DataFrame:
    """K4: the rows of the n latest distinct dates."""
    days = df.select(F.to_date(date).alias("__day")).distinct().orderBy(F.col("__day").desc()).limit(n)
    return df.withColumn("__day", F.to_date(date)).join(F.broadcast(days), "__day", "left_semi").drop("__day")


def leaderboard(runs: DataFrame, by: str, baseline: str | None = None, ascending: bool = False, tie: str = "run_id") -> DataFrame:
    """K5: runs in order of a metric, missing ones last, with rank and improvement over the baseline column.

    A rank is the number of rows before, as a running total over range partitions counts them.
    """
    order = [F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), F.col(tie)]
    out = running_total(runs, order, "__before", name="leaderboard").withColumn("rank", (F.col("__before") + 1).cast("int")).drop("__before")
    return out.withColumn("improvement", F.col(by) - F.col(baseline)) if baseline else out


def top_features(imp: DataFrame, k: int, model: str = "model", feature: str = "feature", importance: str = "importance") -> DataFrame:
    """K6: the k most important features of each model, and in how many models' lists each one is."""
    w = Window.partitionBy(model).orderBy(F.col(importance).desc(), feature)
    top = imp.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.groupBy(feature).agg(F.count("*").alias("models"), F.min("__r").alias("best_rank"))


def select_within_tolerance(df: DataFrame, primary: str, tol_abs: float | None = None, tol_pct: float | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """K7: of the rows within a tolerance of the smallest primary metric, the first by the other metrics in order."""
    best = df.agg(F.min(primary).alias("__best"))
    room = (F.lit(tol_abs) if tol_abs is not None else F.lit(0.0)) if tol_pct is None else F.abs("__best") * tol_pct
    near = df.crossJoin(F.broadcast(best)).where(F.col(primary) <= F.col("__best") + room).drop("__best")  # one row
    return near.orderBy(*then, primary).limit(1)
