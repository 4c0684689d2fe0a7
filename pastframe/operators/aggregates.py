"""Aggregation and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add_group_total(df: DataFrame, key: str, value: str, lines: list[str], out: str = "TOTAL_POINTS") -> DataFrame:
    """A1: the group's total on each of its rows, and its difference from every line."""
    got = df.withColumn(out, F.sum(value).over(Window.partitionBy(key)))
    return got.select("*", *[(F.col(out) - F.col(x)).alias(f"DIFF_FROM_{x}") for x in lines])


def collapse_event_rows(df: DataFrame, keys: list[str], side: str, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """A2: several rows of an event as one: out column -> (side, value column)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(side) == s, F.col(c))).alias(n) for n, (s, c) in spec.items()])


def pivot_features(df: DataFrame, keys: list[str], pivots: list[str], combos: list[tuple], values: list[str], prefix: str = "") -> DataFrame:
    """A3: one column per listed combination and value; the explicit list saves the pass that looks for it."""
    aggs = []
    for combo in combos:
        cond = reduce(lambda a, b: a & b, [F.col(p) == v for p, v in zip(pivots, combo, strict=True)])
        aggs += [F.max(F.when(cond, F.col(v))).alias(prefix + "_".join(map(str, (*combo, v)))) for v in values]
    return df.groupBy(*keys).agg(*aggs)


def to_entity_log(games: DataFrame, game: str, sides: dict[bool, dict[str, str]], shared: tuple[str, ...] = ()) -> DataFrame:
    """A4: one row per side of a game: for each value of HOME, out column -> column of the wide row."""
    rows = [F.struct(F.lit(home).alias("home"), *[F.col(c).alias(n) for n, c in cols.items()]) for home, cols in sides.items()]
    return games.select(game, *shared, F.explode(F.array(*rows)).alias("__s")).select(game, *shared, "__s.*")


def to_slots(df: DataFrame, key: str, value: str, n: int, prefix: str) -> DataFrame:
    """A5: a group's distinct values in order, in slots 1..n; null where there are fewer."""
    got = df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("__v"))
    return got.select(key, *[F.try_element_at("__v", F.lit(i)).alias(f"{prefix}_{i}") for i in range(1, n + 1)])


def lagged_season_count(df: DataFrame, keys: list[str], season: str, item: str, cond: Column, out: str) -> DataFrame:
    """Distinct items that meet a condition per key and season, under the next season; 0 where there are none."""
    n = df.where(cond).groupBy(*keys, (F.col(season) + 1).alias(season)).agg(F.count_distinct(item).alias(out))
    return df.join(n, [*keys, season], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def share_of_total(df: DataFrame, group: list[str], value: str, out: str = "share") -> DataFrame:
    """The value's share of its group's sum; a group whose sum is zero is an error when it is read."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumn("__t", total).withColumn(out, F.when(F.col("__t") != 0, F.col(value) / F.col("__t")).when(F.col("__t").isNotNull(), F.raise_error(F.lit("a group's total is zero")).cast("double"))).drop("__t")


def aggregate_sources(panel: DataFrame, keys: list[str], cols: list[str], age: str | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """Dispersion across sources: median, mean, population deviation (0 where none), range, count, largest age, sums."""
    aggs = [a for c in cols for a in (F.median(c).alias(f"{c}_median"), F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range"), F.count(c).alias(f"{c}_n"))]
    aggs += [F.max(age).alias(f"{age}_max")] if age else []
    return panel.groupBy(*keys).agg(*aggs, *[F.sum(c).alias(f"{c}_sum") for c in sums])


def direction_agreement(panel: DataFrame, keys: list[str], move: str) -> DataFrame:
    """How many sources moved up and down, their net, the dominant side's share of all and of movers (0 without movers)."""
    g = panel.groupBy(*keys).agg(F.count_if(F.col(move) > 0).alias("n_up"), F.count_if(F.col(move) < 0).alias("n_down"), F.count("*").alias("n_all"))
    top, movers = F.greatest("n_up", "n_down"), F.col("n_up") + F.col("n_down")
    return g.select(*keys, "n_up", "n_down", (F.col("n_up") - F.col("n_down")).alias("net"), movers.alias("n_movers"), (top / F.col("n_all")).alias("dominant_of_all"), F.coalesce(F.try_divide(top, movers), F.lit(0.0)).alias("dominant_of_movers"))


def median_of_groups(df: DataFrame, inner: list[str], outer: list[str], value: str, order: list[str]) -> DataFrame:
    """A10: per inner group the first and last value, its move and size; per outer group the medians of those."""
    o = F.struct(*order)
    g = df.groupBy(*inner).agg(F.min_by(value, o).alias("first"), F.max_by(value, o).alias("last"), F.count("*").alias("n"))
    g = g.withColumn("move", F.col("last") - F.col("first"))
    return g.groupBy(*outer).agg(*[F.median(c).alias(f"{value}_{c}_median") for c in ("first", "last", "move", "n")], F.count("*").alias("sources"))


def _quantile(sorted_: Column, q: float) -> Column:
    """Linear interpolation in a sorted array without nulls."""
    n = F.size(sorted_)
    at = (n - 1) * q
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.try_element_at(sorted_, lo + 1), F.try_element_at(sorted_, hi + 1)
    return F.when(n > 0, a + (b - a) * (at - lo))


def with_row_stats(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """Count, mean, population deviation, range, IQR and mean absolute deviation from the median of a row's values, nulls left out.

    The sorted values and their median are columns of their own on the way, so that they are computed once.
    """
    v, m, d = F.col("__v"), F.col("__m"), F.col("__d")
    n = F.size(v)
    got = df.withColumn("__v", F.array_sort(F.array_compact(F.array(*[F.col(c).cast("double") for c in cols]))))
    got = got.withColumn("__m", F.struct(F.when(n > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n).alias("mean"), _quantile(v, 0.5).alias("mid")))
    got = got.withColumn("__d", F.struct(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m["mean"]) * (x - m["mean"])).alias("sq"), F.array_sort(F.transform(v, lambda x: F.abs(x - m["mid"]))).alias("away")))
    out = {"n": n, "mean": m["mean"], "std": F.when(n > 0, F.sqrt(d["sq"] / n)), "range": F.when(n > 0, F.array_max(v) - F.array_min(v)), "iqr": _quantile(v, 0.75) - _quantile(v, 0.25), "mad": _quantile(d["away"], 0.5)}
    return got.select(*df.columns, *[c.alias(f"{prefix}_{k}") for k, c in out.items()])


def coverage(panel: DataFrame, by: list[str], game: str) -> DataFrame:
    """Rows and distinct games per group."""
    return panel.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(game).alias("games"))


def summarize_dynamics(df: DataFrame, move: str, moves: str) -> DataFrame:
    """One row: median and mean move, and the share that never moved."""
    return df.agg(F.median(move).alias("median_move"), F.avg(move).alias("mean_move"), F.avg((F.col(moves) == 0).cast("double")).alias("share_never_moved"), F.count("*").alias("rows"))


def daily_errors(df: DataFrame, date: str, actual: str, line: str) -> DataFrame:
    """Per date the mean value, line, error and absolute error."""
    e = F.col(actual) - F.col(line)
    return df.groupBy(F.to_date(date).alias("date")).agg(F.count("*").alias("games"), F.avg(actual).alias("mean_actual"), F.avg(line).alias("mean_line"), F.avg(e).alias("mean_error"), F.avg(F.abs(e)).alias("mae"))


def daily_accuracy(df: DataFrame, date: str, right: list[str]) -> DataFrame:
    """Per date how often each pick is right, and how often all are among rows where all are known."""
    both = reduce(lambda a, b: a & b, [F.col(c) for c in right])
    return df.groupBy(F.to_date(date).alias("date")).agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}_accuracy") for c in right], F.avg(both.cast("double")).alias("all_right"), F.count("*").alias("games"))


def null_pct(df: DataFrame) -> DataFrame:
    """Per column the percentage of nulls; one aggregate for all of them."""
    one = df.agg(*[(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_pct")) for i, c in enumerate(df.columns)])).alias("r")).select("r.*")


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, rows that repeat a whole row, rows that repeat a key."""
    full = df.groupBy(*df.columns).agg(F.count("*").alias("__c")).agg(F.sum("__c").alias("rows"), (F.sum("__c") - F.count("*")).alias("repeated_rows"))
    key = df.groupBy(*keys).agg(F.count("*").alias("__c")).agg((F.sum("__c") - F.count("*")).alias("repeated_keys"))
    return full.crossJoin(F.broadcast(key))  # one row each


def consensus_value(df: DataFrame, keys: list[str], col: str, how: str = "mode", ts: str | None = None) -> DataFrame:
    """The most common (of several the smallest) or mean value across sources; with ts, games before six in the morning count for the day before."""
    if ts:
        df = df.withColumn("event_date", F.date_sub(F.to_date(ts), F.when(F.hour(ts) < 6, 1).otherwise(0)))
        keys = [*keys, "event_date"]
    return df.groupBy(*keys).agg((F.mode(col, True) if how == "mode" else F.avg(col)).alias(f"{col}_{how}"))


def calibrate_timezone(df: DataFrame, local: str, utc: str, zones: list[str]) -> DataFrame:
    """For each candidate zone the median and largest size of what is left between local times and UTC, in minutes."""
    spark = df.sparkSession
    z = spark.createDataFrame([(x,) for x in zones], T.StructType([T.StructField("zone", T.StringType())]))
    left = (F.unix_timestamp(F.to_utc_timestamp(local, F.col("zone"))) - F.unix_timestamp(utc)) / 60
    return df.select(local, utc).crossJoin(F.broadcast(z)).groupBy("zone").agg(F.median(F.abs(left)).alias("median_residual"), F.max(F.abs(left)).alias("max_residual"), F.count("*").alias("rows"))  # zones: a short list
