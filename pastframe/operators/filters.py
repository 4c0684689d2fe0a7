"""Filters, cleaning and repair."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slice_with_extras(df: DataFrame, seasons: list | None = None, lo=None, hi=None, extra_ids: tuple = (), season_col: str = "season", date_col: str = "date", id_col: str = "id") -> DataFrame:
    """rows of the seasons or dates, and always those of the extra ids; none after hi; whole repeats dropped."""
    want = F.lit(True)
    if seasons is not None:
        want = want & F.col(season_col).isin(list(seasons))
    if lo is not None:
        want = want & (F.col(date_col) >= F.lit(lo))
    if extra_ids:
        want = want | F.col(id_col).isin(list(extra_ids))
    return df.where(want if hi is None else want & (F.col(date_col) <= F.lit(hi))).distinct()


def keep_complete_groups(df: DataFrame, key: str, n: int = 2) -> DataFrame:
    """only groups of exactly n rows."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") == n).drop("__n")


def validate_rows(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """rows that meet all rules (SQL conditions; null is a failure), and the others with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def drop_groups_below(df: DataFrame, group: str, subgroup: str, value: str, min_total: float) -> DataFrame:
    """without the groups in which any subgroup's total is below the threshold (a total of nulls is)."""
    short = df.groupBy(group, subgroup).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__t")).where(F.col("__t") < min_total).select(group).distinct()
    return df.join(short, group, "left_anti")


def parse_minutes(c: Column) -> Column:
    """MM:SS or decimal minutes; anything else is 0; three decimals."""
    s = F.trim(c.cast("string"))
    clock = F.split(s, ":")
    mmss = F.try_element_at(clock, F.lit(1)).try_cast("double") + F.try_element_at(clock, F.lit(2)).try_cast("double") / 60
    return F.round(F.coalesce(F.when(s.rlike(r"^\d+:\d{1,2}$"), mmss).otherwise(s.try_cast("double")), F.lit(0.0)), 3)


def repair_home_flag(df: DataFrame, game: str, home: str, matchup: str, team: str) -> DataFrame:
    """only where a game has two rows of one side, the text decides: in `A @ B` B is at home, in `A vs. B` A is."""
    twice = F.count("*").over(Window.partitionBy(game, home)) > 1
    at, vs = F.split(F.col(matchup), r"\s+@\s+"), F.split(F.col(matchup), r"\s+vs\.?\s+")
    home_team = F.when(F.col(matchup).contains(" @ "), F.trim(F.try_element_at(at, F.lit(2)))).when(F.col(matchup).rlike(r" vs\.? "), F.trim(F.try_element_at(vs, F.lit(1))))
    return df.withColumn("__twice", twice).withColumn(home, F.when(F.col("__twice") & home_team.isNotNull(), F.col(team) == home_team).otherwise(F.col(home))).drop("__twice")


def normalize_duration(df: DataFrame, minutes: str, counts: list[str], points: str | None = None, regulation: float = 240, overtime: float = 259) -> DataFrame:
    """flags overtime and scales only the listed additive counts to regulation; raw points stay; points per 40 where minutes are sound."""
    m = F.col(minutes)
    ot = F.coalesce(m >= overtime, F.lit(False))
    out = df.withColumns({"is_overtime": F.when(m.isNotNull(), ot.cast("int")), **{c: F.when(ot, F.col(c) * regulation / m).otherwise(F.col(c)) for c in counts}})
    return out.withColumn(f"{points}_per_40", F.when((m > 0) & (m < regulation), F.col(points) * 40 / (m / 5)).otherwise(F.when(m >= regulation, F.col(points) * 40 / (m / 5)))) if points else out


def repair_spread_price_bleed(df: DataFrame, is_spread: Column) -> DataFrame:
    """F8: spread lines that aren't each other's mirror are prices that slipped: they move to the price columns, the lines become null."""
    bad = F.coalesce(is_spread & F.col("left_line").isNotNull() & F.col("right_line").isNotNull() & (F.col("left_line") != -F.col("right_line")), F.lit(False))
    new = {f"{s}_price": F.when(bad, F.col(f"{s}_line")).otherwise(F.col(f"{s}_price")) for s in ("left", "right")}
    return df.withColumn("repaired", bad).withColumns(new).withColumns({f"{s}_line": F.when(~F.col("repaired"), F.col(f"{s}_line")) for s in ("left", "right")})


def null_out_of_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]], when: Column | None = None) -> DataFrame:
    """values outside their bounds become null where the condition holds; rows and other columns stay."""
    cond = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    return df.withColumns({c: F.when(~cond | F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items()})


def drop_reasons(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """the first reason (in order) why a row can't be used, as one pass: the rows without one, and counts by reason."""
    why = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in reasons.items()])
    marked = df.withColumn("reason", why)
    return marked.where("reason is null").drop("reason"), marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


def select_point_in_time(df: DataFrame, keep: tuple[str, ...] = (r"_BEFORE$", r"_BEFORE_TEAM_(HOME|AWAY)$", r"^odds_", r"^TOTAL_LINE_"), static: tuple[str, ...] = (), banned: tuple[str, ...] = ()) -> DataFrame:
    """only columns whose names say that they are known before the game; a banned name that would survive is an error."""
    cols = [c for c in df.columns if c in static or any(re.search(k, c) for k in keep)]
    if leaked := [c for c in cols if c in banned]:
        raise ValueError(f"same-game columns would be features: {leaked}")
    return df.select(*cols)


def basic_clean(df: DataFrame, required: list[str], minimum: dict[str, float] = {}, casts: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """casts that give null where a value doesn't fit, then rows with a missing required value or one below its minimum go."""
    out = df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()}) if casts else df
    out = out.dropna(subset=required)
    return out.where(reduce(lambda a, b: a & b, [F.col(c) >= v for c, v in minimum.items()])) if minimum else out


def column_profile(df: DataFrame) -> DataFrame:
    """per column: null share, distinct values (approximate), and an order-free hash of its contents by row; one aggregate.

    A row's hash is a column of its own, computed once for all columns. Hashes of (row, value) are added up, in three parts
    of 21 bits that no number of rows under 2^42 overflows: rows that are repeated add to the sum, and don't cancel.
    """
    hashed = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    aggs, row = [], F.col("__row")
    total = lambda x: F.concat_ws(".", *[F.sum(F.shiftrightunsigned(F.xxhash64(row, x.cast("string")), k).bitwiseAND(F.lit((1 << 21) - 1))) for k in (0, 21, 42)])
    for i, c in enumerate(df.columns):
        x = F.col(f"c{i}")
        twin = F.abs(x) if isinstance(df.schema[c].dataType, T.NumericType) else x
        aggs += [F.avg(x.isNull().cast("double")).alias(f"n{i}"), F.approx_count_distinct(x).alias(f"d{i}"), total(x).alias(f"h{i}"), total(twin).alias(f"a{i}")]
    one = hashed.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_share"), F.col(f"d{i}").alias("distinct"), F.col(f"h{i}").alias("hash"), F.col(f"a{i}").alias("abs_hash")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Sums of so many tasks meet in one group where matrices are added up.
FAN = 16


def correlations(df: DataFrame, cols: list[str], above: float = -1.0, tasks: int | None = None) -> list[tuple[str, str, float]]:
    """Pairwise correlations of rows where both are there, those of a size over `above`, in one pass over the rows.

    A task adds up its rows' products as matrices, batch by batch, and gives one row per column: of the two halves of a
    symmetric matrix the one right of the diagonal. Input splits are dealt to `tasks` tasks (by default, the cluster's slots), so what
    is sent grows with those and the columns' square, not with the table. Rows of a column are added up FAN at a time, level
    by level, so a group never holds more than FAN of them, and turned into correlations column by column. Values are taken
    less their column's mean, so that nothing cancels.
    """
    if len(cols) < 2:
        return []
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    mean = np.array([m or 0.0 for m in x.agg(*[F.avg(c) for c in x.columns]).first()])
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    parts = ("n", "a", "aa", "b", "bb", "ab")
    shape = "part int, i int, " + ", ".join(f"{k} binary" for k in parts)

    def partial(batches):
        sums = None
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - mean
            there = (~np.isnan(v)).astype(float)
            v = np.nan_to_num(v, nan=0.0)
            new = there.T @ there, v.T @ there, (v * v).T @ there, v.T @ v
            sums = new if sums is None else tuple(s + t for s, t in zip(sums, new, strict=True))
        if sums is not None:
            n, a, aa, ab = sums
            part = TaskContext.get().partitionId()
            rows = {"n": n, "a": a, "aa": aa, "b": a.T, "bb": aa.T, "ab": ab}
            for i in range(len(mean) - 1):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "i": pa.array([i], pa.int32()), **{k: pa.array([np.ascontiguousarray(m[i, i + 1 :]).tobytes()], pa.binary()) for k, m in rows.items()}})

    def added(key, pdf):
        return pd.DataFrame({"part": np.array([key[0]], np.int32), "i": np.array([key[1]], np.int32), **{k: [sum(np.frombuffer(v) for v in pdf[k]).tobytes()] for k in parts}})

    def finished(key, pdf):
        n, a, aa, b, bb, ab = (sum(np.frombuffer(v) for v in pdf[k]) for k in parts)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (ab - a * b / n) / np.sqrt((aa - a * a / n) * (bb - b * b / n))
        j = np.flatnonzero(np.isfinite(r) & (np.abs(r) > above))
        return pd.DataFrame({"i": np.full(len(j), key[0], np.int32), "j": (j + key[0] + 1).astype(np.int32), "r": np.clip(r[j], -1, 1)})

    sums = x.coalesce(tasks).mapInArrow(partial, shape)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "i").applyInPandas(added, shape)
    got = sums.groupBy("i").applyInPandas(finished, "i int, j int, r double").orderBy("i", "j").collect()  # pairs above the threshold
    return [(cols[k.i], cols[k.j], k.r) for k in got]


def prune_columns(df: DataFrame, nan_pct: float = 50, corr: float = 0.99, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """without text, mostly null, constant, repeated, absolute-value-twin and highly correlated columns (the earlier of a pair goes)."""
    kinds = dict(df.dtypes)
    why: dict[str, str] = {c: "text" for c, t in kinds.items() if t == "string" and c not in keep}
    seen: dict[int, str] = {}
    twins: dict[int, str] = {}
    for r in column_profile(df.select(*[c for c in df.columns if c not in why])).toLocalIterator():
        c = r["column"]
        if c in keep:
            seen.setdefault(r["hash"], c)
            twins.setdefault(r["abs_hash"], c)
        elif r["null_share"] * 100 > nan_pct:
            why[c] = "null"
        elif r["distinct"] <= 1:
            why[c] = "constant"
        elif r["hash"] in seen:
            why[c] = f"same as {seen[r['hash']]}"
        elif r["abs_hash"] in twins:
            why[c] = f"twin of {twins[r['abs_hash']]}"
        else:
            seen[r["hash"]], twins[r["abs_hash"]] = c, c
    numeric = [c for c in df.columns if c not in why and isinstance(df.schema[c].dataType, T.NumericType)]
    for x, y, _ in correlations(df, numeric, corr):
        if x not in keep and x not in why and y not in why:
            why[x] = f"correlates with {y}"
    return df.drop(*why), why


def apply_missing_policy(df: DataFrame, required: list[str], fallback: dict[str, str] = {}, zero: tuple[str, ...] = (), flag: tuple[str, ...] = ()) -> DataFrame:  # noqa: B006
    """rows without a required value go; flags for market columns; values from a fallback column; zeros; the rest stays null."""
    out = df.dropna(subset=required) if required else df
    out = out.withColumns({f"{c}__is_missing": F.col(c).isNull().cast("byte") for c in flag}) if flag else out
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f)) for c, f in fallback.items()}) if fallback else out
    return out.fillna(0, subset=list(zero)) if zero else out


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """per row the names of the null columns and how many."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.withColumn("null_columns", names).withColumn("n_null", F.size("null_columns"))


def drop_rows_over(df: DataFrame, cols: list[str], most: int) -> DataFrame:
    """rows with more nulls than that go."""
    return null_profile(df, cols).where(F.col("n_null") <= most).drop("null_columns", "n_null")


def filter_by_prefix(df: DataFrame, id_col: str, types: dict[str, str], allowed: list[str]) -> DataFrame:
    """F16: rows whose id's prefix stands for an allowed type; unknown prefixes go."""
    n = len(next(iter(types)))
    return df.where(F.substring(id_col, 1, n).isin([k for k, v in types.items() if v in allowed]))


def season_floor(df: DataFrame, season: str, floor: int) -> DataFrame:
    """F16: seasons from floor on."""
    return df.where(F.col(season) >= floor)


def with_train_flag(df: DataFrame, barred: Column, out: str = "train_eligible") -> DataFrame:
    """false for rows that must not be trained on; unknown stays true."""
    return df.withColumn(out, ~F.coalesce(barred, F.lit(False)))


def add_over_label(df: DataFrame, value: str, line: str, out: str = "is_over") -> tuple[DataFrame, DataFrame]:
    """1 if the value is over its line, else 0; pushes and unknowns go. The second frame is one row: how many pushes."""
    margin = F.col(value) - F.col(line)
    return df.where(margin != 0).withColumn(out, (margin > 0).cast("int")), df.agg(F.count_if(margin == 0).alias("n_push"))


def not_started(df: DataFrame, start: str, now: str, placeholder: str = "23:59:59", date: str | None = None) -> DataFrame:
    """games that start after now; an unknown time is the end of the game's day."""
    end = F.to_timestamp(F.concat(F.to_date(date).cast("string"), F.lit(f" {placeholder}"))) if date else F.lit(None).cast("timestamp")
    return df.where(F.coalesce(F.col(start), end) > F.to_timestamp(F.lit(now)))


def apply_retention(df: DataFrame, season: str, min_season: int) -> tuple[DataFrame, DataFrame]:
    """seasons from min_season on (unknown ones stay), and counts of what stays and goes, in one pass."""
    old = F.coalesce(F.col(season) < min_season, F.lit(False))
    return df.where(~old), df.agg(F.count_if(old).alias("dropped"), F.count_if(~old).alias("kept"))


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share; null without trials."""
    p = F.try_divide(wins, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)
