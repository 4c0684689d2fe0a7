"""History features that know only earlier rows.

Rows of a key are ordered by the given columns; the last of them should be an id, so that ties are decided. The current
row never enters its own feature unless the docstring says so, and null outcomes receive history without entering it.
Windows of one key and order are one sort, however many features are asked for: the functions return columns or take lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastframe.functions.scalar import haversine_km
from pastframe.operators.aggregates import with_row_stats
from pastframe.sources.ordered import running_total
from pastframe.sources.stored import stored


def spec(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def before(keys: list[str], order: list[str], n: int | None = None) -> WindowSpec:
    """The n rows before the current one, or all of them."""
    return spec(keys, order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def known_before(x: Column, keys: list[str], order: list[str]) -> Column:
    """How many non-null values the key has before the row. Over it, the RANGE frame (-n, -1) is the last n known rows."""
    return F.coalesce(F.count(x).over(before(keys, order)), F.lit(0))


def last_known(keys: list[str], n: int) -> WindowSpec:
    """The last n known rows before the current one, if __b is known_before: frames stay bounded however long a history is."""
    return Window.partitionBy(*keys).orderBy("__b").rangeBetween(-n, -1)


def _season(keys: list[str], season: str | None) -> list[str]:
    return [*keys, season] if season else keys


def rolling_mean(df: DataFrame, values: list[str], n: int, keys: list[str], order: list[str], season: str | None = None, out: str = "{}_last_{}_BEFORE") -> DataFrame:
    """Mean of the last n rows before (nulls within them skipped)."""
    w = before(_season(keys, season), order, n)
    return df.select("*", *[F.avg(v).over(w).alias(out.format(v, n)) for v in values])


def rolling_relative(df: DataFrame, values: list[str], n: int, keys: list[str], order: list[str], split: str) -> DataFrame:
    """The mean of the last n rows of this row's split less that of the last n rows of all."""
    w, ws = before(keys, order, n), before([*keys, split], order, n)
    return df.select("*", *[(F.avg(v).over(ws) - F.avg(v).over(w)).alias(f"{v}_{split}_minus_all_{n}_BEFORE") for v in values])


def rolling_window_diff(df: DataFrame, values: list[str], short: int, long: int, keys: list[str], order: list[str]) -> DataFrame:
    """Mean of the last `short` rows less that of the last `long`."""
    a, b = before(keys, order, short), before(keys, order, long)
    return df.select("*", *[(F.avg(v).over(a) - F.avg(v).over(b)).alias(f"{v}_last_{short}_minus_{long}_BEFORE") for v in values])


def _previous_season(df: DataFrame, keys: list[str], season: str, aggs: list[Column]) -> DataFrame:
    """Aggregates of each season under the number of the next one."""
    return df.groupBy(*keys, (F.col(season) + 1).alias(season)).agg(*aggs)


def season_to_date_mean(df: DataFrame, value: str, keys: list[str], order: list[str], season: str, fallback_n: int = 10) -> DataFrame:
    """Mean of this season so far, else of the season before, else of the last fallback_n rows."""
    prev = _previous_season(df, keys, season, [F.avg(value).alias("__prev")])
    now = F.avg(value).over(before([*keys, season], order))
    last = F.avg(value).over(before(keys, order, fallback_n))
    got = df.select("*", now.alias("__now"), last.alias("__last")).join(prev, [*keys, season], "left")
    return got.withColumn(f"{value}_season_mean_BEFORE", F.coalesce("__now", "__prev", "__last")).drop("__now", "__prev", "__last")


def season_to_date_std(df: DataFrame, value: str, keys: list[str], order: list[str], season: str) -> DataFrame:
    """Population deviation of this season so far, else the sample deviation of the season before."""
    prev = _previous_season(df, keys, season, [F.stddev_samp(value).alias("__prev")])
    got = df.withColumn("__now", F.stddev_pop(value).over(before([*keys, season], order))).join(prev, [*keys, season], "left")
    return got.withColumn(f"{value}_season_std_BEFORE", F.coalesce("__now", "__prev")).drop("__now", "__prev")


def rolling_wma(df: DataFrame, value: str, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Mean with linear weights; the row at lag k has weight m + 1 - k, m the smaller of n and the row number."""
    w = spec(keys, order)
    lags = [F.lag(value, k).over(w) for k in range(1, n + 1)]
    m = F.least(F.row_number().over(w), F.lit(n))
    weight = [F.when(x.isNotNull(), m + 1 - k) for k, x in enumerate(lags, 1)]
    add = lambda parts: reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    got = df.select("*", add([x * wt for x, wt in zip(lags, weight, strict=True)]).alias("__num"), add(weight).alias("__den"))
    return got.withColumn(f"{value}_wma_{n}_BEFORE", F.try_divide("__num", "__den")).drop("__num", "__den")


def slope(values: Column) -> Column:
    """Least-squares slope of an array over 1..m; null for fewer than two values."""
    m = F.size(values).cast("double")
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("y"), F.lit(0.0).alias("xy")), lambda a, v: F.struct((a["i"] + 1).alias("i"), (a["y"] + v).alias("y"), (a["xy"] + (a["i"] + 1) * v).alias("xy")))
    sx, sxx = m * (m + 1) / 2, m * (m + 1) * (2 * m + 1) / 6
    return F.when(m >= 2, (m * sums["xy"] - sx * sums["y"]) / (m * sxx - sx * sx))


def rolling_slope(df: DataFrame, value: str, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Slope over the non-null values of the last n rows, numbered 1..m."""
    got = df.withColumn("__v", F.collect_list(F.col(value).cast("double")).over(before(keys, order, n)))
    return got.withColumn(f"{value}_slope_{n}_BEFORE", slope(F.col("__v"))).drop("__v")


def build_rolling_features(df: DataFrame, prefixes: list[str], keys: list[str], order: list[str], windows: tuple[int, ...] = (5, 10), season: str | None = None, split: str | None = None) -> DataFrame:
    """The rolling means of every column with one of the prefixes, in one pass over one sort per key list."""
    cols = [c for c in df.columns if any(c.startswith(p) for p in prefixes) and not c.endswith("_BEFORE")]
    out = [F.avg(c).over(before(keys, order, n)).alias(f"{c}_last_{n}_BEFORE") for c in cols for n in windows]
    if season:
        out += [F.avg(c).over(before([*keys, season], order)).alias(f"{c}_season_mean_BEFORE") for c in cols]
    if split:
        out += [(F.avg(c).over(before([*keys, split], order, n)) - F.avg(c).over(before(keys, order, n))).alias(f"{c}_{split}_minus_all_{n}_BEFORE") for c in cols for n in windows[:1]]
    return df.select("*", *out)


def flag_history(df: DataFrame, flag: str, keys: list[str], order: list[str], season: str, n: int = 5) -> DataFrame:
    """The last known flag, its frequency over the last n known ones, and over the season; 0 where there are none."""
    w, ws = before(keys, order), before([*keys, season], order)
    got = df.withColumn("__b", known_before(F.col(flag), keys, order))
    freq = F.avg(flag).over(last_known(keys, n))
    return got.select(
        *df.columns, F.coalesce(F.last(flag, ignorenulls=True).over(w).cast("double"), F.lit(0.0)).alias(f"{flag}_last_BEFORE"),
        F.coalesce(freq, F.lit(0.0)).alias(f"{flag}_freq_{n}_BEFORE"), F.coalesce(F.avg(flag).over(ws), F.lit(0.0)).alias(f"{flag}_season_freq_BEFORE"),
    )


def record_before(df: DataFrame, result: str, keys: list[str], order: list[str], win: str = "W") -> DataFrame:
    """Wins so far and their share of games with a result; 0 before the first."""
    w = before(keys, order)
    wins, games = F.coalesce(F.count_if(F.col(result) == win).over(w), F.lit(0)), F.coalesce(F.count(result).over(w), F.lit(0))
    return df.select("*", wins.alias("wins_BEFORE"), F.coalesce(F.try_divide(wins, games), F.lit(0.0)).alias("win_ratio_BEFORE"))


def gap_days(df: DataFrame, keys: list[str], date: str, order: list[str], default: int = 7) -> DataFrame:
    """Days since the row before; `default` for the first."""
    return df.withColumn("rest_days_BEFORE", F.coalesce(F.datediff(date, F.lag(date).over(spec(keys, order))), F.lit(default)))


def ewm_recursive(df: DataFrame, value: str | list[str], keys: list[str], order: list[str], halflife: float = 10, valid: str | None = None) -> DataFrame:
    """Exponentially weighted mean, recursive form, over earlier rows that are valid and not null; 0 if none. For one column or several.

    A key's rows go by in order, and a task holds one mean a column: no row looks back at its history.
    """
    a = 1 - math.exp(-math.log(2) / halflife)
    values = [value] if isinstance(value, str) else list(value)
    names = [f"{v}_ewm_BEFORE" for v in values]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    x = [(F.when(F.expr(valid), F.col(v)) if valid else F.col(v)).cast("double").alias(f"__x{i}") for i, v in enumerate(values)]
    first = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1).alias("__first")
    kept = len(df.columns)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means: list[float | None] = [None] * len(names)
        for b in batches:
            begins, out = b.column(kept + len(names)).to_pylist(), []
            for i in range(len(names)):
                m, known = means[i], []
                for begin, v in zip(begins, b.column(kept + i).to_pylist(), strict=True):
                    if begin:
                        m = None
                    known.append(0.0 if m is None else m)
                    if v is not None:
                        m = v if m is None else m * (1 - a) + v * a
                means[i] = m
                out.append(pa.array(known, pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *out], names=[*b.schema.names[:kept], *names])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return df.select("*", *x, first).mapInArrow(folded, schema)


_FRAME_AGGS: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "median": lambda c: F.percentile(c, F.lit(0.5)), "min": F.min, "max": F.max,
}


def ranked_by_date(df: DataFrame, most: int, date: str, order: list[str], cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, __day, __r, __n, __c, cols): the last `most` rows of every date, __r 1 the latest, with the date's rows and those of earlier dates.

    One rank within a date and one count per date: no window runs over all rows, and a date passes on `most` rows at most.
    """
    d = df.select(*keys, F.to_date(date).alias("__day"), F.struct(*order).alias("__o"), *cols)
    day = d.groupBy(*keys, "__day").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    upto = day.withColumn("__c", F.coalesce(F.sum("__n").over(w), F.lit(0)))  # one row per key and date
    own = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(F.col("__o").desc()))).where(F.col("__r") <= most)
    return own.join(upto, [*keys, "__day"]).select(*keys, "__day", "__r", "__n", "__c", *cols)


def rows_before_dates(df: DataFrame, n: int, date: str, order: list[str], cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, __day, __back, cols): for every date the last n rows of strictly earlier dates, __back 1 the latest."""
    return meet_dates(ranked_by_date(df, n, date, order, cols, keys), n, cols, keys)


def meet_dates(ranked: DataFrame, n: int, cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """rows_before_dates from ranked_by_date's rows of n or more a date.

    A row's position in the key's order is its date's count of earlier rows and its rank within the date. Dates meet rows by
    blocks of n positions.
    """
    at = ranked.where(F.col("__r") <= n).withColumn("__pos", F.col("__c") + F.col("__n") - F.col("__r"))
    block = lambda c: F.floor(c / n)
    asked = ranked.where("__r = 1 and __c > 0").select(*keys, "__day", "__c", F.explode(F.array_distinct(F.array(block(F.col("__c") - n), block(F.col("__c") - 1)))).alias("__b"))
    met = asked.join(at.select(*keys, "__pos", block(F.col("__pos")).alias("__b"), *cols), [*keys, "__b"])
    return met.where((F.col("__pos") < F.col("__c")) & (F.col("__pos") >= F.col("__c") - n)).select(*keys, "__day", (F.col("__c") - F.col("__pos")).alias("__back"), *cols)


def rolling_prior_dates_rows(df: DataFrame, value: str, n: int, date: str, order: list[str], func: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    """Over the last n rows of strictly earlier dates; all rows of a date share the value."""
    name = f"{value}_{func}_{n}_rows_BEFORE"
    past = rows_before_dates(df, n, date, order, [value], keys).groupBy(*keys, "__day").agg(_FRAME_AGGS[func](value).alias(name))
    return df.withColumn("__day", F.to_date(date)).join(past, [*keys, "__day"], "left").drop("__day")


#: Values are cut into so many bins of about as many rows each where medians are taken over all rows.
MEDIAN_BINS = 256


def rolling_days(df: DataFrame, value: str, days: int, date: str, func: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, sum, count, std, min, max or median over the calendar days [d - days, d), per key or over all rows.

    Days are summed up first, and the window runs over one row per key and day. Medians per key are taken over the key's
    rows; those over all rows by counts of days and bins of values (median_of_days), so that no task sees all rows.
    """
    name = f"{value}_{func}_{days}d_BEFORE"
    w = Window.partitionBy(*keys).orderBy(F.unix_date("__day")).rangeBetween(-days, -1)  # one row per key and day
    got = df.withColumn("__day", F.to_date(date))
    if func == "median":
        past = median_of_days(got, value, days, name) if not keys else None
        return got.withColumn(name, F.percentile(value, F.lit(0.5)).over(w)).drop("__day") if keys else got.join(past, "__day", "left").drop("__day")
    mid = got.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("__mid"))  # squares are taken from here, so that they don't cancel
    x = F.col(value).cast("double")
    at = x - F.col("__mid")
    daily = got.crossJoin(F.broadcast(mid)).groupBy(*keys, "__day").agg(F.sum(at).alias("s"), F.sum(at * at).alias("q"), F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.first("__mid").alias("m"))  # one row
    s, q, n = (F.sum(c).over(w) for c in ("s", "q", "n"))
    of = {"mean": F.try_divide(s, n) + F.col("m"), "sum": F.when(n > 0, s + n * F.col("m")), "count": F.coalesce(n, F.lit(0)), "min": F.min("lo").over(w), "max": F.max("hi").over(w), "std": F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))}
    return got.join(daily.select(*keys, "__day", of[func].alias(name)), [*keys, "__day"], "left").drop("__day")


def median_of_days(df: DataFrame, value: str, days: int, name: str, bins: int = MEDIAN_BINS) -> DataFrame:
    """(__day, name): the exact median of all rows of the days [d - days, d), for every day of df; null without such rows.

    Rows are counted by day and value. Values are cut into bins of about as many rows by a running total over them. Counts
    run over the days of each bin, and over the bins of each day: so each day knows the bin of its middle ranks and the
    ranks within it, and only that bin's values of those days are ordered.
    """
    x = df.select("__day", F.col(value).cast("double").alias("v"))
    day = x.select("__day").distinct()
    some = stored(x.where("v is not null").groupBy("__day", "v").agg(F.count("*").alias("c")), "day-values")
    values = running_total(some.groupBy("v").agg(F.sum("c").alias("c")), [F.col("v")], "before", F.col("c"), "values")
    size = some.agg(F.ceil(F.greatest(F.sum("c"), F.lit(1)) / bins).alias("size"))
    some = stored(some.join(values.crossJoin(F.broadcast(size)).select("v", F.floor(F.col("before") / F.col("size")).alias("bin")), "v"), "binned")  # one row
    per = some.groupBy("bin", "__day").agg(F.sum("c").alias("c"))
    grid = day.crossJoin(F.broadcast(per.select("bin").distinct())).join(per, ["bin", "__day"], "left")  # bins times dates
    own = Window.partitionBy("bin").orderBy(F.unix_date("__day")).rangeBetween(-days, -1)
    upto = Window.partitionBy("__day").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("__day")
    grid = grid.withColumn("n", F.coalesce(F.sum("c").over(own), F.lit(0))).where("n > 0")
    grid = grid.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(all_)})
    rank = F.explode(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)))
    asked = grid.withColumn("rank", rank).where("rank >= before and rank < before + n").select("__day", "bin", (F.col("rank") - F.col("before")).alias("rank"))
    met = asked.groupBy("__day", "bin").agg(F.collect_list("rank").alias("ranks")).withColumn("then", F.explode(F.sequence(F.date_sub("__day", days), F.date_sub("__day", 1))))
    met = met.join(some.withColumnRenamed("__day", "then"), ["bin", "then"]).groupBy("__day", "bin", "v").agg(F.sum("c").alias("c"), F.first("ranks").alias("ranks"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("__day", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = met.withColumn("below", below).withColumn("k", F.size(F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))))
    return hits.where("k > 0").groupBy("__day").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias(name))


def rolling_days_mean(df: DataFrame, value: str, days: int, date: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """W14 for means at scale: sums per date first, the window runs over dates, and the result is joined back."""
    daily = df.groupBy(*keys, F.to_date(date).alias("__day")).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.unix_date("__day")).rangeBetween(-days, -1)
    mean = F.try_divide(F.sum("__s").over(w), F.sum("__n").over(w)).alias(f"{value}_mean_{days}d_BEFORE")
    return df.withColumn("__day", F.to_date(date)).join(daily.select(*keys, "__day", mean), [*keys, "__day"], "left").drop("__day")


def ewm_reach(span: int) -> int:
    """Rows further back than this weigh less than a double can tell."""
    return math.ceil(60 * math.log(2) / -math.log(1 - 2 / (span + 1)))


def ewm_by_date(df: DataFrame, value: str, span: int, date: str, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, __day, mean, deviation) of W15, one row per date."""
    return ewm_of_ranked(ranked_by_date(df, ewm_reach(span), date, order, [value], keys), value, (span,), keys)


def ewm_of_ranked(ranked: DataFrame, value: str, spans: tuple[int, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """ewm_by_date for several spans at once, from ranked_by_date's rows of the longest span's reach or more a date.

    Every row ages the weights by b, so a row's weight at a date is b to the power of the rows between. A date is summed
    up with the ages at its end, for all spans in one aggregation; its rows beyond a span's reach are left out. Dates lie in
    blocks of reach rows: within a block, sums of weights scaled up to the block's begin give every date's past, and of the
    blocks before only the one next to it still counts. Spans share the blocks of the longest of them as long as the shortest one's
    weights over a block keep within a double's exponents.
    """
    longest = max(spans)
    reach = ewm_reach(longest)
    b = {s: 1 - 2 / (s + 1) for s in spans}
    apart = tuple(s for s in spans if s != longest and -2 * reach * math.log2(b[s]) > 900)
    here = tuple(s for s in spans if s not in apart)
    x = F.col(value).cast("double")
    has = x.isNotNull().cast("double")
    aggs, base = [], {}
    for s in here:
        age = F.when(F.col("__r") <= ewm_reach(s), F.pow(F.lit(b[s]), F.col("__r") - 1)).otherwise(0.0)
        aggs += [F.sum(age * has).alias(f"__w{s}"), F.sum(age * age * has).alias(f"__ww{s}"), F.coalesce(F.sum(age * x), F.lit(0.0)).alias(f"__s{s}"), F.coalesce(F.sum(age * x * x), F.lit(0.0)).alias(f"__q{s}")]
        base |= {f"__w{s}": b[s], f"__ww{s}": b[s] * b[s], f"__s{s}": b[s], f"__q{s}": b[s]}
    t = ranked.where(F.col("__r") <= reach).groupBy(*keys, "__day").agg(F.first(F.col("__c") + F.col("__n")).alias("__e"), *aggs)
    t = t.withColumn("__k", F.floor(F.col("__e") / reach)).withColumn("__off", F.col("__e") - F.col("__k") * reach)
    grow = {c: F.pow(F.lit(v), F.col("__off")) for c, v in base.items()}
    inside = Window.partitionBy(*keys, "__k").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select(*keys, "__day", "__k", "__e", *[(F.sum(F.col(c) / grow[c]).over(inside) * grow[c]).alias(c) for c in base])
    was = F.max(F.struct("__e", *base)).over(Window.partitionBy(*keys).orderBy("__k").rangeBetween(-1, -1))  # one row per key and date
    gap = F.col("__e") - F.col("__was.__e")
    t = t.withColumn("__was", was).select(*keys, "__day", *[(F.col(c) + F.coalesce(F.col(f"__was.{c}") * F.pow(F.lit(v), gap), F.lit(0.0))).alias(c) for c, v in base.items()])
    by_day = Window.partitionBy(*keys).orderBy("__day")
    t = t.select(*keys, "__day", *[F.lag(c).over(by_day).alias(c) for c in base])  # one row per key and date
    out = []
    for s in here:
        w, ww = F.col(f"__w{s}"), F.col(f"__ww{s}")
        mean = F.try_divide(F.col(f"__s{s}"), w)
        var = F.try_divide(F.col(f"__q{s}"), w) - mean * mean
        fix = F.when(w * w - ww > 1e-12 * w * w, w * w / (w * w - ww))  # none for a single row
        out += [mean.alias(f"{value}_ewm_{s}_BEFORE"), F.when(fix.isNotNull(), F.sqrt(F.greatest(var * fix, F.lit(0.0)))).alias(f"{value}_ewstd_{s}_BEFORE")]
    t = t.select(*keys, "__day", *out)
    return t.join(ewm_of_ranked(ranked, value, apart, keys), [*keys, "__day"]) if apart else t


def ewm_prior_dates(df: DataFrame, value: str, span: int, date: str, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Exponentially weighted mean and bias-corrected deviation (adjusted form) over rows of earlier dates.

    Each row ages the weights, null ones too.
    """
    return df.withColumn("__day", F.to_date(date)).join(ewm_by_date(df, value, span, date, order, keys), [*keys, "__day"], "left").drop("__day")


def market_regime_features(df: DataFrame, actual: str, line: str, date: str, order: list[str], rows: tuple[int, ...] = (15, 30, 75, 150), days: tuple[int, ...] = (3, 7, 14), spans: tuple[int, ...] = (15, 30, 75), eps: float = 1e-6, open_line: str | None = None, books: tuple[str, ...] = ()) -> DataFrame:
    """How the line has done in the league lately: bias, error sizes, over and push rates, ratios, activity.

    With an opening line also how far the line moved to its close, with and without sign, how often the close came nearer,
    and the opening line's bias and errors; with two or more books' lines also how far they lie apart, in this row
    (deviation of the population, range) and lately.

    All features are computed once per date: from the last rows of earlier dates, from sums per date, and from weights
    folded by date. Rows are ranked within their date once, and the ranked table serves all windows and spans. A day window without a game is null, its game count 0.
    """
    e = F.col(actual) - F.col(line)
    extra: dict[str, Column] = {}
    if open_line:
        opened = F.col(actual) - F.col(open_line)
        extra |= {"__move": F.col(line) - F.col(open_line), "__open": opened, "__beats": F.when(e.isNotNull() & opened.isNotNull(), (F.abs(e) < F.abs(opened)).cast("double"))}
    if len(books) > 1:
        df = with_row_stats(df, list(books), "regime_crossbook").drop(*[f"regime_crossbook_{k}" for k in ("n", "mean", "iqr", "mad")])
        extra["__apart"] = F.col("regime_crossbook_std")
    g = df.select(*{*order, date}, F.to_date(date).alias("__day"), F.col(actual).alias("__a"), F.col(line).alias("__l"), e.alias("__err"), *[x.alias(c) for c, x in extra.items()])
    most = max([*rows, *map(ewm_reach, spans)])
    ranked = stored(ranked_by_date(g, most, date, order, ["__a", "__l", "__err", *extra]), "ranked")
    past = meet_dates(ranked, max(rows), ["__a", "__l", "__err", *extra])
    v = F.col("__err")
    parts = {"bias": v, "mae": F.abs(v), "std": v, "median": v, "over": (v > 0).cast("double"), "push": (v == 0).cast("double"), "tail": (F.abs(v) > 15).cast("double"), "score": F.col("__a"), "line": F.col("__l")}
    if open_line:
        o, m = F.col("__open"), F.col("__move")
        parts |= {"move": m, "abs_move": F.abs(m), "close_beats_open": F.col("__beats"), "open_bias": o, "open_mae": F.abs(o), "open_std": o}
    if "__apart" in extra:
        parts["crossbook_std"] = F.col("__apart")
    how = {"std": F.stddev_samp, "open_std": F.stddev_samp, "median": lambda c: F.percentile(c, F.lit(0.5))}
    t = past.groupBy("__day").agg(*[how.get(k, F.avg)(F.when(F.col("__back") <= n, c)).alias(f"regime_{k}_{n}_BEFORE") for n in rows for k, c in parts.items()])
    daily = g.groupBy("__day").agg(F.sum("__err").alias("s"), F.sum(F.abs("__err")).alias("a"), F.sum((v > 0).cast("double")).alias("o"), F.count("__err").alias("n"), F.count("*").alias("games"), *([F.sum(F.abs("__move")).alias("m"), F.count("__move").alias("nm")] if open_line else []))
    wd = {d: Window.partitionBy(F.lit(0)).orderBy(F.unix_date("__day")).rangeBetween(-d, -1) for d in (1, *days)}  # one row per date
    day_cols = [c for d in days for c in (F.try_divide(F.sum("s").over(wd[d]), F.sum("n").over(wd[d])).alias(f"regime_bias_{d}d_BEFORE"), F.try_divide(F.sum("a").over(wd[d]), F.sum("n").over(wd[d])).alias(f"regime_mae_{d}d_BEFORE"), F.try_divide(F.sum("o").over(wd[d]), F.sum("n").over(wd[d])).alias(f"regime_over_{d}d_BEFORE"))]
    day_cols += [F.coalesce(F.sum("games").over(wd[d]), F.lit(0)).alias(f"regime_games_{d}d_BEFORE") for d in (1, *days)]
    day_cols += [F.try_divide(F.sum("m").over(wd[d]), F.sum("nm").over(wd[d])).alias(f"regime_abs_move_{d}d_BEFORE") for d in days] if open_line else []
    t = daily.select("__day", *day_cols).join(t, "__day", "left")
    for short, long in ((15, 75), (30, 150)):
        if short in rows and long in rows:
            t = t.withColumn(f"regime_mae_ratio_{short}_{long}_BEFORE", F.col(f"regime_mae_{short}_BEFORE") / (F.col(f"regime_mae_{long}_BEFORE") + eps)).withColumn(f"regime_bias_accel_{short}_{long}_BEFORE", F.col(f"regime_bias_{short}_BEFORE") - F.col(f"regime_bias_{long}_BEFORE"))
    if spans:
        t = t.join(ewm_of_ranked(ranked, "__err", spans).withColumnsRenamed({f"__err_{k}_{s}_BEFORE": f"regime_{k}_{s}_BEFORE" for k in ("ewm", "ewstd") for s in spans}), "__day", "left")
    return df.withColumn("__day", F.to_date(date)).join(t, "__day", "left").drop("__day")


def prior_dynamics(log: DataFrame, values: list[str], team: str, date: str, order: list[str], season: str, windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Means of earlier games' dynamics per team over windows and the season, and of the league by date, the date before and earlier."""
    cols = [F.avg(v).over(before([team], order, n)).alias(f"{v}_team_{n}_BEFORE") for v in values for n in windows]
    cols += [F.avg(v).over(before([team, season], order)).alias(f"{v}_team_season_BEFORE") for v in values]
    day = log.groupBy(F.to_date(date).alias("__day")).agg(*[F.avg(v).alias(v) for v in values])
    league = day.select("__day", *[F.avg(v).over(Window.partitionBy(F.lit(0)).orderBy("__day").rowsBetween(-n, -1)).alias(f"{v}_league_{n}_BEFORE") for v in values for n in windows])
    return log.select("*", *cols).withColumn("__day", F.to_date(date)).join(league, "__day", "left").drop("__day")


def last_n_matchups(df: DataFrame, pair: list[str], value: str, order: list[str], n: int = 5) -> DataFrame:
    """The last n values of the same pair, latest first, null where there are fewer, and their mean."""
    w = spec(pair, order)
    lags = [F.lag(value, k).over(w).alias(f"{value}_matchup_{k}_BEFORE") for k in range(1, n + 1)]
    return df.select("*", *lags, F.avg(value).over(before(pair, order, n)).alias(f"{value}_matchup_mean_BEFORE"))


def season_expanding_mean(df: DataFrame, values: list[str], keys: list[str], order: list[str], season: str, default: float = 0.0) -> DataFrame:
    """Mean of the season so far, `default` at its start."""
    w = before([*keys, season], order)
    return df.select("*", *[F.coalesce(F.avg(v).over(w), F.lit(default)).alias(f"{v}_season_avg_BEFORE") for v in values])


def pregame_averages(log: DataFrame, value: str, team: str, home: str, game: str, order: list[str], n: int = 5, season: str | None = None) -> DataFrame:
    """Per game, four means over the last n: of the home side in any game and at home, of the away side in any and away."""
    k = _season([team], season)
    got = log.select(game, home, F.avg(value).over(before(k, order, n)).alias("any"), F.avg(value).over(before([*k, home], order, n)).alias("own"))
    side = lambda flag, c: F.max(F.when(F.col(home) == flag, F.col(c)))
    return got.groupBy(game).agg(side(True, "any").alias(f"{value}_home_any_{n}"), side(True, "own").alias(f"{value}_home_home_{n}"), side(False, "any").alias(f"{value}_away_any_{n}"), side(False, "own").alias(f"{value}_away_away_{n}"))


def streak(df: DataFrame, keys: list[str], flag: str, order: list[str], season: str | None = None, seasons_back: int = 2) -> DataFrame:
    """How many rows in a row up to and with this one have the flag; rows of older seasons than seasons_back don't count.

    Positions less the position of the last row without the flag, or of the first row of the oldest season that counts.
    """
    w = spec(keys, order)
    rn = F.row_number().over(w)
    got = df.withColumn("__rn", rn)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    stop = F.coalesce(F.max(F.when(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)), F.col("__rn"))).over(upto), F.lit(0))
    got = got.withColumn("__stop", stop)
    if season:
        old = F.max(F.col("__rn")).over(Window.partitionBy(*keys).orderBy(season).rangeBetween(Window.unboundedPreceding, -seasons_back))
        got = got.withColumn("__stop", F.greatest("__stop", F.coalesce(old, F.lit(0))))
    return got.withColumn(f"{flag}_streak", F.col("__rn") - F.col("__stop")).drop("__rn", "__stop")


def last_valid_mean(df: DataFrame, value: str, keys: list[str], order: list[str], valid: str, n: int = 5) -> DataFrame:
    """For every row, the mean of the last n earlier rows that are valid."""
    good = F.when(F.expr(valid), F.col(value).cast("double"))
    got = df.withColumn("__x", good).withColumn("__b", known_before(F.col("__x"), keys, order))
    return got.withColumn(f"{value}_last_{n}_valid_BEFORE", F.avg("__x").over(last_known(keys, n))).drop("__x", "__b")


def travel_features(df: DataFrame, team: str, date: str, order: list[str], lat: str, lon: str, home: str, days: tuple[int, ...] = (1, 2, 5, 7, 14)) -> DataFrame:
    """Distance from the place before (0 if both at home or unknown), sums over the last days with today, and log1p."""
    w = spec([team], order)
    p = lambda c: F.lag(c).over(w)
    km = haversine_km(p(lat), p(lon), F.col(lat), F.col(lon))
    got = df.withColumn("travel_km", F.when(F.col(home) & p(home), 0.0).otherwise(F.coalesce(km, F.lit(0.0)))).withColumn("__d", F.unix_date(F.to_date(date)))
    sums = [F.sum("travel_km").over(Window.partitionBy(team).orderBy("__d").rangeBetween(-d, 0)).alias(f"travel_km_{d}d") for d in days]
    got = got.select("*", *sums).drop("__d")
    return got.select("*", *[F.log1p(f"travel_km_{d}d").alias(f"travel_km_{d}d_log1p") for d in days])


def jetlag_hours(df: DataFrame, team: str, date: str, order: list[str], zone: str, max_days: int = 4) -> DataFrame:
    """Difference of the zones' offsets at noon of this date; 0 if the place before is more than max_days back."""
    w = spec([team], order)
    noon = F.to_timestamp(F.concat(F.to_date(date).cast("string"), F.lit(" 12:00:00")))
    offset = lambda z: (F.unix_timestamp(noon) - F.unix_timestamp(F.to_utc_timestamp(noon, z))) / 3600
    last = F.lag(zone).over(w)
    near = F.datediff(date, F.lag(date).over(w)) <= max_days
    return df.withColumn("__z", last).withColumn("__near", near).withColumn("jetlag_hours", F.when(F.col("__near"), F.coalesce(offset(F.col(zone)) - offset(F.col("__z")), F.lit(0.0))).otherwise(0.0)).drop("__z", "__near")


def opponent_value(df: DataFrame, values: list[str], game: str) -> DataFrame:
    """The other side's value in the same game; only where both are there."""
    w = Window.partitionBy(game)
    return df.select("*", *[F.when(F.count(v).over(w) == 2, F.sum(v).over(w) - F.col(v)).alias(f"{v}_opp") for v in values])


def shift_to_next(df: DataFrame, keys: list[str], order: list[str], id_col: str, out: str = "next_id") -> DataFrame:
    """Each row under the id of the key's next row; null on the last."""
    return df.withColumn(out, F.lead(id_col).over(spec(keys, order)))


def _binned(df: DataFrame, value: str, bins: int) -> Column:
    """The bin of a value: borders are quantiles of all values, so that bins hold about as many distinct places."""
    some = df.agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], 10 * bins)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(some))]) if some else F.array().cast("array<double>"), lambda x: x < F.col(value)))


def _earlier(df: DataFrame, value: str, season: str, bins: int) -> tuple[DataFrame, DataFrame]:
    """(values, grid) of rows (season, __day, value): distinct values with their count c and bin; per season, day and bin,
    how many values of earlier days lie in the bin (n) and in lower ones (low)."""
    vals = df.where(F.col(value).isNotNull()).groupBy(season, "__day", F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    vals = vals.withColumn("__bin", _binned(vals, "__v", bins))
    cell = vals.groupBy(season, "__bin", "__day").agg(F.sum("__c").alias("__c"))
    grid = df.select(season, "__day").distinct().join(cell.select(season, "__bin").distinct(), season)  # days times bins
    grid = grid.join(cell, [season, "__bin", "__day"], "left")
    before_ = Window.partitionBy(season, "__bin").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(season, "__bin", "__day", F.coalesce(F.sum("__c").over(before_), F.lit(0)).alias("__n"))
    lower = Window.partitionBy(season, "__day").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    return vals, grid.withColumn("__low", F.coalesce(F.sum("__n").over(lower), F.lit(0)))


def _median_before(vals: DataFrame, grid: DataFrame, season: str) -> DataFrame:
    """(season, __day, median) of the values of earlier days: the bins that hold the middle ranks are known from the grid, and only these are ranked."""
    total = grid.groupBy(season, "__day").agg(F.sum("__n").alias("__all")).where("__all > 0")
    ranks = total.select(season, "__day", F.explode(F.array(F.floor((F.col("__all") + 1) / 2), F.floor((F.col("__all") + 2) / 2))).alias("__rank"), F.lit(1).alias("__one"))
    at = grid.where("__n > 0").join(ranks, [season, "__day"]).where((F.col("__rank") > F.col("__low")) & (F.col("__rank") <= F.col("__low") + F.col("__n")))
    asked = at.groupBy(season, "__bin", "__day").agg(F.collect_list(F.col("__rank") - F.col("__low")).alias("__ranks"))  # two ranks at most
    met = asked.join(vals.select(season, "__bin", F.col("__day").alias("__of"), "__v", "__c"), [season, "__bin"]).where(F.col("__of") < F.col("__day"))
    one = met.groupBy(season, "__bin", "__day", "__v").agg(F.sum("__c").alias("__c"), F.first("__ranks").alias("__ranks"))
    upto = F.sum("__c").over(Window.partitionBy(season, "__bin", "__day").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    hit = one.withColumn("__u", upto).withColumn("__hits", F.size(F.filter("__ranks", lambda r: (r <= F.col("__u")) & (r > F.col("__u") - F.col("__c")))))
    return hit.where("__hits > 0").groupBy(season, "__day").agg((F.sum(F.col("__v") * F.col("__hits")) / 2).alias("__median"))


def _share_before(vals: DataFrame, grid: DataFrame, season: str) -> DataFrame:
    """(season, __day, v, share): the share of earlier days' values that are v or less.

    Lower bins come from the grid. Within a bin a day is before another if, in binary, they first differ where it has a 0: for each place of the
    binary numbers, days that agree before it meet, those with a 0 are counted by those with a 1 in the order of the values.
    """
    days = vals.select(season, "__day").distinct().withColumn("__i", F.row_number().over(Window.partitionBy(season).orderBy("__day")))  # one row per day
    x = vals.join(days, [season, "__day"]).select(season, "__bin", "__day", "__v", "__c", "__i", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("__place"))
    one = F.expr("shiftright(__i, __place) & 1") == 1
    group = Window.partitionBy(season, "__bin", "__place", F.expr("shiftright(__i, __place + 1)")).orderBy("__v").rangeBetween(Window.unboundedPreceding, 0)
    got = x.withColumn("__s", F.coalesce(F.sum(F.when(~one, F.col("__c"))).over(group), F.lit(0))).withColumn("__s", F.when(one, F.col("__s")).otherwise(0))
    inside = got.groupBy(season, "__bin", "__day", "__v").agg(F.sum("__s").alias("__s"))
    total = grid.groupBy(season, "__day").agg(F.sum("__n").alias("__all"))
    return inside.join(grid.select(season, "__bin", "__day", "__low"), [season, "__bin", "__day"]).join(total, [season, "__day"]).select(season, "__day", "__v", F.try_divide(F.col("__s") + F.col("__low"), F.col("__all")).alias("__share"))


def season_prior_stats(df: DataFrame, value: str, line: str, date: str, season: str, bins: int = 128) -> DataFrame:
    """Mean, median, deviation and rate of a season's values on earlier dates, and where the line stands among earlier lines.

    Counts, sums and squares are per date first; median and share come from counts by date and bin of values, and only
    within a bin are values ranked. Neither a season nor its past is held in one row or ordered in one task.
    """
    d = df.withColumn("__day", F.to_date(date))
    day = d.groupBy(season, "__day").agg(F.sum(value).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q"), F.count(value).alias("__n"), F.sum(line).alias("__ls"), F.sum(F.col(line) * F.col(line)).alias("__lq"), F.count(line).alias("__ln"))
    w = Window.partitionBy(season).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    day = day.select(season, "__day", *[F.sum(c).over(w).alias(c) for c in ("__s", "__q", "__n", "__ls", "__lq", "__ln")])
    vals, grid = _earlier(d, value, season, bins)
    lines, line_grid = (vals, grid) if line == value else _earlier(d, line, season, bins)
    day = day.join(_median_before(vals, grid, season), [season, "__day"], "left")
    got = d.withColumn("__v", F.col(line).cast("double")).join(day, [season, "__day"], "left").join(_share_before(lines, line_grid, season), [season, "__day", "__v"], "left")
    mean = F.try_divide("__s", "__n")
    root = lambda v: F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))  # noqa: E731  rounding may leave a little below zero
    std = root(F.try_divide(F.col("__q") - F.col("__s") * mean, F.col("__n") - 1))
    lm = F.try_divide("__ls", "__ln")
    ls = root(F.try_divide(F.col("__lq") - F.col("__ls") * lm, F.col("__ln") - 1))
    return got.select(*df.columns, mean.alias(f"{value}_prior_mean"), F.col("__median").alias(f"{value}_prior_median"), std.alias(f"{value}_prior_std"), F.try_divide(F.col(line) - lm, ls).alias(f"{line}_prior_z"), F.col("__share").alias(f"{line}_prior_pct"))


def daily_context(df: DataFrame, values: list[str], date: str, windows: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Each day's mean over the whole board, and the mean of those of the days before."""
    day = df.groupBy(F.to_date(date).alias("__day")).agg(*[F.avg(v).alias(f"{v}_day_mean") for v in values], F.count("*").alias("day_games"))
    cols = [F.avg(f"{v}_day_mean").over(Window.partitionBy(F.lit(0)).orderBy("__day").rowsBetween(-n, -1)).alias(f"{v}_day_{n}_BEFORE") for v in values for n in windows]
    return df.withColumn("__day", F.to_date(date)).join(day.select("*", *cols), "__day", "left").drop("__day")


def rolling_reliability(preds: DataFrame, model: str, date: str, error: str, right: str, days: int = 5, buckets: tuple[str, ...] = ()) -> DataFrame:
    """Per row, size, MAE, accuracy and bias of the model over the last `days` distinct dates before, also within buckets."""
    got = preds
    for extra in ((), *((b,) for b in buckets)):
        keys = [model, *extra]
        tag = "".join(f"_{b}" for b in extra)
        dates = preds.select(model, F.to_date(date).alias("__day")).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(model).orderBy("__day")))
        day = preds.withColumn("__day", F.to_date(date)).groupBy(*keys, "__day").agg(F.count(error).alias("n"), F.sum(F.abs(error)).alias("a"), F.sum(error).alias("e"), F.sum(F.col(right).cast("double")).alias("r"), F.count(right).alias("rn")).join(dates, [model, "__day"])
        w = Window.partitionBy(*keys).orderBy("__k").rangeBetween(-days, -1)
        t = day.select(*keys, "__day", *[F.sum(c).over(w).alias(f"__{c}") for c in ("n", "a", "e", "r", "rn")])
        t = t.select(*keys, "__day", F.coalesce("__n", F.lit(0)).alias(f"reliability_n{tag}"), F.try_divide("__a", "__n").alias(f"reliability_mae{tag}"), F.try_divide("__e", "__n").alias(f"reliability_bias{tag}"), F.try_divide("__r", "__rn").alias(f"reliability_acc{tag}"))
        got = got.withColumn("__day", F.to_date(date)).join(t, [*keys, "__day"], "left").drop("__day")
    return got


#: Holidays of a fixed date, (month, day), and those of the n-th weekday, (month, weekday from Sunday 1, n; -1 the last).
FIXED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
FLOATING_HOLIDAYS = ((1, 2, 3), (2, 2, 3), (5, 2, -1), (9, 2, 1), (10, 2, 2), (11, 5, 4))


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    """Weekend, month, weekday and US federal holiday of a date."""
    d = F.to_date(date)
    month, day, dow = F.month(d), F.dayofmonth(d), F.dayofweek(d)
    fixed = reduce(lambda a, b: a | b, [(month == m) & (day == x) for m, x in FIXED_HOLIDAYS])
    nth = lambda n: F.ceil(day / 7) == n if n > 0 else day + 7 > F.dayofmonth(F.last_day(d))
    floating = reduce(lambda a, b: a | b, [(month == m) & (dow == w) & nth(n) for m, w, n in FLOATING_HOLIDAYS])
    return df.select("*", dow.isin(1, 7).cast("int").alias("is_weekend"), month.alias("month"), dow.alias("weekday"), (fixed | floating).cast("int").alias("is_us_holiday"))


def same_group_flags(df: DataFrame, a: str, b: str, groups: dict[str, dict[str, str]]) -> DataFrame:
    """For each grouping (conference, division ...), whether both sides are in the same one; unknown sides are 0."""
    for name, table in groups.items():
        m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        df = df.withColumn(f"same_{name}", F.coalesce(F.try_element_at(m, F.col(a)) == F.try_element_at(m, F.col(b)), F.lit(False)).cast("int"))
    return df
