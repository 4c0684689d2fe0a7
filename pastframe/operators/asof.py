"""As-of panels and tick paths.

A tick: keys (game, market, book), line_ts, minutes_before_tip, and quotes. A horizon h reads only ticks with
minutes_before_tip >= h; of ticks at one moment the later row (largest `tie`) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastframe.functions.scalar import devig, to_decimal

#: The horizons in minutes, and how far back moves look.
GRID = (30, 60, 120, 240, 480, 720)
LOOKBACKS = (30, 60, 120)
KEYS = ["game_id", "market", "book"]


def resolve_line(left: Column, right: Column, market: Column) -> Column:
    """The left side's line, else the right side's, mirrored for spreads; moneylines have none."""
    return F.when(market != "moneyline", F.coalesce(left, F.when(market == "spread", -right).otherwise(right)))


def up_probability(left_price: Column, right_price: Column) -> Column:
    """The left side's probability without the margin."""
    return devig(to_decimal(left_price), to_decimal(right_price))["p"]


def market_level(line: Column, up: Column, market: Column) -> Column:
    """What moves: the line, or for moneylines the probability."""
    return F.when(market == "moneyline", up).otherwise(line)


def _grid(df: DataFrame, grid: tuple[int, ...], offset: str) -> DataFrame:
    """Each tick once per horizon that may read it."""
    return df.withColumn("horizon", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda h: h <= F.col(offset))))


def snapshot_panel(ticks: DataFrame, grid: tuple[int, ...] = GRID, keys: list[str] = KEYS, offset: str = "minutes_before_tip", tie: str = "tick_id") -> DataFrame:
    """Per key and horizon the last readable tick, how many there were, and how old it is; no row where there is none."""
    cols = [c for c in ticks.columns if c not in keys]
    g = _grid(ticks, grid, offset).groupBy(*keys, "horizon").agg(F.max_by(F.struct(*cols), F.struct(-F.col(offset), F.col(tie))).alias("__t"), F.count("*").alias("n_ticks"))
    return g.select(*keys, "horizon", "n_ticks", (F.col(f"__t.{offset}") - F.col("horizon")).alias("staleness"), *[F.col("__t")[c].alias(c) for c in cols])


def tick_deltas(ticks: DataFrame, level: str, price: str, keys: list[str] = KEYS, order: tuple[str, ...] = ("line_ts", "tick_id")) -> DataFrame:
    """T4: each tick's change of level against the one before, its sign, and whether only the price moved."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d, p = F.col(level) - F.lag(level).over(w), F.col(price) - F.lag(price).over(w)
    got = ticks.withColumn("delta", d).withColumn("__p", p)
    return got.withColumn("move_sign", F.signum("delta").cast("int")).withColumn("is_move", F.coalesce(F.col("delta") != 0, F.lit(False))).withColumn("price_only", F.coalesce((F.col("delta") == 0) & (F.col("__p") != 0), F.lit(False))).drop("__p")


def path_aggregates(ticks: DataFrame, level: str, grid: tuple[int, ...] = GRID, keys: list[str] = KEYS, offset: str = "minutes_before_tip", tie: str = "tick_id", opener: str | None = None, price: str | None = None) -> DataFrame:
    """T5: per key and horizon: ticks, moves, distinct levels, extremes, deviation, first direction, total path, opener, reversals.

    A reversal is a move whose sign differs from that of the move before; it is the same whatever horizon reads it.
    Ticks are summed up once, between neighbouring horizons, and a horizon's figures run on over what lies before it: one
    shuffle by key serves all, and no tick is copied to the horizons that read it.
    """
    d = tick_deltas(ticks, level, price or level, keys, ("line_ts", tie))
    timed = Window.partitionBy(*keys).orderBy("line_ts", tie)
    last_sign = F.last(F.when(F.col("is_move"), F.col("move_sign")), ignorenulls=True).over(timed.rowsBetween(Window.unboundedPreceding, -1))
    new = F.row_number().over(Window.partitionBy(*keys, level).orderBy(F.col(offset).desc(), tie)) == 1
    base = F.first(level, ignorenulls=True).over(timed.rowsBetween(Window.unboundedPreceding, 0))
    d = d.select("*", F.coalesce(F.col("is_move") & (F.col("move_sign") != last_sign), F.lit(False)).alias("is_reversal"), (new & F.col(level).isNotNull()).alias("__new"), (F.col(level) - base).alias("__x"))
    o = F.struct("line_ts", tie)
    moved, opens = F.when(F.col("is_move"), o), F.when(F.col(opener), F.struct(-F.unix_micros(F.col("line_ts").cast("timestamp")), tie)) if opener else None
    slot = F.array_max(F.filter(F.array(*map(F.lit, grid)), lambda h: h <= F.col(offset)))
    got = d.withColumn("__slot", slot).where("__slot is not null").groupBy(*keys, "__slot").agg(
        F.count("*").alias("n_ticks"), F.count_if("is_move").alias("n_moves"), F.count_if("price_only").alias("n_price_moves"), F.count_if("__new").alias("n_levels"), F.count_if("is_reversal").alias("n_reversals"),
        F.max(level).alias("level_max"), F.min(level).alias("level_min"), F.count(level).alias("__n"), F.sum("__x").alias("__s"), F.sum(F.col("__x") * F.col("__x")).alias("__q"), F.sum(F.abs("delta")).alias("path_length"),
        F.min(F.struct(o.alias("o"), F.col(level).alias("v"))).alias("__first"), F.max(F.struct(o.alias("o"), F.col(level).alias("v"))).alias("__last"), F.min(F.when(F.col("is_move"), F.struct(moved.alias("o"), "move_sign"))).alias("__turn"),
        *([F.max(F.when(opens.isNotNull(), F.struct(opens.alias("o"), F.col(level).alias("v")))).alias("__open")] if opener else []),
    )
    desc = Window.partitionBy(*keys).orderBy(F.col("__slot").desc())
    w = desc.rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("__first").over(w)["v"]
    open_ = F.coalesce(F.max("__open").over(w)["v"], first) if opener else first
    n, s, q = (F.sum(c).over(w) for c in ("__n", "__s", "__q"))
    sums = [F.sum(c).over(w).alias(c) for c in ("n_ticks", "n_moves", "n_price_moves", "n_levels")]
    run = got.select(
        *keys, "__slot", F.lead("__slot").over(desc).alias("__below"), *sums, F.max("level_max").over(w).alias("level_max"), F.min("level_min").over(w).alias("level_min"),
        F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))).alias("level_std"), F.coalesce(F.sum("path_length").over(w), F.lit(0.0)).alias("path_length"),
        open_.alias("opener"), F.max("__last").over(w)["v"].alias("level"), F.coalesce(F.min("__turn").over(w)["move_sign"], F.lit(0)).alias("first_direction"), F.sum("n_reversals").over(w).alias("n_reversals"),
    )
    reads = F.filter(F.array(*map(F.lit, grid)), lambda h: (h <= F.col("__slot")) & (F.col("__below").isNull() | (h > F.col("__below"))))
    return run.select(*keys, F.explode(reads).alias("horizon"), *[c for c in run.columns if c not in (*keys, "__slot", "__below")])


def lookback_moves(ticks: DataFrame, level: str, grid: tuple[int, ...] = GRID, windows: tuple[int, ...] = LOOKBACKS, keys: list[str] = KEYS, offset: str = "minutes_before_tip", tie: str = "tick_id") -> DataFrame:
    """The level's move over the w minutes before each horizon, whether there is such a window (0 if not), per hour, and acceleration.

    One panel over the grid and the grid moved by every window; each of its rows goes to the horizons that it is the present or the past of.
    """
    wide = tuple(sorted({h + w for h in grid for w in (0, *windows)}))
    panel = snapshot_panel(ticks.select(*keys, offset, tie, level), wide, keys, offset, tie).select(*keys, "horizon", level)
    uses = F.explode(F.array(*[F.struct((F.col("horizon") - w).alias("horizon"), F.lit(w).alias("w")) for w in (0, *windows)])).alias("__u")
    far = panel.select(*keys, uses, F.col(level).alias("__v")).where(F.col("__u.horizon").isin(list(grid)))
    out = far.groupBy(*keys, F.col("__u.horizon").alias("horizon")).agg(F.count_if(F.col("__u.w") == 0).alias("__here"), *[F.max(F.when(F.col("__u.w") == w, F.col("__v"))).alias(f"__{w}") for w in (0, *windows)])
    out = out.where("__here > 0").drop("__here").withColumnRenamed("__0", level)
    for w in windows:
        move = F.col(level) - F.col(f"__{w}")
        out = out.withColumn(f"has_{w}", F.col(f"__{w}").isNotNull().cast("int")).withColumn(f"move_{w}", F.coalesce(move, F.lit(0.0))).withColumn(f"velocity_{w}", F.coalesce(move * 60 / w, F.lit(0.0))).drop(f"__{w}")
    pairs = list(zip(windows, windows[1:], strict=False))
    return out.withColumns({f"acceleration_{a}_{b}": F.col(f"velocity_{a}") - F.col(f"velocity_{b}") for a, b in pairs}) if pairs else out


def path_shape(paths: DataFrame, hours: str | None = None) -> DataFrame:
    """On T5's columns: move since the opener, percent, direction, place in the range (0.5 if flat), moves per hour, reversal flags."""
    move, span = F.col("level") - F.col("opener"), F.col("level_max") - F.col("level_min")
    out = paths.withColumns({
        "open_move": move, "open_move_pct": F.try_divide(move, F.abs("opener")), "open_direction": F.signum(move).cast("int"),
        "range_position": F.when(span == 0, 0.5).otherwise(F.try_divide(F.col("level") - F.col("level_min"), span)),
        "reversed_vs_first": F.coalesce((F.signum(move) != F.col("first_direction")) & (F.col("first_direction") != 0) & (move != 0), F.lit(False)),
    })
    return out.withColumn("moves_per_hour", F.coalesce(F.try_divide("n_moves", hours), F.lit(0.0))) if hours else out


def source_deviation(panel: DataFrame, keys: list[str], level: str, z: float = 1.5) -> DataFrame:
    """Each source against the mean of all: signed, absolute, in deviations, and whether that is an outlier."""
    w = Window.partitionBy(*keys)
    got = panel.withColumn("__m", F.avg(level).over(w)).withColumn("__s", F.stddev_pop(level).over(w)).withColumn("deviation", F.col(level) - F.col("__m"))
    got = got.withColumn("abs_deviation", F.abs("deviation")).withColumn("deviation_z", F.coalesce(F.try_divide("deviation", "__s"), F.when(F.col("deviation").isNotNull(), 0.0)))
    return got.withColumn("is_outlier", F.coalesce(F.abs("deviation_z") > z, F.lit(False))).drop("__m", "__s")


def open_to_close(ticks: DataFrame, level: str, game: str = "game_id", market: str = "market", book: str = "book", order: tuple[str, ...] = ("line_ts", "tick_id")) -> DataFrame:
    """Per game and market the medians over books of opener, close, move and ticks."""
    from pastframe.operators.aggregates import median_of_groups

    return median_of_groups(ticks, [game, market, book], [game, market], level, list(order))


def inverse_group_weight(df: DataFrame, key: str, out: str = "weight") -> DataFrame:
    """1 / rows of the group."""
    return df.withColumn(out, 1 / F.count("*").over(Window.partitionBy(key)))


def slice_horizon(df: DataFrame, h: int, game: str = "game_id", horizon: str = "horizon") -> DataFrame:
    """One horizon; fails if a game has two rows there."""
    from pastframe.operators.joins import require_unique

    one = df.where(F.col(horizon) == h)
    require_unique(one, [game], f"horizon {h}")
    return one


def wide_names(market: str, book: str, feature: str) -> str:
    """The name of a pivoted feature."""
    return f"odds_{market}_{book}_{feature}"


def build_snapshot_dataset(ticks: DataFrame, base: DataFrame, history: DataFrame, markets: list[str], books: list[str], target: str, level: str = "level", grid: tuple[int, ...] = GRID) -> tuple[DataFrame, DataFrame]:
    """Per game and horizon: each market's and book's path features wide, the consensus, history, base features and target; and the scoring columns."""
    from pastframe.operators.aggregates import aggregate_sources, pivot_features
    from pastframe.operators.joins import assemble_dataset

    paths = path_shape(path_aggregates(ticks, level, grid))
    feats = ["level", "open_move", "n_moves", "n_reversals", "range_position"]
    wide = pivot_features(paths, ["game_id", "horizon"], ["market", "book"], [(m, b) for m in markets for b in books], feats, "odds_")
    agree = aggregate_sources(paths, ["game_id", "horizon", "market"], ["level"])
    agree = pivot_features(agree, ["game_id", "horizon"], ["market"], [(m,) for m in markets], ["level_median", "level_mean", "level_std", "level_range", "level_n"], "odds_consensus_")
    snaps = wide.join(agree, ["game_id", "horizon"]).withColumnRenamed("horizon", "snapshot")
    line = f"odds_consensus_{markets[0]}_level_median"
    train, scoring = assemble_dataset(base, snaps, history, sidecar=(target, line))
    label = F.col(target) - F.col(line)
    return inverse_group_weight(train.join(scoring.select("game_id", "snapshot", label.alias("line_error")), ["game_id", "snapshot"]), "game_id", "snapshot_weight"), scoring


