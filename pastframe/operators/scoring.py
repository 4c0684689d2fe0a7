"""Baselines, bet scoring, calibration, consensus and settlement."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastframe.functions.scalar import entropy, to_decimal
from pastframe.operators.aggregates import with_row_stats
from pastframe.operators.filters import wilson
from pastframe.operators.topk import latest_per_key
from pastframe.sources.ordered import running_total

#: Fixed value: the price where a quote has none, -110 in decimal form.
DEFAULT_PRICE = 1 + 100 / 110


def error_metrics(actual: Column, pred: Column) -> list[Column]:
    """MAE, RMSE, bias and R2 over rows where both are there."""
    e = actual - pred
    y = F.when(e.isNotNull(), actual)
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (1 - F.try_divide(F.sum(e * e), F.count(e) * F.var_pop(y))).alias("r2")]


def line_baseline(df: DataFrame, actual: str, line: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The line as a prediction."""
    return df.groupBy(*by).agg(*error_metrics(F.col(actual), F.col(line)))


def bias_baseline(dev: DataFrame, df: DataFrame, actual: str, line: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The line plus the mean error of the development rows."""
    bias = dev.agg(F.avg(F.col(actual) - F.col(line)).alias("__b"))
    return df.crossJoin(F.broadcast(bias)).groupBy(*by).agg(*error_metrics(F.col(actual), F.col(line) + F.col("__b")))  # one row


def placed(df: DataFrame, edge: str, actual: str, line: str, price_over: str | None = None, price_under: str | None = None, min_edge: float = 0.0, default: float = DEFAULT_PRICE) -> DataFrame:
    """Rows on which a bet is made, with side, price, margin and profit per unit; a push gives the stake back. Unknown outcomes go."""
    e = F.col(edge)
    side = F.when(e > 0, 1).when(e < 0, -1)
    own = [F.coalesce(to_decimal(F.col(c)), F.lit(default)) if c else F.lit(default) for c in (price_over, price_under)]
    margin = (F.col(actual) - F.col(line)) * side
    b = df.where(F.abs(e) > min_edge).withColumns({"bet_side": side, "bet_price": F.when(side > 0, own[0]).otherwise(own[1]), "bet_margin": margin})
    b = b.where("bet_margin is not null")
    return b.withColumn("profit", F.when(F.col("bet_margin") > 0, F.col("bet_price") - 1).when(F.col("bet_margin") < 0, -1.0).otherwise(0.0))


def bet_metrics() -> list[Column]:
    """E8's aggregates over placed bets. Break-even is the mean of 1 / price, pushes included; ROI is per placed bet, the win rate per decided one."""
    w, lo = F.count_if(F.col("bet_margin") > 0), F.count_if(F.col("bet_margin") < 0)
    n = F.count("*")
    rate, even = F.try_divide(w, w + lo), F.avg(1 / F.col("bet_price"))
    low, high = wilson(w, w + lo)
    return [
        n.alias("n_bets"), w.alias("wins"), lo.alias("losses"), (n - w - lo).alias("pushes"), rate.alias("win_rate"), low.alias("win_rate_low"), high.alias("win_rate_high"), even.alias("break_even"),
        F.coalesce(F.sum("profit"), F.lit(0.0)).alias("profit"), F.try_divide(F.sum("profit"), n).alias("roi"), F.coalesce(low > even, F.lit(False)).alias("significant"),
    ]


def score_bets(df: DataFrame, edge: str, actual: str, line: str, by: tuple[str, ...] = (), **prices) -> DataFrame:
    """One row of bet metrics, or one per group."""
    return placed(df, edge, actual, line, **prices).groupBy(*by).agg(*bet_metrics())


def threshold_sweep(df: DataFrame, thresholds: list[float], edge: str, actual: str, line: str, **prices) -> DataFrame:
    """Bet metrics at each least edge."""
    b = placed(df, edge, actual, line, **prices).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.abs(edge) > F.col("threshold"))
    return b.groupBy("threshold").agg(*bet_metrics())


def edge_ranges(df: DataFrame, bins: list[float], edge: str, actual: str, line: str, **prices) -> DataFrame:
    """Bets, wins and profit by range of the edge, and the sums over this range and all above it."""
    k = reduce(lambda a, b: a + b, [(F.abs(edge) >= x).cast("int") for x in bins]) - 1
    g = placed(df, edge, actual, line, **prices).withColumn("range", k).where("range >= 0").groupBy("range").agg(F.count("*").alias("n_bets"), F.count_if(F.col("bet_margin") > 0).alias("wins"), F.count_if(F.col("bet_margin") < 0).alias("losses"), F.sum("profit").alias("profit"))
    w = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(F.element_at(F.array(*map(F.lit, bins)), F.col("range") + 1).alias("from_edge"), "n_bets", "wins", "losses", "profit", *[F.sum(c).over(w).alias(f"{c}_tail") for c in ("n_bets", "wins", "losses", "profit")])


def score_lines(df: DataFrame, pred: str, actual: str, lines: list[str], min_edge: float = 0.0) -> DataFrame:
    """The same predictions bet against each line, with that line's own error."""
    long = df.select(pred, actual, F.explode(F.array(*[F.struct(F.lit(x).alias("line_name"), F.col(x).alias("line")) for x in lines])).alias("s")).select(pred, actual, "s.*").withColumn("edge", F.col(pred) - F.col("line"))
    own = long.groupBy("line_name").agg(F.avg(F.abs(F.col(actual) - F.col("line"))).alias("line_mae"))
    return score_bets(long, "edge", actual, "line", ("line_name",), min_edge=min_edge).join(own, "line_name")


def score_by_snapshot(df: DataFrame, edge: str, actual: str, line: str, snapshot: str = "snapshot", game: str = "game_id", **prices) -> DataFrame:
    """Bet metrics per snapshot and pooled (snapshot null), with distinct games; grouping sets, so one pass."""
    b = placed(df, edge, actual, line, **prices)
    return b.groupingSets([[F.col(snapshot)], []], F.col(snapshot)).agg(*bet_metrics(), F.count_distinct(game).alias("n_games"), (F.grouping_id() > 0).alias("pooled"))


def verify_alignment(preds: DataFrame, src: DataFrame, keys: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    """One row: keys on one side only, and rows whose value differs."""
    a, b = preds.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__l")), src.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__r"))
    j = a.join(b, keys, "full")
    return j.agg(F.count_if(F.col("__r").isNull()).alias("only_predictions"), F.count_if(F.col("__l").isNull()).alias("only_source"), F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull() & ~F.coalesce(F.abs(F.col("__a") - F.col("__b")) <= tol, F.col("__a").isNull() & F.col("__b").isNull())).alias("different"))


def calibration_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width buckets of the probability (empty ones left out): size, mean probability, observed share, gap."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    return g.withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))


def calibration_summary(df: DataFrame, p: str, y: str, bins: int = 10, eps: float = 1e-15) -> DataFrame:
    """One row: expected calibration error, Brier score, log loss and base rate."""
    t = calibration_table(df, p, y, bins).agg(F.try_divide(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"))
    q, v = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps)), F.col(y).cast("double")
    s = df.agg(F.count(F.col(p) + v).alias("n"), F.avg((F.col(p) - v) * (F.col(p) - v)).alias("brier"), F.avg(-(v * F.log(q) + (1 - v) * F.log(1 - q))).alias("log_loss"), F.avg(v).alias("base_rate"))
    return s.crossJoin(F.broadcast(t))  # one row


def ou_accuracy(df: DataFrame, pred: str, actual: str, line: str, min_edges: list[float]) -> DataFrame:
    """How often the predicted side is right, per least edge; pushes don't count."""
    e, m = F.col(pred) - F.col(line), F.col(actual) - F.col(line)
    right = F.when((m != 0) & (e != 0), (F.signum(e) == F.signum(m)).cast("double"))
    return df.select(F.abs(e).alias("e"), right.alias("r"), F.explode(F.array(*map(F.lit, min_edges))).alias("min_edge")).where("e >= min_edge").groupBy("min_edge").agg(F.avg("r").alias("accuracy"), F.count("r").alias("decided"), F.count("*").alias("rows"))


def settle(df: DataFrame, picks: dict[str, str], actual: str, line: str, stake: float = 1.0, price: float = DEFAULT_PRICE) -> DataFrame:
    """Per pick (name -> column of over/under): right, profit; and for all picks together where they agree. Pushes are null and pay 0."""
    m = F.signum(F.col(actual) - F.col(line))
    cols: dict[str, Column] = {}
    sides = {n: F.when(F.col(c) == "over", 1).when(F.col(c) == "under", -1) for n, c in picks.items()}
    if len(sides) > 1:
        first = next(iter(sides.values()))
        sides["agree"] = F.when(reduce(lambda a, b: a & b, [s == first for s in sides.values()]), first)
    for n, s in sides.items():
        cols[f"{n}_right"] = F.when((m != 0) & s.isNotNull(), (s == m).cast("int"))
        cols[f"{n}_profit"] = F.when(s.isNull() | m.isNull(), F.lit(None)).when(m == 0, 0.0).otherwise(F.when(s == m, stake * (price - 1)).otherwise(-stake))
    return df.withColumns(cols)


def settlement_stats(settled: DataFrame, name: str, pick: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Bets, wins, profit and ROI per side (and group)."""
    s = settled.where(F.col(f"{name}_profit").isNotNull())
    return s.groupBy(*by, F.col(pick).alias("side")).agg(F.count("*").alias("n"), F.coalesce(F.sum(f"{name}_right"), F.lit(0)).alias("wins"), F.avg(f"{name}_right").alias("win_rate"), F.sum(f"{name}_profit").alias("profit"), F.avg(f"{name}_profit").alias("roi"))


def cv_scores(preds: DataFrame, edge: str, actual: str, line: str, fold: str = "fold", **prices) -> DataFrame:
    """Bet metrics per fold and pooled (fold null)."""
    return placed(preds, edge, actual, line, **prices).groupingSets([[F.col(fold)], []], F.col(fold)).agg(*bet_metrics())


def error_space(df: DataFrame, totals: list[str], errors: list[str], line: str) -> DataFrame:
    """Every model as an error against the line, their mean."""
    cols = {f"{c}_as_error": F.col(c) - F.col(line) for c in totals} | {f"{c}_as_error": F.col(c) for c in errors}
    out = df.withColumns(cols)
    v = F.array_compact(F.array(*map(F.col, cols)))
    return out.withColumn("mean_error", F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


def majority_vote(df: DataFrame, cols: list[str], tie: str = "mean") -> DataFrame:
    """The side that most errors point to, 1 or -1; a tie goes by the mean's sign, or is 0."""
    v = F.array_compact(F.array(*[F.signum(c) for c in cols]))
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    vals = F.array_compact(F.array(*map(F.col, cols)))
    mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("vote", F.when(s != 0, F.signum(s)).otherwise(F.signum(mean) if tie == "mean" else F.lit(0.0)).cast("int"))


def vote_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Votes over and under, their shares, the spread of the values and the entropy of the votes."""
    up, down = (reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conds]) for conds in ([F.col(c) > 0 for c in cols], [F.col(c) < 0 for c in cols]))
    out = df.withColumns({"n_over": up, "n_under": down})
    n = F.col("n_over") + F.col("n_under")
    v = F.array_compact(F.array(*map(F.col, cols)))
    return out.withColumns({"over_share": F.try_divide("n_over", n), "vote_spread": F.array_max(v) - F.array_min(v), "vote_entropy": entropy(F.col("n_over"), F.col("n_under"))})


def consensus_structure(df: DataFrame, cols: list[str], tight: float = 2.0) -> DataFrame:
    """Mean and largest pairwise difference, row statistics, whether all lie close together, and whether all point one way."""
    pairs = F.array_compact(F.array(*[F.abs(F.col(a) - F.col(b)) for a, b in combinations(cols, 2)]))
    signs = F.array_distinct(F.array_compact(F.array(*[F.signum(c) for c in cols])))
    out = with_row_stats(df, cols, "consensus")
    return out.withColumns({"pair_diff_mean": F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(pairs)), "pair_diff_max": F.array_max(pairs), "is_tight": F.coalesce(F.col("consensus_range") <= tight, F.lit(False)), "is_unanimous": F.size(signs) == 1})


def build_meta_frame(base: DataFrame, preds: dict[str, DataFrame], keys: list[str], season: str, seasons: int) -> DataFrame:
    """Rows of the latest seasons that every model has scored, with a column per model."""
    top = base.agg(F.max(season).alias("__top"))
    out = base.crossJoin(F.broadcast(top)).where(F.col(season) > F.col("__top") - seasons).drop("__top")  # one row
    for name, p in preds.items():
        out = out.join(p.select(*keys, F.col("prediction").alias(f"pred_{name}")), keys)
    return out


def game_predictions(preds: DataFrame, game: str = "game_id", model: str = "model", at: str = "predicted_at") -> DataFrame:
    """The latest prediction per game and model."""
    return latest_per_key(preds, [game, model], [at])


def model_daily_metrics(preds: DataFrame, date: str, model: str, pred: str, actual: str, line: str) -> DataFrame:
    """Per model and date: rows, MAE, bias and accuracy against the line."""
    e, m = F.col(pred) - F.col(line), F.col(actual) - F.col(line)
    right = F.when((m != 0) & (e != 0), (F.signum(e) == F.signum(m)).cast("double"))
    return preds.groupBy(model, F.to_date(date).alias("date")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae"), F.avg(F.col(pred) - F.col(actual)).alias("bias"), F.avg(right).alias("accuracy"))


def confusion(df: DataFrame, pred: str, actual: str, line: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Predicted side against what came."""
    side = lambda c: F.when(F.col(c) > F.col(line), "over").when(F.col(c) < F.col(line), "under").when(F.col(c) == F.col(line), "push")
    return df.groupBy(*by, side(pred).alias("predicted"), side(actual).alias("came")).agg(F.count("*").alias("n"))


def timing_metrics(df: DataFrame, minutes: str, pred: str, actual: str, bucket: Column) -> DataFrame:
    """Error by how long before the game a prediction was made."""
    e = F.col(pred) - F.col(actual)
    return df.groupBy(bucket.alias("timing")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(minutes).alias("mean_minutes"))


def pre_midnight(preds: DataFrame, at: str, date: str, tz: str) -> DataFrame:
    """Predictions made before the game's day began in the zone."""
    return preds.where(F.to_date(F.from_utc_timestamp(at, tz)) < F.to_date(date))


def backfill_outcomes(preds: DataFrame, games: DataFrame, key: str, actual: str) -> DataFrame:
    """Outcomes for predictions that lack them."""
    return preds.join(games.select(key, F.col(actual).alias("__a")), key, "left").withColumn(actual, F.coalesce(actual, "__a")).drop("__a")


def to_decisions(df: DataFrame, kind: str, value: str, price_over: str, price_under: str) -> DataFrame:
    """Edge, score, side and price. kind "error": the predicted error is the edge, its size the score; "probability": the
    edge is p - 0.5, the score the better side's expected value."""
    o, u = to_decimal(F.col(price_over)), to_decimal(F.col(price_under))
    if kind == "error":
        edge, score, over = F.col(value), F.abs(value), F.col(value) > 0
    else:
        p = F.col(value)
        eo, eu = p * o - 1, (1 - p) * u - 1
        edge, score, over = p - 0.5, F.greatest(eo, eu), eo >= eu
    return df.withColumns({"edge": edge, "score": score, "side": F.when(over, "over").when(~over, "under"), "price": F.when(over, o).when(~over, u)})


def prepare_frame(df: DataFrame, season: str, floor: int, id_col: str, types: dict[str, str], allowed: list[str], actual: str, line: str, features: list[str]) -> DataFrame:
    """Season floor, allowed types, rows with outcome and line, label without pushes, and the matrix's columns."""
    from pastframe.operators.filters import add_over_label, filter_by_prefix, season_floor

    d = filter_by_prefix(season_floor(df, season, floor), id_col, types, allowed).dropna(subset=[actual, line])
    labelled, _ = add_over_label(d, actual, line)
    return labelled.select(id_col, season, *features, line, actual, "is_over", (F.col(actual) - F.col(line)).alias("line_error"))


def holdout_summary(preds: DataFrame, pred: str, actual: str, line: str, by: tuple[str, ...] = ("seed",), min_edge: float = 0.0) -> DataFrame:
    """Per seed: errors of prediction and line, and bet metrics."""
    p = preds.withColumn("edge", F.col(pred) - F.col(line))
    e = p.groupBy(*by).agg(*error_metrics(F.col(actual), F.col(pred)), F.avg(F.abs(F.col(actual) - F.col(line))).alias("line_mae"))
    return e.join(score_bets(p, "edge", actual, line, by, min_edge=min_edge), list(by), "left")


def average_rank(keys: list[str], value: str) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def _ranks_of_counts(counts: DataFrame, value: str, out: str) -> DataFrame:
    """(__by, value, out, __n) of counts (__by, value, __c): a value's rank among its group's rows with ties at their mean, and the group's rows."""
    levels = counts.groupBy("__by", value).agg(F.sum("__c").alias("__c"))
    upto = running_total(levels, [F.col("__by"), F.col(value)], "__before", F.col("__c"), "ranks")
    whole = upto.groupBy(F.col("__by").alias("__g")).agg(F.min("__before").alias("__base"), F.sum("__c").alias("__n"))
    return upto.join(whole, F.col("__by").eqNullSafe(F.col("__g"))).select("__by", value, (F.col("__before") - F.col("__base") + (F.col("__c") + 1) / 2).alias(out), "__n")


def confidence_trend(df: DataFrame, score: str, won: str, by: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Win rate by bucket of the confidence's rank within its run, and per run the Spearman correlation with winning and its p-value
    (two-sided, normal approximation of t).

    Rows of one run, score and outcome are counted; ranks come from running totals of the counts over range partitions, so
    no task orders the rows of a run.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(won).isNotNull())
    r = rows.groupBy(F.col(by).alias("__by"), F.col(score).alias("__s"), F.col(won).cast("double").alias("__w")).agg(F.count("*").alias("__c"))
    s, w = _ranks_of_counts(r, "__s", "__r"), _ranks_of_counts(r, "__w", "__rw")
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])
    r = r.join(s, same(r, s, ["__by", "__s"])).select(r["__by"], r["__s"], r["__w"], r["__c"], "__r", "__n")
    bucket = F.least(F.floor((F.col("__r") / F.col("__n")) * n), F.lit(n - 1)).cast("int")
    mean = lambda c: (F.sum(F.col(c) * F.col("__c")) / F.sum("__c"))
    table = r.groupBy(F.col("__by").alias(by), bucket.alias("bucket")).agg(F.sum("__c").alias("n"), mean("__w").alias("win_rate"), mean("__s").alias("mean_score"))
    r = r.join(w, same(r, w, ["__by", "__w"])).select(r["__by"], r["__c"], (F.col("__r") - (r["__n"] + 1) / 2).alias("__x"), (F.col("__rw") - (r["__n"] + 1) / 2).alias("__y"))  # less the mean rank
    over = lambda a, b: F.sum(F.col("__c") * F.col(a) * F.col(b))
    t = r.groupBy(F.col("__by").alias(by)).agg(F.try_divide(over("__x", "__y"), F.sqrt(over("__x", "__x") * over("__y", "__y"))).alias("rho"), F.sum("__c").alias("n"))
    return table, t.withColumn("z", F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))).withColumn("p_value", _two_sided(F.col("z"))).drop("z")


def _two_sided(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a rational approximation of erfc (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)


def equity_curve(bets: DataFrame, run: str, date: str, key: str, profit: str = "profit") -> DataFrame:
    """Cumulative profit per run in order of date and key."""
    w = Window.partitionBy(run).orderBy(date, key).rowsBetween(Window.unboundedPreceding, 0)
    return bets.withColumn("equity", F.sum(profit).over(w)).withColumn("drawdown", F.max("equity").over(w) - F.col("equity"))


def walk_audit(daily: DataFrame, run: str, date: str, train_end: str) -> DataFrame:
    """Per run the days on which training reached the scored day; there should be none."""
    return daily.groupBy(run).agg(F.count("*").alias("days"), F.count_if(F.col(train_end) >= F.col(date)).alias("leaking_days"))


def daily_pivot(df: DataFrame, date: str, model: str, models: list[str], metric: str, smooth: int = 1) -> DataFrame:
    """A metric per date and model, a column per model, as the mean of the last `smooth` dates with the current one."""
    g = df.groupBy(F.to_date(date).alias("date")).pivot(model, models).agg(F.avg(metric))
    w = Window.orderBy("date").rowsBetween(-(smooth - 1), 0)
    return g.select("date", *[F.avg(m).over(w).alias(m) for m in models])  # one row per date


def combine_picks(df: DataFrame, diffs: list[str], family: tuple[str, ...] = (), pair: tuple[str, str] | None = None, actual_diff: str | None = None) -> DataFrame:
    """Rules over the models' differences from the line: mean of all, mean without a family, a pair where it agrees (else the mean),
    and the contrary of the mean; each with its pick, and whether it was right."""
    mean = lambda cs: (lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))(F.array_compact(F.array(*map(F.col, cs))))
    rules = {"mean_all": mean(diffs), "mean_without": mean([d for d in diffs if d not in family] or diffs)}
    if pair:
        a, b = map(F.col, pair)
        rules["pair"] = F.when(F.signum(a) == F.signum(b), (a + b) / 2).otherwise(rules["mean_all"])
    rules["contrarian"] = -rules["mean_all"]
    out = df.withColumns(rules)
    out = out.withColumns({f"{r}_pick": F.when(F.col(r) > 0, "over").when(F.col(r) < 0, "under") for r in rules})
    if actual_diff:
        out = out.withColumns({f"{r}_right": F.when((F.col(actual_diff) != 0) & (F.col(r) != 0), (F.signum(r) == F.signum(actual_diff)).cast("int")) for r in rules})
    return out


def rolling_residual(df: DataFrame, residual: str, keys: list[str], order: list[str], n: int = 25, least: int = 8) -> DataFrame:
    """Mean residual of the last n rows with the current one; null below `least`."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("rolling_residual", F.when(F.count(residual).over(w) >= least, F.avg(residual).over(w)))


def fold_comparison(model: DataFrame, base: DataFrame, fold: str = "fold", metric: str = "mae") -> DataFrame:
    """A model's metric less the baseline's, fold by fold, and whether it is better."""
    j = model.select(fold, F.col(metric).alias("model")).join(base.select(fold, F.col(metric).alias("baseline")), fold)
    return j.withColumn("delta", F.col("model") - F.col("baseline")).withColumn("better", F.col("delta") < 0)
