"""Queries over splits and scoring (E), audits (Q), experiment tables (M), players and officials (P, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastframe.operators import audits, experiments, players, scoring, splits
from pastframe.queries.tables import ITEMS, ORDERS, entry, items, orders, tasks
from pastframe.sources.stored import shared_folder, stored

def _bets(s, d):
    """Line items as bets: the edge is the quantity less 25.5, the outcome the tax against the discount."""
    return items(s, d).select("g", "n", "p", "flag", "ls", "d", (F.col("q") - 25.5).alias("edge"), F.col("tax").alias("actual"), F.col("disc").alias("line"), (F.col("q") / 51).alias("prob"), (F.col("tax") > F.col("disc")).cast("int").alias("y"))


#: Bets of ITEMS in SQL, settled at the default price.
_PLACED = f"""{ITEMS}, b AS (SELECT *, q - 25.5 AS edge, (tax - disc) * sign(q - 25.5) AS m FROM i), c AS (SELECT *, CASE WHEN m > 0 THEN 100.0 / 110 WHEN m < 0 THEN -1.0 ELSE 0.0 END AS profit FROM b)"""
_METRICS = """count(*) AS n_bets, count(*) FILTER (m > 0) AS wins, count(*) FILTER (m < 0) AS losses, count(*) FILTER (m = 0) AS pushes, {r:count(*) FILTER (m > 0) / nullif(count(*) FILTER (m <> 0), 0)::DOUBLE} AS win_rate, {r:sum(profit)} AS profit, {r:sum(profit) / count(*)} AS roi"""
_M = ["n_bets", "wins", "losses", "pushes", "win_rate", "profit", "roi"]


def _m6_runs(s, d):
    """Each of the five order priorities as a run that has written its metrics."""
    root, runs = shared_folder(s, "runs"), orders(s, d).groupBy("prio").agg(F.avg("v").alias("roi"), F.count("*").alias("bets"))
    runs = stored(runs, "run-metrics")
    for run in "12345":
        runs.where(F.col("prio").startswith(run)).drop("prio").coalesce(1).write.json(f"{root}/run-{run}/metrics.json")
    return experiments.run_summaries(s, root, "roi double, bets long").where("bets is not null")


QUERIES = {
    "e1_holdout_latest_dates": entry(
        lambda s, d: splits.holdout_latest_dates(orders(s, d), "d", n=500)[1].select("id", "d"),
        f"WITH {ORDERS}, y AS (SELECT d, count(*) AS c FROM o GROUP BY d), w AS (SELECT d, coalesce(sum(c) OVER (ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM y) SELECT id, o.d FROM o JOIN w ON w.d = o.d WHERE later < 500",
    ),
    "e4_recency_weights": entry(
        lambda s, d: splits.recency_weights(orders(s, d), "d", 0.001, "status").select("id", "weight"),
        f"WITH {ORDERS} SELECT id, {{r:exp(-0.001 * (max(d) OVER (PARTITION BY status) - d))}} AS weight FROM o",
    ),
    "e6_line_baseline": entry(
        lambda s, d: scoring.line_baseline(items(s, d).withColumn("line", F.lit(25.0)), "q", "line", ("flag",)),
        f"WITH {ITEMS} SELECT flag, count(*) AS n, {{r:avg(abs(q - 25))}} AS mae, {{r:sqrt(avg((q - 25) * (q - 25)))}} AS rmse, {{r:avg(q - 25)}} AS bias, {{r:1 - sum((q - 25) * (q - 25)) / (count(*) * var_pop(q))}} AS r2 FROM i GROUP BY flag",
    ),
    "e6_bias_baseline": entry(
        lambda s, d: scoring.bias_baseline(items(s, d).where("ls = 'F'").withColumn("line", F.lit(20.0)), items(s, d).where("ls = 'O'").withColumn("line", F.lit(20.0)), "q", "line").select("n", "mae", "bias"),
        f"WITH {ITEMS}, z AS (SELECT avg(q - 20) AS b FROM i WHERE ls = 'F') SELECT count(*) AS n, {{r:avg(abs(q - 20 - b))}} AS mae, {{r:avg(q - 20 - b)}} AS bias FROM i, z WHERE ls = 'O'",
    ),
    "e7_historical_mean_baseline": entry(
        lambda s, d: splits.historical_mean_baseline(orders(s, d), "v", "season").select("id", "historical_mean"),
        f"WITH {ORDERS}, p AS (SELECT season + 1 AS season, avg(v) AS m FROM o GROUP BY season) SELECT id, {{r:m}} AS historical_mean FROM o LEFT JOIN p ON p.season = o.season",
    ),
    "e8_score_bets": entry(
        lambda s, d: scoring.score_bets(_bets(s, d), "edge", "actual", "line", ("flag",)).select("flag", *_M, "win_rate_low", "win_rate_high", "break_even", "significant"),
        f"""WITH {_PLACED}, a AS (SELECT flag, {_METRICS}, count(*) FILTER (m > 0) AS w, count(*) FILTER (m <> 0) AS t FROM c GROUP BY flag),
        l AS (SELECT *, w / t::DOUBLE AS p, 1.959963984540054 AS z FROM a), x AS (SELECT *, (p + z * z / (2 * t)) / (1 + z * z / t) AS mid, z * sqrt(p * (1 - p) / t + z * z / (4.0 * t * t)) / (1 + z * z / t) AS half FROM l)
        SELECT flag, n_bets, wins, losses, pushes, win_rate, profit, roi, {{r:mid - half}} AS win_rate_low, {{r:mid + half}} AS win_rate_high, {{r:110 / 210.0}} AS break_even, mid - half > 110 / 210.0 AS significant FROM x""",
    ),
    "e9_threshold_sweep": entry(
        lambda s, d: scoring.threshold_sweep(_bets(s, d), [0.0, 5.0, 10.0, 20.0], "edge", "actual", "line").select("threshold", *_M),
        f"WITH {_PLACED} SELECT {{r:threshold}} AS threshold, {_METRICS} FROM c JOIN (SELECT unnest([0, 5, 10, 20]) AS threshold) ON abs(edge) > threshold GROUP BY threshold",
    ),
    "e9_edge_ranges": entry(
        lambda s, d: scoring.edge_ranges(_bets(s, d), [0.0, 5.0, 15.0], "edge", "actual", "line"),
        f"""WITH {_PLACED}, k AS (SELECT CASE WHEN abs(edge) >= 15 THEN 15.0 WHEN abs(edge) >= 5 THEN 5.0 ELSE 0.0 END AS from_edge, count(*) AS n_bets, count(*) FILTER (m > 0) AS wins, count(*) FILTER (m < 0) AS losses, sum(profit) AS profit FROM c GROUP BY 1)
        SELECT {{r:from_edge}} AS from_edge, n_bets, wins, losses, {{r:profit}} AS profit, CAST(sum(n_bets) OVER w AS BIGINT) AS n_bets_tail, CAST(sum(wins) OVER w AS BIGINT) AS wins_tail, CAST(sum(losses) OVER w AS BIGINT) AS losses_tail, {{r:sum(profit) OVER w}} AS profit_tail FROM k WINDOW w AS (ORDER BY from_edge DESC)""",
    ),
    "e10_score_lines": entry(
        lambda s, d: scoring.score_lines(_bets(s, d).withColumn("alt", F.col("line") + 0.01), "prob", "actual", ["line", "alt"]).select("line_name", "n_bets", "wins", "losses", "line_mae"),
        f"""WITH {ITEMS}, l AS (SELECT q / 51 AS p, tax AS y, 'line' AS line_name, disc AS line FROM i UNION ALL SELECT q / 51, tax, 'alt', disc + 0.01 FROM i), e AS (SELECT line_name, avg(abs(y - line)) AS e FROM l GROUP BY 1)
        SELECT l.line_name, count(*) FILTER (p <> line) AS n_bets, count(*) FILTER ((y - line) * sign(p - line) > 0) AS wins, count(*) FILTER ((y - line) * sign(p - line) < 0) AS losses, {{r:max(e.e)}} AS line_mae FROM l JOIN e ON e.line_name = l.line_name GROUP BY l.line_name""",
    ),
    "e11_score_by_snapshot": entry(
        lambda s, d: scoring.score_by_snapshot(_bets(s, d), "edge", "actual", "line", "n", "g").select("n", *_M, "n_games", "pooled"),
        f"WITH {_PLACED} SELECT n, {_METRICS}, count(DISTINCT g) AS n_games, grouping(n) = 1 AS pooled FROM c GROUP BY GROUPING SETS ((n), ())",
    ),
    "e12_verify_alignment": entry(
        lambda s, d: scoring.verify_alignment(orders(s, d).where("id % 7 <> 0"), orders(s, d).where("id % 5 <> 0").withColumn("v", F.when(F.col("id") % 11 == 0, F.col("v") + 1).otherwise(F.col("v"))), ["id"], "v"),
        f"WITH {ORDERS} SELECT count(*) FILTER (id % 7 <> 0 AND id % 5 = 0) AS only_predictions, count(*) FILTER (id % 7 = 0 AND id % 5 <> 0) AS only_source, count(*) FILTER (id % 7 <> 0 AND id % 5 <> 0 AND id % 11 = 0) AS different FROM o",
    ),
    "e13_calibration_table": entry(
        lambda s, d: scoring.calibration_table(_bets(s, d), "prob", "y"),
        f"""WITH {ITEMS}, b AS (SELECT q / 51 AS p, (tax > disc)::INT AS y FROM i), g AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bucket, count(*) AS n, avg(p) AS mp, avg(y) AS ob FROM b GROUP BY 1)
        SELECT bucket, n, {{r:mp}} AS mean_p, {{r:ob}} AS observed, {{r:abs(mp - ob)}} AS gap FROM g""",
    ),
    "e13_calibration_summary": entry(
        lambda s, d: scoring.calibration_summary(_bets(s, d), "prob", "y"),
        f"""WITH {ITEMS}, b AS (SELECT q / 51 AS p, (tax > disc)::INT AS y FROM i), g AS (SELECT least(floor(p * 10), 9) AS k, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY 1)
        SELECT count(*) AS n, {{r:avg((p - y) * (p - y))}} AS brier, {{r:avg(-(y * ln(p) + (1 - y) * ln(1 - p)))}} AS log_loss, {{r:avg(y)}} AS base_rate, {{r:(SELECT sum(n * gap) / sum(n) FROM g)}} AS ece FROM b""",
    ),
    "e14_ou_accuracy": entry(
        lambda s, d: scoring.ou_accuracy(_bets(s, d).withColumn("pred", F.col("line") + F.col("edge")), "pred", "actual", "line", [0.0, 10.0]).select("min_edge", "accuracy", "decided", "rows"),
        f"""WITH {_PLACED} SELECT {{r:e}} AS min_edge, {{r:avg(CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN 0.0 END)}} AS accuracy, count(*) FILTER (m <> 0) AS decided, count(*) AS rows FROM c JOIN (SELECT unnest([0, 10]) AS e) ON abs(edge) >= e GROUP BY e""",
    ),
    "e15_settlement_stats": entry(
        lambda s, d: scoring.settlement_stats(scoring.settle(_bets(s, d).withColumn("pick", F.when(F.col("edge") > 0, "over").otherwise("under")), {"m": "pick"}, "actual", "line"), "m", "pick", ("flag",)),
        f"WITH {_PLACED} SELECT flag, CASE WHEN edge > 0 THEN 'over' ELSE 'under' END AS side, count(*) AS n, count(*) FILTER (m > 0) AS wins, {{r:avg(CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN 0.0 END)}} AS win_rate, {{r:sum(profit)}} AS profit, {{r:avg(profit)}} AS roi FROM c GROUP BY ALL",
    ),
    "e16_cv_scores": entry(
        lambda s, d: scoring.cv_scores(_bets(s, d), "edge", "actual", "line", "flag").select("flag", *_M),
        f"WITH {_PLACED} SELECT flag, {_METRICS} FROM c GROUP BY GROUPING SETS ((flag), ())",
    ),
    "e17_majority_vote": entry(
        lambda s, d: scoring.majority_vote(_three(s, d), ["a", "b", "c"]).select("g", "n", "p", "a", "vote"),
        f"""WITH {ITEMS}, v AS (SELECT g, n, p, q - 25 AS a, (disc - 0.05) * 100 AS b, (tax - 0.04) * 100 AS c FROM i)
        SELECT g, n, p, {{r:a}} AS a, CAST(CASE WHEN sign(a) + sign(b) + sign(c) <> 0 THEN sign(sign(a) + sign(b) + sign(c)) ELSE sign(0.0 + a + b + c) END AS INTEGER) AS vote FROM v""",
    ),
    "e17_error_space": entry(
        lambda s, d: scoring.error_space(_three(s, d).withColumn("line", F.lit(1.0)), ["a"], ["b", "c"], "line").select("g", "n", "p", "a_as_error", "mean_error"),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q - 26}} AS a_as_error, {{r:(q - 26 + (disc - 0.05) * 100 + (tax - 0.04) * 100) / 3}} AS mean_error FROM i",
    ),
    "e18_vote_features": entry(
        lambda s, d: scoring.vote_features(_three(s, d), ["a", "b", "c"]).select("g", "n", "p", "a", "n_over", "n_under", "over_share", "vote_spread", "vote_entropy"),
        f"""WITH {ITEMS}, v AS (SELECT g, n, p, q - 25 AS a, (disc - 0.05) * 100 AS b, (tax - 0.04) * 100 AS c FROM i), w AS (SELECT *, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS u, (a < 0)::INT + (b < 0)::INT + (c < 0)::INT AS w FROM v)
        SELECT g, n, p, {{r:a}} AS a, u AS n_over, w AS n_under, {{r:u / nullif(u + w, 0)::DOUBLE}} AS over_share, {{r:greatest(a, b, c) - least(a, b, c)}} AS vote_spread,
        {{r:CASE WHEN u + w = 0 OR u = 0 OR w = 0 THEN 0 ELSE -(u / (u + w)::DOUBLE) * log2(u / (u + w)::DOUBLE) - (w / (u + w)::DOUBLE) * log2(w / (u + w)::DOUBLE) END}} AS vote_entropy FROM w""",
    ),
    "e18_consensus_structure": entry(
        lambda s, d: scoring.consensus_structure(_three(s, d), ["a", "b", "c"]).select("g", "n", "p", "a", "pair_diff_mean", "pair_diff_max", "consensus_range", "is_unanimous"),
        f"""WITH {ITEMS}, v AS (SELECT g, n, p, q - 25 AS a, (disc - 0.05) * 100 AS b, (tax - 0.04) * 100 AS c FROM i)
        SELECT g, n, p, {{r:a}} AS a, {{r:(abs(a - b) + abs(a - c) + abs(b - c)) / 3}} AS pair_diff_mean, {{r:greatest(abs(a - b), abs(a - c), abs(b - c))}} AS pair_diff_max, {{r:greatest(a, b, c) - least(a, b, c)}} AS consensus_range, sign(a) = sign(b) AND sign(b) = sign(c) AS is_unanimous FROM v""",
    ),
    "e20_confusion": entry(
        lambda s, d: scoring.confusion(_bets(s, d).withColumn("pred", F.col("line") + F.col("edge")), "pred", "actual", "line"),
        f"WITH {ITEMS} SELECT CASE WHEN q > 25.5 THEN 'over' ELSE 'under' END AS predicted, CASE WHEN tax > disc THEN 'over' WHEN tax < disc THEN 'under' ELSE 'push' END AS came, count(*) AS n FROM i GROUP BY ALL",
    ),
    "e20_game_predictions": entry(
        lambda s, d: scoring.game_predictions(orders(s, d).select(F.col("k").alias("game_id"), F.col("prio").alias("model"), F.struct("d", "id").alias("predicted_at"), "id")).select("game_id", "model", "id"),
        f"WITH {ORDERS} SELECT k AS game_id, prio AS model, arg_max(id, (d, id)) AS id FROM o GROUP BY ALL",
    ),
    "e20_model_daily_metrics": entry(
        lambda s, d: scoring.model_daily_metrics(_bets(s, d).withColumn("pred", F.col("line") + F.col("edge")), "d", "flag", "pred", "actual", "line"),
        f"WITH {_PLACED} SELECT flag, d AS date, count(*) AS n, {{r:avg(abs(disc + edge - tax))}} AS mae, {{r:avg(disc + edge - tax)}} AS bias, {{r:avg(CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN 0.0 END)}} AS accuracy FROM c GROUP BY ALL",
    ),
    "e21_backfill_outcomes": entry(
        lambda s, d: scoring.backfill_outcomes(orders(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("v")).alias("v")), orders(s, d).select("id", "v"), "id", "v"),
        f"WITH {ORDERS} SELECT id, {{r:v}} AS v FROM o",
    ),
    "e22_to_decisions": entry(
        lambda s, d: scoring.to_decisions(_bets(s, d).withColumns({"po": 1.8 + F.col("line"), "pu": 1.9 + F.col("actual")}), "probability", "prob", "po", "pu").select("g", "n", "p", "edge", "score", "side", "price"),
        f"""WITH {ITEMS}, x AS (SELECT g, n, p, q / 51 AS r, 1.8 + disc AS o, 1.9 + tax AS u FROM i)
        SELECT g, n, p, {{r:r - 0.5}} AS edge, {{r:greatest(r * o - 1, (1 - r) * u - 1)}} AS score, CASE WHEN r * o - 1 >= (1 - r) * u - 1 THEN 'over' ELSE 'under' END AS side, {{r:CASE WHEN r * o - 1 >= (1 - r) * u - 1 THEN o ELSE u END}} AS price FROM x""",
    ),
    "e26_confidence_trend": entry(
        lambda s, d: scoring.confidence_trend(_bets(s, d), "prob", "y", "flag")[0],
        f"""WITH {ITEMS}, b AS (SELECT flag, q / 51 AS p, (tax > disc)::INT AS y FROM i), r AS (SELECT *, rank() OVER (PARTITION BY flag ORDER BY p) + (count(*) OVER (PARTITION BY flag, p) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY flag) AS n FROM b)
        SELECT flag, CAST(least(floor(r / n * 5), 4) AS INTEGER) AS bucket, count(*) AS n, {{r:avg(y)}} AS win_rate, {{r:avg(p)}} AS mean_score FROM r GROUP BY ALL""",
    ),
    "e27_equity_curve": entry(
        lambda s, d: scoring.equity_curve(orders(s, d).withColumn("profit", F.col("v") - 150000), "k", "d", "id").select("id", "equity", "drawdown"),
        f"""WITH {ORDERS}, e AS (SELECT id, k, d, sum(v - 150000) OVER (PARTITION BY k ORDER BY d, id) AS e FROM o) SELECT id, {{r:e}} AS equity, {{r:max(e) OVER (PARTITION BY k ORDER BY d, id) - e}} AS drawdown FROM e""",
    ),
    "e28_daily_pivot": entry(
        lambda s, d: scoring.daily_pivot(items(s, d), "d", "flag", ["A", "N", "R"], "q", 3),
        f"""WITH {ITEMS}, g AS (SELECT d, avg(CASE WHEN flag = 'A' THEN q END) AS a, avg(CASE WHEN flag = 'N' THEN q END) AS n, avg(CASE WHEN flag = 'R' THEN q END) AS r FROM i GROUP BY d)
        SELECT d AS date, {{r:avg(a) OVER w}} AS A, {{r:avg(n) OVER w}} AS N, {{r:avg(r) OVER w}} AS R FROM g WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    ),
    "e29_combine_picks": entry(
        lambda s, d: scoring.combine_picks(_three(s, d), ["a", "b", "c"], ("c",), ("a", "b")).select("g", "n", "p", "a", "mean_all", "mean_without", "pair", "pair_pick"),
        f"""WITH {ITEMS}, v AS (SELECT g, n, p, q - 25 AS a, (disc - 0.05) * 100 AS b, (tax - 0.04) * 100 AS c FROM i), x AS (SELECT *, CASE WHEN sign(a) = sign(b) THEN (a + b) / 2 ELSE (a + b + c) / 3 END AS pr FROM v)
        SELECT g, n, p, {{r:a}} AS a, {{r:(a + b + c) / 3}} AS mean_all, {{r:(a + b) / 2}} AS mean_without, {{r:pr}} AS pair, CASE WHEN pr > 0 THEN 'over' WHEN pr < 0 THEN 'under' END AS pair_pick FROM x""",
    ),
    "e30_rolling_residual": entry(
        lambda s, d: scoring.rolling_residual(orders(s, d), "v", ["k"], ["d", "id"]).select("id", "rolling_residual"),
        f"WITH {ORDERS} SELECT id, {{r:CASE WHEN count(v) OVER w >= 8 THEN avg(v) OVER w END}} AS rolling_residual FROM o WINDOW w AS (PARTITION BY k ORDER BY d, id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)",
    ),
    "q2_audit_reconstruction": entry(
        lambda s, d: audits.audit_reconstruction(items(s, d).withColumns({"t": F.col("q") * 2, "a": F.col("q") * 1.5, "b": F.col("q") * 0.5}), "t", ["q", "a", "b", "tax"]),
        f"WITH {ITEMS} SELECT f.feature, f.partner, {{r:CASE WHEN f.partner IS NULL THEN 1.0 END}} AS corr, (SELECT count(*) FROM i) AS n FROM (VALUES ('q', NULL), ('a', NULL), ('b', NULL), ('a', 'b')) f(feature, partner)",
    ),
    "q5_frame_differences": entry(
        lambda s, d: audits.frame_differences(orders(s, d).where("id % 9 <> 0").select("id", "v", "k"), orders(s, d).select("id", F.when(F.col("id") % 13 == 0, F.col("v") * 2).otherwise(F.col("v")).alias("v"), "k"), ["id"]).select("id", F.array_join("differs", ",").alias("why")),
        f"WITH {ORDERS} SELECT id, CASE WHEN id % 9 = 0 THEN 'only right' ELSE 'v' END AS why FROM o WHERE id % 9 = 0 OR id % 13 = 0",
    ),
    "m2_flag_cohorts": entry(
        lambda s, d: experiments.flag_cohorts(orders(s, d), ["season", "prio"]).groupBy("in_cohort").agg(F.count("*").alias("n")),
        f"WITH {ORDERS}, w AS (SELECT season, prio FROM o GROUP BY season, prio ORDER BY count(*) DESC, season, prio LIMIT 1) SELECT (season, prio) IN (SELECT (season, prio) FROM w) AS in_cohort, count(*) AS n FROM o GROUP BY 1",
    ),
    "m3_contrasts": entry(
        lambda s, d: experiments.contrasts(orders(s, d).withColumnRenamed("id", "run_id"), "prio", ["k", "season"], ["v"], "d").select("run_id", "v_delta"),
        f"""WITH {ORDERS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, season, prio ORDER BY d, id) AS r FROM o) WHERE r = 1), c AS (SELECT *, count(*) OVER (PARTITION BY k, season) AS c FROM f)
        SELECT id AS run_id, {{r:v - first_value(v) OVER (PARTITION BY k, season ORDER BY prio)}} AS v_delta FROM c WHERE c >= 2""",
    ),
    "m3_replicates": entry(
        lambda s, d: experiments.replicates(orders(s, d), ["k", "season"], ["v"]),
        f"WITH {ORDERS} SELECT k, season, count(*) AS runs, {{r:max(v) - min(v)}} AS v_range FROM o GROUP BY k, season HAVING count(*) >= 2",
    ),
    "m5_win_rate_by": entry(
        lambda s, d: experiments.win_rate_by(scoring.placed(_bets(s, d), "edge", "actual", "line"), ["flag", "ls"]),
        f"WITH {_PLACED} SELECT flag, ls, {{r:avg(CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN 0.0 END)}} AS win_rate, count(*) FILTER (m <> 0) AS decided FROM c GROUP BY GROUPING SETS ((flag, ls), ())",
    ),
    "m6_run_summaries": entry(
        _m6_runs,
        f"WITH {ORDERS} SELECT 'run-' || substr(prio, 1, 1) AS run_id, {{r:avg(v)}} AS roi, count(*) AS bets FROM o GROUP BY prio",
    ),
    "m6_seed_spread": entry(
        lambda s, d: experiments.seed_spread(orders(s, d).withColumnRenamed("k", "seed"), ["prio"], ["v"]),
        f"WITH {ORDERS} SELECT prio, count(DISTINCT k) AS seeds, {{r:max(v) - min(v)}} AS v_spread, {{r:stddev_samp(v)}} AS v_std FROM o GROUP BY prio",
    ),
    "m7_importance_stability": entry(
        lambda s, d: experiments.importance_stability(_importance(s, d), 20, "flag", "s", "p", "x", parts=tasks(s, d)).select("flag", "p", "median_share", "median_rank_fraction", "top_quarter_rate", "top_k_rate", "models"),
        f"""WITH {ITEMS}, m AS (SELECT flag, s, p, sum(q) AS x FROM i GROUP BY ALL), r AS (SELECT flag, p, x / sum(x) OVER (PARTITION BY flag, s) AS sh, rank() OVER (PARTITION BY flag, s ORDER BY -x) + (count(*) OVER (PARTITION BY flag, s, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY flag, s) AS n FROM m)
        SELECT flag, p, {{r:median(sh)}} AS median_share, {{r:median(r / n)}} AS median_rank_fraction, {{r:avg((r / n <= 0.25)::INT)}} AS top_quarter_rate, {{r:avg((r <= 20)::INT)}} AS top_k_rate, count(*) AS models FROM r GROUP BY flag, p""",
    ),
    "m7_topk_overlap": entry(
        lambda s, d: experiments.topk_overlap(items(s, d).groupBy("s", "p").agg(F.sum("q").alias("x")), 50, "s", "p", "x"),
        f"""WITH {ITEMS}, m AS (SELECT s, p, sum(q) AS x FROM i GROUP BY s, p), t AS (SELECT s, list(p) AS f FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY x DESC, p) AS r FROM m) WHERE r <= 50 GROUP BY s)
        SELECT a.s AS model_a, b.s AS model_b, {{r:len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f)))::DOUBLE}} AS jaccard FROM t a JOIN t b ON a.s < b.s""",
    ),
    "m8_fold_table": entry(
        lambda s, d: experiments.fold_table(orders(s, d).withColumn("v", F.col("v") - 150000), "k", "v"),
        f"WITH {ORDERS} SELECT k, count(*) AS folds, {{r:avg(v - 150000)}} AS mean, {{r:stddev_samp(v - 150000)}} AS std, {{r:min(v - 150000)}} AS worst, {{r:avg((v > 150000)::INT)}} AS positive_share FROM o GROUP BY k",
    ),
    "m8_pivot_runs": entry(
        lambda s, d: experiments.pivot_runs(items(s, d), "s", "flag", ["A", "N", "R"], "q"),
        f"WITH {ITEMS} SELECT s, {{r:avg(CASE WHEN flag = 'A' THEN q END)}} AS A, {{r:avg(CASE WHEN flag = 'N' THEN q END)}} AS N, {{r:avg(CASE WHEN flag = 'R' THEN q END)}} AS R FROM i GROUP BY s",
    ),
    "r1_official_effects": entry(
        lambda s, d: players.official_effects(_officiated(s, d), ["r1", "r2"], ["v"]),
        f"""WITH {ORDERS}, g AS (SELECT id, season, d, v, k % 20 AS r1, (k + 7) % 20 AS r2 FROM o), l AS (SELECT id, season, d, v, unnest(list_distinct([r1, r2])) AS r FROM g),
        a AS (SELECT l.id, l.r, (SELECT count(*) FROM l x WHERE x.r = l.r AND x.season = l.season AND x.d < l.d) AS n1, (SELECT sum(v) FROM l x WHERE x.r = l.r AND x.season = l.season AND x.d < l.d) AS s1,
          (SELECT count(*) FROM g x WHERE x.season = l.season AND x.d < l.d) AS n0, (SELECT sum(v) FROM g x WHERE x.season = l.season AND x.d < l.d) AS s0,
          (SELECT count(*) FROM l x WHERE x.r = l.r AND x.season = l.season - 1) AS m1, (SELECT sum(v) FROM l x WHERE x.r = l.r AND x.season = l.season - 1) AS t1,
          (SELECT count(*) FROM g x WHERE x.season = l.season - 1) AS m0, (SELECT sum(v) FROM g x WHERE x.season = l.season - 1) AS t0 FROM l),
        e AS (SELECT id, coalesce(CASE WHEN n1 > 0 AND n0 > n1 THEN s1 / n1 - (s0 - s1) / (n0 - n1) END, CASE WHEN m1 > 0 AND m0 > m1 THEN t1 / m1 - (t0 - t1) / (m0 - m1) END) AS e FROM a)
        SELECT id AS game_id, {{r:avg(e)}} AS v_official_mean, {{r:stddev_pop(e)}} AS v_official_std, {{r:sum(e)}} AS v_official_sum FROM e GROUP BY id""",
    ),
}


def _three(s, d):
    """Three models' differences per line item."""
    return items(s, d).select("g", "n", "p", (F.col("q") - 25).alias("a"), ((F.col("disc") - 0.05) * 100).alias("b"), ((F.col("tax") - 0.04) * 100).alias("c"))


def _importance(s, d):
    """By flag and supplier, over tasks whose share is bounded: sums, and windows of a supplier, need no other shuffle."""
    return items(s, d).select("flag", "s", "p", "q").repartition(tasks(s, d), "flag", "s").groupBy("flag", "s", "p").agg(F.sum("q").alias("x"))


def _officiated(s, d):
    return orders(s, d).select(F.col("id").alias("game_id"), F.col("season").alias("season_year"), F.col("d").alias("game_date"), "v", (F.col("k") % 20).alias("r1"), ((F.col("k") + 7) % 20).alias("r2"))


