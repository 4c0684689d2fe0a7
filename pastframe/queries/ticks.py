"""Queries over tick panels (T), market features (O) and streams (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastframe.operators import asof, market
from pastframe.queries.tables import ITEMS, TICKS, entry, items, table, ticks
from pastframe.sources.stored import shared_folder
from pastframe.streaming import ticks as streaming

GRID = (600, 6000, 20000)
_K = "game_id, market, book"
_H = "h AS (SELECT t.*, horizon FROM t JOIN (SELECT unnest([600, 6000, 20000]) AS horizon) ON horizon <= minutes_before_tip)"


def _st1(spark, d):
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    t = src.select(F.col("user_id").cast("string").alias("game_id"), F.col("event_type").alias("market"), (F.col("event_id") % 3).cast("string").alias("book"), F.col("ts").cast("timestamp").alias("line_ts"), "value")
    sink = shared_folder(spark, "ticks")
    streaming.stream_ticks(t.unionByName(t), sink, shared_folder(spark, "ticks-state"), late="3650 days").awaitTermination()
    return spark.read.parquet(sink).groupBy("market").agg(F.count("*").alias("n"), F.sum("value").alias("x"))


def _st4(spark, d):
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    sink = shared_folder(spark, "latest")
    streaming.stream_latest(src.select("user_id", "event_type", "ts", "event_id", "value"), sink, shared_folder(spark, "latest-state"), ["user_id", "event_type"], "ts").awaitTermination()
    return streaming.latest(spark, sink, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


QUERIES = {
    "t1_resolve_line": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", asof.resolve_line(F.when(F.col("n") > 2, F.col("q")), F.col("tax"), F.when(F.col("flag") == "A", "spread").when(F.col("flag") == "R", "moneyline").otherwise("total")).alias("x")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, {{r:CASE WHEN flag = 'R' THEN NULL WHEN n > 2 THEN q WHEN flag = 'A' THEN -tax ELSE tax END}} AS x FROM i",
    ),
    "t2_snapshot_panel": entry(
        lambda s, d: asof.snapshot_panel(ticks(s, d), GRID).select("game_id", "market", "book", "horizon", "n_ticks", "staleness", "level", "tick_id"),
        f"""WITH {TICKS}, {_H} SELECT {_K}, horizon, count(*) AS n_ticks, {{r:min(minutes_before_tip) - horizon}} AS staleness, {{r:arg_max(level, (-minutes_before_tip, tick_id))}} AS level, arg_max(tick_id, (-minutes_before_tip, tick_id)) AS tick_id
        FROM h GROUP BY {_K}, horizon""",
    ),
    "t4_tick_deltas": entry(
        lambda s, d: asof.tick_deltas(ticks(s, d), "level", "price").select("tick_id", "delta", "move_sign", "is_move", "price_only"),
        f"""WITH {TICKS}, x AS (SELECT tick_id, level - lag(level) OVER w AS delta, price - lag(price) OVER w AS p FROM t WINDOW w AS (PARTITION BY {_K} ORDER BY line_ts, tick_id))
        SELECT tick_id, {{r:delta}} AS delta, CAST(sign(delta) AS INTEGER) AS move_sign, coalesce(delta <> 0, FALSE) AS is_move, coalesce(delta = 0 AND p <> 0, FALSE) AS price_only FROM x""",
    ),
    "t5_path_aggregates": entry(
        lambda s, d: asof.path_aggregates(ticks(s, d), "level", GRID).select("game_id", "market", "book", "horizon", "n_ticks", "n_moves", "n_levels", "level_max", "level_min", "level_std", "path_length", "opener", "level", "n_reversals"),
        f"""WITH {TICKS}, x AS (SELECT *, level - lag(level) OVER w AS delta FROM t WINDOW w AS (PARTITION BY {_K} ORDER BY line_ts, tick_id)),
        m AS (SELECT tick_id, sign(delta) <> lag(sign(delta)) OVER (PARTITION BY {_K} ORDER BY line_ts, tick_id) AS rev FROM x WHERE delta <> 0),
        y AS (SELECT x.*, coalesce(rev, FALSE) AS rev FROM x LEFT JOIN m USING (tick_id)), h AS (SELECT y.*, horizon FROM y JOIN (SELECT unnest([600, 6000, 20000]) AS horizon) ON horizon <= minutes_before_tip)
        SELECT {_K}, horizon, count(*) AS n_ticks, count(*) FILTER (delta <> 0) AS n_moves, count(DISTINCT level) AS n_levels, {{r:max(level)}} AS level_max, {{r:min(level)}} AS level_min, {{r:stddev_samp(level)}} AS level_std,
        {{r:coalesce(sum(abs(delta)), 0)}} AS path_length, {{r:arg_min(level, (line_ts, tick_id))}} AS opener, {{r:arg_max(level, (line_ts, tick_id))}} AS level, count(*) FILTER (rev) AS n_reversals FROM h GROUP BY {_K}, horizon""",
    ),
    "t6_lookback_moves": entry(
        lambda s, d: asof.lookback_moves(ticks(s, d), "level", GRID, (600, 6000)).select("game_id", "market", "book", "horizon", "level", "has_600", "move_600", "has_6000", "move_6000", "velocity_6000"),
        f"""WITH {TICKS}, g AS (SELECT unnest([600, 6000, 20000]) AS horizon), w AS (SELECT DISTINCT horizon + x AS horizon FROM g, (SELECT unnest([0, 600, 6000]) AS x)),
        p AS (SELECT {_K}, horizon, arg_max(level, (-minutes_before_tip, tick_id)) AS level FROM t JOIN w ON horizon <= minutes_before_tip GROUP BY {_K}, horizon)
        SELECT p.game_id, p.market, p.book, p.horizon, {{r:p.level}} AS level, (a.level IS NOT NULL)::INT AS has_600, {{r:coalesce(p.level - a.level, 0)}} AS move_600, (b.level IS NOT NULL)::INT AS has_6000, {{r:coalesce(p.level - b.level, 0)}} AS move_6000,
        {{r:coalesce((p.level - b.level) * 60 / 6000, 0)}} AS velocity_6000
        FROM p JOIN g USING (horizon) LEFT JOIN p a ON (a.game_id, a.market, a.book, a.horizon) = (p.game_id, p.market, p.book, p.horizon + 600) LEFT JOIN p b ON (b.game_id, b.market, b.book, b.horizon) = (p.game_id, p.market, p.book, p.horizon + 6000)""",
    ),
    "t7_path_shape": entry(
        lambda s, d: asof.path_shape(asof.path_aggregates(ticks(s, d), "level", GRID)).select("game_id", "market", "book", "horizon", "open_move", "open_direction", "range_position"),
        f"""WITH {TICKS}, {_H}, a AS (SELECT {_K}, horizon, arg_min(level, (line_ts, tick_id)) AS o, arg_max(level, (line_ts, tick_id)) AS c, max(level) AS hi, min(level) AS lo FROM h GROUP BY {_K}, horizon)
        SELECT {_K}, horizon, {{r:c - o}} AS open_move, CAST(sign(c - o) AS INTEGER) AS open_direction, {{r:CASE WHEN hi = lo THEN 0.5 ELSE (c - lo) / (hi - lo) END}} AS range_position FROM a""",
    ),
    "t8_source_deviation": entry(
        lambda s, d: asof.source_deviation(asof.snapshot_panel(ticks(s, d), GRID), ["game_id", "market", "horizon"], "level").select("game_id", "market", "book", "horizon", "deviation", "abs_deviation", "deviation_z", "is_outlier"),
        f"""WITH {TICKS}, {_H}, p AS (SELECT {_K}, horizon, arg_max(level, (-minutes_before_tip, tick_id)) AS level FROM h GROUP BY {_K}, horizon),
        x AS (SELECT *, level - avg(level) OVER w AS dv, stddev_pop(level) OVER w AS sd FROM p WINDOW w AS (PARTITION BY game_id, market, horizon))
        SELECT {_K}, horizon, {{r:dv}} AS deviation, {{r:abs(dv)}} AS abs_deviation, {{r:coalesce(dv / nullif(sd, 0), 0)}} AS deviation_z, abs(coalesce(dv / nullif(sd, 0), 0)) > 1.5 AS is_outlier FROM x""",
    ),
    "t9_open_to_close": entry(
        lambda s, d: asof.open_to_close(ticks(s, d), "level").select("game_id", "market", "level_move_median", "sources"),
        f"""WITH {TICKS}, g AS (SELECT {_K}, arg_max(level, (line_ts, tick_id)) - arg_min(level, (line_ts, tick_id)) AS m FROM t GROUP BY {_K}) SELECT game_id, market, {{r:median(m)}} AS level_move_median, count(*) AS sources FROM g GROUP BY game_id, market""",
    ),
    "t10_build_snapshot_dataset": entry(
        lambda s, d: _t10(s, d),
        f"""WITH {TICKS}, {_H}, a AS (SELECT {_K}, horizon, arg_max(level, (line_ts, tick_id)) AS c FROM h GROUP BY {_K}, horizon), e AS (SELECT game_id, market, horizon, median(c) AS m FROM a GROUP BY ALL),
        k AS (SELECT game_id, horizon, max(CASE WHEN market = 'click' THEN m END) AS line FROM e GROUP BY ALL), y AS (SELECT game_id, sum(price) AS y FROM t GROUP BY game_id)
        SELECT k.game_id, horizon AS snapshot, {{r:y - line}} AS line_error, {{r:1.0 / count(*) OVER (PARTITION BY k.game_id)}} AS w FROM k JOIN y ON y.game_id = k.game_id""",
    ),
    "t11_inverse_group_weight": entry(
        lambda s, d: asof.inverse_group_weight(items(s, d), "g").select("g", "n", "p", "q", "weight"),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, {{r:1.0 / count(*) OVER (PARTITION BY g)}} AS weight FROM i",
    ),
    "t12_slice_horizon": entry(
        lambda s, d: asof.slice_horizon(asof.snapshot_panel(ticks(s, d), GRID, ["game_id"]), 6000).select("game_id", "n_ticks", "tick_id"),
        f"WITH {TICKS}, {_H} SELECT game_id, count(*) AS n_ticks, arg_max(tick_id, (-minutes_before_tip, tick_id)) AS tick_id FROM h WHERE horizon = 6000 GROUP BY game_id",
    ),
    "o1_market_features": entry(
        lambda s, d: market.market_features(_odds(s, d)).select("g", "odds_total_a_mid", "odds_total_b_vig", "odds_total_mid_mean", "odds_total_mid_range", "odds_is_fav_home", "odds_implied_home"),
        f"""WITH {ITEMS}, b AS (SELECT g, max(q) + 180 AS la, min(q) + 185 AS lb, max(disc) + 1.8 AS po, max(tax) + 1.85 AS pu, max(CASE WHEN n = 1 THEN q - 25 END) AS sp FROM i GROUP BY g)
        SELECT g, {{r:la}} AS odds_total_a_mid, {{r:1 / po + 1 / pu - 1}} AS odds_total_b_vig, {{r:(la + lb) / 2}} AS odds_total_mid_mean, {{r:abs(la - lb)}} AS odds_total_mid_range, coalesce(sp < 0, FALSE)::INT AS odds_is_fav_home, {{r:la / 2 - sp / 2}} AS odds_implied_home FROM b""",
    ),
    "o1_moneyline": entry(
        lambda s, d: market.market_features(_odds(s, d).join(items(s, d).groupBy("g").agg(F.max(F.when(F.col("n") == 1, F.col("q") * 5 + 101)).alias("ml_a_price_home"), (F.min("q") * -3 - 100).alias("ml_a_price_away"), (F.max("disc") * 8 + 1.2).alias("ml_b_price_home"), F.max(F.when(F.col("n") > 2, F.col("tax") * 9 + 1.3)).alias("ml_b_price_away")), "g")).select("g", "odds_ml_a_home_prob", "odds_ml_b_vig", "odds_ml_favorite_prob", "odds_ml_prob_gap", "odds_ml_vig_mean"),
        f"""WITH {ITEMS}, b AS (SELECT g, 1 / (1 + max(CASE WHEN n = 1 THEN q * 5 + 101 END) / 100) AS ph, 1 / (1 + 100 / (min(q) * 3 + 100)) AS pa, 1 / (max(disc) * 8 + 1.2) AS qh, 1 / max(CASE WHEN n > 2 THEN tax * 9 + 1.3 END) AS qa FROM i GROUP BY g),
        c AS (SELECT g, ph / (ph + pa) AS h1, qh / (qh + qa) AS h2, ph + pa - 1 AS v1, qh + qa - 1 AS v2 FROM b), m AS (SELECT *, list_avg(list_filter([h1, h2], lambda x: x IS NOT NULL)) AS h, list_avg(list_filter([v1, v2], lambda x: x IS NOT NULL)) AS v FROM c)
        SELECT g, {{r:h1}} AS odds_ml_a_home_prob, {{r:v2}} AS odds_ml_b_vig, {{r:CASE WHEN h IS NOT NULL THEN greatest(h, 1 - h) END}} AS odds_ml_favorite_prob, {{r:abs(2 * h - 1)}} AS odds_ml_prob_gap, {{r:v}} AS odds_ml_vig_mean FROM m""",
    ),
    "o2_side_differences": entry(
        lambda s, d: market.side_differences(items(s, d).select("g", "n", "p", F.col("q").alias("X_BEFORE_TEAM_HOME"), F.col("tax").alias("X_BEFORE_TEAM_AWAY")), ["_BEFORE$|_BEFORE_"]).select("g", "n", "p", F.col("X_BEFORE_DIFF").alias("x")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q - tax}} AS x FROM i",
    ),
    "o3_derived_features": entry(
        lambda s, d: market.derived_features(items(s, d).select("g", "n", "p", F.col("q").alias("POSS_BEFORE_TEAM_HOME"), F.col("tax").alias("POSS_BEFORE_TEAM_AWAY")), market.DERIVED).select("g", "n", "p", F.col("EXPECTED_POSS_BEFORE").alias("x")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:(q + tax) / 2}} AS x FROM i",
    ),
    "o4_style_matchups": entry(
        lambda s, d: market.style_matchups(items(s, d).select("g", "n", "p", F.col("q").alias("R_BEFORE_TEAM_HOME"), F.col("tax").alias("R_BEFORE_TEAM_AWAY"), F.col("disc").alias("R_opp_BEFORE_TEAM_HOME"), F.col("price").alias("R_opp_BEFORE_TEAM_AWAY")), ["R"]).select("g", "n", "p", F.col("R_EXPECTED_HOME_BEFORE").alias("a"), F.col("R_EXPECTED_AWAY_BEFORE").alias("b")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:(q + price) / 2}} AS a, {{r:(tax + disc) / 2}} AS b FROM i",
    ),
    "st1_stream_ticks": entry(_st1, "SELECT event_type AS market, count(*) AS n, {r:sum(value)} AS x FROM events GROUP BY event_type"),
    "st4_stream_latest": entry(_st4, "SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type"),
}


def _odds(s, d):
    """One row per order with the quotes of two books and a spread."""
    g = items(s, d).groupBy("g").agg((F.max("q") + 180).alias("la"), (F.min("q") + 185).alias("lb"), (F.max("disc") + 1.8).alias("po"), (F.max("tax") + 1.85).alias("pu"), F.max(F.when(F.col("n") == 1, F.col("q") - 25)).alias("sp"))
    cols = {f"total_{b}_{c}": F.col(v) for b, x in (("a", "la"), ("b", "lb")) for c, v in (("line_over", x), ("line_under", x), ("price_over", "po"), ("price_under", "pu"))}
    return g.select("g", *[v.alias(k) for k, v in cols.items()], F.col("sp").alias("spread_a_line_home"))


def _t10(s, d):
    t = ticks(s, d)
    base = t.groupBy("game_id").agg(F.sum("price").alias("target"))
    hist = t.groupBy("game_id").agg(F.count("*").alias("h"))
    train, _ = asof.build_snapshot_dataset(t, base, hist, ["click", "view"], [0, 1, 2], "target", grid=GRID)
    return train.select("game_id", "snapshot", "line_error", F.col("snapshot_weight").alias("w"))
