"""Queries over history windows (W) and top-k (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pastframe.operators import sets, topk, windows
from pastframe.queries.tables import ITEMS, ORDERS, entry, items, orders

_B = "PARTITION BY k ORDER BY d, id ROWS BETWEEN"
_O = ["d", "id"]

_ROWS, _DAYS, _SPANS = (15, 30, 75, 150), (3, 7, 14), (15, 30, 75)
_OF = {"bias": "avg(e)", "mae": "avg(abs(e))", "std": "stddev_samp(e)", "median": "median(e)", "over": "avg((e > 0)::INT)", "push": "avg((e = 0)::INT)", "tail": "avg((abs(e) > 15)::INT)", "score": "avg(v)", "line": "avg(l)"}
#: Each date with the rows before it, by how far back; windows of rows, of days and weights that fade by the row.
_W16 = f"""WITH {ORDERS}, g AS (SELECT id, d, v, round(v, -4) AS l, v - round(v, -4) AS e, row_number() OVER (ORDER BY d, id) AS p FROM o), y AS (SELECT d, min(p) AS p0 FROM g GROUP BY d),
    b AS (SELECT y.d, y.p0 - g.p AS back, e, v, l, y.d - g.d AS age FROM y LEFT JOIN g ON g.p < y.p0 AND g.p >= y.p0 - 1600),
    w AS (SELECT d, {', '.join(f"{a} FILTER (back <= {n}) AS {k}_{n}" for n in _ROWS for k, a in _OF.items())} FROM b GROUP BY d),
    z AS (SELECT y.d, {', '.join(f"avg(e) FILTER (y.d - g.d <= {n}) AS bias_{n}d, avg(abs(e)) FILTER (y.d - g.d <= {n}) AS mae_{n}d, avg((e > 0)::INT) FILTER (y.d - g.d <= {n}) AS over_{n}d" for n in _DAYS)}, {', '.join(f"count(e) FILTER (y.d - g.d <= {n}) AS games_{n}d" for n in (1, *_DAYS))}
      FROM y LEFT JOIN g ON g.d < y.d AND y.d - g.d <= {max(_DAYS)} GROUP BY y.d),
    x AS (SELECT d, {', '.join(f"sum(e * pow({1 - 2 / (s + 1)!r}, back - 1)) / sum(pow({1 - 2 / (s + 1)!r}, back - 1)) AS m{s}, sum(pow({1 - 2 / (s + 1)!r}, back - 1)) AS w{s}, sum(pow({1 - 2 / (s + 1)!r}, 2 * (back - 1))) AS ww{s}, sum(e * e * pow({1 - 2 / (s + 1)!r}, back - 1)) AS q{s}" for s in _SPANS)} FROM b WHERE back IS NOT NULL GROUP BY d)
    SELECT g.id, {', '.join(f"{{r:{k}_{n}}} AS regime_{k}_{n}_BEFORE" for n in _ROWS for k in _OF)}, {', '.join(f"{{r:{k}_{n}d}} AS regime_{k}_{n}d_BEFORE" for n in _DAYS for k in ("bias", "mae", "over"))},
    {', '.join(f"coalesce(games_{n}d, 0) AS regime_games_{n}d_BEFORE" for n in (1, *_DAYS))}, {', '.join(f"{{r:mae_{a} / (mae_{c} + 1e-6)}} AS regime_mae_ratio_{a}_{c}_BEFORE, {{r:bias_{a} - bias_{c}}} AS regime_bias_accel_{a}_{c}_BEFORE" for a, c in ((15, 75), (30, 150)))},
    {', '.join(f"{{r:m{s}}} AS regime_ewm_{s}_BEFORE, {{r:CASE WHEN w{s} * w{s} > ww{s} THEN sqrt(greatest(0, (q{s} / w{s} - m{s} * m{s}) * w{s} * w{s} / (w{s} * w{s} - ww{s}))) END}} AS regime_ewstd_{s}_BEFORE" for s in _SPANS)}
    FROM g JOIN w ON w.d = g.d JOIN z ON z.d = g.d LEFT JOIN x ON x.d = g.d"""

def _w16_open(s, d):
    """Orders as games: the line, the opening line and one of three books are missing in some."""
    x = orders(s, d).withColumns({"line": F.when(F.col("id") % 9 > 0, F.round("v", -4)), "open": F.when(F.col("id") % 7 > 0, F.round(F.col("v") * 0.9, -4)), "b1": F.when(F.col("id") % 5 > 0, F.col("v") + 500), "b2": F.col("v") - 900})
    got = windows.market_regime_features(x, "v", "line", "d", _O, (15, 30), (3,), (), open_line="open", books=("v", "b1", "b2"))
    return got.select("id", *[c for c in got.columns if c.startswith("regime_") and any(w in c for w in ("move", "open", "crossbook"))])


QUERIES = {
    "w1_rolling_mean": entry(
        lambda s, d: windows.rolling_mean(orders(s, d), ["v"], 5, ["k"], _O).select("id", F.col("v_last_5_BEFORE").alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:avg(v) OVER ({_B} 5 PRECEDING AND 1 PRECEDING)}} AS x FROM o",
    ),
    "w1_rolling_mean_season": entry(
        lambda s, d: windows.rolling_mean(orders(s, d), ["v"], 5, ["k"], _O, "season").select("id", F.col("v_last_5_BEFORE").alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:avg(v) OVER (PARTITION BY k, season ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)}} AS x FROM o",
    ),
    "w2_rolling_relative": entry(
        lambda s, d: windows.rolling_relative(orders(s, d), ["v"], 5, ["k"], _O, "status").select("id", F.col("v_status_minus_all_5_BEFORE").alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:avg(v) OVER (PARTITION BY k, status ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - avg(v) OVER ({_B} 5 PRECEDING AND 1 PRECEDING)}} AS x FROM o",
    ),
    "w3_rolling_window_diff": entry(
        lambda s, d: windows.rolling_window_diff(orders(s, d), ["v"], 5, 10, ["k"], _O).select("id", F.col("v_last_5_minus_10_BEFORE").alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:avg(v) OVER ({_B} 5 PRECEDING AND 1 PRECEDING) - avg(v) OVER ({_B} 10 PRECEDING AND 1 PRECEDING)}} AS x FROM o",
    ),
    "w4_season_to_date_mean": entry(
        lambda s, d: windows.season_to_date_mean(orders(s, d), "v", ["k"], _O, "season").select("id", F.col("v_season_mean_BEFORE").alias("x")),
        f"""WITH {ORDERS}, p AS (SELECT k, season + 1 AS season, avg(v) AS m FROM o GROUP BY k, season)
        SELECT id, {{r:coalesce(avg(v) OVER (PARTITION BY o.k, o.season ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m, avg(v) OVER (PARTITION BY o.k ORDER BY d, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))}} AS x
        FROM o LEFT JOIN p ON o.k = p.k AND o.season = p.season""",
    ),
    "w5_season_to_date_std": entry(
        lambda s, d: windows.season_to_date_std(orders(s, d), "v", ["k"], _O, "season").select("id", F.col("v_season_std_BEFORE").alias("x")),
        f"""WITH {ORDERS}, p AS (SELECT k, season + 1 AS season, stddev_samp(v) AS m FROM o GROUP BY k, season)
        SELECT id, {{r:coalesce(stddev_pop(v) OVER (PARTITION BY o.k, o.season ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m)}} AS x
        FROM o LEFT JOIN p ON o.k = p.k AND o.season = p.season""",
    ),
    "w6_rolling_wma": entry(
        lambda s, d: windows.rolling_wma(orders(s, d), "v", 3, ["k"], _O).select("id", F.col("v_wma_3_BEFORE").alias("x")),
        f"""WITH {ORDERS}, w AS (SELECT id, least(row_number() OVER q, 3) AS m, lag(v, 1) OVER q AS a, lag(v, 2) OVER q AS b, lag(v, 3) OVER q AS c FROM o WINDOW q AS (PARTITION BY k ORDER BY d, id))
        SELECT id, {{r:(coalesce(a * m, 0) + coalesce(b * (m - 1), 0) + coalesce(c * (m - 2), 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE m END + CASE WHEN b IS NULL THEN 0 ELSE m - 1 END + CASE WHEN c IS NULL THEN 0 ELSE m - 2 END, 0)}} AS x FROM w""",
    ),
    "w7_rolling_slope": entry(
        lambda s, d: windows.rolling_slope(orders(s, d), "v", 5, ["k"], _O).select("id", F.col("v_slope_5_BEFORE").alias("x")),
        f"""WITH {ORDERS}, r AS (SELECT id, k, v, row_number() OVER (PARTITION BY k ORDER BY d, id) AS n FROM o)
        SELECT id, {{r:regr_slope(v, n) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)}} AS x FROM r""",
    ),
    "w8_build_rolling_features": entry(
        lambda s, d: windows.build_rolling_features(orders(s, d), ["v"], ["k"], _O, (5, 10), "season", "status").select("id", F.col("v_last_5_BEFORE").alias("a"), F.col("v_last_10_BEFORE").alias("b"), F.col("v_season_mean_BEFORE").alias("c"), F.col("v_status_minus_all_5_BEFORE").alias("e")),
        f"""WITH {ORDERS} SELECT id, {{r:avg(v) OVER ({_B} 5 PRECEDING AND 1 PRECEDING)}} AS a, {{r:avg(v) OVER ({_B} 10 PRECEDING AND 1 PRECEDING)}} AS b,
        {{r:avg(v) OVER (PARTITION BY k, season ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)}} AS c,
        {{r:avg(v) OVER (PARTITION BY k, status ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - avg(v) OVER ({_B} 5 PRECEDING AND 1 PRECEDING)}} AS e FROM o""",
    ),
    "w9_flag_history": entry(
        lambda s, d: windows.flag_history(orders(s, d).withColumn("f", (F.col("status") == "F").cast("int")), "f", ["k"], _O, "season").select("id", F.col("f_last_BEFORE").alias("a"), F.col("f_freq_5_BEFORE").alias("b"), F.col("f_season_freq_BEFORE").alias("c")),
        f"""WITH {ORDERS}, f AS (SELECT *, CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END AS f FROM o)
        SELECT id, {{r:coalesce(lag(f) OVER (PARTITION BY k ORDER BY d, id), 0)}} AS a, {{r:coalesce(avg(f) OVER ({_B} 5 PRECEDING AND 1 PRECEDING), 0)}} AS b,
        {{r:coalesce(avg(f) OVER (PARTITION BY k, season ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)}} AS c FROM f""",
    ),
    "w10_record_before": entry(
        lambda s, d: windows.record_before(orders(s, d), "status", ["k", "season"], _O, "F").select("id", F.col("wins_BEFORE").alias("w"), F.col("win_ratio_BEFORE").alias("x")),
        f"""WITH {ORDERS} SELECT id, count(*) FILTER (status = 'F') OVER q AS w, {{r:coalesce((count(*) FILTER (status = 'F') OVER q) / nullif(count(status) OVER q, 0)::DOUBLE, 0)}} AS x
        FROM o WINDOW q AS (PARTITION BY k, season ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    "w11_gap_days": entry(
        lambda s, d: windows.gap_days(orders(s, d), ["k", "season"], "d", _O).select("id", F.col("rest_days_BEFORE").cast("long").alias("x")),
        f"WITH {ORDERS} SELECT id, coalesce(d - lag(d) OVER (PARTITION BY k, season ORDER BY d, id), 7) AS x FROM o",
    ),
    "w12_ewm_recursive": entry(
        lambda s, d: windows.ewm_recursive(orders(s, d), "v", ["k"], _O, 10, "status <> 'P'").select("id", F.col("v_ewm_BEFORE").alias("x")),
        f"""WITH RECURSIVE {ORDERS}, r AS (SELECT id, k, CASE WHEN status <> 'P' THEN v END AS v, row_number() OVER (PARTITION BY k ORDER BY d, id) AS n FROM o),
        e AS (SELECT id, k, n, CAST(NULL AS DOUBLE) AS before, v AS m FROM r WHERE n = 1
          UNION ALL SELECT r.id, r.k, r.n, e.m, CASE WHEN r.v IS NULL THEN e.m WHEN e.m IS NULL THEN r.v ELSE e.m * exp(-ln(2) / 10) + r.v * (1 - exp(-ln(2) / 10)) END FROM e JOIN r ON r.k = e.k AND r.n = e.n + 1)
        SELECT id, {{r:coalesce(before, 0)}} AS x FROM e""",
    ),
    "w13_rolling_prior_dates_rows": entry(
        lambda s, d: windows.rolling_prior_dates_rows(orders(s, d), "v", 20, "d", _O, "median", ("prio",)).select("id", F.col("v_median_20_rows_BEFORE").alias("x")),
        f"""WITH {ORDERS}, m AS (SELECT id, prio, d, median(v) OVER (PARTITION BY prio ORDER BY d, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM o)
        SELECT id, {{r:first_value(m) OVER (PARTITION BY prio, d ORDER BY id)}} AS x FROM m""",
    ),
    "w14_rolling_days": entry(
        lambda s, d: windows.rolling_days(orders(s, d), "v", 60, "d", "sum", ("k",)).select("id", F.col("v_sum_60d_BEFORE").alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:sum(v) OVER (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)}} AS x FROM o",
    ),
    "w14_rolling_days_mean": entry(
        lambda s, d: windows.rolling_days_mean(orders(s, d), "v", 14, "d", ("prio",)).select("id", F.col("v_mean_14d_BEFORE").alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:avg(v) OVER (PARTITION BY prio ORDER BY d RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)}} AS x FROM o",
    ),
    "w14_rolling_days_all": entry(
        lambda s, d: reduce(lambda df, f: windows.rolling_days(df, "v", 60, "d", f), ("mean", "std", "median", "min", "max", "count"), orders(s, d).select("id", "d", "v")).drop("d", "v"),
        f"""WITH {ORDERS}, y AS (SELECT DISTINCT d FROM o), m AS (SELECT y.d, avg(v) AS a, stddev_samp(v) AS s, median(v) AS m, min(v) AS lo, max(v) AS hi, count(v) AS n FROM y LEFT JOIN o ON o.d < y.d AND o.d >= y.d - 60 GROUP BY y.d)
        SELECT id, {{r:a}} AS v_mean_60d_BEFORE, {{r:s}} AS v_std_60d_BEFORE, {{r:m}} AS v_median_60d_BEFORE, {{r:lo}} AS v_min_60d_BEFORE, {{r:hi}} AS v_max_60d_BEFORE, n AS v_count_60d_BEFORE FROM o JOIN m ON m.d = o.d""",
    ),
    "w16_open_and_books": entry(
        _w16_open,
        f"""WITH {ORDERS}, q AS (SELECT *, CASE WHEN id % 9 > 0 THEN round(v, -4) END AS l, CASE WHEN id % 7 > 0 THEN round(v * 0.9, -4) END AS op, CASE WHEN id % 5 > 0 THEN v + 500 END AS b1 FROM o),
        g AS (SELECT id, d, v - op AS oe, l - op AS mv, CASE WHEN v - l IS NOT NULL AND op IS NOT NULL THEN CAST(abs(v - l) < abs(v - op) AS INT) END AS bt, CASE WHEN b1 IS NULL THEN 0 ELSE (greatest(v, b1, v - 900) - least(v, b1, v - 900)) END AS unused,
          list_stddev_pop(list_filter([v, b1, v - 900], lambda x: x IS NOT NULL)) AS sd, list_max(list_filter([v, b1, v - 900], lambda x: x IS NOT NULL)) - list_min(list_filter([v, b1, v - 900], lambda x: x IS NOT NULL)) AS rg, row_number() OVER (ORDER BY d, id) AS p FROM q), y AS (SELECT d, min(p) AS p0 FROM g GROUP BY d),
        w AS (SELECT y.d, {", ".join(f"avg(mv) FILTER (g.p >= p0 - {n}) AS mv{n}, avg(abs(mv)) FILTER (g.p >= p0 - {n}) AS am{n}, avg(bt) FILTER (g.p >= p0 - {n}) AS bt{n}, avg(oe) FILTER (g.p >= p0 - {n}) AS ob{n}, avg(abs(oe)) FILTER (g.p >= p0 - {n}) AS om{n}, stddev_samp(oe) FILTER (g.p >= p0 - {n}) AS os{n}, avg(sd) FILTER (g.p >= p0 - {n}) AS sd{n}" for n in (15, 30))} FROM y LEFT JOIN g ON g.p < y.p0 AND g.p >= y.p0 - 30 GROUP BY y.d),
        z AS (SELECT y.d, avg(abs(mv)) AS a3 FROM y LEFT JOIN g ON g.d < y.d AND y.d - g.d <= 3 GROUP BY y.d)
        SELECT g.id, {{r:sd}} AS regime_crossbook_std, {{r:rg}} AS regime_crossbook_range, {{r:a3}} AS regime_abs_move_3d_BEFORE, {", ".join(f"{{r:{a}{n}}} AS regime_{c}_{n}_BEFORE" for n in (15, 30) for a, c in (("mv", "move"), ("am", "abs_move"), ("bt", "close_beats_open"), ("ob", "open_bias"), ("om", "open_mae"), ("os", "open_std"), ("sd", "crossbook_std")))}
        FROM g JOIN w ON w.d = g.d JOIN z ON z.d = g.d""",
    ),
    "w15_ewm_prior_dates": entry(
        lambda s, d: windows.ewm_prior_dates(orders(s, d), "v", 15, "d", ["id"], ("k",)).select("id", F.col("v_ewm_15_BEFORE").alias("x")),
        f"""WITH {ORDERS}, r AS (SELECT id, k, d, v, row_number() OVER (PARTITION BY k ORDER BY d, id) AS n FROM o),
        f AS (SELECT k, d, min(n) AS n0 FROM r GROUP BY k, d),
        e AS (SELECT f.k, f.d, sum(r.v * pow(1 - 2 / 16.0, f.n0 - r.n)) / sum(pow(1 - 2 / 16.0, f.n0 - r.n)) AS m FROM f JOIN r ON r.k = f.k AND r.n < f.n0 GROUP BY f.k, f.d)
        SELECT id, {{r:m}} AS x FROM o LEFT JOIN e ON e.k = o.k AND e.d = o.d""",
    ),
    "w16_market_regime_features": entry(
        lambda s, d: windows.market_regime_features(orders(s, d).withColumn("line", F.round(F.col("v"), -4)), "v", "line", "d", _O).drop("k", "d", "season", "v", "status", "prio", "line"),
        _W16,
    ),
    "w17_prior_dynamics": entry(
        lambda s, d: windows.prior_dynamics(orders(s, d), ["v"], "k", "d", _O, "season", (5,)).select("id", F.col("v_team_5_BEFORE").alias("a"), F.col("v_team_season_BEFORE").alias("b"), F.col("v_league_5_BEFORE").alias("c")),
        f"""WITH {ORDERS}, y AS (SELECT d, avg(v) AS m FROM o GROUP BY d), l AS (SELECT d, avg(m) OVER (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS c FROM y)
        SELECT id, {{r:avg(v) OVER ({_B} 5 PRECEDING AND 1 PRECEDING)}} AS a, {{r:avg(v) OVER (PARTITION BY k, season ORDER BY o.d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)}} AS b, {{r:l.c}} AS c FROM o JOIN l ON l.d = o.d""".replace("ORDER BY d, id ROWS BETWEEN 5", "ORDER BY o.d, id ROWS BETWEEN 5"),
    ),
    "w18_last_n_matchups": entry(
        lambda s, d: windows.last_n_matchups(orders(s, d), ["k", "status"], "v", _O, 3).select("id", *[F.col(f"v_matchup_{i}_BEFORE").alias(f"m{i}") for i in (1, 2, 3)], F.col("v_matchup_mean_BEFORE").alias("x")),
        f"""WITH {ORDERS} SELECT id, {{r:lag(v, 1) OVER q}} AS m1, {{r:lag(v, 2) OVER q}} AS m2, {{r:lag(v, 3) OVER q}} AS m3, {{r:avg(v) OVER (PARTITION BY k, status ORDER BY d, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)}} AS x
        FROM o WINDOW q AS (PARTITION BY k, status ORDER BY d, id)""",
    ),
    "w19_season_expanding_mean": entry(
        lambda s, d: windows.season_expanding_mean(orders(s, d), ["v"], ["k"], _O, "season").select("id", F.col("v_season_avg_BEFORE").alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:coalesce(avg(v) OVER (PARTITION BY k, season ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)}} AS x FROM o",
    ),
    "w20_pregame_averages": entry(
        lambda s, d: windows.pregame_averages(_sides(s, d), "q", "s", "home", "g", ["d", "g"], 5),
        f"""WITH {ITEMS}, u AS (SELECT DISTINCT ON (g, n) * FROM i WHERE n <= 2 ORDER BY g, n, p, s, q, price), w AS (SELECT g, n, avg(q) OVER (PARTITION BY s ORDER BY d, g ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a,
          avg(q) OVER (PARTITION BY s, n ORDER BY d, g ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM (SELECT g, n, s, q, min(d) OVER (PARTITION BY g) + n AS d FROM u))
        SELECT g, {{r:max(CASE WHEN n = 1 THEN a END)}} AS q_home_any_5, {{r:max(CASE WHEN n = 1 THEN b END)}} AS q_home_home_5, {{r:max(CASE WHEN n = 2 THEN a END)}} AS q_away_any_5, {{r:max(CASE WHEN n = 2 THEN b END)}} AS q_away_away_5 FROM w GROUP BY g""",
    ),
    "w21_streak": entry(
        lambda s, d: windows.streak(orders(s, d).withColumn("f", F.col("status") != "O"), ["k"], "f", _O).select("id", F.col("f_streak").cast("long").alias("x")),
        f"""WITH {ORDERS}, r AS (SELECT *, status <> 'O' AS f, row_number() OVER (PARTITION BY k ORDER BY d, id) AS n FROM o)
        SELECT id, n - coalesce(max(CASE WHEN NOT f THEN n END) OVER (PARTITION BY k ORDER BY n), 0) AS x FROM r""",
    ),
    "w22_last_valid_mean": entry(
        lambda s, d: windows.last_valid_mean(orders(s, d), "v", ["k"], _O, "status <> 'P'", 3).select("id", F.col("v_last_3_valid_BEFORE").alias("x")),
        f"""WITH {ORDERS}, r AS (SELECT *, count(*) FILTER (status <> 'P') OVER (PARTITION BY k ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM o),
        g AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY d, id) AS n FROM o WHERE status <> 'P')
        SELECT r.id, {{r:avg(g.v)}} AS x FROM r LEFT JOIN g ON g.k = r.k AND g.n <= r.c AND g.n > r.c - 3 GROUP BY r.id""",
    ),
    "w23_travel_features": entry(
        lambda s, d: windows.travel_features(orders(s, d).withColumn("lat", F.col("id") % 60).withColumn("lon", F.col("id") % 120).withColumn("home", F.lit(False)), "k", "d", _O, "lat", "lon", "home", (7,)).select("id", "travel_km", F.col("travel_km_7d").alias("x"), F.col("travel_km_7d_log1p").alias("y")),
        f"""WITH {ORDERS}, p AS (SELECT id, k, d, radians(id % 60) AS a, radians(id % 120) AS b, radians(lag(id % 60) OVER q) AS pa, radians(lag(id % 120) OVER q) AS pb FROM o WINDOW q AS (PARTITION BY k ORDER BY d, id)),
        t AS (SELECT id, k, d, coalesce(2 * 6371.0 * asin(sqrt(least(pow(sin((a - pa) / 2), 2) + cos(pa) * cos(a) * pow(sin((b - pb) / 2), 2), 1.0))), 0) AS km FROM p),
        w AS (SELECT id, km, sum(km) OVER (PARTITION BY k ORDER BY d RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS x FROM t)
        SELECT id, {{r:km}} AS travel_km, {{r:x}} AS x, {{r:ln(1 + x)}} AS y FROM w""",
    ),
    "w25_opponent_value": entry(
        lambda s, d: windows.opponent_value(items(s, d), ["q"], "g").select("g", "n", "p", "s", "q", F.col("q_opp").alias("x")),
        f"WITH {ITEMS} SELECT g, n, p, s, {{r:q}} AS q, {{r:CASE WHEN count(q) OVER (PARTITION BY g) = 2 THEN sum(q) OVER (PARTITION BY g) - q END}} AS x FROM i",
    ),
    "w26_shift_to_next": entry(
        lambda s, d: windows.shift_to_next(orders(s, d), ["k"], _O, "id").select("id", "next_id"),
        f"WITH {ORDERS} SELECT id, lead(id) OVER (PARTITION BY k ORDER BY d, id) AS next_id FROM o",
    ),
    "w27_season_prior_stats": entry(
        lambda s, d: windows.season_prior_stats(orders(s, d), "v", "v", "d", "season").select("id", F.col("v_prior_mean").alias("a"), F.col("v_prior_median").alias("b"), F.col("v_prior_std").alias("c"), F.col("v_prior_pct").alias("p")),
        f"""WITH {ORDERS} SELECT a.id, {{r:avg(b.v)}} AS a, {{r:median(b.v)}} AS b, {{r:stddev_samp(b.v)}} AS c, {{r:count(*) FILTER (b.v <= a.v) / nullif(count(b.v), 0)::DOUBLE}} AS p
        FROM o a LEFT JOIN o b ON a.season = b.season AND b.d < a.d GROUP BY a.id""",
    ),
    "w28_daily_context": entry(
        lambda s, d: windows.daily_context(orders(s, d), ["v"], "d", (3, 5)).select("id", F.col("v_day_mean").alias("a"), "day_games", F.col("v_day_3_BEFORE").alias("b"), F.col("v_day_5_BEFORE").alias("c")),
        f"""WITH {ORDERS}, y AS (SELECT d, avg(v) AS m, count(*) AS n FROM o GROUP BY d), w AS (SELECT d, m, n, avg(m) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, avg(m) OVER (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS c FROM y)
        SELECT id, {{r:m}} AS a, n AS day_games, {{r:b}} AS b, {{r:c}} AS c FROM o JOIN w ON w.d = o.d""",
    ),
    "w29_rolling_reliability": entry(
        lambda s, d: windows.rolling_reliability(orders(s, d).withColumn("e", F.col("v") - 150000).withColumn("r", F.col("status") == "F"), "prio", "d", "e", "r", 5).select("id", F.col("reliability_n").alias("n"), F.col("reliability_mae").alias("a"), F.col("reliability_acc").alias("r")),
        f"""WITH {ORDERS}, y AS (SELECT prio, d, dense_rank() OVER (PARTITION BY prio ORDER BY d) AS k, count(*) AS n, sum(abs(v - 150000)) AS a, sum(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END) AS r FROM o GROUP BY prio, d),
        w AS (SELECT prio, d, sum(n) OVER q AS n, sum(a) OVER q AS a, sum(r) OVER q AS r FROM y WINDOW q AS (PARTITION BY prio ORDER BY k RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS n, {{r:a / n}} AS a, {{r:r / n}} AS r FROM o JOIN w ON w.prio = o.prio AND w.d = o.d""",
    ),
    "w30_calendar_features": entry(
        lambda s, d: windows.calendar_features(orders(s, d), "d").select("id", "is_weekend", "month", "weekday", "is_us_holiday"),
        f"""WITH {ORDERS}, c AS (SELECT id, month(d) AS m, day(d) AS y, dayofweek(d) + 1 AS w, d FROM o)
        SELECT id, CASE WHEN w IN (1, 7) THEN 1 ELSE 0 END AS is_weekend, m AS month, w AS weekday,
        CASE WHEN (m, y) IN ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) OR (m = 1 AND w = 2 AND ceil(y / 7.0) = 3) OR (m = 2 AND w = 2 AND ceil(y / 7.0) = 3) OR (m = 5 AND w = 2 AND y + 7 > day(last_day(d)))
          OR (m = 9 AND w = 2 AND ceil(y / 7.0) = 1) OR (m = 10 AND w = 2 AND ceil(y / 7.0) = 2) OR (m = 11 AND w = 5 AND ceil(y / 7.0) = 4) THEN 1 ELSE 0 END AS is_us_holiday FROM c""",
    ),
    "k1_topk_by_group": entry(
        lambda s, d: topk.topk_by_group(orders(s, d), ["k"], "v", 3, "status = 'F'", tie="id"),
        f"""WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (status = 'F') DESC, v DESC, id) AS n FROM o)
        SELECT k, {{r:max(CASE WHEN n = 1 THEN v END)}} AS v_top_1, {{r:max(CASE WHEN n = 2 THEN v END)}} AS v_top_2, {{r:max(CASE WHEN n = 3 THEN v END)}} AS v_top_3, {{r:sum(v)}} AS v_sum, {{r:avg(v)}} AS v_mean FROM r GROUP BY k""",
    ),
    "k2_latest_per_key": entry(
        lambda s, d: topk.latest_per_key(orders(s, d), ["k"], _O).select("k", "id", "d", "v"),
        f"WITH {ORDERS} SELECT k, id, d, {{r:v}} AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, id DESC) AS n FROM o) WHERE n = 1",
    ),
    "k3_most_recent": entry(
        lambda s, d: topk.most_recent(orders(s, d), 100, _O).select("id", "v"),
        f"WITH {ORDERS} SELECT id, {{r:v}} AS v FROM o ORDER BY d DESC, id DESC LIMIT 100",
    ),
    "k4_last_n_rows": entry(
        lambda s, d: topk.last_n_rows(orders(s, d), 250, "d", ["id"]).select("id", "v"),
        f"WITH {ORDERS} SELECT id, {{r:v}} AS v FROM o ORDER BY d DESC, id DESC LIMIT 250",
    ),
    "k4_last_n_dates": entry(
        lambda s, d: topk.last_n_dates(orders(s, d), 10, "d").select("id", "v"),
        f"WITH {ORDERS} SELECT id, {{r:v}} AS v FROM o WHERE d IN (SELECT DISTINCT d FROM o ORDER BY d DESC LIMIT 10)",
    ),
    "k5_leaderboard": entry(
        lambda s, d: topk.leaderboard(_runs(s, d), "m", "b").select("run_id", "rank", "m", "improvement"),
        f"""WITH {ORDERS}, g AS (SELECT CAST(k AS VARCHAR) AS run_id, avg(v) AS m, min(v) AS b FROM o GROUP BY k)
        SELECT run_id, row_number() OVER (ORDER BY m DESC, run_id) AS rank, {{r:m}} AS m, {{r:m - b}} AS improvement FROM g""",
    ),
    "k6_top_features": entry(
        lambda s, d: topk.top_features(items(s, d).groupBy("s", "p").agg(F.sum("q").alias("x")), 5, "s", "p", "x").select("p", "models", F.col("best_rank").cast("long").alias("best_rank")),
        f"""WITH {ITEMS}, g AS (SELECT s, p, sum(q) AS x FROM i GROUP BY s, p), r AS (SELECT p, row_number() OVER (PARTITION BY s ORDER BY x DESC, p) AS n FROM g)
        SELECT p, count(*) AS models, min(n) AS best_rank FROM r WHERE n <= 5 GROUP BY p""",
    ),
    "k7_select_within_tolerance": entry(
        lambda s, d: topk.select_within_tolerance(_runs(s, d), "m", tol_pct=0.2, then=("b", "run_id")).select("run_id", "m", "b"),
        f"""WITH {ORDERS}, g AS (SELECT CAST(k AS VARCHAR) AS run_id, avg(v) AS m, min(v) AS b FROM o GROUP BY k)
        SELECT run_id, {{r:m}} AS m, {{r:b}} AS b FROM g WHERE m <= (SELECT min(m) * 1.2 FROM g) ORDER BY g.b, run_id LIMIT 1""",
    ),
    "u2_dedupe": entry(
        lambda s, d: sets.dedupe(orders(s, d), ["k", "d"], ["id"], "first").select("k", "d", "id"),
        f"WITH {ORDERS} SELECT k, d, min(id) AS id FROM o GROUP BY k, d",
    ),
}


def _sides(spark, d):
    """Two rows per order, the first two lines, with a common date."""
    from pastframe.operators.topk import latest_per_key

    u = latest_per_key(items(spark, d).where("n <= 2"), ["g", "n"], ["p", "s", "q", "price"], first=True)
    day = u.groupBy("g").agg(F.min("d").alias("d"))
    return u.drop("d").join(day, "g").withColumn("d", F.date_add("d", F.col("n"))).withColumn("home", F.col("n") == 1)


def _runs(spark, d):
    """One run per customer. The sum is exact, so that runs of equal values tie whatever order they are added in."""
    mean = F.sum(F.col("v").cast("decimal(28,6)")).cast("double") / F.count("v")
    return orders(spark, d).groupBy(F.col("k").cast("string").alias("run_id")).agg(mean.alias("m"), F.min("v").alias("b"))
