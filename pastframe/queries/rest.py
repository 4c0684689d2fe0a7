"""Queries over files, rosters, frames, audits and the operators that need richer stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastframe.functions import scalar as X
from pastframe.operators import aggregates, asof, audits, experiments, filters, joins, scoring, splits, windows
from pastframe.plans import frames
from pastframe.queries.history import _sides
from pastframe.queries.tables import ITEMS, ORDERS, TICKS, entry, items, orders, table, ticks
from pastframe.sources import readers, writers
from pastframe.sources.stored import shared_folder
from pastframe.streaming import ticks as streaming


def _s1(s, d):
    out = shared_folder(s, "csv")
    for season in range(1995, 2002):  # the years of the orders
        orders(s, d).where(F.col("season") == season).select("id", "v", "prio").write.option("header", True).csv(f"{out}/{season}/part")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("prio", T.StringType())])
    return readers.read_season_csv(s, out, schema, columns=["id", "v"]).withColumn("season", F.col("season").cast("int"))


def _s4(s, d):
    e = ticks(s, d)
    t = e.select(F.col("tick_id"), F.lit(2024).alias("season_year"), F.col("market").alias("mk"), F.col("book").alias("book_id"), (F.col("minutes_before_tip") > 0).alias("is_pregame"), (-F.col("minutes_before_tip")).alias("mins_to_tip"), F.round(F.col("level") * 2).alias("left_line"))
    m = e.select("market").distinct().select("market", F.col("market").alias("mk"))
    dim = m.select(F.col("mk").alias("market_id"), "market")
    books = e.select(F.col("book").alias("book_id")).distinct().withColumn("book", F.concat(F.lit("b"), "book_id"))
    return readers.read_pregame_ticks(t.withColumnRenamed("mk", "market_id"), dim, books, [2024], ["click", "view"], ["b2"], 60).select("tick_id", "market", "book", "left_line")


def _s7(s, d):
    path = writers.backup_table(orders(s, d), shared_folder(s, "backup"), "orders", "2024-01-01", "season")
    return s.read.parquet(path).select("id", F.col("season").cast("int").alias("season"), "v")


def _s10(s, d):
    out = shared_folder(s, "partitioned")
    writers.write_partitioned(orders(s, d).select("id", "v", "season"), out, ["season"])
    writers.write_partitioned(orders(s, d).where("season = 1995 and id % 2 = 0").select("id", "v", "season"), out, ["season"])
    return s.read.parquet(out).select("id", "v", F.col("season").cast("int").alias("season"))


def _s12(s, d):
    root = shared_folder(s, "runs")
    return s.read.parquet(writers.write_run_snapshot(orders(s, d).select("id", "v"), root, "r1", "features", "m")).select("id", "v")


def _j13(s, d):
    c = table(s, d, "customer")
    idx = c.select(F.col("c_custkey").cast("string").alias("player_id"), F.col("c_name").alias("full_name"), F.concat(F.lit("No "), F.col("c_custkey").cast("string")).alias("display_name"), F.col("c_custkey").alias("last_date"))
    names = c.select(F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("no. "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("nobody "), F.col("c_custkey").cast("string"))).alias("name"))
    return joins.resolve_names(names, idx)[0]


def _log(s, d):
    """Team rows: two lines of an order as its sides, suppliers as teams."""
    return _sides(s, d).select(F.col("g").cast("string").alias("game_id"), F.col("d").alias("game_date"), F.concat_ws("-", F.col("s").cast("string"), F.col("n").cast("string")).alias("team_id"), "home", F.col("q").alias("PTS"), F.col("price").alias("POSS"))


def _same_date(s, d):
    x = _log(s, d)
    return x.join(x.groupBy("game_id").agg(F.min("game_date").alias("gd")), "game_id").drop("game_date").withColumnRenamed("gd", "game_date")


def _preds(s, d):
    return orders(s, d).select(F.col("id").alias("game_id"), "season", F.col("v").alias("actual"), F.lit(150000.0).alias("line"), (F.lit(150000.0) + (F.col("k") % 7 - 3) * 1000).alias("pred"), (F.col("id") % 3).alias("seed"))


def _st2(s, d):
    src = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events*.parquet")
    t = src.select(F.col("user_id").alias("game_id"), F.col("event_id"), F.col("ts").cast("timestamp").alias("line_ts"))
    games = table(s, d, "events").groupBy(F.col("user_id").alias("game_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("tipoff_utc"))
    out = shared_folder(s, "pregame")
    streaming.stream_pregame(t, games, 600).select("event_id", "minutes_before_tip").writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(s, "pregame-state")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


def _st3(s, d):
    src = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events*.parquet")
    t = src.select(F.col("user_id").cast("string").alias("game_id"), F.col("event_type").alias("market"), (F.col("event_id") % 3).cast("string").alias("book"), F.col("ts").cast("timestamp").alias("line_ts"), F.col("event_id").alias("tick_id"), F.round("value", 0).alias("level"))
    out = shared_folder(s, "state")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    streaming.stream_path_state(t).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_folder(s, "state-log")).trigger(availableNow=True).start().awaitTermination()
    last = s.read.parquet(out).groupBy("game_id", "market", "book").agg(F.max_by(F.struct("level", "first", "n_ticks", "n_moves", "n_reversals"), "n_ticks").alias("x"))
    return last.select("game_id", "market", "book", "x.*")


QUERIES = {
    "s1_read_season_csv": entry(_s1, f"WITH {ORDERS} SELECT id, {{r:v}} AS v, season FROM o"),
    "s4_read_pregame_ticks": entry(_s4, f"WITH {TICKS} SELECT tick_id, market, 'b' || book AS book, {{r:level}} AS left_line FROM t WHERE market IN ('click', 'view') AND book <> 2 AND minutes_before_tip >= 60"),
    "s7_backup_table": entry(_s7, f"WITH {ORDERS} SELECT id, season, {{r:v}} AS v FROM o"),
    "s10_write_partitioned": entry(_s10, f"WITH {ORDERS} SELECT id, {{r:v}} AS v, season FROM o WHERE season <> 1995 OR id % 2 = 0"),
    "s12_write_run_snapshot": entry(_s12, f"WITH {ORDERS} SELECT id, {{r:v}} AS v FROM o"),
    "f6_repair_home_flag": entry(
        lambda s, d: filters.repair_home_flag(_sides(s, d).select("g", "n", F.lit(True).alias("home"), F.concat(F.lit("S"), F.col("n").cast("string")).alias("team"), F.lit("S2 @ S1").alias("m")), "g", "home", "m", "team").select("g", "n", "home"),
        f"WITH {ITEMS}, u AS (SELECT DISTINCT g, n FROM i WHERE n <= 2) SELECT g, n, CASE WHEN count(*) OVER (PARTITION BY g) > 1 THEN n = 1 ELSE TRUE END AS home FROM u",
    ),
    "f11_select_point_in_time": entry(
        lambda s, d: filters.select_point_in_time(windows.rolling_mean(orders(s, d), ["v"], 5, ["k"], ["d", "id"]), static=("id",), banned=("v",)),
        f"WITH {ORDERS} SELECT id, {{r:avg(v) OVER (PARTITION BY k ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)}} AS v_last_5_BEFORE FROM o",
    ),
    "f13_prune_columns": entry(
        lambda s, d: filters.prune_columns(items(s, d).select("g", "n", "p", "q", (F.col("q") * 2).alias("q2"), F.lit(1).alias("one"), F.when(F.col("n") > 6, F.col("q")).alias("rare"), "flag"), keep=("g", "n", "p", "q"))[0],
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, {{r:q * 2}} AS q2 FROM i",
    ),
    "j6_append_scheduled": entry(
        lambda s, d: joins.append_scheduled(orders(s, d).where("status <> 'P'").select("id", "k", "v"), orders(s, d).where("status = 'P'").select("id", "k"), 0),
        f"WITH {ORDERS} SELECT id, k, {{r:CASE WHEN status <> 'P' THEN v END}} AS v FROM o",
    ),
    "j13_resolve_names": entry(
        _j13,
        """SELECT CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'no. ' || c_custkey ELSE 'nobody ' || c_custkey END AS name, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey AS VARCHAR) END AS player_id,
        CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS rule FROM customer""",
    ),
    "j16_assemble_dataset": entry(
        lambda s, d: joins.assemble_dataset(orders(s, d).select("id", "k", "v"), items(s, d).groupBy(F.col("g").alias("id"), F.col("n").alias("snap")).agg(F.sum("q").alias("q")), orders(s, d).where("status = 'F'").select("id", "season"), "id", "snap", ("v",))[0],
        f"WITH {ORDERS}, {ITEMS}, x AS (SELECT g, n, sum(q) AS q FROM i GROUP BY g, n) SELECT o.id, n AS snap, {{r:q}} AS q, k, CASE WHEN status = 'F' THEN season END AS season FROM x JOIN o ON o.id = x.g",
    ),
    "t3_levels": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", asof.up_probability(1.5 + F.col("disc"), 1.6 + F.col("tax")).alias("u")).withColumn("x", asof.market_level(F.col("q"), F.col("u"), F.when(F.col("n") > 3, "moneyline").otherwise("total"))),
        f"WITH {ITEMS}, u AS (SELECT *, (1 / (1.5 + disc)) / (1 / (1.5 + disc) + 1 / (1.6 + tax)) AS u FROM i) SELECT g, n, p, {{r:q}} AS q, {{r:u}} AS u, {{r:CASE WHEN n > 3 THEN u ELSE q END}} AS x FROM u",
    ),
    "x14_normalize_side": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", X.normalize_side(F.when(F.col("flag") == "A", " Over").when(F.col("flag") == "R", "U")).alias("x")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, CASE flag WHEN 'A' THEN 'over' WHEN 'R' THEN 'under' END AS x FROM i",
    ),
    "x16_parse_contributions": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", F.get(X.parse_contributions(F.to_json(F.array(F.struct(F.lit("a").alias("feature"), F.col("q").alias("value"), F.col("disc").alias("contribution")), F.struct(F.lit("b").alias("feature"), F.col("q").alias("value"), (-F.col("tax")).alias("contribution"))))), 0)["feature"].alias("top")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, CASE WHEN disc >= tax THEN 'a' ELSE 'b' END AS top FROM i",
    ),
    "x18_mentions_injury": entry(
        lambda s, d: table(s, d, "documents").select("doc_id", X.mentions_injury(F.col("text")).alias("x"), X.is_unavailable(F.col("source")).alias("y")),
        "SELECT doc_id, regexp_matches(text, '(?i)injur|injry') AS x, FALSE AS y FROM documents",
    ),
    "p1_unavailable": entry(
        lambda s, d: joins.unavailable(orders(s, d).where("id % 7 = 0").select(F.col("id").alias("game_id"), F.col("prio").alias("team_id"), F.col("k").alias("player_id")), orders(s, d).select(F.col("id").alias("game_id"), F.col("prio").alias("team_id"), F.col("k").alias("player_id"), F.when(F.col("status") == "P", "knee Injury").alias("comment"))),
        f"WITH {ORDERS} SELECT DISTINCT id AS game_id, prio AS team_id, k AS player_id FROM o WHERE id % 7 = 0 OR status = 'P'",
    ),
    "e19_build_meta_frame": entry(
        lambda s, d: scoring.build_meta_frame(_preds(s, d).select("game_id", "season", "actual"), {"a": _preds(s, d).select("game_id", F.col("pred").alias("prediction")), "b": _preds(s, d).where("game_id % 2 = 0").select("game_id", F.col("line").alias("prediction"))}, ["game_id"], "season", 2),
        f"WITH {ORDERS} SELECT id AS game_id, season, {{r:v}} AS actual, {{r:150000 + (k % 7 - 3) * 1000}} AS pred_a, {{r:150000}} AS pred_b FROM o WHERE id % 2 = 0 AND season > (SELECT max(season) FROM o) - 2",
    ),
    "e23_prepare_frame": entry(
        lambda s, d: scoring.prepare_frame(_preds(s, d).withColumn("game_id", F.lpad(F.col("game_id").cast("string"), 8, "0")), "season", 1994, "game_id", {"0000": "a", "0001": "b"}, ["a"], "actual", "line", ["pred"]),
        f"WITH {ORDERS}, x AS (SELECT *, lpad(CAST(id AS VARCHAR), 8, '0') AS g FROM o) SELECT g AS game_id, season, {{r:150000 + (k % 7 - 3) * 1000}} AS pred, {{r:150000}} AS line, {{r:v}} AS actual, (v > 150000)::INT AS is_over, {{r:v - 150000}} AS line_error FROM x WHERE season >= 1994 AND substr(g, 1, 4) = '0000' AND v <> 150000",
    ),
    "e25_holdout_summary": entry(
        lambda s, d: scoring.holdout_summary(_preds(s, d), "pred", "actual", "line").select("seed", "n", "mae", "rmse", "line_mae", "n_bets", "wins", "losses"),
        f"""WITH {ORDERS}, p AS (SELECT id % 3 AS seed, v, 150000 + (k % 7 - 3) * 1000 AS pred FROM o)
        SELECT seed, count(*) AS n, {{r:avg(abs(v - pred))}} AS mae, {{r:sqrt(avg((v - pred) * (v - pred)))}} AS rmse, {{r:avg(abs(v - 150000))}} AS line_mae, count(*) FILTER (pred <> 150000) AS n_bets, count(*) FILTER ((v - 150000) * (pred - 150000) > 0) AS wins, count(*) FILTER ((v - 150000) * (pred - 150000) < 0) AS losses FROM p GROUP BY seed""",
    ),
    "q6_diagnose": entry(
        lambda s, d: audits.diagnose(items(s, d).where("n <= 2").select("g", (F.col("n") == 1).alias("home"), F.col("d").cast("timestamp").alias("start")), orders(s, d).select(F.col("id").alias("g"), F.col("d").cast("timestamp").alias("start")), "g", "home", "start").select("g", "n_home", "n_away", F.array_join("problems", ",").alias("why")),
        f"""WITH {ORDERS}, {ITEMS}, x AS (SELECT g, count(*) FILTER (n = 1) AS n_home, count(*) FILTER (n = 2) AS n_away, min(d) AS d FROM i WHERE n <= 2 GROUP BY g),
        y AS (SELECT g, n_home, n_away, concat_ws(',', CASE WHEN n_home <> 1 OR n_away <> 1 THEN 'sides' END, CASE WHEN x.d <> o.d THEN 'start' END) AS why FROM x LEFT JOIN o ON o.id = x.g) SELECT * FROM y WHERE why <> ''""",
    ),
    "m4_rescore": entry(
        lambda s, d: experiments.rescore(orders(s, d).select(F.col("prio").alias("run_id")).distinct(), orders(s, d).select(F.col("prio").alias("run_id"), (F.col("k") % 7 - 3).cast("double").alias("edge"), F.col("v").alias("actual"), F.lit(150000.0).alias("line")), 1.0).select("run_id", "n_bets", "wins", "losses"),
        f"WITH {ORDERS} SELECT prio AS run_id, count(*) FILTER (abs(k % 7 - 3) > 1) AS n_bets, count(*) FILTER (abs(k % 7 - 3) > 1 AND (v - 150000) * (k % 7 - 3) > 0) AS wins, count(*) FILTER (abs(k % 7 - 3) > 1 AND (v - 150000) * (k % 7 - 3) < 0) AS losses FROM o GROUP BY prio",
    ),
    "m5_pooled_vs_control": entry(
        lambda s, d: experiments.pooled_vs_control(orders(s, d), "1-URGENT", "prio", "v"),
        f"WITH {ORDERS}, c AS (SELECT avg(v) AS c FROM o WHERE prio = '1-URGENT') SELECT prio, {{r:avg(v)}} AS v, count(*) AS n, {{r:max(c)}} AS control, {{r:avg(v) - max(c)}} AS gap FROM o, c GROUP BY prio",
    ),
    "a17_calibrate_timezone": entry(
        lambda s, d: aggregates.calibrate_timezone(table(s, d, "events").select(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York").alias("l"), (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=(F.col("event_id") % 3).cast("int"))).alias("u")), "l", "u", ["America/New_York", "UTC", "Europe/Madrid"]),
        """WITH z AS (SELECT unnest(['America/New_York', 'UTC', 'Europe/Madrid']) AS zone, unnest([0, 300, 360]) AS off) SELECT zone, {r:median(off + event_id % 3)} AS median_residual, {r:max(off + event_id % 3)} AS max_residual, count(*) AS rows FROM events, z GROUP BY zone""",
    ),
    "e20_timing_metrics": entry(
        lambda s, d: scoring.timing_metrics(ticks(s, d), "minutes_before_tip", "price", "level", X.timing_bucket(F.col("minutes_before_tip"), (600, 6000))),
        f"WITH {TICKS} SELECT CASE WHEN minutes_before_tip <= 600 THEN '<=600' WHEN minutes_before_tip <= 6000 THEN '<=6000' ELSE '>6000' END AS timing, count(*) AS n, {{r:avg(abs(price - level))}} AS mae, {{r:avg(price - level)}} AS bias, {{r:avg(minutes_before_tip)}} AS mean_minutes FROM t GROUP BY 1",
    ),
    "e20_pre_midnight": entry(
        lambda s, d: scoring.pre_midnight(orders(s, d).select("id", F.date_sub("d", (F.col("id") % 2).cast("int")).cast("timestamp").alias("at"), "d"), "at", "d", "UTC").select("id"),
        f"WITH {ORDERS} SELECT id FROM o WHERE id % 2 = 1",
    ),
    "e27_walk_audit": entry(
        lambda s, d: scoring.walk_audit(orders(s, d).withColumn("end", F.date_sub("d", (F.col("id") % 4).cast("int"))), "k", "d", "end"),
        f"WITH {ORDERS} SELECT k, count(*) AS days, count(*) FILTER (id % 4 = 0) AS leaking_days FROM o GROUP BY k",
    ),
    "e30_fold_comparison": entry(
        lambda s, d: scoring.fold_comparison(orders(s, d).groupBy(F.col("season").alias("fold")).agg(F.avg("v").alias("mae")), orders(s, d).groupBy(F.col("season").alias("fold")).agg(F.median("v").alias("mae"))),
        f"WITH {ORDERS}, x AS (SELECT season AS fold, avg(v) AS m, median(v) AS b FROM o GROUP BY season) SELECT fold, {{r:m}} AS model, {{r:b}} AS baseline, {{r:m - b}} AS delta, m < b AS better FROM x",
    ),
    "m3_effects": entry(
        lambda s, d: experiments.effects(experiments.contrasts(orders(s, d).withColumnRenamed("id", "run_id"), "prio", ["k", "season"], ["v"], "d"), "prio", ["v"]),
        f"""WITH {ORDERS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, season, prio ORDER BY d, id) AS r FROM o) WHERE r = 1), c AS (SELECT *, count(*) OVER (PARTITION BY k, season) AS c, v - first_value(v) OVER (PARTITION BY k, season ORDER BY prio) AS x FROM f)
        SELECT prio, count(*) AS groups, {{r:avg(x)}} AS v_effect FROM c WHERE c >= 2 GROUP BY prio""",
    ),
    "m8_cv_vs_holdout": entry(
        lambda s, d: experiments.cv_vs_holdout(orders(s, d).where("season < 1996").groupBy("k").agg(F.avg("v").alias("roi")), orders(s, d).where("season >= 1996").groupBy("k").agg(F.avg("v").alias("roi")), "k"),
        f"WITH {ORDERS}, x AS (SELECT k, avg(CASE WHEN season < 1996 THEN v END) AS a, avg(CASE WHEN season >= 1996 THEN v END) AS b FROM o GROUP BY k) SELECT k, {{r:a}} AS cv, {{r:b}} AS holdout, {{r:b - a}} AS gap FROM x WHERE a IS NOT NULL AND b IS NOT NULL",
    ),
    "v4_explode_events": entry(
        lambda s, d: readers.explode_events(items(s, d).groupBy("g").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n", "p")))).alias("j")), "j", "struct<n:int,p:bigint>", ["g"]).select("g", "event.n", "event.p"),
        f"WITH {ITEMS} SELECT g, n, p FROM i",
    ),
    "w30_same_group_flags": entry(
        lambda s, d: windows.same_group_flags(orders(s, d).select("id", "status", "prio"), "status", "prio", {"x": {"F": "1", "O": "2", "1-URGENT": "1", "2-HIGH": "2"}}).select("id", "same_x"),
        f"WITH {ORDERS} SELECT id, CASE WHEN (status = 'F' AND prio = '1-URGENT') OR (status = 'O' AND prio = '2-HIGH') THEN 1 ELSE 0 END AS same_x FROM o",
    ),
    "b0_base_game_features": entry(
        lambda s, d: frames.base_game_features(_same_date(s, d), ["PTS", "POSS"], "PTS").select("game_id", "TOTAL", F.col("PTS_last_5_BEFORE_TEAM_HOME").alias("h"), F.col("PTS_last_5_BEFORE_TEAM_AWAY").alias("a"), F.col("PTS_last_5_BEFORE_DIFF").alias("x")),
        f"""WITH {ITEMS}, u AS (SELECT DISTINCT ON (g, n) * FROM i WHERE n <= 2 ORDER BY g, n, p, s, q, price), t AS (SELECT g, n, s, q, min(d) OVER (PARTITION BY g) AS d0, min(n) OVER (PARTITION BY g) AS n0 FROM u),
        w AS (SELECT g, n, q, avg(q) OVER (PARTITION BY s, n ORDER BY d0 + n0, CAST(g AS VARCHAR) ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, count(*) OVER (PARTITION BY g) AS c FROM t)
        SELECT CAST(g AS VARCHAR) AS game_id, {{r:sum(q)}} AS TOTAL, {{r:max(CASE WHEN n = 1 THEN a END)}} AS h, {{r:max(CASE WHEN n = 2 THEN a END)}} AS a, {{r:max(CASE WHEN n = 1 THEN a END) - max(CASE WHEN n = 2 THEN a END)}} AS x FROM w WHERE c = 2 GROUP BY g""",
    ),
    "v1_rolling_apply": entry(
        lambda s, d: splits.rolling_apply(orders(s, d), "v", 5, ["k"], ["d", "id"], lambda v: F.array_max(v) - F.array_min(v), "x").select("id", "x"),
        f"WITH {ORDERS} SELECT id, {{r:max(v) OVER w - min(v) OVER w}} AS x FROM o WINDOW w AS (PARTITION BY k ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
    ),
    "st2_stream_pregame": entry(_st2, f"WITH {TICKS} SELECT tick_id AS event_id, {{r:minutes_before_tip}} AS minutes_before_tip FROM t WHERE minutes_before_tip >= 600"),
    "st3_stream_path_state": entry(
        _st3,
        f"""WITH {TICKS}, x AS (SELECT *, level - lag(level) OVER w AS delta FROM t WINDOW w AS (PARTITION BY game_id, market, book ORDER BY line_ts, tick_id)),
        m AS (SELECT tick_id, sign(delta) <> lag(sign(delta)) OVER (PARTITION BY game_id, market, book ORDER BY line_ts, tick_id) AS rev FROM x WHERE delta <> 0)
        SELECT CAST(game_id AS VARCHAR) AS game_id, market, CAST(book AS VARCHAR) AS book, {{r:arg_max(level, (line_ts, tick_id))}} AS level, {{r:arg_min(level, (line_ts, tick_id))}} AS first, count(*) AS n_ticks, count(*) FILTER (delta <> 0) AS n_moves, count(*) FILTER (rev) AS n_reversals
        FROM x LEFT JOIN m USING (tick_id) GROUP BY game_id, market, book""",
    ),
}
