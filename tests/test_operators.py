"""Operators that need texts, nesting, files or streams of their own, on small fixtures."""

import datetime as dt
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastframe.functions import scalar as X
from pastframe.operators import asof, audits, experiments, filters, joins, market, players, scoring, splits, topk, windows
from pastframe.plans import frames
from pastframe.sources import readers, writers
from pastframe.streaming import ticks as streaming


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_prices(spark):
    df = spark.createDataFrame([(150.0,), (-200.0,), (1.91,), (0.5,), (0.0,), (None,)], "x double")
    got = [r[0] for r in df.select(X.to_decimal(F.col("x"))).collect()]
    assert got == [2.5, 1.5, 1.91, None, None, None]


def test_center_line_moves_towards_the_likelier_side(spark):
    df = spark.createDataFrame([(209.5, 1.62, 2.20), (209.5, 1.91, 1.91), (210.0, 1.62, 2.20), (210.0, 1.91, 1.91), (None, 1.9, 1.9), (210.0, None, 1.9)], "l double, o double, u double")
    got = [r[0] for r in df.select(X.center_line(F.col("l"), F.col("o"), F.col("u"))).collect()]
    assert got[0] == pytest.approx(212.5, abs=0.7) and got[1] == pytest.approx(209.5) and got[3] == pytest.approx(210.0, abs=1e-6)
    assert got[2] > 210 and got[4] is None and got[5] is None


def test_center_line_is_where_both_sides_are_even():
    rng = np.random.default_rng(1)
    line = np.round(rng.uniform(180, 240, 50))
    fair = X.fair_line(line, rng.uniform(1.5, 2.6, 50), rng.uniform(1.5, 2.6, 50), 15.7, True)
    assert np.isfinite(fair).all() and (abs(fair - line) < 15).all()


def test_localize_strict(spark):
    df = spark.createDataFrame([("2024-01-10 20:00:00",), ("2024-03-31 02:30:00",), ("2024-10-27 02:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    got = [r[0] for r in df.select(X.localize_strict(F.col("t"), "Europe/Madrid")).collect()]
    assert got == [dt.datetime(2024, 1, 10, 19, 0), None, None]


def test_sides_names_ids_json(spark):
    df = spark.createDataFrame([("Over", "José O'Neil Jr.", "00123", '[{"feature":"a","value":1,"contribution":0.1},{"feature":"b","value":2,"contribution":-0.5}]', "Out"), ("u", "Luka (#7) Dončić", "22.0", "nonsense", "Probable"), (None, None, None, None, None)], "s string, n string, i string, j string, st string")
    got = df.select(X.normalize_side(F.col("s")), X.canonical_name(F.col("n")), X.canonical_id(F.col("i"), 5), F.get(X.parse_contributions(F.col("j")), 0)["feature"], X.is_unavailable(F.col("st"))).collect()
    assert tuple(got[0]) == ("over", "jose oneil", "00123", "b", True)
    assert tuple(got[1]) == ("under", "luka doncic", "00022", None, False)
    assert got[2][4] is False


def test_season_csv_and_partitioned_writes(spark, tmp_path):
    for season in ("2022-23", "2023-24"):
        (tmp_path / "root" / season / "jan").mkdir(parents=True)
        (tmp_path / "root" / season / "jan" / "a.csv").write_text(f"id,x,y\n1,2.5,{season}\n2,bad,z\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.StringType())])
    df = readers.read_season_csv(spark, f"{tmp_path}/root", schema, columns=["id", "x"])
    assert rows(df, "id", "x", "season") == [(1, 2.5, "2022-23"), (1, 2.5, "2023-24"), (2, None, "2022-23"), (2, None, "2023-24")]
    out = f"{tmp_path}/table"
    writers.write_partitioned(df, out, ["season"])
    writers.write_partitioned(df.where("season = '2023-24' and id = 1"), out, ["season"])
    assert spark.read.parquet(out).count() == 3
    writers.backup_table(df, f"{tmp_path}/b", "t", "2024-01-01", "season")
    writers.backup_table(df, f"{tmp_path}/b", "t", "2024-02-01")
    assert writers.list_backups(spark, f"{tmp_path}/b") == ["2024-02-01", "2024-01-01"]
    assert spark.read.parquet(writers.write_run_snapshot(df, f"{tmp_path}/s", "r1", "features")).count() == 4


def test_pregame_scan(spark):
    t = spark.createDataFrame([(2023, 1, 1, True, -30, 447), (2023, 1, 2, True, -3, 449), (2023, 1, 1, False, 5, 451), (2022, 1, 1, True, -9, 400)], "season_year int, market_id int, book_id int, is_pregame boolean, mins_to_tip int, left_line int")
    m = spark.createDataFrame([(1, "total")], "market_id int, market string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "book_id int, book string")
    assert rows(readers.read_pregame_ticks(t, m, b, [2023], ["total"]), "book", "left_line", "minutes_before_tip") == [("x", 223.5, 30)]


def test_home_repair_and_gates(spark):
    df = spark.createDataFrame([(1, True, "AAA @ BBB", "AAA"), (1, True, "BBB vs. AAA", "BBB"), (2, True, "C vs. D", "C"), (2, False, "D @ C", "D")], "g int, home boolean, m string, team string")
    assert rows(filters.repair_home_flag(df, "g", "home", "m", "team"), "g", "team", "home") == [(1, "AAA", False), (1, "BBB", True), (2, "C", True), (2, "D", False)]
    wide = spark.createDataFrame([(1, 2, 3, 4)], "ID int, PTS int, PTS_BEFORE int, odds_x int")
    assert filters.select_point_in_time(wide, static=("ID",)).columns == ["ID", "PTS_BEFORE", "odds_x"]
    with pytest.raises(ValueError):
        filters.select_point_in_time(wide, static=("ID", "PTS"), banned=("PTS",))
    with pytest.raises(ValueError):
        audits.assert_no_columns(wide, ["^PTS$"])
    with pytest.raises(ValueError):
        audits.assert_no_leak(wide, ["pts"])


def test_prune_columns(spark):
    df = spark.range(200).select("id", (F.col("id") * 2.0).alias("a"), F.col("id").cast("double").alias("c"), F.lit(1).alias("k"), F.when(F.col("id") < 10, 1.0).alias("n"), F.lit("x").alias("t"), F.rand(3).alias("r"), (-F.col("id")).alias("neg"))
    kept, why = filters.prune_columns(df, keep=("id",))
    assert why["k"] == "constant" and why["n"] == "null" and why["t"] == "text" and why["neg"].startswith(("twin", "same")) and "r" in kept.columns and "id" in kept.columns
    assert "a" in why or "c" in why


def test_pair_sides_fails_on_a_repeated_side(spark):
    df = spark.createDataFrame([(1, True, 5), (1, True, 6), (1, False, 7)], "g int, home boolean, x int")
    with pytest.raises(joins.NotUnique):
        joins.pair_sides(df, ["g"], "home")


def test_scheduled_rows_and_strictness(spark):
    hist = spark.createDataFrame([(1, 10.0, "a")], "g int, pts double, t string")
    got = joins.append_scheduled(hist, spark.createDataFrame([(2, "b")], "g int, t string"), strict=0)
    assert rows(got, "g", "pts") == [(1, 10.0), (2, None)]
    with pytest.raises(ValueError):
        joins.append_scheduled(hist, spark.createDataFrame([(2, None)], "g int, t string"), strict=0)


def test_roster_follows_trades_and_listings(spark):
    p = spark.createDataFrame([(1, "p1", "A", day(0)), (1, "p1", "B", day(5)), (1, "p2", "A", day(1)), (1, "p3", "A", day(1))], "season int, player_id string, team_id string, game_date date")
    g = spark.createDataFrame([(1, "g1", "A", day(4)), (1, "g2", "A", day(9)), (1, "g2", "B", day(9))], "season int, game_id string, team_id string, game_date date")
    inj = spark.createDataFrame([("g2", "B", "p3")], "game_id string, team_id string, player_id string")
    got = rows(joins.roster_asof(p, g, inj), "game_id", "team_id", "player_id")
    assert got == [("g1", "A", "p1"), ("g1", "A", "p2"), ("g1", "A", "p3"), ("g2", "A", "p2"), ("g2", "B", "p1"), ("g2", "B", "p3")]


def test_names_resolve_by_rule_then_recency(spark):
    idx = spark.createDataFrame([("1", "Nikola Jokić", "N. Jokic", day(1)), ("2", "Ming Yao", "Yao Ming", day(1)), ("3", "Gary Payton", "G. Payton", day(1)), ("4", "Gary Payton II", "GP2", day(9))], "player_id string, full_name string, display_name string, last_date date")
    got, errors = joins.resolve_names(spark.createDataFrame([("Nikola Jokic",), ("Yao Ming",), ("Gary Payton",), ("Nobody Here",)], "name string"), idx)
    assert rows(got, "name", "player_id") == [("Gary Payton", "4"), ("Nikola Jokic", "1"), ("Nobody Here", None), ("Yao Ming", "2")]
    assert rows(errors, "name") == [("Nobody Here",)]


def test_unavailable_players(spark):
    rep = spark.createDataFrame([("A", day(1), "José Ray", "Out"), ("A", day(1), "Bo Li", "Probable")], "team_id string, game_date date, player_name string, status string")
    pl = spark.createDataFrame([("A", "9", "Jose Ray", day(0)), ("A", "8", "Bo Li", day(0))], "team_id string, player_id string, player_name string, game_date date")
    g = spark.createDataFrame([("g", "A", day(1))], "game_id string, team_id string, game_date date")
    assert rows(joins.listed_unavailable(rep, pl, g), "game_id", "player_id") == [("g", "9")]
    inj = spark.createDataFrame([("g", "A", "1")], "game_id string, team_id string, player_id string")
    box = spark.createDataFrame([("g", "A", "2", "DNP - Injury"), ("g", "A", "3", "DNP - coach"), ("g", "A", "1", "injry")], "game_id string, team_id string, player_id string, comment string")
    assert rows(joins.unavailable(inj, box), "player_id") == [("1",), ("2",)]


def test_availability_and_votes(spark):
    box = [("p%d" % i, "g%d" % n, "T", day(n), 30.0 - i, 20.0 - i) for i in range(8) for n in range(4)]
    pl = spark.createDataFrame(box, "player_id string, game_id string, team_id string, game_date date, minutes double, pts double")
    ros = pl.where("game_id = 'g3'").select("game_id", "team_id", "player_id", "game_date")
    out = spark.createDataFrame([("g3", "T", "p0")], "game_id string, team_id string, player_id string")
    r = players.player_availability_features(pl, ros, out, "pts").first()
    assert r["available_pts_v_top_1"] == 19.0 and r["unavailable_pts_player_id_top_1"] == "p0" and r["available_pts_n"] == 7 and r["unavailable_pts_n"] == 1
    votes = spark.createDataFrame([(2024, "p0", 60, 1.0), (2024, "p1", 30, 2.0), (2024, "x", 10, 3.0), (2024, "p0", 50, 0.5)], "season_year int, player_id string, fan_votes int, score double")
    v = players.vote_share(ros.withColumn("game_date", F.lit(day(90))), votes, out).first()
    assert v["vote_share"] == pytest.approx(0.9) and v["vote_share_out"] == pytest.approx(0.6) and v["n_voted"] == 2


def test_effect_of_an_absence(spark):
    g = [("T", f"g{i}", day(i), 2023, 110.0 if i % 2 else 100.0, 100.0) for i in range(6)]
    games = spark.createDataFrame(g, "team_id string, game_id string, game_date date, season_year int, v double, e double")
    absent = spark.createDataFrame([("g0", "T", "p"), ("g2", "T", "p"), ("g2", "T", "p"), ("g4", "T", "p")], "game_id string, team_id string, player_id string")
    r = players.availability_effect(games, spark.createDataFrame([("g5", "T", "p")], absent.schema), absent, "v", "e", k=2).first()
    assert (r["n_with"], r["n_without"]) == (2, 3) and r["effect"] == pytest.approx(10 * 2 / 4)


def test_jetlag_and_groups(spark):
    df = spark.createDataFrame([("T", "g1", day(0), "America/New_York"), ("T", "g2", day(2), "America/Los_Angeles"), ("T", "g3", day(9), "America/New_York")], "t string, g string, d date, z string")
    assert rows(windows.jetlag_hours(df, "t", "d", ["d", "g"], "z"), "g", "jetlag_hours") == [("g1", 0.0), ("g2", -3.0), ("g3", 0.0)]
    pair = spark.createDataFrame([("A", "B"), ("A", "Z")], "a string, b string")
    assert rows(windows.same_group_flags(pair, "a", "b", {"conf": {"A": "E", "B": "E"}}), "b", "same_conf") == [("B", 1), ("Z", 0)]


def test_normalize_lines(spark):
    df = spark.createDataFrame([(209.5, 209.5, 1.62, 2.20), (209.5, 209.5, 1.91, 1.95), (209.5, 209.5, 1.8, 1.8)], "total_b_line_over double, total_b_line_under double, total_b_price_over double, total_b_price_under double")
    got = [tuple(r) for r in market.normalize_lines(df).collect()]
    assert got[0] == (212.5, 212.5, 1.91, 1.91) and got[1] == (209.5, 209.5, 1.91, 1.95) and got[2] == (209.5, 209.5, 1.8, 1.8)


def test_folds_are_greedy_and_do_not_overlap(spark):
    df = spark.range(100).select("id", F.date_add(F.lit(day(0)), (F.col("id") / 5).cast("int")).alias("d"))
    f = splits.walk_forward_folds(df, "d", "id", splits.FoldSpec(folds=3, test_rows=12, train_rows=20, min_train=20))
    v = splits.validate_folds(f, "id").collect()
    assert len(v) == 3 and all(r.valid and r.n_train == 20 and r.n_test == 15 and r.n_overlap == 0 for r in v)


def test_walk_forward_learner_sees_the_past_only(spark):
    df = spark.range(60).select("id", F.date_add(F.lit(day(0)), (F.col("id") / 3).cast("int")).alias("d"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    got = splits.walk_forward_score(df, "d", "id", splits.ridge(["x"], "y", 1e-9), 4, 30).join(df, "id").collect()
    assert len(got) == 12 and all(r.prediction == pytest.approx(r.y, abs=1e-3) for r in got)


def test_bets_at_the_default_price_break_even(spark):
    df = spark.createDataFrame([(1.0, 2.0 if i < 11 else 0.0, 1.0) for i in range(21)], "e double, a double, l double")
    r = scoring.score_bets(df, "e", "a", "l").first()
    assert r.roi == pytest.approx(0.0, abs=1e-9) and r.wins == 11 and r.break_even == pytest.approx(11 / 21)


def test_leak_probe_finds_a_leak(spark):
    df = spark.range(20).select("id", F.lit("k").alias("k"), F.col("id").cast("double").alias("y"))
    safe = lambda d: windows.rolling_mean(d, ["y"], 3, ["k"], ["id"])
    leaky = lambda d: d.withColumn("f", F.col("y") + 1)
    assert audits.leak_probe(safe, df, "y", "id = 19").count() == 0
    assert audits.leak_probe(leaky, df, "y", "id = 19").count() == 2


def test_diagnose_and_preflight(spark):
    g = spark.createDataFrame([("a", True, dt.datetime(2024, 1, 1, 20)), ("a", False, dt.datetime(2024, 1, 1, 20)), ("b", True, dt.datetime(2024, 1, 1, 20)), ("b", True, dt.datetime(2024, 1, 1, 20))], "g string, home boolean, s timestamp")
    plan = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 23)), ("b", dt.datetime(2024, 1, 1, 20))], "g string, s timestamp")
    assert rows(audits.diagnose(g, plan, "g", "home", "s"), "g", "problems") == [("a", ["start"]), ("b", ["sides"])]
    df = spark.range(40).select(F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("d"), F.when(F.col("id") > 9, 1).alias("x"))
    assert rows(audits.preflight(df, "d", {"s": splits.FoldSpec(2, 5, 10, 5)}, ["x"]), "spec", "folds_possible", "rows_complete") == [("s", 2, 0.75)]


def test_experiment_tables(spark, tmp_path):
    runs = spark.createDataFrame([("a", '{"m": {"depth": 3, "lr": 0.1}, "n": "x"}'), ("b", '{"m": {"depth": 4}}')], "run_id string, config string")
    assert rows(experiments.design_matrix(runs).select("run_id", F.col("`m.depth`").alias("depth"), "n"), "run_id", "depth", "n") == [("a", "3", "x"), ("b", "4", None)]
    for r, x in (("r1", 0.1), ("r2", -0.2)):
        (tmp_path / r).mkdir()
        (tmp_path / r / "metrics.json").write_text('{"roi": %s}' % x)
    s = experiments.run_summaries(spark, str(tmp_path), "roi double")
    assert rows(s, "run_id", "roi") == [("r1", 0.1), ("r2", -0.2)]
    assert rows(experiments.cv_vs_holdout(s, s), "run_id", "gap") == [("r1", 0.0), ("r2", 0.0)]


def test_meta_frame_and_summaries(spark):
    base = spark.createDataFrame([("g1", 2022, 200.0, 201.0), ("g2", 2023, 210.0, 205.0), ("g3", 2023, 190.0, 195.0)], "game_id string, season int, actual double, line double")
    p = spark.createDataFrame([("g2", 211.0), ("g3", 199.0), ("g1", 0.0)], "game_id string, prediction double")
    m = scoring.build_meta_frame(base, {"a": p, "b": p}, ["game_id"], "season", 1)
    assert rows(m, "game_id", "pred_a", "pred_b") == [("g2", 211.0, 211.0), ("g3", 199.0, 199.0)]
    h = scoring.holdout_summary(m.withColumn("seed", F.lit(1)), "pred_a", "actual", "line").first()
    assert h.mae == pytest.approx(5.0) and h.wins == 1 and h.losses == 1
    f = scoring.prepare_frame(base.withColumn("game_id", F.concat(F.lit("002"), "game_id")), "season", 2023, "game_id", {"002": "Regular"}, ["Regular"], "actual", "line", [])
    assert rows(f, "game_id", "is_over", "line_error") == [("002g2", 1, 5.0), ("002g3", 0, -5.0)]


def team_rows(spark):
    data = []
    for g in range(12):
        for home in (True, False):
            t = "AB"[(g + home) % 2]
            data.append((f"g{g:02d}", day(2 * g), t, home, 100.0 + g + home, 90.0 + g))
    return spark.createDataFrame(data, "game_id string, game_date date, team_id string, home boolean, PTS double, POSS double")


def test_game_frame_is_leakage_safe(spark):
    t = team_rows(spark)
    f = frames.base_game_features(t, ["PTS", "POSS"], "PTS")
    assert f.count() == 12 and "TOTAL" in f.columns and not [c for c in f.columns if c.startswith(("PTS_TEAM", "POSS_TEAM"))]
    build = lambda d: frames.base_game_features(d, ["PTS", "POSS"], "PTS")
    changed = build(t.withColumn("PTS", F.when(F.col("game_id") == "g11", 999.0).otherwise(F.col("PTS"))))
    assert f.drop("TOTAL").exceptAll(changed.drop("TOTAL")).count() == 0


def test_scheduled_games_receive_history(spark):
    t = team_rows(spark)
    sched = spark.createDataFrame([("s1", day(40), "A", True), ("s1", day(40), "B", False)], "game_id string, game_date date, team_id string, home boolean")
    f = frames.build_feature_frame(t, sched, ["PTS", "POSS"], "PTS")
    s = f.where("game_id = 's1'").first()
    assert s["PTS_last_5_BEFORE_TEAM_HOME"] is not None and s["TOTAL"] is None


def ticks_df(spark):
    data = [("g", "total", "x", dt.datetime(2024, 1, 1, 10, 5 * i), i, float(l)) for i, l in enumerate([200, 201, 201, 200, 202, 202, 203])]
    return spark.createDataFrame(data, "game_id string, market string, book string, line_ts timestamp, tick_id int, level double")


def test_stream_state_matches_the_batch(spark, tmp_path):
    df = ticks_df(spark)
    for i in (0, 3, 6):
        df.where(f"tick_id between {i} and {i + 2}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    q = streaming.stream_path_state(src).writeStream.outputMode("update").format("memory").queryName("state").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("state").orderBy(F.col("n_ticks").desc()).first()
    batch = asof.path_aggregates(df.withColumn("minutes_before_tip", F.lit(100.0)), "level", (30,)).first()
    assert (last.level, last.first, last.n_ticks, last.n_moves, last.n_reversals) == (batch.level, batch.opener, batch.n_ticks, batch.n_moves, batch.n_reversals)


def test_stream_pregame_and_repeats(spark, tmp_path):
    df = ticks_df(spark)
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    games = spark.createDataFrame([("g", dt.datetime(2024, 1, 1, 10, 20))], "game_id string, tipoff_utc timestamp")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    for _ in range(2):  # a second run finds nothing new
        streaming.stream_ticks(streaming.stream_pregame(src, games), f"{tmp_path}/sink", f"{tmp_path}/c2").awaitTermination()
    assert sorted(r.tick_id for r in spark.read.parquet(f"{tmp_path}/sink").collect()) == [0, 1, 2, 3]


def test_topk_pads_and_counts(spark):
    df = spark.createDataFrame([("g", "a", 5.0, 20.0), ("g", "b", 9.0, 3.0), ("g", "c", 0.0, 30.0)], "g string, p string, v double, m double")
    r = topk.topk_by_group(df, ["g"], "v", 4, "m >= 15", tie="p", carry=("p",)).first()
    assert (r.p_top_1, r.p_top_2, r.p_top_3, r.p_top_4) == ("a", "c", "b", None) and r.v_sum == 14.0 and r.v_mean == 7.0


def test_raw_quotes_become_ticks(spark):
    from pastframe.plans.tick_transform import transform_ticks

    raw = spark.createDataFrame(
        [(day(9), 2023, 1, "Home", "Away", "bk", "total", "opener", dt.datetime(2024, 1, 10, 20), 224.5, -110.0, 224.5, -110.0), (day(9), 2023, 2, "HOME", "Away", "bk", "total", "move", dt.datetime(2024, 1, 10, 20), 225.5, -110.0, 225.5, -110.0),
         (day(9), 2023, 3, "Home", "Away", "bk", "spread", "move", dt.datetime(2024, 1, 10, 21), -3.0, None, 105.0, None), (day(9), 2023, 4, "X", "Away", "bk", "total", "move", dt.datetime(2024, 1, 10, 20), 1.0, 1.0, 1.0, 1.0), (day(90), 2023, 5, "Home", "Away", "bk", "total", "move", dt.datetime(2024, 3, 31, 2, 30), 1.0, 1.0, 1.0, 1.0)],
        "game_date date, season_year int, event_id long, team_home string, team_away string, bookmaker_slug string, market string, row_kind string, timestamp timestamp, left_line double, left_price double, right_line double, right_price double",
    )
    games = spark.createDataFrame([("g", day(9), "Home", "Away")], "game_id string, game_date date, team_home string, team_away string")
    plan = spark.createDataFrame([("g", dt.datetime(2024, 1, 11, 0))], "game_id string, tipoff_utc timestamp")
    books, markets = spark.createDataFrame([(7, "bk")], "book_id int, bookmaker_slug string"), spark.createDataFrame([(1, "total"), (2, "spread")], "market_id int, market string")
    t, dim, lost = transform_ticks(raw, games, plan, books, markets, {"HOME": "Home"})
    got = {r.market_id: r for r in t.collect()}
    assert got[1].line_ts == dt.datetime(2024, 1, 10, 19) and got[1].left_line == 451 and got[1].mins_to_tip == -300 and got[1].is_pregame
    assert got[2].left_line is None and got[2].left_price == -3.0 and got[2].right_price == 105.0
    assert dim.count() == 1 and rows(lost, "reason", "rows") == [("kept", 3), ("no game", 1), ("no time", 1)]


def test_names_are_folded_as_unicode_decomposes_them(spark):
    blocks = [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]
    names = [f"Ab{chr(c)}cd X{chr(c)}" for c in blocks] + ["e\u0301a\u0323b", "V J Edgecombe", "Mo Mo", "Ken Griffey Jr. III", "Jr.", "x Sr (#3)", "", "O'Neal-Smith  v"]

    def plain(n):
        n = n.translate(str.maketrans(X.WRITTEN_OUT)).replace("(#3)", " ")
        n = "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c))
        t = re.sub(r"[^a-z0-9]+", " ", n.lower().replace(".", "").replace("'", "")).split()
        while t and t[-1] in X.SUFFIXES:
            t.pop()
        return " ".join(t), " ".join(sorted(t))

    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: (r[1], r[2]) for r in df.select("n", X.canonical_name(F.col("n")), X.canonical_name(F.col("n"), sort_tokens=True)).collect()}
    bad = {n: (got[n], plain(n)) for n in names if got[n] != plain(n)}
    assert not bad
