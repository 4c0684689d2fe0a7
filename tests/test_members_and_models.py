"""Roster windows, memberships from several sources, streaks and benches, models from sums of products, and smaller helpers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pastframe.functions import scalar
from pastframe.operators import audits, filters, joins, players, splits, windows
from pastframe.sources import ordered

DAY = dt.date.fromisoformat
PLAYERS = "season_year int, game_id string, game_date date, team_id string, player_id string, minutes double, scheduled boolean"
GAMES = "season_year int, game_id string, game_date date, team_id string"
LISTED = "season_year int, game_date date, team_id string, player_id string"


def rosters(spark, games, rows, listed=()):
    """{(date, team): row} of roster_windows. rows: (season, date, team, player, minutes[, scheduled])."""
    g = spark.createDataFrame([(s, f"{d}{t}", DAY(d), t) for s, d, t in games], GAMES)
    p = spark.createDataFrame([(s, f"g{d}", DAY(d), t, who, m, bool(more and more[0])) for s, d, t, who, m, *more in rows], PLAYERS)
    out = players.roster_windows(p, g, spark.createDataFrame([(s, DAY(d), t, who) for s, d, t, who in listed], LISTED)).collect()
    return {r.game_id: r for r in out}


def test_players_to_come_and_listed_ones_are_members_before_the_game(spark):
    day, last = "2025-10-22", "2025-03-20"
    rows = [(2024, last, "A", who, m) for who, m in (("stays", 40.0), ("leaves", 110.0), ("hurt", 20.0), ("sits", 70.0))] + [(2024, last, "B", "b", 20.0)]
    got = rosters(spark, [(2025, day, "A"), (2025, day, "B")], [*rows, (2025, day, "B", "leaves", None, True)], [(2025, day, "A", "hurt")])
    a, b = got[f"{day}A"], got[f"{day}B"]
    assert a.continuity == a.continuity_2m == pytest.approx(1 - 110 / 240) and a.net == a.net_2m == pytest.approx(-110 / 240)
    assert b.incoming == b.incoming_2m == pytest.approx(110 / 240) and b.net == pytest.approx(110 / 240)
    got = rosters(spark, [(2025, day, "A")], [*rows, (2025, day, "B", "leaves", None, False)])  # not known before the game
    assert got[f"{day}A"].continuity == 1.0


def test_candidates_weigh_their_minutes_for_the_team_by_its_game_days(spark):
    day = "2025-10-22"
    rows = [(2024, "2025-03-20", "A", "first", 120.0), (2024, "2025-03-20", "A", "stable", 40.0), (2024, "2025-04-20", "A", "second", 120.0), (2024, "2025-04-20", "A", "stable", 40.0), (2025, "2025-10-01", "B", "first", 30.0), (2025, "2025-10-02", "C", "second", 30.0)]
    assert rosters(spark, [(2025, day, "A")], rows)[f"{day}A"].continuity == pytest.approx(0.25)
    day = "2025-11-01"
    rows = [(2024, "2025-04-01", "A", "leaves", 50.0), (2024, "2025-04-01", "A", "stable", 40.0), (2025, "2025-10-20", "A", "leaves", 20.0), (2025, "2025-10-20", "A", "stable", 40.0), (2025, "2025-10-25", "B", "leaves", 30.0), (2025, day, "B", "leaves", 99.0)]
    assert rosters(spark, [(2025, day, "A")], rows)[f"{day}A"].continuity == pytest.approx(40 / 60)  # this season's minutes, without the game's own


def test_the_near_window_moves_with_the_date(spark):
    day = "2026-05-15"
    rows = [(2024, "2025-04-01", "A", "old", 30.0), (2025, "2026-02-01", "B", "old", 30.0), (2025, "2026-04-01", "A", "stable", 20.0)]
    got = rosters(spark, [(2025, day, "A")], rows)[f"{day}A"]
    assert got.continuity == pytest.approx(0.4) and got.continuity_2m == 1.0
    rows = [(2025, "2026-04-01", "A", "recent", 30.0), (2025, "2026-04-01", "A", "stable", 30.0), (2025, "2026-04-20", "B", "recent", 30.0)]
    got = rosters(spark, [(2025, day, "A")], rows)[f"{day}A"]
    assert got.continuity is None and got.continuity_2m == pytest.approx(0.5)  # no baseline of the season before
    day = "2025-10-22"  # August would be summer: from March on
    rows = [(2024, "2025-03-05", "A", "moves", 40.0), (2024, "2025-03-05", "A", "stable", 40.0), (2025, "2025-10-01", "B", "moves", 20.0)]
    assert rosters(spark, [(2025, day, "A")], rows)[f"{day}A"].continuity_2m == pytest.approx(0.5)


def test_near_window_ends(spark):
    """near_window_end and in_near_window against the window itself, day by day."""
    days = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2024-12-31', interval 1 day)) AS a")
    both = days.withColumn("at", F.explode(F.expr("sequence(a, date_add(a, 270), interval 1 day)")))
    start = F.add_months("at", -2)
    start = F.when(F.month(start).between(6, 9), F.make_date(F.year(start), F.lit(3), F.lit(1))).otherwise(start)
    assert both.where(players.in_near_window(F.col("at"), F.col("a")) != (F.col("a") >= start)).count() == 0


def test_the_first_source_that_knows_is_heard(spark):
    row = "k int, d date, member string, tie string"
    day = lambda n: dt.date(2024, 1, n)
    on = spark.createDataFrame([(1, day(5), "hurt1", None), (1, day(5), "hurt2", None), (2, day(4), "no", None), (None, day(5), "x", None)], row)
    upto = spark.createDataFrame([(1, day(5), "late", "2"), (2, day(3), "b", "1"), (2, day(3), "c", "2"), (2, day(5), "today", "1"), (3, day(6), "after", "1")], row)
    before = spark.createDataFrame([(2, day(5), "z", None), (3, day(1), "first", None), (3, day(5), "same day", None)], row)
    probes = spark.createDataFrame([(k, day(5)) for k in (1, 2, 3, 4)], "k int, d date").withColumn("members", F.lit("old"))
    heard = lambda *sources: {r.k: r.out for r in joins.members_asof(probes, list(sources), ["k"], "d", out="out").collect()}
    assert heard((on, "on"), (upto, "upto"), (before, "before")) == {1: ["hurt1", "hurt2"], 2: ["today"], 3: ["first"], 4: None}
    assert heard((upto, "before"), (on, "on")) == {1: ["hurt1", "hurt2"], 2: ["c"], 3: None, 4: None}


def test_streaks_end_at_a_game_played_and_two_seasons_back(spark):
    games = spark.createDataFrame([(2020 + i // 4, f"g{i}", "T", dt.date(2020 + i // 4, 1, 1 + i % 4)) for i in range(12)], "season_year int, game_id string, team_id string, game_date date")
    away = [(f"g{i}", "T", "all") for i in range(12)] + [(f"g{i}", "T", "some") for i in (0, 1, 3, 4, 5)] * 2 + [("none", "T", "lost")]
    got = {(r.player_id, r.game_id): r.streak for r in players.absence_streaks(games, spark.createDataFrame(away, "game_id string, team_id string, player_id string")).collect()}
    assert [got["all", f"g{i}"] for i in range(12)] == [1, 2, 3, 4, 5, 6, 7, 8, 5, 6, 7, 8]
    assert {k[1]: v for k, v in got.items() if k[0] == "some"} == {"g0": 1, "g1": 2, "g3": 1, "g4": 2, "g5": 3} and ("lost", "none") not in got


def test_ridge_from_sums_equals_ridge_of_rows(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(10, 3, (n, 3))
    y = 50 + x @ [1.0, -2.0, 0.5] + rng.normal(0, 1, n)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(int(i // 7)), *[None if rng.random() < 0.1 else float(v) for v in x[i][:2]], None if i < 380 and i % 3 else float(x[i][2]), float(y[i]), float(rng.uniform(0.5, 2))) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, d date, a double, b double, c double, y double, w double").repartition(5)
    learner = splits.ridge(["a", "b", "c"], "y", 3.0, "w")
    plain = lambda train, test: learner(train, test)  # noqa: E731  the same, unknown to the solver
    for make in (lambda f: splits.walk_forward_score(df, "d", "id", f, 6, 150), lambda f: splits.score_folds(df, splits.walk_forward_folds(df, "d", "id", splits.FoldSpec(3, 40, 120, 60)), "id", f)):
        want, got = ({(r.fold, r.id): r.prediction for r in make(f).collect()} for f in (plain, learner))
        assert set(want) == set(got) and len(want) >= 30 and all(abs(want[k] - got[k]) < 1e-6 for k in want)
    grid = spark.createDataFrame([(0.5, "x"), (40.0, "y")], "alpha double, name string")
    folds = splits.walk_forward_folds(df, "d", "id", splits.FoldSpec(3, 40, 120, 60))
    fast = splits.grid_over_folds(df, folds, grid, "id", "y", lambda r: splits.ridge(["a", "b"], "y", r.alpha))
    slow = splits.grid_over_folds(df, folds, grid, "id", "y", lambda r: lambda tr, te: splits.ridge(["a", "b"], "y", r.alpha)(tr, te))
    assert sorted((r.alpha, r.name, r.folds, round(r.mean_mae, 6)) for r in fast.collect()) == sorted((r.alpha, r.name, r.folds, round(r.mean_mae, 6)) for r in slow.collect())
    plan = splits.walk_forward_score(df, "d", "id", learner, 6, 150)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("gram")[0] or "MapInPandas" in plan


def test_columns_of_repeated_rows_stay_apart(spark):
    df = spark.range(1000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    for k in (1, 2, 4):
        many = df.crossJoin(spark.range(k)).drop("id")
        assert filters.prune_columns(many)[1] == {}
        assert filters.prune_columns(many.withColumns({"twin": -F.col("b"), "same": F.col("a")}))[1] == {"twin": "twin of b", "same": "same as a"}


def test_medians_over_all_rows_by_days_and_bins(spark):
    rng = np.random.default_rng(1)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(int(rng.integers(60))), None if i % 11 == 0 else float(rng.choice([1.0, 2.0, rng.normal()]))) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, d date, v double")
    past = lambda d: [v for _, e, v in rows if v is not None and d - dt.timedelta(9) <= e < d]
    for func, want in (("median", np.median), ("mean", np.mean), ("std", lambda x: np.std(x, ddof=1)), ("count", len), ("max", max)):
        got = windows.rolling_days(df, "v", 9, "d", func).collect()
        for r in got:
            x, y = past(r.d), r[f"v_{func}_9d_BEFORE"]
            assert (y == len(x)) if func == "count" else (y is None) if len(x) < (2 if func == "std" else 1) else y == pytest.approx(want(x))
    days = df.select(F.to_date("d").alias("__day"), "v")
    assert sorted(map(tuple, windows.median_of_days(days, "v", 9, "m", bins=3).collect())) == sorted(map(tuple, windows.median_of_days(days, "v", 9, "m", bins=500).collect()))


def test_running_totals_over_a_whole_table(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 3).alias("n")).repartition(6)
    got = {r.k: r.before for r in ordered.running_total(df, [F.col("k").desc()], "before", F.col("n")).collect()}
    n = {r.k: r.n for r in df.collect()}
    assert got == {k: sum(v for j, v in n.items() if j > k) for k in n}


def test_helpers(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0), (3, None, None)], "id int, a double, b double")
    assert [r.id for r in filters.drop_rows_over(df, ["a", "b"], 1).orderBy("id").collect()] == [1, 2]
    seasons = spark.createDataFrame([(2019,), (2020,), (2021,)], "s int")
    assert sorted(r.s for r in filters.season_floor(seasons, "s", 2020).collect()) == [2020, 2021]
    times = spark.createDataFrame([("2024-01-02T20:00:00Z",), ("nonsense",), (None,)], "t string")
    assert [r.x is None for r in times.select(scalar.parse_utc(F.col("t")).alias("x")).collect()] == [False, True, True]
    audits.assert_frames_equal(df, df.orderBy(F.col("id").desc()), ["id"])
    with pytest.raises(Exception):  # noqa: B017
        audits.assert_frames_equal(df, df.withColumn("b", F.col("b") + 1), ["id"])


def test_latest_rows_are_merged_like_a_carry(spark, tmp_path):
    from pastframe.operators.topk import latest_per_key
    from pastframe.streaming import ticks as streaming

    rng = np.random.default_rng(2)
    src, sink = f"{tmp_path}/src", f"{tmp_path}/sink"
    read = lambda: spark.readStream.schema("k int, at int, v int").option("maxFilesPerTrigger", 1).parquet(src)
    for n in range(9):
        spark.createDataFrame([(int(k), int(rng.integers(1000)) * 10 + n, i) for i, k in enumerate(rng.integers(0, 30, 12))], "k int, at int, v int").dropDuplicates(["k", "at"]).coalesce(1).write.mode("append").parquet(src)
        if n in (6, 8):
            streaming.stream_latest(read(), sink, f"{tmp_path}/log", ["k"], "at").awaitTermination()
            assert [hi - lo + 1 for lo, hi in streaming.cover(streaming.runs(spark, sink))] == ([4, 2, 1] if n == 6 else [8, 1])
            want = latest_per_key(spark.read.parquet(src), ["k"], ["at"])
            assert {(r.k, r["at"]) for r in streaming.latest(spark, sink, ["k"], "at").collect()} == {(r.k, r["at"]) for r in want.collect()}
    assert len(streaming.runs(spark, sink)) <= 6 and streaming.latest(spark, f"{tmp_path}/none", ["k"], "at") is None


def test_the_composed_frame_knows_nothing_of_later_outcomes(spark):
    """B0 with all families of players, votes and officials, probed as a whole (Q4)."""
    from pastframe.plans import frames

    cutoff, rows = dt.date(2024, 1, 15), []
    for i in range(14):
        day = dt.date(2024, 1, 1) + dt.timedelta(2 * i)
        for k, (a, b) in enumerate((("A", "B"), ("C", "D")) if i % 2 else (("A", "C"), ("B", "D"))):
            rows += [(f"{i:02d}{k}", day, t, t == a, 2023, 90 + (7 * i + 3 * ord(t)) % 31, i % 3, 3 + (i + k) % 2) for t in (a, b)]
    df = spark.createDataFrame(rows, "game_id string, game_date date, team_id string, home boolean, season_year int, PTS int, r1 int, r2 int")

    def build(x):
        games = x.select("season_year", "game_id", "team_id", "game_date")
        each = x.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("player_id", F.concat("team_id", F.col("i").cast("string")))
        per = each.select(*games.columns, "player_id", (F.col("PTS") % 23 + F.col("i") * 4).cast("double").alias("minutes"), (F.col("PTS") / (F.col("i") + 2)).alias("pts"), (F.col("PTS") % 7).cast("double").alias("pace"), F.lit(False).alias("scheduled"))
        hurt = each.where("i = 1 and cast(game_id as int) % 3 = 0").select("game_id", "team_id", "player_id")
        votes = per.select(F.lit(2023).alias("season_year"), "player_id", "team_id").distinct().withColumns({"fan_votes": F.length("player_id").cast("long"), "score": F.lit(1.0)})
        votes = votes.unionByName(votes.withColumn("season_year", F.lit(2024)))
        families = frames.player_families(games, per, hurt, votes, "pts", "pace")
        crew = players.official_effects(x.groupBy("game_id", "season_year", "game_date", "r1", "r2").agg(F.sum("PTS").alias("v")), ["r1", "r2"], ["v"])
        return frames.base_game_features(x, ["PTS"], "PTS", families=families, by_game={"crew": crew}).where(F.col("game_date") <= F.lit(cutoff))

    frame = build(df)
    names = [c for c in frame.columns if "_BEFORE" in c]
    assert {c.split("_")[0] for c in names} >= {"PTS", "slots", "bench", "roster", "votes", "crew", "rest"} and frame.count() == 16
    assert audits.leak_probe(build, df, "PTS", f"game_date >= date'{cutoff}'", ("TOTAL",)).count() == 0


def test_correlations_added_up_by_a_tree(spark):
    """Forty tasks are added up in two levels; columns with nulls count the rows where both are there."""
    r = np.random.default_rng(5)
    v = r.normal(size=(2000, 4))
    v[:, 2] = v[:, 0] * 0.7 + v[:, 2]
    v[r.random((2000, 4)) < 0.1] = np.nan
    df = spark.createDataFrame(pd.DataFrame(v, columns=list("abcd"))).replace(float("nan"), None).repartition(40)
    got = {(x, y): c for x, y, c in filters.correlations(df, list("abcd"), tasks=40)}
    want = pd.DataFrame(v, columns=list("abcd")).corr()
    assert len(got) == 6
    assert all(abs(c - want.loc[x, y]) < 1e-9 for (x, y), c in got.items())


def test_spans_of_one_ranked_table(spark):
    """Spans that share blocks (15 and 75) and one that can't (2) against the plain weights over rows of earlier dates."""
    r = np.random.default_rng(6)
    days = np.sort(r.integers(0, 300, 6000))
    x = np.where(r.random(6000) < 0.1, np.nan, r.normal(size=6000))
    rows = pd.DataFrame({"id": np.arange(6000), "d": pd.to_datetime("2024-01-01") + pd.to_timedelta(days, "D"), "x": x})
    df = spark.createDataFrame(rows).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    spans = (2, 15, 75)
    ranked = windows.ranked_by_date(df, windows.ewm_reach(75), "d", ["d", "id"], ["x"])
    got = windows.ewm_of_ranked(ranked, "x", spans).toPandas().sort_values("__day")
    first = np.searchsorted(days, np.unique(days))
    assert len(got) == len(first)
    for s in spans:
        e = rows["x"].ewm(span=s)
        for name, all_ in ((f"x_ewm_{s}_BEFORE", e.mean()), (f"x_ewstd_{s}_BEFORE", e.std())):
            want = np.array([all_[i - 1] if i else np.nan for i in first])
            np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-6, atol=1e-9)
