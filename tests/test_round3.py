"""Large tables: ties, plans without a shuffle of the result, averages that don't look back."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pastframe.operators import experiments, joins, players, scoring, windows
from pastframe.queries import history, people
from pastframe.queries import scoring as scoring_queries

KEY = ["game_id", "team_id", "player_id"]


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan()


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_k5_runs_of_equal_values_tie(spark, tmp_path):
    v = [(0, 0.3), (0, 0.2), (0, 0.1), (1, 0.1), (1, 0.2), (1, 0.3)]  # doubles add up to more in the second order
    o = spark.createDataFrame([(i, k, x, dt.datetime(2024, 1, 1), "F", "1") for i, (k, x) in enumerate(v)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderstatus string, o_orderpriority string")
    o.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = history.QUERIES["k5_leaderboard"][0](spark, str(tmp_path)).collect()
    assert sorted((r.rank, r.run_id) for r in got) == [(1, "0"), (2, "1")]


def test_m1_reads_the_configs_once(spark):
    runs = spark.createDataFrame([("a", '{"a": {"b": {"c": {"d": {"e": 5}}}}, "n": null, "none": {}, "bad": "{x"}'), ("b", '{"n": "7"}'), ("c", "{")], "run_id string, config string")
    got = experiments.design_matrix(runs, factors=["a.b.c.d.e", "n", "none"])
    assert rows(got, ["run_id", "`a.b.c.d.e`", "n"]) == [("a", "5", None), ("b", None, "7")]
    assert plan(got).collectLeaves().size() == 1


def test_e26_ranks_without_a_window_over_a_run(spark):
    d = pd.DataFrame({"run": ["x"] * 9 + ["y"] * 4, "s": [1.0, 2, 2, 3, 3, 3, 4, 5, 5, 1, 1, 2, 3], "y": [0, 1, 0, 1, 0, 1, 1, 1, 1, 1, 0, 0, 1]})
    got, t = scoring.confidence_trend(spark.createDataFrame(d), "s", "y", "run")
    d["n"] = d.groupby("run").s.transform("size")
    d["bucket"] = (d.groupby("run").s.rank() / d.n * 5).astype(int).clip(upper=4)
    want = d.groupby(["run", "bucket"]).agg(n=("y", "size"), w=("y", "mean"), m=("s", "mean")).reset_index()
    assert rows(got, ["run", "bucket", "n", "win_rate", "mean_score"]) == [(r[0], r[1], r[2], pytest.approx(r[3]), pytest.approx(r[4])) for r in want.itertuples(index=False)]
    rho = {k: g.s.rank().corr(g.y.rank()) for k, g in d.groupby("run")}
    assert {r.run: r.rho for r in t.collect()} == pytest.approx(rho)
    assert "windowspecdefinition(run" not in plan(got).toString()


def test_j18_result_is_not_shuffled_for_repeats(spark):
    rep = spark.createDataFrame([("A", day(1), "José Ray", "Out"), ("A", day(1), "Jose Ray", "Out"), ("A", day(2), "Jose Ray", "Out")], "team_id string, game_date date, player_name string, status string")
    pl = spark.createDataFrame([("A", "9", "Jose Ray", day(0))], "team_id string, player_id string, player_name string, game_date date")
    g = spark.createDataFrame([("g", "A", day(1)), ("g", "A", day(1)), ("h", "A", day(1)), ("h", "A", day(2))], "game_id string, team_id string, game_date date")  # g twice, h on two days
    got = joins.listed_unavailable(rep, pl, g)
    assert rows(got, KEY) == [("g", "A", "9"), ("h", "A", "9")]
    assert plan(got).nodeName() == "Union"


def test_j12_members_are_not_shuffled(spark):
    p = spark.createDataFrame([(1, "p1", "A", day(0)), (1, "p1", "A", day(3)), (1, "p1", "B", day(5)), (1, "p2", "A", day(1)), (2, "p2", "B", day(1))], "season int, player_id string, team_id string, game_date date")
    g = spark.createDataFrame([(1, "g0", "A", day(0)), (1, "g1", "A", day(4)), (1, "g1", "A", day(4)), (1, "g2", "A", day(5)), (1, "g3", "A", day(6)), (1, "g3", "A", day(4))], "season int, game_id string, team_id string, game_date date")
    inj = spark.createDataFrame([("g1", "A", "p2"), ("g1", "A", "p2"), ("g2", "Z", "p2"), ("g9", "A", "x")], "game_id string, team_id string, player_id string")
    got = joins.roster_asof(p, g, inj)
    assert rows(got, KEY) == [("g1", "A", "p1"), ("g1", "A", "p2"), ("g2", "A", "p1"), ("g2", "Z", "p2"), ("g3", "A", "p1"), ("g3", "A", "p2"), ("g9", "A", "x")]
    assert plan(got).nodeName() == "Union"


def test_j12_runs_of_games_meet_spans(spark, monkeypatch):
    """A player's games of a run come one after the other, which files keep in little room."""
    monkeypatch.setattr(joins, "GAMES_OF_RUN", 50, raising=False)
    rng = random.Random(12)
    per = list({(p, d): (1, p, rng.choice("AB"), day(d)) for p, d in ((rng.randrange(20), rng.randrange(60)) for _ in range(200))}.values())
    games = [(1, i, rng.choice("AB"), day(rng.randrange(60))) for i in range(300)]
    inj = [(i, rng.choice("AB"), rng.randrange(20)) for i in range(0, 300, 9)]
    want = set(inj)
    for _, i, t, d in games:
        for p in range(20):
            if any(q == p and u == t for _, q, u, _ in per) and max(((e, u) for _, q, u, e in per if q == p and e < d), default=("", ""))[1] == t and not any(i == j and q == p for j, _, q in inj):
                want.add((i, t, p))
    make = spark.createDataFrame
    got = joins.roster_asof(make(per, "season int, player_id int, team_id string, game_date date"), make(games, "season int, game_id int, team_id string, game_date date"), make(inj, "game_id int, team_id string, player_id int"))
    assert rows(got, KEY) == sorted(want)
    found = [r.player_id for r in got.coalesce(1).collect()]
    assert sum(a != b for a, b in zip(found, found[1:], strict=False)) < len(found) / 4


def test_w12_is_the_recursion_over_all_earlier_rows(spark):
    n, r = 1500, math.exp(-math.log(2) / 10)
    x = {k: [1e300 if i == 0 else None if i % 7 == k else float(i % 5 + k) for i in range(n)] for k in (1, 2)}
    df = spark.createDataFrame([(k, i, v, v and -v, f"t{i}") for k, vs in x.items() for i, v in enumerate(vs)], "k int, i int, v double, u double, t string")
    got = windows.ewm_recursive(df.repartition(7), ["v", "u"], ["k"], ["i"], 10)
    want = []
    for k, vs in x.items():
        m = None
        for i, v in enumerate(vs):
            want.append((k, i, 0.0 if m is None else m, 0.0 if m is None else -m, f"t{i}"))
            if v is not None:
                m = v if m is None else m * (1 - (1 - r)) + v * (1 - r)
    assert rows(got, ["k", "i", "v_ewm_BEFORE", "u_ewm_BEFORE", "t"]) == want
    assert "collect_list" not in plan(got).toString()


def test_m7_models_meet_in_blocks(spark):
    imp = [(f"m{m}", f"f{(m * m + 3 * f) % 17}", float((m * 7 + f * 5) % 11)) for m in range(23) for f in range(6)] + [("none", None, 1.0)]
    top = {}
    for m in {m for m, _, _ in imp}:
        best = sorted(((-x, f or "") for n, f, x in imp if n == m))[:4]
        top[m] = {f for _, f in best if f}
    want = sorted((a, b, len(top[a] & top[b]) / max(len(top[a] | top[b]), 1)) for a in top for b in top if a < b)
    df = spark.createDataFrame(imp, "model string, feature string, importance double")
    for block in (5, 1000):
        got = experiments.topk_overlap(df, 4, block=block)
        assert rows(got, ["model_a", "model_b", "jaccard"]) == [(a, b, pytest.approx(x)) for a, b, x in want]
    assert "array_intersect" not in plan(got).toString()


def test_m7_models_go_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """However many models there are; blocks grow instead, and are gone through in tiles."""
    monkeypatch.setattr(experiments, "OVERLAP_TILE", 4, raising=False)
    df = spark.range(60 * 5).selectExpr("id % 60 as model", "(id * id) % 13 as feature", "id % 7 + 0.5 as importance")
    for block, most, blocks in ((1, 3, 3), (7, 24, 9), (1, 24, 24), (100, 24, 1)):
        got = experiments.topk_overlap(df, 3, block=block, most=most)
        told = [r for r in got.collect()]
        assert len({(r.model_a, r.model_b) for r in told}) == len(told) == 60 * 59 / 2 and all(r.model_a < r.model_b for r in told)
        assert f"explode(sequence(0, {blocks - 1}" in got._jdf.queryExecution().analyzed().toString()  # what a model is sent to
    top = {m: {r.feature for r in df.where(f"model = {m}").orderBy(F.desc("importance"), "feature").limit(3).collect()} for m in (3, 44)}
    want = len(top[3] & top[44]) / len(top[3] | top[44])
    assert [r.jaccard for r in told if (r.model_a, r.model_b) == (3, 44)] == [pytest.approx(want)]


def test_p4_a_player_s_steps_don_t_meet_all_his_teams(spark):
    from pastframe.operators import players

    p = spark.createDataFrame([(2024, "g0", day(446), "A", "x", 40.0, False), (2025, "g1", day(666), "B", "x", 30.0, False), (2024, "g0", day(446), "A", "y", 20.0, False)], "season_year int, game_id string, game_date date, team_id string, player_id string, minutes double, scheduled boolean")
    g = spark.createDataFrame([(2025, "g1", "A", day(666)), (2025, "g2", "A", day(667)), (2025, "g2", "B", day(667))], "season_year int, game_id string, team_id string, game_date date")
    got = players.roster_windows(p, g, spark.createDataFrame([], "season_year int, game_date date, team_id string, player_id string"))
    by = {(r.game_id, r.team_id): r for r in got.collect()}
    assert by["g1", "A"].continuity == 1.0 and by["g2", "A"].continuity == pytest.approx(1 / 3)
    assert by["g2", "B"].incoming is None and by["g2", "B"].incoming_2m == pytest.approx(40 / 240)
    text = plan(got).toString()
    assert "collect_list" not in text and "(player_id#" not in "".join(x for x in text.splitlines() if "Join" in x)


def test_p4_window_steps_are_the_days_on_which_a_window_changes(spark):
    days = spark.range(366 * 2).select(F.date_add(F.lit(day(-400)), F.col("id").cast("int")).alias("day"))
    at = days.select("day", F.explode(F.sequence(F.lit(1), F.lit(420))).alias("n")).select("day", F.date_add("day", F.col("n")).alias("at"), (F.col("n") == 1).alias("next"))
    now, was = players.in_near_window(F.col("at"), F.col("day")), F.col("next") | players.in_near_window(F.date_sub("at", 1), F.col("day"))
    told = days.select("day", F.array_sort(F.array_compact(F.array(*players.window_steps(F.col("day"), players.near_window_end(F.col("day")))))).alias("steps"))
    flips = at.where(now != was).groupBy("day").agg(F.array_sort(F.collect_list("at")).alias("flips"))
    got = told.join(flips, "day").collect()
    assert len(got) == 366 * 2 and all([s for s in r.steps if s > r.day] == r.flips for r in got)


def test_p4_rows_are_shared_by_the_tasks_asked_for(spark):
    """And a player's row, however often another overtakes it, is met by no join."""
    rng = random.Random(4)
    p = spark.createDataFrame([(2024, f"g{i}", day(300 + i // 3), rng.choice("AB"), rng.choice("xyz"), float(rng.randrange(40)), False) for i in range(300)], "season_year int, game_id string, game_date date, team_id string, player_id string, minutes double, scheduled boolean")
    g = p.select("season_year", "game_id", "team_id", "game_date")
    hurt = p.where("minutes < 3").select("season_year", "game_date", "team_id", "player_id")
    one, many = (players.roster_windows(p, g, hurt, n) for n in (None, 23))
    assert rows(one, one.columns) == rows(many, many.columns) and one.count() == 300
    tree = plan(many).toString()
    assert tree.count("RepartitionByExpression") == 1 and ", 23" in tree and "decimal(30" not in tree


def test_p4_generated_code_is_small_enough_to_be_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes for good."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = people.QUERIES["p4_roster_windows"][0](spark, "/root/testdata/sf0.001")
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_b0_roster_rows_are_in_as_many_tasks_as_the_line_items_ask_for(spark, monkeypatch):
    from pastframe.queries import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 100)  # of some 6,000
    text = plan(people.QUERIES["b0_team_frame"][0](spark, "/root/testdata/sf0.001")).toString()
    assert any("RepartitionByExpression [s#" in x and ", 60" in x for x in text.splitlines())


def test_p5_candidates_by_stretches_of_days(spark):
    """Against the four sources told day by day; rosters as moves and as members of games."""
    rng = random.Random(5)
    when = lambda: dt.date(2022, 1, 1) + dt.timedelta(rng.randrange(900))
    games = [(f"g{i}", rng.choice("ABC"), when()) for i in range(150)]
    played = [(rng.randrange(8), *rng.choice(games)[1:], f"g{rng.randrange(200)}") for _ in range(60)]
    votes = [(y, p, rng.choice(["A", "B", None]), rng.randrange(1, 90), float(rng.randrange(50))) for y in (2021, 2022, 2023, 2024) for p in range(10) if rng.random() < 0.8]
    hurt = [(g, t, rng.randrange(9)) for g, t, _ in games if rng.random() < 0.3]
    moves = list({(p, d): (p, rng.choice(["A", "B", "C", None]), d) for p, d in ((rng.randrange(9), when()) for _ in range(40))}.values())

    def at(p, d):  # the roster that the last move up to the day tells
        return max(((x, t or "") for q, t, x in moves if q == p and x <= d), default=(None, None))[1]

    v = {(y, p): x for y, p, *x in votes}
    want = {}
    for g, t, d in games:
        year, found = d.year - (d.month < 3), []
        for p in range(10):
            if (year, p) in v:
                listed, out = v[year, p][0] == t, (g, t, p) in hurt
                rows = [(x, n.zfill(20), m) for q, m, x, n in played if q == p and x <= d]
                of = {m for h, m, q in hurt if q == p and any(i == h and x == d for i, _, x in games)} or ({max(rows)[2]} if rows else None)
                there = listed or any(x == d and m == t for x, _, m in rows) or at(p, d) == t
                if out or (there and t in of if of is not None else listed):
                    found.append((v[year, p][1], v[year, p][2], out))
        want[g] = (sum(x[0] for x in found), len(found), min((x[1] for x in found), default=None), min((x[1] for x in found if x[2]), default=None))
    make = spark.createDataFrame
    args = make(games, "game_id string, team_id string, game_date date"), make(played, "player_id int, team_id string, game_date date, game_id string"), make(votes, "season_year int, player_id int, team_id string, fan_votes long, score double"), make(hurt, "game_id string, team_id string, player_id int")
    rosters = make([(g, t, p) for g, t, d in games for p in range(10) if at(p, d) == t], "game_id string, team_id string, player_id int")
    for told in ({"moves": make(moves, "player_id int, team_id string, game_date date")}, {"rosters": rosters}):
        got = players.vote_features(*args, **told)
        assert {r.game_id: (r.votes, r.n_candidates, r.min_score, r.min_score_out) for r in got.collect()} == want


def test_p5_query_meets_no_roster_with_its_games(spark):
    p = plan(people.QUERIES["p5_vote_features"][0](spark, "/root/testdata/sf0.001")).toString()
    assert "__until" not in p  # the spans that games meet, as in J12


def test_p3_slots_are_shared_by_the_tasks_asked_for(spark):
    """Slots and absences meet the games once, and nothing is joined by player again."""
    games = spark.createDataFrame([("T", f"g{i}", day(i // 2), 2020 + i % 2, float(i * i % 7), 1.0) for i in range(12)], "team_id string, game_id string, game_date date, season_year int, v double, e double")
    slots = spark.createDataFrame([(f"g{i}", "T", p) for i in range(12) for p in "pq"] * 2, "game_id string, team_id string, player_id string")
    out = slots.where("game_id in ('g0', 'g1', 'g4', 'g5', 'g8') and player_id = 'p'")
    one, many = (players.availability_effect(games, slots, out, "v", "e", parts=n) for n in (None, 23))
    assert rows(one, one.columns) == rows(many, many.columns) and one.count() == 24
    tree = many._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(team_id" in tree and ", 23)" in tree and "player_id" not in "".join(x for x in tree.split("\n") if "SortMergeJoin" in x or "HashJoin" in x)


def test_p2_bench_rows_are_shared_by_the_tasks_asked_for(spark):
    per = spark.createDataFrame([(f"g{i}", "T", p, day(i), 8.0 + i + 3 * j, float(i * j), 1.0 + j) for i in range(9) for j, p in enumerate("pqr")], "game_id string, team_id string, player_id string, game_date date, minutes double, pts double, pace double")
    ros, out = per.select("game_id", "team_id", "player_id", "game_date"), per.where("game_id = 'g4' and player_id = 'p'").select("game_id", "team_id", "player_id")
    one, many = (players.bench_features(per, ros, out, "pts", "pace", n) for n in (None, 23))
    assert rows(one, one.columns) == rows(many, many.columns) and {r.game_id: r.n_bench for r in many.collect()}["g4"] == 2
    tree = plan(many).toString()
    assert tree.count("RepartitionByExpression") == 6 and tree.count(", 23") >= 6


def test_m7_sums_and_windows_share_a_shuffle(spark):
    got = scoring_queries.QUERIES["m7_importance_stability"][0](spark, "/root/testdata/sf0.001")
    assert got.count() > 0
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert tree.count("hashpartitioning(") == 2 and tree.count("REPARTITION_BY_NUM") == 2


def test_st3_a_game_is_one_state(spark, tmp_path):
    """The books of a game share a state and a call; late ticks, and keys that are no longer kept, are told for each of them."""
    from pastframe.streaming import ticks as streaming

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [
        [("g", "t", "x", at(10, 1), 1, 5.0), ("g", "t", "x", at(10, 0), 2, 4.0), ("g", "t", "y", at(10, 0), 3, 1.0), ("g", None, "y", at(10, 0), 4, 1.0)],
        [("g", "t", "x", at(9, 59), 5, 9.0), ("g", "t", "x", at(10, 2), 6, 4.0), ("g", "t", "y", at(12, 0), 7, 2.0)],
        [("g", "t", "y", at(12, 5), 8, 2.0)],
        [("g", "t", "x", at(12, 6), 9, 7.0)],
    ]
    schema = "game_id string, market string, book string, line_ts timestamp, tick_id int, level double"
    for expire, want in ((None, (7.0, 4.0, 4, 3, 2, 1)), ("10 minutes", (7.0, 7.0, 1, 0, 0, 0))):
        src, done = f"{tmp_path}/{expire}", []
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)

            def keep(batch, n):
                done.extend(batch.collect())

            stream = streaming.stream_path_state(spark.readStream.schema(schema).parquet(src), expire=expire)
            q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{src}-log").trigger(availableNow=True).start()
            q.awaitTermination()
            if i == 0:
                assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == 1
        x = [r for r in done if r.book == "x"]
        assert (x[-1].level, x[-1].first, x[-1].n_ticks, x[-1].n_moves, x[-1].n_reversals, x[-1].n_late) == want
        assert (x[1].n_ticks, x[1].n_late, x[1].last_ts) == (3, 1, at(10, 2))
        assert [(r.n_ticks, r.n_moves) for r in done if r.book == "y" and r.market] == [(1, 0), (2, 1), (3, 1)]
