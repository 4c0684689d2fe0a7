"""Queries over quotes, times, guards and frames that SQL tells by other means."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastframe.functions import scalar as X
from pastframe.operators import audits, experiments, market, windows
from pastframe.plans import frames
from pastframe.plans.tick_transform import transform_ticks
from pastframe.queries.history import _sides
from pastframe.queries.tables import ITEMS, ORDERS, entry, items, orders, table
from pastframe.sources import readers


def _phi(z: str) -> str:
    """The normal distribution function by its power series, for values within 4 of zero."""
    return f"(0.5 + {z} * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda n: exp(2 * n * ln(greatest(abs({z}), 1e-300)) + n * ln(2.0) + lgamma(n + 1) - lgamma(2 * n + 2)))))"


def _fair(source: str, line: str, left: str, right: str, sigma: float, above: bool = True) -> str:
    """CTEs that end in fair(l, a, b, f): the line at which both sides are even, by bisection, for the distinct quotes of a source."""
    return f"""quote AS (SELECT DISTINCT {line} AS l, {left} AS a, {right} AS b FROM {source}),
    want AS (SELECT *, {'1 / a' if above else '1 / b'} / (1 / a + 1 / b) AS p, CASE WHEN floor(l) = l THEN 0.5 ELSE 0 END AS h FROM quote),
    half(l, a, b, p, h, lo, hi, k) AS (SELECT l, a, b, p, h, l - 2.0 * {sigma}, l + 2.0 * {sigma}, 0 FROM want UNION ALL
      SELECT l, a, b, p, h, CASE WHEN u / (u + w) < p THEN m ELSE lo END, CASE WHEN u / (u + w) < p THEN hi ELSE m END, k + 1
      FROM (SELECT *, 1 - {_phi('y')} AS u, {_phi('z')} AS w FROM (SELECT *, (lo + hi) / 2 AS m, (l + h - (lo + hi) / 2) / {sigma} AS y, (l - h - (lo + hi) / 2) / {sigma} AS z FROM half WHERE k < 45))),
    fair AS (SELECT l, a, b, (lo + hi) / 2 AS f FROM half WHERE k = 45)"""


def _quoted(s, d):
    """Line items as quotes: a line by the quantity, whole or half by the number in the order, prices by discount and tax."""
    return items(s, d).select("g", "n", "p", "q", (F.col("q") + 200 + (F.col("n") % 2) / 2).alias("l"), (1.5 + F.col("disc") * 4).alias("a"), (1.6 + F.col("tax") * 4).alias("b"))


_QUOTED = f"{ITEMS}, t AS (SELECT g, n, p, q, q + 200 + (n % 2) / 2.0 AS l, 1.5 + disc * 4 AS a, 1.6 + tax * 4 AS b FROM i)"


def _odds(s, d):
    """One row per order with the quotes of two books and a spread."""
    g = items(s, d).groupBy("g").agg((F.max("q") + 180).alias("la"), (F.min("q") + 185).alias("lb"), (F.max("disc") + 1.8).alias("po"), (F.max("tax") + 1.85).alias("pu"), F.max(F.when(F.col("n") == 1, F.col("q") - 25)).alias("sp"))
    cols = {f"total_{b}_{c}": F.col(v) for b, x in (("a", "la"), ("b", "lb")) for c, v in (("line_over", x), ("line_under", x), ("price_over", "po"), ("price_under", "pu"))}
    return g.select("g", *[v.alias(k) for k, v in cols.items()], F.col("sp").alias("spread_a_line_home"))


_O5 = f"""WITH RECURSIVE {ITEMS}, t AS (SELECT g, max(q) + 180 AS la, min(q) + 185 AS lb, round(max(disc) + 1.8, 2) AS po, round(max(tax) + 1.85, 2) AS pu FROM i GROUP BY g),
    both_ AS (SELECT la AS x, po, pu FROM t UNION SELECT lb, po, pu FROM t), {_fair('both_', 'x', 'po', 'pu', X.SIGMA_TOTAL)}, r AS (SELECT l, a, b, floor(f / 0.5 + 0.5) * 0.5 AS f FROM fair),
    m AS (SELECT *, po <> pu AND po <> 1.91 AND pu <> 1.91 AS move FROM t)
    SELECT g, {{r:CASE WHEN move THEN x.f ELSE la END}} AS total_a_line_over, {{r:CASE WHEN move THEN 1.91 ELSE po END}} AS total_a_price_over, {{r:CASE WHEN move THEN y.f ELSE lb END}} AS total_b_line_over, {{r:CASE WHEN move THEN 1.91 ELSE po END}} AS total_b_price_over
    FROM m JOIN r x ON x.l = la AND x.a = po AND x.b = pu JOIN r y ON y.l = lb AND y.a = po AND y.b = pu"""


def _shifted(s, d):
    """Events spread over a year and a day of local times, so that some fall where the clock is changed."""
    e = table(s, d, "events")
    return e.withColumn("ts", (F.col("ts").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 366).cast("int"))))


#: The same, with UTC by the rule of the European Union: the last Sundays of March and October.
_MADRID = """t AS (SELECT *, ts + to_days(CAST(event_id % 366 AS INTEGER)) AS l FROM events),
    c AS (SELECT *, make_date(CAST(year(l) AS INTEGER), 3, 31) - CAST(dayofweek(make_date(CAST(year(l) AS INTEGER), 3, 31)) AS INTEGER) AS s, make_date(CAST(year(l) AS INTEGER), 10, 31) - CAST(dayofweek(make_date(CAST(year(l) AS INTEGER), 10, 31)) AS INTEGER) AS w FROM t),
    z AS (SELECT * EXCLUDE (s, w), CASE WHEN l >= s + INTERVAL 2 HOURS AND l < s + INTERVAL 3 HOURS THEN NULL WHEN l >= w + INTERVAL 2 HOURS AND l < w + INTERVAL 3 HOURS THEN NULL
      WHEN l >= s + INTERVAL 3 HOURS AND l < w + INTERVAL 2 HOURS THEN l - INTERVAL 2 HOURS ELSE l - INTERVAL 1 HOUR END AS utc FROM c)"""


def _f10(s, d):
    """Every event as a quote by local time: four books of which one is unknown, three markets of which one is, games of four users in five."""
    e = _shifted(s, d)
    day, away = F.to_date("ts"), F.col("event_type")
    book = F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string"))
    kind = F.when(F.col("event_id") % 3 == 0, "total").when(F.col("event_id") % 3 == 1, "spread").otherwise("moneyline")
    slip = F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(-F.col("value"))
    raw = e.select(day.alias("game_date"), F.lit(2024).alias("season_year"), "event_id", F.col("user_id").cast("string").alias("team_home"), away.alias("team_away"), book.alias("bookmaker_slug"), kind.alias("market"), F.when(F.col("event_id") % 5 == 0, "opener").otherwise("move").alias("row_kind"), F.col("ts").alias("timestamp"), F.col("value").alias("left_line"), F.lit(-110.0).alias("left_price"), slip.alias("right_line"), F.lit(-110.0).alias("right_price"))
    games = e.where("user_id % 5 <> 0").groupBy(day.alias("game_date"), F.col("user_id").cast("string").alias("team_home"), away.alias("team_away")).agg(F.min("event_id").cast("string").alias("game_id"))
    plan = games.select("game_id", (F.col("game_date").cast("timestamp") + F.expr("interval 20 hours")).alias("tipoff_utc"))
    books = e.where("event_id % 4 < 3").select((F.col("event_id") % 4).cast("int").alias("book_id")).distinct().withColumn("bookmaker_slug", F.concat(F.lit("b"), F.col("book_id").cast("string")))
    markets = e.where("event_id % 3 < 2").select((F.col("event_id") % 3 + 1).cast("int").alias("market_id")).distinct().withColumn("market", F.when(F.col("market_id") == 1, "total").otherwise("spread"))
    return transform_ticks(raw, games, plan, books, markets)


_F10 = f"""{_MADRID}, f AS (SELECT CAST(l AS DATE) AS day, user_id, event_type, CAST(min(event_id) AS VARCHAR) AS game_id FROM t WHERE user_id % 5 <> 0 GROUP BY ALL),
    why AS (SELECT z.*, f.game_id, CAST(l AS DATE) + INTERVAL 20 HOURS AS tip, CASE WHEN utc IS NULL THEN 'no time' WHEN z.user_id % 5 = 0 THEN 'no game' WHEN event_id % 4 = 3 THEN 'no book' WHEN event_id % 3 = 2 THEN 'no market' ELSE 'kept' END AS reason
      FROM z LEFT JOIN f ON f.day = CAST(l AS DATE) AND f.user_id = z.user_id AND f.event_type = z.event_type)"""
_TICKS = f"""WITH {_F10}, k AS (SELECT *, epoch_us(utc) - epoch_us(tip) AS us, event_id % 3 = 1 AS spread, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE -value END AS rl FROM why WHERE reason = 'kept'),
    b AS (SELECT *, spread AND value <> -rl AS slipped FROM k),
    y AS (SELECT *, CASE WHEN NOT slipped THEN value END AS ll, CASE WHEN NOT slipped THEN rl END AS rr, CASE WHEN spread THEN -30 ELSE 150 END AS lo, CASE WHEN spread THEN 30 ELSE 300 END AS hi FROM b)
    SELECT game_id, CAST(event_id % 3 + 1 AS INTEGER) AS market_id, CAST(event_id % 4 AS INTEGER) AS book_id, epoch_us(utc) AS at, {{r:us / 6e7}} AS mins_to_tip, us < 0 AS is_pregame, event_id % 5 = 0 AS is_opener,
      CAST(CASE WHEN us >= 0 OR ll BETWEEN lo AND hi THEN round(ll * 2) END AS SMALLINT) AS left_line, {{r:CASE WHEN slipped THEN value ELSE -110 END}} AS left_price,
      CAST(CASE WHEN us >= 0 OR rr BETWEEN lo AND hi THEN round(rr * 2) END AS SMALLINT) AS right_line, {{r:CASE WHEN slipped THEN rl ELSE -110 END}} AS right_price FROM y"""


def _refused(check) -> bool:
    """Whether a guard refuses a frame."""
    try:
        check()
    except ValueError:
        return True
    return False


def _guarded(s, d, guard, bad: str):
    """Rolling features that a guard lets pass, and whether it refuses the same frame with a column by another name."""
    x = windows.rolling_mean(orders(s, d), ["v"], 3, ["k"], ["d", "id"]).select("id", F.col("v_last_3_BEFORE").alias("x_BEFORE"))
    guard(x)
    return x.withColumn("refused", F.lit(_refused(lambda: guard(x.withColumnRenamed("x_BEFORE", bad)))))


_GUARDED = f"WITH {ORDERS} SELECT id, {{r:avg(v) OVER (PARTITION BY k ORDER BY d, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)}} AS x_BEFORE, TRUE AS refused FROM o"


def _q4(s, d):
    """A build whose features know the target of their own row, and one whose features don't."""
    build = lambda x: windows.rolling_mean(x, ["v"], 3, ["k"], ["d", "id"]).select("id", "v", "v_last_3_BEFORE")
    late = "d >= '2001-01-01'"
    frame = orders(s, d).select("id", "k", "d", "v")
    probe = lambda f, name: audits.leak_probe(f, frame, "v", late).agg(F.count_distinct("id").alias("rows")).withColumn("build", F.lit(name))
    before = lambda x: build(x.withColumn("v", F.when(F.col("d") < "2001-01-01", F.col("v"))).select("id", "k", "d", "v"))
    return probe(lambda x: build(x).withColumn("w", F.col("v") * 2).drop("v_last_3_BEFORE"), "leaks").unionByName(probe(before, "clean"))


def _s14(s, d):
    """The fingerprint of the orders, dealt and ordered anew, with one value changed, and with a row repeated."""
    o = orders(s, d).drop("d")
    prints = {"same": o.repartition(7).select(*sorted(o.columns, reverse=True)), "changed": o.withColumn("v", F.when(F.col("id") == 1, F.col("v") + 1).otherwise(F.col("v"))), "repeated": o.unionByName(o.where("id = 1"))}
    base = readers.dataset_fingerprint(o)
    out = base.select("rows", F.struct("xor", "total", "rows").alias("p"))
    for name, x in prints.items():
        out = out.crossJoin(readers.dataset_fingerprint(x).select(F.struct("xor", "total", "rows").alias(name)))  # one row each
    return out.select("rows", *[(F.col(n) == F.col("p")).alias(n) for n in prints])


def _configs(s, d):
    """Events as runs whose configuration is nested."""
    return table(s, d, "events").select(F.col("event_id").alias("run_id"), F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("by")).alias("model"), F.get_json_object("props", "$.k").alias("k"))).alias("config"))


def _log(s, d):
    """Team rows: two lines of an order as its sides, suppliers as teams."""
    x = _sides(s, d).select(F.col("g").cast("string").alias("game_id"), F.col("d").alias("game_date"), F.concat_ws("-", F.col("s").cast("string"), F.col("n").cast("string")).alias("team_id"), "home", F.col("q").alias("PTS"), F.col("price").alias("POSS"))
    return x.join(x.groupBy("game_id").agg(F.min("game_date").alias("gd")), "game_id").drop("game_date").withColumnRenamed("gd", "game_date")


def _b1(s, d):
    """Every fiftieth game is scheduled 3000 days later."""
    x = _log(s, d)
    late = F.col("game_id").cast("long") % 50 == 0
    f = frames.build_feature_frame(x.where(~late), x.where(late).drop("PTS", "POSS").withColumn("game_date", F.date_add("game_date", 3000)), ["PTS", "POSS"], "PTS")
    sides = [(m, w, h) for m in ("PTS", "POSS") for w in ("last_5", "last_10", "season_mean") for h in ("HOME", "AWAY")]
    return f.select("game_id", "TOTAL", *[F.col(f"{m}_{w}_BEFORE_TEAM_{h}").alias(f"{m}_{w}_{h}") for m, w, h in sides], *[F.col(f"rest_days_BEFORE_TEAM_{h}").cast("int").alias(f"rest_{h}") for h in ("HOME", "AWAY")])


_FRAME = {"last_5": "PARTITION BY team ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING", "last_10": "PARTITION BY team ORDER BY d, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING", "season_mean": "PARTITION BY team, season ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"}
_B1 = f"""WITH {ITEMS}, u AS (SELECT DISTINCT ON (g, n) * FROM i WHERE n <= 2 ORDER BY g, n, p, s, q, price), y AS (SELECT g, n, s || '-' || n AS team, q, price, g % 50 = 0 AS late, CAST(min(d) OVER (PARTITION BY g) + CAST(min(n) OVER (PARTITION BY g) AS INTEGER) AS DATE) AS d0 FROM u),
    t AS (SELECT CAST(g AS VARCHAR) AS id, n, team, CAST(d0 + CASE WHEN late THEN 3000 ELSE 0 END AS DATE) AS d, CASE WHEN NOT late THEN q END AS PTS, CASE WHEN NOT late THEN price END AS POSS FROM y),
    z AS (SELECT *, year(d) - (month(d) < 8)::INT AS season FROM t),
    w AS (SELECT id, n, PTS AS own, count(*) OVER (PARTITION BY id) AS c, {', '.join(f"avg({m}) OVER ({f}) AS {m}_{k}" for m in ('PTS', 'POSS') for k, f in _FRAME.items())}, coalesce(d - lag(d) OVER (PARTITION BY team, season ORDER BY d, id), 7) AS rest FROM z)
    SELECT id AS game_id, {{r:CASE WHEN count(own) = 2 THEN sum(own) END}} AS TOTAL, {', '.join(f"{{r:max({m}_{k}) FILTER (n = {j})}} AS {m}_{k}_{h}" for m in ('PTS', 'POSS') for k in _FRAME for j, h in ((1, 'HOME'), (2, 'AWAY')))}, CAST(max(rest) FILTER (n = 1) AS INTEGER) AS rest_HOME, CAST(max(rest) FILTER (n = 2) AS INTEGER) AS rest_AWAY
    FROM w WHERE c = 2 GROUP BY id"""

QUERIES = {
    "x4_center_line": entry(
        lambda s, d: _quoted(s, d).select("g", "n", "p", "q", X.center_line(F.col("l"), F.col("a"), F.col("b")).alias("x")),
        f"WITH RECURSIVE {_QUOTED}, {_fair('t', 'l', 'a', 'b', X.SIGMA_TOTAL)} SELECT g, n, p, {{r:q}} AS q, {{r:f}} AS x FROM t JOIN fair USING (l, a, b)",
    ),
    "v3_fair_margins": entry(
        lambda s, d: _quoted(s, d).select("g", "n", "p", "q", X.center_line(F.col("l") - 225, F.col("a"), F.col("b"), X.SIGMA_MARGIN, left_above=False).alias("x")),
        f"WITH RECURSIVE {_QUOTED.replace('q + 200 +', 'q - 25 +')}, {_fair('t', 'l', 'a', 'b', X.SIGMA_MARGIN, above=False)} SELECT g, n, p, {{r:q}} AS q, {{r:f}} AS x FROM t JOIN fair USING (l, a, b)",
    ),
    "x9_localize_strict": entry(
        lambda s, d: _shifted(s, d).select("event_id", F.unix_micros(X.localize_strict(F.col("ts"), "Europe/Madrid")).alias("utc")),
        f"WITH {_MADRID} SELECT event_id, epoch_us(utc) AS utc FROM z",
    ),
    "x11_encode_line": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", X.encode_line(F.col("q") / 2 - 12).alias("code"), X.decode_line(X.encode_line(F.col("q") / 2 - 12)).alias("back")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, CAST(q - 24 AS SMALLINT) AS code, {{r:(q - 24) / 2}} AS back FROM i",
    ),
    "o5_normalize_lines": entry(lambda s, d: market.normalize_lines(_odds(s, d)).select("g", "total_a_line_over", "total_a_price_over", "total_b_line_over", "total_b_price_over"), _O5),
    "f10_transform_ticks": entry(
        lambda s, d: _f10(s, d)[0].select("game_id", "market_id", "book_id", F.unix_micros("line_ts").alias("at"), "mins_to_tip", "is_pregame", "is_opener", "left_line", "left_price", "right_line", "right_price"),
        _TICKS,
    ),
    "f10_transform_losses": entry(lambda s, d: _f10(s, d)[2], f"WITH {_F10} SELECT reason, count(*) AS rows FROM why GROUP BY reason"),
    # until 1995 summer time ended in September in Spain; in the USA it began on the first Sunday of April until 2006
    "w24_jetlag_hours": entry(
        lambda s, d: windows.jetlag_hours(orders(s, d).withColumn("z", F.when(F.col("id") % 2 == 0, "America/New_York").otherwise("Europe/Madrid")), "k", "d", ["d", "id"], "z", 90).select("id", "jetlag_hours"),
        f"""WITH {ORDERS}, y AS (SELECT *, CAST(year(d) AS INTEGER) AS y, CASE WHEN id % 2 = 0 THEN 'N' ELSE 'M' END AS z FROM o), b AS (SELECT *, make_date(y, 3, 31) - CAST(dayofweek(make_date(y, 3, 31)) AS INTEGER) AS e0, make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INTEGER) AS e1,
          make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INTEGER) AS u0 FROM y),
        f AS (SELECT *, CASE WHEN d >= e0 AND d < CASE WHEN y = 1995 THEN DATE '1995-09-24' ELSE e1 END THEN 2 ELSE 1 END - CASE WHEN d >= u0 AND d < e1 THEN -4 ELSE -5 END AS gap, lag(z) OVER w AS was, d - lag(d) OVER w AS days FROM b WINDOW w AS (PARTITION BY k ORDER BY d, id))
        SELECT id, {{r:CASE WHEN days <= 90 AND was <> z THEN CASE WHEN z = 'M' THEN gap ELSE -gap END ELSE 0 END}} AS jetlag_hours FROM f""",
    ),
    "s14_dataset_fingerprint": entry(_s14, "SELECT count(*) AS rows, TRUE AS same, FALSE AS changed, FALSE AS repeated FROM orders"),
    "m1_design_matrix": entry(
        lambda s, d: experiments.design_matrix(_configs(s, d)).toDF("run_id", "k", "model_by_user", "model_kind"),
        "SELECT event_id AS run_id, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS model_by_user, event_type AS model_kind FROM events",
    ),
    "q1_assert_no_columns": entry(lambda s, d: _guarded(s, d, lambda x: audits.assert_no_columns(x, [r"^closing", "_CLOSE_"]), "closing_x"), _GUARDED),
    "q3_assert_no_leak": entry(lambda s, d: _guarded(s, d, lambda x: audits.assert_no_leak(x, ["PTS", "WL"]), "pts"), _GUARDED),
    "q4_leak_probe": entry(_q4, f"WITH {ORDERS} SELECT 'leaks' AS build, count(*) AS rows FROM o WHERE d >= DATE '2001-01-01' UNION ALL SELECT 'clean', 0"),
    "b1_build_feature_frame": entry(_b1, _B1),
}
