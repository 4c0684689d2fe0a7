"""Queries over sources (S), filters (F), joins (J), aggregates (A), sets (U) and scalar functions (X)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastframe.functions import scalar as X
from pastframe.operators import aggregates, filters, joins, sets
from pastframe.queries.tables import ITEMS, ORDERS, TICKS, entry, items, orders, table, ticks
from pastframe.sources import readers, writers

_DOCS = "doc_id, lang, source, n_chars"


def _labels(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(s, d, "labels"), "doc_id", "left")


def _legs(s, d):
    e = table(s, d, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type", "value")
    return {n: e.where(F.col("event_type") == n).groupBy("day", "user_id").agg(F.sum("value").alias(n)) for n in ("click", "view", "purchase")}


#: Names and what they are written as: accents, letters written out, a suffix that isn't at the end, a token that repeats.
_NAMES = {"José": "jose", "Kristaps Porziņģis": "kristaps porzingis", "Dāvis Bertāns": "davis bertans", "Alperen Şengün": "alperen sengun", "Nikola Đurišić": "nikola djurisic", "V J": "v j", "Mo Mo": "mo mo", "Shai Gilgeous-Alexander": "shai gilgeous alexander", "D'Angelo": "dangelo"}

QUERIES = {
    "s2_align_daily_legs": entry(
        lambda s, d: readers.align_daily_legs(_legs(s, d), ["day", "user_id"], "day")[0],
        """WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type, sum(value) AS v FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL),
        ok AS (SELECT day FROM e GROUP BY day HAVING count(DISTINCT event_type) = 3)
        SELECT day, user_id, {r:max(CASE WHEN event_type = 'click' THEN v END)} AS click, {r:max(CASE WHEN event_type = 'view' THEN v END)} AS view, {r:max(CASE WHEN event_type = 'purchase' THEN v END)} AS purchase
        FROM e WHERE day IN (SELECT day FROM ok) GROUP BY day, user_id""",
    ),
    "s2_leg_audit": entry(
        lambda s, d: readers.align_daily_legs(_legs(s, d), ["day", "user_id"], "day")[1].select("day", F.array_join("legs", ",").alias("legs"), "rows", "complete"),
        """WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase'))
        SELECT day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS legs, count(*) AS rows, count(DISTINCT event_type) = 3 AS complete FROM e GROUP BY day""",
    ),
    "s3_scan_seasons": entry(
        lambda s, d: readers.scan_seasons(s, orders(s, d), [1995, 1996], [1, 2, 3, 7], "season", "id").select("id", "season", "v"),
        f"WITH {ORDERS} SELECT id, season, {{r:v}} AS v FROM o WHERE season IN (1995, 1996) OR id IN (1, 2, 3, 7)",
    ),
    "s3_scan_seasons_by_frame": entry(
        lambda s, d: readers.scan_seasons(s, orders(s, d), [1995], items(s, d).where("q >= 49").select(F.col("g").alias("id")), "season", "id").select("id", "season"),
        f"WITH {ORDERS} SELECT id, season FROM o WHERE season = 1995 OR id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
    ),
    "s5_flatten_event_json": entry(
        lambda s, d: _props(s, d),
        "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n, array_to_string(list_sort(json_keys(props)), ',') AS ks FROM events",
    ),
    "s6_source_presence": entry(
        lambda s, d: readers.source_presence(table(s, d, "events"), "user_id", "event_type"),
        "SELECT event_type AS source, count(DISTINCT user_id) AS events, {r:count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events)::DOUBLE} AS share FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    ),
    "s8_append_new": entry(
        lambda s, d: writers.append_new(orders(s, d).where("season < 1996"), orders(s, d).where("season >= 1995"), ["id"], ["d"]).select("id", "v"),
        f"WITH {ORDERS} SELECT id, {{r:v}} AS v FROM o WHERE season >= 1995 AND id NOT IN (SELECT id FROM o WHERE season < 1996)",
    ),
    "s9_upsert": entry(
        lambda s, d: writers.upsert(orders(s, d).where("status = 'F'").select("k", "d", "id", "v"), orders(s, d).where("status = 'O'").select("k", "d", "id", "v"), ["k"], ["d", "id"]),
        f"""WITH {ORDERS}, n AS (SELECT k, d, id, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, id DESC) AS r FROM o WHERE status = 'O') WHERE r = 1)
        SELECT k, d, id, {{r:v}} AS v FROM (SELECT k, d, id, v FROM o WHERE status = 'F' AND k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n)""",
    ),
    "s11_assign_surrogate_ids": entry(
        lambda s, d: writers.assign_surrogate_ids(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_name").alias("name")), orders(s, d).select(F.col("prio").alias("name")), "name", "i"),
        f"""WITH {ORDERS}, f AS (SELECT DISTINCT prio AS name FROM o WHERE prio NOT IN (SELECT n_name FROM nation))
        SELECT CAST(n_nationkey AS BIGINT) AS i, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY name), name FROM f""",
    ),
    "s13_conform": entry(
        lambda s, d: readers.conform(table(s, d, "labels"), T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("quality", T.IntegerType()), T.StructField("extra", T.DoubleType())])),
        "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS INTEGER) AS quality, CAST(NULL AS DOUBLE) AS extra FROM labels",
    ),
    "s13_coalesce_duplicates": entry(
        lambda s, d: readers.coalesce_duplicates(_labels(s, d), {"mark": ["quality", "toxic"]}),
        f"SELECT {_DOCS}, coalesce(quality, toxic) AS mark FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "f1_slice_with_extras": entry(
        lambda s, d: filters.slice_with_extras(orders(s, d), seasons=[1994], hi="1997-06-30", extra_ids=(1, 2, 3), season_col="season", date_col="d", id_col="id").select("id", "d"),
        f"WITH {ORDERS} SELECT DISTINCT id, d FROM o WHERE (season = 1994 OR id IN (1, 2, 3)) AND d <= DATE '1997-06-30'",
    ),
    "f2_keep_complete_groups": entry(
        lambda s, d: filters.keep_complete_groups(items(s, d), "g", 4).select("g", "n", "p", "q"),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM i) WHERE c = 4",
    ),
    "f3_validate_rows": entry(
        lambda s, d: filters.validate_rows(items(s, d), {"q": "q > 5", "disc": "disc <= 0.08", "tax": "tax between 0.01 and 0.07"})[1].groupBy(F.array_join("broken_rules", ",").alias("why")).agg(F.count("*").alias("rows")),
        f"""WITH {ITEMS}, b AS (SELECT concat_ws(',', CASE WHEN NOT q > 5 THEN 'q' END, CASE WHEN NOT disc <= 0.08 THEN 'disc' END, CASE WHEN NOT tax BETWEEN 0.01 AND 0.07 THEN 'tax' END) AS why FROM i)
        SELECT why, count(*) AS rows FROM b WHERE why <> '' GROUP BY why""",
    ),
    "f4_drop_groups_below": entry(
        lambda s, d: filters.drop_groups_below(items(s, d), "g", "n", "q", 5).select("g", "n", "p", "q"),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q FROM i WHERE g NOT IN (SELECT g FROM i GROUP BY g, n HAVING coalesce(sum(q), 0) < 5)",
    ),
    "f5_parse_minutes": entry(
        lambda s, d: items(s, d).select("g", "n", "p", filters.parse_minutes(F.when(F.col("n") == 1, "DNP").when(F.col("n") == 2, F.col("q").cast("string")).otherwise(F.concat(F.col("q").cast("int").cast("string"), F.lit(":"), F.lpad((F.col("p") % 60).cast("string"), 2, "0")))).alias("m")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:round(CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN q ELSE CAST(q AS INTEGER) + (p % 60) / 60.0 END, 3)}} AS m FROM i",
    ),
    "f7_normalize_duration": entry(
        lambda s, d: filters.normalize_duration(items(s, d).withColumn("m", F.col("q") + 225), "m", ["price"]).select("g", "n", "p", "q", "is_overtime", "price"),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, CASE WHEN q + 225 >= 259 THEN 1 ELSE 0 END AS is_overtime, {{r:CASE WHEN q + 225 >= 259 THEN price * 240 / (q + 225) ELSE price END}} AS price FROM i",
    ),
    "f8_repair_spread_price_bleed": entry(
        lambda s, d: filters.repair_spread_price_bleed(_quotes(s, d), F.col("flag") == "A").select("g", "n", "p", "repaired", "left_line", "right_line", "left_price", "right_price"),
        f"""WITH {ITEMS}, b AS (SELECT g, n, p, q AS l, CASE WHEN n % 2 = 0 THEN -q ELSE q + 1 END AS r, disc, tax, flag = 'A' AND q <> -(CASE WHEN n % 2 = 0 THEN -q ELSE q + 1 END) AS bad FROM i)
        SELECT g, n, p, bad AS repaired, {{r:CASE WHEN NOT bad THEN l END}} AS left_line, {{r:CASE WHEN NOT bad THEN r END}} AS right_line, {{r:CASE WHEN bad THEN l ELSE disc END}} AS left_price, {{r:CASE WHEN bad THEN r ELSE tax END}} AS right_price FROM b""",
    ),
    "f9_null_out_of_bounds": entry(
        lambda s, d: filters.null_out_of_bounds(items(s, d), {"q": (10, 40)}, F.col("flag") != "N").select("g", "n", "p", "flag", "q"),
        f"WITH {ITEMS} SELECT g, n, p, flag, {{r:CASE WHEN flag = 'N' OR q BETWEEN 10 AND 40 THEN q END}} AS q FROM i",
    ),
    "f10_drop_reasons": entry(
        lambda s, d: filters.drop_reasons(items(s, d), {"late": F.col("d") > "1998-01-01", "small": F.col("q") < 5, "flag": F.col("flag") == "R"})[1],
        f"WITH {ITEMS} SELECT CASE WHEN d > DATE '1998-01-01' THEN 'late' WHEN q < 5 THEN 'small' WHEN flag = 'R' THEN 'flag' ELSE 'kept' END AS reason, count(*) AS rows FROM i GROUP BY ALL",
    ),
    "f12_basic_clean": entry(
        lambda s, d: filters.basic_clean(_labels(s, d), ["quality"], {"n_chars": 300}, {"n_chars": "double"}).select("doc_id", "quality", "n_chars"),
        "SELECT doc_id, quality, {r:n_chars} AS n_chars FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars >= 300",
    ),
    "f14_apply_missing_policy": entry(
        lambda s, d: filters.apply_missing_policy(_labels(s, d), ["n_chars"], {"quality": "toxic"}, ("toxic",), ("quality",)).select("doc_id", "quality", "toxic", F.col("quality__is_missing").cast("int").alias("missing")),
        "SELECT doc_id, coalesce(quality, toxic) AS quality, coalesce(toxic, 0) AS toxic, CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS missing FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "f15_null_profile": entry(
        lambda s, d: filters.null_profile(_labels(s, d), ["quality", "toxic", "lang"]).select("doc_id", "n_null", F.array_join("null_columns", ",").alias("cols")),
        "SELECT doc_id, CAST((quality IS NULL)::INT + (toxic IS NULL)::INT + (lang IS NULL)::INT AS INTEGER) AS n_null, concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN lang IS NULL THEN 'lang' END) AS cols FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "f16_filter_by_prefix": entry(
        lambda s, d: filters.filter_by_prefix(orders(s, d), "prio", {"1": "first", "2": "first", "3": "second"}, ["first"]).select("id", "prio"),
        f"WITH {ORDERS} SELECT id, prio FROM o WHERE substr(prio, 1, 1) IN ('1', '2')",
    ),
    "f17_with_train_flag": entry(
        lambda s, d: filters.with_train_flag(_labels(s, d), F.col("quality") == 0).groupBy("train_eligible").agg(F.count("*").alias("rows")),
        "SELECT NOT coalesce(quality = 0, FALSE) AS train_eligible, count(*) AS rows FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    ),
    "f18_add_over_label": entry(
        lambda s, d: filters.add_over_label(items(s, d).withColumn("line", F.lit(25.0)), "q", "line")[0].select("g", "n", "p", "q", "is_over"),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, CASE WHEN q > 25 THEN 1 ELSE 0 END AS is_over FROM i WHERE q <> 25",
    ),
    "f19_not_started": entry(
        lambda s, d: filters.not_started(table(s, d, "events").withColumn("start", F.when(F.col("event_id") % 7 != 0, F.col("ts"))), "start", "2024-01-10 12:00:00", date="ts").select("event_id"),
        "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 7 <> 0 THEN ts END, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '23:59:59') > TIMESTAMP '2024-01-10 12:00:00'",
    ),
    "f20_apply_retention": entry(
        lambda s, d: filters.apply_retention(orders(s, d), "season", 1995)[1],
        f"WITH {ORDERS} SELECT count(*) FILTER (season < 1995) AS dropped, count(*) FILTER (season >= 1995) AS kept FROM o",
    ),
    "j1_pair_sides": entry(
        lambda s, d: joins.pair_sides(_two(s, d), ["g"], "home", validate=False),
        f"""WITH {ITEMS}, u AS (SELECT DISTINCT ON (g, n) * FROM i WHERE n <= 2 ORDER BY g, n, p, s, q, price)
        SELECT a.g, a.p AS p_TEAM_HOME, {{r:a.q}} AS q_TEAM_HOME, b.p AS p_TEAM_AWAY, {{r:b.q}} AS q_TEAM_AWAY FROM u a JOIN u b ON a.g = b.g AND a.n = 1 AND b.n = 2""",
    ),
    "j2_attach_side_values": entry(
        lambda s, d: joins.attach_side_values(_two(s, d), orders(s, d).select(F.col("id").alias("g"), F.col("v").alias("hv"), F.col("k").cast("double").alias("av")), "g", "home", {"x": ("hv", "av")}).select("g", "home", "x"),
        f"WITH {ITEMS}, u AS (SELECT DISTINCT g, n FROM i WHERE n <= 2) SELECT g, n = 1 AS home, {{r:CASE WHEN n = 1 THEN o_totalprice ELSE CAST(o_custkey AS DOUBLE) END}} AS x FROM u LEFT JOIN orders ON o_orderkey = g",
    ),
    "j3_resolve_ids": entry(
        lambda s, d: joins.resolve_ids(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), ["k"], "name")[1],
        "SELECT count(*) FILTER (n_name IS NULL) AS unmatched, count(*) AS rows FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey",
    ),
    "j4_backfill_from": entry(
        lambda s, d: joins.backfill_from(_labels(s, d).select("doc_id", "source", "quality"), table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").where("doc_id % 100 = 1").select("source", "quality"), ["source"], ["quality"]),
        """WITH c AS (SELECT source, count(*) AS n, max(quality) AS q FROM labels JOIN documents USING (doc_id) WHERE doc_id % 100 = 1 GROUP BY source)
        SELECT doc_id, documents.source, coalesce(quality, CASE WHEN c.n = 1 THEN c.q END) AS quality FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN c ON c.source = documents.source""",
    ),
    "j5_outer_coalesce": entry(
        lambda s, d: joins.outer_coalesce(orders(s, d).where("status = 'F'").groupBy("k").agg(F.max("v").alias("v")), orders(s, d).where("status = 'O'").groupBy("k").agg(F.max("v").alias("v")), ["k"], {"x": ["v", "b_v"]}),
        f"WITH {ORDERS} SELECT k, {{r:coalesce(max(CASE WHEN status = 'F' THEN v END), max(CASE WHEN status = 'O' THEN v END))}} AS x FROM o WHERE status IN ('F', 'O') GROUP BY k",
    ),
    "j7_missing_keys": entry(
        lambda s, d: joins.missing_keys(table(s, d, "part").select(F.col("p_partkey").alias("p")), items(s, d).where("q > 30"), ["p"]),
        "SELECT p_partkey AS p FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)",
    ),
    "j7_missing_dates": entry(
        lambda s, d: joins.missing_dates(orders(s, d).select(F.col("id").alias("g"), "d"), items(s, d).where("q > 10"), ["g"], "d").select("d"),
        f"WITH {ORDERS}, m AS (SELECT d FROM o WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)) SELECT DISTINCT CAST(x AS DATE) AS d FROM (SELECT d AS x FROM m UNION ALL SELECT d + INTERVAL 1 DAY FROM m)",
    ),
    "j8_find_incomplete": entry(
        lambda s, d: joins.find_incomplete(table(s, d, "events").select(F.col("user_id").alias("g"), "event_type").distinct(), table(s, d, "events").groupBy(F.col("user_id").alias("g")).agg(F.to_date(F.max("ts")).alias("d")), "event_type", "g", "d", 0.5),
        """WITH g AS (SELECT user_id AS g, CAST(max(ts) AS DATE) AS d FROM events GROUP BY user_id), h AS (SELECT DISTINCT user_id AS g, event_type FROM events),
        e AS (SELECT d, event_type FROM h JOIN g USING (g) GROUP BY d, event_type HAVING count(*) >= 0.5 * (SELECT count(*) FROM g x WHERE x.d = g.d))
        SELECT g.d, g.g, e.event_type FROM g JOIN e ON e.d = g.d ANTI JOIN h ON h.g = g.g AND h.event_type = e.event_type""",
    ),
    "j9_history_join": entry(
        lambda s, d: joins.history_join(orders(s, d).select("id", "k", "d", "season"), orders(s, d).select("k", "d", "season", "v"), "k", "d", "season", "id").groupBy("id").agg(F.count("*").alias("n"), F.sum("hist_v").alias("x")),
        f"WITH {ORDERS} SELECT a.id, count(*) AS n, {{r:sum(b.v)}} AS x FROM o a JOIN o b ON a.k = b.k AND b.d < a.d AND b.season BETWEEN a.season - 1 AND a.season GROUP BY a.id",
    ),
    "j10_prior_matchups": entry(
        lambda s, d: joins.prior_matchups(orders(s, d), orders(s, d).where("d >= '1998-01-01'").select("k", "status"), "k", "status", "d", "1997-01-01", "id", 1995, "season"),
        f"WITH {ORDERS} SELECT id, k, status, d FROM o WHERE d < DATE '1997-01-01' AND season >= 1995 AND (k, status) IN (SELECT (k, status) FROM o WHERE d >= DATE '1998-01-01')",
    ),
    "j11_last_value_asof": entry(
        lambda s, d: joins.last_value_asof(orders(s, d).where("status = 'F'").groupBy("k", "d").agg(F.max("v").alias("v")), orders(s, d).where("status <> 'F'").select("k", "d", "id"), ["k"], "d", ["v"]).select("id", "v"),
        f"""WITH {ORDERS}, e AS (SELECT k, d, max(v) AS v FROM o WHERE status = 'F' GROUP BY k, d)
        SELECT p.id, {{r:(SELECT arg_max(e.v, e.d) FROM e WHERE e.k = p.k AND e.d < p.d)}} AS v FROM o p WHERE status <> 'F'""",
    ),
    "j14_team_at_cutoff": entry(
        lambda s, d: joins.team_at_cutoff(orders(s, d).select("season", F.col("k").alias("player_id"), F.col("prio").alias("team_id"), F.col("d").alias("game_date")), orders(s, d).groupBy("season").agg(F.date_sub(F.max("d"), 60).alias("cutoff"))),
        f"""WITH {ORDERS}, c AS (SELECT season, max(d) - 60 AS cutoff FROM o GROUP BY season)
        SELECT o.season, k AS player_id, arg_max(prio, (d, prio)) AS team_id FROM o JOIN c ON c.season = o.season AND d <= cutoff GROUP BY o.season, k""",
    ),
    "j15_safe_join": entry(
        lambda s, d: joins.safe_join(orders(s, d).select("id", "k"), table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), ["k"], "inner", "many_to_one"),
        f"WITH {ORDERS} SELECT k, id, c_mktsegment FROM o JOIN customer ON c_custkey = k",
    ),
    "j17_merge_measures": entry(
        lambda s, d: joins.merge_measures(items(s, d).groupBy("g").agg(F.sum("q").alias("q")), items(s, d).groupBy("g").agg(F.sum("q").alias("q"), F.avg("disc").alias("disc")), ["g"]),
        f"WITH {ITEMS} SELECT g, {{r:sum(q)}} AS q, {{r:avg(disc)}} AS disc FROM i GROUP BY g",
    ),
    "a1_add_group_total": entry(
        lambda s, d: aggregates.add_group_total(items(s, d), "g", "q", ["price"]).select("g", "n", "p", "q", F.col("TOTAL_POINTS").alias("t"), F.col("DIFF_FROM_price").alias("x")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, {{r:sum(q) OVER (PARTITION BY g)}} AS t, {{r:sum(q) OVER (PARTITION BY g) - price}} AS x FROM i",
    ),
    "a2_collapse_event_rows": entry(
        lambda s, d: aggregates.collapse_event_rows(items(s, d), ["g"], "flag", {"a_q": ("A", "q"), "r_q": ("R", "q"), "n_price": ("N", "price")}),
        f"WITH {ITEMS} SELECT g, {{r:max(CASE WHEN flag = 'A' THEN q END)}} AS a_q, {{r:max(CASE WHEN flag = 'R' THEN q END)}} AS r_q, {{r:max(CASE WHEN flag = 'N' THEN price END)}} AS n_price FROM i GROUP BY g",
    ),
    "a3_pivot_features": entry(
        lambda s, d: aggregates.pivot_features(items(s, d), ["s"], ["flag", "ls"], [("A", "F"), ("N", "O")], ["q", "price"]),
        f"WITH {ITEMS} SELECT s, {{r:max(CASE WHEN flag = 'A' AND ls = 'F' THEN q END)}} AS A_F_q, {{r:max(CASE WHEN flag = 'A' AND ls = 'F' THEN price END)}} AS A_F_price, {{r:max(CASE WHEN flag = 'N' AND ls = 'O' THEN q END)}} AS N_O_q, {{r:max(CASE WHEN flag = 'N' AND ls = 'O' THEN price END)}} AS N_O_price FROM i GROUP BY s",
    ),
    "a4_to_entity_log": entry(
        lambda s, d: aggregates.to_entity_log(table(s, d, "orders"), "o_orderkey", {True: {"x": "o_totalprice", "e": "o_custkey"}, False: {"x": "o_totalprice", "e": "o_orderkey"}}, ("o_orderstatus",)),
        "SELECT o_orderkey, o_orderstatus, TRUE AS home, {r:o_totalprice} AS x, o_custkey AS e FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, FALSE, {r:o_totalprice}, o_orderkey FROM orders",
    ),
    "a5_to_slots": entry(
        lambda s, d: aggregates.to_slots(items(s, d), "g", "s", 3, "ref"),
        f"WITH {ITEMS}, l AS (SELECT g, list_sort(list(DISTINCT s)) AS v FROM i GROUP BY g) SELECT g, v[1] AS ref_1, v[2] AS ref_2, v[3] AS ref_3 FROM l",
    ),
    "a6_lagged_season_count": entry(
        lambda s, d: aggregates.lagged_season_count(orders(s, d).select("id", "k", "season", "status"), ["k"], "season", "id", F.col("status") == "F", "x").select("id", "x"),
        f"WITH {ORDERS}, c AS (SELECT k, season + 1 AS season, count(DISTINCT id) AS x FROM o WHERE status = 'F' GROUP BY k, season) SELECT id, coalesce(x, 0) AS x FROM o LEFT JOIN c ON c.k = o.k AND c.season = o.season",
    ),
    "a7_share_of_total": entry(
        lambda s, d: aggregates.share_of_total(orders(s, d), ["k"], "v").select("id", "share"),
        f"WITH {ORDERS} SELECT id, {{r:v / sum(v) OVER (PARTITION BY k)}} AS share FROM o",
    ),
    "a8_aggregate_sources": entry(
        lambda s, d: aggregates.aggregate_sources(items(s, d), ["g"], ["q"], "tax", ("price",)),
        f"WITH {ITEMS} SELECT g, {{r:median(q)}} AS q_median, {{r:avg(q)}} AS q_mean, {{r:coalesce(stddev_pop(q), 0)}} AS q_std, {{r:max(q) - min(q)}} AS q_range, count(q) AS q_n, {{r:max(tax)}} AS tax_max, {{r:sum(price)}} AS price_sum FROM i GROUP BY g",
    ),
    "a9_direction_agreement": entry(
        lambda s, d: aggregates.direction_agreement(items(s, d).withColumn("m", F.col("q") - 25), ["g"], "m"),
        f"""WITH {ITEMS}, c AS (SELECT g, count(*) FILTER (q > 25) AS n_up, count(*) FILTER (q < 25) AS n_down, count(*) AS n FROM i GROUP BY g)
        SELECT g, n_up, n_down, n_up - n_down AS net, n_up + n_down AS n_movers, {{r:greatest(n_up, n_down) / n::DOUBLE}} AS dominant_of_all, {{r:coalesce(greatest(n_up, n_down) / nullif(n_up + n_down, 0)::DOUBLE, 0)}} AS dominant_of_movers FROM c""",
    ),
    "a10_median_of_groups": entry(
        lambda s, d: aggregates.median_of_groups(ticks(s, d), ["game_id", "market", "book"], ["game_id", "market"], "level", ["line_ts", "tick_id"]),
        f"""WITH {TICKS}, g AS (SELECT game_id, market, book, arg_min(level, (line_ts, tick_id)) AS a, arg_max(level, (line_ts, tick_id)) AS b, count(*) AS n FROM t GROUP BY ALL)
        SELECT game_id, market, {{r:median(a)}} AS level_first_median, {{r:median(b)}} AS level_last_median, {{r:median(b - a)}} AS level_move_median, {{r:median(n)}} AS level_n_median, count(*) AS sources FROM g GROUP BY ALL""",
    ),
    "a11_row_stats": entry(
        lambda s, d: aggregates.with_row_stats(items(s, d), ["q", "disc", "tax", "price"], "x").select("g", "n", "p", "q", "x_n", "x_mean", "x_std", "x_range", "x_iqr", "x_mad"),
        f"""WITH {ITEMS}, l AS (SELECT g, n, p, q, [q, disc, tax, price] AS v FROM i)
        SELECT g, n, p, {{r:q}} AS q, 4 AS x_n, {{r:list_avg(v)}} AS x_mean, {{r:list_stddev_pop(v)}} AS x_std, {{r:list_max(v) - list_min(v)}} AS x_range,
        {{r:list_aggregate(v, 'quantile_cont', 0.75) - list_aggregate(v, 'quantile_cont', 0.25)}} AS x_iqr, {{r:list_aggregate(v, 'mad')}} AS x_mad FROM l""",
    ),
    "a12_coverage": entry(
        lambda s, d: aggregates.coverage(items(s, d), ["flag", "ls"], "g"),
        f"WITH {ITEMS} SELECT flag, ls, count(*) AS rows, count(DISTINCT g) AS games FROM i GROUP BY flag, ls",
    ),
    "a13_summarize_dynamics": entry(
        lambda s, d: aggregates.summarize_dynamics(items(s, d), "q", "n"),
        f"WITH {ITEMS} SELECT {{r:median(q)}} AS median_move, {{r:avg(q)}} AS mean_move, {{r:avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END)}} AS share_never_moved, count(*) AS rows FROM i",
    ),
    "a14_daily_errors": entry(
        lambda s, d: aggregates.daily_errors(items(s, d).withColumn("line", F.lit(25.0)), "d", "q", "line"),
        f"WITH {ITEMS} SELECT d AS date, count(*) AS games, {{r:avg(q)}} AS mean_actual, {{r:25.0}} AS mean_line, {{r:avg(q - 25)}} AS mean_error, {{r:avg(abs(q - 25))}} AS mae FROM i GROUP BY d",
    ),
    "a14_daily_accuracy": entry(
        lambda s, d: aggregates.daily_accuracy(items(s, d).withColumns({"a": F.col("q") > 25, "b": F.col("disc") > 0.05}), "d", ["a", "b"]),
        f"WITH {ITEMS} SELECT d AS date, {{r:avg(CASE WHEN q > 25 THEN 1.0 ELSE 0 END)}} AS a_accuracy, {{r:avg(CASE WHEN disc > 0.05 THEN 1.0 ELSE 0 END)}} AS b_accuracy, {{r:avg(CASE WHEN q > 25 AND disc > 0.05 THEN 1.0 ELSE 0 END)}} AS all_right, count(*) AS games FROM i GROUP BY d",
    ),
    "a15_null_pct": entry(
        lambda s, d: aggregates.null_pct(_labels(s, d)),
        """WITH l AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'doc_id' AS "column", {r:100.0 * avg((doc_id IS NULL)::INT)} AS null_pct FROM l UNION ALL SELECT 'lang', {r:100.0 * avg((lang IS NULL)::INT)} FROM l
        UNION ALL SELECT 'source', {r:100.0 * avg((source IS NULL)::INT)} FROM l UNION ALL SELECT 'n_chars', {r:100.0 * avg((n_chars IS NULL)::INT)} FROM l UNION ALL SELECT 'quality', {r:100.0 * avg((quality IS NULL)::INT)} FROM l UNION ALL SELECT 'toxic', {r:100.0 * avg((toxic IS NULL)::INT)} FROM l""",
    ),
    "a15_duplicate_report": entry(
        lambda s, d: aggregates.duplicate_report(items(s, d), ["g", "n"]),
        f"WITH {ITEMS} SELECT CAST(count(*) AS BIGINT) AS rows, (SELECT count(*) FROM i) - (SELECT count(*) FROM (SELECT DISTINCT * FROM i)) AS repeated_rows, (SELECT count(*) FROM i) - (SELECT count(*) FROM (SELECT DISTINCT g, n FROM i)) AS repeated_keys FROM i",
    ),
    "a16_consensus_value": entry(
        lambda s, d: aggregates.consensus_value(items(s, d), ["g"], "n"),
        f"WITH {ITEMS}, c AS (SELECT g, n, count(*) AS c FROM i GROUP BY g, n) SELECT g, n AS n_mode FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, n) AS r FROM c) WHERE r = 1",
    ),
    "u1_union_all": entry(
        lambda s, d: sets.union_all(orders(s, d).select("id", "v"), orders(s, d).select("id", "status")),
        f"WITH {ORDERS} SELECT id, {{r:v}} AS v, NULL AS status FROM o UNION ALL SELECT id, NULL, status FROM o",
    ),
    "u3_diff_keys": entry(
        lambda s, d: sets.diff_keys(items(s, d), items(s, d).where("flag = 'A'"), ["p"]),
        f"WITH {ITEMS} SELECT p FROM i EXCEPT SELECT p FROM i WHERE flag = 'A'",
    ),
    "u3_common_keys": entry(
        lambda s, d: sets.common_keys(*[items(s, d).where(F.col("flag") == f) for f in "ARN"], keys=["s", "n"]),
        f"WITH {ITEMS} SELECT s, n FROM i WHERE flag = 'A' INTERSECT SELECT s, n FROM i WHERE flag = 'R' INTERSECT SELECT s, n FROM i WHERE flag = 'N'",
    ),
    "x1_prices": entry(
        lambda s, d: items(s, d).withColumn("a", F.when(F.col("q") > 25, F.col("q") * 10).otherwise(-F.col("q") * 10)).select("g", "n", "p", "q", X.american_to_decimal(F.col("a")).alias("x"), X.to_decimal(F.col("a")).alias("y"), X.decimal_to_american(X.american_to_decimal(F.col("a"))).alias("z")),
        f"""WITH {ITEMS}, b AS (SELECT *, CASE WHEN q > 25 THEN q * 10 ELSE -q * 10 END AS a FROM i), c AS (SELECT *, CASE WHEN a > 0 THEN 1 + a / 100 WHEN a < 0 THEN 1 + 100 / abs(a) END AS x FROM b)
        SELECT g, n, p, {{r:q}} AS q, {{r:x}} AS x, {{r:CASE WHEN abs(a) >= 100 THEN x END}} AS y, {{r:CASE WHEN x >= 2 THEN (x - 1) * 100 WHEN x > 1 THEN -100 / (x - 1) END}} AS z FROM c""",
    ),
    "x2_devig": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", X.implied_prob(1 + F.col("q") / 50).alias("a"), X.devig(1 + F.col("q") / 50, 1 + F.col("tax") + F.col("disc")).alias("v")).select("g", "n", "p", "q", "a", F.col("v.p").alias("b"), F.col("v.overround").alias("c")),
        f"WITH {ITEMS}, b AS (SELECT *, 1 / (1 + q / 50) AS x, 1 / (1 + tax + disc) AS y FROM i) SELECT g, n, p, {{r:q}} AS q, {{r:x}} AS a, {{r:x / (x + y)}} AS b, {{r:x + y}} AS c FROM b",
    ),
    "x3_rounding": entry(
        lambda s, d: items(s, d).withColumn("z", (F.col("q") - 25) / 4).select("g", "n", "p", "q", X.round_half_away(F.col("z")).alias("a"), X.round_half_up(F.col("z")).alias("b"), X.clamp(F.col("z"), -3, 3).alias("c")),
        f"WITH {ITEMS}, b AS (SELECT *, (q - 25) / 4 AS z FROM i) SELECT g, n, p, {{r:q}} AS q, {{r:sign(z) * floor(abs(z) / 0.5 + 0.5) * 0.5}} AS a, {{r:floor(z / 0.5 + 0.5) * 0.5}} AS b, {{r:least(greatest(z, -3), 3)}} AS c FROM b",
    ),
    "x5_haversine": entry(
        lambda s, d: orders(s, d).select("id", X.haversine_km(F.col("id") % 60, F.col("k") % 120, F.lit(40.0), F.lit(-74.0)).alias("x")),
        f"WITH {ORDERS} SELECT id, {{r:2 * 6371.0 * asin(sqrt(least(pow(sin((radians(40.0) - radians(id % 60)) / 2), 2) + cos(radians(id % 60)) * cos(radians(40.0)) * pow(sin(radians(-74.0 - (k % 120)) / 2), 2), 1.0)))}} AS x FROM o",
    ),
    "x6_canonical_name": entry(
        lambda s, d: table(s, d, "customer").select("c_custkey", X.canonical_name(F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES) + 1).cast("int")), F.lit(" "), F.col("c_name"), F.lit(" Jr. (#12)"))).alias("x")),
        f"SELECT c_custkey, list_extract({list(_NAMES.values())!r}, c_custkey % {len(_NAMES)} + 1) || ' ' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS x FROM customer",
    ),
    "x7_canonical_id": entry(
        lambda s, d: orders(s, d).select("id", X.canonical_id(F.concat(F.col("id").cast("string"), F.lit(".0"))).alias("x")),
        f"WITH {ORDERS} SELECT id, lpad(CAST(id AS VARCHAR), CAST(greatest(10, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS x FROM o",
    ),
    "x8_seasons": entry(
        lambda s, d: orders(s, d).select("id", X.season_year(F.col("d")).alias("y"), X.season_label(X.season_year(F.col("d"))).alias("l"), F.size(X.season_labels_between(F.lit("1992-01-01").cast("date"), F.col("d"))).alias("n"), X.season_type(F.col("prio"), {"1": "A", "2": "B"}).alias("t")),
        f"""WITH {ORDERS}, y AS (SELECT *, CAST(year(d) - CASE WHEN month(d) < 8 THEN 1 ELSE 0 END AS INTEGER) AS y FROM o)
        SELECT id, y, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS l, y - 1991 + 1 AS n, CASE substr(prio, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' END AS t FROM y""",
    ),
    "x10_minutes": entry(
        lambda s, d: table(s, d, "events").withColumn("m", X.minutes_between(F.col("ts"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))).select("event_id", "m", X.timing_bucket(F.col("m") % 1000).alias("b")),
        """WITH e AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 6e7 AS m FROM events), f AS (SELECT *, m % 1000 AS k FROM e)
        SELECT event_id, {r:m} AS m, CASE WHEN k <= 30 THEN '<=30' WHEN k <= 60 THEN '<=60' WHEN k <= 120 THEN '<=120' WHEN k <= 360 THEN '<=360' WHEN k <= 720 THEN '<=720' ELSE '>720' END AS b FROM f""",
    ),
    "x12_safe_ops": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", X.safe_div(F.col("q"), F.col("disc")).alias("a"), X.pair_mean(F.when(F.col("n") > 2, F.col("q")), F.col("tax")).alias("b"), X.log_ratio(F.col("q"), F.col("disc")).alias("c")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, {{r:q / nullif(disc, 0)}} AS a, {{r:CASE WHEN n > 2 THEN (q + tax) / 2 ELSE tax END}} AS b, {{r:CASE WHEN q > 0 AND disc > 0 THEN ln(q / disc) END}} AS c FROM i",
    ),
    "x13_entropy": entry(
        lambda s, d: items(s, d).groupBy("s").agg(*[F.count_if(F.col("flag") == f).alias(f) for f in "ARN"]).select("s", X.entropy(F.col("A"), F.col("R"), F.col("N")).alias("x")),
        f"""WITH {ITEMS}, c AS (SELECT s, flag, count(*) AS c FROM i GROUP BY s, flag), p AS (SELECT s, c / sum(c) OVER (PARTITION BY s) AS p FROM c) SELECT s, {{r:-sum(p * log2(p))}} AS x FROM p GROUP BY s""",
    ),
    "x15_bucket": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", X.bucket(F.col("q"), [10, 20, 30]).cast("int").alias("a"), X.bucket(F.col("q"), [10, 20, 30], False).cast("int").alias("b"), X.encode_line(F.col("q")).cast("int").alias("e")),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, (q > 10)::INT + (q > 20)::INT + (q > 30)::INT AS a, (q >= 10)::INT + (q >= 20)::INT + (q >= 30)::INT AS b, CAST(round(q * 2) AS INTEGER) AS e FROM i",
    ),
    "x17_one_hot": entry(
        lambda s, d: items(s, d).select("g", "n", "p", "q", *[c.cast("int") for c in X.one_hot("flag", ["A", "N", "R"], "f")]).toDF("g", "n", "p", "q", "f_A", "f_N", "f_R"),
        f"WITH {ITEMS} SELECT g, n, p, {{r:q}} AS q, (flag = 'A')::INT AS f_A, (flag = 'N')::INT AS f_N, (flag = 'R')::INT AS f_R FROM i",
    ),
}


def _two(s, d):
    """Two rows per order, its first two lines, with a side."""
    from pastframe.operators.topk import latest_per_key

    return latest_per_key(items(s, d).where("n <= 2").select("g", "n", "p", "s", "q", "price"), ["g", "n"], ["p", "s", "q", "price"], first=True).select("g", (F.col("n") == 1).alias("home"), "p", "q")


def _quotes(s, d):
    return items(s, d).select("g", "n", "p", "flag", F.col("q").alias("left_line"), F.when(F.col("n") % 2 == 0, -F.col("q")).otherwise(F.col("q") + 1).alias("right_line"), F.col("disc").alias("left_price"), F.col("tax").alias("right_price"))


def _props(s, d):
    """The keys of the events' JSON."""
    flat = readers.flatten_event_json(table(s, d, "events"), "props", "struct<j:string>", {}).select("event_id", F.map_keys(F.from_json("props", "map<string,string>")).alias("ks"))
    return flat.select("event_id", F.size("ks").alias("n"), F.array_join(F.array_sort("ks"), ",").alias("ks"))
