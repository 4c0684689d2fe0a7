"""Queries over walk-forward folds and the learners that they feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastframe.operators import audits, splits
from pastframe.queries.tables import ORDERS, entry, orders

SPEC = splits.FoldSpec(folds=3, test_rows=300, train_rows=900, min_train=500)
WIDE = splits.FoldSpec(folds=9, test_rows=9000, train_rows=900, min_train=500)


def _folds(s, d):
    return splits.walk_forward_folds(orders(s, d), "d", "id", SPEC)


def _bounds(spec: splits.FoldSpec, tag: str = "") -> str:
    """CTEs that find the folds' bounds: {tag}bound(fold, first, ends, t0, t1, n). Windows are taken greedily, day after day."""
    return f"""{tag}day AS (SELECT d, count(*) AS n FROM o GROUP BY d), {tag}cum AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, CAST(sum(n) OVER (ORDER BY d) - n AS BIGINT) AS b, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS u FROM {tag}day),
    {tag}nxt AS (SELECT a.i, a.d AS t0, a.b, e.d AS t1, e.i AS e, e.i IS NOT NULL AND least(a.b, {spec.train_rows}) >= {spec.min_train} AS ok FROM {tag}cum a ASOF LEFT JOIN {tag}cum e ON a.b + {spec.test_rows} <= e.u),
    {tag}walk(i) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT CASE WHEN ok THEN e + 1 ELSE n.i + 1 END FROM {tag}walk w JOIN {tag}nxt n ON n.i = w.i),
    {tag}got AS (SELECT t0, t1, b, row_number() OVER (ORDER BY b DESC) AS back, count(*) OVER () AS n FROM {tag}nxt JOIN {tag}walk USING (i) WHERE ok),
    {tag}bound AS (SELECT CAST(least(n, {spec.folds}) - back AS INTEGER) AS fold, greatest(0, b - {spec.train_rows}) AS first, b AS ends, t0, t1 FROM {tag}got WHERE back <= {spec.folds})"""


_ROWS = """pos AS (SELECT *, row_number() OVER (ORDER BY d, id) - 1 AS p FROM o),
    rows AS (SELECT fold, id, d, v, k, CASE WHEN d BETWEEN t0 AND t1 THEN 'test' ELSE 'train' END AS role FROM pos JOIN bound ON d BETWEEN t0 AND t1 OR (p >= first AND p < ends))"""


def _ridge(groups: str, penalty: str) -> str:
    """CTE line(…, b0, b1): least squares of v on k over training rows, with a penalty on the slope."""
    return f"""sums AS (SELECT {groups}, count(*) AS n, sum(k) AS sx, sum(v) AS sy, sum(k * k) AS sxx, sum(k * v) AS sxy FROM rows WHERE role = 'train' GROUP BY {groups}),
    slope AS (SELECT *, (sxy - sx * sy / n) / (sxx - CAST(sx AS DOUBLE) * sx / n + {penalty}) AS b1 FROM sums), line AS (SELECT *, (sy - b1 * sx) / n AS b0 FROM slope)"""


#: The last three dates, each with the 500 rows before it.
_LAST = f"""WITH {ORDERS}, y AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS back FROM o GROUP BY d), pos AS (SELECT *, row_number() OVER (ORDER BY d, id) - 1 AS p FROM o),
    bound AS (SELECT CAST(3 - back AS INTEGER) AS fold, pos.d AS t0, pos.d AS t1, min(p) - 500 AS first, min(p) AS ends FROM pos JOIN y ON y.d = pos.d WHERE back <= 3 GROUP BY pos.d, back),
    rows AS (SELECT fold, id, d, v, k, CASE WHEN d = t0 THEN 'test' ELSE 'train' END AS role FROM pos JOIN bound ON d = t0 OR (p >= first AND p < ends))"""


def _with_x(s, d):
    return orders(s, d).withColumn("x", F.col("k").cast("double"))


QUERIES = {
    "e2_walk_forward_folds": entry(
        lambda s, d: _folds(s, d),
        f"WITH RECURSIVE {ORDERS}, {_bounds(SPEC)}, {_ROWS} SELECT fold, id, d AS date, role FROM rows",
    ),
    "e3_validate_folds": entry(
        lambda s, d: splits.validate_folds(_folds(s, d), "id"),
        f"""WITH RECURSIVE {ORDERS}, {_bounds(SPEC)}, {_ROWS} SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, max(d) FILTER (role = 'train') AS train_end,
        min(d) FILTER (role = 'test') AS test_start, max(d) FILTER (role = 'test') AS test_end, CAST(0 AS BIGINT) AS n_overlap, TRUE AS valid FROM rows GROUP BY fold""",
    ),
    "e3_summarize_folds": entry(
        lambda s, d: splits.summarize_folds(_folds(s, d)),
        f"WITH RECURSIVE {ORDERS}, {_bounds(SPEC)}, {_ROWS} SELECT fold, role, count(*) AS rows, min(d) AS first_date, max(d) AS last_date FROM rows GROUP BY fold, role",
    ),
    "e5_walk_forward_score": entry(
        lambda s, d: splits.walk_forward_score(_with_x(s, d), "d", "id", splits.ridge(["x"], "v"), 3, 500),
        f"{_LAST}, {_ridge('fold', '1')} SELECT fold, id, {{r:b0 + b1 * k}} AS prediction FROM rows JOIN line USING (fold) WHERE role = 'test'",
    ),
    "v2_score_folds": entry(
        lambda s, d: splits.score_folds(_with_x(s, d), _folds(s, d), "id", splits.ridge(["x"], "v", 50.0)),
        f"WITH RECURSIVE {ORDERS}, {_bounds(SPEC)}, {_ROWS}, {_ridge('fold', '50')} SELECT fold, id, {{r:b0 + b1 * k}} AS prediction FROM rows JOIN line USING (fold) WHERE role = 'test'",
    ),
    "e7_random_baseline": entry(
        lambda s, d: splits.random_baseline(orders(s, d), 7, "id").select("id", "p_random"),
        f"WITH {ORDERS} SELECT id, {{r:CAST('0x' || substr(md5('7:' || id), 1, 13) AS BIGINT) / 4503599627370496.0}} AS p_random FROM o",
    ),
    "e24_grid_over_folds": entry(
        lambda s, d: splits.grid_over_folds(_with_x(s, d), _folds(s, d), s.createDataFrame([(0.1,), (100.0,)], "penalty double"), "id", "v", lambda r: splits.ridge(["x"], "v", r.penalty)),
        f"""WITH RECURSIVE {ORDERS}, {_bounds(SPEC)}, one AS (SELECT unnest([0.1::DOUBLE, 100.0]) AS penalty), {_ROWS.replace('rows AS', 'plain AS')}, rows AS (SELECT * FROM plain, one), {_ridge('fold, penalty', 'penalty')},
        e AS (SELECT penalty, fold, avg(abs(b0 + b1 * k - v)) AS mae FROM rows JOIN line USING (fold, penalty) WHERE role = 'test' GROUP BY ALL)
        SELECT {{r:penalty}} AS penalty, {{r:avg(mae)}} AS mean_mae, {{r:stddev_samp(mae)}} AS std_mae, count(*) AS folds FROM e GROUP BY e.penalty""",
    ),
    "q7_preflight": entry(
        lambda s, d: audits.preflight(orders(s, d).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("v"))), "d", {"a": SPEC, "b": WIDE}, ["v", "k"]),
        f"""WITH RECURSIVE {ORDERS}, {_bounds(SPEC, 'a_')}, {_bounds(WIDE, 'b_')}, c AS (SELECT avg(CASE WHEN id % 10 > 0 THEN 1.0 ELSE 0.0 END) AS c FROM o)
        SELECT 'a' AS spec, CAST({SPEC.folds} AS INTEGER) AS folds_wanted, CAST((SELECT count(*) FROM a_bound) AS INTEGER) AS folds_possible, {{r:c}} AS rows_complete FROM c
        UNION ALL SELECT 'b', CAST({WIDE.folds} AS INTEGER), CAST((SELECT count(*) FROM b_bound) AS INTEGER), {{r:c}} FROM c""",
    ),
}
