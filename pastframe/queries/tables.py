"""The given tables in the roles that the operators ask for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Line items of one task, where a query says how many tasks share them.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, d: str) -> int:
    """So many tasks that the line items of one are bounded, Spark's number of shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // TASK_ROWS))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as game rows: customer is the key, the order date the date, the order key the tie."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"))


#: The same in SQL.
ORDERS = "o AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS season, o_totalprice AS v, o_orderstatus AS status, o_orderpriority AS prio FROM orders)"


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as quotes: the user is the game, the type the market, three books by the id, the user's last event the start."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tip = e.groupBy("user_id").agg(F.max("ts").alias("tip"))
    m = (F.unix_micros("tip") - F.unix_micros("ts")) / 6e7
    return e.join(tip, "user_id").select(F.col("user_id").alias("game_id"), F.col("event_type").alias("market"), (F.col("event_id") % 3).cast("int").alias("book"), F.col("ts").alias("line_ts"), F.col("event_id").alias("tick_id"), F.round(F.col("value"), 0).alias("level"), F.col("value").alias("price"), m.alias("minutes_before_tip"))


TICKS = """t AS (SELECT user_id AS game_id, event_type AS market, CAST(event_id % 3 AS INTEGER) AS book, ts AS line_ts, event_id AS tick_id, round(value, 0) AS level,
  value AS price, (epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts)) / 6e7 AS minutes_before_tip FROM events)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as bets and game lines."""
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.to_date("l_shipdate").alias("d"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("ls"))


ITEMS = """i AS (SELECT l_orderkey AS g, CAST(l_linenumber AS INTEGER) AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_extendedprice AS price,
  l_discount AS disc, l_tax AS tax, CAST(l_shipdate AS DATE) AS d, l_returnflag AS flag, l_linestatus AS ls FROM lineitem)"""


#: Added before rounding, so that halves, which means of prices often are, don't lie on the border between two results.
SHIFT = 1.37e-6


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, as sums in another order differ in the last digits; -0 is 0."""
    return df.select(*[(F.round(F.col(f"`{c}`") + SHIFT, places) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def entry(fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str | None]:
    """A query whose doubles are rounded, and its SQL. {r:expr} in the SQL is a rounded expression."""
    text = re.sub(r"\{r:((?:[^{}]|\{[^{}]*\})*)\}", rf"(round(CAST(\1 AS DOUBLE) + {SHIFT}, 4) + 0e0)", sql) if sql else None
    return (lambda spark, d: rounded(fn(spark, d))), text
