"""Running totals over the whole of a table in an order: no window over all rows, and no task that sees them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastframe.sources.stored import stored


def running_total(df: DataFrame, order: list[Column], before: str, of: Column | int = 1, name: str = "ordered", write: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """df with `before`: the sum of `of` over all rows that come earlier in `order` (of 1: how many they are).

    Rows are range-partitioned in that order and written, so that borders stay where they are; partitions are summed, their
    sums run on over one row a partition, and a window runs on within a partition. Rows that are equal in `order` share a
    partition and come one after the other in any order: make it unique where that matters.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = write(df.withColumn("__of", F.lit(of) if isinstance(of, int) else of).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), name)
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = cut.groupBy("__part").agg(F.sum("__of").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    own = F.sum("__of").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.join(F.broadcast(base), "__part").withColumn(before, F.col("__base") + F.coalesce(own, F.lit(0))).drop("__part", "__base", "__of")
