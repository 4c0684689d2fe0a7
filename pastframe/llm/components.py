"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastframe.llm.common import forget, written


#: Edges of a node are dealt to so many tasks; minima, one row a node, are repeated for each.
SPREAD = 8


def _spread(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """edges (u, v) with the minimum m of u; a node with a third of all edges keeps no task for itself."""
    left = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int"))
    return left.join(minima.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["u", "s"]).drop("s")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Each round joins edges with per-node minima (partial aggregation first, and edges of a node dealt to several tasks) and is written to the shared folder; the driver sees a count and a checksum only. Self
    edges and repeated edges have no effect; null ends are ignored. No edges: no rows.
    """
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _spread(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _spread(large, root).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first())
        forget(e)
        e = after
        if now == mark or now[0] == 0:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
