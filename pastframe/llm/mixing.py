"""Mixing sources to target weights by weighted fair queueing, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastframe.llm.common import settled, written
from pastframe.sources.ordered import running_total

#: Weights of the sources in their order, again and again.
WEIGHTS = (5, 2, 1)
#: A document is in the mix so many times at most.
REPEATS = 3
#: A source is divided into bins of about so many documents, by equal spans of their shuffled keys.
BIN_ROWS = 4096


def word_count(text: Column) -> Column:
    """How many [^\\x20\\x09-\\x0D]+ the whole text has: each is put down as one letter. Null: 0."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.rtrim(one, F.lit(" \t\n\x0b\f\r"))).cast("long")


def shares(stats: DataFrame, budget: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """stats (one row a source: source_size, weight, ...) with target: the budget by weight, `repeats` times the source's size at most.

    What a source can't take is shared by the others by weight until none is above. With sources in the order of cap by
    weight, the first k stop at their caps, and the rest get one level times their weights: k is the first place where
    the level of the rest is no higher than the source's own cap by weight. Without a budget it is all sizes together.
    """
    cap = F.col("source_size") * repeats
    w = Window.orderBy(cap / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    all_ = stats.agg(F.sum("weight").alias("all_weight"), (F.sum("source_size") if budget is None else F.lit(budget)).cast("long").alias("budget"))
    rest = stats.crossJoin(F.broadcast(all_)).select(  # one row
        (cap / F.col("weight")).alias("ratio"), ((F.col("budget") - F.coalesce(F.sum(cap).over(w), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(w), F.lit(0)))).alias("level")
    )
    level = rest.where("level <= ratio").agg(F.min_by("level", "ratio").alias("level"))
    return stats.crossJoin(F.broadcast(level)).withColumn("target", F.least(F.col("level") * F.col("weight"), cap.cast("double"))).drop("level")  # one row


def cycled(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """stats with weight: sources in the order of code points, null last, take the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    return stats.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights)))).cast("long"))


def queued(docs: DataFrame, weights: DataFrame | tuple[int, ...] = WEIGHTS, budget: int | None = None, repeats: int = REPEATS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """docs (doc_id, source, text): a row each, with size, source_size, target and begin: the words of its source that go first.

    A source's documents are shuffled by the MD5 of their ids. Each source is cut into bins of shuffled keys of about
    bin_rows documents, however many it has; bins are summed, their sums run on, and a window runs on within a bin. Rows
    alike in id, source and size go one after the other, and are spread over tasks as one row that knows how many it is.
    """
    key = ["doc_id", "source", "size"]
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    stats = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    stats = cycled(stats, weights) if isinstance(weights, tuple) else stats.join(weights.select(F.col("source").alias("s"), "weight"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    stats = written(shares(written(stats, "sources"), budget, repeats).withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())), "targets")
    bins = F.ceil(F.col("rows") / bin_rows)
    shuffled = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    met = sized.join(stats.select(F.col("source").alias("s"), "sid", "source_size", "target", "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    met = met.withColumn("shuffled", shuffled).withColumn("bin", F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * bins / (1 << 32)).cast("long"))
    own = F.col("size") * F.col("n")
    upto = Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    base = met.groupBy("sid", "bin").agg(F.sum(own).alias("all")).select("sid", "bin", F.coalesce(F.sum("all").over(upto), F.lit(0)).alias("base"))
    w = Window.partitionBy("sid", "bin").orderBy("shuffled", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = met.join(base, ["sid", "bin"]).withColumn("begin", F.col("base") + F.coalesce(F.sum(own).over(w), F.lit(0)))
    each = placed.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    return each.select(*key, "sid", "source_size", "target", (F.col("begin") + F.col("i") * F.col("size")).alias("begin"))


def sequence(queue: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The mix: queue's documents, a row each time that one is taken, with epoch, finish and at (the words of the mix before it).

    A document's virtual finish time is its source's words up to its end, those of earlier epochs included, divided by
    the source's target. The whole mix is range-sorted by it. All queues together have served the total budget at time 1,
    where the mix is truncated: to whole documents, of which those stay that are served by half or more then. So a
    source's words lie within half a document of its target.
    """
    served = queue.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("upto", F.col("begin") + F.col("epoch") * F.col("source_size") + F.col("size"))
    kept = served.where(2 * F.col("upto") - F.col("size") <= 2 * F.col("target")).withColumn("finish", F.col("upto") / F.col("target")).drop("upto")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("begin"), F.col("epoch")]
    return running_total(kept, order, "at", F.col("size"), "mix", written)


def mixed(docs: DataFrame, weights: DataFrame | tuple[int, ...] = WEIGHTS, budget: int | None = None, repeats: int = REPEATS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words that the mix takes of it), first_at (words of the mix before it first comes, null if it doesn't).

    weights: whole numbers that sources take in turn in the order of code points, null last, or a table (source, weight)
    of each source that may come in; sources without a row there stay out. Null texts and those without a word have size
    0, and are never taken. Null sources are one source; null ids are shuffled as the empty text. Rows that are repeated
    whole count each. Very long texts are one row of the queue, never cut. Other columns are not read. An empty table
    gives no rows. Runs agree, as all follows from ids, sources and sizes. A source with a third of all documents is dealt
    to as many bins as it fills; the table of sources is joined as Spark sees fit by its size.
    """
    queue = settled(docs.sparkSession, lambda: queued(docs, weights, budget, repeats, bin_rows), "queue")
    times = sequence(queue, repeats).groupBy("sid", "begin").agg(F.count("*").alias("times"), F.min("at").alias("first_at"))
    some = queue.where("size > 0").join(times, ["sid", "begin"], "left")
    none = queue.where("size = 0").withColumns({"times": F.lit(None).cast("long"), "first_at": F.lit(None).cast("long")})
    return some.unionByName(none).select("doc_id", "source", "size", "source_size", "target", (F.coalesce("times", F.lit(0)) * F.col("size")).alias("taken"), "first_at")
