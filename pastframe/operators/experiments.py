"""Experiment comparison tables (M1-M8). Run tables are small; predictions that they are joined with may be large."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pastframe.operators.scoring import average_rank, score_bets
from pastframe.sources.ordered import running_total


def design_matrix(runs: DataFrame, config: str = "config", run: str = "run_id", factors: list[str] | None = None) -> DataFrame:
    """M1: nested JSON configs as one column per dotted key; with factors, only those.

    Levels are opened within the row, so a config is read and parsed once however deep it is.
    """
    found = F.map_entries(F.from_json(config, "map<string,string>"))
    none = F.array().cast("array<struct<key:string,value:string>>")

    def opened(e: Column) -> Column:
        deeper = F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(F.coalesce(e["value"].startswith("{"), F.lit(False)), F.coalesce(deeper, none)).otherwise(F.array(e))

    for _ in range(4):  # levels of nesting
        found = F.flatten(F.transform(found, opened))
    long = runs.select(run, F.explode(found).alias("e")).select(run, F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    return long.groupBy(run).pivot("k", factors).agg(F.first("v")) if factors else long.groupBy(run).pivot("k").agg(F.first("v"))


def flag_cohorts(runs: DataFrame, window: list[str], out: str = "in_cohort") -> DataFrame:
    """M2: runs of the most common evaluation window are the cohort."""
    ref = runs.groupBy(*window).count().orderBy(F.col("count").desc(), *window).limit(1).select(*[F.col(c).alias(f"__{c}") for c in window])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in window])
    return runs.crossJoin(F.broadcast(ref)).withColumn(out, same).drop(*[f"__{c}" for c in window])  # one row


def contrasts(runs: DataFrame, factor: str, others: list[str], metrics: list[str], at: str = "created_at") -> DataFrame:
    """M3: runs that agree in all other factors (null is a level) and differ in this one: the earliest run of each level, with deltas to the first level."""
    w = Window.partitionBy(*others, factor).orderBy(at, "run_id")
    one = runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    g = Window.partitionBy(*others)
    levels = one.withColumn("__n", F.count("*").over(g)).where("__n >= 2").drop("__n")
    o = g.orderBy(F.col(factor).asc_nulls_first())
    return levels.select("*", *[(F.col(m) - F.first(m).over(o)).alias(f"{m}_delta") for m in metrics])


def effects(contrast: DataFrame, factor: str, metrics: list[str]) -> DataFrame:
    """M3: per level the mean delta over all matched groups."""
    return contrast.groupBy(factor).agg(F.count("*").alias("groups"), *[F.avg(f"{m}_delta").alias(f"{m}_effect") for m in metrics])


def replicates(runs: DataFrame, factors: list[str], metrics: list[str]) -> DataFrame:
    """M3: how far runs of equal factors lie apart."""
    return runs.groupBy(*factors).agg(F.count("*").alias("runs"), *[(F.max(m) - F.min(m)).alias(f"{m}_range") for m in metrics]).where("runs >= 2")


def rescore(runs: DataFrame, preds: DataFrame, threshold: float, edge: str = "edge", actual: str = "actual", line: str = "line") -> DataFrame:
    """M4: all runs at one least edge."""
    return runs.join(score_bets(preds, edge, actual, line, ("run_id",), min_edge=threshold), "run_id", "left")


def pooled_vs_control(scores: DataFrame, control: str, group: str = "arm", metric: str = "roi") -> DataFrame:
    """M5: each arm's metric against the control's."""
    c = scores.where(F.col(group) == control).agg(F.avg(metric).alias("control"))
    g = scores.groupBy(group).agg(F.avg(metric).alias(metric), F.count("*").alias("n")).crossJoin(F.broadcast(c))  # one row
    return g.withColumn("gap", F.col(metric) - F.col("control"))


def win_rate_by(bets: DataFrame, by: list[str]) -> DataFrame:
    """M5: win rate of decided bets per group and overall (nulls), in one pass."""
    won = F.when(F.col("bet_margin") > 0, 1.0).when(F.col("bet_margin") < 0, 0.0)
    return bets.groupingSets([[F.col(c) for c in by], []], *map(F.col, by)).agg(F.avg(won).alias("win_rate"), F.count(won).alias("decided"))


def seed_spread(runs: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """M6: range and deviation over seeds."""
    return runs.groupBy(*group).agg(F.count_distinct("seed").alias("seeds"), *[x for m in metrics for x in ((F.max(m) - F.min(m)).alias(f"{m}_spread"), F.stddev_samp(m).alias(f"{m}_std"))])


def run_summaries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """M6: the metric files root/<run>/metrics.json, or folders of that name, as one row per run."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/metrics.json").withColumn("run_id", F.regexp_extract(F.input_file_name(), r"/([^/]+)/metrics\.json", 1))


def importance_stability(imp: DataFrame, k: int = 100, target: str = "target", model: str = "model", feature: str = "feature", importance: str = "importance", families: dict[str, str] = {}, parts: int | None = None) -> DataFrame:  # noqa: B006
    """M7: per target and feature: medians of share and rank fraction over models, how often it is used, in the top quarter, in the top k.

    parts: how many tasks share the targets and features; by default Spark's own number.
    """
    g = [target, model]
    w = Window.partitionBy(*g)
    s = imp.withColumn("__neg", -F.col(importance)).withColumn("share", F.try_divide(F.col(importance), F.sum(importance).over(w))).withColumn("__n", F.count("*").over(w))
    s = s.withColumn("rank", average_rank(g, "__neg")).withColumn("rank_fraction", F.col("rank") / F.col("__n"))
    fam: Column = F.lit("other")
    for word, name in reversed(families.items()):
        fam = F.when(F.lower(feature).contains(word.lower()), name).otherwise(fam)
    s = s.repartition(parts, target, feature) if parts else s
    return s.groupBy(target, feature).agg(F.median("share").alias("median_share"), F.median("rank_fraction").alias("median_rank_fraction"), F.avg((F.col(importance) > 0).cast("double")).alias("used_rate"), F.avg((F.col("rank_fraction") <= 0.25).cast("double")).alias("top_quarter_rate"), F.avg((F.col("rank") <= k).cast("double")).alias("top_k_rate"), F.count("*").alias("models")).withColumn("family", fam)


#: Models of a block: a task compares the models of two blocks. Blocks are no more than MOST_BLOCKS, as each model is sent to every block, and
#: larger where that isn't enough; a task then goes through them in tiles.
OVERLAP_BLOCK, MOST_BLOCKS, OVERLAP_TILE = 1024, 24, 256


def topk_overlap(imp: DataFrame, k: int, model: str = "model", feature: str = "feature", importance: str = "importance", block: int = OVERLAP_BLOCK, most: int = MOST_BLOCKS) -> DataFrame:
    """M7: Jaccard similarity of the top-k sets of every two models.

    All pairs are asked for, so work and result are quadratic in the models; what is shuffled isn't, as a model goes to at most
    `most` blocks. Blocks are spans of the order of models. A task meets two of them tile by tile, counts what a
    model shares with the other tile by a list of models per feature, and holds two blocks and the pairs of two tiles. A
    model's pairs with a tile come one after the other, and the next model has the same ones, which columns of files keep in little room.
    """
    w = Window.partitionBy(model).orderBy(F.col(importance).desc(), feature)
    top = imp.where(F.col(model).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).groupBy(F.col(model).alias("m")).agg(F.collect_set(feature).alias("fs"))
    placed = running_total(top, [F.col("m")], "place", name="overlap")
    n = placed.count()
    blocks = max(1, min(-(-n // block), most))
    own = placed.withColumn("own", F.floor(F.col("place") / max(1, -(-n // blocks))).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = own.select("m", "fs", "place", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("place")
        names, lists, mine = (t.column(c).combine_chunks() for c in ("m", "fs", "own"))
        code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, owner, words = np.cumsum(size), np.repeat(np.arange(len(size)), size), int(code.max(initial=-1)) + 1
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = (np.flatnonzero(mine.to_numpy() == x) for x in (i, j))
        tiles = lambda x: [x[at : at + OVERLAP_TILE] for at in range(0, len(x), OVERLAP_TILE)]
        sets = lambda x: slice(ends[x[0]] - size[x[0]], ends[x[-1]])  # noqa: E731  of models one after the other
        for q in tiles(right):
            has = code[sets(q)]
            holders = (owner[sets(q)] - q[0])[np.argsort(has, kind="stable")]  # by feature, the models that have it
            begin = np.concatenate(([0], np.cumsum(np.bincount(has, minlength=words))))
            for p in tiles(left):
                if i == j and p[0] >= q[-1]:
                    continue
                c = code[sets(p)]
                many = begin[c + 1] - begin[c]
                at = np.repeat(begin[c] - np.cumsum(many) + many, many) + np.arange(many.sum())
                shared = np.bincount(np.repeat(owner[sets(p)] - p[0], many) * len(q) + holders[at], minlength=len(p) * len(q))
                a, b = np.repeat(p, len(q)), np.tile(q, len(p))
                some = a < b if i == j else slice(None)
                a, b, shared = a[some], b[some], shared[some]
                jaccard = shared / np.maximum(size[a] + size[b] - shared, 1)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(jaccard)], names=["model_a", "model_b", "jaccard"])

    kind = imp.schema[model].dataType
    cells = cells.repartition(blocks * (blocks + 1) // 2, "i", "j")  # small as they are, their pairs aren't: they aren't to be put together
    return cells.groupBy("i", "j").applyInArrow(met, T.StructType([T.StructField("model_a", kind), T.StructField("model_b", kind), T.StructField("jaccard", T.DoubleType())]))


def pivot_runs(runs: DataFrame, index: str, cols: str, values: list[str], metric: str) -> DataFrame:
    """M8: a metric by two factors."""
    return runs.groupBy(index).pivot(cols, values).agg(F.avg(metric))


def fold_table(folds: DataFrame, run: str = "run_id", metric: str = "roi") -> DataFrame:
    """M8: per run how a metric does over its folds: mean, deviation, worst, share above zero."""
    return folds.groupBy(run).agg(F.count("*").alias("folds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("worst"), F.avg((F.col(metric) > 0).cast("double")).alias("positive_share"))


def cv_vs_holdout(cv: DataFrame, holdout: DataFrame, run: str = "run_id", metric: str = "roi") -> DataFrame:
    """M8: the same run in validation and on the holdout."""
    return cv.select(run, F.col(metric).alias("cv")).join(holdout.select(run, F.col(metric).alias("holdout")), run).withColumn("gap", F.col("holdout") - F.col("cv"))
