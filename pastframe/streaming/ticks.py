"""Incremental tick intake and running state (ST1-ST4). The batch operators are their oracles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pastframe.operators.topk import latest_per_key
from pastframe.sources.writers import append_new

KEYS = ["game_id", "market", "book", "line_ts"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_ticks(src: DataFrame, sink: str, checkpoint: str, keys: list[str] = KEYS, ts: str = "line_ts", late: str = "1 day") -> StreamingQuery:
    """ST1: ticks appended once per key: repeats within the watermark go by state, later ones by an anti join with the sink.

    The sink is partitioned by the tick's day: a batch reads only the days that it has ticks of. Within a day it is
    partitioned by batch, so that a batch that is tried again replaces its own files. The time must be among the keys.
    """
    unique = src.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", F.to_date(ts)).persist()
        days = [r.day for r in batch.select("day").distinct().collect()]  # the days of one batch
        old = spark.read.parquet(sink).where(F.col("day").isin(days) & (F.col("batch") != n)) if exists(spark, sink) else None
        new = append_new(old, batch, keys).withColumn("batch", F.lit(n))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(sink)
        batch.unpersist()

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_ticks(spark: SparkSession, sink: str, out: str, before: str) -> DataFrame:
    """ST1: the sink's days before a date as one batch each, written to out; the caller puts it in their place while no stream runs."""
    rows = spark.read.parquet(sink).where(F.col("day") < F.to_date(F.lit(before))).withColumn("batch", F.lit(-1).cast("long"))
    rows.repartition("day").write.mode("overwrite").partitionBy("day", "batch").parquet(out)
    return spark.read.parquet(out)


def stream_pregame(ticks: DataFrame, games: DataFrame, margin_minutes: float = 5) -> DataFrame:
    """ST2: only ticks up to the margin before their game's start; games are a static table, so the join keeps no state."""
    j = ticks.join(games.select("game_id", "tipoff_utc"), "game_id")
    before = (F.unix_micros(F.col("tipoff_utc").cast("timestamp")) - F.unix_micros(F.col("line_ts").cast("timestamp"))) / 6e7
    return j.withColumn("minutes_before_tip", before).where(F.col("minutes_before_tip") >= margin_minutes)


FIELDS = "last_ts long, level double, first double, n_ticks long, n_moves long, n_reversals long, sign int, n_late long"
OUT = "game_id string, market string, book string, " + FIELDS  # last_ts in microseconds until the end
#: The state of a game: one place in each array for each of its markets and books; times in microseconds, until in milliseconds.
STATE = "market array<string>, book array<string>, last_ts array<long>, level array<double>, first array<double>, n_ticks array<long>, n_moves array<long>, n_reversals array<long>, sign array<int>, n_late array<long>, until array<long>"
_UNKNOWN = (1 << 63) - 1
_NEW = (None, None, None, 0, 0, 0, 0, 0, 0)


def _path(held: tuple, at: np.ndarray, x: np.ndarray) -> tuple:
    """The state of one market and book after ticks of levels x, in order, at microseconds `at`; unknown times are _UNKNOWN."""
    last, value, first, n, moves, turns, sign, late, _ = held
    known = at != _UNKNOWN
    if last is not None:
        fresh = known & (at >= last)
        late += int(len(at) - fresh.sum())
        at, x, known = at[fresh], x[fresh], known[fresh]
    if len(x):
        step = np.sign(np.diff(x if value is None else np.append(value, x)))
        step = step[step != 0]
        signs = np.append(sign, step) if sign else step
        moves += len(step)
        turns += int((np.diff(signs) != 0).sum())
        sign = int(signs[-1]) if len(signs) else 0
        n, first = n + len(x), float(x[0]) if first is None else first
        last, value = int(at[known][-1]) if known.any() else last, float(x[-1])
    return last, value, first, n, moves, turns, sign, late


def stream_path_state(ticks: DataFrame, level: str = "level", tie: str = "tick_id", expire: str | None = None) -> DataFrame:
    """ST3: per (game, market, book) the last quote, ticks, moves and reversals so far, one row per key and batch that had ticks.

    Ticks of a batch are taken in order of time; ticks older than the state's last one are late: they are counted, in
    n_late, and change nothing else. expire: how long after the watermark a key without ticks is kept; by default for ever.
    A game's markets and books are one group with one state: Python is called once for a game and batch, not for each key.
    """
    wait = GroupStateTimeout.NoTimeout if expire is None else GroupStateTimeout.EventTimeTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(m, b): tuple(x) for m, b, *x in zip(*state.get, strict=True)} if state.exists else {}
        now = state.getCurrentWatermarkMs() if expire is not None else 0
        out, parts = {}, [] if state.hasTimedOut else list(frames)
        if parts:
            rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            at, x, ties = rows["__at"].to_numpy(), rows[level].to_numpy(float), rows[tie].to_numpy()
            by = rows.sort_values(["__at", tie]).index if ties.dtype == object else np.lexsort((ties, at))
            markets, books = rows["market"].tolist(), rows["book"].tolist()
            places: dict[tuple, list[int]] = {}
            for i in by:
                m, b = markets[i], books[i]
                places.setdefault((m if m == m else None, b if b == b else None), []).append(i)
            for k, own in places.items():
                new = _path(held.get(k, _NEW), at[own], x[own])
                out[k] = new
                held[k] = (*new, max((new[0] or 0) // 1000, now) + 1 if expire is not None else 0)
        if expire is not None:
            held = {k: v for k, v in held.items() if k in out or v[-1] >= now}
        if held:
            state.update(tuple(map(list, zip(*((*k, *v) for k, v in held.items()), strict=True))))
            if expire is not None:
                state.setTimeoutTimestamp(max(min(v[-1] for v in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(*key, *k, *v) for k, v in out.items()], columns=[c.split()[0] for c in OUT.split(", ")])

    timed = ticks if expire is None else ticks.withWatermark("line_ts", expire)
    timed = timed.withColumn("__at", F.coalesce(F.unix_micros(F.col("line_ts").cast("timestamp")), F.lit(_UNKNOWN)))
    needed = dict.fromkeys(["game_id", "market", "book", "__at", tie, level, *(["line_ts"] if expire else [])])
    done = timed.select(*needed).groupBy("game_id").applyInPandasWithState(step, OUT, STATE, "update", wait)
    return done.withColumn("last_ts", F.timestamp_micros("last_ts"))


def stream_latest(preds: DataFrame, sink: str, checkpoint: str, keys: list[str], at: str) -> StreamingQuery:
    """ST4: the latest prediction per key, read by latest(). A batch writes the latest rows of its own keys, as a run of one batch.

    Two neighbouring runs of as many batches each are merged into one, like a carry in binary counting: a row is written
    again log2(batches) times in all, and a batch's writes grow with its keys, not with the table. A batch that is tried
    again writes its run anew, or finds it merged and does nothing. What has been merged goes with the next batch, so that
    those who read it can end.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        done = runs(spark, sink)
        for lo, hi in set(done) - set(cover(done)):
            delete(spark, f"{sink}/run={lo}-{hi}")
        if any(hi >= n for _, hi in done):
            return
        latest_per_key(batch, keys, [at]).write.mode("overwrite").parquet(f"{sink}/run={n}-{n}")
        own = [*cover(done), (n, n)]
        while len(own) > 1 and own[-1][1] - own[-1][0] == own[-2][1] - own[-2][0] and own[-2][1] + 1 == own[-1][0]:
            (lo, _), (_, hi) = own[-2:]
            both = [spark.read.parquet(f"{sink}/run={a}-{b}") for a, b in own[-2:]]
            latest_per_key(both[0].unionByName(both[1]), keys, [at]).write.mode("overwrite").parquet(f"{sink}/run={lo}-{hi}")
            own[-2:] = [(lo, hi)]

    return preds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def runs(spark: SparkSession, sink: str) -> list[tuple[int, int]]:
    """ST4: first and last batch of each run that is complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(tuple(map(int, n.removeprefix("run=").split("-"))) for n in names if n.startswith("run=") and exists(spark, f"{sink}/{n}/_SUCCESS"))


def cover(done: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """ST4: the runs that no other run holds, in order: together all batches, each once."""
    return [r for r in done if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done)]


def latest(spark: SparkSession, sink: str, keys: list[str], at: str) -> DataFrame | None:
    """ST4: the table after the last batch: the latest row per key over the runs, of which there are log2(batches) or so."""
    tables = [spark.read.parquet(f"{sink}/run={lo}-{hi}") for lo, hi in cover(runs(spark, sink))]
    return latest_per_key(reduce(DataFrame.unionByName, tables), keys, [at]) if tables else None
