"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words also count by their first letters, so that forms of a word not seen in training are recognised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastframe.llm.common import forget, hash_sample, let_workers_import, with_text_columns, written

BITS = 18
#: A word's first letters count besides the whole word: inflected forms then share what is learned.
PREFIXES = (3, 4, 5, 6)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: per-coordinate rates; l1, l2: penalties (l1 makes weights exactly zero)."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.1
    epochs: int = 5
    shards: int = 4
    #: Labelled rows to learn from, at most; beyond it the rows of small hash are the sample.
    max_rows: int = 24_000


class Words(dict):
    """Rows of hashes: of a word in lower case without signs at its edges, and of its first letters (PREFIXES of them).

    Kept from text to text while there is room.
    """

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.table = most, np.empty((1024, 1 + len(PREFIXES)), np.uint64)

    def __missing__(self, word: str) -> int:
        w = _EDGE.sub("", word.lower()) or word
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = [xxhash.xxh64_intdigest(w, 7), *(xxhash.xxh64_intdigest(w[:p], 7 + p) if len(w) >= p else 0 for p in PREFIXES)]
        self[word] = k
        return k

    def rows(self, text: str) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, text.split()), np.int64)
        return self.table[at]


def features(text: str, words: Words) -> np.ndarray:
    """Distinct hashed indices of the words, their first letters, word pairs and pairs with one word between."""
    rows = words.rows(text)
    h = rows[:, 0]
    shift = np.uint64(64 - BITS)
    parts = [(rows[rows != 0] * _MIX[0]) >> shift]
    if len(h) > 1:
        parts.append((h[:-1] * _MIX[1] + h[1:] * _MIX[2]) * _MIX[0] >> shift)
    if len(h) > 2:
        parts.append((h[:-2] * _MIX[3] + h[2:] * _MIX[1]) * _MIX[0] >> shift)
    return np.unique(np.concatenate(parts)).astype(np.int32)


def _weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return np.where(np.abs(z) <= p.l1, 0.0, w)


def fit(rows: DataFrame, p: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> np.ndarray:
    """Weights (the last one is the bias) from labelled rows.

    The rows are dealt by hash to a fixed number of shards. In each pass every shard goes through its rows once from the
    state that all share; of each coordinate, Spark averages the changes of z and n over the shards that touched it. The
    driver holds a state of the hashed size. Rows with a null label or text are left out. Without rows all weights are zero: every score is 0.5.
    """
    spark = rows.sparkSession
    let_workers_import(spark)
    take = hash_sample(rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()), [id_col], p.max_rows)
    take = take.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            x = [features(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(x, pa.list_(pa.int32()))], names=["h", "y", "x"])

    table = written(take.mapInArrow(featured, "h bigint, y int, x array<int>").withColumn("shard", F.pmod("h", F.lit(p.shards)).cast("int")), "toxic-features")
    data = table.repartitionById(p.shards, F.col("shard")).persist()  # dealt once; what a lost executor held is dealt again from the table
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(p.epochs):
        state = spark.sparkContext.broadcast((z, n))

        def one_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # noqa: B023  runs before the next pass binds another state
            held = [f for f in frames if len(f)]  # a shard: p.max_rows / p.shards rows
            if not held:
                return
            pdf = pd.concat(held)
            z0, n0 = state.value  # noqa: B023
            z1, n1 = z0.copy(), n0.copy()
            for x, y in pdf.sort_values("h")[["x", "y"]].itertuples(index=False):
                i = np.append(np.asarray(x, np.int64), size - 1)
                w = _weights(z1[i], n1[i], p)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
                s = (np.sqrt(n1[i] + g * g) - np.sqrt(n1[i])) / p.alpha
                z1[i] += g - s * w
                n1[i] += g * g
            i = np.flatnonzero((z1 != z0) | (n1 != n0))
            yield pd.DataFrame({"i": i, "z": z1[i] - z0[i], "n": n1[i] - n0[i]})

        got = data.mapInPandas(one_pass, "i long, z double, n double").groupBy("i").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
        z[got.i], n[got.i] = z[got.i] + got.z, n[got.i] + got.n  # at most 2**BITS + 1 rows
        state.unpersist()
    data.unpersist()
    forget(table)
    return _weights(z, n, p)


def with_score(df: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the probability of label 1 of each whole text; null and empty texts get what the bias gives.

    The weights go out as a broadcast of their nonzero entries: at most 2**BITS of them.
    """
    kept = np.flatnonzero(weights)
    sent = df.sparkSession.sparkContext.broadcast((kept, weights[kept]))

    def setup() -> tuple[np.ndarray, Words]:
        w = np.zeros((1 << BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        return w, Words()

    def made(texts: list[str], state: tuple[np.ndarray, Words]) -> list[pa.Array]:
        w, words = state
        s = np.array([w[features(t, words)].sum() if t and not t.isspace() else 0.0 for t in texts]) + w[-1]
        return [pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))]

    return with_text_columns(df, text_col, [(out, "double", pa.float64())], made, setup)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves no rest; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score and predicted (score of 0.5 or more) of every row; learns from rows that aren't held out.

    Repeated rows get equal scores. An id labelled more than once counts with its largest label. Null and empty texts get
    the score of a text without features; very long texts are read whole. Rows without an id are held out of nothing and
    have no label. Other columns are not carried. An empty table gives no rows; without labels every score is 0.5.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    marks = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    weights = fit(docs.join(marks, id_col), p, id_col)
    return with_score(docs.withColumn("held_out", held_out(id_col)), weights).select(
        id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
