"""Quality classifier: a label model over overlapping heuristics, whose posterior labels train a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastframe.llm.common import WordTable, hash_sample, let_workers_import, with_text_columns
from pastframe.llm.quality_rules import FEATURES, statistics, word_table

BITS = 14
#: Behind the hashed weights: that of repeats, then those of lengths.
EXTRA = (1 << BITS) + 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: (statistic, bad beyond, least words): these labellers call a text bad (-1) or, below and on shorter texts, nothing (0).
BAD = (
    ("symbols_per_word", 0.3, 3),
    ("same_as_previous", 0.2, 10),
    ("repeat_share", 0.5, 20),
    ("upper_share", 0.5, 8),
    ("exclaim_per_word", 0.3, 8),
    ("pipe_per_word", 0.25, 5),
    ("dup_line_share", 0.5, 20),
    ("digit_share", 0.4, 10),
)
#: Labellers that call a text good (+1) or nothing: all these statistics at most so large.
GOOD = (
    {"symbols_per_word": 0.05, "upper_share": 0.15, "exclaim_per_word": 0.05, "pipe_per_word": 0.02, "digit_share": 0.25, "same_as_previous": 0.1},
    {"symbols_per_word": 0.1, "upper_share": 0.3, "exclaim_per_word": 0.1, "same_as_previous": 0.05, "repeat_share": 0.3, "dup_line_share": 0.4, "pipe_per_word": 0.05},
)
_BAD_AT = [list(FEATURES).index(name) for name, *_ in BAD]
_GOOD_AT = [[(list(FEATURES).index(name), most) for name, most in g.items()] for g in GOOD]
N_LABELLERS = len(BAD) + len(GOOD)


def votes(text: str, words: WordTable) -> np.ndarray:
    """What each labeller says of a whole text; none says anything of a text without words."""
    (n, *_), values = statistics(text, words)
    bad = [-(n >= least and values[at] > most) for at, (_, most, least) in zip(_BAD_AT, BAD, strict=True)]
    return np.array([*bad, *(n > 0 and all(values[at] <= most for at, most in g) for g in _GOOD_AT)], np.int8)


@dataclass(frozen=True)
class LabelModel:
    """How often each labeller is right when it speaks, and the share of good documents where none speaks."""

    accuracy: np.ndarray
    good: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        log = np.log(self.good / (1 - self.good)) + v @ np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(log, -50, 50)))


def expectation_maximisation(v: np.ndarray, counts: np.ndarray, good_share: float = 0.6, rounds: int = 200) -> LabelModel:
    """Fits the label model to distinct vote patterns and their counts; every labeller starts as right nine times in ten.

    Accuracies stay within 0.55 and 0.999: a labeller is taken to know something and never to be beyond doubt. The
    classes' shares are not learned: a large good share would explain away labellers that only ever say bad.
    """
    model = LabelModel(np.full(v.shape[1], 0.9), good_share)
    for _ in range(rounds):
        good = model.posterior(v)
        right = (np.where(v > 0, good[:, None], 0) + np.where(v < 0, 1 - good[:, None], 0)) * counts[:, None]
        spoke = (v != 0) * counts[:, None]
        accuracy = np.clip((right.sum(0) + 9) / (spoke.sum(0) + 10), 0.55, 0.999)
        after = LabelModel(accuracy, good_share)
        if np.abs(after.accuracy - model.accuracy).max() < 1e-7:
            return after
        model = after
    return model


class _Kinds(dict):
    """What a character counts as in a shape."""

    def __missing__(self, c: str) -> str:
        k = self[c] = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        return k


_KINDS, _RUN = _Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """The word's kinds of characters, runs as one: X, x and d for letters and digits, other signs as they are."""
    return _RUN.sub(r"\1", "".join(map(_KINDS.__getitem__, word)))


def shape_table() -> WordTable:
    return WordTable(lambda w: (xxhash.xxh64_intdigest(shape(w.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass"), 5),), 1)


def features(text: str, shapes: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word shapes and pairs of neighbouring shapes with their shares, the share of words that repeat the one
    before, and the text's length by powers of two."""
    at, facts = shapes.rows(text.encode("utf-8", "surrogatepass"))
    n = len(at)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    h = facts[:, 0]
    shift = np.uint64(64 - BITS)
    counts = np.bincount(np.concatenate([h * _A >> shift, (h[:-1] * _A + h[1:] * _B) * _A >> shift]).astype(np.int64))
    idx = np.flatnonzero(counts)
    again = np.count_nonzero(at[1:] == at[:-1]) / n
    size = EXTRA + min(n.bit_length(), 20)
    return np.append(idx, [1 << BITS, size]).astype(np.int32), np.append(counts[idx] / n, [again, 1.0]).astype(np.float32)


@dataclass(frozen=True)
class Settings:
    #: Documents that the linear scorer learns from, at most; beyond it those of small hash. The label model sees all.
    max_rows: int = 20_000
    steps: int = 500
    rate: float = 3.0
    l2: float = 1e-6


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray = field(repr=False)
    bias: float

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.weights[idx] @ val + self.bias, -30, 30)))


def fit(docs: DataFrame, p: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learns from texts alone.

    Votes of all documents are counted by pattern in Spark: 3 to the power of the labellers bounds what reaches the
    driver. The scorer then learns the posterior labels of a bounded sample. No documents: every score is about 0.5.
    """
    let_workers_import(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    say = lambda ts, words: [pa.array([(votes(t, words) + 1).tobytes() for t in ts], pa.binary())]
    counted = with_text_columns(texts, "text", [("votes", "binary", pa.binary())], say, word_table).groupBy("votes").count().toPandas()
    patterns = np.array([np.frombuffer(b, np.int8) for b in counted.votes]).reshape(-1, N_LABELLERS) - 1
    labels = expectation_maximisation(patterns, counted["count"].to_numpy(float))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, words = shape_table(), word_table()
        for b in batches:
            ts = [t or "" for t in b.column("text").to_pylist()]
            y = labels.posterior(np.array([votes(t, words) for t in ts]).reshape(-1, N_LABELLERS))
            x = [features(t, shapes) for t in ts]
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array([i for i, _ in x], pa.list_(pa.int32())), pa.array([v for _, v in x], pa.list_(pa.float32()))], names=["y", "i", "v"])

    sample = hash_sample(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), ["id", "text"], p.max_rows).select("text").mapInArrow(featured, "y double, i array<int>, v array<float>").toPandas()
    w, bias = np.zeros(EXTRA + 21), 0.0
    if len(sample):
        rows = np.repeat(np.arange(len(sample)), sample.i.map(len))
        idx, val, y = np.concatenate(sample.i.to_list()).astype(np.int64), np.concatenate(sample.v.to_list()).astype(float), sample.y.to_numpy()
        share = np.where(y < 0.5, 0.5 / max((y < 0.5).sum(), 1), 0.5 / max((y >= 0.5).sum(), 1))  # both classes weigh the same
        seen, seen_bias = np.full(len(w), 1e-8), 1e-8
        for _ in range(p.steps):
            raw = np.bincount(rows, w[idx] * val, len(y)) + bias
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * share
            gw = np.bincount(idx, g[rows] * val, len(w)) + p.l2 * w
            seen, seen_bias = seen + gw**2, seen_bias + g.sum() ** 2
            w, bias = w - p.rate * gw / np.sqrt(seen), bias - p.rate * g.sum() / np.sqrt(seen_bias)
    return QualityModel(labels, w, float(bias))


def with_quality(df: DataFrame, model: QualityModel, text_col: str = "text", out: str = "quality") -> DataFrame:
    """df with the scorer's P(good) of each whole text; null counts as empty. Without words the bias alone decides."""
    made = lambda texts, shapes: [pa.array([model.score(*features(t, shapes)) for t in texts], pa.float64())]
    return with_text_columns(df, text_col, [(out, "double", pa.float64())], made, shape_table)


def quality(docs: DataFrame, p: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, score and kept (score of `least` or more) of every row; repeated rows get equal results.

    Null texts count as empty; very long texts, and words, are read whole. Other columns are not carried. An empty table gives no rows.
    """
    d = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    return with_quality(d, fit(d, p, id_col), "text", "score").select(id_col, "score", (F.col("score") >= least).alias("kept"))


def keep_good(df: DataFrame, p: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df with a score of `least` or more, with df's columns."""
    scored = with_quality(df, fit(df, p, id_col, text_col), text_col, "__quality")
    return scored.where(F.col("__quality") >= least).select(*[F.col(f"`{c}`") for c in df.columns])
