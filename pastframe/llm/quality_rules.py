"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastframe.llm.common import WordTable, hash_sample, with_text_columns, written

SYMBOLS = [c.encode() for c in "#*$%&|<>"]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
_P = np.uint64(0x9E3779B97F4A7C15)

#: The features of the trees, and whether the score may only fall (-1) as one grows; 0: free.
FEATURES = {
    "n_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "same_as_previous": -1, "distinct_share": 0, "stop_share": 0, "exclaim_per_word": -1, "pipe_per_word": -1,
}


def word_table() -> WordTable:
    """Of each word its hash, code points, digits, and whether it is in capitals."""

    def facts(word: bytes) -> tuple[int, ...]:
        w = word.decode("utf-8", "surrogatepass")
        return xxhash.xxh64_intdigest(word, 11), len(w), 0 if w.isalpha() else sum(map(str.isdigit, w)), int(len(w) > 1 and w.isupper())

    return WordTable(facts, 4)


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows that occur more than once in the text."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    acc = np.zeros(n, np.uint64)
    for j in range(window):
        acc = acc * _P + h[j : j + n]
    ordered = np.sort(acc)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(acc, twice))
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def statistics(text: str, words: WordTable) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts COUNTS and the values of FEATURES of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    _, facts = words.rows(data)
    n, h = len(facts), np.ascontiguousarray(facts[:, 0])
    chars, digits, upper = map(int, facts[:, 1:].sum(0))
    symbols, repeats = sum(map(data.count, SYMBOLS)), repeated_words(h)
    lines, dup = duplicate_lines(data)
    d, c = max(n, 1), max(chars, 1)
    uniq, counts = np.unique(h, return_counts=True)
    top = np.sort(counts)[::-1][:20].sum() if n else 0
    values = (
        float(n), chars / d, symbols / d, dup / max(lines, 1), repeats / d, upper / d, digits / c,
        float(np.count_nonzero(h[1:] == h[:-1])) / d, len(uniq) / d, float(top) / d, data.count(b"!") / d, data.count(b"|") / d,
    )
    return (n, chars, symbols, dup, repeats), values


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the five counts and an array of feature values of each whole text; null counts as empty: all zero."""

    def made(texts: list[str], words: WordTable) -> list[pa.Array]:
        both = [statistics(t, words) for t in texts]
        cols = [pa.array([c[k] for c, _ in both], pa.int64()) for k in range(len(COUNTS))]
        return [*cols, pa.array([v for _, v in both], pa.list_(pa.float64()))]

    outputs = [*((c, "bigint", pa.int64()) for c in COUNTS), ("features", "array<double>", pa.list_(pa.float64()))]
    return with_text_columns(df, text_col, outputs, made, word_table)


@dataclass(frozen=True)
class Boosting:
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    l2: float = 1.0
    min_rows: int = 20
    #: Labelled rows to learn from, at most; beyond it the rows of small hash are the sample.
    max_rows: int = 20_000


@dataclass(frozen=True)
class Forest:
    """All trees as rows of node arrays: heap order, the children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document, of each row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(f) + 1)) - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, p: Boosting = Boosting(), signs: tuple[int, ...] = tuple(FEATURES.values())) -> Forest:
    """Trees by histograms of gradients. A constrained feature's split must not raise the side that should be lower,
    and both sides' later values stay on their side of the middle. One class or no rows: no trees but a constant."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(signs))]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.empty((0, len(signs)), int)
    share = (y.sum() + 1) / (len(y) + 2)
    base, size = float(np.log(share / (1 - share))), (1 << p.depth + 1) - 1
    raw, out = np.full(len(y), base), []
    for _ in range(p.trees if 0 < y.sum() < len(y) else 0):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)
        feature, threshold, value = np.zeros(size, int), np.full(size, np.inf), np.zeros(size)
        lo, hi = np.full(size, -np.inf), np.full(size, np.inf)
        node = np.zeros(len(y), int)
        leaf = lambda a, b, k: np.clip(a / (b + p.l2), lo[k], hi[k])
        value[0] = leaf(g.sum(), h.sum(), 0)
        for k in range(size):
            here = node == k
            left, right = 2 * k + 1, 2 * k + 2
            if left >= size:
                break
            best = (1e-9, None)
            if here.sum() >= 2 * p.min_rows:
                gs, hs, xs = g[here], h[here], binned[here]
                for j, sign in enumerate(signs):
                    m = len(cuts[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(xs[:, j], weights, m))[:-1] for weights in (gs, hs, None))
                    gr, hr = gs.sum() - gl, hs.sum() - hl
                    vl, vr = leaf(gl, hl, k), leaf(gr, hr, k)
                    gain = gl**2 / (hl + p.l2) + gr**2 / (hr + p.l2) - gs.sum() ** 2 / (hs.sum() + p.l2)
                    ok = (nl >= p.min_rows) & (len(gs) - nl >= p.min_rows) & (sign * (vr - vl) >= 0)
                    if ok.any() and (top := np.where(ok, gain, -1).max()) > best[0]:
                        c = int(np.where(ok, gain, -1).argmax())
                        best = (top, (j, c, vl[c], vr[c]))
            lo[[left, right]], hi[[left, right]] = lo[k], hi[k]
            value[[left, right]] = value[k]
            if best[1]:
                j, c, vl, vr = best[1]
                feature[k], threshold[k] = j, cuts[j][c]
                value[left], value[right] = vl, vr
                if signs[j]:
                    low, high = (left, right) if signs[j] > 0 else (right, left)
                    hi[low] = lo[high] = (vl + vr) / 2
                node[here & (binned[:, j] > c)] = right
                node[here & (binned[:, j] <= c)] = left
            else:
                node[here] = left
        value *= p.rate
        raw += value[node]
        out.append((feature, threshold, value))
    f, t, v = (np.array([o[i] for o in out]).reshape(len(out), size) for i in range(3))
    return Forest(f.astype(int), t, v, base)


def with_verdict(df: DataFrame, forest: Forest, features_col: str = "features", out: str = "quality_score") -> DataFrame:
    """df with the forest's score of each row's feature array; the forest is a few kilobytes and goes with the task."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()) if len(values) else np.empty((0, len(FEATURES)))
        return pd.Series(forest.score(x))

    return df.withColumn(out, score(features_col))


def quality_rules(docs: DataFrame, labels: DataFrame, p: Boosting = Boosting(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """id, the five counts, base_failed, quality_score and kept of every row.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and a score of
    `least` or more. The trees learn from labelled rows that pass the base rules (p.max_rows of them at most; an id
    labelled twice counts with its smaller label); without labels the score is 0.5 and the base rules alone decide.
    Null text counts as empty: base_failed. Very long texts are read whole. Repeated rows get equal results; other columns
    are not carried. An empty table gives no rows.
    """
    d = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = written(with_statistics(d).drop("text").withColumn("base_failed", failed), "statistics")
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"))
    sample = hash_sample(stats.where("not base_failed").join(marks, id_col), [id_col], p.max_rows).select(id_col, "features", "y").toPandas().sort_values(id_col)
    x = np.stack(sample.features.to_numpy()) if len(sample) else np.empty((0, len(FEATURES)))
    forest = boost(x, sample.y.to_numpy(float), p)
    return with_verdict(stats, forest).withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= least)).select(
        id_col, *COUNTS, "base_failed", "quality_score", "kept"
    )
