"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from pastframe.llm.common import WordHashes, row_key, salted_join, with_text_columns, written

SHINGLE = 5
LEAST = 0.8
#: Fingerprints within RADIUS differ by at most RADIUS // BLOCKS bits in one of the blocks.
RADIUS, BLOCKS = 23, 8
WIDTH = 64 // BLOCKS
FLIPS = [sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), r)]
#: Words of the items of a block, at most, or one item: what is broadcast at a time is about 100 bytes a word.
BLOCK_WORDS = 200_000
#: So many windows are fingerprinted at a time.
PIECE = 8192
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_hashes() -> WordHashes:
    """Words in lower case without signs at their edges; the low byte is the word's length. Words of signs alone are 0."""

    def of(word: str) -> int:
        w = _EDGE.sub("", word.lower())
        return xxhash.xxh64_intdigest(w, 3) & ~0xFF | min(len(w), 255) if w else 0

    return WordHashes(of)


def words_of(text: str, hashes: WordHashes) -> np.ndarray:
    h = np.fromiter(map(hashes.__getitem__, text.split()), np.uint64)
    return h[h != 0]


def shingles(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (letters in its words) of each run of k words."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0)
    acc, weight, letters = np.zeros(n, np.uint64), np.zeros(n), (h & np.uint64(0xFF)).astype(float)
    for j in range(k):
        acc = (acc ^ h[j : j + n]) * _MUL
        acc ^= acc >> np.uint64(29)
        weight += letters[j : j + n]
    return acc, weight


def fingerprint(h: np.ndarray, weight: np.ndarray) -> int:
    """64-bit SimHash of weighted shingles."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * (weight @ bits) > weight.sum(), bitorder="little").view("<u8")[0])


def fingerprints(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(start, fingerprint) of the windows of `size` shingles at these ascending starts, by running sums over runs that overlap."""
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
        for at in range(0, len(run), PIECE):
            p = run[at : at + PIECE]
            lo, hi = p[0], p[-1] + size
            bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.zeros((hi - lo + 1, 65), np.int64)  # weights are whole numbers; the last column is their total
            own = weight[lo:hi, None].astype(np.int64)
            np.cumsum(np.hstack([bits * own, own]), axis=0, out=sums[1:])
            held = sums[p - lo + size] - sums[p - lo]
            fps = np.packbits(2 * held[:, :64] > held[:, 64:], axis=1, bitorder="little").view("<u8")[:, 0]
            yield from zip(p.tolist(), fps.tolist(), strict=True)


def totals(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and the summed weight of each."""
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse, weight, len(u))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Index:
    """A block of items: shingles that anchor windows, and for each window size a multi-index over fingerprints."""

    def __init__(self, items: list[tuple[object, str]]):
        hashes = word_hashes()
        self.ids, self.size, self.sets, self.fp = [], [], [], []
        self.by_k: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        spots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            h = words_of(text or "", hashes)
            k = min(SHINGLE, len(h))
            if item_id is None or not k:
                continue
            s, w = shingles(h, k)
            at = len(self.ids)
            self.ids.append(item_id)
            self.size.append(len(h))
            self.sets.append(totals(s, w))
            self.fp.append(fingerprint(s, w))
            spots[k] += [(int(x), at, j) for j, x in enumerate(s)]
        for k, rows in spots.items():
            rows.sort()
            x = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(x >> np.uint64(48)).astype(np.int64)] = True
            self.by_k[k] = x, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for at, (size, fp) in enumerate(zip(self.size, self.fp, strict=True)):
            blocks = self.tables.setdefault(size, [defaultdict(list) for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                blocks[b][fp >> b * WIDTH & (1 << WIDTH) - 1].append(at)

    def within(self, size: int, fp: int) -> Iterator[int]:
        """All items of this size whose fingerprint differs from fp in RADIUS bits or fewer: of BLOCKS blocks one then differs in
        RADIUS // BLOCKS or fewer, and those flips are looked up."""
        met: set[int] = set()
        for b, block in enumerate(self.tables[size]):
            own = fp >> b * WIDTH & (1 << WIDTH) - 1
            for f in FLIPS:
                if own ^ f in block:
                    met.update(block[own ^ f])
        return (at for at in met if (self.fp[at] ^ fp).bit_count() <= RADIUS)

    def search(self, h: np.ndarray) -> list[tuple[object, int, float]]:
        """(item id, first word, similarity) of the best window of each item that a document's words hold."""
        best: dict[int, tuple[float, int]] = {}
        for k, (x, item, offset, seen) in self.by_k.items():
            s, w = shingles(h, k)
            spots = np.flatnonzero(seen[(s >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(x, s[spots], "left"), np.searchsorted(x, s[spots], "right")
            spots, lo, hi = spots[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(spots):
                continue
            n = hi - lo
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            size = np.array(self.size)[item[entry]]
            total = np.concatenate([[0], np.cumsum(w)])
            for m in np.unique(size).tolist():
                shared = np.zeros(len(s))
                held = np.repeat(spots, n)[size == m]
                shared[held] = w[held]
                shared = np.concatenate([[0], np.cumsum(shared)])
                length = min(m - k + 1, len(s))
                # what a window shares with an item is at most what it shares with all of them
                most = shared[length:] - shared[:-length]
                starts = np.flatnonzero((most > 0) & (most >= LEAST * (1 - 1e-9) * (total[length:] - total[:-length])))
                for p, fp in fingerprints(s, w, starts, length) if len(starts) else ():
                    near = list(self.within(m, fp))
                    window = slice(p, p + length)
                    found = totals(s[window], w[window]) if near else None
                    for at in near:
                        sim = similarity(found, self.sets[at])
                        if sim >= LEAST and (at not in best or (-sim, p) < (-best[at][0], best[at][1])):
                            best[at] = sim, p
        return sorted((self.ids[at], p, sim) for at, (sim, p) in best.items())


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, str]]]:
    """The distinct items in blocks of at most `most` items and BLOCK_WORDS words; the driver holds one block at a time."""
    held, words = [], 0
    for r in benchmark.select(id_col, text_col).distinct().toLocalIterator():
        n = len((r[1] or "").split())
        if held and (len(held) == most or words + n > BLOCK_WORDS):
            yield held
            held, words = [], 0
        held.append((r[0], r[1]))
        words += n
    if held:
        yield held


def _searched(df: DataFrame, index: Index, text_col: str, out: str, item_kind: DataType) -> DataFrame:
    """df with the hits of one block's items; their index is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(item_kind)), ("start", pa.int32()), ("similarity", pa.float64())]))

    def made(texts: list[str], hashes: WordHashes) -> list[pa.Array]:
        found = [[{"item_id": i, "start": p, "similarity": s} for i, p, s in sent.value.search(words_of(t, hashes))] for t in texts]
        return [pa.array(found, kind)]

    return with_text_columns(df, text_col, [(out, _hits(item_kind), kind)], made, word_hashes)


def _hits(item_kind: DataType) -> str:
    return f"array<struct<item_id:{item_kind.simpleString()},start:int,similarity:double>>"


def with_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits", item_id: str = "item_id", item_text: str = "text", block_items: int = 5_000) -> DataFrame:
    """df with an array of (item_id, start, similarity) of the benchmark items that each whole text holds.

    A window has an item's number of words and may begin anywhere. What it shares with an item is at most the weight of
    its shingles that any item of that size in the block has; windows where that is under LEAST of their weight can't
    have a similarity of LEAST and are passed over, all others are fingerprinted, whatever the order of their shingles.
    The multi-index gives all items of that size within RADIUS bits, none left out, and those with a weighted shingle
    similarity of LEAST or more are hits, at the window that is most similar (of those the first).
    start counts words, signs standing alone left out. Items of fewer than SHINGLE words are one shingle; items without
    words or id match nothing; ids may be of any type. Null and empty texts, and an empty benchmark, give empty arrays.
    Repeated rows get equal arrays; very long texts are searched whole.
    A benchmark of more than block_items items (or BLOCK_WORDS words) goes through in blocks, each after the other: what
    a block finds is written, by text, before the next one is read and sent.
    """
    item_kind = benchmark.schema[item_id].dataType
    found, first = [], None
    for block in blocks(benchmark, item_id, item_text, block_items):
        if first is None:
            first = block
            continue
        for one in (first, block) if not found else (block,):
            texts = df.select(row_key(text_col).alias("__at"), F.col(f"`{text_col}`").alias("text"))
            hits = _searched(texts, Index(one), "text", "hit", item_kind)
            found.append(written(hits.where(F.size("hit") > 0).groupBy("__at").agg(F.first("hit").alias("hit")), "block-hits"))
    if first is None:
        return df.withColumn(out, F.array().cast(_hits(item_kind)))
    if not found:
        return _searched(df, Index(first), text_col, out, item_kind)
    both = reduce(DataFrame.unionByName, found).groupBy("__at").agg(F.flatten(F.collect_list("hit")).alias("__hit"))
    met = salted_join(df.withColumn("__at", row_key(text_col)), both, ["__at"], "left")
    return met.withColumn(out, F.coalesce("__hit", F.array().cast(_hits(item_kind)))).drop("__at", "__hit")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_items: int = 5_000) -> DataFrame:
    """One row per document and item that it holds: id, item_id, start, similarity. Repeated rows give repeated hits."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return with_contamination(d, benchmark, block_items=block_items).select("id", F.explode("hits").alias("hit")).select(F.col("id").alias(id_col), "hit.item_id", "hit.start", "hit.similarity")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that hold no benchmark item, with df's columns."""
    marked = with_contamination(df, benchmark, text_col, "__hits")
    return marked.where(F.size("__hits") == 0).select(*[F.col(f"`{c}`") for c in df.columns])
