"""Ranked lexical search: item tiles times document tiles as dense matrices of whole numbers, the best of each tile kept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastframe.llm.common import let_workers_import, settled, sliced, written
from pastframe.sources.ordered import running_total

#: Terms are the maximal runs of ASCII letters and digits and of all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text: A-Z in lower case, what is no part of a term a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: An impact is less than this, so rows of a tile whose weights sum to less than EXACT have exact sums in float64.
IMPACT = 1_000_000
EXACT = (1 << 53) // IMPACT


@dataclass(frozen=True)
class Tiles:
    #: Terms of a block of items, repeats of a term in an item not counted: a block goes out as a broadcast.
    block_terms: int = 400_000
    #: Items of a tile.
    items: int = 64
    #: Cells of a document tile: the block's vocabulary times documents.
    cells: int = 4 << 20


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, count) of items (item, text): the terms of each whole text, only A-Z lower-cased."""
    upper = "".join(map(chr, range(65, 91)))
    term = F.explode(F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(TERM), F.lit(0)))
    return items.select("item", term.alias("term")).groupBy("item", "term").agg(F.count("*").alias("count"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of each document (doc_id, text) with a term: its number of terms, and which of the vocabulary it has how often."""
    spark = docs.sparkSession
    let_workers_import(spark)
    known = spark.sparkContext.broadcast(vocabulary)  # Tiles.block_terms at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.get
        for whole in batches:
            for batch in sliced(whole, "text"):
                n, ids, tfs = [], [], []
                for text in batch.column("text").to_pylist():
                    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
                    found = np.fromiter((k for k in map(place, words) if k is not None), np.int32)
                    own, tf = np.unique(found, return_counts=True)
                    n.append(len(words))
                    ids.append(own)
                    tfs.append(tf.astype(np.int32))
                rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "ids", "tfs"])
                yield rows.filter(pa.array(np.array(n) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, n bigint, ids array<int>, tfs array<int>")


def exact_parts(q: np.ndarray, limit: int = EXACT) -> Iterator[np.ndarray]:
    """Matrices in float64 that sum to the whole numbers q, none with a row whose sum is over limit."""
    while q.any():
        part = np.clip(limit - (np.cumsum(q, axis=1) - q), 0, q)
        yield part.astype(np.float64)
        q = q - part


def item_tiles(item: np.ndarray, term: np.ndarray, q: np.ndarray, size: int) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Per `size` items: the number of the first, the compact vocabulary (term numbers), and the weights over it in exact parts.

    item: numbers from 0 in ascending order; term and q: of the same length, a term of the item and its weight times its count.
    """
    tiles = []
    for first in range(0, int(item[-1]) + 1 if len(item) else 0, size):
        a, b = np.searchsorted(item, [first, first + size])
        words, at = np.unique(term[a:b], return_inverse=True)
        weights = np.zeros((int(item[b - 1]) - first + 1 if b > a else 0, len(words)), np.int64)
        weights[item[a:b] - first, at] = q[a:b]
        tiles.append((first, words, list(exact_parts(weights))))
    return tiles


class Best:
    """The k best (score, document) of each item so far, equal scores by ascending document, those without an id last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.floor = k, np.zeros((0, 4), np.int64), np.ones(items, np.int64)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray, nameless: np.ndarray) -> None:
        """scores: items from number `first` on times documents. Those at least as high as an item's k-th best so far come in: ties are never cut."""
        i, d = np.nonzero(scores >= self.floor[first : first + len(scores), None])
        if len(i):
            new = np.stack([i + first, -scores[i, d], nameless[d], docs[d]], axis=1)
            old = self.rows
            rows = np.concatenate([old, new])
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            start = np.searchsorted(rows[:, 0], rows[:, 0])
            rank = np.arange(len(rows)) - start
            last = rows[rank == self.k - 1]
            self.floor[last[:, 0]] = -last[:, 1]
            self.rows = rows[rank < self.k]


def scored(found: DataFrame, tiles: list[tuple[int, np.ndarray, list[np.ndarray]]], terms: int, items: int, n_docs: int, all_terms: int, k: int, cells: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item in each task. found: postings."""
    spark = found.sparkSession
    let_workers_import(spark)
    sent = spark.sparkContext.broadcast(tiles)  # weights of Tiles.block_terms entries at most, dense over a tile's own vocabulary
    wide = int(np.clip(cells // max(terms, 1), 16, 4096))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, tile = Best(items, k), np.zeros((terms, wide))
        for batch in batches:
            for at in range(0, batch.num_rows, wide):
                b = batch.slice(at, wide)
                ids, tfs = b.column("ids"), b.column("tfs")
                sizes = np.diff(ids.offsets.to_numpy())
                doc = np.repeat(np.arange(len(b)), sizes)
                term, tf = ids.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
                m = 25 + 75 * b.column("n").to_numpy() * n_docs // all_terms
                tile[term, doc] = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                names = b.column("doc_id")
                nameless, names = np.asarray(names.is_null(), np.int64), names.fill_null(0).to_numpy()
                for first, words, parts in sent.value:
                    impacts = tile[words, : len(b)]
                    scores = sum((part @ impacts).astype(np.int64) for part in parts)
                    if parts:
                        kept.add(first, scores, names, nameless)
                tile[term, doc] = 0
        rows = kept.rows
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 3], mask=rows[:, 2] > 0), pa.array(-rows[:, 1])], names=["item", "doc_id", "score"])

    return found.mapInArrow(best, "item bigint, doc_id bigint, score bigint")


def _ranked(docs: DataFrame, block: DataFrame, k: int, tiles: Tiles) -> DataFrame:
    """(item, rank, doc_id, score) of a block's items; block: (item, term, count), tiles.block_terms rows or one item's."""
    rows = block.select("item", "term", "count").toPandas()
    numbers, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
    vocabulary = {t: i for i, t in enumerate(sorted({t.encode("utf-8", "surrogatepass") for t in rows["term"]}))}
    term = np.array([vocabulary[t.encode("utf-8", "surrogatepass")] for t in rows["term"]], np.int64)
    found = written(postings(docs, vocabulary), "postings")
    n_docs, all_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    seen = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toPandas()  # a row a term of the block
    df[seen["id"].to_numpy(np.int64)] = seen["df"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    order = np.argsort(item, kind="stable")
    made = item_tiles(item[order], term[order], (weight[term] * rows["count"].to_numpy())[order], tiles.items)
    best = scored(found, made, len(vocabulary), len(numbers), n_docs, all_terms, k, tiles.cells)
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(numbers)], "item bigint, number bigint")  # a row an item of the block
    return top.join(F.broadcast(names), "item").select(F.col("number").alias("item"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, tiles: Tiles = Tiles()) -> DataFrame:
    """The k documents (doc_id, text) of highest score for each item (item_id, text): item_id, rank from 1, doc_id, score above 0.

    Score: over the item's terms, repeats included, weight times impact in whole numbers, by the counts of all documents:
    weight floor(1000 ln((2N+2)/(2df+1))), impact (1e9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L.

    Items go through in blocks of tiles.block_terms terms (an item with more is a block of its own); one pass over the
    documents keeps what they have of a block's vocabulary, from which document frequencies are counted, and a second pass
    multiplies. A tile of items has a compact vocabulary of its own; its weights times the tile of documents' impacts is
    one dense product in float64. Impacts are under 1e6, so weights are divided into parts that sum to less than 2^53 / 1e6
    a row: no partial sum is rounded. Parts are added in 64 bits. A task keeps each item's k best, ties by ascending
    doc_id, so what leaves it is k rows an item; ranks are then taken over those rows, with k an item cut on the map side.

    Null texts have no terms; documents without terms don't count, items without terms have no rows. Rows repeated whole
    are documents, or items, of their own. Rows without an id come last among equal scores. Very long texts are counted
    whole, and an item may have any length. Other columns are not read. Empty tables give no rows.
    """
    asked = written(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    terms = written(item_terms(asked), "item-terms")
    sizes = running_total(terms.groupBy("item").agg(F.count("*").alias("n")), [F.col("item")], "before", F.col("n"), "item-order", written)
    blocks = written(sizes.select("item", F.floor(F.col("before") / tiles.block_terms).alias("block")), "item-blocks")
    blocks_of = [row[0] for row in blocks.select("block").distinct().orderBy("block").collect()]  # a number a block
    parts = [settled(docs.sparkSession, lambda: _ranked(docs, terms.join(blocks.where(F.col("block") == block), "item"), k, tiles), "ranked") for block in blocks_of]  # noqa: B023  runs at once
    if not parts:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, parts).join(asked, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
