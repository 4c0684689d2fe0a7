"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastframe.llm.common import settled, with_text_columns, written
from pastframe.llm.components import connected_components

BITS = 64
#: Two fingerprints link at this many differing bits or fewer. The ball construction below is made for it.
RADIUS = 3
BLOCK = 1 << 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; no words: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not w:
        return 0
    grams = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(g), seed) for g in grams), np.uint64, max(1, len(w) - words + 1))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """df with a signed 64-bit SimHash of text_col; null text counts as empty and gets 0."""
    made = lambda texts, _: [pa.array(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))]
    return with_text_columns(df, text_col, [(out, "bigint", pa.int64())], made)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ball() -> tuple[list[int], list[int]]:
    """Masks of the variants: within one bit (itself included), and those of two bits that are needed besides.

    A pair at distance 1 or 2 meets in a variant one bit from either. At distance 3, one of the two has an even number
    of set bits and the other an odd one; the even one goes two bits and the odd one a single bit. Of three differing
    bits two lie in the same half of the word, so flips of two bits in one half are enough.
    """
    near = [0, *(1 << i for i in range(BITS))]
    half = BITS // 2
    far = [1 << i | 1 << j for lo in (0, half) for i, j in combinations(range(lo, lo + half), 2)]
    return [_signed(m) for m in near], [_signed(m) for m in far]


def ball_edges(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) whose components are those of the relation "RADIUS or fewer differing bits". fps: distinct values.

    Every fingerprint emits all variants in its ball, and variants are shuffled by value. Fingerprints within one bit of
    a variant differ from each other by at most 2 and from those at two bits by at most 3, so all that share the variant
    link to the smallest of the near ones: a star, whose size is linear in the group. Those at two bits without a near
    one differ by 2 or 4; at 2 they meet elsewhere.
    """
    near, far = ball()
    even = F.bit_count(F.col(fp)) % 2 == 0
    # the distinct values are small and would be coalesced into a few tasks, which then emit all variants; dealt by fp
    # itself, as they already are, they would not be dealt again
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.lit("spread"), fp))
    v = spread.select(F.col(fp).alias("fp"), F.explode(F.when(even, F.lit([*near, *far])).otherwise(F.lit(near))).alias("mask"))
    v = v.select((F.col("fp").bitwiseXOR(F.col("mask"))).alias("variant"), "mask", (F.bit_count("mask") > 1).alias("far"))
    own = F.col("variant").bitwiseXOR(F.col("mask"))
    w = Window.partitionBy("variant").orderBy("far", own)
    met = v.select(own.alias("b"), F.first(own).over(w).alias("a"), F.first("far").over(w).alias("lonely"))
    met = met.where("not lonely and a <> b").select("a", "b").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of df: id_col, fp (signed long), fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of RADIUS or fewer differing bits. Null and empty texts have
    fingerprint 0 and are linked like any other; null ids stay, and are never a component's id unless all its ids are
    null. Repeated rows stay repeated. Very long texts count whole. An empty table gives no rows; other columns are not carried.
    """
    fps = with_fingerprint(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", "fp", words, seed).select("id", "fp")
    fps = written(fps, "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    comp = settled(df.sparkSession, lambda: connected_components(ball_edges(least.select("fp"))), "components")
    linked = least.join(comp, least.fp == comp.node, "left").select("fp", "least", "component")
    root = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("root"))
    labels = linked.join(root, "component", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return fps.join(labels, "fp").select(
        F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
