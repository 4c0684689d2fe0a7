"""Conversation prefix trie: double arrays over dense turn ids in shards of the sorted prefixes, shared nodes merged by key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastframe.llm.common import forget, let_workers_import, salted_join, settled, written
from pastframe.llm.mixing import word_count
from pastframe.sources.ordered import running_total


@dataclass(frozen=True)
class Cut:
    #: Conversations are cut into blocks of so many turns; a block goes to the trie of its own prefix.
    block: int = 256
    #: A double array takes blocks until they hold so many turns.
    chunk: int = 200_000
    #: Turns of a block that tell its shard.
    head: int = 4
    #: Conversation ids that are written out as one piece of text.
    piece: int = 512


#: A node's key: its depth and two exclusive ors of hashes of (place, turn) over its turns, 128 bits that don't depend on the order of adding.
KEY = ["depth", "k1", "k2"]


def positioned(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, p, a, b, words), p from 0 in each conversation, a and b a hash of role and text, and members (conv_id, turns).

    Turns go by turn, null first, then role, then text; null role and text become empty. Places are running counts over
    range partitions of the sorted turns, so a conversation of a third of all turns is dealt to as many tasks as it fills.
    Rows without a conv_id belong to no conversation.
    """
    spark = conversations.sparkSession
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = said.withColumn("same", F.monotonically_increasing_id())  # rows alike may go in any order, and needn't share a task

    def numbered() -> DataFrame:
        order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("same")]
        own = running_total(rows, order, "at", name="turn-order", write=written)
        return own.select("conv_id", "at", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "role", "text").alias("b"), word_count(F.col("text")).alias("words"))

    turns = settled(spark, numbered, "turns")
    members = written(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("turns")), "members")
    placed = salted_join(turns, members, ["conv_id"]).select("conv_id", (F.col("at") - F.col("first")).alias("p"), "a", "b", "words")
    return placed, members.select("conv_id", "turns")


def reopened(turns: DataFrame, members: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their ids' span: (turns, members) of conversations rebuilt.

    Conversation c's first h turns, h = crc32 of its decimal id modulo most + 1, give way to the first h turns of
    conversation c - c % every: to all if it has fewer, to none if there is no such conversation.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("long")
    turns = written(turns, "places")
    opening = turns.where((F.col("conv_id") % every == 0) & (F.col("p") < most)).withColumnRenamed("conv_id", "base")
    asked = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    opened = asked.join(opening, "base").where("p < h").select("conv_id", "p", "a", "b", "words")
    short = asked.join(members.select(F.col("conv_id").alias("base"), "turns"), "base", "left").select("conv_id", F.least("h", F.coalesce("turns", F.lit(0))).alias("m"), "h").where("m < h")
    own = turns.withColumn("h", h).where("p >= h")
    own = salted_join(own, short.select("conv_id", "m"), ["conv_id"], "left").select("conv_id", (F.col("p") - F.col("h") + F.coalesce("m", "h")).alias("p"), "a", "b", "words")
    return opened.unionByName(own), members


class DoubleArray:
    """A trie in two arrays: state s goes by symbol c to BASE[s] + c if CHECK there is s. The first states are roots."""

    #: Free places that are tried for siblings, and how far they are looked for.
    TRIES, AHEAD = 64, 4096

    def __init__(self, roots: int, symbols: int):
        size = roots + symbols + self.AHEAD
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[:roots] = -2
        self.low = self.top = roots  # no place is free below low, none is taken from top on

    def _reach(self, place: int) -> None:
        while place + self.AHEAD >= len(self.check):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])

    def _fit(self, symbols: np.ndarray) -> int:
        """A base for siblings of ascending symbols: at the first free places if one of those does, else behind all that is taken."""
        span = int(symbols[-1] - symbols[0])
        self._reach(max(self.top, self.low + self.AHEAD) + span)
        free = self.low + np.flatnonzero(self.check[self.low : self.low + self.AHEAD] == -1)[: self.TRIES]
        for at in free.tolist():
            if (self.check[at - symbols[0] + symbols] == -1).all():
                return at - int(symbols[0])
        return self.top - int(symbols[0])

    def pack(self, parent: np.ndarray, symbol: np.ndarray) -> None:
        """Children (parent state, symbol), distinct and in ascending order, of parents without children so far."""
        if not len(parent):
            return
        start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        count = np.diff(np.r_[start, len(parent)])
        for at, n in zip(start[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            own = symbol[at : at + n]
            base = self._fit(own)
            self.base[parent[at]] = base
            self.check[base + own] = parent[at]
            self.top = max(self.top, base + int(own[-1]) + 1)
        alone = start[count == 1]
        free = self.low + np.flatnonzero(self.check[self.low : self.top] == -1)[: len(alone)]
        places = np.concatenate([free, np.arange(self.top, self.top + len(alone) - len(free))])
        if len(places):
            self._reach(int(places[-1]))
            self.base[parent[alone]] = places - symbol[alone]
            self.check[places] = parent[alone]
            self.top = max(self.top, int(places[-1]) + 1)
        taken = self.check[self.low : self.top] != -1
        self.low += len(taken) if taken.all() else int(taken.argmin())

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after these symbols; -1 where there is no such child."""
        to = self.base[state] + symbol
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == state), to, -1)


def dense_ids(turn: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A number from 0 for each distinct turn (rows of two hashes), by first place in `order`, so that siblings have numbers close together; and how many."""
    _, first, inverse = np.unique(turn.view([("a", np.int64), ("b", np.int64)]).ravel(), return_index=True, return_inverse=True)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(at[first])] = np.arange(len(first))
    return rank[inverse], len(first)


def trie_nodes(shard: int, block: int, conv: np.ndarray, j: np.ndarray, start: np.ndarray, length: np.ndarray, turn: np.ndarray, z: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of one double array: blocks of conversations (conv, j, start key, length), and of all their turns the hash, key part and words.

    Level by level siblings are packed; then all blocks traverse the arrays together, and each state on the way tells its
    node's key, how many blocks came through, and the smallest conversation of those.
    """
    offset = np.r_[0, np.cumsum(length)[:-1]]
    level = np.arange(len(turn)) - np.repeat(offset, length)
    symbol, n_symbols = dense_ids(turn, np.argsort(level, kind="stable"))
    _, root = np.unique(np.column_stack([j, start]), axis=0, return_inverse=True)
    root = root.ravel().astype(np.int64)
    arrays, deepest = DoubleArray(int(root.max()) + 1, n_symbols), int(length.max())
    live = [np.flatnonzero(length > d) for d in range(deepest)]
    state = root.copy()
    for d, rows in enumerate(live):
        own = symbol[offset[rows] + d]
        pair = np.unique(state[rows] * n_symbols + own)
        arrays.pack(pair // n_symbols, pair % n_symbols)
        state[rows] = arrays.step(state[rows], own)
    state, key, out = root.copy(), start.copy(), []
    for d, rows in enumerate(live):
        before, parent_key = state[rows], key[rows]
        state[rows] = arrays.step(before, symbol[offset[rows] + d])
        key[rows] ^= z[offset[rows] + d]
        node, first, inverse = np.unique(state[rows], return_index=True, return_inverse=True)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, conv[rows])
        at, above = rows[first], before[first] if d else np.full(len(node), -1)
        out.append(np.column_stack([np.full(len(node), shard), node, above, j[at], start[at], j[at] * block + d + 1, key[at], parent_key[first], words[offset[at] + d], np.bincount(inverse), least]))
    return dict(zip(_NODE, np.concatenate(out).T, strict=True))


_NODE = ["shard", "state", "above", "j", "s1", "s2", "depth", "k1", "k2", "p1", "p2", "words", "n", "conv_id"]


def packed(blocks: DataFrame, cut: Cut) -> DataFrame:
    """The nodes of every double array, _NODE: a node that several arrays share has a row from each.

    Blocks (conv_id, j, s1, s2, turns) are range-sorted by the prefix before them and their first turns, then id: a shard
    is a span of that order, and a prefix that a third of all conversations share is as many shards as its rows ask for.
    """
    let_workers_import(blocks.sparkSession)
    order = ["j", "s1", "s2", "head", "conv_id"]
    sharded = blocks.withColumn("head", F.transform(F.slice("turns", 1, cut.head), lambda t: t["a"]))
    sharded = sharded.repartitionByRange(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, turns = TaskContext.get().partitionId() << 32, [], 0

        def nodes() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: table.column(c).chunk(0)
            said = column("turns")
            of = lambda *names: np.column_stack([said.flatten().field(n).to_numpy() for n in names])
            length = np.diff(said.offsets.to_numpy())
            start = np.column_stack([column("s1").to_numpy(), column("s2").to_numpy()])
            made = trie_nodes(shard, cut.block, column("conv_id").to_numpy(), column("j").to_numpy(), start, length, np.ascontiguousarray(of("a", "b")), of("z1", "z2"), of("words")[:, 0])
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            ends = batch.column("turns").offsets.to_numpy()
            at = 0
            while at < len(batch):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + cut.chunk - turns, "right")) - 1)
                held.append(batch.slice(at, upto - at))
                turns += int(ends[upto] - ends[at])
                at = upto
                if turns >= cut.chunk or at < len(batch):
                    yield nodes()
                    shard, held, turns = shard + 1, [], 0
        if held:
            yield nodes()

    return sharded.drop("head").mapInArrow(build, ", ".join(f"{c} bigint" for c in _NODE))


def summed_up(nodes: pd.DataFrame) -> pd.DataFrame:
    """leaves and saved of each node of one double array, those below it added, level by level from the deepest."""
    nodes = nodes.sort_values("state")
    state, above, depth = (nodes[c].to_numpy() for c in ("state", "above", "depth"))
    value = nodes[["leaves", "saved"]].to_numpy(np.int64)
    parent = np.searchsorted(state, above)
    for rows in (np.flatnonzero((depth == d) & (above >= 0)) for d in np.unique(depth)[::-1]):
        np.add.at(value, parent[rows], value[rows])
    return nodes[KEY].assign(leaves=value[:, 0], saved=value[:, 1])


def totals(hubs: DataFrame) -> DataFrame:
    """(id, leaves, saved) of hubs (id, up, leaves, saved), each with all below it: pointers to ancestors are doubled, so rounds grow as the logarithm of the depth."""
    hubs = written(hubs, "hubs")
    while hubs.where("up is not null").take(1):
        below = hubs.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = hubs.select(F.col("id").alias("up"), F.col("up").alias("next"))
        after = hubs.join(below, "id", "left").join(further, "up", "left")
        after = written(after.select("id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "hubs")
        forget(hubs)
        hubs = after
    return hubs.select("id", "leaves", "saved")


def end_digests(ends: DataFrame, piece: int) -> DataFrame:
    """KEY and ends_sha256: the hash of the conv_ids (ends: KEY, conv_id), ascending and comma-joined, of each key.

    Ids are written out in pieces wherever they are; only these meet in one task, which hashes them one after the other
    as they come, so a key with a third of all conversations takes no memory, and a row for `piece` of them.
    """
    let_workers_import(ends.sparkSession)
    placed = running_total(ends, [*map(F.col, KEY), F.col("conv_id")], "at", name="ends", write=written)
    texts = placed.groupBy(*KEY, F.floor(F.col("at") / piece).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if own == key:
                    sha.update(b"," + ids.encode())
                else:
                    done += [] if key is None else [(*key, sha.hexdigest())]
                    key, sha = own, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*KEY, "ends_sha256"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, sha.hexdigest())], names=[*KEY, "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(n, *KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids").mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame, cut: Cut = Cut()) -> DataFrame:
    """The prefix trie of conversations, a row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, p, a, b, words), places p from 0 without gaps, a and b a hash of the turn; members: conv_id, those
    without turns too. A node is a distinct sequence of first turns, (conv_id, depth) its smallest member and length, so
    its text is the first depth turns of that conversation. n_convs counts members, n_leaves the childless nodes at or
    below it; saved_tokens sums (n_convs - 1) times the words of the last turn over the nodes at or below it;
    ends_sha256 is of the ids of the conversations that end there. The root has depth 0 and no parent.

    Conversations are cut into blocks of turns, blocks sharded by prefix, and each shard packs double arrays (packed).
    Nodes that arrays share are merged by key: counts add up, smallest ids are kept, and one array owns the node. What is
    summed over subtrees is then put to the owner's state only, summed up within each array, and added up by key: an
    ancestor of a node is in each array that the node is in, so nothing is lost or counted twice. Blocks that hang on
    others are hubs; their sums go up by pointer doubling first. No task holds more than a chunk of turns, a block, or a
    row for 512 ids, however long a conversation and however common a prefix is. No members: no rows.
    """
    spark = turns.sparkSession
    z = lambda *salt: F.xxhash64(*salt, "p", "a", "b")
    said = turns.withColumns({"z1": z(), "z2": z(F.lit("second")), "j": F.floor(F.col("p") / cut.block).cast("long")})
    each = F.sort_array(F.collect_list(F.struct("p", "a", "b", "z1", "z2", "words"))).alias("turns")
    blocks = written(said.groupBy("conv_id", "j").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.count("*").alias("length"), each), "blocks")
    thin = blocks.select("conv_id", "j", "x1", "x2", "length")
    upto = Window.partitionBy("conv_id").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    begun = thin.join(thin.where("j = 1").select("conv_id"), "conv_id", "left_semi").select("conv_id", "j", F.bit_xor("x1").over(upto).alias("s1"), F.bit_xor("x2").over(upto).alias("s2"))
    prefixed = blocks.select("conv_id", "j", "turns").join(begun, ["conv_id", "j"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("s1", "s2")})
    pieces = written(packed(prefixed, cut), "trie-nodes")

    merged = pieces.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), *(F.first(c).alias(c) for c in ("j", "s1", "s2", "p1", "p2")), F.min(F.struct("shard", "state")).alias("owner"))
    merged = written(merged, "merged-nodes")
    children = merged.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "nodes")

    hub = lambda *cols: F.struct(*[F.col(c).alias(k) for c, k in zip(cols, KEY, strict=True)])
    hung = nodes.where("j > 0").withColumn("top", F.col("j") * cut.block).groupBy(hub("top", "s1", "s2").alias("id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = nodes.withColumn("top", F.col("j") * cut.block).select(hub(*KEY).alias("id"), F.when(F.col("j") > 0, hub("top", "s1", "s2")).alias("up"))
    hung = totals(hung.join(up, "id")).select("id.*", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    own = nodes.join(hung, KEY, "left").select("owner.*", *((F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("leaves", "l"), ("saved", "s"))))
    spread = pieces.select("shard", "state", "above", *KEY).join(own, ["shard", "state"], "left").fillna(0, ["leaves", "saved"])
    sums = spread.groupBy("shard").applyInPandas(summed_up, "depth bigint, k1 bigint, k2 bigint, leaves bigint, saved bigint")  # a chunk of turns a group
    sums = sums.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    key0 = [F.lit(0).cast("long").alias(c) for c in KEY]
    top = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    whole = nodes.agg(F.coalesce(F.sum((F.col("depth") == 1).cast("long")), F.lit(0)).alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("l"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = top.crossJoin(F.broadcast(whole)).select(*key0, "n_convs", "conv_id", "n_children", F.greatest("l", F.lit(1)).alias("n_leaves"), "saved_tokens", *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])  # one row
    every = written(nodes.select(*KEY, "n_convs", "conv_id", "n_children", "p1", "p2").join(sums, KEY).unionByName(root), "all-nodes")
    parents = every.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    related = salted_join(every, parents, ["depth", "p1", "p2"], "left")
    last = thin.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"), F.sum("length").alias("depth"))
    ends = members.join(last, "conv_id", "left").select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in KEY], "conv_id")
    out = related.join(settled(spark, lambda: end_digests(ends, cut.piece), "end-digests"), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, cut: Cut = Cut()) -> DataFrame:
    """trie of conversations (conv_id, turn, role, text) as they are. Null turns go first, null roles and texts are empty; other columns are not read; repeated rows are turns of their own; texts count whole."""
    turns, members = positioned(conversations)
    return settled(conversations.sparkSession, lambda: trie(turns, members, cut), "trie")
