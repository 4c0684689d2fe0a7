"""SimHash near-dedup on shingles: ball hashing and an exact cover propose pairs of documents, shingle similarity decides.

What the stars of the proposals leave out between different groups is met by the rarest shingles, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastframe.llm.common import WordHashes, forget, let_workers_import, salted_join, settled, sliced, with_text_columns, written
from pastframe.llm.components import connected_components

#: Words of a shingle, and the share of all shingles of two documents that must be in both.
SHINGLE, LEAST = 5, 0.8
#: So many fingerprints of so many bits, over pairs of words: an edit touches two pairs but five shingles, so a fingerprint
#: of pairs of words stays near where one of shingles would not. Documents meet where one of the fingerprints differs in
#: 2 bits or fewer; each emits the variants within half of that. They see close copies; what they miss, the cover sees.
FINGERPRINTS, BITS = 2, 48
#: Largest sizes of the classes of shingle sets: up to the first, sets are near only if they are equal, and two sets that
#: are near are of one class or of neighbouring ones, as each is at least 1 / LEAST times STEP as large as the one before.
STEP = LEAST**-2
CLASSES = [4]
while CLASSES[-1] < 1 << 40:
    CLASSES.append(int(CLASSES[-1] * STEP))
#: Parts over those that pigeons need: a share of them, and some.
SLACK, MORE = 0.04, 3
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.array([2 * k * k * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F & (1 << 64) - 1 | 1 for k in range(1, -(-FINGERPRINTS * BITS // 64) + 1)], np.uint64)


def word_hashes() -> WordHashes:
    return WordHashes(lambda w: xxhash.xxh64_intdigest(w, 17))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of each run of k words; of fewer words, of all of them."""
    k = min(k, len(h))
    if not k:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : j + len(acc)]) * _MUL
        acc ^= acc >> np.uint64(31)
    return np.unique(acc)


def words_of(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words, split at \\x20 and \\x09-\\x0D, with A-Z in lower case."""
    return np.fromiter(map(hashes.__getitem__, text.encode("utf-8", "surrogatepass").lower().split()), np.uint64)


def fingerprints(pairs: np.ndarray) -> np.ndarray:
    """FINGERPRINTS numbers of BITS bits: each bit is set if it is in more than half of the word pairs' hashes."""
    ones = np.zeros(FINGERPRINTS * BITS, np.int64)
    for at in range(0, len(pairs), 255 * 32):  # a byte counts up to 255
        x = pairs[at : at + 255 * 32, None] * _MIX
        x ^= x >> np.uint64(32)
        bits = np.unpackbits((x * _MUL).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):
            ones += bits[i : i + 255, : len(ones)].sum(0, dtype=np.uint8)
    own = np.packbits((2 * ones > len(pairs)).reshape(FINGERPRINTS, BITS), axis=1, bitorder="little")
    return np.pad(own, ((0, 0), (0, 2))).view("<u8")[:, 0].astype(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> np.uint64(29))


def cover(grams: np.ndarray, slack: float = SLACK, more: int = MORE) -> np.ndarray:
    """64-bit codes of a set of distinct shingle hashes: two sets of a similarity of LEAST or more, unless equal and small, share one.

    Sets of sizes s and t that are near differ in (s + t)(1 - LEAST) / (1 + LEAST) shingles or fewer. Where the larger is in
    a class of largest size u, that is 2u/9 or fewer, so if hashes are dealt to more parts than that, some part is the same
    in both. Its code stands for all of its shingles, four or five as a rule: texts that only share a common phrase don't
    meet. A part that is empty in both says nothing, so there are some parts more than that; a set with as many empty ones
    as could matter gives the codes of its smallest hashes too, one more than a near set may lack: of two such sets that are
    near, those share one. A set goes by the parts of its own class, and of the next if a near set can be in it.
    """
    n, out = len(grams), []
    own = int(np.searchsorted(CLASSES, n))
    for k in (own, own + 1):
        most = min(CLASSES[k], int(n / LEAST + 1e-9))  # the largest near set that this class is for
        if not k or not n or (k > own and most <= CLASSES[own]):
            continue
        differ = lambda a, b: int((a + b) * (1 - LEAST) / (1 + LEAST) + 1e-9)
        parts = differ(CLASSES[k], CLASSES[k])
        parts += 1 + int(parts * slack) + more
        part = (grams % np.uint64(parts)).astype(np.int64)
        code, size = np.zeros(parts, np.uint64), np.bincount(part, minlength=parts)
        np.add.at(code, part, grams)
        code = _mixed(code + np.arange(parts, dtype=np.uint64) * _MUL + np.uint64(k))
        out.append(code[size > 0])
        if (size == 0).sum() >= parts - differ(n, most):
            out.append(_mixed(~grams[: n - int(np.ceil(LEAST * n - 1e-9)) + 1] + np.uint64(k)))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def marks(grams: np.ndarray) -> np.ndarray:
    """Whether shingles are odd in number, by as many residues of their hashes as there are shingles or up to twice as many: a power of two of longs.

    Where two sets differ here, they differ in another shingle for each. The half of more residues is the one half xor the other.
    """
    n = 64 << max(0, int(len(grams) - 1).bit_length() - 6)
    odd = np.bincount((_mixed(grams) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def with_sketch(df: DataFrame, text_col: str) -> DataFrame:
    """df without its text, but with ka and kb, 128 bits that equal sets of shingles share, the fingerprints, fps, the codes of the cover, the number n of shingles and their marks."""

    def made(texts: list[str], hashes: WordHashes) -> list[pa.Array]:
        keys, fps, codes, sizes, odd = [], [], [], [], []
        for t in texts:
            h = words_of(t, hashes)
            grams = runs(h, SHINGLE)
            keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
            fps.append(fingerprints(runs(h, 2)))
            codes.append(cover(grams))
            sizes.append(len(grams))
            odd.append(marks(grams))
        k = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
        return [pa.array(k[:, 0]), pa.array(k[:, 1]), *(pa.array(x, pa.list_(pa.int64())) for x in (fps, codes)), pa.array(sizes, pa.int64()), pa.array(odd, pa.list_(pa.int64()))]

    longs = lambda name: (name, "array<bigint>", pa.list_(pa.int64()))
    outputs = [("ka", "bigint", pa.int64()), ("kb", "bigint", pa.int64()), longs("fps"), longs("codes"), ("n", "bigint", pa.int64()), longs("marks")]
    return with_text_columns(df, text_col, outputs, made, word_hashes, keep_text=False)


def in_balls(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, ka, kb, fps) that meet by a fingerprint, in either order, repeated.

    Nodes of one fingerprint link to the first of them; fingerprints emit the variants within one bit, and those that
    share a variant, which are BITS + 1 at most, link to the first of them: stars, whose size is linear in the group.
    Pairs that no star holds are left to the cover and to unmet().
    First is the smallest of one half of the keys for even fingerprints and of the other for odd ones, so that most
    groups are told from two sides.
    """
    f = nodes.select("node", "ka", "kb", F.posexplode("fps").alias("j", "f"))
    half = lambda k: F.shiftright(k, 32).cast("int")  # noqa: E731  random enough, and half to shuffle
    f = f.select("node", F.when(F.col("j") % 2 == 0, half("ka")).otherwise(half("kb")).alias("rank"), F.shiftleft(F.col("j").cast("bigint"), BITS).bitwiseOR(F.col("f")).alias("code"))
    lead = written(f.groupBy("code").agg(F.min(F.struct("rank", "node")).alias("lead"), F.count("*").alias("n")), "leads")
    own = salted_join(f.select("code", "node"), lead.where("n > 1").select("code", F.col("lead.node").alias("a")), ["code"]).select("a", F.col("node").alias("b"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lead.repartition(n, F.xxhash64(F.lit("spread"), "code"))
    masks = F.lit([0, *(1 << i for i in range(BITS))])
    v = spread.select(F.col("lead.rank").alias("rank"), F.col("lead.node").alias("b"), F.explode(F.transform(masks, lambda m: F.col("code").bitwiseXOR(m))).alias("variant"))
    met = v.select("b", F.first("b").over(Window.partitionBy("variant").orderBy("rank", "b")).alias("a")).select("a", "b")
    return own.unionByName(met)


#: A code of more than this share of the nodes is known to be shared without a shuffle, judged by a sample of so many nodes.
HOT, SAMPLE = 1 / 500, 20_000


def shared_codes(nodes: DataFrame) -> DataFrame:
    """(node, code, size) of nodes (node, codes): the codes that another node has too, size the number of all codes of the node.

    Codes of many nodes, as a sample tells, stay where they are: no task gathers their nodes. Whatever the sample says, the
    rows are the same.
    """
    codes = nodes.select("node", F.size("codes").alias("size"), F.explode("codes").alias("code"))
    some = written(nodes.sample(min(1.0, SAMPLE / max(nodes.count(), 1)), seed=7).select("codes"), "code-sample")
    often = some.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("c")).where(F.col("c") > max(HOT * some.count(), 20))
    often = written(often.select("code"), "hot-codes")
    rest = codes.join(often, "code", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("code"))).where("n > 1")
    return codes.join(often, "code").select("node", "code", "size").unionByName(rest.select("node", "code", "size"))


def in_cover(shared: DataFrame) -> DataFrame:
    """(a, b) of shared codes (node, code, size), in either order, repeated: all nodes of a code link to the most central one.

    That is the one of which the largest share of codes is shared: a text that others are versions of shares nearly all,
    and a version doesn't share what is its own. Counts and choices are made with partial aggregation.
    """
    share = shared.groupBy("node").agg((F.count("*") / F.first("size")).alias("share"))
    lead = shared.join(share, "node").groupBy("code").agg(F.max(F.struct("share", "node"))["node"].alias("a"))
    return shared.join(lead, "code").select("a", F.col("node").alias("b"))


def candidates(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, ka, kb, fps) and their shared codes that may be near, each pair once."""
    both = in_balls(nodes).unionByName(in_cover(shared)).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of pairs (a, b) that may be near by the numbers and marks of their shingles (node, n, marks): all that are near, and few others.

    Sets that are near differ in (na + nb)(1 - LEAST) / (1 + LEAST) shingles or fewer, so in no more marks, and in size by no more.
    """
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("marks").alias(f"m{c}"))
    both = salted_join(salted_join(pairs, side("a"), ["a"]), side("b"), ["b"])
    most = (F.col("na") + F.col("nb")) * (1 - LEAST) / (1 + LEAST) + 1e-6
    both = both.where(F.abs(F.col("na") - F.col("nb")) <= most)

    def halved(x: str, y: str):
        k = (F.size(x) / 2).cast("int")
        half = F.zip_with(F.slice(x, 1, F.greatest(k, F.lit(1))), F.slice(x, k + 1, F.greatest(k, F.lit(1))), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(y), half).otherwise(F.col(x))

    differ = F.zip_with(halved("ma", "mb"), halved("mb", "ma"), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("bigint"))
    return both.where(F.aggregate(differ, F.lit(0).cast("bigint"), lambda t, x: t + x) <= most).select(*pairs.columns)


def _shingles(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (at, node, more) with grams, the hashes of the distinct shingles of the row of docs (at, text), in 32 bits, in place of at."""
    rows = docs.select("at", "text").join(asked, "at").dropDuplicates(["at"]).drop("at")  # by at, as they were dealt for the join
    let_workers_import(rows.sparkSession)
    keys = [c for c in rows.columns if c != "text"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for whole in batches:
            for b in sliced(whole, "text"):
                grams = [np.unique((runs(words_of(t or "", hashes), SHINGLE) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(grams, pa.list_(pa.int32()))], names=[*keys, "grams"])
            pa.default_memory_pool().release_unused()  # else idle workers hold it

    return rows.mapInArrow(made, ", ".join([*(f"{c} bigint" for c in keys), "grams array<int>"]))


def near(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The rows of pairs (a, b) whose similarity is LEAST or more."""
    side = lambda c: grams.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}"))
    both = salted_join(salted_join(pairs, side("a"), ["a"]), side("b"), ["b"])
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared >= LEAST * (F.size("ga") + F.size("gb") - shared)).select(*pairs.columns)


#: How common shingles are is judged by so many nodes, and kept for so many shingles at most: the rest count as rare.
COMMON_SAMPLE, COMMON_MOST = 10_000, 100_000
#: Nodes of a code that are compared each with each; those of codes of more nodes meet by their rarest shingles.
FEW = 16


def open_codes(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(code, n, node, comp) of the codes that leave anything open: the stars have compared all nodes of a code with one of them.

    So these have three or more nodes, in more than one component; n is how many, and comp is the node itself if it has none.
    """
    placed = shared.select("node", "code").join(comp, "node", "left").select("node", "code", F.coalesce("component", "node").alias("comp"))
    placed = written(placed, "placed-codes")
    several = placed.groupBy("code").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("n > 2 and lo < hi")
    found = written(salted_join(placed, several.select("code", "n"), ["code"]).select("code", "n", "node", "comp"), "open-codes")
    forget(placed)
    return found


def rarest(grams: DataFrame) -> DataFrame:
    """(node, comp, size, rare) of nodes with their shingles (node, comp, grams): its rarest shingles, one more than a near set may lack, the rarest first.

    The order is one for all sets, so two sets that are near share one of these. It goes by counts in a sample; whatever
    the sample says, no pair is lost, only more of them have to be compared.
    """
    some = grams.sample(min(1.0, COMMON_SAMPLE / max(grams.count(), 1)), seed=7)
    counts = some.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    known = counts.orderBy(F.desc("c"), "g").limit(COMMON_MOST).toArrow()  # bounded, whatever the table
    by = np.argsort(known["g"].to_numpy())
    common = grams.sparkSession.sparkContext.broadcast((known["g"].to_numpy()[by].astype(np.int32), known["c"].to_numpy()[by]))
    let_workers_import(grams.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = common.value
        for b in batches:
            rare, sizes = [], []
            for g in b.column("grams"):
                g = g.values.to_numpy(zero_copy_only=False)
                n, c = len(g), np.zeros(len(g), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, g), len(names) - 1)
                    c = np.where(names[at] == g, counts[at], 0)
                rare.append(g[np.lexsort((g, c))[: n - int(np.ceil(LEAST * n - 1e-9)) + 1]])
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("comp"), pa.array(sizes, pa.int32()), pa.array(rare, pa.list_(pa.int32()))], names=["node", "comp", "size", "rare"])
            del b, rare
            pa.default_memory_pool().release_unused()

    return grams.select("node", "comp", "grams").mapInArrow(made, "node bigint, comp bigint, size int, rare array<int>")


def unmet(shared: DataFrame, grams: DataFrame | Callable[[DataFrame], DataFrame], comp: DataFrame) -> DataFrame:
    """(a, b, ca, cb): the pairs of nodes of different components, ca and cb, that may be near, each pair once.

    grams: (node, grams), or what makes (node, comp, grams) of the nodes (node, comp) that are asked for.
    The nodes of a code of up to FEW are compared each with each. Those of larger codes meet by their rarest shingles, so that
    a passage that is common brings none together. A set's place in the
    order tells how many shingles it can still share with another, and pairs for which that isn't enough are not made.
    Of a shingle, only nodes outside of its largest component are met with the others: a crowd that is one group already
    makes no pairs.
    """
    opened = open_codes(shared, comp)
    few = opened.where(F.col("n") <= FEW)
    few = few.select("code", F.col("node").alias("a"), F.col("comp").alias("ca")).join(few.select("code", F.col("node").alias("b"), F.col("comp").alias("cb")), "code")
    few = few.where("a < b and ca <> cb").select("a", "b", "ca", "cb")
    many = written(opened.where(F.col("n") > FEW).select("node", "comp").distinct(), "open-nodes")
    if not many.take(1):
        return few.distinct()
    x = written(rarest(grams(many) if callable(grams) else grams.join(many, "node")), "rarest")
    x = x.select("node", "comp", "size", F.posexplode("rare").alias("at", "gram"))
    several = x.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gram")
    x = written(salted_join(x, written(several, "open-shingles"), ["gram"]), "meetings")
    most = x.groupBy("gram", "comp").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"))
    x = written(salted_join(x, most, ["gram"]), "meetings")
    side = lambda c: [F.col("node").alias(c), F.col("comp").alias(f"c{c}"), F.col("size").alias(f"s{c}"), (F.col("size") - F.col("at")).alias(f"left_{c}")]
    both = salted_join(x.select("gram", "most", *side("a")), x.where("comp <> most").select("gram", *side("b")), ["gram"])
    enough = F.least("left_a", "left_b") * (1 + LEAST) >= LEAST * (F.col("sa") + F.col("sb")) - 1e-9
    both = both.where((F.col("ca") != F.col("cb")) & ((F.col("ca") == F.col("most")) | (F.col("a") < F.col("b"))) & enough)
    met = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("ca", "cb"), ("cb", "ca"))))
    return few.unionByName(met).distinct()


def near_groups(docs: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, component) for every node with a near one; component is the smallest node that links reach.

    docs: at, text; nodes: node, at (the row that stands for it), ka, kb, fps, n, marks; shared: their shared_codes.
    """

    def decided(pairs: DataFrame) -> DataFrame:
        pairs = written(plausible(pairs, nodes), "plausible")
        asked = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "at"), "node"), "asked")
        return near(pairs, written(_shingles(docs, asked), "shingles"))

    def shingles(some: DataFrame) -> DataFrame:
        return written(_shingles(docs, some.join(nodes.select("node", "at"), "node")), "open-shingle-sets")

    comp = settled(nodes.sparkSession, lambda: connected_components(decided(written(candidates(nodes, shared), "candidates"))), "components")
    left = settled(nodes.sparkSession, lambda: decided(settled(nodes.sparkSession, lambda: unmet(shared, shingles, comp), "unmet")), "links")
    if not left.take(1):
        return comp
    up = written(connected_components(left, "ca", "cb").toDF("component", "up"), "joined-components")
    met = comp.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    alone = up.select(F.col("component").alias("node"), F.col("up").alias("component")).join(comp, "node", "left_anti")
    return met.unionByName(alone)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies in df: that of the smallest id, null ids last; of those the row of smallest hash.

    Near copies share LEAST of their distinct shingles of SHINGLE words or more; groups are what such links reach.
    Documents of equal shingles are one node from the start, so copies cost a row each and no pair. Two nodes that are near
    always meet (cover), and whether a pair links is decided by its shingles alone. In a crowd of near copies nodes are
    compared with the most central node of each code that they have, then those of different groups with each other
    (unmet): no link between groups is missed. Groups go by texts alone: rows that share an
    id, or have none, but whose texts aren't near stay apart. Null texts count as empty, and empty ones are copies of each
    other. Very long texts count whole. Other columns pass through, whatever their names. An empty table gives no rows.
    """
    row = F.struct(*[f(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]) for f in (F.xxhash64, lambda *c: F.xxhash64(F.lit("second"), *c))])
    docs = df.select(F.col(f"`{id_col}`").alias("id"), row.alias("at"), F.col(f"`{text_col}`").alias("text"))
    spark = df.sparkSession
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("least")
    sketch = written(with_sketch(docs, "text"), "sketches")
    repeated = written(sketch.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select(F.col("at").alias("__at")), "repeated")  # rows that are repeated whole
    nodes = sketch.groupBy("ka", "kb").agg(least, *(F.first(c).alias(c) for c in ("fps", "codes", "n", "marks")))
    coded = written(nodes.select(F.monotonically_increasing_id().alias("node"), "ka", "kb", "fps", "codes", "n", "marks", "least", F.col("least.at").alias("at")), "coded")
    forget(sketch)
    shared = settled(spark, lambda: shared_codes(coded), "shared-codes")
    nodes = written(coded.drop("codes"), "nodes")  # codes are as large as the texts: they go once they have met
    forget(coded)

    def survivors() -> DataFrame:
        comp = settled(spark, lambda: near_groups(docs, nodes, shared), "components")
        linked = nodes.join(comp, "node", "left").select("component", "least")
        alone = linked.where("component is null").select("least")
        first = alone.unionByName(linked.where("component is not null").groupBy("component").agg(F.min("least").alias("least")).select("least"))
        return first.select(F.col("least.at").alias("__at"))

    first = settled(spark, survivors, "survivors")
    forget(nodes)
    forget(shared)
    marked = df.withColumn("__at", row).join(first, "__at", "left_semi")
    once = marked.join(repeated, "__at", "left_anti").drop("__at")
    more = marked.join(repeated, "__at", "left_semi")
    return once.unionByName(more.dropDuplicates(["__at"]).drop("__at"))
