"""Near copies of a similarity of 0.8 or more: the cover meets every pair, alone and in crowds."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastframe.llm import near_copies

POOL = [f"{a}{b}{c}" for a in "bdfgklmnprstv" for b in "aeiou" for c in "nrstlm"]


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def edited(rng, words, kind, low, high):
    """words with edits of a kind, of a similarity from low to high to the words before."""
    for n in range(1, 4 * len(words)):
        new = list(words)
        at = int(rng.integers(len(new)))
        size = max(1, n // 2)
        for k in range(size):
            i = int(rng.integers(len(new))) if kind == "scattered" else (at + k) % len(new) if kind == "block" else at
            if kind == "insert":
                new.insert(at, str(rng.choice(POOL)))
            else:
                new[i] = str(rng.choice(POOL))
        if similarity(words, new) < low:
            return None
        if similarity(words, new) <= high:
            return new
    return None


@pytest.mark.parametrize("slack", [(near_copies.SLACK, near_copies.MORE), (0, 0)])
def test_sets_that_are_near_share_a_code(slack):
    rng = np.random.default_rng(5)
    tried = 0
    while tried < 3000:
        n = int(np.exp(rng.uniform(np.log(4), np.log(1500))))
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        more = int(rng.integers(0, n // 4 + 1))
        both = int(rng.integers(int(np.ceil(0.8 * (n + more) - 1e-9)), n + 1)) if 0.8 * (n + more) <= n else n + 1
        if both > n or (both == n and not more):
            continue
        y = np.unique(np.r_[rng.permutation(x)[:both], rng.integers(0, 1 << 64, more, dtype=np.uint64)])
        assert len(np.intersect1d(near_copies.cover(x, *slack), near_copies.cover(y, *slack)))
        tried += 1


def pairs_of(rng, n, low, high):
    out = []
    while len(out) < n:
        words = [str(w) for w in rng.choice(POOL, int(rng.integers(12, 500)))]
        kind = ("scattered", "block", "insert")[len(out) % 3]
        if (new := edited(rng, words, kind, low, high)) is not None and new != words:
            out.append((words, new))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, " ".join(t), len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").withColumns({"codes": F.lit("x"), "node": F.lit(1)})


def test_no_pair_from_0_80_is_missed_and_none_below_is_dropped(spark):
    rng = np.random.default_rng(2)
    near, far = pairs_of(rng, 240, 0.8, 0.86), pairs_of(rng, 60, 0.7, 0.7999)
    texts = [t for pair in near + far for t in pair]
    kept = {r.doc_id for r in near_copies.drop_near_copies(frame(spark, texts)).collect()}
    assert kept == set(range(0, len(texts), 2)) | set(range(2 * len(near) + 1, len(texts), 2))


def groups(texts):
    """How many groups the texts make, by all pairs."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    by = {}
    for i, x in enumerate(sets):
        for g in x:
            by.setdefault(g, []).append(i)
    for i, x in enumerate(sets):
        for j in {j for g in x for j in by[g] if j > i}:
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    return sum(root[i] == i for i in range(len(texts)))


def test_crowds_of_near_copies(spark):
    """Versions of one text, versions of versions, and drafts that drift, each near the one before only."""
    rng, texts = np.random.default_rng(3), []
    for kind in ("scattered", "block"):
        for how in ("star", "tree", "drift"):
            own = [[str(w) for w in rng.choice(POOL, 200)]]
            while len(own) < 60:
                before = own[0 if how == "star" else -1 if how == "drift" else int(rng.integers(len(own)))]
                if (new := edited(rng, before, kind, 0.8, 0.88)) is not None:
                    own.append(new)
            texts += own
    order = rng.permutation(len(texts))
    kept = near_copies.drop_near_copies(frame(spark, [texts[i] for i in order]).repartition(3)).count()
    assert kept - groups(texts) <= 0.02 * len(texts), (kept, groups(texts))


def test_no_link_of_a_crowd_is_missed(spark):
    """Short texts near the threshold: some are near to none of the central ones. Stars alone left 31 groups of 6."""
    rng, texts = np.random.default_rng(13), []
    for kind in ("scattered", "block"):
        for how in ("star", "tree", "drift"):
            own = [[str(w) for w in rng.choice(POOL, 60)]]
            while len(own) < 120:
                before = own[0 if how == "star" else -1 if how == "drift" else int(rng.integers(len(own)))]
                if (new := edited(rng, before, kind, 0.8, 0.82)) is not None:
                    own.append(new)
            texts += own
    order = rng.permutation(len(texts))
    kept = near_copies.drop_near_copies(frame(spark, [texts[i] for i in order]).repartition(3)).count()
    assert kept == groups(texts)


def test_common_shingles_make_no_pairs(spark):
    """Half of every text is one passage: texts meet by what is rare in them, and the near ones among them are found."""
    rng = np.random.default_rng(6)
    passage = [str(w) for w in rng.choice(POOL, 60)]
    texts = [passage + [str(w) for w in rng.choice(POOL, 60)] for _ in range(300)]
    texts += [t[:-3] + [str(w) for w in rng.choice(POOL, 3)] for t in texts[:20]]
    nodes = [(i, i, sorted(zlib.crc32(" ".join(g).encode()) & 0x7FFFFFFF for g in grams(t))) for i, t in enumerate(texts)]
    table = spark.createDataFrame(nodes, "node long, comp long, grams array<int>")
    shared = spark.createDataFrame([(i, 1, 1) for i in range(len(texts))], "node long, code long, size int")
    comp = spark.createDataFrame([], "node long, component long")
    met = {(min(r.a, r.b), max(r.a, r.b)) for r in near_copies.unmet(shared, table.drop("comp"), comp).collect()}
    assert met == {(i, 300 + i) for i in range(20)}


def test_common_codes_are_linked_like_others(spark):
    """The sample decides how shared codes are found, never which."""
    rng = np.random.default_rng(4)
    rows = [(i, [int(c) for c in {1, 2, *rng.integers(3, 900, 4)}]) for i in range(400)]
    nodes = spark.createDataFrame(rows, "node long, codes array<long>")
    want = {(n, c) for n, cs in rows for c in cs if sum(c in x for _, x in rows) > 1}
    for hot in (near_copies.HOT, 2.0):
        was, near_copies.HOT = near_copies.HOT, hot
        try:
            assert {(r.node, r.code) for r in near_copies.shared_codes(nodes).collect()} == want
        finally:
            near_copies.HOT = was


def test_marks_leave_all_near_pairs_and_few_others(spark):
    """Texts that only share a passage aren't compared by their shingles; of near sets, also of other sizes of marks, none is lost."""
    rng = np.random.default_rng(8)
    sets, near, far = [], [], []
    for _ in range(300):
        n = int(np.exp(rng.uniform(np.log(2), np.log(1500))))
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for more in {0, int(n / 4), int(rng.integers(0, n // 4 + 1))}:
            both = int(np.ceil(0.8 * (n + more) - 1e-9))
            if both <= n:
                near.append((len(sets), len(sets) + 1))
                sets += [x, np.unique(np.r_[rng.permutation(x)[:both], rng.integers(0, 1 << 64, more, dtype=np.uint64)])]
    passage = rng.integers(0, 1 << 64, 20, dtype=np.uint64)
    for n in (60, 130, 250, 600, 1400) * 20:
        far.append((len(sets), len(sets) + 1))
        sets += [np.unique(np.r_[passage, rng.integers(0, 1 << 64, int(n * f), dtype=np.uint64)]) for f in (1, rng.uniform(0.9, 1.1))]
    nodes = spark.createDataFrame([(i, len(x), near_copies.marks(x).tolist()) for i, x in enumerate(sets)], "node long, n long, marks array<long>")
    pairs = spark.createDataFrame([*near, *((b, a) for a, b in near), *far], "a long, b long")
    left = {(r.a, r.b) for r in near_copies.plausible(pairs, nodes).collect()}
    assert left >= {*near, *((b, a) for a, b in near)}
    assert len(left & set(far)) <= 2


def test_texts_do_not_go_with_their_codes(spark):
    """The codes are about as large as the texts; with both, a table and a shuffle of it, the disk went over four times the input."""
    got = near_copies.with_sketch(frame(spark, [["a", "b"]]).select("doc_id", "text"), "text")
    assert got.columns == ["doc_id", "ka", "kb", "fps", "codes", "n", "marks"]


@pytest.mark.parametrize("few", [2, 10_000])
def test_open_codes_of_any_size_lose_no_link(spark, monkeypatch, few):
    """Each with each, or by the rarest shingles: both find what the stars left."""
    monkeypatch.setattr(near_copies, "FEW", few)
    rng, texts = np.random.default_rng(14), []
    for kind in ("scattered", "block"):
        own = [[str(w) for w in rng.choice(POOL, 60)]]
        while len(own) < 80:
            if (new := edited(rng, own[int(rng.integers(len(own)))], kind, 0.8, 0.82)) is not None:
                own.append(new)
        texts += own
    assert near_copies.drop_near_copies(frame(spark, texts).repartition(3)).count() == groups(texts)


def test_words_are_those_of_the_contract():
    assert re.findall(r"[^\x20\x09-\x0D]+", "A b\tc") == ["A b", "c"]
