"""Operators 11 to 13 against plain versions, on small tables with nulls, ties, repeated rows, long texts and hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pastframe.llm import conversation_trie as ct
from pastframe.llm import lexical, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TALK = "conv_id long, turn long, role string, text string"


def plain_trie(conversations, reopen):
    by = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(rows)] for c, rows in by.items()}
    if reopen:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: h[c]] + rows[h[c] :] for c, rows in own.items()}
    through, ends = defaultdict(list), defaultdict(list)
    for c, rows in own.items():
        ends[tuple(rows)].append(c)
        for d in range(len(rows) + 1):
            through[tuple(rows[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in through if k), Counter(), Counter()
    for k, cs in through.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(cs) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, ())))).encode()).hexdigest()
    return sorted((min(cs), len(k), min(through[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k], digest(k)) for k, cs in through.items())


def talks(seed, n):
    """Conversations over few turns, so that they share prefixes of any length; some long, some copies, some ids of a span without its first."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(4 * n), n):
        opening = [rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))]
        rows += [(c, i, "user", f"{w} said  {w}\n") for i, w in enumerate(opening)]
    for c in range(1000, 1000 + n):  # a group of copies, of which some go on
        rows += [(c, i, "user", "copy") for i in range(13)] + [(c, 13 + i, "assistant", "more") for i in range(c % 3)]
    rows += [(5000, i % 40, "user", rng.choice("xy")) for i in range(300)]  # one long, with turns of one number
    rows += [(5001, None, None, None), (5001, 2, "user", ""), (5001, None, "user", "a"), (None, 1, "user", "nobody")]
    return rows + [(5002, 1, "user", "twice")] * 3


@pytest.mark.parametrize("cut", [ct.Cut(), ct.Cut(block=2, chunk=9, piece=2), ct.Cut(block=7, chunk=40, piece=3)])
def test_trie_is_the_plain_one(spark, cut):
    rows = talks(1, 30)
    df = spark.createDataFrame(rows, TALK).withColumns({"words": mixing.F.lit(1), "depth": mixing.F.lit("x")}).repartition(5)
    assert sorted(map(tuple, ct.conversation_trie(df, cut).collect()), key=lambda r: r[:2]) == plain_trie(rows, False)
    again = ct.trie(*ct.reopened(*ct.positioned(df)), cut)
    assert sorted(map(tuple, again.collect()), key=lambda r: r[:2]) == plain_trie(rows, True)


def test_trie_edges(spark):
    none = ct.conversation_trie(spark.createDataFrame([], TALK))
    assert none.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split() and not none.take(1)
    rows = [(c, t, "user", "x " * 200_000 if t == 1 else "same") for c in (3, 19) for t in range(2)]
    df = spark.createDataFrame(rows, TALK)
    got = sorted(map(tuple, ct.trie(*ct.reopened(*ct.positioned(df))).collect()), key=lambda r: r[:2])
    assert got == plain_trie(rows, True) and any(zlib.crc32(str(c).encode()) % 4 >= 2 for c in (3, 19))  # one is left without a turn


def test_double_array_holds_what_was_packed():
    rng = np.random.default_rng(0)
    arrays, at, known = ct.DoubleArray(3, 500), np.arange(3), {}
    for _ in range(6):
        pairs = np.unique(np.column_stack([rng.choice(at, 200), rng.integers(0, 500, 200)]), axis=0)
        arrays.pack(pairs[:, 0], pairs[:, 1])
        at = arrays.step(pairs[:, 0], pairs[:, 1])
        assert (at >= 0).all() and len(set(at.tolist())) == len(at) and not set(at.tolist()) & set(known)
        known |= dict(zip(at.tolist(), map(tuple, pairs.tolist()), strict=True))
    every = np.array(list(known))
    for symbol in rng.integers(0, 500, 20):
        to = arrays.step(every, np.full(len(every), symbol))
        assert [known.get(t) if t >= 0 else None for t in to.tolist()] == [(s, int(symbol)) if (s, int(symbol)) in known.values() else None for s in every.tolist()]


DOCS = "doc_id long, text string, source string"


def plain_mix(docs, weights=(5, 2, 1), repeats=3):
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    key = lambda s: (s is None, (s or "").encode())
    sources = sorted({s for _, _, s in docs}, key=key)
    total = {s: sum(n for n, (_, _, x) in zip(size, docs, strict=True) if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:  # the excess is shared anew until none is above
        rest = sum(total.values()) - sum(repeats * total[s] for s in capped)
        level = rest / max(sum(weight[s] for s in sources if s not in capped), 1)
        target = {s: float(repeats * total[s]) if s in capped else level * weight[s] for s in sources}
        if not (over := {s for s in sources if s not in capped and target[s] > repeats * total[s]}):
            return size, total, target
        capped |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 3, 40, 200]))), rng.choice(["s1"] * 12 + ["s2", "é", "s10", "𝔘", None, ""])) for i in range(600)]
    docs += [(None, "no id", "s2"), (None, None, None), (7000, "x\t\n y " * 4000, "s10")] + [(8000, "the same row", "s2")] * 9
    df = spark.createDataFrame(docs, DOCS).withColumns({"size": mixing.F.lit("x"), "n": mixing.F.lit(1)})
    got = mixing.mixed(df, bin_rows=16).collect()
    size, total, target = plain_mix(docs)
    assert sorted((r.doc_id or -1, r["size"], r.source or "", r.source_size) for r in got) == sorted((d or -1, n, s or "", total[s]) for (d, _, s), n in zip(docs, size, strict=True))
    for s in total:
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-12, abs_tol=1e-9) for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert all(r["size"] * 3 >= r.taken >= 0 and r.taken % max(r["size"], 1) == 0 and (r.first_at is None) == (r.taken == 0) for r in own)
    again = mixing.mixed(df.repartition(7), bin_rows=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, got))  # bins decide where rows go, never the order


def test_mix_is_one_sequence(spark):
    docs = [(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(200)]
    mix = mixing.sequence(mixing.queued(spark.createDataFrame(docs, DOCS))).orderBy("at").collect()
    assert [r["at"] for r in mix] == list(np.cumsum([0, *(r["size"] for r in mix)])[:-1])
    assert [r.finish for r in mix] == sorted(r.finish for r in mix)
    half = mix[len(mix) // 2]  # at any time each source has its share
    for s in {r.source for r in mix}:
        had = sum(r["size"] for r in mix if r.source == s and r["at"] < half["at"])
        assert abs(had - next(r.target for r in mix if r.source == s) * half.finish) <= 5


def test_mix_by_a_table_of_weights(spark):
    docs = spark.createDataFrame([(i, "a b c", "kept" if i % 2 else "other" if i % 3 else "out") for i in range(60)], DOCS)
    got = mixing.mixed(docs, spark.createDataFrame([("kept", 1), ("other", 3)], "source string, weight long"), budget=100).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert set(taken) == {"kept", "other"} and abs(taken["kept"] - 25) <= 2 and abs(taken["other"] - 75) <= 2


def test_mix_edges(spark):
    assert not mixing.mixed(spark.createDataFrame([], DOCS)).take(1)
    empty = mixing.mixed(spark.createDataFrame([(1, "", "a"), (2, None, None)], DOCS)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken, r.first_at) for r in empty) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]


def plain_search(docs, items, k=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(lexical.TERM, (t or "").translate(fold))
    told = [(d, Counter(x), len(x)) for d, x in ((d, terms(t)) for d, t in docs) if x]
    n_docs, all_terms = len(told), sum(n for _, _, n in told)
    df = Counter(t for _, tf, _ in told for t in tf)
    out = []
    for item, text in items:
        own, scores = terms(text), []
        for d, tf, n in told:
            m = 100 - 75 + (75 * n * n_docs) // all_terms
            scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if tf[t]), d))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(best)]
    return sorted(out, key=str)


def library(seed):
    rng = random.Random(seed)
    words = [f"{w}{i}" for i in range(60) for w in ("Ärger", "K", "東京", "x")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 80])))) for i in range(150)]
    docs += [(1000 + i, "x1 K2, a copy of one text") for i in range(40)] + [(5, "x1 K2"), (5, "x1 K2"), (None, "x1 k2"), (None, "x1 k2"), (2000, None), (2001, "..  --"), (2002, "x3 " * 30_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 20])))) for i in range(40)]
    return docs, items + [(100, "x1 K2"), (100, "x1 K2"), (101, None), (102, " -- "), (103, "unheard"), (None, "K2\x00K3/x4"), (104, "x3 " * 50_000)]


@pytest.mark.parametrize("tiles", [lexical.Tiles(), lexical.Tiles(block_terms=60, items=3, cells=400)])
def test_search_is_the_plain_one(spark, tiles):
    docs, items = library(5)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": mixing.F.lit("x"), "item": mixing.F.lit(0)}).repartition(6)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", mixing.F.lit("x"))
    assert sorted(map(tuple, lexical.search(d, i, tiles=tiles).collect()), key=str) == plain_search(docs, items)


def test_sums_stay_below_2_to_53():
    rng = np.random.default_rng(1)
    q = rng.integers(0, 5 * lexical.EXACT // 4, (7, 30)) * (rng.random((7, 30)) < 0.5)
    q[3, 4] = 9 * lexical.EXACT
    parts = list(lexical.exact_parts(q.copy()))
    assert len(parts) > 9 and all((p.sum(1) <= lexical.EXACT).all() for p in parts) and (sum(p.astype(np.int64) for p in parts) == q).all()
    impact = rng.integers(0, lexical.IMPACT, (30, 5))
    assert (sum((p @ impact.astype(np.float64)).astype(np.int64) for p in parts) == np.array([[sum(int(a) * int(b) for a, b in zip(row, col, strict=True)) for col in impact.T] for row in q])).all()


def test_search_edges(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, i in ((none, some), (some.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")), (none, none.withColumnRenamed("doc_id", "item_id"))):
        got = lexical.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and not got.take(1)


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_mixing", "op13_lexical_search"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from pastframe.llm import queries

    at, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = duck.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = queries.queries()[name](spark, at)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.fetchall()))
