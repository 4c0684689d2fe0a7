"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import gzip
import hashlib
import json
import math
import os
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pastframe.llm import bpe, decontamination, line_templates, near_copies, pii, quality_rules, simhash, tool_calls, toxicity, warc, weak_quality
from pastframe.llm.common import hot_keys, new_folder, salted_join, shared_root
from pastframe.llm.components import connected_components
from pastframe.llm.queries import oracle_sql, queries, vocabulary_path

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **extra):
    df = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


ODD = [None, "", " \t\n ", "one", "a b", "x" * 5000, "word " * 3000, "same text here for you", "same text here for you", "é ß 漢字 \U0001f600 ok", "12 34 56"]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{D}/documents.parquet").cache()


# op 1


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, real):
    both = real.select("doc_id", "text").unionByName(docs(spark, ODD).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in simhash.near_duplicates(both).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in both.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_ball_links_every_distance_up_to_three_and_no_more(spark):
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(0, 1 << 63, 12).tolist():
        values.add(base)
        for n in range(1, 6):
            for _ in range(12):
                values.add(base ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = {v: v for v in values}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    plan = simhash.ball_edges(df.groupBy("fp").count().select("fp"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # the few bytes of fingerprints are dealt out before they emit
    edges = [(r.a, r.b) for r in simhash.ball_edges(df).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
    comp = {r.node: r.component for r in connected_components(simhash.ball_edges(df)).collect()}
    brute = brute_components(fps)
    groups = collections.defaultdict(set)
    for v, c in brute.items():
        groups[c].add(signed(v))
    mine = collections.defaultdict(set)
    for v in map(signed, values):
        mine[comp.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(df).collect()} == {0}
    assert connected_components(df.where("a < 0")).count() == 0


def test_dropping_near_duplicates_keeps_one_of_each_group(spark):
    df = docs(spark, ["the quick brown fox jumps over it", "the quick brown fox jumps over it", "another text altogether it is", None, ""])
    df = df.unionByName(df.where("doc_id = 2"))
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df).collect()) == [0, 2, 3]


def test_near_duplicates_are_dropped_by_group_and_not_by_id(spark):
    near, far, other = "the quick brown fox jumps over it", "another text altogether it is", "third words of no kin at all"
    rows = [(None, near), (None, far), (None, far), (7, other), (7, "and a fourth one which stands alone"), (8, other), (9, near)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    want = sorted([(9, near), (-1, far), (7, other), (7, rows[4][1])])
    for n in (1, 5):
        got = near_copies.drop_near_copies(df.repartition(n))
        assert got.columns == df.columns and sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got.collect()) == want


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    pool = [f"{a}{b}{c}" for a in "bdfgklmnprstv" for b in "aeiou" for c in "nrstlm"]
    texts = [" ".join(rng.choice(pool, int(rng.integers(60, 400)))) for _ in range(150)]
    for t in list(texts):
        for _ in range(2):
            w = t.split()
            for _ in range(max(1, int(len(w) * rng.uniform(0, 0.025)))):
                w[int(rng.integers(len(w)))] = str(rng.choice(pool))
            texts.append(" ".join(w))
    texts += ODD
    df = docs(spark, texts, ka="x", node=1, n=2)
    kept = {r.doc_id for r in near_copies.drop_near_copies(df).collect()}
    sets = shingle_sets(texts)
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if near(a, b)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {find(i) for i in range(len(texts))}
    assert want <= kept and len(kept - want) <= 0.1 * (len(texts) - len(want)) and len(want) < 300


# op 2


def brute_spans(t):
    pat = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in pat.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_brute_force(spark, real):
    hard = ["a@b.com_x@y.z a@@b.c a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3.256 1..2.3.4", "4111 1111-1111 1111 4111111111111112", "+1 (555) 123-4567 +12 ++49 30 1234567", "é\U0001f600 a@b.cd 1.1.1.1", "9" * 3000, "a" * 3000 + "@", "a.b" * 2000 + "@c" + ".d" * 2000]
    df = real.select("doc_id", "text").unionByName(docs(spark, [*ODD, *hard]).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {r.doc_id: r.s for r in pii.find_personal_data(df).select("doc_id", pii.spelled(F.col("base")).alias("s")).collect()}
    want = {r.doc_id: brute_spans(r.text) for r in df.collect()}
    assert got == want


def brute_discoveries(texts, p=pii.Bootstrap()):
    """Runs, contexts and three rounds of scores over the pattern-instance graph, in plain Python."""
    space = r"[^\x20\x09-\x0D]"
    runs, edges, seeds = [], collections.Counter(), collections.Counter()
    for d, t in texts.items():
        base = [(int(b), int(e), k) for k, b, e in (x.split(":") for x in filter(None, brute_spans(t).split(",")))]
        last = 0
        for m in re.finditer(rf"(?<!{space})(?:(?!\d|@){space})*[0-9@]{space}*(?: (?:(?![0-9@]){space})*[0-9]{space}*)*", t):
            lead = re.match(r"[^A-Za-z0-9+]*", m[0]).end()
            core = re.match(r"[^A-Za-z0-9+]*(.*?)[^A-Za-z0-9]*$", m[0], re.S)[1]
            start, end = m.start() + lead, m.start() + lead + len(core)
            words = re.findall(f"{space}+", t[last : m.start()].lower())
            last = m.end()
            kind = min((k for b, e, k in base if (b, e) == (start, end)), key=pii.KINDS.index, default=None)
            if kind or not any(b < end and e > start for b, e, _ in base):
                pats = [f"{n} " + " ".join(words[-n:]) for n in (1, 2) if len(words) >= n]
                runs.append((d, start, end, core, kind))
                for q in pats:
                    edges[core, kind, q] += 1
    for (_, k, q), n in edges.items():
        if k:
            seeds[q, k] += n
    total = collections.Counter()
    for (_, _, q), n in edges.items():
        total[q] += n
    scores = {}
    for _ in range(p.rounds):
        conf = {(q, k): (s + sum(n * scores.get((i, k), 0) for (i, kk, qq), n in edges.items() if kk is None and qq == q)) / (total[q] + 1) for (q, k), s in seeds.items() if s >= p.support}
        new = collections.defaultdict(float)
        for (i, kk, q) in edges:
            if kk is None:
                for (qq, k), c in conf.items():
                    if qq == q:
                        new[i, k] = max(new[i, k], c)
        scores = {x: v for x, v in new.items() if v >= p.confidence / 2}
    best = {}
    for (i, k), v in scores.items():
        if v >= p.confidence:
            best[i] = max(best.get(i, (0, "")), (v, k))
    return {(d, b, e, best[i][1]) for d, b, e, i, k in runs if k is None and i in best}


def test_discoveries_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = {i: f"row {i} call us at +49 30 {1000000 + i * 37} now, mail to u{i}@a{i % 3}.org or" for i in range(14)}
    texts |= {100 + i: f"call us at 0{i}55-77{i}1 x now, mail to nobody{i} and ref no 88{i}7 of" for i in range(6)}
    far = "at" + "h" * 90
    texts |= {300 + i: f"the {far} +49 30 {2000000 + i * 41} now" for i in range(12)} | {320 + i: f"the {'b' * 20 + far} 77/{i}3 x, the {far}{' ' * 90}0{i}66/77{i} now" for i in range(3)}
    texts |= {200 + i: " ".join(rng.choice(["at", "mail", "to", "us", "12-3", "a@b.cd", "(77)", "+12 345 678 901", "call", "1.2.3.4"], 25)) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = set()
    for r in pii.find_personal_data(df).collect():
        base = {(s.kind, s.start, s.end) for s in r.base}
        got |= {(r.doc_id, s.start, s.end, s.kind) for s in r.spans if (s.kind, s.start, s.end) not in base}
    assert got == brute_discoveries(texts) and len(got) >= 9
    assert {d for d, *_ in got if d >= 300} == {320, 321, 322}  # words and gaps of over 80 characters are contexts too


def test_many_matches_take_linear_time(spark):
    n = 100_000
    text = "".join(f"u{i}@mail.example.org, " for i in range(n))
    df = docs(spark, [text, "10.0.0.1 " * 30_000], end="x", base="y")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.find_personal_data(df).select("doc_id", F.size("base").alias("n"), pii.spelled(F.slice("base", -1, 1)).alias("last"), F.size("spans").alias("m")).collect()}
    assert (got[0].n, got[1].n) == (n, 30_000) and got[0].last == f"email:{len(text) - 2 - len(f'u{n - 1}@mail.example.org')}:{len(text) - 2}"
    assert time.monotonic() - began < 90
    assert pii.find_personal_data(docs(spark, [])).count() == 0


def test_contexts_take_linear_time(spark):
    """One word of a million characters before a run, and a million words."""
    df = docs(spark, ["w" * 1_000_000 + " 12-34", "w " * 1_000_000 + "12-34", "\n" * 1_000_000 + "12-34"])
    began = time.monotonic()
    runs = pii.located(F.col("text"), pii.CANDIDATE, pii.CONTEXT)
    got = [r.b for r in df.orderBy("doc_id").select(F.get(F.transform(runs, lambda x: x["before"]), F.lit(0)).alias("b")).collect()]
    assert got == ["w" * 1_000_000 + " ", "w w ", ""]
    assert time.monotonic() - began < 30


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"reach me by mail at user{i}@example.com today" for i in range(12)]
    unseen = [f"reach me by mail at user{i}(at)example{i} today" for i in range(2)]
    other = [f"the score was {i} to {i + 3} today" for i in range(8)]
    df = docs(spark, [*seeds, *unseen, *other])
    got = {r.doc_id: r.s for r in pii.find_personal_data(df, pii.Bootstrap(confidence=0.7)).select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect()}
    assert all(got[12 + i] == f"email:20:{20 + len(f'user{i}(at)example{i}')}" for i in range(2))
    assert all(got[i] == f"email:20:{20 + len(f'user{i}@example.com')}" for i in range(12))
    assert not any(got[i] for i in range(14, 22))


# op 3


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.93
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_ftrl_equals_a_plain_version(spark):
    rng = np.random.default_rng(2)
    good, bad = [f"ok{c}" for c in "abcdefghij"], [f"vile{c}" for c in "abcd"]
    rows = [(i, " ".join([*rng.choice(good, 6), *(rng.choice(bad, 2) if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(90)]
    p = toxicity.Ftrl(epochs=2, shards=3)
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = toxicity.fit(df, p)
    words, shards = toxicity.Words(), collections.defaultdict(list)
    for r in df.select(F.xxhash64("doc_id", "text").alias("h"), "text", "label").collect():
        shards[r.h % p.shards].append((r.h, toxicity.features(r.text, words).tolist(), r.label))
    z, n = collections.Counter(), collections.Counter()
    weight = lambda z, n: 0.0 if abs(z) <= p.l1 else -(z - math.copysign(p.l1, z)) / ((p.beta + math.sqrt(n)) / p.alpha + p.l2)
    for _ in range(p.epochs):
        changes = collections.defaultdict(list)
        for rows_ in shards.values():
            z1, n1, touched = dict(z), dict(n), set()
            for _, x, y in sorted(rows_):
                x = [*x, 1 << toxicity.BITS]
                margin = sum(weight(z1.get(i, 0), n1.get(i, 0)) for i in x)
                g = 1 / (1 + math.exp(-margin)) - y
                for i, w in [(i, weight(z1.get(i, 0), n1.get(i, 0))) for i in x]:
                    before = n1.get(i, 0)
                    z1[i] = z1.get(i, 0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / p.alpha * w
                    n1[i] = before + g * g
                    touched.add(i)
            for i in touched:
                changes[i].append((z1[i] - z.get(i, 0), n1[i] - n.get(i, 0)))
        for i, c in changes.items():
            z[i] += sum(a for a, _ in c) / len(c)
            n[i] += sum(b for _, b in c) / len(c)
    want = np.zeros(len(got))
    for i in z:
        want[i] = weight(z[i], n[i])
    assert np.allclose(got, want, atol=1e-9) and (got[got != 0]).size > 3


def test_toxicity_of_odd_texts_and_without_labels(spark):
    df = docs(spark, ODD, score="old", held_out="old")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(df, none).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert toxicity.toxicity(df.where("false"), none).count() == 0


# op 4


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    y = rng.random(20000) < 0.7
    acc = np.array([0.95, 0.9, 0.8, 0.85])
    v = np.where(rng.random((20000, 4)) < acc, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    v[rng.random((20000, 4)) < 0.3] = 0
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = weak_quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(model.accuracy - acc).max() < 0.03


def test_label_model_equals_a_plain_version(spark, real):
    hashes = weak_quality.word_table()
    texts = [r.text or "" for r in real.select("text").collect()]
    vs = [weak_quality.votes(t, hashes).tolist() for t in texts]
    acc, share = [0.9] * weak_quality.N_LABELLERS, 0.6

    def good(v):
        a, b = share, 1 - share
        for x, p in zip(v, acc, strict=True):
            if x:
                a, b = a * (p if x > 0 else 1 - p), b * (p if x < 0 else 1 - p)
        return a / (a + b)

    for _ in range(200):
        ps, new = [good(v) for v in vs], []
        for k in range(len(acc)):
            right = sum(p if v[k] > 0 else 1 - p for v, p in zip(vs, ps, strict=True) if v[k])
            spoke = sum(1 for v in vs if v[k])
            new.append(min(max((right + 9) / (spoke + 10), 0.55), 0.999))
        done, acc = max(abs(x - y) for x, y in zip(acc, new, strict=True)) < 1e-7, new
        if done:
            break
    model = weak_quality.fit(real.select("doc_id", "text"))
    assert np.allclose(model.labels.accuracy, acc, atol=1e-6)
    kept = {r.doc_id: r for r in weak_quality.quality(real).collect()}
    shapes = weak_quality.shape_table()
    for r in real.limit(60).collect():
        score = model.score(*weak_quality.features(r.text or "", shapes))
        assert kept[r.doc_id].score == pytest.approx(score, abs=1e-6) and kept[r.doc_id].kept == (kept[r.doc_id].score >= 0.5)


def test_intermediate_tables_go(spark, real):
    import corpus_pipeline as c

    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    out = c.run(spark, D)
    assert out.count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"decontaminate"}
    before = set(os.listdir(root))
    simhash.near_duplicates(real).count(), pii.find_personal_data(real).count(), toxicity.toxicity(real, spark.read.parquet(f"{D}/labels.parquet")).count()
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"fingerprints", "components", "pii-found", "pii-discovered"}


def test_classifier_agrees_with_the_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = weak_quality.quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_classifier_on_odd_texts(spark):
    got = weak_quality.keep_good(docs(spark, [*ODD, "Plain words make up this text."] * 3, quality=1))
    assert got.columns == [*docs(spark, []).columns, "quality"]
    assert weak_quality.quality(docs(spark, [])).count() == 0


# op 5


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_rule_counts_equal_brute_force(spark, real):
    df = real.select("doc_id", "text").unionByName(docs(spark, [*ODD, "a b c d e f g h i a b c d e f g h", "x\x85y  z\nx\n\nx\r\nx"]).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, spark.read.parquet(f"{D}/labels.parquet")).collect()}
    for r in df.collect():
        n, chars, symbols, dup, rep = brute_counts(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert g.base_failed == (n < 20 or 100 * rep > 30 * n) and not (g.kept and g.base_failed)


def test_rule_verdicts_equal_a_plain_version(spark, real):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.quality_rules(real, labels).collect()}
    hashes = quality_rules.word_table()
    stats = {r.doc_id: quality_rules.statistics(r.text or "", hashes) for r in real.collect()}
    failed = {i: c[0] < 20 or 100 * c[4] > 30 * c[0] for i, (c, _) in stats.items()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in stats and not failed[r.doc_id]}
    forest = quality_rules.boost(np.array([stats[i][1] for i in sorted(y)]), np.array([float(y[i]) for i in sorted(y)]))
    for i, (counts, x) in stats.items():
        raw = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while 2 * node + 2 < len(f):
                node = 2 * node + 1 + (x[f[node]] > t[node])
            raw += v[node]
        score = 1 / (1 + math.exp(-raw))
        assert got[i].quality_score == pytest.approx(score) and got[i].base_failed == failed[i] and got[i].kept == (not failed[i] and score >= 0.5)


def test_trees_obey_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 2))
    y = (rng.random(4000) < np.clip(1 - x[:, 0] + 0.3 * np.sin(20 * x[:, 0]), 0, 1)).astype(float)
    forest = quality_rules.boost(x, y, quality_rules.Boosting(trees=30), (-1, 0))
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.5)])
    assert (np.diff(forest.score(grid)) <= 1e-12).all() and forest.score(grid)[0] > 0.8 > 0.4 > forest.score(grid)[-1]
    assert (quality_rules.boost(x[:0], y[:0], signs=(-1, 0)).score(grid) == 0.5).all()


# op 6

CHAT = [
    (1, 0, "system", json.dumps({"tools": [{"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}]})),
    (1, 1, "user", "please {add}"),
    (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
    (1, 3, "assistant", json.dumps({"tool_calls": [{"id": "c2", "name": "add", "arguments": {"b": 1}, "depends_on": ["c1"]}, {"id": "c1", "name": "add", "arguments": '{"z": 1, "a": 2}'}]})),
    (1, 4, "tool", json.dumps({"tool_call_id": "c2", "content": "4"})),
    (1, 5, "tool", json.dumps({"tool_call_id": "c2", "content": "again"})),
    (1, 6, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
    (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": "{", "depends_on": ["b"]}, {"id": "b", "name": "f", "arguments": "{}", "depends_on": ["a"]}]})),
    (3, None, None, None),
]


def test_calls_are_linked_ordered_and_checked(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn int, role string, text string")
    rows = tool_calls.formatted(df).collect()
    by = {(r.kind, r.call_id, r.status): r for r in rows if r.kind != "message"}
    assert by["call", "c1", "linked"].level == 0 and by["call", "c2", "linked"].level == 1
    assert by["result", "c1", "linked"].order_turn == 3 and by["result", "c1", "linked"].turn == 2 and ("result", "c2", "repeat") in by and ("result", "zz", "orphan") in by
    assert by["call", "c2", "linked"].problem == "$.a: missing" and by["call", "c1", "linked"].problem is None
    assert by["call", "c1", "linked"].json.startswith('{"arguments":{"a":2,"z":1},"call_id":"c1"')
    assert by["call", "a", "cycle"].problem == "$: not JSON" and ("call", "b", "cycle") in by
    assert [json.loads(r.json)["content"] for r in rows if r.conv_id == 3] == [None]
    order = sorted((r.order_turn, r.level, r.kind, r.call_id) for r in rows if r.conv_id == 1 and r.call_id in ("c1", "c2") and r.status == "linked")
    assert [(k, c) for _, _, k, c in order] == [("call", "c1"), ("result", "c1"), ("call", "c2"), ("result", "c2")]
    assert tool_calls.formatted(df.where("false")).count() == 0


def test_messages_with_calls_keep_their_content(spark):
    call = {"id": "c1", "name": "f", "arguments": "{}", "depends_on": ["c0"]}
    texts = [json.dumps({"content": "let me look", "tool_calls": [call]}), json.dumps({"content": "nothing to call", "tool_calls": []}), json.dumps({"tool_calls": [call | {"id": "c2", "depends_on": None}]})]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    rows = sorted(tool_calls.formatted(df).collect(), key=lambda r: (r.turn, r.level, r.kind))
    assert [(r.turn, r.kind) for r in rows] == [(0, "message"), (0, "call"), (1, "message"), (2, "message"), (2, "call")]
    said = [json.loads(r.json) for r in rows if r.kind == "message"]
    assert [m["content"] for m in said] == ["let me look", texts[1], None] and all(m["role"] == "assistant" for m in said)
    made = [r.json for r in rows if r.kind == "call"]
    assert [json.loads(j)["depends_on"] for j in made] == [["c0"], []]
    assert all(j == json.dumps(json.loads(j), sort_keys=True, separators=(",", ":")) for j in made)


def test_odd_calls_lose_nothing(spark):
    call = lambda **k: {"id": "c1", "name": "f", "arguments": "{}"} | k
    rows = [
        (None, 0, "assistant", json.dumps({"content": "a", "tool_calls": [call()]})),
        (None, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "x"})),
        (1, 0, "assistant", json.dumps({"content": "b", "tool_calls": [call(id=None), call(arguments='{"a": 1e999}'), call(id="c2", arguments='{"a": "\\ud800"}')]})),
        (1, 1, "tool", '{"tool_call_id": "c1", "content": "\\ud83d ok"}'),
        (1, None, "tool", None),
        (1, 2, "tool", "{broken"),
        (1, 2, "tool", "{broken"),
        (2, 0, "assistant", json.dumps({"tool_calls": None})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"level": F.lit("x"), "json": F.lit("y"), "status": F.lit(1)})
    got = tool_calls.formatted(df).collect()
    assert collections.Counter((r.conv_id, r.kind, r.call_id, r.status, r.problem) for r in got) == collections.Counter([
        (None, "message", None, None, None), (None, "call", "c1", "orphan", "unknown tool"), (None, "result", "c1", "orphan", None),
        (1, "message", None, None, None), (1, "call", None, "orphan", "unknown tool"), (1, "call", "c1", "linked", "$: not JSON"), (1, "call", "c2", "orphan", "unknown tool"),
        (1, "result", "c1", "linked", None), (1, "message", None, None, None), (1, "message", None, None, None), (1, "message", None, None, None), (2, "message", None, None, None),
    ])
    assert '{"a":"?"}' in next(r.json for r in got if r.call_id == "c2") and all(json.loads(r.json) for r in got)


def test_calls_come_after_what_they_wait_for_in_later_turns(spark):
    call = lambda i, *on: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": "{}", "depends_on": list(on)}]})
    rows = [(1, 1, "assistant", call("a", "b")), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "early"})), (1, 3, "assistant", call("b")), (1, None, "assistant", call("c")), (1, 2, "assistant", call("d", "a", "c"))]
    got = {(r.kind, r.call_id): r for r in tool_calls.formatted(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect() if r.kind != "message"}
    assert {k: (r.turn, r.order_turn, r.level) for k, r in got.items()} == {("call", "a"): (1, 3, 1), ("result", "a"): (2, 3, 1), ("call", "b"): (3, 3, 0), ("call", "c"): (None, None, 0), ("call", "d"): (2, 3, 2)}


def test_long_conversations_are_settled_alike(spark):
    rng = np.random.default_rng(5)
    calls = [(c, f"n{i}", int(rng.integers(30)), [f"n{j}" for j in rng.choice(max(i, 1), min(i, 2), replace=False)] + (["gone"] if i % 7 == 0 else [])) for c in (1, 2) for i in range(40)]
    calls += [(3, "a", 1, ["b"]), (3, "b", 1, ["a"]), (3, "c", 2, ["a"]), (3, "d", 0, []), (4, "z", 0, ["z"])]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn int, depends_on array<string>")
    want = {}
    for c in {x[0] for x in calls}:
        want |= {(c, k): v for k, v in tool_calls.settle({x[1]: x[2] for x in calls if x[0] == c}, {x[1]: x[3] for x in calls if x[0] == c}).items()}
    for most in (20, 60, 10_000):
        assert {(r.conv_id, r.call_id): (r.level, r.after) for r in tool_calls._levels(df, most).collect()} == want
    assert want[3, "d"] == (0, 0) and not any(k in want for k in [(3, "a"), (3, "c"), (4, "z")])
    own = {x[1]: x for x in calls if x[0] == 1}
    for k, (_, _, turn, ws) in own.items():
        on = [want[1, w] for w in ws if w != "gone"]
        assert want[1, k] == (max((x + 1 for x, _ in on), default=0), max([turn, *(t for _, t in on)]))


def test_a_long_chain_takes_few_rounds(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.concat(F.lit("c"), "id").alias("call_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("c"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    began = time.time()
    got = tool_calls._levels(df, 10_000)
    assert got.where("level = after and concat('c', level) = call_id").count() == n and time.time() - began < 120


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op9_warc", "chat_tool_links"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = queries()[name](spark, D), con.execute(oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


# op 7


def test_tokens_equal_the_library(spark, real):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    hard = ["a<|endoftext|>b", "ΑΣ ΑΣ'LL İ ǅ ẛ̣ ſ", "ha" * 4000, "!" * 3000, "7" * 200, "don't WE'VE", "  x​", "the" * 2000 + " " + "#!" * 900]
    df = real.select("doc_id", "text", F.lit("old").alias("ids")).unionByName(docs(spark, [*ODD, *hard], ids="old").select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "ids"))
    got = {r.doc_id: r for r in bpe.encode_decode(df, vocabulary_path()).collect()}
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids == ids and got[r.doc_id].decoded == lib.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary_path()), bpe.Encoder(bpe.Vocabulary(vocabulary_path()))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{x}b {x}1{x}'s a\u0323{x}\u0301" for x in points[i : i + 256]) for i in range(0, len(points), 256)]
    assert all(own.encode(t) == got.ids for t, got in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True))


def test_transducer_is_the_same_in_pieces_and_holds_little():
    v = bpe.Vocabulary(vocabulary_path())
    rng = np.random.default_rng(1)
    for alphabet in ("ab", "the", "anisoter"):
        word = "".join(rng.choice(list(alphabet), 9000))
        t, out, most = bpe.Transducer(v), [], 0
        for c in word:
            out += t.feed([c])
            most = max(most, len(t.held))
        out += t.finish()
        assert out == v.merge([*word[:-1], word[-1] + v.end]) and most <= 2 * t.room


def test_text_comes_back_but_for_case_and_spaces(spark):
    df = docs(spark, ["Hello, Wörld 12 ok", "漢字 \U0001f600"])
    got = [r.decoded for r in bpe.encode_decode(df, vocabulary_path(), joined=False).orderBy("doc_id").collect()]
    assert [re.sub(r"\s", "", x) for x in got] == ["hello,wörld12ok", "漢字\U0001f600"]


# op 8


def brute_lines(texts, min_docs=3):
    """The same in plain Python: masks, leaves, modal templates, further divisions, documents per template, all places but the first."""
    raw = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    tokens = lambda x: raw(x) if all(re.search("[0-9]", w) for w in raw(x)) else [("<*>" if re.search("[0-9]", w) else w) for w in raw(x)]
    places = [(i, n, tuple(tokens(x))) for i, t in texts.items() for n, x in enumerate((t or "").split("\n")) if tokens(x)]
    depth, parts = line_templates.DEPTH, line_templates.PARTS
    lines = {m for _, _, m in places if len(m) > depth}
    of = {}
    for k in range(-1, parts):
        groups = collections.defaultdict(set)
        for m in lines - set(of):
            groups[len(m), m[:depth], m[depth + k :: parts] if k >= 0 else k].add(m)
        for name, ms in groups.items():
            if len(ms) > 1:
                modal = [min(collections.Counter(col).items(), key=lambda kv: (-kv[1], kv[0].encode()))[0] for col in zip(*ms, strict=True)]
                of |= {m: ("t", k, name) for m in ms if sum(a == b for a, b in zip(m[depth:], modal[depth:], strict=True)) >= line_templates.ALIKE * (len(m) - depth)}
    by, size = collections.defaultdict(list), {}
    for i, n, m in places:
        by[of.get(m, m)].append((i, n))
        size[of.get(m, m)] = len(m)
    enough = {t: min_docs if size[t] < line_templates.LONG else line_templates.LONG_DOCS for t in by}
    gone = {p for t, ps in by.items() if len({i for i, _ in ps}) >= enough[t] for p in ps if p != min(ps)}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()}


def test_short_lines_that_differ_in_a_word_stay(spark):
    ends = ["king", "cook", "nurse", "king of all", "cook of all", "nurse of all", "king of the hill", "cook of the hill", "nurse of the hill", "big king", "big cook", "big nurse"]
    texts = [f"He said to the {x}" for x in ends] + ["He said to the smith at 5", "He said to the smith at 6", "He said to the smith at 7"]
    df = docs(spark, texts)
    got = {r.doc_id: r.text for r in line_templates.with_kept_lines(df).collect()}
    assert got == brute_lines(dict(enumerate(texts))) == {i: t if i < 13 else "" for i, t in enumerate(texts)}
    assert line_templates.drop_recurring_lines(df).count() == 13


def test_two_templates_of_one_leaf_and_long_passages(spark):
    first = [f"you may call us at {'abcdefg'[i]} on week days only" for i in range(5)]
    second = [f"you may call us {'uvwxyzk'[i]} times a year no more" for i in range(4)]
    noise = [" ".join(["you may call us", *(x + y for y in "abcdef")]) for x in "ghijklmnopqr"]
    long_ = " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    texts = [f"{x}\nown line {i} of text {x[-3:]}" for i, x in enumerate([*noise, *first, *second, long_, long_])]
    df = docs(spark, texts)
    got = {r.doc_id: r.text for r in line_templates.with_kept_lines(df).collect()}
    assert got == brute_lines(dict(enumerate(texts)))
    kept = [i for i, t in enumerate(texts) if got[i].startswith(t.split("\n")[0])]
    assert kept == [*range(12), 12, 17, 21]


def test_a_hot_line_is_dealt_to_many_tasks_and_nothing_is_lost(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line in all of them\nown "), F.col("id"), F.lit("\n"), F.md5(F.col("id").cast("string"))).alias("text"))
    got = line_templates.with_kept_lines(df)
    assert {(r.n_dropped, r["count"]) for r in got.groupBy("n_dropped").count().collect()} == {(0, 1), (2, 3999)} and got.count() == 4000
    big, small = spark.range(3000).select((F.col("id") % 2).alias("k"), "id"), spark.createDataFrame([(0, "a"), (2, "b")], "k long, v string")
    assert salted_join(big, small, ["k"]).count() == 1500 and salted_join(big, small, ["k"], "left").where("v is null").count() == 1500
    assert hot_keys(big, ["k"]).count() == 2


def test_lines_are_removed_in_linear_time(spark):
    n = 60_000
    df = spark.createDataFrame([("\n".join(map(str, range(n))), list(range(1, n, 2)))], "t string, d array<int>")
    assert df.select(line_templates.without_lines(F.col("t"), F.col("d")).alias("x")).first().x == "\n".join(map(str, range(0, n, 2)))


def test_line_dedup_equals_brute_force(spark, real):
    extra = [*ODD[2:], *(f"Page {i} of 9 printed on day {i}\nown words {'abcdefg'[i]} here now\nleft alone {i * 3} over there they said {'uvwxyzk'[i]} so it was" for i in range(5)), None]
    df = real.select("doc_id", "text").unionByName(docs(spark, extra).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = {r.doc_id: r.text for r in line_templates.with_kept_lines(df.withColumn("n_dropped", F.lit("old"))).collect()}
    want = brute_lines({r.doc_id: r.text for r in df.collect()})
    assert got == want and got != {r.doc_id: r.text for r in df.collect()}


def test_documents_of_recurring_lines_go(spark):
    df = docs(spark, ["same line of words", "same line of words", "same line of words", "", None, "own"])
    assert sorted(r.doc_id for r in line_templates.drop_recurring_lines(df).collect()) == [0, 3, 4, 5]
    assert line_templates.drop_recurring_lines(docs(spark, [])).count() == 0


# op 9


def test_archives_are_the_same_whatever_the_layout(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(pages.limit(9).withColumn("page_id", F.col("page_id") + 10**6)).unionByName(spark.createDataFrame([(10**7, None, None), (10**7 + 1, "u\r\nX: y", ""), (10**7 + 2, "u", "short"), (10**7 + 3, "u", "short")], pages.schema))
    lay = warc.Layout(roll_bytes=50_000, range_bytes=100_000)
    a, b = (new_folder(spark, "w") for _ in range(2))
    ma, mb = warc.write_archives(pages, a, lay), warc.write_archives(pages.repartition(7), b, lay)
    assert warc.same_files(ma, mb) and ma.count() > 2
    root = warc.open_fs(a)[1]
    for r in ma.collect():
        blob = open(f"{root}/{r.file}", "rb").read()
        assert hashlib.sha256(blob).hexdigest() == r.sha256 and gzip.decompress(blob).count(b"WARC/1.1\r\n") == r.records
    back = {r.page_id: r for r in warc.read_archives(spark, a).collect()}
    src = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    first = {}
    for i in sorted(src):
        first.setdefault(src[i], i)
    assert set(back) == set(src)
    for i, body in src.items():
        to = first[body] if len(body) >= 100 and first[body] != i else None
        r = back[i]
        assert (r.refers_to, r.record_type, r.payload_bytes, r.payload_digest) == (to, "revisit" if to is not None else "response", len(body), hashlib.sha256(body).hexdigest())
        assert to is not None or r.payload == body


def test_ranges_are_even_on_uneven_ids_and_pages_without_id_are_kept(spark):
    body = "b" * 150
    rows = [(i * i, "u", f"{i} " + "x" * 900) for i in range(400)] + [(1 << 55, "far", "y" * 500), (5, "u", body), (5, "v", body), (5, "v", "own"), (None, "w", body), (None, None, None), (None, "z", "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"range": F.lit(1), "payload": F.lit("p"), "kind": F.lit(2)})
    outs = [new_folder(spark, "w") for _ in range(2)]
    lay = warc.Layout(roll_bytes=1 << 20, range_bytes=20_000)
    ma, mb = warc.write_archives(pages.coalesce(1), outs[0], lay), warc.write_archives(pages.repartition(5), outs[1], lay)
    assert warc.same_files(ma, mb)
    n = sorted(r.records for r in ma.collect())
    assert len(n) in (18, 19) and n[-1] <= 2 * n[len(n) // 2] and sum(n) == len(rows)
    back = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, outs[0]).collect()]
    assert back.count((5, "response", None, 150)) == 2 and (5, "response", None, 3) in back
    assert sorted(x[1:] for x in back if x[0] is None) == [("response", None, 0), ("response", None, 200), ("revisit", 5, 150)]


def test_no_pages_make_an_empty_archive(spark):
    out = new_folder(spark, "w")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(pages, out).count() == 0 and warc.read_archives(spark, out).count() == 0


# op 10


def test_decontamination_equals_brute_force(spark, real):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    long_ = max(items.values(), key=lambda t: len(t.split())).split()
    edited = " ".join([*long_[:-1], "changed"])
    df = real.select("doc_id", "text").unionByName(docs(spark, [*ODD, "before it " + edited + " and after", " ".join(long_).upper(), " ".join(long_[: len(long_) // 2])]).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    bench = bench.unionByName(spark.createDataFrame([(900, None), (901, "zq yx"), (None, "a b c d e f")], bench.schema))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    again = {(r.doc_id, r.item_id) for r in decontamination.with_contamination(df, bench, block_items=7).select("doc_id", F.explode("hits.item_id").alias("item_id")).collect()}
    hashes, want = decontamination.word_hashes(), set()
    sets = {}
    for i, t in items.items():
        h = decontamination.words_of(t, hashes)
        k = min(decontamination.SHINGLE, len(h))
        sets[i] = len(h), k, decontamination.totals(*decontamination.shingles(h, k))
    for r in df.collect():
        h = decontamination.words_of(r.text or "", hashes)
        for i, (n, k, own) in sets.items():
            s, w = decontamination.shingles(h, k)
            if not np.isin(s, own[0]).any():
                continue
            starts = range(max(1, len(h) - n + 1))
            if any(decontamination.similarity(decontamination.totals(s[p : p + n - k + 1], w[p : p + n - k + 1]), own) >= decontamination.LEAST for p in starts):
                want.add((r.doc_id, i))
    assert got == want == again and {d for d, _ in got} >= {10**6 + len(ODD), 10**6 + len(ODD) + 1} and 10**6 + len(ODD) + 2 not in {d for d, _ in got}


def test_reordered_items_are_found(spark):
    a, b, c, d = ([f"{x}{i}word" for i in range(30)] for x in "abcd")
    bench = spark.createDataFrame([(1, " ".join(a + b)), (2, " ".join(c))], "item_id long, text string")
    pad = [f"pad{i}" for i in range(200)]
    df = docs(spark, [" ".join(x) for x in (pad + b + a + pad, b + a, a + d + b, pad + c[15:] + c[:15] + pad, a + pad)])
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontamination.contaminated(df, bench).collect()}
    items, hashes, want = {r.item_id: r.text for r in bench.collect()}, decontamination.word_hashes(), {}
    for r in df.collect():
        h = decontamination.words_of(r.text, hashes)
        for i, t in items.items():
            own = decontamination.words_of(t, hashes)
            of = decontamination.totals(*decontamination.shingles(own, 5))
            sims = [(-decontamination.similarity(decontamination.totals(*decontamination.shingles(h[p : p + len(own)], 5)), of), p) for p in range(max(1, len(h) - len(own) + 1))]
            if -min(sims)[0] >= decontamination.LEAST:
                want[r.doc_id, i] = min(sims)[1], pytest.approx(-min(sims)[0])
    assert got == want and {(0, 1), (1, 1)} <= set(got)


def test_edited_items_are_found_wherever_their_fingerprint_is_near(spark):
    rng = np.random.default_rng(8)
    pool = [f"{a}{b}{c}" for a in "bdfgklmnprstv" for b in "aeiou" for c in "nrstlm"]
    items = {f"item-{i}": rng.choice(pool, int(rng.integers(12, 70))).tolist() for i in range(12)}
    texts = []
    for _ in range(220):
        x = list(items[f"item-{rng.integers(12)}"])
        for _ in range(int(rng.integers(0, 4))):
            at, how = int(rng.integers(len(x))), int(rng.integers(4))
            if how == 3:
                x = x[at:] + x[:at]
            else:
                x[at : at + (how > 0)] = [str(rng.choice(pool))] if how < 2 else []
        texts.append(" ".join([*rng.choice(pool, int(rng.integers(0, 90))), *x, *rng.choice(pool, int(rng.integers(0, 90)))]))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(docs(spark, texts, hits="x", start=1), bench, block_items=5).collect()}
    hashes, near, all_ = decontamination.word_hashes(), {}, set()
    for d, t in enumerate(texts):
        h = decontamination.words_of(t, hashes)
        for i, x in items.items():
            own = decontamination.words_of(" ".join(x), hashes)
            s, w = decontamination.shingles(own, 5)
            of, fp = decontamination.totals(s, w), decontamination.fingerprint(s, w)
            for p in range(max(1, len(h) - len(own) + 1)):
                s, w = decontamination.shingles(h[p : p + len(own)], 5)
                if (sim := decontamination.similarity(decontamination.totals(s, w), of)) >= decontamination.LEAST:
                    all_.add((d, i))
                    if (decontamination.fingerprint(s, w) ^ fp).bit_count() <= decontamination.RADIUS:
                        near[d, i] = max(sim, near.get((d, i), 0))
    assert got == pytest.approx(near) and len(near) >= 0.99 * len(all_) and len(all_) > 60


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    index = decontamination.Index([(i, " ".join(rng.choice(words, 20))) for i in range(60)])
    for _ in range(200):
        at = int(rng.integers(60))
        fp = index.fp[at] ^ sum(1 << int(b) for b in rng.choice(64, decontamination.RADIUS, replace=False))
        assert at in set(index.within(20, fp))


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    base = spark.read.parquet(f"{D}/documents.parquet")
    odd = docs(spark, ODD).select((F.col("doc_id") + 10**6).alias("doc_id"), *base.columns[1:])
    d = base.unionByName(odd)
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, d, D).cache()
        assert after.columns == base.columns and 0 < after.count() <= d.count(), name
        d = after
    out = c.STAGES[-1][1](spark, d, D)
    assert out.count() == d.count() and all(r.n_tokens == len(r.ids) for r in out.collect())
    assert c.run(spark, D).count() > 0


def test_stages_keep_columns_of_clashing_names(spark):
    import corpus_pipeline as c

    d = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    for name in ("key", "id", "at", "row", "fps", "ka", "n", "m", "drop", "hits", "quality", "node", "label", "a", "b"):
        d = d.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for _, stage in c.STAGES:
        got = stage(spark, d, D)
        assert set(d.columns) <= set(got.columns) and got.where("key = concat('key', doc_id) and b = concat('b', doc_id)").count() == got.count() > 0


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as c

    d = docs(spark, [])
    for _, stage in c.STAGES:
        d = stage(spark, d, D)
        assert d.count() == 0
