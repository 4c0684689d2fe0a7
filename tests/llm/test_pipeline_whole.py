"""The pipeline's rows against plain versions of its stages, one after the other."""

import numpy as np
from test_llm import brute_lines, shingle_sets
from tokenizers import Tokenizer

from pastframe.llm import decontamination
from pastframe.llm.queries import vocabulary_path

D = "/root/testdata/sf0.001"


def plain_lines(texts):
    """Texts without recurring lines; those that were made of them go."""
    left = brute_lines(texts)
    return {i: t for i, t in left.items() if t == texts[i] or (t or "").strip(" \t\n\x0b\f\r")}


def plain_groups(texts):
    """The smallest id of each group of near copies, by all pairs."""
    ids = sorted(texts)
    sets, root = dict(zip(ids, shingle_sets([texts[i] for i in ids]), strict=True)), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in texts.items() if find(i) == i}


def plain_clean(texts, items):
    """Texts none of whose windows of an item's size has the item's shingles to LEAST."""
    hashes, kept = decontamination.word_hashes(), {}
    sets = []
    for t in items:
        h = decontamination.words_of(t, hashes)
        k = min(decontamination.SHINGLE, len(h))
        sets.append((len(h), k, decontamination.totals(*decontamination.shingles(h, k))))
    for d, text in texts.items():
        h, held = decontamination.words_of(text or "", hashes), False
        for n, k, own in sets:
            s, w = decontamination.shingles(h, k)
            held = held or (np.isin(s, own[0]).any() and any(decontamination.similarity(decontamination.totals(s[p : p + n - k + 1], w[p : p + n - k + 1]), own) >= decontamination.LEAST for p in range(max(1, len(h) - n + 1))))
        if not held:
            kept[d] = text
    return kept


def test_rows_equal_plain_stages(spark):
    """The classifier is trained, so its verdicts are taken as they are; all that follows is told in plain Python."""
    import corpus_pipeline as c

    good = c.STAGES[0][1](spark, spark.read.parquet(f"{D}/documents.parquet"), D)
    texts = {r.doc_id: r.text for r in good.collect()}
    want = plain_clean(plain_groups(plain_lines(texts)), [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()])
    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in c.run(spark, D).collect()}
    assert set(got) == set(want) and 0 < len(want) < len(texts)
    for i, t in want.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert r.text == t and r.n_chars == len(t or "") and list(r.ids) == ids and r.n_tokens == len(ids)
        if t and all(" " <= ch <= "~" or ch in "\n\t" for ch in t):
            assert "".join(r.decoded_text.split()) == "".join(t.lower().split())
