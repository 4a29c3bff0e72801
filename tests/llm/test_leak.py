from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from terrane.llm import leak


def brute(docs, items, run=12):
    grams = defaultdict(set)
    for i, t in items:
        w = leak.words(t)
        for k in range(len(w) - run + 1):
            grams[tuple(w[k : k + run])].add(i)
    out = set()
    for d, t in docs:
        w = leak.words(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return {(d, i) for d, i in out if d is not None and i is not None}


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id long")
    rows = leak.leaks(d, i, **kw).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id) for r in rows}


def corpus():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    shared = " ".join(rng.choices(vocab, k=20))
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 40))) + " " + shared * (i % 4 == 0)) for i in range(30)]
    items += [(30, "a a a a a a a a a a a a a b"), (31, None), (32, ""), (None, items[0][1]), items[0]]
    docs = []
    for d in range(300):
        w = rng.choices(vocab, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            src = leak.words(rng.choice(items)[1])
            if src:
                a = rng.randrange(len(src))
                piece = src[a : a + rng.randrange(9, 16)]
                k = rng.randrange(len(w) + 1)
                w[k:k] = piece
        docs.append((d, "_".join(w).upper()))
    docs += [(1000, "a " * 40), (1001, None), (1002, ""), (None, items[0][1]), docs[0], (1003, items[4][1])]
    return docs, items


@pytest.mark.parametrize("block", [50, 4_000_000])
def test_against_brute_force(spark, block):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 50
    assert run(spark, docs, items, block=block) == want


def test_words():
    assert leak.words("Ａb­c_ﬁ²​ D-é1") == ["abc", "fi2", "d", "é1"]
    assert leak.words(None) == [] and leak.words("__ --") == []


def test_empty(spark):
    assert run(spark, [], [(1, "x " * 20)]) == set()
    assert run(spark, [(1, "x " * 20)], []) == set()


def test_very_long(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    text = "filler word " * 300_000 + passage + " filler" * 10
    assert run(spark, [(1, text), (2, "p0 " + passage[3:-1])], [(9, "x " + passage + " y")]) == {(1, 9)}


def test_hot_shingles_are_spread(spark):
    """A passage that a third of the documents have, and a filter so full that much passes it."""
    docs, items = corpus()
    passage = leak.words(items[4][1])[-14:]
    docs += [(2000 + i, f"d{i} " + " ".join(passage) + f" e{i}") for i in range(150)]
    assert run(spark, docs, items, hot_docs=5) == brute(docs, items)
    full = np.full(1 << 17, 255, dtype=np.uint8)
    assert len(leak._may_have(full, np.arange(100, dtype=np.int64))) == 100


def test_filter_has_all(spark):
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    f = leak.shingle_filter(spark.createDataFrame([(int(x),) for x in h], "shingle long"), len(h), block=700)
    assert leak._may_have(f, h).tolist() == list(range(5000))
    others = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 100_000)
    assert len(leak._may_have(f, others)) < 2000
