from __future__ import annotations

import math
import os

import pytest

from terrane.llm import mix

pytestmark = pytest.mark.skipif(not os.path.exists(mix.TOKENIZER), reason="no vocabulary here")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int, tokens int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source_name string, target_share double, max_repeats int")


@pytest.mark.parametrize(("mean", "most"), [(0.3, 1), (0.999, 1), (1.7, 3), (3.9, 4), (0.01, 5), (2.0, 2), (40.0, 60)])
def test_bounds_give_the_mean(mean, most):
    b = mix.poisson_bounds(mean, most)
    assert len(b) == most and b == sorted(b)
    assert math.isclose(sum(1 - x for x in b), mean, abs_tol=1e-9)
    if mean < most / 10:  # then the cap hardly matters: a Poisson distribution
        assert math.isclose(1 - b[0], 1 - math.exp(-mean), rel_tol=1e-3)


def test_shares_and_caps(spark):
    rows = [(i, f"text number {i} of the source " * (1 + i % 5), [" Big One", "big_one", "small", "tiny", None, "other"][i % 6], 1, 1) for i in range(6000)]
    m = mix.Mix(docs(spark, rows), targets(spark, [("big one", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.15, 2), ("absent", 0.05, 2)]), size=mix.EXACT)
    got = {r.source_name: r for r in m.shares().collect()}
    assert got["absent"].actual_share == 0 and got["absent"].copies == 0
    for name, share in (("big_one", 0.5), ("small", 0.3), ("tiny", 0.15)):
        assert abs(got[name].actual_share - share / 0.95) < 0.02
    records = m.records().collect()
    assert sum(r.copies for r in got.values()) == len(records)
    per = {}
    for r in records:
        per.setdefault(r.doc_id, []).append(r.copy_no)
    cap = {"big_one": 1, "small": 3, "tiny": 2}
    source = {i: mix_name(s) for i, _, s, *_ in rows}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= cap[source[i]] for i, c in per.items())
    order = [r.doc_id for r in records]
    assert order != sorted(order) and [r.doc_id for r in m.records().collect()] == order


def test_sizes(spark):
    rows = [(i, f"text number {i}", "big" if i % 10 else "small", 1, 1) for i in range(5000)]
    d, t = docs(spark, rows), targets(spark, [("big", 0.5, 3), ("small", 0.5, 2)])
    held = {r.source_name: r for r in mix.Mix(d, t, size=mix.HELD).shares().collect()}
    assert held["small"].mean_repeats == 2 and held["small"].most_repeats == 2 and held["small"].copies == 1000
    assert abs(held["big"].mean_repeats - 0.5 / 0.9) < 0.01 and abs(held["small"].actual_share - 0.2 / 0.7) < 0.02
    asked = mix.Mix(d, t, size=1000).shares().collect()
    assert abs(sum(r.tokens for r in asked) - 1000) < 250


def mix_name(s):
    return s.strip().lower().replace(" ", "_") if s else s


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["Hello  world, it's 2024!", "", None, "naïve 漢字\n\n x", "y" * 30_000, "long text. " * 200_000]
    counts = mix.token_counts(docs(spark, [(i, t, "s", 0, 0) for i, t in enumerate(texts)]).withColumn("_draw", mix.draw(0)))
    got = {r.doc_id: r.n_tokens for r in counts.collect()}
    with open(mix.TOKENIZER, "rb") as f:
        enc = mix._encoder(f.read())
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_edge_tables(spark):
    none = docs(spark, [])
    t = targets(spark, [("a", 0.5, 1), ("b", 0.5, 0), (None, 0.1, 2), ("c", None, 2)])
    assert mix.Mix(none, t).records().count() == 0
    assert mix.Mix(none, t).shares().collect()[0].actual_share == 0
    some = docs(spark, [(None, "x y z", "a", 3, 4), (None, "x y z", "a", 3, 4), (1, None, "a", 0, 0)])
    m = mix.Mix(some, t)
    assert m.records().count() == 3 and m.shares().first().actual_share == 1
    assert mix.Mix(some, targets(spark, [])).records().count() == 0


def test_few_documents_meet_their_shares(spark):
    """Draws of few documents are uneven; the rate makes up for it, to a document or two."""
    rows = [(i, f"text number {i} of the source " * (1 + i % 7), "abc"[(i % 10) // 4], 1, 1) for i in range(150)]
    t = targets(spark, [("a", 0.2, 2), ("b", 0.3, 3), ("c", 0.5, 4)])
    for seed in range(3):
        for r in mix.Mix(docs(spark, rows), t, seed=seed).shares().collect():
            assert r.most_repeats <= r.max_repeats and abs(r.actual_share - r.target_share) <= r.tolerance + 1e-9 < 0.06


def test_high_rates_and_limits(spark):
    b = mix.rate_bounds(900.0, 2000)
    assert math.isclose(sum(1 - x for x in b), 900.0, rel_tol=1e-6) and mix.rate_bounds(0.0, 2) == [1.0, 1.0]
    with pytest.raises(ValueError):
        mix.Mix(docs(spark, [(1, "x", "a", 1, 1)]), targets(spark, [("a", 1.0, mix.MAX_REPEATS + 1)]))
