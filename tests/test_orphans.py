from __future__ import annotations

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.operators import orphans

T = datetime.datetime


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key long")


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.integers(-70_000, 200_000) | st.sampled_from([65535, 65536, -65536, -1, 0]), max_size=40),
    st.lists(st.tuples(st.integers(-70_000, 200_000), st.integers(0, 400)), max_size=5),
)
def test_orphan_keys(spark, refs, spans):
    parents = {k for a, n in spans for k in range(a, a + n)}
    got = [r.key for r in orphans.orphan_keys(keys(spark, [*refs, None]), keys(spark, [*parents, None])).collect()]
    assert sorted(got) == sorted(set(refs) - parents)


def test_runs_are_cut_at_buckets(spark):
    got = sorted((r.start, r.end) for r in orphans.key_runs(keys(spark, [*range(65530, 65545), 9, 10, 10, 12])).collect())
    assert got == [(9, 10), (12, 12), (65530, 65535), (65536, 65544)]


def test_orphan_values(spark):
    refs = spark.createDataFrame([("a", 1), ("a", 2), ("z", 9), (None, 1), ("a", 1)], "n string, k int")
    have = spark.createDataFrame([("a", 1), ("b", 1)], "n string, k int")
    got = {(r.n, r.k) for r in orphans.orphan_values(refs, have, ["n", "k"]).collect()}
    assert got == {("a", 2), ("z", 9), (None, 1)}


def statuses(spark, rel, found, tables, columns):
    rel = spark.createDataFrame(rel, "rel_id long, to_table string, to_cols array<string>, detected_at timestamp, name string")
    found = spark.createDataFrame(found, "finding_id long, table_name string, found_at timestamp, status string")
    tables = spark.createDataFrame(tables, "full_name string, created_at timestamp, dropped_at timestamp, name string")
    columns = spark.createDataFrame(columns, "table_name string, column_name string")
    return orphans.reference_status(rel, found, tables, columns)


def test_reference_status(spark):
    t0, t1, t2, t3 = (T(2024, m, 1) for m in (1, 2, 3, 4))
    tables = [("S.A", t1, None, "x"), ("S.A", t1, None, "x"), ("S.B", t0, t2, "x"), (None, t0, None, "x")]
    rel = [
        (1, ' "s"."a" ', ["id"], t2, "n"),
        (2, "S.A", ["id", "nope"], t2, "n"),
        (2, "S.A", ["id", "nope"], t2, "n"),
        (3, "S.A", None, t0, "n"),
        (4, "S.B", [], t2, "n"),
        (5, "A", ["ID"], t2, "n"),
        (6, None, None, t2, "n"),
        (7, "S.B", ["gone"], t1, "n"),
        (8, "S.A", [None], t2, "n"),
        (9, "S.A", ["ID"], None, "n"),
    ]
    found = [(1, "s.b", t3, "x"), (2, None, t3, "x"), (3, " ", t3, "x"), (4, "S.Q", t3, "x"), (5, "S.A", t1, "x"), (6, '""', t1, "x")]
    df = statuses(spark, rel, found, tables, [("s.a", '"ID"'), (None, "X"), ("S.B", "Y")])
    got = {(r.ref_source[0], r.ref_id, r.status) for r in df.collect()}
    assert got == {
        ("r", 2, "missing_column"), ("r", 3, "late"), ("r", 4, "dropped"), ("r", 5, "missing_table"), ("r", 6, "missing_table"),
        ("r", 7, "missing_column"), ("r", 8, "missing_column"), ("f", 1, "dropped"), ("f", 4, "missing_table"),
    }
    counts = {(r.table_name, r.month, r.status): r.refs for r in orphans.orphan_counts(df).collect()}
    assert counts[("S.A", "2024-03", "missing_column")] == 2


def test_empty(spark):
    assert statuses(spark, [], [], [], []).count() == 0


_NAMES = st.text("aZ_.019é€\U0001f600", max_size=5) | st.integers(0, 40).map(lambda i: f"T_{i}") | st.integers(0, 12).map(lambda i: f"T_{i:03}") | st.just("9" * 25) | st.none()


@settings(max_examples=15, deadline=None)
@given(st.lists(_NAMES, max_size=40), st.lists(_NAMES, max_size=40))
def test_orphan_texts(spark, refs, have):
    """Texts are coded by each side alone; what is found are the differences of the sets."""
    rows = [spark.createDataFrame([(x,) for x in side], "n string") for side in (refs, have)]
    got = [r.n for r in orphans.orphan_values(*rows, ["n"]).collect()]
    assert len(got) == len(set(got)) and set(got) == set(refs) - set(have)


def test_runs_compress_numbered_names(spark):
    names = spark.createDataFrame([(f"ORDERS_{i}",) for i in range(1, 2001)], "n string")
    runs = orphans.key_runs(orphans.coded(names, ["n"]), ["kind", "stem"]).collect()
    assert [(r.stem, r.start, r.end) for r in runs] == [("ORDERS_", 1, 2000)]
