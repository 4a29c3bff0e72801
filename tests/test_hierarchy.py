from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest

from terrane.operators import hierarchy as h
from terrane.plans import problems


def brute(parent):
    out = {}
    for x in parent:
        path, y, seen = [x], parent[x], {x}
        while y in parent and y not in seen:
            path.append(y)
            seen.add(y)
            y = parent[y]
        if y in parent:
            ring = path[path.index(y) :]
            out[x] = (None, None, None, min(ring))
        else:
            out[x] = (tuple(path[::-1]), len(path) - 1, path[-1], None)
    return out


def solved(spark, parent, rows_per_part):
    df = spark.createDataFrame(list(parent.items()), "id string, next string")
    rows = h.hierarchy(df, rows_per_part).collect()
    assert len(rows) == len(parent)
    return {r.id: (tuple(r.path) if r.path else None, r.depth, r.root, r.cycle_code) for r in rows}


def forests():
    rng = random.Random(5)
    mixed = {f"n{i}": rng.choice([None, f"n{rng.randrange(300)}", f"n{max(0, i - 1)}", f"lost{i % 3}"]) for i in range(300)}
    chain = {f"c{i:03}": f"c{i + 1:03}" for i in range(200)}
    ring = {f"r{i:03}": f"r{(i + 1) % 150:03}" for i in range(150)} | {f"t{i}": "r003" for i in range(20)} | {"u0": "t0"}
    star = {f"s{i}": "hub" for i in range(150)} | {"hub": None} | {f"l{i}": f"s{i % 150}" for i in range(100)}
    return {"mixed": mixed, "chain": chain, "ring": ring, "star": star, "self": {"a": "a", "b": "a", "c": None}}


@pytest.mark.parametrize("name", forests())
@pytest.mark.parametrize("rows_per_part", [40, 100_000])
def test_against_brute_force(spark, name, rows_per_part):
    parent = forests()[name]
    assert solved(spark, parent, rows_per_part) == brute(parent)


def test_empty(spark):
    assert h.hierarchy(spark.createDataFrame([], "id string, next string")).count() == 0


def test_current_rows(spark):
    t = datetime.datetime
    rows = [
        (" a ", "b", t(2024, 1, 1), 1),
        ("A", " ", t(2024, 1, 2), 2),
        ("A", " ", t(2024, 1, 2), 3),
        ("b", "x", t(2024, 1, 1), 4),
        ("B", "y", t(2024, 1, 1), 5),
        (None, "a", t(2024, 1, 1), 6),
        (" ", "a", t(2024, 1, 1), 7),
        ("c", None, None, 8),
    ]
    df = spark.createDataFrame(rows, "code string, parent string, at timestamp, id long")
    got = {r.id: r.next for r in h.current_categories(df, "code", "parent", "at").collect()}
    assert got == {"A": None, "B": "Y", "C": None}


def test_descendants(spark):
    parent = forests()["mixed"]
    df = spark.createDataFrame(list(parent.items()), "id string, next string")
    got = {(r.ancestor, r.descendant, r.distance) for r in h.descendants(h.hierarchy(df, 50)).collect()}
    want = {(a, x, len(p) - 1 - i) for x, (p, *_) in brute(parent).items() if p for i, a in enumerate(p[:-1])}
    assert got == want


@pytest.mark.parametrize("name", ["mixed", "ring", "self"])
def test_descendants_on_and_below_cycles(spark, monkeypatch, name):
    parent = forests()[name]
    want = set()
    for x in parent:
        y, seen = parent[x], {x}
        while y in parent and y not in seen:
            want.add((y, x, len(seen)))
            seen.add(y)
            y = parent[y]
    df = spark.createDataFrame([(k, v, datetime.datetime(2024, 1, 1)) for k, v in parent.items()], "category_code string, parent_category string, loaded_at timestamp")
    monkeypatch.setattr(problems, "table", lambda s, d, n: df)
    rows = problems.p3_descendants(spark, "").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == {(a.upper(), b.upper(), n) for a, b, n in want}
    got = h.all_descendants(spark.createDataFrame(list(parent.items()), "id string, next string"), 40).collect()
    assert {tuple(r) for r in got} == want


def test_paths_of_a_long_chain_come_in_slices(monkeypatch):
    monkeypatch.setattr(h, "LABELS_PER_BATCH", 5_000)
    n = 1_500
    ids = [f"{i:05}" for i in range(n)]
    frame = pd.DataFrame({"id": ids, "next": [*ids[1:], None], "label": [[x] for x in ids], "least": ids, "cyc": [None] * n})
    parts = list(h._contract(iter([frame])))
    assert len(parts) > 100 and max(p["frag"].map(len).sum() for p in parts) < 5_000 + n
    got = pd.concat(parts)
    assert got["id"].tolist() == ids and [f[0] for f in got["frag"]] == [ids[-1]] * n and got["frag"].map(len).tolist() == list(range(n, 0, -1))
