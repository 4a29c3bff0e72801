from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, rules
from terrane.plans import graph as plans


def frames(spark, edges, nodes=()):
    every = sorted({x for e in edges for x in e} | set(nodes))
    return spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in every], "node string")


def random_edges(seed, n=40, m=45):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})


def brute_components(edges, nodes):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


# Each operator in rounds of joins, and in one task.
SIZES = pytest.mark.parametrize("small", [0, graph.SMALL])


@SIZES
@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_islands(spark, seed, small):
    e = random_edges(seed)
    edges, nodes = frames(spark, e, ["alone"])
    got = {r.node: r.component for r in graph.components(edges, nodes, small).collect()}
    assert got == brute_components(e, got)
    rows = graph.islands(edges, nodes, small).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(len(rows))) and rows[0].label == "main"
    assert [(-r.size, r.component) for r in rows] == sorted((-r.size, r.component) for r in rows)


@SIZES
def test_long_chain_components(spark, small):
    e = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    edges, nodes = frames(spark, e)
    assert {r.component for r in graph.components(edges, nodes, small).collect()} == {"c000"}


def bfs(edges, start):
    depth, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for s, d in edges:
            if s == a and d not in depth:
                depth[d] = depth[a] + 1
                queue.append(d)
    return depth


@SIZES
def test_reach_and_depth_bound(spark, small):
    e = random_edges(3, 25, 40)
    edges, _ = frames(spark, e)
    start = e[0][0]
    starts = spark.createDataFrame([(start,), (start,), (None,)], "node string")
    want = bfs(e, start)
    got = graph.reach(edges, starts, small=small).collect()
    assert {r.node: r.depth for r in got} == want
    assert all(r.parent is None or (r.parent, r.node) in set(e) and want[r.parent] == r.depth - 1 for r in got)
    assert {r.node for r in graph.reach(edges, starts, 1, small).collect()} == {n for n, d in want.items() if d <= 1}


@SIZES
def test_shortest_path(spark, small):
    edges, _ = frames(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")])
    assert [tuple(r) for r in graph.shortest_path(edges, "a", "d", small).orderBy("step").collect()] == [(0, "a", None), (1, "b", "→"), (2, "c", "↩"), (3, "d", "→")]
    assert graph.shortest_path(edges, "a", "y", small).count() == 0
    assert graph.shortest_path(edges, "a", "a", small).count() == 1


def brute_cycles(edges, longest):
    out, succ = set(), {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)

    def walk(path):
        for b in succ.get(path[-1], ()):
            if b == path[0]:
                out.add(" → ".join([*path, b]))
            elif b > path[0] and b not in path and len(path) < longest:
                walk([*path, b])

    for a in succ:
        walk([a])
    return out


def test_cycles(spark):
    e = sorted({*random_edges(5, 9, 30), ("n00", "n00")})
    edges, _ = frames(spark, e)
    got = [r.cycle for r in graph.cycles(edges, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cycles(e, 4)


@SIZES
def test_levels_and_critical_path(spark, small):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("y", "z")]
    edges, nodes = frames(spark, e, ["lone"])
    assert {r.node: r.level for r in graph.levels(edges, nodes, small).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "lone": 0, "x": None, "y": None, "z": None}
    assert [r.node for r in graph.critical_path(edges, nodes, small).orderBy("level").collect()] == ["a", "b", "c"]
    assert graph.levels(edges.limit(0), nodes.limit(0), small).count() == 0


def test_cascade(spark):
    rows = [("orders", "people", "CASCADE"), ("lines", "orders", "CASCADE"), ("logs", "people", "SET_NULL"), ("cards", "people", None), ("notes", "cards", None), ("people", "people", None)]
    df = spark.createDataFrame(rows, "from_table string, to_table string, on_delete string")
    got = {r.node: (r.depth, r.action) for r in graph.cascade(df, "people").collect()}
    assert got == {
        "orders": (1, "CASCADE DELETE"), "lines": (2, "CASCADE"), "logs": (1, "SET NULL"), "cards": (1, "RESTRICT / ERROR"), "notes": (2, "RESTRICT"),
    }


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(6) for j in range(i)]
    edges, nodes = frames(spark, [*clique("a"), *clique("b"), *clique("c"), ("a0", "b0"), ("b1", "c1")], ["lone"])
    groups = graph.communities(edges, nodes).cache()
    assert groups.count() == 19 and groups.select("node").distinct().count() == 19
    by = {r.node: r.community for r in groups.collect()}
    assert all(len({by[f"{p}{i}"] for i in range(6)}) == 1 for p in "abc") and by["lone"] == "lone"
    one = nodes.withColumn("community", F.lit("all"))
    assert graph.modularity(edges, groups) > max(0.5, graph.modularity(edges, one))
    assert graph.communities(edges.limit(0), nodes.limit(0)).count() == 0


def brute_levels(before, nodes):
    """Longest chains of predecessors; None for nodes on and behind cycles."""
    level = {}
    for _ in nodes:
        for n in nodes:
            own = [level.get(a) for a, b in before if b == n and a != n]
            if n not in level and None not in own:
                level[n] = max(own, default=-1) + 1
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_level_queries_take_all_keys(spark, monkeypatch, seed):
    rng = random.Random(seed)
    order = rng.sample(range(30), 30)  # names say nothing about who refers to whom
    e = sorted({(f"n{order[max(p)]:02}", f"n{order[min(p)]:02}") for p in ((rng.randrange(30), rng.randrange(30)) for _ in range(45))} | {("x", "y"), ("y", "x"), ("z", "y")})
    frame, nodes = frames(spark, e)
    monkeypatch.setattr(plans, "edges", lambda s, d: frame)
    monkeypatch.setattr(plans, "nodes", lambda s, d: nodes)
    names = sorted({x for pair in e for x in pair})
    want = brute_levels([(b, a) for a, b in e], names)
    assert {r.node: r.level for r in plans.topo_levels(spark, "").collect()} == want
    path = plans.critical_path(spark, "").orderBy("level").collect()
    assert [r.level for r in path] == list(range(max(v for v in want.values() if v is not None) + 1))
    assert all((b.node, a.node) in e and want[b.node] == b.level for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_migration_levels_match_creators_as_of_each_use(spark, monkeypatch, seed):
    rng = random.Random(seed)
    kinds = ["CREATE_TABLE", "ADD_COLUMN", "DROP_TABLE", "RENAME_TABLE"]
    rows = [(f"f{v:02}", f"{v // 5}.{v % 5}", i, rng.choice(kinds), rng.choice(["HOT", "hot ", "hot", "a", "b", None])) for v in range(30) for i in range(4)]
    ops = spark.createDataFrame(rng.sample(rows, len(rows)) + rows[:20], "source_file string, version string, statement_index int, operation string, table_name string")
    created, deps, level = {}, set(), {}
    for f, _, _, kind, name in rows:
        name = name and name.strip().upper()
        if name and kind == "CREATE_TABLE":
            created[name] = f
        elif name and kind != "RENAME_TABLE" and created.get(name, f) != f:
            deps.add((f, created[name], name))
    for f in sorted({r[0] for r in rows}):
        level[f] = max((level[c] + 1 for a, c, _ in deps if a == f), default=0)
    monkeypatch.setattr(plans, "table", lambda s, d, n: ops)
    assert {r.level: r.files for r in plans.migration_levels(spark, "").collect()} == {n: list(level.values()).count(n) for n in level.values()}
    got = {(r.source_file, r.depends_on): r.tables for r in rules.creators_before(ops).collect()}
    assert got == {(f, c): len({n for g, e, n in deps if (g, e) == (f, c)}) for f, c, _ in deps}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_of_any_length(spark, monkeypatch, seed):
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    e = sorted({*ring, ("r4", "r0"), ("r6", "n00"), ("r2", "r2"), *random_edges(seed, 20, 26)})
    frame, _ = frames(spark, e)
    monkeypatch.setattr(plans, "edges", lambda s, d: frame)
    rows = plans.cycles(spark, "").collect()
    short = brute_cycles(e, 4)
    assert len(rows) == len({r.cycle for r in rows}) and {r.cycle for r in rows if r.length <= 4} == short
    shortest, reported = {}, {}
    for a, b in e:
        if a in bfs(e, b):
            shortest[a, b] = bfs(e, b)[a] + 1
    for r in rows:
        path = r.cycle.split(" → ")
        assert path[0] == path[-1] == min(path) and len(path) - 1 == len(set(path)) == r.length
        for pair in zip(path, path[1:]):
            reported[pair] = min(r.length, reported.get(pair, r.length))
    assert reported == shortest and max(shortest.values()) > 4


@SIZES
@pytest.mark.parametrize("seed", [3, 8])
def test_strong_components(spark, seed, small):
    e = sorted({*random_edges(seed, 30, 40), ("n00", "n00"), ("a", "b")})
    edges, nodes = frames(spark, e, ["lone"])
    names = [r.node for r in nodes.collect()]
    ahead = {n: set(bfs(e, n)) for n in names}
    want = {}
    for n in names:
        own = {m for m in ahead[n] if n in ahead[m]}
        want[n] = (min(own), len(own) > 1 or (n, n) in e)
    assert {r.node: (r.component, r.cyclic) for r in graph.strong_components(edges, nodes, small).collect()} == want


@SIZES
def test_communities_are_split_and_loose_ones_left_out(spark, small):
    """Two cliques hang together by one edge, and a long ring has too few links."""
    clique = [(f"{k}{i}", f"{k}{j}") for k in "ab" for i in range(6) for j in range(i)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 30:02}") for i in range(30)]
    edges, nodes = frames(spark, [*clique, ("a0", "b0"), *ring], ["lone"])
    found = {r.node: r.community for r in graph.communities(edges, nodes, largest=0.2, min_split=5, min_cohesion=0.5, small=small).collect()}
    assert len({found[f"a{i}"] for i in range(6)}) == 1 and len({found[f"b{i}"] for i in range(6)}) == 1 and found["a0"] != found["b0"]
    assert found["lone"] == "lone" and "-1" in {found[f"r{i:02}"] for i in range(30)} | {"-1"}
    whole = graph.communities(edges, nodes, largest=1.0, small=small)
    assert whole.where("community = '-1'").count() == 0 and graph.modularity(edges, whole) > 0.6
