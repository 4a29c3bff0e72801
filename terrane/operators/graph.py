"""Graph operators as rounds of joins. Each round is written to the shared folder, so plans stay short and losses cheap.

A graph of at most SMALL edges is solved by one task that holds it, with the same result; larger ones take the rounds.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.numbering import numbered
from terrane.session import cut

SMALL = 500_000  # edges, and nodes, that one task holds


def _fits(small: int, *parts: DataFrame) -> bool:
    """Whether each of these written tables is small enough for one task."""
    return all(p.count() <= small for p in parts)


def _in_one_task(edges: DataFrame, nodes: DataFrame, solve: Callable[[list, list], list[tuple]], schema: str) -> DataFrame:
    """The rows that `solve` makes of lists of all edges (src, dst) and of all nodes; their number is checked before."""
    rows = edges.select("src", "dst").unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [r for part in parts for r in part.itertuples(index=False, name=None)]
        if every:
            found = solve([(a, b) for a, b in every if isinstance(b, str)], [a for a, b in every if not isinstance(b, str)])
            for at in range(0, len(found), 10_000):
                yield pd.DataFrame(found[at : at + 10_000], columns=names, dtype=object)

    return rows.repartition(1).mapInPandas(run, schema)


def _after(edges: list) -> dict[str, list[str]]:
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    return out


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, small: int = SMALL) -> DataFrame:
    """(node, depth, parent) of all nodes reachable from `starts` (node) along (src, dst): breadth first, each node once.

    The parent is the least node of the round before that leads there; starts have none and depth 0.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    seen = cut(starts.select("node").where("node IS NOT NULL").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), "reach0")
    if _fits(small, e, seen):

        def search(edges: list, nodes: list) -> list[tuple]:
            after = _after(edges)
            found: dict[str, tuple] = {n: (n, 0, None) for n in nodes}
            front, depth = sorted(nodes), 0
            while front and (max_depth is None or depth < max_depth):
                depth += 1
                new: dict[str, tuple] = {}
                for n in front:  # in order, so the first to lead there is the least
                    for m in after[n]:
                        if m not in found and m not in new:
                            new[m] = (m, depth, n)
                found |= new
                front = sorted(new)
            return list(found.values())

        return _in_one_task(e, seen, search, "node string, depth int, parent string")
    front, depth, all_seen = seen, 0, seen
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.select(F.col("node").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        step = step.join(all_seen.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
        front = cut(step.select("node", F.lit(depth).alias("depth"), "parent"), f"reach{depth}")
        if front.isEmpty():
            break
        all_seen = all_seen.unionByName(front)
    return all_seen


def shortest_path(edges: DataFrame, start: str, end: str, small: int = SMALL) -> DataFrame:
    """(step, node, via) of a shortest undirected path: `via` is → for an edge along its direction and ↩ against it. Empty if there is none.

    The search ends with the round that meets `end`; each round's parents are its own rows, so the path is traced by
    doubling the steps that a row leads back, not node by node.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst").distinct(), "path_edges")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = cut(reach(both, spark.createDataFrame([(start,)], "node string"), small=small), "path")
    path = _back(found.select("node", "parent", F.col("depth").alias("step")), end, small)
    along = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).withColumn("_along", F.lit(True))
    path = path.join(along, (F.col("parent") == F.col("_s")) & (F.col("node") == F.col("_d")), "left")
    return path.select("step", "node", F.when(F.col("parent").isNull(), None).when(F.col("_along"), "→").otherwise("↩").alias("via"))


def _back(links: DataFrame, end: str, small: int) -> DataFrame:
    """The rows (node, parent, step) from `end` back to where there is no parent, by as many rounds as the logarithm of their number.

    After a round, `far` is twice as many steps back as before; what has been met takes along what is as far from it.
    """
    links = cut(links, "links")
    if _fits(small, links):
        up = links.where("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"))

        def walk(edges: list, nodes: list) -> list[tuple]:
            parent, at, out = dict(edges), end if end in set(nodes) else None, []
            while at is not None:
                out.append((at,))
                at = parent.get(at)
            return out

        return links.join(_in_one_task(up, links, walk, "node string"), "node", "left_semi")
    jump = cut(links.where("parent IS NOT NULL").select("node", F.col("parent").alias("far")), "jump0")
    met = cut(links.where(F.col("node") == end).select("node"), "met0")
    n = 0
    while not jump.isEmpty():
        n += 1
        step = met.join(jump, "node").select(F.col("far").alias("node"))
        met = cut(met.unionByName(step).distinct(), f"met{n}")
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.far") == F.col("b.node")).select("a.node", "b.far"), f"jump{n}")
    return links.join(met, "node", "left_semi")


def components(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component): the least node connected to each, by label minimum and pointer jumping; rounds grow with the logarithm of the longest path.

    Minima are taken map-side first, so a hub's neighbours do not meet in one task.
    """
    links = cut(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    every = cut(nodes.select("node").where("node IS NOT NULL").distinct(), "nodes")
    if _fits(small, links, every):

        def unite(edges: list, nodes: list) -> list[tuple]:
            up = {n: n for n in nodes}

            def root(x: str) -> str:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for a, b in edges:
                if a in up and b in up:
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
            return [(n, root(n)) for n in nodes]

        return _in_one_task(links, every, unite, "node string, component string")
    both = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    labels = cut(every.select("node", F.col("node").alias("label")), "labels0")
    n = 0
    while True:
        n += 1
        near = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("_n")).agg(F.min("label").alias("_l"))
        new = labels.join(near, F.col("node") == F.col("_n"), "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"), F.col("label").alias("old"))
        # The label's own label may be smaller still.
        own = new.select(F.col("node").alias("_m"), F.col("label").alias("_ml"))
        jumped = cut(new.join(own, F.col("label") == F.col("_m"), "left").select("node", F.least("label", F.coalesce("_ml", "label")).alias("label"), "old"), f"labels{n}")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def islands(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """Components by size (then least node): (component, rank, size, label); the largest is main, the others islands."""
    by = components(edges, nodes, small).groupBy("component").agg(F.count("*").alias("size"))
    ranked = numbered(by.withColumn("_less", -F.col("size")), [], ["_less", "component"], "rank")
    rows = ranked.select("component", "rank", "size")
    return rows.withColumn("label", F.when(F.col("rank") == 0, "main").otherwise(F.concat(F.lit("island-"), F.col("rank").cast("string"))))


def cyclic_edges(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """The edges that lie on some cycle: those inside a strong component, and loops."""
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    parts = strong_components(e, e.select(F.explode(F.array("src", "dst")).alias("node")), small).where("cyclic").select("node", "component")
    parts = cut(parts, "cyclic")
    return cut(e.join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst").where("a = b").select("src", "dst"), "on_cycles")


def cycles(edges: DataFrame, longest: int = 4, small: int = SMALL) -> DataFrame:
    """(cycle, length) of simple cycles up to `longest` edges, each written once from its least node; longer ones are in `circular`.

    Paths grow only over edges that lie on some cycle and never below their first node.
    """
    e = cyclic_edges(edges, small)
    return _written(e.select(F.array("src").alias("path")) if e.isEmpty() else _short(e, longest))


def circular(edges: DataFrame, longest: int = 4, small: int = SMALL) -> DataFrame:
    """(cycle, length) of `cycles` and, for each edge that is on longer ones only, a shortest through it: each edge of a cycle is on some row."""
    e = cyclic_edges(edges, small)
    if e.isEmpty():
        return _written(e.select(F.array("src").alias("path")))
    short = cut(_short(e, longest), "short")
    return _written(short.unionByName(_closing(e, short)))


def _written(paths: DataFrame) -> DataFrame:
    return paths.select(F.array_join(F.concat("path", F.array(F.get("path", F.lit(0)))), " → ").alias("cycle"), F.size("path").alias("length"))


def _short(e: DataFrame, longest: int) -> DataFrame:
    loops = e.where("src = dst").select(F.array("src").alias("path"))
    paths = cut(e.where("src < dst").select(F.array("src", "dst").alias("path")), "paths1")
    found = [loops]
    for n in range(2, longest + 1):
        last, first = F.element_at("path", -1), F.get("path", F.lit(0))
        ends = paths.select("path", last.alias("src"), first.alias("first")).join(e, "src")
        found.append(ends.where("dst = first").select("path"))
        if n < longest:
            paths = cut(ends.where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")), f"paths{n}")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _closing(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(path) of a shortest cycle, the least of them from that edge, through each edge that is on no cycle of `known` (path)."""
    at = F.transform("path", lambda x, i: F.struct(x.alias("_s"), F.coalesce(F.get("path", i + 1), F.get("path", F.lit(0))).alias("_d")))
    on = known.select(F.explode(at).alias("p")).select("p.*")
    left = edges.where("src <> dst").join(on, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")
    front = cut(left.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").alias("node"), F.array("src", "dst").alias("path")), "closing0")
    seen, found, n = front.select("a", "b", "node"), front.select("path").limit(0), 0
    while not front.isEmpty():
        n += 1
        step = front.join(edges, F.col("node") == F.col("src")).groupBy("a", "b", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        step = cut(step.withColumnRenamed("dst", "node").join(seen, ["a", "b", "node"], "left_anti"), f"step{n}")
        closed = step.where("node = a")
        found = found.unionByName(closed.select(F.slice("path", 1, n + 1).alias("path")))
        front = cut(step.join(closed.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "node", "path"), f"closing{n}")
        seen = seen.unionByName(front.select("a", "b", "node"))
    first = F.array_position("path", F.array_min("path")).cast("int")
    return found.select(F.concat(F.slice("path", first, F.size("path")), F.slice("path", F.lit(1), first - 1)).alias("path")).distinct()


def levels(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, level): 0 for nodes without an incoming edge, else one more than the highest level before; null on and behind cycles.

    Each round settles the nodes of one level, those whose every predecessor is settled.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct(), "dag")
    every = cut(nodes.select("node").distinct(), "nodes")
    if _fits(small, e, every):
        return _in_one_task(e, every, _settle, "node string, level int")
    # Open are the edges whose source is not settled; a round takes those out of its nodes, and what has none left is next.
    open_edges, left, done, n = e, every, None, 0
    while True:
        free = left.join(open_edges.select(F.col("dst").alias("_d")), F.col("node") == F.col("_d"), "left_anti")
        free = cut(free.select("node", F.lit(n).alias("level")), f"level{n}")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        settled = free.select(F.col("node").alias("_f"))
        open_edges = cut(open_edges.join(settled, F.col("src") == F.col("_f"), "left_anti"), f"open{n}")
        left = cut(left.join(settled, F.col("node") == F.col("_f"), "left_anti"), f"left{n}")
        n += 1
    if done is None:
        return every.select("node", F.lit(None).cast("int").alias("level"))
    return done.unionByName(left.select("node", F.lit(None).cast("int").alias("level")))


def _settle(edges: list, nodes: list) -> list[tuple]:
    after, before = _after(edges), defaultdict(int)
    for _, b in edges:
        before[b] += 1
    level = {n: 0 for n in nodes if not before[n]}
    free = deque(level)
    while free:
        n = free.popleft()
        for m in after[n]:
            before[m] -= 1
            if not before[m] and m not in level:  # the last edge to come is from the highest level
                level[m] = level[n] + 1
                free.append(m)
    return [(n, level.get(n)) for n in nodes]


def critical_path(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(level, node): one longest path of the acyclic part, the least nodes first."""
    lv = cut(levels(edges, nodes, small).where("level IS NOT NULL"), "levels")
    top = lv.orderBy(F.desc("level"), "node").head()
    if top is None:
        return lv.select("level", "node")
    # Each node's least predecessor of the level before leads back along a longest path to it.
    at = lv.select(F.col("node").alias("dst"), F.col("level").alias("to"))
    steps = edges.select("src", "dst").join(lv.toDF("src", "level"), "src").join(at, "dst").where("level = to - 1")
    parent = steps.groupBy(F.col("dst").alias("_n")).agg(F.min("src").alias("parent"))
    links = lv.join(parent, F.col("node") == F.col("_n"), "left").select("node", "parent", F.col("level").alias("step"))
    return _back(links, top.node, small).select(F.col("step").alias("level"), "node")


def cascade(relationships: DataFrame, start: str, small: int = SMALL) -> DataFrame:
    """What deleting from `start` does: (node, depth, action) of each table reached against the foreign keys, first edge first."""
    r = cut(relationships.select(F.col("to_table").alias("src"), F.col("from_table").alias("dst"), "on_delete"), "fks")
    found = reach(r, r.sparkSession.createDataFrame([(start,)], "node string"), small=small)
    rule = r.groupBy(F.col("src").alias("_s"), F.col("dst").alias("_d")).agg(F.min(F.coalesce("on_delete", F.lit(""))).alias("rule"))
    rows = found.where("depth > 0").join(rule, (F.col("parent") == F.col("_s")) & (F.col("node") == F.col("_d")))
    first = F.col("depth") == 1
    action = (
        F.when((F.col("rule") == "CASCADE") & first, "CASCADE DELETE")
        .when(F.col("rule") == "CASCADE", "CASCADE")
        .when(F.col("rule").isin("SET_NULL", "SET NULL"), "SET NULL")
        .when(first, "RESTRICT / ERROR")
        .otherwise("RESTRICT")
    )
    return rows.select("node", "depth", "parent", action.alias("action"))


def impact(edges: DataFrame, nodes: DataFrame, starts: DataFrame, max_depth: int = 5, direction: str = "out", small: int = SMALL) -> DataFrame:
    """(node, type, depth, parent, kind, leaf) of what changes to `starts` (node) affect, at most `max_depth` steps away.

    `direction` follows edges `out` of an object or `in` to it. `nodes` (node, type) give types, "unknown" where there is none;
    `kind` is direct for one step, else transitive; a leaf leads to nothing further. Several starts give one merged
    result: each object once, at its least depth.
    """
    if direction not in ("out", "in"):
        raise ValueError("direction is out or in")
    e = edges.select("src", "dst") if direction == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = cut(reach(e, starts, max_depth, small), "impact")
    types = nodes.select(F.col("node").alias("_n"), "type").dropDuplicates(["_n"])
    used = found.where("parent IS NOT NULL").select(F.col("parent").alias("_p"), F.lit(True).alias("_leads")).distinct()
    rows = found.where("depth > 0").join(types, F.col("node") == F.col("_n"), "left").join(used, F.col("node") == F.col("_p"), "left")
    kind = F.when(F.col("depth") == 1, "direct").otherwise("transitive")
    return rows.select("node", F.coalesce("type", F.lit("unknown")).alias("type"), "depth", "parent", kind.alias("kind"), F.col("_leads").isNull().alias("leaf"))


def impact_paths(found: DataFrame) -> DataFrame:
    """(node, path) of each leaf of an `impact`: the objects from a start to it. As many joins as it is deep."""
    up = found.select(F.col("node").alias("_n"), F.col("parent").alias("_up"))
    rows = found.where("leaf").select("node", F.col("parent").alias("at"), F.array("node").alias("path"))
    for _ in range(found.agg(F.max("depth")).first()[0] or 0):
        rows = rows.withColumn("path", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path")))
        rows = rows.join(up, F.col("at") == F.col("_n"), "left").select("node", F.col("_up").alias("at"), "path")
    return rows.select("node", "path")


def _weights(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops as (src, dst, w), src < dst."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def _louvain(edges: list[tuple[str, str, float]], nodes: list[str], resolution: float) -> dict[str, str]:
    """The community of each node, named by its least: nodes move in order of name until none gains, then communities are nodes.

    Staying wins ties, then the least name. Loops are the edges inside a community.
    """
    member = {n: n for n in nodes}
    near: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        if a != b:
            near[b][a] = near[b].get(a, 0.0) + w
    m2 = sum(w if a != b else 2 * w for a, own in near.items() for b, w in own.items()) or 1.0
    while True:
        degree = {n: sum(w if b != n else 2 * w for b, w in own.items()) for n, own in near.items()}
        at = {n: n for n in near}
        total = dict(degree)
        moved_once = False
        while True:
            moved = False
            for n in sorted(near):
                inside: dict[str, float] = {at[n]: 0.0}
                for b, w in near[n].items():
                    if b != n:
                        inside[at[b]] = inside.get(at[b], 0.0) + w
                total[at[n]] -= degree[n]
                gain = {c: w - resolution * degree[n] * total[c] / m2 for c, w in inside.items()}
                best = min(gain, key=lambda c: (-gain[c], c != at[n], c))
                if gain[best] <= gain[at[n]] + 1e-12:
                    best = at[n]
                if best != at[n]:
                    at[n], moved = best, True
                total[best] += degree[n]
            moved_once |= moved
            if not moved:
                break
        if not moved_once:
            break
        name: dict[str, str] = {}
        for n in sorted(near):
            name.setdefault(at[n], n)
        quotient: dict[str, dict[str, float]] = {}
        for a, own in near.items():
            for b, w in own.items():
                if a <= b:
                    x, y = sorted((name[at[a]], name[at[b]]))
                    quotient.setdefault(x, {})[y] = quotient.get(x, {}).get(y, 0.0) + w
                    if x != y:
                        quotient.setdefault(y, {})[x] = quotient.get(y, {}).get(x, 0.0) + w
        for c in set(name.values()):
            quotient.setdefault(c, {})
        member = {n: name[at[c]] for n, c in member.items()}
        near = quotient
    least: dict[str, str] = {}
    for n in sorted(member):
        least.setdefault(member[n], n)
    return {n: least[c] for n, c in member.items()}


def _moves(w: DataFrame, every: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(node, c) after rounds in which the nodes of a coin's side move to the neighbouring community with the greatest gain.

    Weights between a node and communities are summed map-side, so hubs are no hot keys.
    """
    both = cut(w.where("src <> dst").unionByName(w.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "weights")
    loops = w.where("src = dst").select(F.col("src").alias("node"), (2 * F.col("w")).alias("k"))
    deg = both.select(F.col("src").alias("node"), F.col("w").alias("k")).unionByName(loops).groupBy("node").agg(F.sum("k").alias("k"))
    at = cut(every.join(deg, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("node").alias("c")), "community0")
    m2 = at.agg(F.sum("k")).first()[0] or 1.0
    for n in range(1, rounds + 1):
        total = at.groupBy("c").agg(F.sum("k").alias("tot"))
        near = both.join(at.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("inside"))
        mine = at.select("node", F.col("c").alias("to"), F.lit(0.0).alias("inside"))
        options = near.unionByName(mine).groupBy("node", "to").agg(F.sum("inside").alias("inside")).join(at, "node").join(total.withColumnRenamed("c", "to"), "to")
        rest = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0)
        gain = F.col("inside") - resolution * F.col("k") * rest / m2
        # Staying wins ties, then the least name.
        best = options.groupBy("node", "k", "c").agg(F.min(F.struct((-gain).alias("g"), (F.col("to") != F.col("c")).alias("moves"), F.col("to").alias("to"))).alias("b"))
        side = F.pmod(F.xxhash64("node", F.lit(n)), F.lit(2)) == 0
        moved = cut(best.select("node", "k", F.when(side, F.col("b.to")).otherwise(F.col("c")).alias("c"), (F.col("b.to") != F.col("c")).alias("wants")), f"community{n}")
        at = moved.drop("wants")
        if moved.where("wants").isEmpty():
            break
    return at.select("node", "c")


def _cluster(w: DataFrame, every: DataFrame, resolution: float, small: int, level: int = 0) -> DataFrame:
    """(node, community) by moves; communities are nodes of a smaller graph, until one task solves that to its end."""
    n = every.count()
    if w.count() <= small and n <= small:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [r for part in parts for r in part.itertuples(index=False, name=None)]
            found = _louvain([(a, b, x) for a, b, x in rows if isinstance(b, str)], [a for a, b, _ in rows if not isinstance(b, str)], resolution)
            if found:
                yield pd.DataFrame(sorted(found.items()), columns=["node", "community"])

        rows = w.select("src", "dst", "w").unionByName(every.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("w")))
        return rows.repartition(1).mapInPandas(run, "node string, community string")
    at = _moves(w, every, resolution, 12)
    name = at.groupBy("c").agg(F.min("node").alias("to"))
    at = cut(at.join(name, "c").select("node", "to"), f"coarse{level}")
    groups = cut(at.select(F.col("to").alias("node")).distinct(), f"groups{level}")
    if groups.count() == n:
        return at.select("node", F.col("to").alias("community"))
    q = w.join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w"))
    above = _cluster(cut(q, f"quotient{level}"), groups, resolution, small, level + 1)
    joined = at.join(above.toDF("to", "over"), "to")
    least = joined.groupBy("over").agg(F.min("node").alias("community"))
    return joined.join(least, "over").select("node", "community")


def communities(
    edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, largest: float = 0.25, min_split: int = 10, min_cohesion: float | None = None, small: int = SMALL
) -> DataFrame:
    """(node, community) of high modularity, each community named by its least node.

    One with more than `largest` of all nodes, if that is `min_split` nodes or more, is split once at 1.5 times the
    resolution. With `min_cohesion`, nodes of communities with a lower share of linked pairs are in community -1.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    every = cut(nodes.select("node").where("node IS NOT NULL").distinct(), "nodes")
    e = cut(e.join(every.toDF("src"), "src", "left_semi").join(every.toDF("dst"), "dst", "left_semi"), "known")
    w = cut(_weights(e), "weights")
    found = cut(_cluster(w, every, resolution, small), "communities")
    most = int(every.count() * largest)
    if most >= min_split:
        big = [r.community for r in found.groupBy("community").count().where(F.col("count") > most).collect()]  # fewer than 1 / largest
        for c in big:
            own = cut(found.where(F.col("community") == c).select("node"), "oversized")
            inside = w.join(own.toDF("src"), "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi")
            parts = _cluster(cut(inside, "inside"), own, resolution * 1.5, small)
            found = cut(found.where(F.col("community") != c).unionByName(parts), "split")
    if min_cohesion is None:
        return found
    loose = group_cohesion(e, found).where(F.col("cohesion") < min_cohesion).select(F.col("community").alias("_c"))
    rows = found.join(loose, F.col("community") == F.col("_c"), "left")
    return rows.select("node", F.when(F.col("_c").isNull(), F.col("community")).otherwise("-1").alias("community"))


def group_cohesion(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(community, size, inside, cohesion) of a partition (node, community): the share of its pairs that an edge links; 1 for a single node."""
    e = _weights(edges).join(groups.toDF("src", "a"), "src").join(groups.toDF("dst", "b"), "dst").where("a = b")
    inside = e.groupBy(F.col("a").alias("_c")).agg(F.count("*").alias("inside"))
    sizes = groups.groupBy("community").agg(F.count("*").alias("size")).join(inside, F.col("community") == F.col("_c"), "left")
    pairs = F.col("size") * (F.col("size") - 1) / 2
    share = F.when(F.col("size") == 1, 1.0).otherwise(F.coalesce("inside", F.lit(0)) / pairs)
    return sizes.select("community", "size", F.coalesce("inside", F.lit(0)).alias("inside"), share.alias("cohesion"))


def strong_components(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component, cyclic): the least node of those that reach a node and are reached by it, and whether a cycle is among them.

    Beyond one task: least names are carried forward until none changes; nodes with the name of a node that they
    lead back to are its component, and the rest goes on without them.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    every = cut(nodes.select("node").where("node IS NOT NULL").distinct(), "nodes")
    loops = e.where("src = dst").select(F.col("src").alias("_l"), F.lit(True).alias("_loop"))
    if _fits(small, e, every):
        found = _in_one_task(e, every, _tarjan, "node string, component string")
    else:
        found, left, links, n = None, every, cut(e.where("src <> dst"), "strong0"), 0
        while not left.isEmpty():
            n += 1
            names = cut(left.select("node", F.col("node").alias("label")), f"names{n}")
            while True:
                near = links.join(names.toDF("src", "label"), "src").groupBy(F.col("dst").alias("_n")).agg(F.min("label").alias("_l"))
                new = cut(names.join(near, F.col("node") == F.col("_n"), "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"), F.col("label").alias("old")), f"names{n}")
                names = new.select("node", "label")
                if new.where("label <> old").isEmpty():
                    break
            same = links.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            back = reach(same, names.where("node = label").select("node"), small=small)
            own = cut(back.select("node").join(names, "node").select("node", F.col("label").alias("component")), f"strong{n}")
            found = own if found is None else found.unionByName(own)
            gone = own.select(F.col("node").alias("_g"))
            left = cut(left.join(gone, F.col("node") == F.col("_g"), "left_anti"), f"left{n}")
            links = cut(links.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone.withColumnRenamed("_g", "_h"), F.col("dst") == F.col("_h"), "left_anti"), f"links{n}")
        if found is None:
            found = every.select("node", F.col("node").alias("component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("_n"), F.min("node").alias("_least"))
    rows = found.join(sizes, "component").join(loops, F.col("node") == F.col("_l"), "left")
    return rows.select("node", F.col("_least").alias("component"), ((F.col("_n") > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic"))


def _tarjan(edges: list, nodes: list) -> list[tuple]:
    """Strong components with a stack of our own, as chains can be long."""
    after = _after(edges)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[tuple] = []
    for start in nodes:
        if start in order:
            continue
        work = [(start, iter(after[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            n, rest = work[-1]
            for m in rest:
                if m not in order:
                    order[m] = low[m] = len(order)
                    stack.append(m)
                    on.add(m)
                    work.append((m, iter(after[m])))
                    break
                if m in on:
                    low[n] = min(low[n], order[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == order[n]:
                    group = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        group.append(m)
                        if m == n:
                            break
                    out += [(m, min(group)) for m in group]
    return out


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """Of a partition (node, community)."""
    e = edges.select("src", "dst").where("src <> dst")
    g = groups.select(F.col("node"), F.col("community"))
    m = e.count() or 1
    inside = e.join(g.toDF("src", "a"), "src").join(g.toDF("dst", "b"), "dst").where("a = b").count()
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).join(g, "node").groupBy("community").agg(F.count("*").alias("k"))
    squares = ends.select(F.sum(F.col("k").cast("double") ** 2)).first()[0] or 0.0
    return inside / m - squares / (4.0 * m * m)
