"""Parent-child rows to whole hierarchies by contracting fragments (problem 3).

Each round places a node in the same partition as its parent where a coin tossed by hash allows it,
follows parent links inside each partition to where they leave it (the fragment's exit), and keeps
only the nodes at which links enter another partition: the quotient forest. That is solved in the same
way until it fits one task, and the fragments' paths are then put behind the paths of their exits.
Half of the coin tosses differ, so a quotient of any shape, a single long chain included, is smaller
than its forest by a constant factor, and the number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import cut

ROWS_PER_PART = 20_000  # nodes of a partition, and of a quotient that one task solves
LABELS_PER_BATCH = 500_000  # ids in the paths that a task holds and gives back at a time
MAX_BROADCAST = 100_000  # hot parents, those of more than half a partition of nodes, are sent to all executors up to this number

_FRAGMENT = "id string, ext string, frag array<string>, least string, cyc string"


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the links of one partition's nodes (id, next, label, least, cyc) to their exits."""
    frames = list(parts)
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    ids, labels, least = rows["id"].tolist(), rows["label"].tolist(), rows["least"].tolist()
    nexts = [x if isinstance(x, str) else None for x in rows["next"]]
    cyc = [x if isinstance(x, str) else None for x in rows["cyc"]]
    at = {x: i for i, x in enumerate(ids)}
    ext: list = [None] * len(ids)
    up = [-1] * len(ids)  # the node before in the fragment; paths are written out only as they are given back
    new, walking, done = 0, 1, 2
    state = bytearray(len(ids))
    for start in range(len(ids)):
        walk, u = [], start
        while state[u] == new:
            v = at.get(nexts[u])
            if cyc[u] is not None or v is None:
                state[u] = done
                if cyc[u] is None:
                    ext[u] = nexts[u]
                break
            state[u] = walking
            walk.append(u)
            u = v
        if state[u] == walking:  # the walk met itself: a ring
            ring = walk[walk.index(u) :]
            del walk[len(walk) - len(ring) :]
            code = min(least[x] for x in ring)
            for x in ring:
                cyc[x], state[x] = code, done
        for x in reversed(walk):
            y = at[nexts[x]]
            state[x] = done
            if cyc[y] is not None:
                cyc[x] = cyc[y]
            else:
                ext[x], up[x] = ext[y], y
                least[x] = min(least[x], least[y])  # if the fragment is part of a ring, its share of the least code

    start, held, frags = 0, 0, []
    for i in range(len(ids)):
        frag = None
        if cyc[i] is None:
            chain, u = [], i
            while u >= 0:
                chain.append(labels[u])
                u = up[u]
            frag = [x for own in reversed(chain) for x in own]
            held += len(frag)
        frags.append(frag)
        if held >= LABELS_PER_BATCH or i == len(ids) - 1:
            own = slice(start, i + 1)
            yield pd.DataFrame({"id": ids[own], "ext": ext[own], "frag": frags, "least": least[own], "cyc": cyc[own]})
            start, held, frags = i + 1, 0, []


def _solve(nodes: DataFrame, size: int, rows_per_part: int, level: int) -> DataFrame:
    """(id, path, cyc) of each node of (id, next, label, least, cyc); a `next` that is no node ends the path."""
    if size <= rows_per_part:
        solved = nodes.repartition(1).mapInPandas(_contract, _FRAGMENT)
        return solved.select("id", F.col("frag").alias("path"), "cyc")

    nid, nxt = F.col("id"), F.col("next")

    def coin(c):
        return F.xxhash64(c, F.lit(level)).bitwiseAND(F.lit(1)) == 1

    # A hot parent draws no children to its partition. There are at most size / most of them.
    most = max(1, rows_per_part // 2)
    hot = nodes.where("next IS NOT NULL").groupBy("next").count().where(F.col("count") > most).select(nxt.alias("_hot"))
    hot = F.broadcast(hot) if size // most <= MAX_BROADCAST else hot
    placed = nodes.join(hot, nxt == F.col("_hot"), "left")
    with_parent = nxt.isNotNull() & F.col("_hot").isNull() & ~coin(nid) & coin(nxt)
    placed = placed.withColumn("_at", F.when(with_parent, nxt).otherwise(nid))
    placed = placed.repartition(-(-size // rows_per_part), "_at").select("id", "next", "label", "least", "cyc")
    frags = cut(placed.mapInPandas(_contract, _FRAGMENT), f"fragments{level}")

    entered = frags.where("ext IS NOT NULL").select(F.col("ext").alias("_id")).distinct()
    # An entry that is no node is an unknown parent: its label is empty, and what hangs on it is a root.
    quotient = entered.join(frags, F.col("_id") == nid, "left").select(
        F.col("_id").alias("id"),
        F.col("ext").alias("next"),
        F.coalesce("frag", F.array().cast("array<string>")).alias("label"),
        F.coalesce("least", "_id").alias("least"),
        "cyc",
    )
    quotient = cut(quotient, f"quotient{level}")
    above = _solve(quotient, quotient.count(), rows_per_part, level + 1)
    above = above.select(nid.alias("_aid"), F.col("path").alias("_path"), F.col("cyc").alias("_acyc"))
    ring = F.coalesce("cyc", "_acyc")
    path = F.concat(F.coalesce("_path", F.array().cast("array<string>")), "frag")
    return frags.join(above, F.col("ext") == F.col("_aid"), "left").select(
        "id", F.when(ring.isNull(), path).alias("path"), ring.alias("cyc")
    )


def current_categories(rows: DataFrame, code_col: str, parent_col: str, at_col: str) -> DataFrame:
    """(id, next): the latest row of each code; of equally late rows, the one with the greater parent.

    Codes compare trimmed and upper-cased. Rows with a null or blank code are no categories; a null or
    blank parent is none.
    """

    def code(name: str):
        return F.nullif(F.upper(F.btrim(rows[name], F.lit(" \t\r\n"))), F.lit(""))

    named = rows.select(code(code_col).alias("id"), code(parent_col).alias("next"), rows[at_col].alias("at"))
    latest = named.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("at", "next")).alias("last"))
    return latest.select("id", "last.next")


def hierarchy(links: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Path, depth and root of every node of (id, next), and the nodes caught in cycles.

    `path` leads from the root to the node, both included; `depth` of a root is 0. A node whose chain of
    parents ends in a cycle, on it or below it, has a `cycle_code`, the least id on that cycle, and no
    path, depth or root. A parent that is no node makes a root. `id` must be unique; a table without rows
    gives none.
    """
    nodes = links.select("id", "next", F.array("id").alias("label"), F.col("id").alias("least"), F.lit(None).cast("string").alias("cyc"))
    nodes = cut(nodes, "nodes")
    solved = _solve(nodes, nodes.count(), rows_per_part, 0)
    return solved.select(
        "id",
        "path",
        (F.size("path") - 1).alias("depth"),
        F.get("path", F.lit(0)).alias("root"),
        F.col("cyc").alias("cycle_code"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of the nodes that have a path, without a shuffle and without lists that grow with a tree."""
    above = paths.where("path IS NOT NULL").select("id", "depth", F.posexplode("path").alias("place", "ancestor"))
    return above.where("place < depth").select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("place")).alias("distance"))


def all_descendants(links: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(ancestor, descendant, distance) of every node of (id, next), those on and below cycles included.

    A descendant's chain of parents leads to the ancestor; the distance is the number of steps until it first
    does. A member of a ring so has all other members and all that hangs below any of them as descendants. No node is its own.
    """
    links = cut(links.select("id", "next"), "links")
    solved = cut(hierarchy(links, rows_per_part), "solved")
    caught = links.join(solved.where("cycle_code IS NOT NULL").select("id", "cycle_code"), "id")
    # Without the link of its least member a ring is a tree, whose path to that link's parent is the whole ring.
    least = F.col("id") == F.col("cycle_code")
    opened = cut(hierarchy(caught.select("id", F.when(~least, F.col("next")).alias("next")), rows_per_part), "opened")
    rings = caught.where(least).select(F.col("cycle_code").alias("_code"), F.col("next").alias("_last")).join(opened.select(F.col("id").alias("_last"), F.col("path").alias("ring")), "_last")
    round_ = opened.join(rings, F.col("root") == F.col("_code"))
    # Members on the path are behind it already; the others come after the link that was left out.
    met = F.size(F.array_intersect("path", "ring"))
    round_ = round_.select("id", "depth", F.size("ring").alias("n"), met.alias("met"), F.posexplode("ring").alias("place", "ancestor")).where("place >= met")
    round_ = round_.select("ancestor", F.col("id").alias("descendant"), (F.col("depth") + F.col("n") - F.col("place")).alias("distance"))
    return descendants(solved).unionByName(descendants(opened)).unionByName(round_)
