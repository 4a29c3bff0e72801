"""Queries of the graph operators over foreign keys and file dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions.names import norm_name
from terrane.operators import catalog, graph, hierarchy, rules
from terrane.plans.catalog import _P_EDGES, _PAIRS, _PROPERTIES, _R, _T, columns, tables
from terrane.plans.problems import _P3_CTE
from terrane.plans.registry import query, table
from terrane.session import cut

_REC = _R.replace("WITH t AS", "WITH RECURSIVE t AS", 1)


def edges(spark, d):
    return catalog.fk_edges(tables(spark, d))


def nodes(spark, d):
    return tables(spark, d).select(F.col("full_name").alias("node"))


@query(
    "islands",
    _REC + """, cc(node, other) AS (SELECT full_name, full_name FROM t UNION SELECT cc.node, b.q FROM cc JOIN both_ways b ON b.p = cc.other),
c AS (SELECT node, min(other) AS component FROM cc GROUP BY 1), g AS (SELECT component, count(*) AS size FROM c GROUP BY 1),
k AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) - 1 AS rank, size FROM g)
SELECT *, CASE WHEN rank = 0 THEN 'main' ELSE 'island-' || rank END AS label FROM k""",
)
def islands(spark, d):
    return graph.islands(edges(spark, d), nodes(spark, d))


@query(
    "cycles",
    _REC + """, w(path) AS (SELECT [src, dst] FROM e WHERE src < dst
  UNION ALL SELECT list_append(path, e.dst) FROM w JOIN e ON e.src = path[-1] WHERE e.dst > path[1] AND NOT list_contains(path, e.dst))
SELECT array_to_string(list_append(path, path[1]), ' → ') AS cycle, len(path)::INT AS length FROM w JOIN e ON e.src = path[-1] AND e.dst = path[1]
UNION ALL SELECT src || ' → ' || src, 1 FROM e WHERE src = dst""",
)
def cycles(spark, d):
    return graph.circular(edges(spark, d), 4)


_LEDGER = "'CORE.LEDGER_ENTRY'"


@query(
    "impact",
    _REC + f""", b(node, depth) AS (SELECT {_LEDGER}, 0 UNION SELECT r.from_table, b.depth + 1 FROM b JOIN r ON r.to_table = b.node WHERE b.depth < (SELECT count(*) FROM t)),
m AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1),
f AS (SELECT m.node, m.depth, min(p.node) AS parent FROM m JOIN r ON r.from_table = m.node JOIN m p ON p.node = r.to_table AND p.depth = m.depth - 1 GROUP BY 1, 2),
x AS (SELECT f.*, min(coalesce(r.on_delete, '')) AS rule FROM f JOIN r ON r.from_table = f.node AND r.to_table = f.parent GROUP BY ALL)
SELECT node, depth::INT AS depth, parent, CASE WHEN rule = 'CASCADE' AND depth = 1 THEN 'CASCADE DELETE' WHEN rule = 'CASCADE' THEN 'CASCADE' WHEN rule IN ('SET_NULL', 'SET NULL') THEN 'SET NULL'
  WHEN depth = 1 THEN 'RESTRICT / ERROR' ELSE 'RESTRICT' END AS action FROM x""",
)
def impact(spark, d):
    return graph.cascade(catalog.relationships(tables(spark, d)), "CORE.LEDGER_ENTRY")


@query(
    "impact_depths",
    _REC + """, b(node, depth) AS (SELECT src, 0 FROM e WHERE starts_with(src, 'BILLING.') UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 5),
m AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1) SELECT depth::INT AS depth, count(*) AS tables FROM m GROUP BY 1""",
)
def impact_depths(spark, d):
    e = edges(spark, d)
    starts = e.where(F.col("src").startswith("BILLING.")).select(F.col("src").alias("node"))
    return graph.reach(e, starts, 5).groupBy("depth").agg(F.count("*").alias("tables"))


def _far(spark, d):
    """Two tables that a path links: the first edge's source and the last of its component."""
    c = graph.components(edges(spark, d), nodes(spark, d))
    big = c.groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last")).orderBy(F.desc("n"), "component").head()
    return big.component, big["last"]


@query(
    "fk_path",
    _REC + """, cc(node, other) AS (SELECT full_name, full_name FROM t UNION SELECT cc.node, b.q FROM cc JOIN both_ways b ON b.p = cc.other),
g AS (SELECT c.component, count(*) AS n, max(node) AS last FROM (SELECT node, min(other) AS component FROM cc GROUP BY 1) c GROUP BY 1 ORDER BY n DESC, component LIMIT 1),
dist(node, depth) AS (SELECT component, 0 FROM g UNION SELECT b.q, x.depth + 1 FROM dist x JOIN both_ways b ON b.p = x.node WHERE x.depth < (SELECT count(*) FROM t)),
m AS (SELECT node, min(depth) AS depth FROM dist GROUP BY 1),
back(node, depth) AS (SELECT last, (SELECT depth FROM m WHERE node = last) FROM g
  UNION ALL SELECT (SELECT min(b.p) FROM both_ways b JOIN m ON m.node = b.p AND m.depth = back.depth - 1 WHERE b.q = back.node), back.depth - 1 FROM back WHERE back.depth > 0)
SELECT depth::INT AS step, node, CASE WHEN depth = 0 THEN NULL WHEN EXISTS (SELECT 1 FROM back p JOIN e ON e.src = p.node AND e.dst = back.node WHERE p.depth = back.depth - 1) THEN '→' ELSE '↩' END AS via FROM back""",
)
def fk_path(spark, d):
    a, b = _far(spark, d)
    return graph.shortest_path(edges(spark, d), a, b)


_LIN = _REC + _PAIRS + """, le AS (SELECT DISTINCT to_table || '.' || g AS src, from_table || '.' || f AS dst FROM p WHERE g IS NOT NULL AND f IS NOT NULL)"""


def _lineage(spark, d):
    r = catalog.relationships(tables(spark, d))
    p = r.select("from_table", "to_table", F.explode(F.arrays_zip("from_cols", "to_cols")).alias("p")).where("p.from_cols IS NOT NULL AND p.to_cols IS NOT NULL")
    return p.select(F.concat_ws(".", "to_table", "p.to_cols").alias("src"), F.concat_ws(".", "from_table", "p.from_cols").alias("dst")).distinct()


@query("lineage_down", _LIN + ", b(node, depth) AS (SELECT 'CORE.LEDGER_ENTRY.ENTRY_ID', 0 UNION SELECT le.dst, depth + 1 FROM b JOIN le ON le.src = node WHERE depth < (SELECT count(*) FROM le)) SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1")
def lineage_down(spark, d):
    return graph.reach(_lineage(spark, d), spark.createDataFrame([("CORE.LEDGER_ENTRY.ENTRY_ID",)], "node string")).select("node", "depth")


@query("lineage_up", _LIN + ", s AS (SELECT max(dst) AS m FROM le), b(node, depth) AS (SELECT m, 0 FROM s UNION SELECT le.src, depth + 1 FROM b JOIN le ON le.dst = node WHERE depth < (SELECT count(*) FROM le)) SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1")
def lineage_up(spark, d):
    e = _lineage(spark, d)
    start = e.agg(F.max("dst").alias("node"))
    return graph.reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).select("node", "depth")


# Referenced tables come before those that refer to them. The depth of the recursion is bounded by the number of tables, which only nodes
# on and behind cycles reach.
_DAG = """, g AS (SELECT dst AS src, src AS dst FROM e WHERE src <> dst),
b(node, level) AS (SELECT full_name, 0 FROM t UNION SELECT g.dst, level + 1 FROM b JOIN g ON g.src = b.node WHERE level < (SELECT count(*) FROM t)),
l AS (SELECT node, CASE WHEN max(level) < (SELECT count(*) FROM t) THEN max(level) END AS level FROM b GROUP BY 1)"""


def _dag(spark, d):
    return edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@query("topo_levels", _REC + _DAG + " SELECT node, level::INT AS level FROM l")
def topo_levels(spark, d):
    return graph.levels(_dag(spark, d), nodes(spark, d))


@query(
    "critical_path",
    _REC + _DAG + """,
back(node, level) AS (SELECT * FROM (SELECT node, level FROM l WHERE level IS NOT NULL ORDER BY level DESC, node LIMIT 1)
  UNION ALL SELECT (SELECT min(l.node) FROM g JOIN l ON l.node = g.src WHERE g.dst = back.node AND l.level = back.level - 1), back.level - 1 FROM back WHERE back.level > 0)
SELECT level::INT AS level, node FROM back""",
)
def critical_path(spark, d):
    return graph.critical_path(_dag(spark, d), nodes(spark, d))


@query(
    "migration_levels",
    """WITH RECURSIVE s AS (SELECT upper(trim(replace(table_name, '"', ''))) AS t, operation, source_file,
  dense_rank() OVER (ORDER BY list_resize(list_transform(string_split(replace(version, '_', '.'), '.'), lambda x: x::HUGEINT), 12, 0), statement_index) AS seq FROM operations WHERE table_name IS NOT NULL),
u AS (SELECT t, seq, 0 AS k, source_file, NULL::VARCHAR AS creator FROM s WHERE operation IN ('ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX')
  UNION ALL SELECT t, seq, 1, NULL, max(source_file) FROM s WHERE operation = 'CREATE_TABLE' GROUP BY 1, 2),
d AS (SELECT source_file, last_value(creator IGNORE NULLS) OVER (PARTITION BY t ORDER BY seq, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS creator FROM u),
g AS (SELECT DISTINCT creator AS src, source_file AS dst FROM d WHERE source_file IS NOT NULL AND creator <> source_file),
o AS (SELECT DISTINCT source_file FROM operations), n AS (SELECT count(*) AS n FROM o),
b(node, level) AS (SELECT source_file, 0 FROM o UNION SELECT g.dst, level + 1 FROM b JOIN g ON g.src = b.node WHERE level < (SELECT n FROM n)),
l AS (SELECT node, CASE WHEN max(level) < (SELECT n FROM n) THEN max(level) END AS level FROM b GROUP BY 1)
SELECT level::INT AS level, count(*) AS files FROM l GROUP BY 1""",
)
def migration_levels(spark, d):
    """How many files could run side by side, level by level; each depends on the creators, as of its statements, of the tables it changes."""
    ops = table(spark, d, "operations")
    dep = rules.creators_before(ops)
    lv = graph.levels(dep.select(F.col("depends_on").alias("src"), F.col("source_file").alias("dst")), ops.select(F.col("source_file").alias("node")))
    return lv.groupBy("level").agg(F.count("*").alias("files"))


_CHANGED = """x AS (SELECT DISTINCT upper(trim(replace(from_table, '"', ''))) AS src, upper(trim(replace(to_table, '"', ''))) AS dst FROM relationship_changes WHERE from_table IS NOT NULL AND to_table IS NOT NULL)"""


def _changes(spark, d):
    r = table(spark, d, "relationship_changes")
    return r.select(norm_name(F.col("from_table")).alias("src"), norm_name(F.col("to_table")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


@query(
    "change_circles",
    f"""WITH RECURSIVE {_CHANGED}, r(a, b) AS (SELECT src, dst FROM x UNION SELECT r.a, x.dst FROM r JOIN x ON x.src = r.b)
SELECT p.a AS node, min(p.b) AS component FROM r p JOIN r q ON q.a = p.b AND q.b = p.a GROUP BY 1""",
)
def change_circles(spark, d):
    """Tables that lie on circles of all keys ever added or removed, with the least table of their circle."""
    e = _changes(spark, d)
    every = e.select(F.explode(F.array("src", "dst")).alias("node"))
    return graph.strong_components(e, every).where("cyclic").select("node", "component")


@query(
    "category_cycles",
    _P3_CTE + """
walk(least, up, path) AS (SELECT id, p, [id] FROM link UNION ALL SELECT least, l.p, list_append(path, up) FROM walk JOIN link l ON l.id = up WHERE up > least AND NOT list_contains(path, up))
SELECT array_to_string(list_append(path, least), ' → ') AS cycle, len(path)::INT AS length FROM walk WHERE up = least""",
)
def category_cycles(spark, d):
    """Cycles of parents, of any length, each from its least code."""
    links = hierarchy.current_categories(table(spark, d, "product_categories"), "category_code", "parent_category", "loaded_at")
    known = links.select(F.col("id").alias("_id"))
    return graph.circular(links.select(F.col("id").alias("src"), F.col("next").alias("dst")).join(known, F.col("dst") == F.col("_id"), "left_semi"))


@query("communities")
def communities(spark, d):
    return graph.communities(edges(spark, d), nodes(spark, d), min_cohesion=0.1)


@query("communities_kept", f"WITH {_T} SELECT count(*) AS tables, true AS in_one_each, true AS connected, true AS better_than_schemas FROM t")
def communities_kept(spark, d):
    """What must hold of communities: every table is in one, none has more than one component, and modularity is above that of the schemas."""
    e, every = cut(edges(spark, d), "edges"), cut(nodes(spark, d).distinct(), "nodes")
    c = cut(graph.communities(e, every), "communities")
    inside = e.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
    parts = graph.components(inside, every).select("component").distinct().count()
    schemas = every.select("node", F.split_part("node", F.lit("."), F.lit(1)).alias("community"))
    better = graph.modularity(e, c) >= graph.modularity(e, schemas)
    by = every.join(c.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return by.agg(
        F.count("*").alias("tables"), ((F.count("*") == F.count("community")) & (F.count("*") == F.countDistinct("node"))).alias("in_one_each"),
        (F.countDistinct("community") == parts).alias("connected"), F.lit(better).alias("better_than_schemas"),
    )


@query("domains")
def domains(spark, d):
    """Communities as domains: size, cohesion, name and their foreign keys within."""
    e = edges(spark, d)
    c = cut(graph.communities(e, nodes(spark, d), min_cohesion=0.1), "communities")
    return catalog.domains(e, c)


_PREFIX = "CASE WHEN len(w) > 1 THEN upper(CASE WHEN contains(full_name, '.') THEN w[-2] ELSE w[1] END) END"


@query(
    "schema_domains",
    _R + f""", w AS (SELECT schema_name AS community, full_name, string_split(replace(full_name, '.', '_'), '_') AS w FROM t),
p AS (SELECT community, {_PREFIX} AS prefix, count(*) AS n FROM w GROUP BY 1, 2), z AS (SELECT community, count(*) AS size, min(full_name) AS least FROM w GROUP BY 1),
m AS (SELECT community, min_by(prefix, (-n, prefix)) AS prefix, max(n) AS most FROM p WHERE prefix IS NOT NULL GROUP BY 1),
i AS (SELECT a.schema_name AS s, count(*) AS inside FROM u JOIN t a ON a.full_name = u.a JOIN t b ON b.full_name = u.b WHERE a.schema_name = b.schema_name GROUP BY 1),
lab AS (SELECT z.*, CASE WHEN most * 2 >= size THEN prefix ELSE split_part(least, '.', 2) END AS word FROM z LEFT JOIN m USING (community))
SELECT community, size, coalesce(inside, 0) AS inside, (CASE WHEN size = 1 THEN 1.0 ELSE coalesce(inside, 0) / (size * (size - 1) / 2) END)::DECIMAL(18,6) AS cohesion,
  upper(word[1]) || lower(word[2:]) || ' Domain' AS name FROM lab LEFT JOIN i ON s = community""",
)
def schema_domains(spark, d):
    """Schemas as domains, named by the words of their tables' names."""
    t = tables(spark, d)
    return catalog.domains(edges(spark, d), t.select(F.col("full_name").alias("node"), F.col("schema_name").alias("community")))


_IMPACT = _PROPERTIES.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + f""", pe AS ({_P_EDGES}),
b(node, depth) AS (SELECT full_name, 0 FROM t WHERE starts_with(full_name, 'CLINIC.') UNION SELECT pe.src, depth + 1 FROM b JOIN pe ON pe.dst = b.node WHERE depth < 4),
m AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1),
f AS (SELECT m.node, m.depth, min(q.node) AS parent FROM m JOIN pe ON pe.src = m.node JOIN m q ON q.node = pe.dst AND q.depth = m.depth - 1 WHERE m.depth > 0 GROUP BY 1, 2)
"""


def _impact(spark, d):
    t, c = tables(spark, d), columns(spark, d)
    starts = t.where("startswith(full_name, 'CLINIC.')").select(F.col("full_name").alias("node"))
    return graph.impact(catalog.property_edges(t, c), catalog.property_nodes(t, c), starts, 4, "in")


@query(
    "impact_objects",
    _IMPACT + """SELECT f.node, coalesce(n.type, 'unknown') AS type, depth::INT AS depth, parent, CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS kind,
  f.node NOT IN (SELECT parent FROM f) AS leaf FROM f LEFT JOIN n ON n.node = f.node""",
)
def impact_objects(spark, d):
    """What depends on the tables of one schema, through all kinds of edges."""
    return _impact(spark, d)


@query(
    "impact_paths",
    _IMPACT + """, w(node, up, path) AS (SELECT node, parent, [node] FROM f WHERE node NOT IN (SELECT parent FROM f)
  UNION ALL SELECT w.node, f.parent, list_prepend(w.up, path) FROM w LEFT JOIN f ON f.node = w.up WHERE w.up IS NOT NULL)
SELECT node, path FROM w WHERE up IS NULL""",
)
def impact_paths(spark, d):
    return graph.impact_paths(cut(_impact(spark, d), "found"))
