"""Queries over the snapshot tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions.names import norm_name
from terrane.operators import catalog as c
from terrane.plans.registry import query, table

_T = "t AS (SELECT DISTINCT * FROM tables_state)"
_C = "col AS (SELECT DISTINCT * FROM columns_state)"
_R = (
    _T
    + """, con AS (SELECT full_name, schema_name, pk_columns, unnest(constraints) AS k FROM t),
r AS (SELECT full_name AS from_table, k.name AS name, k.columns AS from_cols, k.ref_table AS to_table, k.ref_columns AS to_cols, k.on_delete AS on_delete,
  CASE WHEN list_sort(list_distinct(k.columns)) = list_sort(list_distinct(pk_columns)) THEN 'one_to_one' ELSE 'many_to_one' END AS cardinality
  FROM con WHERE k.type = 'foreign_key'),
d AS (SELECT full_name, column_count, has_pk, created_in, schema_name,
  (SELECT count(*) FROM r WHERE r.from_table = t.full_name) AS fk_out, (SELECT count(*) FROM r WHERE r.to_table = t.full_name) AS fk_in FROM t),
e AS (SELECT DISTINCT from_table AS src, to_table AS dst FROM r WHERE to_table IN (SELECT full_name FROM t)),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
both_ways AS (SELECT a AS p, b AS q FROM u UNION SELECT b, a FROM u)
"""
)
_R = "WITH " + _R


def tables(spark, d):
    return c.snapshot(table(spark, d, "tables_state"))


def columns(spark, d):
    return c.column_rows(table(spark, d, "columns_state"))


@query(
    "filter_tables",
    _R + "SELECT full_name, column_count, CASE WHEN has_pk THEN '✓' ELSE '✗' END AS pk, fk_out, fk_in,"
    " CASE WHEN fk_out = 0 AND fk_in = 0 THEN '✓' ELSE '✗' END AS orphan, created_in FROM d"
    " WHERE regexp_matches(full_name, '(?i)(note|owner)') AND column_count BETWEEN 3 AND 8 AND NOT (fk_out = 0 AND fk_in = 0)",
)
def filter_tables(spark, d):
    return c.filter_tables(tables(spark, d), pattern="(note|owner)", min_cols=3, max_cols=8, is_orphan=False)


@query(
    "filter_columns",
    f"WITH {_C} SELECT table_name, column_name, data_type, concat_ws(' ', CASE WHEN is_pk THEN 'PK' END, CASE WHEN is_fk THEN 'FK' END,"
    " CASE WHEN is_unique THEN 'UQ' END, CASE WHEN NOT nullable THEN 'NN' END) AS flags FROM col"
    " WHERE regexp_matches(column_name, '(?i)_(id|ref)$') AND regexp_matches(data_type, '(?i)number') AND NOT nullable",
)
def filter_columns(spark, d):
    return c.filter_columns(columns(spark, d), pattern="_(id|ref)$", type_like="number", nullable=False)


@query(
    "filter_indexes",
    f"WITH {_T} SELECT full_name, i.name AS index_name, array_to_string(i.columns, ', ') AS columns, i.is_unique FROM (SELECT full_name, unnest(indexes) AS i FROM t)"
    " WHERE i.is_unique AND regexp_matches(full_name, '(?i)^(stock|core)[.]')",
)
def filter_indexes(spark, d):
    return c.filter_indexes(tables(spark, d), table="^(stock|core)[.]", unique_only=True)


@query("missing_pk", f"WITH {_T} SELECT full_name, column_count FROM t WHERE NOT coalesce(has_pk, false)")
def missing_pk(spark, d):
    return c.missing_pk(tables(spark, d))


@query(
    "missing_fk",
    f"WITH {_C} SELECT table_name, column_name, data_type FROM col WHERE regexp_matches(column_name, '(?i)_(id|key|fk|ref)$') AND NOT is_fk AND NOT is_pk",
)
def missing_fk(spark, d):
    return c.missing_fk(columns(spark, d))


@query("schema_tables", f"WITH {_T} SELECT schema_name, count(*) AS tables, sum(column_count)::BIGINT AS columns FROM t WHERE upper(schema_name) IN ('CORE', 'STOCK') GROUP BY 1")
def schema_tables(spark, d):
    rows = c.tables_in_schema(tables(spark, d), "core", "stock")
    return rows.groupBy("schema_name").agg(F.count("*").alias("tables"), F.sum("column_count").alias("columns"))


@query("relationships", _R + "SELECT from_table, name, from_cols, to_table, to_cols, on_delete, cardinality FROM r")
def relationships(spark, d):
    return c.relationships(tables(spark, d))


@query(
    "refs_both",
    _R + "SELECT '▶' AS mark, 'out' AS direction, from_table AS near, to_table AS far, r.name AS name, t.column_count AS far_columns FROM r LEFT JOIN t ON t.full_name = to_table"
    " WHERE regexp_matches(from_table, '(?i)^stock') UNION ALL SELECT '◀', 'in', to_table, from_table, r.name, t.column_count FROM r LEFT JOIN t ON t.full_name = from_table"
    " WHERE regexp_matches(to_table, '(?i)^stock')",
)
def refs_both(spark, d):
    return c.references_of(tables(spark, d), "^stock")


@query("referencing", _R + "SELECT full_name, column_count FROM t WHERE full_name IN (SELECT from_table FROM r WHERE to_table = 'CORE.LEDGER_ENTRY')")
def referencing(spark, d):
    return c.referencing(tables(spark, d), "CORE.LEDGER_ENTRY")


@query("orphans", _R + "SELECT full_name, column_count FROM d WHERE fk_in = 0 AND fk_out = 0")
def orphans(spark, d):
    return c.orphans(tables(spark, d))


@query("unresolved_fk", _R + "SELECT from_table, name, to_table FROM r WHERE coalesce(to_table, '') <> '' AND to_table NOT IN (SELECT full_name FROM t)")
def unresolved_fk(spark, d):
    return c.unresolved_fks(tables(spark, d))


# Sequences named as tables are, and those of brands, few of which are.
_SEQS = """sq AS (SELECT DISTINCT sequence, regexp_replace(upper(sequence), '^(SEQ_|SQ_|S_)', '') AS stem FROM
  (SELECT 'SEQ_' || split_part(full_name, '.', 2) AS sequence FROM tables_state UNION ALL SELECT 'S_' || upper(p_brand) FROM part)),
lone AS (SELECT sequence FROM sq WHERE NOT EXISTS (SELECT 1 FROM tables_state t WHERE starts_with(upper(t.name), stem) OR starts_with(stem, upper(t.name))))"""


def sequences(spark, d):
    seqs = table(spark, d, "tables_state").select(F.concat(F.lit("SEQ_"), F.split_part("full_name", F.lit("."), F.lit(2))).alias("sequence"))
    return seqs.unionByName(table(spark, d, "part").select(F.concat(F.lit("S_"), F.upper("p_brand")).alias("sequence")))


@query("theta_prefix_anti", f"WITH {_SEQS} SELECT sequence FROM lone")
def theta_prefix_anti(spark, d):
    return c.orphan_sequences(sequences(spark, d), table(spark, d, "tables_state"))


@query(
    "stats_lookup",
    f"""WITH {_T}, s AS (SELECT * FROM (SELECT table_name, count(*) AS row_count FROM documents WHERE table_name IS NOT NULL GROUP BY 1)
  UNION ALL SELECT split_part(table_name, '.', 2), count(*) FROM findings WHERE table_name LIKE '%.%' GROUP BY 1),
m AS (SELECT t.full_name, CASE WHEN lower(s.table_name) = lower(t.full_name) THEN 1 WHEN lower(s.table_name) = lower(t.name) THEN 2 ELSE 3 END AS rank, s.table_name AS stats_name, s.row_count
  FROM t JOIN s ON lower(s.table_name) IN (lower(t.full_name), lower(t.name)) OR (contains(s.table_name, '.') AND list_last(string_split(lower(s.table_name), '.')) = lower(t.name)))
SELECT full_name, rank, stats_name, row_count FROM m QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY rank, stats_name, row_count) = 1""",
)
def stats_lookup(spark, d):
    full = table(spark, d, "documents").where("table_name IS NOT NULL").groupBy("table_name").agg(F.count("*").alias("row_count"))
    short = table(spark, d, "findings").where("table_name LIKE '%.%'").groupBy(F.split_part("table_name", F.lit("."), F.lit(2)).alias("table_name")).agg(F.count("*").alias("row_count"))
    return c.table_stats(tables(spark, d), full.unionByName(short))


@query(
    "state_stats",
    f"""WITH {_T}, {_C} SELECT count(*) AS tables, sum(len(indexes))::BIGINT AS indexes, sum(len(list_filter(constraints, lambda k: k.type = 'foreign_key')))::BIGINT AS relationships,
  count(*) FILTER (WHERE NOT has_pk) AS tables_without_pk, count(*) FILTER (WHERE dropped_at IS NOT NULL) AS dropped, (SELECT count(*) FROM col) AS columns FROM t""",
)
def state_stats(spark, d):
    return c.state_stats(tables(spark, d), columns(spark, d))


@query(
    "god_tables",
    _R + """, g AS (SELECT full_name, fk_in, fk_out, fk_in + fk_out AS degree FROM d)
SELECT full_name, degree, fk_in, fk_out FROM g WHERE (SELECT stddev_pop(degree) FROM g) = 0 OR degree > (SELECT avg(degree) + 2 * stddev_pop(degree) FROM g)
ORDER BY degree DESC, full_name LIMIT 10""",
)
def god_tables(spark, d):
    return c.god_tables(tables(spark, d))


_PAIRS = """, p AS (SELECT from_table, to_table, unnest(from_cols) AS f, unnest(to_cols) AS g FROM r)"""


@query(
    "god_columns",
    _R + _PAIRS + " SELECT to_table || '.' || g AS column, count(*) AS refs, count(DISTINCT from_table || '.' || f) AS users FROM p WHERE g IS NOT NULL GROUP BY 1 HAVING count(*) + count(DISTINCT from_table || '.' || f) >= 4",
)
def god_columns(spark, d):
    return c.god_columns(tables(spark, d), 4)


@query(
    "unused_columns",
    _R + f""", {_C}, used AS (SELECT full_name AS t, unnest(k.columns) AS c FROM con UNION SELECT k.ref_table, unnest(k.ref_columns) FROM con WHERE k.ref_table IS NOT NULL
  UNION SELECT full_name, unnest(i.columns) FROM (SELECT full_name, unnest(indexes) AS i FROM t))
SELECT table_name, column_name FROM col WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.t = table_name AND used.c = column_name)""",
)
def unused_columns(spark, d):
    return c.unused_columns(tables(spark, d), columns(spark, d))


@query(
    "drop_column_in_use",
    _R + """, used AS (SELECT full_name AS t, unnest(k.columns) AS c FROM con UNION SELECT k.ref_table, unnest(k.ref_columns) FROM con WHERE k.ref_table IS NOT NULL
  UNION SELECT full_name, unnest(i.columns) FROM (SELECT full_name, unnest(indexes) AS i FROM t)),
x AS (SELECT DISTINCT upper(trim(replace(table_name, '"', ''))) AS table_name, upper(trim(replace(column_name, '"', ''))) AS column_name FROM operations WHERE operation = 'DROP_COLUMN')
SELECT table_name, column_name FROM x WHERE EXISTS (SELECT 1 FROM used WHERE used.t = table_name AND used.c = column_name)""",
)
def drop_column_in_use(spark, d):
    drops = table(spark, d, "operations").where("operation = 'DROP_COLUMN'")
    return c.drops_in_use(drops.select(norm_name(F.col("table_name")).alias("table_name"), norm_name(F.col("column_name")).alias("column_name")), tables(spark, d))


@query(
    "table_roles",
    _R + "SELECT full_name, CASE WHEN fk_in > 0 AND fk_out = 0 THEN 'root' WHEN fk_in > 0 THEN 'junction' WHEN fk_out > 0 THEN 'leaf' ELSE 'standalone' END AS role FROM d",
)
def table_roles(spark, d):
    return c.table_roles(tables(spark, d))


@query(
    "cross_domain",
    _R + """SELECT a.schema_name AS from_schema, b.schema_name AS to_schema, count(*) AS fks, CASE WHEN count(*) >= 10 THEN 'strong' WHEN count(*) >= 5 THEN 'medium' ELSE 'weak' END AS strength
FROM r JOIN t a ON a.full_name = from_table JOIN t b ON b.full_name = to_table WHERE a.schema_name <> b.schema_name GROUP BY 1, 2""",
)
def cross_domain(spark, d):
    return c.cross_domain(tables(spark, d))


@query(
    "modal_label",
    f"""WITH {_C}, n AS (SELECT table_name, raw_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY table_name) AS columns FROM col GROUP BY 1, 2)
SELECT table_name, raw_type AS modal, n AS most, columns::BIGINT AS columns, CASE WHEN n * 2 >= columns THEN raw_type ELSE 'mixed' END AS label
FROM n QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY n DESC, raw_type) = 1""",
)
def modal_label(spark, d):
    return c.modal_labels(columns(spark, d))


@query(
    "schema_fingerprint",
    f"""WITH {_T}, {_C}, n AS (SELECT table_name, string_agg(column_name, ',' ORDER BY ord, column_name) AS cs FROM col GROUP BY 1),
l AS (SELECT schema_name, full_name, sha256(full_name || '|' || coalesce(cs, '') || '|' || array_to_string(list_transform(constraints, lambda k: k.type), ',')) AS h FROM t LEFT JOIN n ON table_name = full_name)
SELECT schema_name, substring(sha256(string_agg(h, '' ORDER BY full_name)), 1, 16) AS fingerprint FROM l GROUP BY 1""",
)
def schema_fingerprint(spark, d):
    return c.fingerprints(columns(spark, d), tables(spark, d))


@query(
    "property_graph_counts",
    _R + f""", {_C} SELECT 'node:table' AS kind, count(*) AS n FROM t UNION ALL SELECT 'node:column', count(*) FROM col
UNION ALL SELECT 'node:migration', count(DISTINCT created_in) FROM t UNION ALL SELECT 'edge:contains', count(*) FROM col
UNION ALL SELECT 'edge:foreign_key', count(*) FROM e UNION ALL SELECT 'edge:creates', count(created_in) FROM t
UNION ALL SELECT 'edge:modifies', count(*) FROM (SELECT created_in, unnest(list_distinct(modified_in)) AS v FROM t) WHERE v <> created_in
UNION ALL SELECT 'edge:drops', count(dropped_at) FROM t""",
)
def property_graph_counts(spark, d):
    return c.property_graph(tables(spark, d), columns(spark, d))


@query(
    "graph_metrics",
    _R + """SELECT p AS full_name, count(*) AS degree, (count(*) / ((SELECT count(*) FROM t) - 1))::DECIMAL(18,6) AS centrality,
  ((SELECT count(*) FROM both_ways) / ((SELECT count(*) FROM t) * ((SELECT count(*) FROM t) - 1)))::DECIMAL(18,6) AS density FROM both_ways GROUP BY 1 ORDER BY degree DESC, 1 LIMIT 10""",
)
def graph_metrics(spark, d):
    return c.graph_metrics(tables(spark, d))


@query(
    "cohesion",
    _R + """, i AS (SELECT a.schema_name AS s, count(*) AS inside FROM u JOIN t a ON a.full_name = u.a JOIN t b ON b.full_name = u.b WHERE a.schema_name = b.schema_name GROUP BY 1),
z AS (SELECT schema_name, count(*) AS n FROM t GROUP BY 1)
SELECT schema_name, n, (CASE WHEN n = 1 THEN 1.0 ELSE coalesce(inside, 0) / (n * (n - 1) / 2) END)::DECIMAL(18,6) AS cohesion FROM z LEFT JOIN i ON s = schema_name""",
)
def cohesion(spark, d):
    return c.cohesion(tables(spark, d))


@query(
    "surprising_joins",
    _R + """, f AS (SELECT u.a, u.b FROM u JOIN t x ON x.full_name = u.a JOIN t y ON y.full_name = u.b WHERE x.schema_name <> y.schema_name),
n AS (SELECT p, list(q) AS qs FROM both_ways GROUP BY 1),
s AS (SELECT f.a, f.b, list_filter(x.qs, lambda z: z <> f.b) AS na, list_filter(y.qs, lambda z: z <> f.a) AS nb FROM f JOIN n x ON x.p = f.a JOIN n y ON y.p = f.b)
SELECT a, b, (CASE WHEN len(na) + len(nb) = 0 THEN 1.0 ELSE 1 - len(list_intersect(na, nb)) / len(list_distinct(list_concat(na, nb))) END)::DECIMAL(18,4) AS surprise
FROM s ORDER BY surprise DESC, a, b LIMIT 20""",
)
def surprising_joins(spark, d):
    return c.surprising_joins(tables(spark, d))


@query(
    "insights",
    _R.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + f""", {_C}, {_SEQS}, key AS (SELECT * FROM col WHERE regexp_matches(column_name, '(?i)_(id|key|fk|ref)$') AND NOT is_pk),
ix AS (SELECT full_name, list_sort(i.columns) AS cols FROM (SELECT full_name, unnest(indexes) AS i FROM t)),
g AS (SELECT full_name, fk_in + fk_out AS degree FROM d),
f AS (SELECT u.a, u.b FROM u JOIN t x ON x.full_name = u.a JOIN t y ON y.full_name = u.b WHERE x.schema_name <> y.schema_name),
n AS (SELECT p, list(q) AS qs FROM both_ways GROUP BY 1),
s AS (SELECT f.a, f.b, list_filter(x.qs, lambda z: z <> f.b) AS na, list_filter(y.qs, lambda z: z <> f.a) AS nb FROM f JOIN n x ON x.p = f.a JOIN n y ON y.p = f.b),
walk(path) AS (SELECT [src, dst] FROM e WHERE src < dst UNION ALL SELECT list_append(path, e.dst) FROM walk JOIN e ON e.src = path[-1] WHERE e.dst > path[1] AND NOT list_contains(path, e.dst)),
joined(node, other) AS (SELECT full_name, full_name FROM t UNION SELECT joined.node, b.q FROM joined JOIN both_ways b ON b.p = joined.other),
part_of AS (SELECT node, min(other) AS component FROM joined GROUP BY 1)
SELECT 'ORPHAN_TABLE' AS code, 'warning' AS severity, full_name AS table_name, NULL::VARCHAR AS column_name FROM d WHERE fk_in = 0 AND fk_out = 0
UNION ALL SELECT 'NO_PK', 'error', full_name, NULL FROM t WHERE NOT coalesce(has_pk, false)
UNION ALL SELECT 'NO_INDEXES', 'info', full_name, NULL FROM t WHERE coalesce(len(indexes), 0) = 0 AND column_count > 2
UNION ALL SELECT 'WIDE_TABLE', 'info', full_name, NULL FROM t WHERE column_count > 20
UNION ALL SELECT 'EMPTY_TABLE_COMMENT', 'info', full_name, NULL FROM t WHERE coalesce(table_comment, '') = ''
UNION ALL SELECT 'MISSING_FK_CANDIDATE', 'warning', table_name, column_name FROM key WHERE NOT is_fk
UNION ALL SELECT 'NULLABLE_FK', 'info', table_name, column_name FROM col WHERE is_fk AND nullable
UNION ALL SELECT 'UNRESOLVED_FK', 'error', from_table, to_table FROM r WHERE coalesce(to_table, '') <> '' AND to_table NOT IN (SELECT full_name FROM t)
UNION ALL SELECT 'NULLABLE_PK', 'error', table_name, column_name FROM col WHERE is_pk AND nullable
UNION ALL SELECT 'VARCHAR_ID', 'warning', table_name, column_name FROM key WHERE raw_type IN ('VARCHAR', 'VARCHAR2', 'CHAR', 'NVARCHAR', 'NCHAR', 'TEXT')
UNION ALL SELECT 'DUPLICATE_INDEX', 'warning', full_name, array_to_string(cols, ',') FROM ix GROUP BY full_name, cols HAVING count(*) > 1
UNION ALL SELECT 'UNIQUE_WITHOUT_INDEX', 'info', full_name, array_to_string(list_sort(list_distinct(k.columns)), ',') FROM con WHERE k.type = 'unique'
  AND NOT EXISTS (SELECT 1 FROM ix WHERE ix.full_name = con.full_name AND list_sort(list_distinct(ix.cols)) = list_sort(list_distinct(k.columns)))
UNION ALL SELECT 'GOD_TABLE', 'info', full_name, NULL FROM (SELECT full_name FROM g WHERE (SELECT stddev_pop(degree) FROM g) = 0
  OR degree > (SELECT avg(degree) + 2 * stddev_pop(degree) FROM g) ORDER BY degree DESC, full_name LIMIT 10)
UNION ALL SELECT 'SURPRISING_JOIN', 'info', a, b FROM (SELECT a, b, (CASE WHEN len(na) + len(nb) = 0 THEN 1.0
  ELSE 1 - len(list_intersect(na, nb)) / len(list_distinct(list_concat(na, nb))) END)::DECIMAL(18,4) AS surprise FROM s ORDER BY surprise DESC, a, b LIMIT 20)
UNION ALL SELECT 'CIRCULAR_FK', 'warning', path[1], array_to_string(list_append(path, path[1]), ' → ') FROM walk JOIN e ON e.src = path[-1] AND e.dst = path[1]
UNION ALL SELECT 'CIRCULAR_FK', 'warning', src, src || ' → ' || src FROM e WHERE src = dst
UNION ALL SELECT 'ISLAND', 'warning', component, NULL FROM (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS rank FROM (SELECT component, count(*) AS size FROM part_of GROUP BY 1)) WHERE rank > 1 AND size > 1
UNION ALL SELECT 'ORPHAN_SEQUENCE', 'info', sequence, NULL FROM lone""",
)
def insights(spark, d):
    return c.insights(tables(spark, d), columns(spark, d), sequences(spark, d))


_PROPERTIES = f"""WITH {_T}, {_C}, n AS (SELECT full_name AS node, 'table' AS type, list_last(string_split(full_name, '.')) AS label FROM t UNION ALL SELECT table_name || '.' || column_name, 'column', column_name FROM col
  UNION ALL SELECT DISTINCT 'migration:' || v, 'migration', 'V' || v FROM (SELECT created_in AS v FROM t UNION ALL SELECT unnest(modified_in) FROM t) WHERE v IS NOT NULL)"""


@query("property_nodes", _PROPERTIES + " SELECT * FROM n")
def property_nodes(spark, d):
    return c.property_nodes(tables(spark, d), columns(spark, d))


_P_EDGES = """ SELECT table_name AS src, table_name || '.' || column_name AS dst, 'contains' AS relation FROM col
UNION ALL SELECT DISTINCT full_name, k.ref_table, 'foreign_key' FROM (SELECT full_name, unnest(constraints) AS k FROM t) WHERE k.type = 'foreign_key' AND k.ref_table IN (SELECT full_name FROM t)
UNION ALL SELECT 'migration:' || created_in, full_name, 'creates' FROM t WHERE created_in IS NOT NULL
UNION ALL SELECT 'migration:' || v, full_name, 'modifies' FROM (SELECT full_name, created_in, unnest(list_distinct(modified_in)) AS v FROM t) WHERE v IS DISTINCT FROM created_in"""


@query("property_edges", _PROPERTIES + _P_EDGES)
def property_edges(spark, d):
    return c.property_edges(tables(spark, d), columns(spark, d))


@query(
    "graph_warnings",
    _R.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """, cc(node, other) AS (SELECT full_name, full_name FROM t UNION SELECT cc.node, b.q FROM cc JOIN both_ways b ON b.p = cc.other)
SELECT 'components' AS warning, count(DISTINCT m) AS n FROM (SELECT node, min(other) AS m FROM cc GROUP BY 1)
UNION ALL SELECT 'isolated nodes', count(*) FROM t WHERE full_name NOT IN (SELECT p FROM both_ways) AND full_name NOT IN (SELECT src FROM e)""",
)
def graph_warnings(spark, d):
    """Of the graph of tables and foreign keys, which the property graph holds together by migrations."""
    t = tables(spark, d)
    nodes = c.property_nodes(t, columns(spark, d)).where("type = 'table'")
    return c.graph_warnings(nodes, c.property_edges(t, columns(spark, d)).where("relation = 'foreign_key'"))


@query(
    "finding_counts",
    """WITH f AS (SELECT DISTINCT * FROM findings)
SELECT severity, code, count(*) AS n, count(DISTINCT upper(trim(replace(table_name, '"', '')))) AS tables FROM f GROUP BY 1, 2""",
)
def finding_counts(spark, d):
    return c.finding_counts(table(spark, d, "findings"))


@query(
    "findings_filter",
    """SELECT DISTINCT finding_id, code, table_name FROM findings WHERE severity = 'error' AND code IN ('NO_PK', 'UNRESOLVED_FK') AND starts_with(upper(trim(replace(table_name, '"', ''))), 'BILLING.')""",
)
def findings_filter(spark, d):
    f = table(spark, d, "findings").select("finding_id", "code", "severity", "table_name")
    return c.filter_findings(f, "error", ("NO_PK", "UNRESOLVED_FK"), "BILLING.").select("finding_id", "code", "table_name")


@query(
    "top_findings",
    """WITH f AS (SELECT DISTINCT * FROM findings) SELECT finding_id, severity, coalesce(table_name, '') AS table_name, code FROM f
ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, coalesce(table_name, ''), code, finding_id LIMIT 20""",
)
def top_findings(spark, d):
    return c.top_findings(table(spark, d, "findings"), 20)


@query("find_table", f"WITH {_T} SELECT full_name, column_count FROM (SELECT * FROM t WHERE upper(name) = 'LEDGER_ENTRY' OR upper(full_name) = 'LEDGER_ENTRY' ORDER BY upper(full_name) <> 'LEDGER_ENTRY', full_name LIMIT 1)")
def find_table(spark, d):
    return c.find_table(tables(spark, d), "ledger_entry").select("full_name", "column_count")
