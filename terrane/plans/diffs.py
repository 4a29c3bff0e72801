"""Queries of snapshot differences: the columns as first created against the columns after the whole feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions.names import version_key
from terrane.operators import catalog, changefeed, diff
from terrane.plans.catalog import columns, tables
from terrane.plans.problems import P5_SQL
from terrane.plans.registry import query, table

_AB = (
    "WITH cur AS (" + P5_SQL.replace("WITH RECURSIVE", "WITH") + """),
a AS (SELECT DISTINCT table_name, column_name, data_type, nullable, default_expr, is_pk, is_unique, column_comment FROM columns_state),
b AS (SELECT cur.table_name, cur.column_name, cur.data_type, coalesce(a.nullable, true) AS nullable, a.default_expr, coalesce(a.is_pk, false) AS is_pk, coalesce(a.is_unique, false) AS is_unique, a.column_comment
  FROM cur LEFT JOIN a ON a.table_name = cur.table_name AND a.column_name = cur.column_name),
ta AS (SELECT DISTINCT full_name, table_comment FROM tables_state), tb AS (SELECT DISTINCT b.table_name AS full_name, ta.table_comment FROM b LEFT JOIN ta ON ta.full_name = b.table_name),
j AS (SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name, a.table_name IS NULL AS added, b.table_name IS NULL AS removed,
  a.data_type AS ty_a, b.data_type AS ty_b, a.nullable AS an, b.nullable AS bn FROM a FULL JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name),
cc AS (SELECT table_name, column_name, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN added OR removed THEN '' ELSE 'type: ' || coalesce(ty_a, 'None') || '→' || coalesce(ty_b, 'None') END AS diffs, NOT added AS breaking, ty_a, ty_b FROM j WHERE added OR removed OR ty_a IS DISTINCT FROM ty_b),
tj AS (SELECT coalesce(ta.full_name, tb.full_name) AS full_name, ta.full_name IS NULL AS added, tb.full_name IS NULL AS removed FROM ta FULL JOIN tb ON ta.full_name = tb.full_name),
cn AS (SELECT table_name, count(*) AS n, bool_or(breaking) AS bad FROM cc GROUP BY 1),
tc AS (SELECT full_name, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'modified' END AS change, coalesce(n, 0) AS columns, removed OR (NOT added AND coalesce(bad, false)) AS breaking
  FROM tj LEFT JOIN cn ON cn.table_name = full_name WHERE added OR removed OR n IS NOT NULL)
"""
)


def _sides(spark, d):
    a = columns(spark, d)
    now = changefeed.current_columns(table(spark, d, "operations"))
    old = a.select(F.col("table_name").alias("_t"), F.col("column_name").alias("_c"), "nullable", "default_expr", "is_pk", "is_unique", "column_comment")
    b = now.join(old, (F.col("table_name") == F.col("_t")) & (F.col("column_name") == F.col("_c")), "left")
    for name, value in (("nullable", True), ("is_pk", False), ("is_unique", False)):
        b = b.withColumn(name, F.coalesce(name, F.lit(value)))
    ta = tables(spark, d)
    tb = now.select(F.col("table_name").alias("full_name")).distinct().join(ta.select(F.col("full_name").alias("_f"), "table_comment"), F.col("full_name") == F.col("_f"), "left")
    return ta, a, tb, b


@query("column_diff", _AB + "SELECT table_name, column_name, change, diffs, breaking FROM cc")
def column_diff(spark, d):
    _, a, _, b = _sides(spark, d)
    return diff.column_changes(a, b)


@query("snapshot_diff", _AB + "SELECT * FROM tc")
def snapshot_diff(spark, d):
    ta, a, tb, b = _sides(spark, d)
    return diff.table_changes(ta, tb, diff.column_changes(a, b))


@query(
    "diff_stats",
    _AB + """SELECT 'table' AS object, change, count(*) AS n, count(*) FILTER (WHERE breaking) AS breaking FROM tc GROUP BY 2
UNION ALL SELECT 'column', change, count(*), count(*) FILTER (WHERE breaking) FROM cc WHERE table_name IN (SELECT full_name FROM tc WHERE change = 'modified') GROUP BY 2""",
)
def diff_stats(spark, d):
    ta, a, tb, b = _sides(spark, d)
    c = diff.column_changes(a, b)
    return diff.diff_stats(diff.table_changes(ta, tb, c), c)


_DRIFT = _AB + """, dr AS (
SELECT CASE WHEN removed THEN 'missing_table' ELSE 'extra_table' END AS category, full_name AS table_name, NULL::VARCHAR AS column_name,
  CASE WHEN removed THEN '-- recreate table ' || full_name ELSE '-- DROP TABLE ' || full_name || ';' END AS repair, CASE WHEN removed THEN 'error' ELSE 'warning' END AS severity FROM tj WHERE added OR removed
UNION ALL SELECT CASE change WHEN 'removed' THEN 'missing_column' WHEN 'added' THEN 'extra_column' ELSE 'type_mismatch' END, table_name, column_name,
  CASE change WHEN 'removed' THEN 'ALTER TABLE ' || table_name || ' ADD (' || column_name || ' ' || ty_a || ');' WHEN 'added' THEN 'ALTER TABLE ' || table_name || ' DROP COLUMN ' || column_name || ';'
    ELSE 'ALTER TABLE ' || table_name || ' MODIFY (' || column_name || ' ' || ty_a || ');' END, CASE change WHEN 'added' THEN 'warning' ELSE 'error' END
FROM cc WHERE table_name IN (SELECT full_name FROM tj WHERE NOT added AND NOT removed))
"""


@query("drift_repair", _DRIFT + "SELECT * FROM dr")
def drift_repair(spark, d):
    ta, a, tb, b = _sides(spark, d)
    return diff.drift(ta, a, tb, b)


@query("drift_counts", _DRIFT + "SELECT category, severity, count(*) AS n FROM dr GROUP BY 1, 2")
def drift_counts(spark, d):
    ta, a, tb, b = _sides(spark, d)
    return diff.drift(ta, a, tb, b).groupBy("category", "severity").agg(F.count("*").alias("n"))


# The snapshot against one whose foreign keys and plain indexes are gone, with a unique key and an index on the first column of each primary key.
_CHANGED = """WITH a AS (SELECT DISTINCT full_name, name AS short, constraints, indexes, pk_columns FROM tables_state),
ac AS (SELECT full_name, unnest(constraints) AS k FROM a), ai AS (SELECT full_name, unnest(indexes) AS k FROM a),
ck AS (SELECT full_name, k.type AS ty, k.columns AS cols, k.name AS nm, k.ref_table AS rt, k.ref_columns AS rc, k.on_delete AS od FROM ac),
bk AS (SELECT * FROM ck WHERE ty <> 'foreign_key' UNION ALL SELECT full_name, 'unique', [pk_columns[1]], 'UQ_' || short, NULL, [], NULL FROM a WHERE len(pk_columns) > 0),
ik AS (SELECT full_name, k.name AS nm, k.columns AS cols, k.is_unique AS uq FROM ai),
jk AS (SELECT * FROM ik WHERE uq UNION ALL SELECT full_name, 'IX_' || short || '_PK', [pk_columns[1]], false FROM a WHERE len(pk_columns) > 0)
"""


def _changed(spark, d):
    t = tables(spark, d)
    has = F.size("pk_columns") > 0
    first = F.array(F.get("pk_columns", F.lit(0)))
    text = F.lit(None).cast("string")
    con = F.struct(
        F.concat(F.lit("UQ_"), "name").alias("name"), F.lit("unique").alias("type"), first.alias("columns"), text.alias("ref_table"), F.array().cast("array<string>").alias("ref_columns"),
        text.alias("on_delete"), text.alias("check_expr"),
    )
    idx = F.struct(F.concat(F.lit("IX_"), "name", F.lit("_PK")).alias("name"), first.alias("columns"), F.lit(False).alias("is_unique"), text.alias("created_in"))
    kept = F.filter("constraints", lambda c: c["type"] != "foreign_key")
    plain = F.filter("indexes", lambda i: i["is_unique"])
    return t, t.withColumn("constraints", F.when(has, F.concat(kept, F.array(con))).otherwise(kept)).withColumn("indexes", F.when(has, F.concat(plain, F.array(idx))).otherwise(plain))


@query(
    "constraint_drift",
    _CHANGED + """, pa AS (SELECT full_name, 'constraint' AS o, ty || ' ' || array_to_string(cols, ',') AS key, min_by(x, coalesce(nm, '')) AS x FROM (SELECT *, CASE ty
    WHEN 'primary_key' THEN 'ALTER TABLE ' || full_name || ' ADD CONSTRAINT ' || coalesce(nm, 'None') || ' PRIMARY KEY (' || array_to_string(cols, ', ') || ');'
    WHEN 'foreign_key' THEN 'ALTER TABLE ' || full_name || ' ADD CONSTRAINT ' || coalesce(nm, 'None') || ' FOREIGN KEY (' || array_to_string(cols, ', ') || ') REFERENCES ' || rt || ' (' || array_to_string(rc, ', ') || ')' || coalesce(' ON DELETE ' || od, '') || ';'
    ELSE '-- Cannot generate constraint: ' || ty END AS x FROM ck) GROUP BY 1, 2, 3
  UNION ALL SELECT full_name, 'index', CASE WHEN uq THEN 'unique ' ELSE 'plain ' END || array_to_string(cols, ','), min_by('CREATE ' || CASE WHEN uq THEN 'UNIQUE ' ELSE '' END || 'INDEX ' || nm || ' ON ' || full_name || ' (' || array_to_string(cols, ', ') || ');', nm) FROM ik GROUP BY 1, 2, 3),
pb AS (SELECT full_name, 'constraint' AS o, ty || ' ' || array_to_string(cols, ',') AS key, min_by(coalesce('ALTER TABLE ' || full_name || ' DROP CONSTRAINT ' || nm || ';', ''), coalesce(nm, '')) AS x FROM bk GROUP BY 1, 2, 3
  UNION ALL SELECT full_name, 'index', CASE WHEN uq THEN 'unique ' ELSE 'plain ' END || array_to_string(cols, ','), min_by('DROP INDEX ' || nm || ';', nm) FROM jk GROUP BY 1, 2, 3)
SELECT full_name, 'missing_' || o AS category, key, x AS repair, CASE o WHEN 'constraint' THEN 'warning' ELSE 'info' END AS severity FROM pa WHERE (full_name, o, key) NOT IN (SELECT full_name, o, key FROM pb)
UNION ALL SELECT full_name, 'extra_' || o, key, x, 'info' FROM pb WHERE (full_name, o, key) NOT IN (SELECT full_name, o, key FROM pa)""",
)
def constraint_drift(spark, d):
    return diff.constraint_drift(*_changed(spark, d))


@query(
    "object_diff",
    _CHANGED + """, x AS (SELECT 'a' AS side, 'constraint' AS object, full_name AS owner, ty || ' ' || array_to_string(list_sort(cols), ',') || ' ' || coalesce(nm, '-') AS name FROM ck
  UNION SELECT 'b', 'constraint', full_name, ty || ' ' || array_to_string(list_sort(cols), ',') || ' ' || coalesce(nm, '-') FROM bk
  UNION SELECT 'a', 'index', full_name, nm FROM ik UNION SELECT 'b', 'index', full_name, nm FROM jk
  UNION SELECT 'a', 'relationship', full_name, array_to_string(cols, ',') || ' → ' || rt || ' ' || array_to_string(rc, ',') || ' ' || coalesce(nm, '-') FROM ck WHERE ty = 'foreign_key')
SELECT object, owner, name, CASE WHEN max(side) = 'a' THEN 'removed' ELSE 'added' END AS change FROM x GROUP BY 1, 2, 3 HAVING count(*) = 1""",
)
def object_diff(spark, d):
    """Constraints, indexes and relationships of the two snapshots."""
    return diff.object_changes(*_changed(spark, d))


@query("sequence_diff", "SELECT * FROM (VALUES ('S_B', 'removed', ''), ('S_C', 'modified', 'start_with: 1→5; increment_by: 1→2'), ('S_D', 'modified', 'increment_by: 1→-1'), ('S_E', 'added', '')) v(sequence, change, diffs)")
def sequence_diff(spark, d):
    """Two lists of sequences, written out."""
    fields = "sequence string, start_with bigint, increment_by bigint"
    a = spark.createDataFrame([("S_A", 1, 1), ("S_B", 1, 1), ("S_C", 1, 1), ("S_D", 1, 1)], fields)
    b = spark.createDataFrame([("S_A", 1, 1), ("S_C", 5, 2), ("S_D", 1, -1), ("S_E", 1, 1)], fields)
    return diff.sequence_changes(a, b)


@query(
    "create_statements",
    """WITH c AS (SELECT DISTINCT * FROM columns_state)
SELECT table_name, 'CREATE TABLE ' || table_name || ' (' || chr(10) || string_agg('  ' || column_name || ' ' || coalesce(data_type, 'UNKNOWN') || coalesce(' DEFAULT ' || nullif(default_expr, ''), '') || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY ord)
  || chr(10) || ');' AS statement FROM c GROUP BY 1""",
)
def create_statements(spark, d):
    return diff.create_statements(columns(spark, d))


_AT = P5_SQL.replace("FROM operations\n", "FROM operations WHERE list_resize(list_transform(string_split(replace(version, '_', '.'), '.'), lambda x: x::HUGEINT), 12, 0) <= list_resize([5::HUGEINT], 12, 0)\n")


@query("state_at", _AT)
def state_at(spark, d):
    """The columns after all statements of versions up to 5."""
    ops = table(spark, d, "operations")
    return changefeed.current_columns(ops.where(version_key(F.col("version")) <= version_key(F.lit("5"))))


@query(
    "latest_state",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, count(*) AS events FROM events GROUP BY 1",
)
def latest_state(spark, d):
    return catalog.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("n", "events")


@query(
    "integrity_manifest",
    r"""WITH o AS (SELECT source_file || '#' || statement_index AS filename, sha256(replace(coalesce(raw_sql, ''), chr(13) || chr(10), chr(10))) AS hash, arrived_at, op_id FROM operations),
k AS (SELECT filename, arg_min(hash, (arrived_at, op_id)) AS hash FROM o WHERE arrived_at < TIMESTAMP '2024-01-01' GROUP BY 1), n AS (SELECT filename, arg_max(hash, (arrived_at, op_id)) AS hash FROM o GROUP BY 1)
SELECT coalesce(k.filename, n.filename) AS filename, CASE WHEN n.filename IS NULL THEN 'missing' WHEN k.filename IS NULL THEN 'new' WHEN k.hash <> n.hash THEN 'modified' ELSE 'clean' END AS status
FROM k FULL JOIN n ON k.filename = n.filename""",
)
def integrity_manifest(spark, d):
    """Each statement as last delivered against the manifest of what had arrived first by 2024."""
    o = table(spark, d, "operations").select(F.concat_ws("#", "source_file", "statement_index").alias("path"), "raw_sql", F.struct("arrived_at", "op_id").alias("at"), "arrived_at")
    old = o.where("arrived_at < TIMESTAMP_NTZ '2024-01-01'").groupBy("path").agg(F.min_by("raw_sql", "at").alias("text"))
    new = o.groupBy("path").agg(F.max_by("raw_sql", "at").alias("text"))
    return diff.integrity(diff.manifest(old, "path", "text"), diff.manifest(new, "path", "text"))
