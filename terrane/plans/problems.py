"""The queries of problems 2 to 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import changefeed, hierarchy, orphans, rejects
from terrane.plans.registry import query, table

_P2_FIELD = r"""(?:"(?:[^"]|"")*"|[^",]*)"""
P2_SQL = rf"""
WITH l AS (
  SELECT line_id, regexp_replace(coalesce(line, ''), '\r$', '') AS b FROM raw_log_lines
), q AS (
  SELECT line_id, b, regexp_full_match(b, '{_P2_FIELD}(?:,{_P2_FIELD})*', 's') AS ok FROM l
), s AS (
  SELECT line_id, ok, list_transform(regexp_extract_all(',' || b, ',({_P2_FIELD})', 1, 's'),
    lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM q
), t AS (
  SELECT line_id, CASE
    WHEN NOT ok THEN 'quoting'
    WHEN f[1] NOT IN ('O', 'R') THEN 'invalid_value'
    WHEN len(f) <> CASE f[1] WHEN 'O' THEN 8 ELSE 6 END THEN 'column_count'
    WHEN f[2] = '' OR NOT regexp_full_match(f[3], '[0-9]+([._][0-9]+)*') THEN 'invalid_value'
    WHEN f[1] = 'O' AND (NOT regexp_full_match(f[4], '[0-9]+') OR f[5] NOT IN ({", ".join(f"'{k}'" for k in rejects.OPERATION_KINDS)})) THEN 'invalid_value'
    WHEN f[1] = 'R' AND (f[4] NOT IN ('true', 'false') OR NOT regexp_full_match(f[5],
      '[ \t\r\n]*\[[ \t\r\n]*(("([^"\\\x00-\x1f]|\\(["\\/bfnrt]|u[0-9a-fA-F]{{4}}))*")([ \t\r\n]*,[ \t\r\n]*"([^"\\\x00-\x1f]|\\(["\\/bfnrt]|u[0-9a-fA-F]{{4}}))*")*)?[ \t\r\n]*\][ \t\r\n]*')) THEN 'invalid_value'
    WHEN NOT regexp_full_match(f[len(f)], '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\dZ') OR f[len(f)] LIKE '0000%'
      OR try_strptime(f[len(f)], '%Y-%m-%dT%H:%M:%SZ') IS NULL THEN 'invalid_value'
  END AS reason FROM s
)
SELECT DISTINCT line_id, reason FROM t WHERE reason IS NOT NULL
"""


@query("p2_found", P2_SQL)
def p2_found(spark, d):
    return rejects.rejected(table(spark, d, "raw_log_lines")).select("line_id", "reason").distinct()


_P2_ALL = P2_SQL.rsplit("SELECT DISTINCT", 1)[0].replace("SELECT line_id, CASE", "SELECT line_id, f, CASE")


@query("p2_rejects", _P2_ALL + "SELECT DISTINCT t.line_id, reason, l.line FROM t JOIN raw_log_lines l ON l.line_id = t.line_id WHERE reason IS NOT NULL")
def p2_rejects(spark, d):
    return rejects.rejected(table(spark, d, "raw_log_lines"))


@query(
    "p2_operations",
    _P2_ALL + """SELECT line_id, f[2] AS source_file, f[3] AS version, f[4]::DECIMAL(38, 0) AS statement_index, f[5] AS operation, f[6] AS table_name, f[7] AS raw_sql,
  strptime(f[8], '%Y-%m-%dT%H:%M:%SZ') AS applied_at FROM t WHERE reason IS NULL AND f[1] = 'O'""",
)
def p2_operations(spark, d):
    return rejects.load_operations(table(spark, d, "raw_log_lines"))


@query(
    "p2_results",
    _P2_ALL + """SELECT line_id, f[2] AS filename, f[3] AS version, f[4] = 'true' AS skipped, f[5]::JSON::VARCHAR[] AS errors,
  strptime(f[6], '%Y-%m-%dT%H:%M:%SZ') AS applied_at FROM t WHERE reason IS NULL AND f[1] = 'R'""",
)
def p2_results(spark, d):
    return rejects.load_results(table(spark, d, "raw_log_lines"))


def _links(spark, d):
    return hierarchy.current_categories(table(spark, d, "product_categories"), "category_code", "parent_category", "loaded_at")


def _categories(spark, d):
    return hierarchy.hierarchy(_links(spark, d))


_P3_CTE = r"""
WITH RECURSIVE c AS (
  SELECT DISTINCT upper(trim(category_code)) AS id,
    arg_max(coalesce(nullif(upper(trim(parent_category)), ''), '~'), loaded_at) AS p
  FROM product_categories WHERE trim(category_code) <> '' GROUP BY 1
), link AS (SELECT a.id, a.p FROM c a JOIN c b ON a.p = b.id),
"""
P3_SQL = (
    _P3_CTE
    + r"""
reach(id, up) AS (SELECT id, p FROM link UNION SELECT r.id, l.p FROM reach r JOIN link l ON r.up = l.id),
ring AS (SELECT id FROM reach WHERE id = up),
hit AS (SELECT r.id, r.up FROM reach r JOIN ring ON r.up = ring.id)
SELECT id AS category_code, min(up) AS cycle_code FROM hit GROUP BY id
"""
)
P3_PATHS_SQL = (
    _P3_CTE
    + r"""
walk(id, path) AS (
  SELECT id, [id] FROM c WHERE id NOT IN (SELECT id FROM link)
  UNION ALL SELECT l.id, list_append(w.path, l.id) FROM walk w JOIN link l ON l.p = w.id
)
SELECT id AS category_code, array_to_string(path, '/') AS path, (len(path) - 1)::INT AS depth, path[1] AS root FROM walk
"""
)
P3_DESC_SQL = (
    _P3_CTE
    + r"""
walk(id, up, path) AS (
  SELECT id, p, [id] FROM link WHERE p <> id
  UNION ALL SELECT w.id, l.p, list_append(w.path, w.up) FROM walk w JOIN link l ON l.id = w.up WHERE l.p <> w.up AND NOT list_contains(w.path, l.p)
)
SELECT up AS category_code, id AS descendant, len(path)::INT AS distance FROM walk
"""
)


@query("p3_found", P3_SQL)
def p3_found(spark, d):
    return _categories(spark, d).where("cycle_code IS NOT NULL").select(F.col("id").alias("category_code"), "cycle_code")


@query("p3_paths", P3_PATHS_SQL)
def p3_paths(spark, d):
    rows = _categories(spark, d).where("path IS NOT NULL")
    return rows.select(F.col("id").alias("category_code"), F.array_join("path", "/").alias("path"), "depth", "root")


@query("p3_descendants", P3_DESC_SQL)
def p3_descendants(spark, d):
    """Descendants of all categories, those on and below cycles included."""
    rows = hierarchy.all_descendants(_links(spark, d))
    return rows.withColumnRenamed("ancestor", "category_code")


def _statuses(spark, d):
    return orphans.reference_status(*(table(spark, d, t) for t in ("relationship_changes", "findings", "tables_state", "columns_state")))


_P4_CTE = r"""
WITH t AS (
  SELECT upper(trim(replace(full_name, '"', ''))) AS name, min(created_at) AS created_at,
    CASE WHEN bool_and(dropped_at IS NOT NULL) THEN max(dropped_at) END AS dropped_at
  FROM tables_state GROUP BY 1
), col AS (
  SELECT DISTINCT upper(trim(replace(table_name, '"', ''))) AS name, upper(trim(replace(column_name, '"', ''))) AS c FROM columns_state
), r AS (
  SELECT DISTINCT 'relationship_changes' AS ref_source, rel_id AS ref_id, coalesce(upper(trim(replace(to_table, '"', ''))), '') AS name,
    list_transform(coalesce(to_cols, []), lambda x: upper(trim(replace(x, '"', '')))) AS cols, detected_at AS t FROM relationship_changes
  UNION SELECT DISTINCT 'findings', finding_id, upper(trim(replace(table_name, '"', ''))), [], found_at
  FROM findings WHERE trim(replace(table_name, '"', '')) <> ''
), gap AS (
  SELECT DISTINCT u.ref_source, u.ref_id FROM (SELECT ref_source, ref_id, name, unnest(cols) AS c FROM r) u
  WHERE NOT EXISTS (SELECT 1 FROM col WHERE col.name = u.name AND col.c = u.c)
), s AS (
  SELECT r.*, CASE WHEN t.name IS NULL THEN 'missing_table' WHEN t.dropped_at <= r.t THEN 'dropped' WHEN t.created_at > r.t THEN 'late'
    WHEN gap.ref_id IS NOT NULL THEN 'missing_column' END AS status
  FROM r LEFT JOIN t ON r.name = t.name LEFT JOIN gap ON gap.ref_source = r.ref_source AND gap.ref_id = r.ref_id
)
"""


@query("p4_found", _P4_CTE + "SELECT DISTINCT ref_source, ref_id, status FROM s WHERE status IS NOT NULL")
def p4_found(spark, d):
    return _statuses(spark, d).select("ref_source", "ref_id", "status").distinct()


@query(
    "p4_counts",
    _P4_CTE + "SELECT ref_source, name AS table_name, strftime(t, '%Y-%m') AS month, status, count(*) AS refs FROM s WHERE status IS NOT NULL GROUP BY ALL",
)
def p4_counts(spark, d):
    return orphans.orphan_counts(_statuses(spark, d))


@query("integer_orphans_found", "SELECT DISTINCT op_id AS key FROM operations WHERE op_id NOT IN (SELECT op_id FROM operations WHERE raw_sql IS NOT NULL)")
def integer_orphans_found(spark, d):
    """Deliveries that no delivery with a text has the number of: keys of both sides are matched as the integers they are."""
    ops = table(spark, d, "operations").select(F.col("op_id").alias("key"), "raw_sql")
    return orphans.orphan_keys(ops.select("key"), ops.where("raw_sql IS NOT NULL").select("key"))


@query(
    "integer_orphan_keys",
    "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
)
def integer_orphan_keys(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return orphans.orphan_keys(refs, table(spark, d, "orders").select(F.col("o_orderkey").alias("key")))


P5_SQL = r"""
WITH RECURSIVE s AS (
  SELECT operation AS op, upper(trim(replace(table_name, '"', ''))) AS t, upper(trim(replace(column_name, '"', ''))) AS c, data_type AS ty, col_defs,
    list_resize(list_transform(string_split(replace(version, '_', '.'), '.'), lambda x: x::HUGEINT), 12, 0) AS v, statement_index AS i
  FROM operations
  QUALIFY row_number() OVER (PARTITION BY source_file, statement_index ORDER BY arrived_at, op_id) = 1
), n AS (SELECT *, row_number() OVER (ORDER BY v, i) AS seq FROM s WHERE op IN ('CREATE_TABLE', 'DROP_TABLE', 'ADD_COLUMN', 'MODIFY_COLUMN', 'DROP_COLUMN')),
base AS (SELECT t, max(seq) AS b, arg_max(op, seq) AS op FROM n WHERE op IN ('CREATE_TABLE', 'DROP_TABLE') GROUP BY t),
born AS (
  SELECT n.t, seq, upper(trim(replace(d.name, '"', ''))) AS c, d.data_type AS ty, 'I' AS k
  FROM (SELECT t, seq, unnest(col_defs) AS d FROM n WHERE op = 'CREATE_TABLE') n
  UNION ALL SELECT t, seq, c, ty, 'I' FROM n WHERE op = 'ADD_COLUMN'
  UNION ALL SELECT t, seq, c, ty, 'U' FROM n WHERE op = 'MODIFY_COLUMN' AND ty IS NOT NULL
), live AS (
  SELECT x.* FROM born x JOIN base ON base.t = x.t AND base.op = 'CREATE_TABLE' AND x.seq >= base.b
  LEFT JOIN (SELECT t, c, max(seq) AS d FROM n WHERE op = 'DROP_COLUMN' GROUP BY ALL) dc ON dc.t = x.t AND dc.c = x.c
  WHERE dc.d IS NULL OR x.seq > dc.d
), first AS (SELECT t, c, min(seq) AS f FROM live WHERE k = 'I' GROUP BY ALL)
SELECT live.t AS table_name, live.c AS column_name, arg_max(live.ty, live.seq) FILTER (WHERE k = 'U' OR seq = f) AS data_type
FROM live JOIN first ON first.t = live.t AND first.c = live.c AND live.seq >= f GROUP BY ALL
"""


@query("p5_found", P5_SQL)
def p5_found(spark, d):
    return changefeed.current_columns(table(spark, d, "operations"))
