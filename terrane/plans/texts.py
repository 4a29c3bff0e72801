"""Queries of retrieval, rendering, caching and event streams in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import catalog, render, retrieval
from terrane.plans.catalog import _C, _R, _T, columns, tables
from terrane.plans.registry import query, table
from terrane.sources import migrations
from terrane.streaming import watch

QUESTION = "Which foreign key references the ledger entry when a migration script drops an old index, and which script fails?"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(retrieval.STOP_WORDS)))
_BM25 = f"""WITH c AS (SELECT chunk_id, arg_max(concat_ws(' ', title, title, hint, hint, content), built_at) AS x FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
d AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(x), '[a-z][a-z0-9_]*'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS t FROM c),
q AS (SELECT t, count(*) AS m FROM (SELECT unnest(list_filter(regexp_extract_all(lower('{QUESTION}'), '[a-z][a-z0-9_]*'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))) AS t) GROUP BY 1),
tf AS (SELECT chunk_id, t, count(*) AS f FROM (SELECT chunk_id, unnest(t) AS t FROM d) GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d)
SELECT tf.chunk_id, sum(m * ln((n - df + 0.5) / (df + 0.5) + 1.0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d.t) / a)))::DECIMAL(18,4) AS score
FROM tf JOIN q USING (t) JOIN df USING (t) JOIN d ON d.chunk_id = tf.chunk_id, s GROUP BY 1 ORDER BY score DESC, 1 DESC LIMIT 10"""


@query("bm25_topk", _BM25)
def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "chunks"), QUESTION, 10)


@query(
    "cosine_search",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, (list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)) + 1e-9))::DECIMAL(18,4) AS score FROM v, v q WHERE q.vec_id % 100 = 0)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC))::INT AS rank FROM s QUALIFY rank <= 10""",
)
def cosine_search(spark, d):
    """The stated queries are the rows whose id is divisible by 100, against all rows."""
    v = table(spark, d, "embeddings")
    return retrieval.cosine_search(v, v.where("vec_id % 100 = 0"), 10)


_NL = "chr(10)"
_CHUNKS = _R + f""", {_C}, cs AS (SELECT table_name, string_agg('  ' || column_name || ': ' || coalesce(data_type, 'UNKNOWN') || CASE WHEN fl = '' THEN '' ELSE ' [' || fl || ']' END || coalesce(' -- ' || column_comment, ''), {_NL} ORDER BY ord) AS l
  FROM (SELECT *, concat_ws(', ', CASE WHEN is_pk THEN 'PK' END, CASE WHEN NOT nullable THEN 'NOT NULL' END, 'DEFAULT ' || nullif(default_expr, ''), CASE WHEN is_unique AND NOT is_pk THEN 'UNIQUE' END, CASE WHEN is_fk THEN 'FK' END) AS fl FROM col) GROUP BY 1),
o1 AS (SELECT from_table AS f, '  ' || array_to_string(from_cols, ',') || ' → ' || to_table || '(' || array_to_string(to_cols, ',') || ')' || coalesce(' ON DELETE ' || on_delete, '') || coalesce(' [' || name || ']', '') AS l FROM r WHERE to_table IS NOT NULL),
i1 AS (SELECT to_table AS f, '  ' || from_table || '.' || array_to_string(from_cols, ',') || ' → ' || array_to_string(to_cols, ',') AS l FROM r WHERE to_table IS NOT NULL),
x1 AS (SELECT full_name AS f, '  ' || i.name || ': (' || array_to_string(i.columns, ', ') || ')' || CASE WHEN i.is_unique THEN '  UNIQUE' ELSE '' END || ' [V' || coalesce(i.created_in, '?') || ']' AS l FROM (SELECT full_name, unnest(indexes) AS i FROM t)),
k1 AS (SELECT full_name AS f, '  ' || coalesce(k.name, 'unnamed') || ': CHECK (' || coalesce(k.check_expr, '') || ')' AS l FROM con WHERE k.type = 'check'),
og AS (SELECT f, string_agg(l, {_NL} ORDER BY l) AS l FROM o1 GROUP BY 1), ig AS (SELECT f, string_agg(l, {_NL} ORDER BY l) AS l FROM i1 GROUP BY 1),
xg AS (SELECT f, string_agg(l, {_NL} ORDER BY l) AS l FROM x1 GROUP BY 1), kg AS (SELECT f, string_agg(l, {_NL} ORDER BY l) AS l FROM k1 GROUP BY 1)
"""


@query(
    "chunks",
    _CHUNKS + f"""SELECT 'table:' || full_name AS chunk_id, 'TABLE: ' || full_name || coalesce({_NL} || 'Description: ' || nullif(table_comment, ''), '') || {_NL} || 'Schema: ' || coalesce(schema_name, 'default') || ' | Created: V' || coalesce(created_in, '?')
  || CASE WHEN len(modified_in) > 0 THEN ' | Modified: V' || array_to_string(modified_in, ', V') ELSE '' END || {_NL} || {_NL} || 'COLUMNS:' || {_NL} || coalesce(cs.l, '')
  || coalesce({_NL} || {_NL} || 'REFERENCES (outgoing FK):' || {_NL} || og.l, '') || coalesce({_NL} || {_NL} || 'REFERENCED BY:' || {_NL} || ig.l, '') || coalesce({_NL} || {_NL} || 'INDEXES:' || {_NL} || xg.l, '')
  || coalesce({_NL} || {_NL} || 'CHECK CONSTRAINTS:' || {_NL} || kg.l, '') AS content
FROM t LEFT JOIN cs ON cs.table_name = full_name LEFT JOIN og ON og.f = full_name LEFT JOIN ig ON ig.f = full_name LEFT JOIN xg ON xg.f = full_name LEFT JOIN kg ON kg.f = full_name""",
)
def chunks(spark, d):
    t = tables(spark, d)
    return retrieval.table_chunks(t, columns(spark, d), catalog.relationships(t))


@query(
    "schema_chunks",
    _R + f""", {_C}, mo AS (SELECT from_table AS f, 0 AS side, '  ──FK──▶ ' || to_table || ' via ' || array_to_string(from_cols, ',') || coalesce('  [ON DELETE ' || on_delete || ']', '') AS l FROM r WHERE to_table IS NOT NULL
  UNION ALL SELECT to_table, 1, '  ◀──FK── ' || from_table || ' via ' || array_to_string(from_cols, ',') FROM r WHERE to_table IS NOT NULL), mg AS (SELECT f, string_agg(l, {_NL} ORDER BY side, l) AS l FROM mo GROUP BY 1),
ed AS (SELECT '  ' || from_table || '.' || array_to_string(from_cols, ',') || ' → ' || to_table || '.' || array_to_string(to_cols, ',') AS l FROM r WHERE to_table IS NOT NULL),
ro AS (SELECT '  ' || full_name || ': ' || CASE WHEN fk_in > 0 AND fk_out = 0 THEN 'root/parent entity' WHEN fk_in > 0 THEN 'junction/child entity' WHEN fk_out > 0 THEN 'leaf/detail entity' ELSE 'standalone' END || ' (referenced by ' || fk_in || ', references ' || fk_out || ')' AS l FROM d)
SELECT 'schema:summary' AS chunk_id, 'SCHEMA SUMMARY' || {_NL} || 'DB Schemas: ' || (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT schema_name AS s FROM t)) || {_NL} || 'Tables: ' || (SELECT count(*) || ' (' || string_agg(full_name, ', ' ORDER BY full_name) || ')' FROM t)
  || {_NL} || 'Sequences: 0 ()' || {_NL} || 'Total columns: ' || (SELECT count(*) FROM col) || {_NL} || 'FK relationships: ' || (SELECT count(*) FROM ed) || {_NL} || {_NL} || 'RELATIONSHIP MAP:' || {_NL} || (SELECT string_agg(l, {_NL} ORDER BY l) FROM ed)
  || {_NL} || {_NL} || 'TABLE ROLES:' || {_NL} || (SELECT string_agg(l, {_NL} ORDER BY l) FROM ro) AS content
UNION ALL SELECT 'schema:relationships', 'RELATIONSHIP GRAPH (adjacency list)' || {_NL} || {_NL} || string_agg(full_name || ':' || {_NL} || coalesce(l, '  (no FK relationships)'), {_NL} ORDER BY full_name) FROM t LEFT JOIN mg ON f = full_name""",
)
def schema_chunks(spark, d):
    """The summary of the whole schema and its relationship map."""
    t = tables(spark, d)
    return retrieval.schema_chunks(t, columns(spark, d), catalog.relationships(t))


@query("chat_history", "SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 4")
def chat_history(spark, d):
    return retrieval.history(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "event_id", 2)


@query("csv_render", f"""WITH {_T} SELECT full_name, '"' || replace(full_name, '"', '""') || '","' || replace(coalesce(table_comment, ''), '"', '""') || '","' || column_count || '"' AS line FROM t""")
def csv_render(spark, d):
    return tables(spark, d).select("full_name", render.csv_line("full_name", "table_comment", "column_count").alias("line"))


@query("json_render", f"WITH {_T} SELECT full_name, json_object('full_name', full_name, 'column_count', column_count, 'has_pk', has_pk, 'comment', table_comment)::VARCHAR AS line FROM t")
def json_render(spark, d):
    rows = tables(spark, d).withColumn("comment", F.col("table_comment"))
    return rows.select("full_name", render.json_line("full_name", "column_count", "has_pk", "comment").alias("line"))


_ID = "regexp_replace({}, '[^A-Za-z0-9_]', '_', 'g')"


@query("dot_render", _R + f"""SELECT from_table AS source, '  ' || {_ID.format("from_table")} || ' -> ' || {_ID.format("to_table")} || ' [label="' || array_to_string(from_cols, ', ') || '"];' AS line FROM r WHERE to_table IS NOT NULL""")
def dot_render(spark, d):
    return render.dot_edges(catalog.relationships(tables(spark, d)))


@query(
    "mermaid_render",
    _R + f"""SELECT from_table AS source, '    ' || {_ID.format("from_table")} || CASE cardinality WHEN 'one_to_one' THEN ' ||--|| ' ELSE ' }}o--|| ' END || {_ID.format("to_table")} || ' : "' || array_to_string(from_cols, ', ') || '"' AS line FROM r WHERE to_table IS NOT NULL""",
)
def mermaid_render(spark, d):
    return render.mermaid_edges(catalog.relationships(tables(spark, d)))


@query("grid_layout", f"WITH {_T}, g AS (SELECT schema_name, full_name, row_number() OVER (PARTITION BY schema_name ORDER BY full_name) - 1 AS i FROM t) SELECT schema_name, full_name, (i % 3 * 320)::INT AS x, (i // 3 * 240)::INT AS y FROM g")
def grid_layout(spark, d):
    return render.grid(tables(spark, d))


@query("cache_misses", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text NOT IN (SELECT content FROM chunks WHERE content IS NOT NULL) GROUP BY 1")
def cache_misses(spark, d):
    """Distinct texts, by content hash, that are not cached yet."""
    held = table(spark, d, "chunks").where("content IS NOT NULL").select(F.sha2("content", 256).alias("cache_key"))
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return migrations.lacking(docs, held, "hash").groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query(
    "debounce",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM events),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM g GROUP BY user_id, s""",
)
def debounce(spark, d):
    return watch.debounced(table(spark, d, "events"), "user_id", "ts", "2 hours")


@query(
    "shrink_gate",
    """WITH n AS (SELECT ts::DATE AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1), p AS (SELECT *, lag(users) OVER (ORDER BY day) AS before FROM n)
SELECT day, users, before, coalesce(before > 0 AND users < 0.8 * before, false) AS blocked FROM p""",
)
def shrink_gate(spark, d):
    by = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"))
    return watch.shrink_checked(by, "day", "users")


# Scripts with what makes splitting hard, and the statements each has, as written.
_SCRIPTS = [
    ("quotes", "INSERT INTO T VALUES ('a;b', 'it''s;'); UPDATE \"X;Y\" SET A = 1 WHERE B = ';'", ["INSERT INTO T VALUES ('a;b', 'it''s;')", "UPDATE \"X;Y\" SET A = 1 WHERE B = ';'"]),
    ("comments", "-- one; two\nDROP TABLE A; /* three; four */ DROP TABLE B;;", ["DROP TABLE A", "DROP TABLE B"]),
    ("body", "CREATE OR REPLACE TRIGGER TR BEFORE INSERT ON T BEGIN\n  X := 1;\n  Y := 2;\nEND;\n/\nDROP TABLE C;", ["CREATE OR REPLACE TRIGGER TR BEFORE INSERT ON T BEGIN\n  X := 1;\n  Y := 2;\nEND;", "DROP TABLE C"]),
    ("brackets", "CREATE TABLE T (A VARCHAR2(10) DEFAULT ';', B INT);\nALTER TABLE T ADD (C INT)", ["CREATE TABLE T (A VARCHAR2(10) DEFAULT ';', B INT)", "ALTER TABLE T ADD (C INT)"]),
    ("empty", " ; \n -- nothing\n", []),
]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(
    "split_statements",
    "SELECT * FROM (VALUES " + ", ".join(f"({_text(n)}, {i}, {_text(x)})" for n, _, own in _SCRIPTS for i, x in enumerate(own)) + """) v(script, statement_no, statement)
UNION ALL SELECT 'op ' || op_id, 0, rtrim(trim(regexp_replace(raw_sql, '--[^\\n]*$', ''), ' ' || chr(9) || chr(10) || chr(13)), '; ' || chr(9) || chr(10) || chr(13)) FROM operations WHERE raw_sql IS NOT NULL""",
)
def split_statements(spark, d):
    """Scripts cut into statements: those above, and every text of the log, each of which is one."""
    from terrane.ddl.extract import split

    ops = table(spark, d, "operations").where("raw_sql IS NOT NULL")
    own = spark.createDataFrame([(n, x) for n, x, _ in _SCRIPTS], "filename string, sql string")
    rows = split(own.unionByName(ops.select(F.concat(F.lit("op "), "op_id").alias("filename"), F.col("raw_sql").alias("sql"))))
    return rows.select(F.col("filename").alias("script"), F.col("stmt_idx").alias("statement_no"), F.col("raw_sql").alias("statement"))


@query(
    "ddl_extract",
    """WITH o AS (SELECT *, upper(trim(replace(table_name, '"', ''))) AS t, upper(trim(replace(column_name, '"', ''))) AS c FROM operations WHERE raw_sql IS NOT NULL),
d AS (SELECT op_id, t, unnest(col_defs) AS d, unnest(range(1, len(col_defs) + 1)) AS i FROM o WHERE operation = 'CREATE_TABLE')
SELECT op_id, 0 AS op_idx, CASE operation WHEN 'UNKNOWN' THEN upper(regexp_extract(raw_sql, '[A-Za-z]+')) ELSE operation END AS operation, t AS table_name,
  CASE WHEN operation IN ('ADD_COLUMN', 'MODIFY_COLUMN', 'DROP_COLUMN', 'COMMENT') THEN c WHEN operation = 'CREATE_INDEX' THEN upper(regexp_extract(raw_sql, '(?i)INDEX[\\s\\p{Z}]+([^\\s\\p{Z}]+)[\\s\\p{Z}]+ON', 1))
    WHEN operation = 'ADD_CONSTRAINT' THEN upper(regexp_extract(raw_sql, '(?i)CONSTRAINT[\\s\\p{Z}]+([^\\s\\p{Z}]+)', 1)) END AS object,
  CASE WHEN operation IN ('ADD_COLUMN', 'MODIFY_COLUMN') THEN data_type END AS data_type FROM o
UNION ALL SELECT op_id, i::INT, 'CREATE_COLUMN', t, upper(trim(replace(d.name, '"', ''))), d.data_type FROM d""",
)
def ddl_extract(spark, d):
    """All operations of every statement's text, parsed by our own extractor; the SQL takes what the log says of it."""
    from terrane.ddl.extract import extract

    ops = table(spark, d, "operations").where("raw_sql IS NOT NULL")
    rows = extract(ops.select(F.col("op_id").cast("string").alias("filename"), F.col("raw_sql").alias("sql")))
    return rows.select(F.col("filename").cast("bigint").alias("op_id"), "op_idx", "operation", "table_name", F.col("target").alias("object"), "data_type")
