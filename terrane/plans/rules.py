"""Queries of the rules over the migration log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import types, versions
from terrane.functions.names import norm_name
from terrane.operators import migrations
from terrane.operators import rules as r
from terrane.plans.catalog import _C, _T, columns
from terrane.plans.registry import query, table


def _q(x: str) -> str:
    return x.replace("'", "''")


def _case(values: dict, of: str) -> str:
    rows = " ".join(f"WHEN '{_q(str(k))}' THEN {repr(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {of} {rows} END"


_LADDER = " ".join(
    f"WHEN regexp_matches(x, '{_q(k.pattern)}')" + (f" AND NOT regexp_matches(x, '{_q(k.unless)}')" if k.unless else "") + f" THEN '{_q(k.kind)}'" for k in r.RULES
)
_K = rf"""s AS (SELECT source_file, statement_index, arg_min(raw_sql, (arrived_at, op_id)) AS raw_sql FROM operations WHERE raw_sql IS NOT NULL GROUP BY 1, 2),
one AS (SELECT *, upper(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(raw_sql, '--[^\n]*', ' ', 'g'), '(?s)/\*.*?\*/', ' ', 'g'), '[\s\v\x85\p{{Z}}]+', ' ', 'g')), ' ?;$', '')) AS x FROM s),
kinds AS (SELECT source_file, statement_index, CASE {_LADDER} ELSE '{r.OTHER.kind}' END AS kind FROM one),
k AS (SELECT *, {_case(r._of("category"), "kind")} AS category, {_case(r._of("level"), "kind")} AS level, {_case(r._of("weight"), "kind")} AS weight,
  {_case(r._of("penalty"), "kind")} AS penalty FROM kinds)"""


def kinds(spark, d):
    return r.with_kinds(table(spark, d, "operations"))


@query("statement_kinds", f"WITH {_K} SELECT kind, level, count(*) AS n FROM k GROUP BY 1, 2")
def statement_kinds(spark, d):
    return kinds(spark, d).groupBy("kind", "level").agg(F.count("*").alias("n"))


_RANK = _case({n: i for i, n in enumerate(r.CATEGORIES)}, "category")
_RISK = _case({n: r.RISKS.index(x) for n, x in r.CATEGORIES.items()}, "category")


@query(
    "classify",
    f"""WITH {_K}, g AS (SELECT source_file, arg_min(category, {_RANK}) AS "primary", list_sort(list_distinct(list(category))) AS every, max({_RISK}) AS risk FROM k GROUP BY 1)
SELECT source_file, "primary", array_to_string(list_filter(every, lambda c: c <> "primary"), ',') AS secondary, ['low', 'medium', 'high'][risk + 1] AS risk FROM g""",
)
def classify(spark, d):
    return r.classify(kinds(spark, d))


@query(
    "classify_groups",
    f"""WITH {_K}, g AS (SELECT source_file, arg_min(category, {_RANK}) AS "primary", max({_RISK}) AS risk FROM k GROUP BY 1)
SELECT "primary", ['low', 'medium', 'high'][risk + 1] AS risk, count(*) AS files FROM g GROUP BY 1, 2""",
)
def classify_groups(spark, d):
    return r.classify(kinds(spark, d)).groupBy("primary", "risk").agg(F.count("*").alias("files"))


_LEVEL = _case({x: i for i, x in enumerate(r.LEVELS)}, "level")


@query(
    "safety_levels",
    f"""WITH {_K} SELECT source_file, arg_max(level, {_LEVEL}) AS level, count(*) FILTER (WHERE level = 'SAFE') AS safe, count(*) FILTER (WHERE level = 'MEDIUM_RISK') AS medium_risk,
  count(*) FILTER (WHERE level = 'HIGH_RISK') AS high_risk, count(*) FILTER (WHERE level = 'DANGEROUS') AS dangerous, max({_LEVEL}) >= 2 AS needs_approval FROM k GROUP BY 1""",
)
def safety_levels(spark, d):
    return r.safety(kinds(spark, d))


@query("threshold_gates", f"WITH {_K}, g AS (SELECT source_file, max({_LEVEL}) AS l FROM k GROUP BY 1) SELECT count(*) AS files, count(*) FILTER (WHERE l >= 2) AS blocked, CASE WHEN count(*) FILTER (WHERE l >= 2) > 0 THEN 1 ELSE 0 END AS exit_code FROM g")
def threshold_gates(spark, d):
    return r.gate(r.safety(kinds(spark, d)), "HIGH_RISK")


def _cost_sql(profile: str) -> str:
    f = r.PROFILES[profile]
    factor = "CASE WHEN false THEN 1.0 " + " ".join(f"WHEN contains(lower(kind), '{k}') THEN {v}" for k, v in f.items() if k != "*") + f" ELSE {f['*']} END"
    read = 100_000 * 200 / (100.0 * 1024 * 1024)
    secs = f"coalesce({_case({k: v * read for k, v in r.RUNTIME_FACTORS.items()}, 'kind')}, CASE WHEN kind = 'TRUNCATE' THEN 1.0 ELSE greatest(0.1, weight * 0.02) END)"
    return f"""WITH {_K}, g AS (SELECT source_file, least(100, sum(greatest(1, round_even((weight * ({factor}))::DECIMAL(18,4), 0)::INT)))::INT AS score,
  sum(({secs})::DOUBLE)::DECIMAL(18,3) AS seconds, count(*) AS statements FROM k GROUP BY 1)
SELECT *, CASE WHEN score < 25 THEN 'low' WHEN score < 50 THEN 'medium' WHEN score < 75 THEN 'high' ELSE 'critical' END AS grade FROM g"""


@query("cost_score", _cost_sql("default"))
def cost_score(spark, d):
    return r.cost(kinds(spark, d))


@query("cost_score_data_migration", _cost_sql("data-migration"))
def cost_score_data_migration(spark, d):
    return r.cost(kinds(spark, d), "data-migration")


@query("cost_summary", "SELECT count(*) AS files, avg(score)::DECIMAL(18,4) AS mean_score, max(score) AS max_score FROM (" + _cost_sql("default") + ")")
def cost_summary(spark, d):
    return r.cost(kinds(spark, d)).agg(F.count("*").alias("files"), F.avg("score").cast("decimal(18,4)").alias("mean_score"), F.max("score").alias("max_score"))


@query(
    "rollback_score",
    f"""WITH {_K}, g AS (SELECT source_file, bool_or(penalty IS NULL) AS bad, sum(coalesce(penalty, 0)) AS p FROM k GROUP BY 1)
SELECT source_file, CASE WHEN bad THEN 'irreversible' WHEN p > 0 THEN 'partial' ELSE 'reversible' END AS feasibility,
  (CASE WHEN bad THEN 0 WHEN p > 0 THEN greatest(20, 100 - p) ELSE 95 END)::INT AS score FROM g""",
)
def rollback_score(spark, d):
    return r.rollback(kinds(spark, d))


_NORM = "upper(trim(replace(table_name, '\"', '')))"


@query(
    "health_score",
    f"""WITH {_K}, bad AS (SELECT source_file, bool_or(penalty IS NULL) AS b FROM k GROUP BY 1),
i AS (SELECT upper(split_part(source_file, '/', 1)) AS schema, count(*) FILTER (WHERE b) AS files FROM bad GROUP BY 1),
f AS (SELECT split_part({_NORM}, '.', 1) AS schema, severity FROM (SELECT DISTINCT * FROM findings) WHERE contains(table_name, '.')),
g AS (SELECT schema, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM f GROUP BY 1),
sc AS (SELECT g.*, coalesce(files, 0) AS files, greatest(0, 100 - 20 * errors - 5 * warnings - 10 * coalesce(files, 0))::INT AS score FROM g LEFT JOIN i USING (schema))
SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'warning' ELSE 'critical' END AS grade FROM sc""",
)
def health_score(spark, d):
    f = table(spark, d, "findings").distinct().where("contains(table_name, '.')")
    f = f.select(F.split_part(norm_name(F.col("table_name")), F.lit("."), F.lit(1)).alias("schema"), "severity")
    files = r.rollback(kinds(spark, d)).groupBy(F.upper(F.split_part("source_file", F.lit("/"), F.lit(1))).alias("schema"))
    return r.health(f, files.agg(F.count_if(F.col("feasibility") == "irreversible").alias("files")), "schema")


_STAB = f"""WITH {_T}, n AS (SELECT count(DISTINCT version) AS total FROM migration_results),
m AS (SELECT full_name AS name, len(list_distinct(list_filter(modified_in, lambda v: v <> created_in))) AS changes FROM t),
s AS (SELECT name, (1 + changes)::BIGINT AS modifications, (1 + changes) * 100 / total AS c, greatest(0, 100 - floor((1 + changes) * 200 / total))::INT AS score FROM m, n)
"""


def _stability(spark, d):
    total = table(spark, d, "migration_results").select(F.countDistinct("version")).scalar()
    t = table(spark, d, "tables_state").dropDuplicates(["full_name"])
    changes = F.size(F.array_distinct(F.filter("modified_in", lambda v: v != F.col("created_in"))))
    return r.stability(t.select(F.col("full_name").alias("name"), changes.alias("changes")), total)


@query(
    "stability",
    _STAB + """SELECT name, modifications, c::DECIMAL(18,2) AS churn, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN c >= 20 THEN 'high' WHEN c < 10 THEN 'stable' ELSE 'medium' END AS class FROM s""",
)
def stability(spark, d):
    return _stability(spark, d)


@query("stability_overall", _STAB + "SELECT count(*) AS tables, floor(avg(score))::INT AS overall, CASE WHEN count(*) > 1 THEN stddev_pop(score)::DECIMAL(18,4) END AS volatility FROM s")
def stability_overall(spark, d):
    rows = _stability(spark, d)
    vol = F.when(F.count("*") > 1, F.stddev_pop("score").cast("decimal(18,4)"))
    return rows.agg(F.count("*").alias("tables"), F.floor(F.avg("score")).cast("int").alias("overall"), vol.alias("volatility"))


_PII = [(k, p) for k, ps in r.PII_PATTERNS.items() for p in ps]
_PII_SQL = f"""WITH {_C}, p AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{_q(p)}')" for i, (k, p) in enumerate(_PII))}) v(i, category, pattern)),
h AS (SELECT table_name, column_name, i, category, pattern FROM col JOIN p ON regexp_matches(lower(column_name), pattern)
  UNION ALL SELECT table_name, column_name, 1000 + i, category, pattern FROM col JOIN p ON regexp_matches(column_comment, pattern)),
g AS (SELECT table_name, column_name, arg_min(category, i) AS category, string_agg(category, ',' ORDER BY i) AS categories, arg_max(pattern, i) AS evidence FROM h GROUP BY 1, 2),
w AS (SELECT g.*, (SELECT bool_or(regexp_full_match(lower(column_name), pattern)) FROM p WHERE p.category = g.category) AS whole,
  (SELECT bool_or(regexp_matches(lower(column_name), pattern)) FROM p WHERE contains(pattern, '_')) AS wide FROM g)
"""


@query("pii_scan", _PII_SQL + "SELECT table_name, column_name, category, categories, (CASE WHEN whole THEN 1.0 WHEN wide THEN 0.8 ELSE 0.6 END)::DECIMAL(3,1) AS confidence, evidence FROM w")
def pii_scan(spark, d):
    return r.pii(columns(spark, d))


# What the scan must say of some columns, written out.
_PII_CASES = [
    ("EMAIL", None, "email", "email", 1.0, "e_?mail"),
    ("CUSTOMER_NAME", None, "name", "name", 1.0, "(first|last|full|display|user|person|customer|client)_?name"),
    ("X1", "holds the customer email address", "email", "email,address", 0.6, "(addr|address|street|city|state|province|postal|zip|postcode)"),
    ("HOME_PHONE_NUMBER", None, "phone", "phone", 0.8, "(phone|mobile|cell|fax|tel)(_?num(ber)?)?"),
    ("WEIGHT_KG", "weight kg of the row", "health", "health", 0.6, r"\bweight\b"),
    ("CITY", None, "address", "address", 1.0, "(addr|address|street|city|state|province|postal|zip|postcode)"),
    ("SESSION_ID", "A SESSION_ID", "cookie", "cookie", 1.0, "(session_?id|cookie|jwt|bearer)"),
    ("QUANTITY", "how many", None, None, None, None),
]


@query(
    "pii_cases",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', '{k}', '{ks}', {conf}::DECIMAL(3,1), '{_q(e)}')" for c, _, k, ks, conf, e in _PII_CASES if k)
    + ") v(column_name, category, categories, confidence, evidence)",
)
def pii_cases(spark, d):
    cases = spark.createDataFrame([("T", c, text) for c, text, *_ in _PII_CASES], "table_name string, column_name string, column_comment string")
    return r.pii(cases).drop("table_name")


@query("pii_counts", _PII_SQL + "SELECT category, count(*) AS columns, count(DISTINCT table_name) AS tables FROM w GROUP BY 1")
def pii_counts(spark, d):
    return r.pii(columns(spark, d)).groupBy("category").agg(F.count("*").alias("columns"), F.countDistinct("table_name").alias("tables"))


@query("pii_tables", _PII_SQL + "SELECT table_name, count(*) AS columns, max(CASE WHEN whole THEN 1.0 WHEN wide THEN 0.8 ELSE 0.6 END)::DECIMAL(3,1) AS surest FROM w GROUP BY 1 ORDER BY columns DESC, 1 LIMIT 5")
def pii_tables(spark, d):
    return r.pii_tables(r.pii(columns(spark, d)))


# Statements with what the rules must say of them, written out: kind, category, level, weight, penalty (null: it cannot be undone).
_STATEMENTS = [
    ("create table app.t (id number);", "CREATE TABLE", "table_creation", "SAFE", 20, 10),
    ("CREATE TABLE T2 AS SELECT * FROM T", "CREATE TABLE AS SELECT", "table_creation", "SAFE", 60, 10),
    ("CREATE INDEX IX ON T(A)", "CREATE INDEX", "index_management", "MEDIUM_RISK", 40, 5),
    ("CREATE UNIQUE INDEX CONCURRENTLY IX ON T(A)", "CREATE INDEX CONCURRENTLY", "index_management", "SAFE", 20, 5),
    ("CREATE SEQUENCE S START WITH 1", "CREATE SEQUENCE", "mixed", "SAFE", 10, 10),
    ("CREATE OR REPLACE VIEW V AS SELECT A FROM T", "CREATE PROC/VIEW", "view_trigger_procedure", "SAFE", 5, 0),
    ("-- gone\nDROP TABLE T CASCADE CONSTRAINTS", "DROP TABLE", "cleanup", "DANGEROUS", 10, None),
    ("DROP VIEW V", "DROP VIEW", "cleanup", "HIGH_RISK", 10, None),
    ("DROP INDEX IX", "DROP INDEX", "index_management", "MEDIUM_RISK", 5, 5),
    ("ALTER TABLE T DROP COLUMN A", "DROP COLUMN", "column_removal", "HIGH_RISK", 70, None),
    ("ALTER TABLE T ADD CONSTRAINT FK FOREIGN KEY (A) REFERENCES P (B)", "ADD CONSTRAINT", "constraint_modification", "MEDIUM_RISK", 60, 5),
    ("ALTER TABLE T ADD (A NUMBER NOT NULL)", "ADD COLUMN NOT NULL", "column_addition", "HIGH_RISK", 80, 15),
    ("ALTER TABLE T ADD (A NUMBER DEFAULT 0 NOT NULL)", "ADD COLUMN", "column_addition", "SAFE", 10, 15),
    ("ALTER TABLE T MODIFY (A CLOB)", "MODIFY COLUMN", "constraint_modification", "HIGH_RISK", 80, None),
    ("INSERT INTO T SELECT * FROM O", "INSERT ... SELECT", "data_migration", "SAFE", 60, None),
    ("INSERT INTO T VALUES (1)", "INSERT", "data_migration", "SAFE", 10, None),
    ("DELETE FROM T", "DELETE (no where)", "data_migration", "DANGEROUS", 90, None),
    ("DELETE FROM T WHERE A = 1", "DELETE (where)", "data_migration", "HIGH_RISK", 50, None),
    ("UPDATE T SET A = 1", "UPDATE (no where)", "data_migration", "DANGEROUS", 90, None),
    ("UPDATE T SET A = 1 WHERE B = 2", "UPDATE (where)", "data_migration", "HIGH_RISK", 50, None),
    ("TRUNCATE TABLE T", "TRUNCATE", "data_migration", "DANGEROUS", 80, None),
    ("MERGE INTO T USING S ON (T.A = S.A) WHEN MATCHED THEN UPDATE SET B = 1", "MERGE", "data_migration", "MEDIUM_RISK", 90, None),
    ("COMMENT ON TABLE T IS 'x'", "COMMENT", "mixed", "SAFE", 10, 0),
    ("GRANT SELECT ON T TO U", "UNCLASSIFIED", "mixed", "MEDIUM_RISK", 30, 0),
]


def _sql(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + _q(x) + "'"


def _log(spark, statements: list[str]):
    rows = [("f", i, x, "1", None, 0) for i, x in enumerate(statements)]
    return spark.createDataFrame(rows, "source_file string, statement_index int, raw_sql string, version string, arrived_at timestamp, op_id int")


@query(
    "statement_rules",
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_sql, x[1:]))})" for i, x in enumerate(_STATEMENTS)) + ") v(statement_index, kind, category, level, weight, penalty)",
)
def statement_rules(spark, d):
    return r.with_kinds(_log(spark, [x[0] for x in _STATEMENTS])).select("statement_index", "kind", "category", "level", "weight", "penalty")


_TRIGGER = "CREATE OR REPLACE TRIGGER TR BEFORE INSERT ON T FOR EACH ROW BEGIN IF :NEW.A IS NULL THEN :NEW.A := 0; END IF; " + "X := X + 1; " * 40 + "END;"
_FINDING_SCRIPTS = [
    ("ALTER TABLE T ADD (A NUMBER NOT NULL)", "ADD_NOT_NULL_NO_DEFAULT", "error"),
    ("ALTER TABLE T ADD (A NUMBER DEFAULT 1 NOT NULL)", None, None),
    ("CREATE VIEW V AS SELECT * FROM T", "SELECT_STAR_VIEW", "warning"),
    ("CREATE VIEW V AS SELECT A FROM T", None, None),
    (_TRIGGER, "TRIGGER_WITH_BUSINESS_LOGIC", "warning"),
    ("CREATE TRIGGER TR BEFORE INSERT ON T BEGIN IF 1 = 1 THEN NULL; END IF; END;", None, None),
    ("DELETE FROM T", "LARGE_DELETE_NO_WHERE", "warning"),
    ("DELETE FROM T WHERE A = 1", None, None),
]


@query(
    "statement_findings",
    f"""WITH {_K}, z AS (SELECT k.*, one.x, one.raw_sql FROM k JOIN one ON k.source_file = one.source_file AND k.statement_index = one.statement_index)
SELECT source_file, statement_index, 'ADD_NOT_NULL_NO_DEFAULT' AS code, 'error' AS severity FROM z WHERE kind = 'ADD COLUMN NOT NULL'
UNION ALL SELECT source_file, statement_index, 'SELECT_STAR_VIEW', 'warning' FROM z WHERE kind = 'CREATE PROC/VIEW' AND regexp_matches(x, '\\bVIEW\\b.* SELECT \\*')
UNION ALL SELECT source_file, statement_index, 'TRIGGER_WITH_BUSINESS_LOGIC', 'warning' FROM z WHERE regexp_matches(x, '^CREATE (OR REPLACE )?TRIGGER\\b') AND regexp_matches(x, '\\b(IF|CASE)\\b') AND length(raw_sql) > 500
UNION ALL SELECT source_file, statement_index, 'LARGE_DELETE_NO_WHERE', 'warning' FROM z WHERE kind = 'DELETE (no where)'
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('f', {i}, '{c}', '{v}')" for i, (_, c, v) in enumerate(_FINDING_SCRIPTS) if c) + ") v(source_file, statement_index, code, severity)",
)
def statement_findings(spark, d):
    """Findings of the log's statements and of the scripts above, which have each finding and what only looks like one."""
    scripts = _log(spark, [x[0] for x in _FINDING_SCRIPTS])
    return r.statement_findings(kinds(spark, d)).unionByName(r.statement_findings(r.with_kinds(scripts)))


_ONCE = """one AS (SELECT source_file, statement_index, arg_min(struct_pack(operation, table_name, column_name, raw_sql), (arrived_at, op_id)) AS x FROM operations WHERE raw_sql IS NOT NULL GROUP BY 1, 2),
l AS (SELECT source_file, statement_index, x.operation AS op, upper(trim(replace(x.table_name, '"', ''))) AS t, upper(trim(replace(x.column_name, '"', ''))) AS c, x.raw_sql AS raw_sql FROM one),
v AS (SELECT source_file, statement_index, op, CASE op WHEN 'CREATE_TABLE' THEN 'DROP TABLE ' || t || ' CASCADE CONSTRAINTS;' WHEN 'CREATE_INDEX' THEN 'DROP INDEX ' || upper(regexp_extract(raw_sql, '(?i)INDEX[\\s\\p{Z}]+([^\\s\\p{Z}]+)[\\s\\p{Z}]+ON', 1)) || ';'
    WHEN 'ADD_COLUMN' THEN 'ALTER TABLE ' || t || ' DROP COLUMN ' || c || ';' WHEN 'ADD_CONSTRAINT' THEN 'ALTER TABLE ' || t || ' DROP CONSTRAINT ' || upper(regexp_extract(raw_sql, '(?i)CONSTRAINT[\\s\\p{Z}]+([^\\s\\p{Z}]+)', 1)) || ';' END AS reverse,
  CASE op WHEN 'CREATE_TABLE' THEN 'Rollback will drop table ' || t || ' - all data will be lost' WHEN 'CREATE_INDEX' THEN 'Rollback will drop index ' || upper(regexp_extract(raw_sql, '(?i)INDEX[\\s\\p{Z}]+([^\\s\\p{Z}]+)[\\s\\p{Z}]+ON', 1)) || ' - queries may be slower'
    WHEN 'ADD_COLUMN' THEN 'Rollback will drop column ' || t || '.' || c || ' - data will be lost' WHEN 'DROP_TABLE' THEN 'Cannot restore table ' || t || ' without full backup and schema definition'
    WHEN 'DROP_COLUMN' THEN 'Cannot restore dropped column ' || t || '.' || c || ' without backup' WHEN 'MODIFY_COLUMN' THEN 'Cannot undo MODIFY on ' || t || ' without knowing original column definitions'
    WHEN 'UNKNOWN' THEN 'Cannot undo UPDATE without knowing original values' END AS warning,
  op IN ('DROP_TABLE', 'DROP_COLUMN', 'MODIFY_COLUMN', 'UNKNOWN') AS lost,
  CASE op WHEN 'CREATE_TABLE' THEN 10 WHEN 'CREATE_INDEX' THEN 5 WHEN 'ADD_COLUMN' THEN 15 WHEN 'ADD_CONSTRAINT' THEN 5 ELSE 0 END AS penalty FROM l)"""


def _statement_ops(spark, d):
    """The operations of each statement of the log, by the first delivery that has a text."""
    from terrane.ddl.extract import extract

    o = table(spark, d, "operations").where("raw_sql IS NOT NULL").groupBy("source_file", "statement_index")
    one = o.agg(F.min_by("raw_sql", F.struct("arrived_at", "op_id")).alias("sql"))
    rows = extract(one.select(F.to_json(F.struct("source_file", "statement_index")).alias("filename"), "sql"))
    key = F.from_json("filename", "source_file string, statement_index int")
    return rows.withColumn("k", key).withColumn("stmt_idx", F.col("k.statement_index")).withColumn("filename", F.col("k.source_file")).drop("k")


@query("reverse_statements", f"WITH {_ONCE} SELECT source_file, statement_index, reverse, warning, lost AS irreversible FROM v")
def reverse_statements(spark, d):
    rows = r.reverse_operations(_statement_ops(spark, d)).where("op_idx = 0")
    return rows.select(F.col("filename").alias("source_file"), F.col("stmt_idx").alias("statement_index"), "reverse", "warning", "irreversible")


@query(
    "rollback_scripts",
    f"""WITH {_ONCE}, g AS (SELECT source_file, bool_or(lost) AS bad, sum(penalty) AS p, string_agg(reverse, chr(10) ORDER BY statement_index) AS script, count(DISTINCT warning) AS warnings, count(*) FILTER (WHERE lost) AS gone FROM v GROUP BY 1)
SELECT source_file, CASE WHEN bad THEN 'irreversible' WHEN p > 0 OR warnings > 0 THEN 'partial' ELSE 'reversible' END AS feasibility, (CASE WHEN bad THEN 0 WHEN p > 0 OR warnings > 0 THEN greatest(20, 100 - p) ELSE 95 END)::INT AS score,
  CASE WHEN NOT bad THEN script END AS script, warnings::INT AS warnings, gone::INT AS lost FROM g""",
)
def rollback_scripts(spark, d):
    plan = r.rollback_plan(_statement_ops(spark, d))
    return plan.select(F.col("filename").alias("source_file"), "feasibility", "score", "script", F.size("warnings").alias("warnings"), "lost")


_FILE = r"'^([VUR])([0-9][0-9._]*)?__(.+?)(\.sql)?$'"


@query(
    "naming_rules",
    rf"""WITH f AS (SELECT filename, list_last(string_split(filename, '/')) AS b FROM (SELECT DISTINCT filename FROM migration_results)),
g AS (SELECT *, regexp_extract(b, {_FILE}, 1) AS k, regexp_extract(b, {_FILE}, 2) AS v, regexp_extract(b, {_FILE}, 3) AS descr FROM f),
h AS (SELECT *, NOT ((k IN ('V', 'U') AND v <> '') OR (k = 'R' AND v = '')) AS bad FROM g)
SELECT filename, 'LONG_FILENAME' AS code FROM h WHERE length(b) > 25 UNION ALL SELECT filename, 'DESC_FORMAT' FROM h WHERE NOT bad AND NOT regexp_full_match(descr, '[a-z_]+')
UNION ALL SELECT filename, 'DESC_UNDERSCORE' FROM h WHERE starts_with(descr, '_') UNION ALL SELECT filename, 'INVALID_FILENAME' FROM h WHERE bad""",
)
def naming_rules(spark, d):
    return r.naming(table(spark, d, "migration_results").select("filename").distinct(), "filename", "^[a-z_]+$", 25)


_VK = "list_transform(string_split(replace({}, '_', '.'), '.'), lambda x: x::HUGEINT)"


@query(
    "duplicate_versions",
    rf"""WITH f AS (SELECT DISTINCT regexp_extract(filename, '^(.*)/', 1) AS folder, filename, {_VK.format(f"regexp_extract(list_last(string_split(filename, '/')), {_FILE}, 2)")} AS v FROM migration_results)
SELECT folder, min(filename) AS first_file, count(*) AS files FROM f GROUP BY folder, v HAVING count(*) > 1""",
)
def duplicate_versions(spark, d):
    return r.duplicate_versions(table(spark, d, "migration_results"), "filename")


_FILES = [
    "a/V1__x.sql", "a/V2__x.sql", "a/V02__again.sql", "a/V2.0__third.sql", "a/V5__x.sql", "a/V9.1__x.sql", "a/R__views.sql", "b/V1__x.sql", "b/V1_0__y.sql", "b/V3__x.sql", "V7__x.sql", "V8__x.sql",
]


def _files(spark):
    return spark.createDataFrame([(f,) for f in _FILES], "filename string")


@query("sample_duplicates", "SELECT * FROM (VALUES ('a', 'a/V02__again.sql', 3), ('b', 'b/V1_0__y.sql', 2)) v(folder, first_file, files)")
def sample_duplicates(spark, d):
    """Versions that several files carry, in a list of files that has some."""
    return r.duplicate_versions(_files(spark), "filename")


@query("sample_gaps", "SELECT folder, after::DECIMAL(38,0) AS after, before::DECIMAL(38,0) AS before, missing::DECIMAL(38,0) AS missing FROM (VALUES ('a', 2, 5, 2), ('a', 5, 9, 3), ('b', 1, 3, 1)) v(folder, after, before, missing)")
def sample_gaps(spark, d):
    """Gaps between the versions of a folder, in a list of files that has some."""
    return r.missing_versions(_files(spark), "filename")


_MAJOR = f"SELECT DISTINCT regexp_extract(filename, '^(.*)/', 1) AS folder, regexp_extract(regexp_extract(list_last(string_split(filename, '/')), {_FILE}, 2), '^[0-9]+')::HUGEINT AS n FROM migration_results"


@query("version_gaps", f"WITH o AS ({_MAJOR}), g AS (SELECT folder, n AS after, lead(n) OVER (PARTITION BY folder ORDER BY n) AS before FROM o) SELECT folder, after::DECIMAL(38,0) AS after, before::DECIMAL(38,0) AS before, (before - after - 1)::DECIMAL(38,0) AS missing FROM g WHERE before - after > 1")
def version_gaps(spark, d):
    return r.missing_versions(table(spark, d, "migration_results"), "filename")


@query(
    "out_of_order",
    f"""WITH f AS (SELECT DISTINCT filename, regexp_extract(filename, '^(.*)/', 1) AS folder, {_VK.format("version")} AS v FROM migration_results),
g AS (SELECT folder, filename, row_number() OVER (PARTITION BY folder ORDER BY filename) AS by_name,
  row_number() OVER (PARTITION BY folder ORDER BY list_resize(v, 12, 0), filename) AS renumbered FROM f)
SELECT *, by_name <> renumbered AS moved FROM g""",
)
def out_of_order(spark, d):
    return r.order_check(table(spark, d, "migration_results"), "filename", "version")


_LINT_WORDS = "select|from|where|insert|into|update|delete|create|alter|drop|table|index|view|join|group|order|values|constraint"


@query(
    "lint_score",
    rf"""WITH l AS (SELECT doc_id, coalesce(text, '') AS x, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM documents),
c AS (SELECT doc_id, len(list_filter(ls, lambda y: contains(y, chr(9)))) + (length(x) - length(replace(x, '(', '')) <> length(x) - length(replace(x, ')', '')))::INT + ((length(x) - length(replace(x, chr(39), ''))) % 2 <> 0)::INT AS errors,
  len(list_filter(ls, lambda y: length(y) > 120 OR regexp_matches(y, '^\s*,') OR (regexp_matches(y, '\b({_LINT_WORDS})\b') AND regexp_matches(y, '\b({_LINT_WORDS.upper()})\b')))) AS warnings,
  len(list_filter(ls, lambda y: regexp_matches(y, '[ \t]$'))) + len(regexp_extract_all(x, '(\r\n|\r|\n)[ \t]*(\r\n|\r|\n)[ \t]*(\r\n|\r|\n)')) AS notes FROM l)
SELECT *, greatest(0, 100 - 10 * errors - 5 * warnings - notes) AS score, greatest(0, 100 - 10 * errors - 5 * warnings - notes) >= 80 AS passed FROM c""",
)
def lint_score(spark, d):
    return r.lint(table(spark, d, "documents"), "doc_id", "text")


@query(
    "creator_deps",
    f"""WITH s AS (SELECT {_NORM} AS t, operation, source_file, list_resize({_VK.format("version")}, 12, 0) AS v, statement_index FROM operations),
c AS (SELECT t, arg_max(source_file, (v, statement_index)) AS creator FROM s WHERE operation = 'CREATE_TABLE' GROUP BY 1),
u AS (SELECT DISTINCT t, source_file FROM s WHERE operation IN ('ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX'))
SELECT source_file, creator AS depends_on, count(*) AS tables FROM u JOIN c USING (t) WHERE creator <> source_file GROUP BY 1, 2""",
)
def creator_deps(spark, d):
    return r.creator_dependencies(table(spark, d, "operations"))


@query(
    "dependency_issues",
    f"""WITH RECURSIVE s AS (SELECT DISTINCT {_NORM} AS t, operation, source_file, list_resize({_VK.format("version")}, 12, 0) AS v, statement_index FROM operations),
c AS (SELECT t, arg_max(source_file, (v, statement_index)) AS creator FROM s WHERE operation = 'CREATE_TABLE' AND t IS NOT NULL GROUP BY 1),
u AS (SELECT DISTINCT t, source_file FROM s WHERE t IS NOT NULL AND operation IN ('ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX')),
g AS (SELECT DISTINCT creator AS a, source_file AS b FROM u JOIN c USING (t) WHERE creator <> source_file),
r(a, b) AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
SELECT 'UNREFERENCED_OBJECT' AS code, 'error' AS severity, source_file, t AS object FROM u WHERE t NOT IN (SELECT t FROM c)
UNION ALL SELECT 'ISOLATED_MIGRATION', 'warning', source_file, NULL FROM (SELECT DISTINCT source_file FROM operations)
  WHERE source_file NOT IN (SELECT b FROM g) AND source_file NOT IN (SELECT source_file FROM s WHERE operation = 'CREATE_TABLE' AND t IS NOT NULL)
UNION ALL SELECT 'CIRCULAR_DEPENDENCY', 'error', p.a, min(p.b) FROM r p JOIN r q ON q.a = p.b AND q.b = p.a GROUP BY p.a""",
)
def dependency_issues(spark, d):
    return r.dependency_issues(table(spark, d, "operations"))


def _dialect_sql(name: str) -> str:
    length = "regexp_extract(data_type, '(\\(.*\\))', 1)"
    length = f"CASE WHEN base LIKE '%SERIAL' THEN '' ELSE {length} END" if name == "postgres" else length
    return f"SELECT DISTINCT '{name}' AS dialect, data_type, CASE WHEN base = '' THEN data_type ELSE coalesce({_case(types.TYPE_MAPS[name], 'base')}, base) || {length} END AS canonical FROM b"


@query("dialect_types", f"WITH {_C}, b AS (SELECT data_type, regexp_extract(upper(data_type), '^([A-Z][A-Z0-9_]*)', 1) AS base FROM col) " + " UNION ALL ".join(map(_dialect_sql, types.TYPE_MAPS)))
def dialect_types(spark, d):
    from functools import reduce

    c = columns(spark, d).select("data_type").distinct()
    rows = [c.select(F.lit(n).alias("dialect"), "data_type", types.canonical_type(F.col("data_type"), n).alias("canonical")) for n in types.TYPE_MAPS]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("auto_increment", f"WITH {_C} SELECT data_type, count(*) FILTER (WHERE contains(upper(coalesce(default_expr, '')), 'GENERATED')) AS oracle, count(*) FILTER (WHERE contains(upper(data_type), 'SERIAL')) AS postgres FROM col GROUP BY 1")
def auto_increment(spark, d):
    text = F.concat_ws(" ", "data_type", "default_expr")
    return columns(spark, d).groupBy("data_type").agg(*(F.count_if(types.is_auto_increment(text, n)).alias(n) for n in ("oracle", "postgres")))


@query(
    "render_types",
    f"WITH {_C} SELECT table_name, column_name, raw_type || CASE WHEN num_precision IS NULL THEN '' WHEN num_scale IS NULL THEN '(' || num_precision || ')' ELSE '(' || num_precision || ',' || num_scale || ')' END AS rendered FROM col",
)
def render_types(spark, d):
    c = columns(spark, d)
    return c.select("table_name", "column_name", types.render_type(F.col("raw_type"), F.col("num_precision"), F.col("num_scale")).alias("rendered"))


@query(
    "version_parse",
    rf"""WITH f AS (SELECT DISTINCT filename, list_last(string_split(filename, '/')) AS b FROM migration_results),
g AS (SELECT filename, regexp_extract(b, {_FILE}, 1) AS k, regexp_extract(b, {_FILE}, 2) AS v, regexp_extract(b, {_FILE}, 3) AS descr FROM f)
SELECT filename, CASE WHEN k = 'V' AND v <> '' THEN 'versioned' WHEN k = 'U' AND v <> '' THEN 'rollback' WHEN k = 'R' AND v = '' THEN 'repeatable' ELSE 'unknown' END AS kind,
  CASE WHEN v = '' THEN '0' ELSE v END AS version, replace(descr, '_', ' ') AS description,
  list_sum(list_transform(list_filter(string_split(replace(CASE WHEN v = '' THEN '0' ELSE v END, '_', '.'), '.'), lambda p: p <> ''), lambda p, i: p::DOUBLE * pow(1000, 4 - i))) AS ord FROM g""",
)
def version_parse(spark, d):
    p = F.col("filename")
    v = versions.file_version(p)
    rows = table(spark, d, "migration_results").select("filename").distinct()
    return rows.select("filename", versions.file_kind(p).alias("kind"), v.alias("version"), versions.file_description(p).alias("description"), versions.version_order(v).cast("double").alias("ord"))


@query(
    "next_versions",
    r"""SELECT DISTINCT version, CASE WHEN regexp_full_match(version, '[0-9]+([.][0-9]+)*') THEN substring(version, 1, length(version) - length(list_last(string_split(version, '.'))))
  || (list_last(string_split(version, '.'))::BIGINT + 1)::VARCHAR ELSE version || '.1' END AS following FROM migration_results""",
)
def next_versions(spark, d):
    return table(spark, d, "migration_results").select("version", versions.next_version(F.col("version")).alias("following")).distinct()


@query(
    "pr_extract",
    """WITH m AS (SELECT finding_id, CASE finding_id % 4 WHEN 0 THEN 'Merge pull request #' || finding_id || ' from x' WHEN 1 THEN message || ' (PR ' || finding_id || ')' WHEN 2 THEN message ELSE 'merge branch ''pr/' || finding_id || '''' END AS msg FROM (SELECT DISTINCT finding_id, message FROM findings))
SELECT finding_id, CASE WHEN finding_id % 4 <> 2 THEN finding_id::VARCHAR END AS pr FROM m""",
)
def pr_extract(spark, d):
    i = F.col("finding_id").cast("string")
    msg = (
        F.when(F.col("finding_id") % 4 == 0, F.concat(F.lit("Merge pull request #"), i, F.lit(" from x")))
        .when(F.col("finding_id") % 4 == 1, F.concat("message", F.lit(" (PR "), i, F.lit(")")))
        .when(F.col("finding_id") % 4 == 2, F.col("message"))
        .otherwise(F.concat(F.lit("merge branch 'pr/"), i, F.lit("'")))
    )
    return table(spark, d, "findings").select("finding_id", "message").distinct().select("finding_id", versions.pr_number(msg).alias("pr"))


_NODES = f"""n AS (SELECT source_file, min(version) AS version, replace(regexp_extract(list_last(string_split(source_file, '/')), {_FILE}, 3), '_', ' ') AS description,
  list_sort(list_distinct(list({_NORM}) FILTER (WHERE operation = 'CREATE_TABLE'))) AS creates,
  list_sort(list_distinct(list({_NORM}) FILTER (WHERE operation IN ('ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX')))) AS alters FROM operations GROUP BY 1)"""


@query("migration_timeline", f"WITH {_NODES} SELECT source_file, version, description, coalesce(creates, []) AS creates, coalesce(alters, []) AS alters, row_number() OVER (ORDER BY version, source_file) - 1 AS place FROM n")
def migration_timeline(spark, d):
    """Files with what they create and change, in the order of their versions as text."""
    return migrations.timeline(migrations.nodes(table(spark, d, "operations")))


@query(
    "migration_dot",
    f"""WITH {_NODES}, s AS (SELECT {_NORM} AS t, operation, source_file, list_resize({_VK.format("version")}, 12, 0) AS v, statement_index FROM operations),
c AS (SELECT t, arg_max(source_file, (v, statement_index)) AS creator FROM s WHERE operation = 'CREATE_TABLE' GROUP BY 1),
u AS (SELECT DISTINCT t, source_file FROM s WHERE operation IN ('ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX'))
SELECT 0 AS part, source_file, '  "' || source_file || '" [label="' || concat_ws('\\n', version, description) || '", fillcolor=' || CASE WHEN len(creates) > 0 THEN 'lightgreen' WHEN len(alters) > 0 THEN 'lightyellow' ELSE 'lightblue' END || ', style="filled,rounded"];' AS line FROM n
UNION ALL SELECT DISTINCT 1, source_file, '  "' || source_file || '" -> "' || creator || '";' FROM u JOIN c USING (t) WHERE creator <> source_file""",
)
def migration_dot(spark, d):
    """The lines of the graph of files."""
    ops = table(spark, d, "operations")
    return migrations.dot_lines(migrations.nodes(ops), migrations.edges(ops))
