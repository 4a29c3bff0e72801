from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrane.functions import types, versions
from terrane.operators import catalog, diff, render, retrieval, rules
from terrane.streaming import watch

T = (
    "full_name string, name string, schema_name string, constraints array<struct<name:string,type:string,columns:array<string>,ref_table:string,ref_columns:array<string>,"
    "on_delete:string,check_expr:string>>, indexes array<struct<name:string,columns:array<string>,is_unique:boolean,created_in:string>>, table_comment string, created_in string,"
    " modified_in array<string>, column_count int, has_pk boolean, pk_columns array<string>, created_at timestamp, dropped_at timestamp, degree long"
)


def table(name, fks=(), columns=3, pk=("ID",), indexes=(), comment=None, uniques=()):
    cons = [(f"PK_{name}", "primary_key", list(pk), None, [], None, None)] if pk else []
    cons += [(f"FK{i}", "foreign_key", [c], t, ["ID"], None, None) for i, (c, t) in enumerate(fks)]
    cons += [(f"UQ{i}", "unique", list(u), None, [], None, None) for i, u in enumerate(uniques)]
    return (f"S.{name}", name, "S", cons, [(n, list(c), u, "1") for n, c, u in indexes], comment, "1", ["1", "2"], columns, bool(pk), list(pk), None, None, 7)


@pytest.fixture(scope="module")
def tables(spark):
    hub = [table(f"T{i:02}", [("HUB_ID", "S.HUB")]) for i in range(15)]
    rows = [*hub, table("HUB"), table("LONE", columns=30, pk=()), table("BAD", [("X_ID", "S.NOWHERE"), ("ID", "S.HUB")], comment="x", uniques=[("A", "B")])]
    rows[0] = table("T00", [("HUB_ID", "S.HUB")], indexes=[("I1", ["A", "B"], False), ("I2", ["B", "A"], True)])
    return catalog.snapshot(spark.createDataFrame([*rows, rows[0]], T))


def test_lookups(tables):
    assert tables.count() == 18
    assert {r.full_name for r in catalog.orphans(tables).collect()} == {"S.LONE"}
    assert [(r.from_table, r.to_table) for r in catalog.unresolved_fks(tables).collect()] == [("S.BAD", "S.NOWHERE")]
    assert [r.full_name for r in catalog.missing_pk(tables).collect()] == ["S.LONE"]
    assert {r.cardinality for r in catalog.relationships(tables).where("from_table = 'S.BAD' AND name = 'FK1'").collect()} == {"one_to_one"}
    god = catalog.god_tables(tables).collect()
    assert [(r.full_name, r.degree, r.fk_in, r.fk_out) for r in god] == [("S.HUB", 16, 16, 0)]
    both = catalog.references_of(tables, "bad$").collect()
    assert sorted((r.mark, r.far, r.far_columns) for r in both) == [("▶", "S.HUB", 3), ("▶", "S.NOWHERE", None)]
    assert catalog.filter_tables(tables, pattern="^s.t0", is_orphan=False, min_cols=3, has_pk=True).count() == 10
    assert catalog.filter_tables(tables, schema="s", created_in="9").count() == 0


def test_empty_snapshot(tables, spark):
    none = tables.limit(0)
    cols = spark.createDataFrame([], "table_name string, ord int, column_name string, data_type string, raw_type string, nullable boolean, is_pk boolean, is_fk boolean, default_expr string, is_unique boolean")
    for f in (catalog.orphans, catalog.god_tables, catalog.graph_metrics, catalog.cohesion, catalog.surprising_joins, catalog.table_roles, catalog.cross_domain):
        assert f(none).count() == 0
    assert catalog.state_stats(none, cols).first().tables == 0
    assert catalog.insights(none, cols).count() == 0


def test_theta_anti(spark):
    seqs = spark.createDataFrame([("SEQ_USERS",), ("S_US",), ("SQ_USERS_OLD",), ("SEQ_NONE",), ("SEQ_",), (None,)], "sequence string")
    names = spark.createDataFrame([("users",), ("",), (None,)], "name string")
    assert {r.sequence for r in catalog.orphan_sequences(seqs, names).collect()} == {"SEQ_NONE", "SEQ_"}


def test_statement_kinds(spark):
    cases = {
        "create table a as\nselect 1": "CREATE TABLE AS SELECT", "CREATE GLOBAL TEMPORARY TABLE a (b INT)": "CREATE TABLE", "create unique index i on t(a)": "CREATE INDEX",
        "CREATE INDEX CONCURRENTLY i ON t(a)": "CREATE INDEX CONCURRENTLY", "DROP TABLE t;": "DROP TABLE", "alter table t add (a int not null)": "ADD COLUMN NOT NULL",
        "alter table t add (a int default 0 not null)": "ADD COLUMN", "alter table t add constraint c check (a > 0)": "ADD CONSTRAINT", "alter table t drop column a": "DROP COLUMN",
        "alter table t drop constraint c": "DROP CONSTRAINT", "alter table t modify (a int)": "MODIFY COLUMN", "ALTER TABLE t RENAME COLUMN a TO b": "RENAME",
        "insert into t select * from u": "INSERT ... SELECT", "insert into t values (1)": "INSERT", "delete from t": "DELETE (no where)", "delete /* x */ from t where a = 1 -- y": "DELETE (where)",
        "update t set a = 1": "UPDATE (no where)", "truncate table t": "TRUNCATE", "merge into t using u on (1=1)": "MERGE", "comment on table t is 'x'": "COMMENT",
        "create or replace view v as select 1": "CREATE PROC/VIEW", "grant x to y": "UNCLASSIFIED", "": "UNCLASSIFIED", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", rules.statement_kind(F.col("s")).alias("k"))
    assert {r.s: r.k for r in df.collect()} == cases


def kinds(spark, files):
    rows = [(f, i, s, "1", None, i) for f, ss in files.items() for i, s in enumerate(ss)]
    return rules.with_kinds(spark.createDataFrame(rows, "source_file string, statement_index int, raw_sql string, version string, arrived_at timestamp, op_id long"))


def test_statement_findings(spark):
    trigger = "CREATE TRIGGER x BEFORE INSERT ON t BEGIN IF a THEN b; END IF; " + "c := 1; " * 80 + "END;"
    k = kinds(spark, {"f": ["ALTER TABLE t ADD (a INT NOT NULL)", "CREATE OR REPLACE VIEW v AS SELECT * FROM t", trigger, "DELETE FROM t", "CREATE VIEW w AS SELECT a FROM t"]})
    got = [(r.statement_index, r.code) for r in rules.statement_findings(k).orderBy("statement_index").collect()]
    assert got == [(0, "ADD_NOT_NULL_NO_DEFAULT"), (1, "SELECT_STAR_VIEW"), (2, "TRIGGER_WITH_BUSINESS_LOGIC"), (3, "LARGE_DELETE_NO_WHERE")]


def test_scores(spark):
    k = kinds(spark, {"create": ["CREATE TABLE t (a INT)"], "drop": ["DROP TABLE t", "COMMENT ON TABLE t IS 'x'"], "view": ["CREATE VIEW v AS SELECT 1"], "notnull": ["ALTER TABLE t ADD (a INT NOT NULL)"] * 2})
    cost = {r.source_file: (r.score, r.grade) for r in rules.cost(k).collect()}
    assert cost == {"create": (20, "low"), "drop": (20, "low"), "view": (5, "low"), "notnull": (100, "critical")}
    assert {r.source_file: r.score for r in rules.cost(k, "plsql").collect()}["view"] == 1
    back = {r.source_file: (r.feasibility, r.score) for r in rules.rollback(k).collect()}
    assert back == {"create": ("partial", 90), "drop": ("irreversible", 0), "view": ("reversible", 95), "notnull": ("partial", 70)}
    safe = {r.source_file: (r.level, r.needs_approval) for r in rules.safety(k).collect()}
    assert safe["drop"] == ("DANGEROUS", True) and safe["view"] == ("SAFE", False)
    cls = {r.source_file: (r.primary, r.secondary, r.risk) for r in rules.classify(k).collect()}
    assert cls["drop"] == ("cleanup", "mixed", "high") and cls["view"] == ("view_trigger_procedure", "", "medium")
    assert rules.cost(k.limit(0)).count() == 0


def test_pii(spark):
    names = ["EMAIL", "PHONE_NUMBER", "FIRST_NAME", "SSN", "AMOUNT", None]
    df = spark.createDataFrame([("T", n) for n in names], "table_name string, column_name string")
    got = {r.column_name: (r.category, float(r.confidence)) for r in rules.pii(df, {"money": ("amount",)}).collect()}
    assert got == {"EMAIL": ("email", 1.0), "PHONE_NUMBER": ("phone", 1.0), "FIRST_NAME": ("name", 1.0), "SSN": ("ssn", 1.0), "AMOUNT": ("money", 1.0)}


def test_types_and_versions(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(types.canonical_type(F.lit("NUMBER(10,2)"), "oracle")) == "NUMERIC(10,2)"
    assert show(types.canonical_type(F.lit("BIGSERIAL"), "postgresql")) == "BIGINT"
    assert show(types.canonical_type(F.lit("(x)"), "mysql")) == "(x)"
    with pytest.raises(ValueError):
        types.canonical_type(F.lit("x"), "db9")
    assert show(types.is_auto_increment(F.lit("id INTEGER PRIMARY KEY"), "sqlite")) is False
    assert float(show(versions.version_order(F.lit("1.2.3")))) == 1_002_003_000
    assert float(show(versions.version_order(F.lit("20240101120000")))) == 20240101120000 * 1e9
    assert [show(versions.next_version(F.lit(v))) for v in ("3", "1.9", "1_2")] == ["4", "1.10", "1_2.1"]
    assert str(show(versions.version_instant(F.lit("20240229120000")))) == "2024-02-29 12:00:00" and show(versions.version_instant(F.lit("1.2"))) is None
    kinds = {"V1__a.sql": "versioned", "U2.1__b.sql": "rollback", "R__c.sql": "repeatable", "x.sql": "unknown", "V__a.sql": "unknown"}
    df = spark.createDataFrame([(k,) for k in kinds], "f string").select("f", versions.file_kind(F.col("f")).alias("k"))
    assert {r.f: r.k for r in df.collect()} == kinds


def test_diff_and_integrity(spark):
    schema = "table_name string, column_name string, data_type string, nullable boolean, default_expr string, is_pk boolean, is_unique boolean, column_comment string, a_x int"
    a = spark.createDataFrame([("T", "A", "INT", True, None, False, False, None, 1), ("T", "B", "INT", True, "", False, False, None, 1), (None, "C", "INT", True, None, False, False, None, 1)], schema)
    b = spark.createDataFrame([("T", "A", "INT", False, "0", False, False, "c", 1), ("T", "D", "INT", True, None, False, False, None, 1), (None, "C", "INT", True, None, False, False, None, 1)], schema)
    got = {(r.table_name, r.column_name): (r.change, r.diffs, r.breaking) for r in diff.column_changes(a, b).collect()}
    assert got == {
        ("T", "A"): ("modified", "nullable: True→False; default: None→0; comment: None→c", True), ("T", "B"): ("removed", "", True), ("T", "D"): ("added", "", False),
    }
    ta = spark.createDataFrame([("T", None), ("GONE", None)], "full_name string, table_comment string")
    tb = spark.createDataFrame([("T", None), ("NEW", None)], "full_name string, table_comment string")
    drifts = diff.drift(ta, a, tb, b)
    assert {(r.category, r.severity) for r in drifts.collect()} == {("missing_table", "error"), ("extra_table", "warning"), ("missing_column", "error"), ("extra_column", "warning"), ("nullability", "warning")}
    script = diff.repair_script(drifts)
    assert script.index("missing_column") < script.index("extra_column") and "ALTER TABLE T ADD (B INT);" in script
    crlf = spark.createDataFrame([("f", "a\r\nb"), ("g", None)], "p string, t string")
    lf = spark.createDataFrame([("f", "a\nb"), ("g", "x"), ("h", "")], "p string, t string")
    assert {r.filename: r.status for r in diff.integrity(diff.manifest(crlf, "p", "t"), diff.manifest(lf, "p", "t")).collect()} == {"f": "clean", "g": "modified", "h": "new"}


def test_schema_texts_name_all(spark):
    n = 50_001  # tables and keys; more than 50,000 were refused
    cons = "array(struct('F' AS name, 'foreign_key' AS type, array('HUB_ID') AS columns, 'S.T000000' AS ref_table, array('ID') AS ref_columns, CAST(NULL AS string) AS on_delete, CAST(NULL AS string) AS check_expr))"
    t = spark.range(n).selectExpr("concat('S.T', lpad(id, 6, '0')) AS full_name", "'S' AS schema_name", "array('ID') AS pk_columns", f"{cons} AS constraints")
    seqs = spark.createDataFrame([("Q2",), ("Q1",), (None,)], "sequence string")
    got = {r.chunk_id: r.content for r in retrieval.schema_chunks(t, spark.range(3), catalog.relationships(t), seqs).collect()}
    names = [f"S.T{i:06}" for i in range(n)]
    role = lambda x: f"junction/child entity (referenced by {n}, references 1)" if x == names[0] else "leaf/detail entity (referenced by 0, references 1)"
    into = "".join(f"\n  ◀──FK── {x} via HUB_ID" for x in names)
    summary = "\n".join([
        "SCHEMA SUMMARY", "DB Schemas: S", f"Tables: {n} ({', '.join(names)})", "Sequences: 2 (Q1, Q2)", "Total columns: 3", f"FK relationships: {n}",
        "", "RELATIONSHIP MAP:", *(f"  {x}.HUB_ID → S.T000000.ID" for x in names), "", "TABLE ROLES:", *(f"  {x}: {role(x)}" for x in names),
    ])
    graph = "RELATIONSHIP GRAPH (adjacency list)\n\n" + "\n".join(f"{x}:\n  ──FK──▶ S.T000000 via HUB_ID{into if x == names[0] else ''}" for x in names)
    same = got == {"schema:summary": summary, "schema:relationships": graph}
    assert same  # without the texts, which are long


def test_retrieval(spark):
    rows = [("a", "orders of people", "hint", "customers place orders", None), ("b", "people", None, "nobody here", None), ("b", "people", None, "nobody here", None), (None, "orders", "x", "y", None), ("c", None, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, title string, hint string, content string, built_at timestamp")
    got = retrieval.bm25(df, "Which orders of the customers?", 5).collect()
    assert [r.chunk_id for r in got] == ["a"]
    assert retrieval.bm25(df, "the of", 5).count() == 0 and retrieval.bm25(df.limit(0), "orders", 5).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.cosine_top(v, [1.0, 0.0], 2).collect()] == [5, 1]
    near = retrieval.cosine_search(v, v.where("vec_id IN (1, 2)"), 2, block=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in near) == [(1, 1, 5), (1, 2, 1), (2, 1, 2), (2, 2, 5)]
    assert "[1] orders of people" in retrieval.prompt("?", retrieval.bm25(df, "orders", 1), df)


def test_render(spark):
    df = spark.createDataFrame([('a "b"', None, 3)], "x string, y string, z int")
    assert df.select(render.csv_line("x", "y", "z").alias("l")).first().l == '"a ""b""","","3"'
    assert df.select(render.json_line("x", "y", "z").alias("l")).first().l == '{"x":"a \\"b\\"","y":null,"z":3}'
    assert df.select(render.html_escape(F.lit("<a & 'b'>")).alias("l")).first().l == "&lt;a &amp; &#x27;b&#x27;&gt;"


def test_watch(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "V1__a.sql").write_text("CREATE TABLE a (b INT);")

    def react(rows, batch):
        seen.append(sorted(r.sql for r in rows.collect()))

    for _ in range(2):
        watch.watch_files(spark, str(folder), react, str(tmp_path / "cp")).awaitTermination(60)
    (folder / "V2__b.sql").write_text("DROP TABLE a;")
    watch.watch_files(spark, str(folder), react, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [["CREATE TABLE a (b INT);"], ["DROP TABLE a;"]]
    with pytest.raises(watch.Shrunk):
        watch.check_shrink(10, 7)
    watch.check_shrink(10, 8)
    watch.check_shrink(10, 1, force=True)


def test_streamed_fold_equals_batch(spark, tmp_path):
    from tests.test_changefeed import SCHEMA, feed, fold, state

    from terrane.operators import changefeed

    rows = feed(21)
    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch.fold_changes(spark, stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    # Deliveries of one statement that come in several batches agree but for their spelling.
    assert state(changefeed.read_state(spark, str(tmp_path / "state"))) == fold(rows)


def test_debounce_on_a_stream(spark, tmp_path):
    df = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS ts FROM VALUES (0), (1), (2), (9), (11) t(s)")
    assert sorted(r.events for r in watch.debounced(df, "k", "ts", "2 seconds").collect()) == [2, 3]
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = watch.debounced(s, "k", "ts", "2 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("bursts").count() >= 1


def test_orphan_sequences_match_tables_of_any_width(spark, monkeypatch):
    from terrane.plans import catalog as plans

    state = spark.createDataFrame([("A.SLIM", "SLIM", 2), ("A.WIDE", "WIDE", 9)], "full_name string, name string, column_count int")
    part = spark.createDataFrame([("Brand#12",), ("wide",), ("slim",)], "p_brand string")
    monkeypatch.setattr(plans, "table", lambda s, d, n: {"tables_state": state, "part": part}[n])
    assert [r.sequence for r in plans.theta_prefix_anti(spark, "").collect()] == ["S_BRAND#12"]
