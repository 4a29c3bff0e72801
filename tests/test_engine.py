from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F
from tests.test_ddl import FILES

from terrane import config, sinks
from terrane.ddl import lineage
from terrane.ddl.tokens import statements
from terrane.engine import Schema
from terrane.operators import graph, retrieval, rules
from terrane.sources import git, migrations
from terrane.streaming import watch


@pytest.fixture(scope="module")
def schema(spark):
    return Schema(spark.createDataFrame(FILES, "filename string, sql string"))


def test_queries(schema):
    assert {r.full_name for r in schema.query("tables", pattern="order").collect()} == {"SHOP.ORDERS", "SHOP.ORDER_LINES"}
    assert {(r.node, r.depth, r.action) for r in schema.query("impact", start="SHOP.PEOPLE").collect()} == {("SHOP.ORDERS", 1, "CASCADE DELETE"), ("SHOP.ORDER_LINES", 2, "SET NULL")}
    assert [r.node for r in schema.query("fk-path", start="SHOP.GOODS", end="SHOP.PEOPLE").orderBy("step").collect()] == ["SHOP.GOODS", "SHOP.ORDER_LINES", "SHOP.ORDERS", "SHOP.PEOPLE"]
    assert schema.query("islands").count() == 1
    with pytest.raises(ValueError):
        schema.query("nothing")


def test_point_in_time_diff_and_simulation(schema):
    old = schema.at("2")
    assert {r.full_name for r in old.tables.collect()} == {"SHOP.PEOPLE", "SHOP.GOODS", "SHOP.ORDERS", "SHOP.LINES"}
    tables, columns = old.diff(schema)
    assert {(r.full_name, r.change) for r in tables.collect()} == {("SHOP.LINES", "removed"), ("SHOP.ORDER_LINES", "added"), ("SHOP.PEOPLE", "modified"), ("SHOP.GOODS", "modified")}
    assert ("SHOP.PEOPLE", "BORN", "removed") in {(r.table_name, r.column_name, r.change) for r in columns.collect()}
    after = schema.simulate("ALTER TABLE shop.people DROP COLUMN nick; DROP TABLE shop.goods;")
    tables, columns = schema.diff(after)
    assert {(r.full_name, r.change, r.breaking) for r in tables.collect()} == {("SHOP.GOODS", "removed", True), ("SHOP.PEOPLE", "modified", True)}
    assert schema.drift(after).where("category = 'missing_column'").count() == 1
    assert rules.rollback(after.kinds).where("source_file LIKE '%simulated%'").first().feasibility == "irreversible"


def test_ask(schema):
    text = schema.ask("Where is the nick of people?", 1)
    assert "SHOP.PEOPLE" in text and text.endswith("Question: Where is the nick of people?\n")


def test_renderings(schema):
    t, c = schema.tables, schema.columns
    assert "SHOP_ORDERS -> SHOP_PEOPLE" in sinks.dot(t) and "SHOP_ORDERS }o--|| SHOP_PEOPLE" in sinks.mermaid(t, c)
    assert len(json.loads(sinks.excalidraw(t))["elements"]) == 4 * 2 + 3 and sinks.drawio(t).count("edge=") == 3
    assert "<h2>SHOP.GOODS</h2>" in sinks.html(t, c, schema.query("insights"))
    groups = schema.query("domains")
    assert {n["id"] for n in json.loads(sinks.graph_json(t, groups))["nodes"]} >= {"SHOP.GOODS"}
    assert "- tables: 4" in sinks.report(t, c, groups)
    body = json.loads(sinks.snapshot_json(t, c, "3"))
    assert body["stats"]["tables"] == 4 and {x["fullName"] for x in body["tables"]} >= {"SHOP.PEOPLE"}
    text = sinks.contract(schema.query("stats"), "stats")
    sinks.assert_contract(schema.query("stats"), text)
    with pytest.raises(ValueError):
        sinks.assert_contract(t, text)


def test_summary_and_settings(schema, tmp_path):
    assert "SHOP.ORDERS (3) -> SHOP.PEOPLE <- SHOP.ORDER_LINES" in sinks.summary(schema.tables).splitlines()
    (tmp_path / config.FILE).write_text('dialect = "mysql"\nquestion_chunks = 3\n')
    got = config.Settings.load({"TERRANE_QUESTION_CHUNKS": "9"}, (tmp_path / "none", tmp_path))
    assert (got.dialect, got.question_chunks, got.cost_profile) == ("mysql", 9, "default")
    assert config.Settings.load({}, ()).dialect == "oracle"
    assert [config.parse_bool(x) for x in ("1", "TRUE", " yes", "no", "")] == [True, True, True, False, False]


def test_lineage(spark):
    sql = """CREATE OR REPLACE VIEW app.v (person, total) AS SELECT u.name, SUM(o.price * o.n) AS s FROM app.users u LEFT JOIN orders o ON o.uid = u.id WHERE u.x = 1;
    CREATE TABLE t2 AS SELECT DISTINCT id, upper(nick) big FROM app.users; CREATE TABLE plain (a INT); CREATE VIEW w AS SELECT * FROM t2;"""
    got = {e for own in statements(sql) for e in lineage.view_lineage(own)}
    assert got == {
        ("APP.USERS.NAME", "APP.V.PERSON"), ("ORDERS.PRICE", "APP.V.TOTAL"), ("ORDERS.N", "APP.V.TOTAL"), ("APP.USERS.ID", "T2.ID"), ("APP.USERS.NICK", "T2.BIG"),
        ("T2.*", "W.COLUMN_1"),
    }
    df = lineage.lineage(spark.createDataFrame([("a.sql", sql), ("b.sql", None)], "filename string, sql string"))
    assert df.count() == len(got)


def test_manifest_and_cache(spark, tmp_path):
    known = spark.createDataFrame([("a", "1", "t0", "t0"), ("b", "2", "t0", "t0"), ("c", "3", "t0", "t0")], "filename string, hash string, first_seen string, last_modified string")
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "filename string, hash string")
    got = {tuple(r) for r in sinks.update_manifest(known, now, "t1").collect()}
    assert got == {("a", "1", "t0", "t0"), ("b", "9", "t0", "t1"), ("d", "4", "t1", "t1")}
    cache = sinks.ChunkCache(spark, str(tmp_path / "cache"))
    assert cache.get("x") is None
    for i in range(4):
        cache.put(f"f{i}", spark.range(i + 1), f"2024-0{i + 1}")
    assert cache.get("f2").count() == 3 and cache.collect_garbage(2) == 2
    assert cache.get("f0") is None and cache.get("f3").count() == 4


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "V1__a.sql").write_text("x")
    run("add", ".")
    run("commit", "-qm", "Merge pull request #42 from y")
    (tmp_path / "V2__b.sql").write_text("y")
    p = git.provenance(spark, str(tmp_path))
    assert {(r.filename, r.author, r.pr) for r in p.collect()} == {("V1__a.sql", "n", "42"), ("V2__b.sql", None, None)}
    run("add", ".")
    assert [r.filename for r in git.changed_files(spark, str(tmp_path), staged=True).collect()] == ["V2__b.sql"]
    later = p.withColumn("commit", F.lit("z")).where("filename <> 'V2__b.sql'")
    assert {(r.filename, r.status) for r in git.verify(p, later).collect()} == {("V1__a.sql", "commit_changed"), ("V2__b.sql", "missing_in_current")}


def test_build_writes_everything(schema, tmp_path):
    paths = schema.build(str(tmp_path / "out"))
    assert len(paths) == len(set(paths)) >= 20
    page = (tmp_path / "out" / "graph.html").read_text()
    assert "SHOP.GOODS" in page and page.count("</script>") == 1
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["stats"]["tables"] == 4 and set(manifest["fingerprints"]) == {"SHOP"}
    assert '"SHOP.GOODS"' in (tmp_path / "out" / "snapshot.yaml").read_text()
    graph = json.loads((tmp_path / "out" / "migrations.json").read_text())
    assert graph["stats"]["migration_count"] == len(graph["nodes"]) > 1
    assert "Longest chain" in (tmp_path / "out" / "dependencies.txt").read_text() and "migrations," in (tmp_path / "out" / "timeline.txt").read_text()
    back = migrations.dump(schema.files.sparkSession, str(tmp_path / "out" / "snapshot.json"))
    assert {r.full_name for r in back.collect()} == {r.full_name for r in schema.tables.collect()}
    with pytest.raises(ValueError):
        sinks.export(schema.tables, schema.columns, str(tmp_path), "png")


def test_simulation_report(schema):
    r = schema.simulation("ALTER TABLE shop.goods ADD (extra INT);")
    assert r["success"] and r["rollback"] == "partial" and r["rollback_script"] == "ALTER TABLE SHOP.GOODS DROP COLUMN EXTRA;"
    assert {(x["table_name"], x["column_name"], x["change"]) for x in r["columns"]} == {("SHOP.GOODS", "EXTRA", "added")}
    text = schema.simulation_text("DROP TABLE shop.goods; SOMETHING ELSE;", 1)
    assert "Success: False" in text and "Rollback: irreversible" in text and "more" in text


def test_impact_of_changed_files(schema, spark):
    files = schema.files.where("sql LIKE '%goods%' OR sql LIKE '%GOODS%'").select("filename")
    starts = schema.changed_tables(files)
    assert "SHOP.GOODS" in {r.node for r in starts.collect()}
    found = schema.impact_of(spark.createDataFrame([("SHOP.PEOPLE",)], "node string"))
    rows = {r.node: r for r in found.collect()}
    assert rows["SHOP.ORDERS"].kind == "direct" and rows["SHOP.ORDER_LINES"].kind == "transitive" and rows["SHOP.ORDERS"].type == "table"
    paths = {r.node: r.path for r in graph.impact_paths(found).collect()}
    assert paths["SHOP.ORDER_LINES"] == ["SHOP.PEOPLE", "SHOP.ORDERS", "SHOP.ORDER_LINES"]
    with pytest.raises(ValueError):
        schema.impact_of(starts, direction="up")


def test_lineage_renderings(spark):
    links = spark.createDataFrame([("a.x", "b.x"), ("b.x", "c.x"), ("q.x", "r.x")], "src string, dst string")
    assert sinks.lineage_text(links, "a.x").splitlines() == ["a.x", "  b.x (from a.x)", "    c.x (from b.x)"]
    assert sinks.lineage_mermaid(links, "a.x", 1).splitlines() == ["flowchart LR", '    a_x["a.x"] --> b_x["b.x"]']
    assert [c["node"] for c in json.loads(sinks.lineage_json(links, "a.x"))["columns"]] == ["a.x", "b.x", "c.x"]


def test_contracts(schema):
    held = sinks.Contracts()
    for version, old in (("1", False), ("2", False), ("3", True)):
        held.add("stats", version, schema.query("stats").schema, "stats", old)
    assert held.latest("stats")["version"] == "2" and held.latest("none") is None and len(held.of_command("stats")) == 3 and held.get("stats", "3")["deprecated"]


def test_one_build_at_a_time(spark, tmp_path):
    lock = str(tmp_path / "lock")
    with watch.BuildLock(lock), pytest.raises(watch.Busy), watch.BuildLock(lock):
        pass
    (tmp_path / "lock").write_text("999999999")  # of a process that is gone
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "V1__a.sql").write_text("CREATE TABLE a (x INT); CREATE TABLE b (x INT);")
    seen = []
    watch.watch_schema(spark, str(tmp_path / "sql"), lambda s: seen.append(s.tables.count()), str(tmp_path / "check"), lock).awaitTermination()
    assert seen == [2] and not (tmp_path / "lock").exists()


def test_retriever_by_vectors_or_words(schema):
    chunks = schema.chunks().selectExpr("chunk_id", "chunk_id AS title", "'' AS hint", "content", "CAST(NULL AS TIMESTAMP) AS built_at")
    embed = lambda texts: [[float(t.count("NICK")), float(t.count("PRICE")), 1.0] for t in texts]
    vectors = retrieval.embed_chunks(chunks, embed, batch=2)
    by_vector = retrieval.make_retriever(chunks, embed, vectors)("NICK NICK NICK NICK", 3)
    assert "table:SHOP.PEOPLE" in {r.chunk_id for r in by_vector.collect()}
    assert retrieval.make_retriever(chunks)("nick of people", 1).first().chunk_id in {r.chunk_id for r in chunks.collect()}
    assert {"schema:summary", "schema:relationships"} <= {r.chunk_id for r in chunks.collect()}
