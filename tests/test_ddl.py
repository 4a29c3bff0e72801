from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.ddl import extract, fold
from terrane.ddl.tokens import statements, text_of, tokens
from terrane.operators import catalog
from terrane.sources import migrations

V1 = """
-- people; and things
CREATE TABLE shop.people (
  id NUMBER(10) NOT NULL, mail VARCHAR2(200) NOT NULL, state VARCHAR2(10) DEFAULT 'new; open' NOT NULL, born DATE, rate NUMBER(12, 2),
  CONSTRAINT pk_people PRIMARY KEY (id), CONSTRAINT uq_people_mail UNIQUE (mail), CONSTRAINT ck_state CHECK (state IN ('new; open', 'done'))
);
CREATE TABLE "SHOP"."GOODS" (id NUMBER(10) PRIMARY KEY, title VARCHAR2(100), price NUMBER(10,2) CHECK (price > 0), a INT, b INT, c CLOB);
CREATE SEQUENCE shop.seq_people;
CREATE SEQUENCE shop.seq_goods START WITH 50 INCREMENT BY 5;
COMMENT ON TABLE shop.people IS 'those who''ve bought';
COMMENT ON COLUMN shop.people.mail IS 'where to write';
"""
V2 = """
CREATE TABLE shop.orders (id NUMBER(10), person_id NUMBER(10) NOT NULL, placed TIMESTAMP, CONSTRAINT pk_orders PRIMARY KEY (id),
  CONSTRAINT fk_orders_people FOREIGN KEY (person_id) REFERENCES shop.people (id) ON DELETE CASCADE);
CREATE TABLE shop.lines (id NUMBER(10) PRIMARY KEY, order_id NUMBER(10) REFERENCES shop.orders(id) ON DELETE SET NULL, good_id NUMBER(10),
  CONSTRAINT fk_lines_goods FOREIGN KEY (good_id) REFERENCES shop.goods(id));
CREATE INDEX shop.ix_orders_person ON shop.orders (person_id DESC);
CREATE UNIQUE INDEX ix_lines ON shop.lines (order_id, good_id ASC);
CREATE INDEX ix_gone ON shop.lines (good_id);
"""
V3 = """
ALTER TABLE shop.people ADD (nick VARCHAR2(40) DEFAULT 'x' NOT NULL, seen TIMESTAMP);
ALTER TABLE shop.people ADD nick DATE;
ALTER TABLE shop.goods ADD CONSTRAINT uq_title UNIQUE (title);
ALTER TABLE shop.people MODIFY (rate NUMBER(14,4), born NULL);
ALTER TABLE shop.people RENAME COLUMN mail TO e_mail;
ALTER TABLE shop.people DROP COLUMN born;
DROP INDEX ix_gone;
DROP SEQUENCE shop.seq_people;
ALTER TABLE shop.lines RENAME TO order_lines;
CREATE TABLE IF NOT EXISTS shop.goods (other INT);
CREATE OR REPLACE PROCEDURE p IS
BEGIN
  DELETE FROM x;
  UPDATE y SET z = 1;
END;
/
ALTER TABLE shop.order_lines ADD note CLOB;
INSERT INTO shop.goods SELECT * FROM old_goods;
ALTER TABLE shop.nowhere ADD x INT;
"""
FILES = [("db/V1__first.sql", V1), ("db/V2__orders.sql", V2), ("db/V3__more.sql", V3), ("db/U3__undo.sql", "DROP TABLE shop.people;"), ("db/V3__more.sql", V3)]


@pytest.fixture(scope="module")
def ops(spark):
    return extract.migration_ops(spark.createDataFrame(FILES, "filename string, sql string")).cache()


@pytest.fixture(scope="module")
def state(ops):
    return {r.full_name: r for r in fold.snapshot(ops).collect()}


def test_tables(state):
    assert sorted(state) == ["SHOP.GOODS", "SHOP.ORDERS", "SHOP.ORDER_LINES", "SHOP.PEOPLE"]
    people = state["SHOP.PEOPLE"]
    assert [(c.name, c.data_type, c.nullable) for c in people.columns] == [
        ("ID", "NUMBER(10)", False), ("E_MAIL", "VARCHAR2(200)", False), ("STATE", "VARCHAR2(10)", False), ("RATE", "NUMBER(14,4)", True),
        ("NICK", "VARCHAR2(40)", False), ("SEEN", "TIMESTAMP", True),
    ]
    assert people.columns[2].default_expr == "'new; open'" and people.table_comment == "those who've bought" and people.columns[1].comment == "where to write"
    assert [(k.name, k.type, list(k.columns)) for k in people.constraints] == [
        ("PK_PEOPLE", "primary_key", ["ID"]), ("UQ_PEOPLE_MAIL", "unique", ["E_MAIL"]), ("CK_STATE", "check", []),
    ]
    assert people.constraints[2].check_expr == "state IN ('new; open', 'done')"
    assert people.created_in == "1" and list(people.modified_in) == ["3"] and people.has_pk


def test_keys_indexes_and_renames(state):
    lines = state["SHOP.ORDER_LINES"]
    assert [(i.name, list(i.columns), i.is_unique) for i in lines.indexes] == [("IX_LINES", ["ORDER_ID", "GOOD_ID"], True)]
    assert [(i.name, list(i.columns)) for i in state["SHOP.ORDERS"].indexes] == [("IX_ORDERS_PERSON", ["PERSON_ID"])]
    fks = [(k.name, list(k.columns), k.ref_table, k.on_delete) for t in state.values() for k in t.constraints if k.type == "foreign_key"]
    assert sorted(fks, key=str) == sorted([
        ("FK_ORDERS_PEOPLE", ["PERSON_ID"], "SHOP.PEOPLE", "CASCADE"), (None, ["ORDER_ID"], "SHOP.ORDERS", "SET_NULL"), ("FK_LINES_GOODS", ["GOOD_ID"], "SHOP.GOODS", None),
    ], key=str)
    assert "NOTE" in [c.name for c in lines.columns] and len(state["SHOP.GOODS"].columns) == 6
    assert [k.name for k in state["SHOP.GOODS"].constraints] == ["PK_GOODS", "UQ_TITLE"]


def test_sequences_and_other_statements(ops):
    assert [tuple(r) for r in fold.sequences(ops).collect()] == [("SHOP.SEQ_GOODS", 50, 5, "1")]
    kinds = {r.operation: r["count"] for r in ops.groupBy("operation").count().collect()}
    assert kinds["CREATE_PROCEDURE"] == 1 and kinds["INSERT"] == 1 and "UPDATE" not in kinds and "DELETE" not in kinds


def test_snapshot_feeds_the_catalog(spark, ops):
    t = fold.snapshot(ops)
    c = fold.column_state(t)
    assert {r.full_name: r.role for r in catalog.table_roles(t).collect()} == {
        "SHOP.PEOPLE": "root", "SHOP.GOODS": "root", "SHOP.ORDERS": "junction", "SHOP.ORDER_LINES": "leaf",
    }
    row = c.where("table_name = 'SHOP.PEOPLE' AND column_name = 'RATE'").first()
    assert (row.raw_type, row.num_precision, row.num_scale, row.is_pk) == ("NUMBER", 14, 4, False)
    codes = {r.code for r in catalog.insights(t, c).collect()}
    assert {"NULLABLE_FK", "NO_INDEXES", "EMPTY_TABLE_COMMENT"} <= codes and "NO_PK" not in codes


def test_point_in_time(spark):
    df = spark.createDataFrame(FILES[:2], "filename string, sql string")
    assert fold.snapshot(extract.migration_ops(df)).count() == 4
    assert fold.snapshot(extract.migration_ops(df.limit(0))).count() == 0
    assert fold.snapshot(extract.migration_ops(spark.createDataFrame([("V1__x.sql", None), ("V2__y.sql", "")], "filename string, sql string"))).count() == 0


def test_recreated_table(spark):
    files = [("V1__a.sql", "CREATE TABLE t (a INT); CREATE TABLE t (b INT)"), ("V2__b.sql", "DROP TABLE t; CREATE TABLE t (c INT); ALTER TABLE t ADD (d INT, a INT)")]
    (t,) = fold.snapshot(extract.migration_ops(spark.createDataFrame(files, "filename string, sql string"))).collect()
    assert [c.name for c in t.columns] == ["C", "D", "A"] and t.created_in == "2"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab;'\"-/*() \n`1.", max_size=60))
def test_tokens_cover_the_text(sql):
    spans = [(t.start, t.stop) for t in tokens(sql)]
    assert spans == sorted(spans) and all(sql[a:b] for a, b in spans)
    for own in statements(sql):
        assert text_of(sql, own) in sql


def test_very_long_script():
    sql = "INSERT INTO t VALUES ('" + "x''y;" * 200_000 + "');\n" * 1 + "CREATE TABLE a (b INT);" * 5_000
    assert len(statements(sql)) == 5_001


def test_sources(spark, tmp_path):
    for name, sql in FILES:
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(sql)
    (tmp_path / "top.sql").write_text("SELECT 1")
    got = migrations.sql_files(spark, str(tmp_path))
    assert sorted(r.filename for r in got.collect()) == ["db/U3__undo.sql", "db/V1__first.sql", "db/V2__orders.sql", "db/V3__more.sql", "top.sql"]
    assert migrations.sql_files(spark, str(tmp_path), recursive=False).count() == 1
    cached = migrations.content_key(got).where("filename = 'top.sql'")
    assert migrations.uncached(got, cached).count() == 4
    (tmp_path / "m.json").write_text('[{"filename": "V1__x.sql", "sql": "SELECT 1"}, {"sql": "x"}]')
    assert migrations.json_files(spark, str(tmp_path / "m.json")).count() == 1
