"""Queries through the whole DDL front end: texts to operations to snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.ddl import fold
from terrane.engine import Schema
from terrane.functions.names import version_key
from terrane.plans.problems import P5_SQL
from terrane.plans.registry import query, table
from terrane.plans.rules import _statement_ops

# Migrations of a small schema, and below what they leave.
MIGRATIONS = [
    ("V1__base.sql", """CREATE TABLE shop.customer (id NUMBER(12) PRIMARY KEY, email VARCHAR2(200) NOT NULL, "Since" DATE DEFAULT SYSDATE);
CREATE TABLE shop.orders (order_id NUMBER(12) NOT NULL, customer_id NUMBER(12), note VARCHAR2(10) DEFAULT ';', CONSTRAINT pk_orders PRIMARY KEY (order_id),
  CONSTRAINT fk_orders_customer FOREIGN KEY (customer_id) REFERENCES shop.customer (id) ON DELETE CASCADE);"""),
    ("V2__more.sql", "ALTER TABLE shop.orders ADD (total NUMBER(12,2) DEFAULT 0 NOT NULL);\nCREATE INDEX ix_orders_customer ON shop.orders (customer_id);\nCREATE SEQUENCE seq_orders START WITH 100 INCREMENT BY 5;"),
    ("V3__change.sql", "ALTER TABLE shop.orders MODIFY (note CLOB);\nALTER TABLE shop.customer RENAME COLUMN email TO mail;\nCOMMENT ON TABLE shop.customer IS 'who buys; and where';\nCOMMENT ON COLUMN shop.customer.mail IS 'it''s unique';"),
    ("V10__later.sql", "CREATE TABLE IF NOT EXISTS shop.customer (other INT);\nALTER TABLE shop.customer ADD CONSTRAINT uq_mail UNIQUE (mail);\nALTER TABLE shop.customer DROP COLUMN \"Since\";\nRENAME orders_old TO nothing;"),
    ("V4__gone.sql", "CREATE TABLE shop.tmp (a INT); -- for a while\nDROP TABLE shop.tmp;\nCREATE UNIQUE INDEX ix_gone ON shop.orders (note);\nDROP INDEX ix_gone;"),
    ("V5__rename.sql", "ALTER TABLE shop.orders RENAME TO sales;\nALTER TABLE shop.sales ADD COLUMN paid DATE NULL"),
    ("U5__undo.sql", "DROP TABLE shop.sales;"),
    ("R__views.sql", "CREATE OR REPLACE VIEW shop.v AS SELECT * FROM shop.customer;"),
]
TABLES = [
    ("SHOP.CUSTOMER", "who buys; and where", "1", "3,10", 2, "ID", "primary_key ID|unique MAIL", ""),
    ("SHOP.SALES", None, "1", "2,3,5", 5, "ORDER_ID", "foreign_key CUSTOMER_ID|primary_key ORDER_ID", "IX_ORDERS_CUSTOMER"),
]
COLUMNS = [
    ("SHOP.CUSTOMER", 0, "ID", "NUMBER(12)", False, None, True, False, True, None),
    ("SHOP.CUSTOMER", 1, "MAIL", "VARCHAR2(200)", False, None, False, False, True, "it's unique"),
    ("SHOP.SALES", 0, "ORDER_ID", "NUMBER(12)", False, None, True, False, True, None),
    ("SHOP.SALES", 1, "CUSTOMER_ID", "NUMBER(12)", True, None, False, True, False, None),
    ("SHOP.SALES", 2, "NOTE", "CLOB", True, "';'", False, False, False, None),
    ("SHOP.SALES", 3, "TOTAL", "NUMBER(12,2)", False, "0", False, False, False, None),
    ("SHOP.SALES", 4, "PAID", "DATE", True, None, False, False, False, None),
]


def _value(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + f") v({names})"


def _schema(spark) -> Schema:
    return Schema(spark.createDataFrame(MIGRATIONS, "filename string, sql string"))


@query("ddl_tables", _values(TABLES, "full_name, table_comment, created_in, modified_in, column_count, pk, keys, indexes"))
def ddl_tables(spark, d):
    """The tables that the migrations above leave."""
    keys = F.array_join(F.array_sort(F.transform("constraints", lambda c: F.concat_ws(" ", c["type"], F.array_join(c["columns"], ",")))), "|")
    t = _schema(spark).tables
    return t.select(
        "full_name", "table_comment", "created_in", F.array_join("modified_in", ",").alias("modified_in"), "column_count", F.array_join("pk_columns", ",").alias("pk"), keys.alias("keys"),
        F.array_join(F.transform("indexes", lambda i: i["name"]), ",").alias("indexes"),
    )


@query("ddl_columns", _values(COLUMNS, "table_name, ord, column_name, data_type, nullable, default_expr, is_pk, is_fk, is_unique, column_comment"))
def ddl_columns(spark, d):
    """Their columns."""
    return _schema(spark).columns.select("table_name", "ord", "column_name", "data_type", "nullable", "default_expr", "is_pk", "is_fk", "is_unique", "column_comment")


@query("ddl_sequences", _values([("SEQ_ORDERS", 100, 5, "2")], "sequence, start_with, increment_by, created_in"))
def ddl_sequences(spark, d):
    return _schema(spark).sequences


@query("ddl_state", P5_SQL.replace("FROM operations\n", "FROM operations WHERE raw_sql IS NOT NULL\n"))
def ddl_state(spark, d):
    """The columns that all statements of the log leave, parsed from their texts and folded; the SQL folds what the log says of them."""
    versions = table(spark, d, "operations").groupBy("source_file").agg(F.min("version").alias("version"))
    ops = _statement_ops(spark, d).join(versions, F.col("filename") == F.col("source_file")).withColumn("file_key", version_key(F.col("version")))
    return fold.column_state(fold.snapshot(ops)).select("table_name", "column_name", "data_type")
