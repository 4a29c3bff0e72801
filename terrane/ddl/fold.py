"""Operations of migration files to the snapshot they leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.hierarchy import hierarchy

_STATE = (
    "full_name string, columns array<struct<name:string,data_type:string,nullable:boolean,default_expr:string,is_pk:boolean,comment:string>>,"
    " constraints array<struct<name:string,type:string,columns:array<string>,ref_table:string,ref_columns:array<string>,on_delete:string,check_expr:string>>,"
    " indexes array<struct<name:string,columns:array<string>,is_unique:boolean,created_in:string>>, table_comment string, created_in string, modified_in array<string>"
)


_NAMES = ["full_name", "columns", "constraints", "indexes", "table_comment", "created_in", "modified_in"]


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tables that groups of operations leave, which come one group after the other and each in the order of the log.

    A group is a table with all names it had. Only the tables of the group at hand are held, not its operations.
    """
    group: str | None = None
    tables: dict[str, dict] = {}
    done: list[list] = []

    def changed(t: dict, version: str) -> None:
        t["modified_in"][version] = None

    def find(t: dict, name: str) -> dict | None:
        return next((c for c in t["columns"] if c["name"] == name), None)

    def close() -> None:
        done.extend([list(t[n]) if n == "modified_in" else t[n] for n in _NAMES] for t in tables.values())
        tables.clear()

    applied = True
    for r in (x for part in parts for x in part.itertuples(index=False)):
        if r.group != group:
            close()
            group, applied = r.group, True
            if len(done) >= 1_000:
                yield pd.DataFrame(done, columns=_NAMES)
                done.clear()
        t, op = tables.get(r.table_name), r.operation
        cols = list(r.columns) if r.columns is not None else []
        if op == "CREATE_TABLE":
            applied = not (r.guarded and t is not None)
            if applied:
                tables[r.table_name] = {
                    "full_name": r.table_name, "columns": [], "constraints": [], "indexes": [], "table_comment": None, "created_in": r.version, "modified_in": {},
                }
            continue
        inline = r.comment == "inline" and op in ("CREATE_COLUMN", "ADD_CONSTRAINT")
        if inline and not applied:
            continue
        if op == "DROP_TABLE":
            tables.pop(r.table_name, None)
        elif op == "DROP_INDEX":
            for x in tables.values():
                x["indexes"] = [i for i in x["indexes"] if i["name"] != r.target]
        elif t is None:
            continue
        elif op in ("CREATE_COLUMN", "ADD_COLUMN"):
            if find(t, r.target) is None:
                t["columns"].append({
                    "name": r.target, "data_type": r.data_type or "UNKNOWN", "nullable": r.nullable is not False and not r.is_pk, "default_expr": r.default_expr,
                    "is_pk": bool(r.is_pk), "comment": None,
                })
            if op == "ADD_COLUMN":
                changed(t, r.version)
        elif op == "MODIFY_COLUMN":
            c = find(t, r.target)
            if c:
                c["data_type"] = r.data_type or c["data_type"]
                c["nullable"] = c["nullable"] if r.nullable is None else bool(r.nullable)
                c["default_expr"] = r.default_expr or c["default_expr"]
            changed(t, r.version)
        elif op == "DROP_COLUMN":
            t["columns"] = [c for c in t["columns"] if c["name"] != r.target]
            changed(t, r.version)
        elif op == "RENAME_COLUMN":
            for c in t["columns"]:
                c["name"] = r.new_name if c["name"] == r.target else c["name"]
            for k in t["constraints"]:
                k["columns"] = [r.new_name if c == r.target else c for c in k["columns"]]
            changed(t, r.version)
        elif op == "RENAME_TABLE":
            new = r.new_name if "." in r.new_name or "." not in r.table_name else r.table_name.rpartition(".")[0] + "." + r.new_name
            t["full_name"] = new
            tables[new] = tables.pop(r.table_name)
            changed(t, r.version)
        elif op == "ADD_CONSTRAINT":
            t["constraints"].append({
                "name": r.target, "type": r.constraint_type, "columns": cols, "ref_table": r.ref_table,
                "ref_columns": list(r.ref_columns) if r.ref_columns is not None else [], "on_delete": r.on_delete, "check_expr": r.check_expr,
            })
            if not inline:
                changed(t, r.version)
        elif op == "DROP_CONSTRAINT":
            t["constraints"] = [k for k in t["constraints"] if not (k["name"] == r.target if r.target else k["type"] == r.constraint_type)]
            changed(t, r.version)
        elif op == "CREATE_INDEX":
            t["indexes"].append({"name": r.target, "columns": cols, "is_unique": bool(r.is_unique), "created_in": r.version})
        elif op == "COMMENT":
            if r.target is None:
                t["table_comment"] = r.comment
            elif find(t, r.target):
                find(t, r.target)["comment"] = r.comment
    close()
    if done:
        yield pd.DataFrame(done, columns=_NAMES)


_TABLE_OPS = (
    "CREATE_TABLE", "CREATE_COLUMN", "DROP_TABLE", "RENAME_TABLE", "ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN", "RENAME_COLUMN", "ADD_CONSTRAINT",
    "DROP_CONSTRAINT", "CREATE_INDEX", "COMMENT",
)


def snapshot(ops: DataFrame) -> DataFrame:
    """One row per table with the columns of the snapshot tables, and `columns`.

    A table's operations, under all names that renames gave it, are folded in the order of the log: IF NOT
    EXISTS keeps a table, a plain CREATE replaces it; adding an existing column changes nothing but marks the
    table; renaming a column renames it in the table's constraints. Indexes are dropped by name. Operations are sorted on
    disk and read one by one, so a table may have any number of them; a constraint or index takes its place in the state.
    """
    new = F.when(F.col("new_name").contains(".") | ~F.col("table_name").contains("."), F.col("new_name")).otherwise(
        F.concat(F.regexp_extract("table_name", "^(.*)[.]", 1), F.lit("."), "new_name")
    )
    renames = ops.where("operation = 'RENAME_TABLE'").groupBy(new.alias("id")).agg(F.min("table_name").alias("next"))
    olds = renames.select(F.col("next").alias("id")).distinct().join(renames.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")
    chains = renames.unionByName(olds.withColumn("next", F.lit(None).cast("string")))
    roots = hierarchy(chains).select(F.col("id").alias("_id"), F.coalesce("root", "cycle_code").alias("_root"))
    mine = ops.where(F.col("operation").isin(*_TABLE_OPS) & F.col("table_name").isNotNull())
    # An index is dropped without its table's name: the table is the one it was created on.
    made = ops.where("operation = 'CREATE_INDEX' AND target IS NOT NULL").select(F.col("target").alias("_x"), F.col("table_name").alias("_on")).distinct()
    drops = ops.where("operation = 'DROP_INDEX'").join(made, F.col("target") == F.col("_x")).withColumn("table_name", F.col("_on")).select(*ops.columns)
    rows = mine.unionByName(drops).join(roots, F.col("table_name") == F.col("_id"), "left").withColumn("group", F.coalesce("_root", "table_name")).drop("_id", "_root")
    order = ["group", "file_key", "filename", "stmt_idx", "op_idx"]
    t = rows.repartition("group").sortWithinPartitions(*order).mapInPandas(_fold, _STATE)
    keys = F.flatten(F.transform(F.filter("constraints", lambda k: k["type"] == "primary_key"), lambda k: k["columns"]))
    none = F.lit(None).cast("timestamp_ntz")
    return t.select(
        F.when(F.col("full_name").contains("."), F.regexp_extract("full_name", "^(.*)[.]", 1)).alias("schema_name"), F.element_at(F.split("full_name", "[.]"), -1).alias("name"),
        "full_name", "constraints", "indexes", "table_comment", "created_in", "modified_in", F.size("columns").alias("column_count"), (F.size(keys) > 0).alias("has_pk"),
        keys.alias("pk_columns"), none.alias("created_at"), none.alias("dropped_at"), "columns",
    )


def column_state(tables: DataFrame) -> DataFrame:
    """The snapshot's columns as rows of the column tables."""
    c = F.col("c")
    rows = tables.select("full_name", "pk_columns", "constraints", F.posexplode("columns").alias("ord", "c"))

    def named(kind: str):
        return F.array_contains(F.flatten(F.transform(F.filter("constraints", lambda k: k["type"] == kind), lambda k: k["columns"])), c["name"])

    number = lambda i: F.nullif(F.regexp_extract(c["data_type"], r"\((\d+)(?:,(\d+))?\)", i), F.lit("")).cast("int")
    return rows.select(
        F.col("full_name").alias("table_name"), "ord", c["name"].alias("column_name"), c["data_type"].alias("data_type"), F.regexp_extract(c["data_type"], "^([^(]*)", 1).alias("raw_type"),
        number(1).alias("num_precision"), number(2).alias("num_scale"), c["nullable"].alias("nullable"), c["default_expr"].alias("default_expr"),
        F.array_contains("pk_columns", c["name"]).alias("is_pk"), named("foreign_key").alias("is_fk"), (named("unique") | F.array_contains("pk_columns", c["name"])).alias("is_unique"),
        c["comment"].alias("column_comment"),
    )


def sequences(ops: DataFrame) -> DataFrame:
    """(sequence, start_with, increment_by, created_in): sequences whose last statement creates them."""
    at = F.struct("file_key", "filename", "stmt_idx", "op_idx")
    s = ops.where("operation IN ('CREATE_SEQUENCE', 'DROP_SEQUENCE')")
    last = s.groupBy(F.col("target").alias("sequence")).agg(F.max_by(F.struct("operation", "start_with", "increment_by", "version"), at).alias("l"))
    return last.where("l.operation = 'CREATE_SEQUENCE'").select("sequence", "l.start_with", "l.increment_by", F.col("l.version").alias("created_in"))
