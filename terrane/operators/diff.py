"""Differences of snapshots: what was added, removed and changed, what breaks, and the statements that repair it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories of drift and their severity.
DRIFT = {
    "missing_table": "error",
    "extra_table": "warning",
    "missing_column": "error",
    "extra_column": "warning",
    "type_mismatch": "error",
    "nullability": "warning",
    "missing_constraint": "warning",
    "extra_constraint": "info",
    "missing_index": "info",
    "extra_index": "info",
}


def full_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of `a` and `b` by key (null keys are keys): the keys, `a_<field>`, `b_<field>` and `change`.

    `change` is added, removed, modified or same. One full outer join; both sides must be unique by key.
    """
    left = a.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.lit(True).alias("_a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    right = b.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.lit(True).alias("_b"), *(F.col(f).alias(f"b_{f}") for f in fields))
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differs, "modified").otherwise("same")
    both = left.join(right, on, "full")
    key = [F.when(F.col("_a").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys]
    return both.select(*key, *(F.col(f"{s}_{f}") for f in fields for s in "ab"), change.alias("change"))


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _boolean(c: Column) -> Column:
    return F.when(c.isNull(), "None").when(c, "True").otherwise("False")


def column_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that differ between two snapshots, with one text per field that does, and whether it breaks users.

    Removing a column, another type and nullable becoming not nullable break; a table added or removed is
    in `table_changes`.
    """
    fields = ["data_type", "nullable", "default_expr", "is_pk", "is_unique", "column_comment"]
    d = full_diff(a, b, ["table_name", "column_name"], fields).where("change <> 'same'")

    def said(field: str, name: str, show) -> Column:
        x, y = F.col(f"a_{field}"), F.col(f"b_{field}")
        return F.when(~x.eqNullSafe(y), F.concat(F.lit(f"{name}: "), show(x), F.lit("→"), show(y)))

    texts = F.array_compact(F.array(
        said("data_type", "type", _shown), said("nullable", "nullable", _boolean), said("default_expr", "default", _shown),
        said("is_pk", "primary_key", _boolean), said("is_unique", "unique", _boolean), said("column_comment", "comment", _shown),
    ))
    tightened = F.col("a_nullable") & ~F.col("b_nullable")
    breaks = (F.col("change") == "removed") | ((F.col("change") == "modified") & (~F.col("a_data_type").eqNullSafe(F.col("b_data_type")) | F.coalesce(tightened, F.lit(False))))
    shown = F.when(F.col("change") == "modified", F.array_join(texts, "; ")).otherwise("")
    return d.select("table_name", "column_name", "change", shown.alias("diffs"), breaks.alias("breaking"))


def table_changes(a: DataFrame, b: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables that differ: added, removed, or modified by what `columns` (see `column_changes`) and their comment say."""
    t = full_diff(a, b, ["full_name"], ["table_comment"])
    c = columns.groupBy(F.col("table_name").alias("_t")).agg(F.count("*").alias("n"), F.bool_or("breaking").alias("bad"))
    rows = t.join(c, F.col("full_name") == F.col("_t"), "left")
    change = F.when((F.col("change") == "same") & F.col("n").isNotNull(), "modified").otherwise(F.col("change"))
    bad = (change == "removed") | ((change == "modified") & F.coalesce("bad", F.lit(False)))
    rows = rows.select("full_name", change.alias("change"), F.coalesce("n", F.lit(0)).alias("columns"), bad.alias("breaking"))
    return rows.where("change <> 'same'")


def diff_stats(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts of changes; columns only of tables that both snapshots have."""
    shared = columns.join(tables.where("change = 'modified'").select(F.col("full_name").alias("_t")), F.col("table_name") == F.col("_t"), "left_semi")
    both = tables.select(F.lit("table").alias("object"), "change", "breaking").unionByName(shared.select(F.lit("column").alias("object"), "change", "breaking"))
    return both.groupBy("object", "change").agg(F.count("*").alias("n"), F.count_if("breaking").alias("breaking"))


def drift(base_tables: DataFrame, base_columns: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """How a target has drifted from its base, each with severity and the statement that repairs the target."""
    t = full_diff(base_tables, tables, ["full_name"], []).where("change IN ('added', 'removed')")
    gone, extra = F.col("change") == "removed", F.col("change") == "added"
    none = F.lit(None).cast("string")
    of_tables = t.select(
        F.when(gone, "missing_table").otherwise("extra_table").alias("category"), F.col("full_name").alias("table_name"), none.alias("column_name"),
        F.when(gone, F.concat(F.lit("-- recreate table "), "full_name")).otherwise(F.concat(F.lit("-- DROP TABLE "), "full_name", F.lit(";"))).alias("repair"),
    )
    shared = base_tables.select(F.col("full_name").alias("_n")).join(tables.select("full_name"), F.col("_n") == F.col("full_name"), "left_semi")
    c = full_diff(base_columns, columns, ["table_name", "column_name"], ["data_type", "nullable"]).where("change <> 'same'")
    c = c.join(shared, F.col("table_name") == F.col("_n"), "left_semi")
    retyped = ~F.col("a_data_type").eqNullSafe(F.col("b_data_type"))
    kinds = F.array_compact(F.array(
        F.when(gone, "missing_column"), F.when(extra, "extra_column"),
        F.when((F.col("change") == "modified") & retyped, "type_mismatch"),
        F.when((F.col("change") == "modified") & ~F.col("a_nullable").eqNullSafe(F.col("b_nullable")), "nullability"),
    ))
    of_columns = c.withColumn("category", F.explode(kinds))
    alter = F.concat(F.lit("ALTER TABLE "), "table_name")
    nul = F.when(F.col("a_nullable"), F.lit(" NULL")).otherwise(" NOT NULL")
    repair = (
        F.when(F.col("category") == "missing_column", F.concat(alter, F.lit(" ADD ("), "column_name", F.lit(" "), "a_data_type", F.lit(");")))
        .when(F.col("category") == "extra_column", F.concat(alter, F.lit(" DROP COLUMN "), "column_name", F.lit(";")))
        .when(F.col("category") == "type_mismatch", F.concat(alter, F.lit(" MODIFY ("), "column_name", F.lit(" "), "a_data_type", F.lit(");")))
        .otherwise(F.concat(alter, F.lit(" MODIFY ("), "column_name", nul, F.lit(");")))
    )
    rows = of_tables.unionByName(of_columns.select("category", "table_name", "column_name", repair.alias("repair")))
    severity = F.try_element_at(F.create_map(*(F.lit(x) for pair in DRIFT.items() for x in pair)), F.col("category"))
    return rows.withColumn("severity", severity)


def constraint_rows(tables: DataFrame) -> DataFrame:
    """(full_name, type, columns, name, ref_table, ref_columns, on_delete) of the tables' constraints."""
    c = tables.select("full_name", F.explode("constraints").alias("c"))
    return c.select("full_name", "c.type", "c.columns", "c.name", "c.ref_table", "c.ref_columns", "c.on_delete")


def index_rows(tables: DataFrame) -> DataFrame:
    """(full_name, name, columns, is_unique) of the tables' indexes."""
    i = tables.select("full_name", F.explode("indexes").alias("i"))
    return i.select("full_name", "i.name", "i.columns", "i.is_unique")


def object_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(object, owner, name, change) of constraints and indexes of tables that both snapshots have, and of relationships of all.

    Constraints compare by type, sorted columns and name; indexes by name, whatever their columns; relationships by
    the tables, columns and name of a foreign key. Each is added or removed.
    """
    both = a.select("full_name").join(b.select(F.col("full_name").alias("_b")), F.col("full_name") == F.col("_b"), "left_semi").distinct()

    def keyed(t: DataFrame) -> DataFrame:
        own = t.join(both.withColumnRenamed("full_name", "_f"), F.col("full_name") == F.col("_f"), "left_semi")
        text = lambda *cs: F.concat_ws(" ", *(F.coalesce(c, F.lit("-")) for c in cs))
        listed = lambda c: F.array_join(c, ",")
        cons = constraint_rows(own).select(F.lit("constraint").alias("object"), F.col("full_name").alias("owner"), text(F.col("type"), listed(F.array_sort("columns")), F.col("name")).alias("name"))
        idx = index_rows(own).select(F.lit("index").alias("object"), F.col("full_name").alias("owner"), F.col("name").alias("name"))
        fks = constraint_rows(t).where("type = 'foreign_key'")
        rel = fks.select(F.lit("relationship").alias("object"), F.col("full_name").alias("owner"), text(listed("columns"), F.lit("→"), F.col("ref_table"), listed("ref_columns"), F.col("name")).alias("name"))
        return cons.unionByName(idx).unionByName(rel).distinct()

    return full_diff(keyed(a), keyed(b), ["object", "owner", "name"], []).where("change <> 'same'").select("object", "owner", "name", "change")


def sequence_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sequence, change, diffs) of sequences (sequence, start_with, increment_by) that differ."""
    d = full_diff(a, b, ["sequence"], ["start_with", "increment_by"]).where("change <> 'same'")
    said = lambda f: F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.concat(F.lit(f"{f}: "), _shown(F.col(f"a_{f}")), F.lit("→"), _shown(F.col(f"b_{f}"))))
    shown = F.when(F.col("change") == "modified", F.array_join(F.array_compact(F.array(said("start_with"), said("increment_by"))), "; ")).otherwise("")
    return d.select("sequence", "change", shown.alias("diffs"))


def _severity(category: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DRIFT.items() for x in pair)), category)


def constraint_drift(base: DataFrame, target: DataFrame) -> DataFrame:
    """Constraints by (type, columns) and indexes by (columns, unique) of tables that both have, which only one side has: (full_name, category, key, severity, repair).

    All checks of a table without columns are one. Of several with one key the least name is repaired; a constraint
    without a name cannot be dropped by a statement and has an empty repair.
    """

    def keys(t: DataFrame) -> DataFrame:
        listed = lambda c: F.array_join(c, ", ")
        alter = F.concat(F.lit("ALTER TABLE "), "full_name")
        refs = F.concat(F.lit(" REFERENCES "), "ref_table", F.lit(" ("), listed("ref_columns"), F.lit(")"), F.coalesce(F.concat(F.lit(" ON DELETE "), "on_delete"), F.lit("")))
        what = (
            F.when(F.col("type") == "primary_key", F.concat(F.lit("PRIMARY KEY ("), listed("columns"), F.lit(")")))
            .when(F.col("type") == "unique", F.concat(F.lit("UNIQUE ("), listed("columns"), F.lit(")")))
            .when((F.col("type") == "foreign_key") & F.col("ref_table").isNotNull(), F.concat(F.lit("FOREIGN KEY ("), listed("columns"), F.lit(")"), refs))
        )
        add = F.coalesce(F.concat(alter, F.lit(" ADD CONSTRAINT "), F.coalesce("name", F.lit("None")), F.lit(" "), what, F.lit(";")), F.concat(F.lit("-- Cannot generate constraint: "), "type"))
        drop = F.coalesce(F.concat(alter, F.lit(" DROP CONSTRAINT "), "name", F.lit(";")), F.lit(""))
        c = constraint_rows(t).select("full_name", F.lit("constraint").alias("object"), F.concat_ws(" ", "type", F.array_join("columns", ",")).alias("key"), F.struct(F.coalesce("name", F.lit("")).alias("name"), add.alias("add"), drop.alias("drop")).alias("r"))
        unique = F.when(F.col("is_unique"), F.lit("UNIQUE ")).otherwise("")
        make = F.concat(F.lit("CREATE "), unique, F.lit("INDEX "), "name", F.lit(" ON "), "full_name", F.lit(" ("), listed("columns"), F.lit(");"))
        gone = F.concat(F.lit("DROP INDEX "), "name", F.lit(";"))
        i = index_rows(t).select("full_name", F.lit("index").alias("object"), F.concat_ws(" ", F.when(F.col("is_unique"), "unique").otherwise("plain"), F.array_join("columns", ",")).alias("key"), F.struct(F.coalesce("name", F.lit("")).alias("name"), make.alias("add"), gone.alias("drop")).alias("r"))
        return c.unionByName(i).groupBy("full_name", "object", "key").agg(F.min("r").alias("r"))

    shared = base.select(F.col("full_name").alias("_n")).join(target.select("full_name"), F.col("_n") == F.col("full_name"), "left_semi").distinct()
    d = full_diff(keys(base), keys(target), ["full_name", "object", "key"], ["r"]).where("a_r IS NULL OR b_r IS NULL")
    d = d.join(shared, F.col("full_name") == F.col("_n"), "left_semi")
    category = F.concat(F.when(F.col("b_r").isNull(), "missing_").otherwise("extra_"), F.col("object"))
    repair = F.when(F.col("b_r").isNull(), F.col("a_r.add")).otherwise(F.col("b_r.drop"))
    return d.select("full_name", category.alias("category"), "key", repair.alias("repair")).withColumn("severity", _severity(F.col("category")))


def create_statements(columns: DataFrame) -> DataFrame:
    """(table_name, statement): a CREATE TABLE of the columns in their order, with default and NOT NULL."""
    rule = F.concat(F.lit("  "), "column_name", F.lit(" "), F.coalesce("data_type", F.lit("UNKNOWN")), F.coalesce(F.concat(F.lit(" DEFAULT "), F.nullif("default_expr", F.lit(""))), F.lit("")), F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
    by = columns.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", rule.alias("x")))), lambda e: e["x"]), ",\n").alias("body"))
    return by.select("table_name", F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"), "body", F.lit("\n);")).alias("statement"))


def manifest(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(filename, hash): SHA-256 of each file's text with CR LF as LF."""
    text = F.replace(F.coalesce(text_col, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return files.select(F.col(path_col).alias("filename"), F.sha2(text, 256).alias("hash"))


def integrity(known: DataFrame, current: DataFrame) -> DataFrame:
    """Files against a manifest: modified, missing, new or clean."""
    d = full_diff(known, current, ["filename"], ["hash"])
    status = F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "new").when(F.col("change") == "modified", "modified").otherwise("clean")
    return d.select("filename", status.alias("status"))


def repair_script(drifts: DataFrame, max_statements: int = 10_000) -> str:
    """The repairing statements as one script, by severity, category and name. Reads at most `max_statements` rows or fails."""
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rows = drifts.orderBy(order, "category", "table_name", "column_name").limit(max_statements + 1).collect()
    if len(rows) > max_statements:
        raise ValueError(f"more than {max_statements} repairs; write the rows instead")
    out, last = [], None
    for r in rows:
        if r.category != last:
            out.append(f"-- {r.category} ({r.severity})")
            last = r.category
        out.append(r.repair)
    return "\n".join(out) + "\n"
