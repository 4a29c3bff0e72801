"""Rebuilding a table from an unordered change feed with equality deletes (problem 5).

Changes are appended to two kinds of files, each row with the sequence number of its statement: data
rows (a column that came to be, or a new type for one) and delete keys (a table, or one column of a
table). A reader keeps a data row only if no later delete key matches it. Appending never reads the
state, so repeats and late statements need no care; a reader sees the same state in whatever order
and in however many batches the files were written. For that each row also has the key of its statement and
which delivery of it this is, and of several deliveries the reader takes the first to arrive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.names import norm_name, sequence_key
from terrane.session import scratch

ROWS_PER_TASK = 1_000_000  # data rows of a table that one task compares with its table deletes; more are spread
MAX_HOT = 10_000  # tables that are spread; each of the others has less than 1 / MAX_HOT of all rows

_LOG = "level string, t string, c string, kind string, data_type string, seq string, source_file string, statement_index int, arrived_at timestamp_ntz, op_id bigint, content string, batch string"
_ROW = "struct<content:string,level:string,c:string,kind:string,data_type:string>"
_EFFECTIVE = ("CREATE_TABLE", "DROP_TABLE", "ADD_COLUMN", "MODIFY_COLUMN", "DROP_COLUMN")


def _statements(ops: DataFrame) -> DataFrame:
    """One row per statement key; of several deliveries the first to arrive counts (then the lowest op_id).

    Deliveries without effect can be the first as well. They are read by themselves, with their key and time only, so that
    the scan of the others filters on their kind.
    """
    effective = F.col("operation").isin(*_EFFECTIVE) & F.col("table_name").isNotNull()
    payload = F.struct("version", "operation", "table_name", "column_name", "data_type", "col_defs")
    key = ("source_file", "statement_index", F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"), "op_id")
    told = ops.where(effective).select(*key, payload.alias("p"))
    silent = ops.where(~F.coalesce(effective, F.lit(False))).select(*key, F.lit(None).cast(told.schema["p"].dataType).alias("p"))
    by = told.unionByName(silent).groupBy("source_file", "statement_index").agg(F.min(F.struct("arrived_at", "op_id", "p")).alias("s"))
    p = F.col("s.p")
    return by.select(
        "source_file",
        "statement_index",
        "s.arrived_at",
        "s.op_id",
        p["operation"].alias("operation"),
        norm_name(p["table_name"]).alias("t"),
        norm_name(p["column_name"]).alias("c"),
        p["data_type"].alias("data_type"),
        p["col_defs"].alias("col_defs"),
        F.when(p.isNotNull(), sequence_key(p["version"], F.col("statement_index"))).alias("seq"),
    )


_DELIVERY = ("source_file", "statement_index", "arrived_at", "op_id")


def change_rows(ops: DataFrame) -> DataFrame:
    """The feed as rows of data and delete files.

    A CREATE writes a table delete that reopens the table and a row per column; a DROP a table delete
    that does not. Statements without a table name, and column statements without a column name, change
    nothing and make one row that says so; null `col_defs` is a table without columns; a column named twice in one
    CREATE counts once.
    """

    def row(content: str, level: str, kind: str, c=None, data_type=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(content).alias("content"),
            F.lit(level).alias("level"),
            (none if c is None else c).alias("c"),
            F.lit(kind).alias("kind"),
            (none if data_type is None else data_type).alias("data_type"),
        )

    s = _statements(ops)
    op, c = F.col("operation"), F.col("c")
    defs = F.coalesce(F.col("col_defs"), F.array().cast(ops.schema["col_defs"].dataType))
    created = F.transform(defs, lambda d: row("data", "column", "insert", norm_name(d["name"]), d["data_type"]))
    rows = (
        F.when(op == "CREATE_TABLE", F.concat(F.array(row("delete", "table", "reopen")), created))
        .when(op == "DROP_TABLE", F.array(row("delete", "table", "close")))
        .when((op == "ADD_COLUMN") & c.isNotNull(), F.array(row("data", "column", "insert", c, F.col("data_type"))))
        .when(
            (op == "MODIFY_COLUMN") & c.isNotNull() & F.col("data_type").isNotNull(),
            F.array(row("data", "column", "update", c, F.col("data_type"))),
        )
        .when((op == "DROP_COLUMN") & c.isNotNull(), F.array(row("delete", "column", "drop", c)))
        .otherwise(F.array(row("none", "statement", "none")))
    ).cast(f"array<{_ROW}>")
    return s.select("t", "seq", *_DELIVERY, F.inline(rows)).where("content <> 'data' OR c IS NOT NULL")


def append_changes(ops: DataFrame, path: str, alone: bool = False) -> None:
    """Append a batch of the feed to the table's data and delete files.

    A batch that is all there ever is (`alone`) needs no delivery keys, nor rows of statements without effect.
    """
    rows = change_rows(ops)
    if alone:
        rows = rows.where("content <> 'none'").select("t", "seq", *(F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in _DELIVERY), "content", "level", "c", "kind", "data_type")
    rows.withColumn("batch", F.lit(uuid.uuid4().hex)).write.mode("append").partitionBy("content", "batch").parquet(path)


def _log(spark: SparkSession, path: str) -> DataFrame:
    """All rows; of a statement that several batches have, those of its first delivery."""
    log = spark.read.schema(_LOG).parquet(path)
    if log.select("batch").distinct().limit(2).count() < 2:
        return log
    at = F.struct("arrived_at", "op_id")
    firsts = log.groupBy("source_file", "statement_index").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("last > first")
    firsts = firsts.select(F.col("source_file").alias("_f"), F.col("statement_index").alias("_i"), "first")
    same = F.col("source_file").eqNullSafe(F.col("_f")) & F.col("statement_index").eqNullSafe(F.col("_i"))
    return log.join(firsts, same & (at > F.col("first")), "left_anti")


def _latest_deletes(log: DataFrame) -> DataFrame:
    """Delete keys compacted to the latest of each table (`c` is null) and column."""
    rows = log.where("content = 'delete'")
    return rows.groupBy("level", "t", "c").agg(F.max(F.struct("seq", "kind", *_DELIVERY)).alias("last"))


def _alive(log: DataFrame, deletes: DataFrame, rows_per_task: int, opened_only: bool = True) -> DataFrame:
    """Data rows without a later delete key, of tables that exist (`opened_only`) or of all.

    A table that has more than `rows_per_task` data rows meets its delete in as many tasks as that takes.
    """
    data = log.where("content = 'data'")
    # A closed table's last delete is later than anything; a table that was never opened has no key at all.
    opened = deletes.where("level = 'table'" + (" AND last.kind = 'reopen'" if opened_only else "")).select(F.col("t").alias("_t"), F.col("last.seq").alias("oseq"))
    dropped = deletes.where("level = 'column'").select(F.col("t").alias("_t"), F.col("c").alias("_c"), F.col("last.seq").alias("dseq"))
    hot = data.groupBy(F.col("t").alias("_h")).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_task)
    hot = hot.orderBy(F.desc("n"), "_h").limit(MAX_HOT).select("_h", F.ceil(F.col("n") / rows_per_task).cast("int").alias("ways"))
    hot = data.sparkSession.createDataFrame(hot.collect(), "_h string, ways int")  # at most MAX_HOT rows
    opened = opened.join(F.broadcast(hot), F.col("_t") == F.col("_h"), "left")
    opened = opened.select("_t", "oseq", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("_way"))
    spread = data.join(F.broadcast(hot), F.col("t") == F.col("_h"), "left")
    spread = spread.withColumn("way", F.coalesce(F.pmod(F.xxhash64("c", "seq"), F.col("ways")).cast("int"), F.lit(0))).drop("_h", "ways")
    met = (F.col("t") == F.col("_t")) & (F.col("way") == F.col("_way"))
    if opened_only:
        alive = spread.join(opened, met & (F.col("seq") >= F.col("oseq")), "left_semi")
    else:  # a statement that makes the table may still come
        alive = spread.join(opened, met & (F.col("seq") < F.col("oseq")), "left_anti")
    return alive.join(dropped, (F.col("t") == F.col("_t")) & (F.col("c") == F.col("_c")) & (F.col("dseq") > F.col("seq")), "left_anti").drop("way")


def read_state(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The columns every table has after all statements: `table_name`, `column_name`, `data_type`.

    Of the rows left by the deletes, the first insert of a column gives it (later ones find it there)
    and the last update after that its type.
    """
    log = _log(spark, path)
    alive = _alive(log, _latest_deletes(log), rows_per_task)
    rows = alive.groupBy("t", "c").agg(
        F.min(F.when(F.col("kind") == "insert", F.struct("seq", "data_type"))).alias("made"),
        F.max(F.when(F.col("kind") == "update", F.struct("seq", "data_type"))).alias("typed"),
    )
    later = F.col("typed.seq") > F.col("made.seq")
    return rows.where("made IS NOT NULL").select(
        F.col("t").alias("table_name"),
        F.col("c").alias("column_name"),
        F.when(later, F.col("typed.data_type")).otherwise(F.col("made.data_type")).alias("data_type"),
    )


def compact(spark: SparkSession, path: str, into: str, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Write the files at `path` anew without the rows that later deletes took away, and with one delete per key.

    Batches can be appended to the new files as before. What is compacted is final: an earlier delivery of a
    statement that comes only then does not bring rows back that the later delivery took away.
    """
    log = _log(spark, path)
    deletes = _latest_deletes(log)
    names = ["level", "t", "c", "kind", "data_type", "seq", *_DELIVERY, "content"]
    none = F.lit(None).cast("string")
    kept = deletes.select("level", "t", "c", "last.kind", none.alias("data_type"), "last.seq", *(f"last.{n}" for n in _DELIVERY), F.lit("delete").alias("content"))
    rows = _alive(log, deletes, rows_per_task, opened_only=False).select(*names).unionByName(kept).unionByName(log.where("content = 'none'").select(*names))
    rows.withColumn("batch", F.lit(uuid.uuid4().hex)).write.mode("errorifexists").partitionBy("content", "batch").parquet(into)


def current_columns(ops: DataFrame) -> DataFrame:
    """Append the whole feed to new files in the shared folder and read the state back."""
    spark = ops.sparkSession
    path = scratch(spark, "changes")
    append_changes(ops, path, alone=True)
    return read_state(spark, path)
