from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from terrane.functions.names import sequence_key
from terrane.operators import changefeed as cf
from terrane.session import scratch

SCHEMA = (
    "op_id long, source_file string, version string, statement_index int, operation string, table_name string, column_name string,"
    " data_type string, nullable boolean, col_defs array<struct<name:string,data_type:string,nullable:boolean>>, raw_sql string,"
    " content_hash string, arrived_at timestamp, seq string, kind string"
)
KINDS = ["CREATE_TABLE", "DROP_TABLE", "ADD_COLUMN", "MODIFY_COLUMN", "DROP_COLUMN", "COMMENT"]


def norm(x):
    return x.replace('"', "").strip().upper()


def order(version, index):
    v = [int(p) for p in version.replace("_", ".").split(".")]
    while v and v[-1] == 0:
        v.pop()
    return (v, index)


def fold(rows):
    first = {}
    for r in rows:
        k = (r["source_file"], r["statement_index"])
        if k not in first or (r["arrived_at"], r["op_id"]) < (first[k]["arrived_at"], first[k]["op_id"]):
            first[k] = r
    tables = {}
    for r in sorted(first.values(), key=lambda r: order(r["version"], r["statement_index"])):
        t, c = norm(r["table_name"]), norm(r["column_name"] or "")
        if r["operation"] == "CREATE_TABLE":
            tables[t] = {}
            for d in r["col_defs"] or []:
                tables[t].setdefault(norm(d["name"]), d["data_type"])
        elif r["operation"] == "DROP_TABLE":
            tables.pop(t, None)
        elif t in tables:
            if r["operation"] == "ADD_COLUMN":
                tables[t].setdefault(c, r["data_type"])
            elif r["operation"] == "MODIFY_COLUMN" and c in tables[t] and r["data_type"]:
                tables[t][c] = r["data_type"]
            elif r["operation"] == "DROP_COLUMN":
                tables[t].pop(c, None)
    return sorted((t, c, ty) for t, cs in tables.items() for c, ty in cs.items())


def feed(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choices(KINDS, [2, 1, 8, 5, 4, 2])[0]
        parts = [str(rng.randrange(3)), str(rng.choice([1, 2, 9, 10, 1000, 20240101120000]))]
        rows.append({
            "op_id": i, "source_file": f"f{i // 4}", "version": None, "statement_index": i % 4, "operation": kind,
            "table_name": rng.choice(["s.a", '"S"."A"', " S.B ", "s.c"]), "column_name": rng.choice(["x", '"X"', "Y", "z"]) if "COLUMN" in kind else None,
            "data_type": rng.choice(["INT", "DATE", None if kind == "MODIFY_COLUMN" else "CLOB"]), "nullable": True,
            "col_defs": [{"name": c, "data_type": "NUMBER", "nullable": True} for c in rng.sample(["x", "y", "w"], 2)] if kind == "CREATE_TABLE" else None,
            "raw_sql": None, "content_hash": None, "arrived_at": datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(500)),
            "seq": "clash", "kind": "clash",
        })
        rows[-1]["version"] = f"{i // 4:03}" + rng.choice([".", "_"]) + ".".join(parts) if i % 4 == 0 else rows[-2]["version"]
    again = [dict(r, op_id=r["op_id"] + 10_000, arrived_at=r["arrived_at"] + datetime.timedelta(days=3)) for r in rng.sample(rows, 100)]
    rows += again
    rng.shuffle(rows)
    return rows


def state(df):
    return sorted((r.table_name, r.column_name, r.data_type) for r in df.collect())


def test_against_fold(spark):
    for seed in range(4):
        rows = feed(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        assert state(cf.current_columns(df)) == fold(rows)


def test_order_of_batches_does_not_matter(spark):
    rows = feed(11)
    by_file = {}
    for r in rows:
        by_file.setdefault(r["source_file"], []).append(r)
    files = list(by_file.values())
    random.Random(3).shuffle(files)
    path = scratch(spark, "batches")
    for part in (files[:50], files[50:110], files[110:]):
        cf.append_changes(spark.createDataFrame([r for f in part for r in f], SCHEMA), path)
    cf.append_changes(spark.createDataFrame([r for f in files[:50] for r in f], SCHEMA), path)  # delivered twice
    assert state(cf.read_state(spark, path)) == fold(rows)


def test_nulls_and_empty(spark):
    base = dict.fromkeys(x.split()[0] for x in SCHEMA.replace("array<struct<name:string,data_type:string,nullable:boolean>>", "a").split(","))
    rows = [base, base | {"operation": "CREATE_TABLE", "table_name": "t", "source_file": "f"}, base | {"operation": "ADD_COLUMN", "table_name": "t", "source_file": "g"}]
    assert state(cf.current_columns(spark.createDataFrame(rows, SCHEMA))) == []
    assert state(cf.current_columns(spark.createDataFrame([], SCHEMA))) == []


def test_sequence_key_sorts_as_versions(spark):
    versions = ["1", "1.0", "01.00.0", "1.0.1", "1.1", "1_2", "1.9", "1.10", "1.1000", "2", "20240101120000", "0", "0.1", "10.000", "1.0.0.0.0.3"]
    df = spark.createDataFrame([(v, i) for v in versions for i in (0, 2, 10)], "v string, i int")
    got = [(r.v, r.i) for r in df.withColumn("k", sequence_key(F.col("v"), F.col("i"))).orderBy("k").collect()]
    assert [order(v, i) for v, i in got] == sorted(order(v, i) for v in versions for i in (0, 2, 10))


def contradicting(seed):
    """A feed whose later deliveries say something else than the first, some with another kind of statement."""
    rng = random.Random(seed)
    rows = feed(seed)
    for r in rows:
        if r["op_id"] >= 10_000:
            r |= {"data_type": "XML"} | ({"operation": rng.choice(["COMMENT", "DROP_COLUMN", "ADD_COLUMN"]), "column_name": "x"} if rng.random() < 0.5 else {})
    return rows


def test_the_first_delivery_counts_in_any_batches(spark):
    rows = contradicting(5)
    want = fold(rows)
    assert state(cf.current_columns(spark.createDataFrame(rows, SCHEMA))) == want
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        path = scratch(spark, "batches")
        for k in range(3):
            cf.append_changes(spark.createDataFrame(rows[k::3], SCHEMA), path)
        assert state(cf.read_state(spark, path)) == want
        assert state(cf.read_state(spark, path, rows_per_task=7)) == want  # hot tables are spread


def test_compacted_files_go_on(spark):
    rows = feed(21)
    path, small = scratch(spark, "batches"), scratch(spark, "compacted")
    cf.append_changes(spark.createDataFrame(rows[:400], SCHEMA), path)
    cf.compact(spark, path, small)
    assert spark.read.parquet(small).count() < spark.read.parquet(path).count()
    assert state(cf.read_state(spark, small)) == fold(rows[:400])
    cf.append_changes(spark.createDataFrame(rows[400:], SCHEMA), small)
    assert state(cf.read_state(spark, small)) == fold(rows)
