from __future__ import annotations

import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.operators import rejects

GOOD_O = "O,a.sql,1.2_3,4,CREATE_TABLE,T,,2024-02-29T23:59:59Z"
GOOD_R = 'R,a.sql,1,true,"[""x"", ""\\u00e9""]",2024-01-01T00:00:00Z'
CASES = {
    GOOD_O: None,
    GOOD_O + "\r": None,
    GOOD_R: None,
    'O,"a ""b"", c\nd.sql",1,4,COMMENT,T,"",2024-01-01T00:00:00Z': None,
    "R,a.sql,1,true,[],2024-01-01T00:00:00Z": None,
    'R,a.sql,1,true,"[ ""a"" ,""b"" ]",2024-01-01T00:00:00Z': None,
    'O,a"b.sql,1,4,COMMENT,T,,2024-01-01T00:00:00Z': "quoting",
    'O,"a"b.sql,1,4,COMMENT,T,,2024-01-01T00:00:00Z': "quoting",
    'O, "a.sql",1,4,COMMENT,T,,2024-01-01T00:00:00Z': "quoting",
    'O,"a.sql,1,4,COMMENT,T,,2024-01-01T00:00:00Z': "quoting",
    '"': "quoting",
    "": "invalid_value",
    "X,1": "invalid_value",
    "o,a.sql,1,4,COMMENT,T,,2024-01-01T00:00:00Z": "invalid_value",
    GOOD_O + ",x": "column_count",
    "O": "column_count",
    "R,a.sql,1,true,2024-01-01T00:00:00Z": "column_count",
    "O,,1,4,COMMENT,T,,2024-01-01T00:00:00Z": "invalid_value",
    "O,a,1..2,4,COMMENT,T,,2024-01-01T00:00:00Z": "invalid_value",
    "O,a,.1,4,COMMENT,T,,2024-01-01T00:00:00Z": "invalid_value",
    "O,a,1.,4,COMMENT,T,,2024-01-01T00:00:00Z": "invalid_value",
    "O,a,1,-4,COMMENT,T,,2024-01-01T00:00:00Z": "invalid_value",
    "O,a,1,٤,COMMENT,T,,2024-01-01T00:00:00Z": "invalid_value",
    "O,a,1,4,comment,T,,2024-01-01T00:00:00Z": "invalid_value",
    "O,a,1,4,COMMENT,T,,2023-02-29T00:00:00Z": "invalid_value",
    "O,a,1,4,COMMENT,T,,2024-01-01T24:00:00Z": "invalid_value",
    "O,a,1,4,COMMENT,T,,2024-01-01T00:00:00Z\n": "invalid_value",
    "R,a,1,TRUE,[],2024-01-01T00:00:00Z": "invalid_value",
    'R,a,1,true,"[1]",2024-01-01T00:00:00Z': "invalid_value",
    'R,a,1,true,"[""a"",]",2024-01-01T00:00:00Z': "invalid_value",
    'R,a,1,true,"[,""a""]",2024-01-01T00:00:00Z': "invalid_value",
    'R,a,1,true,"[""a"",null]",2024-01-01T00:00:00Z': "invalid_value",
    'R,a,1,true,"[""a""] x",2024-01-01T00:00:00Z': "invalid_value",
    'R,a,1,true,"[""a\\q""]",2024-01-01T00:00:00Z': "invalid_value",
    "R,a,1,true,,2024-01-01T00:00:00Z": "invalid_value",
}


def run(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    return {r.line_id: r.reason for r in rejects.rejected(df).collect()}


def test_contract(spark):
    lines = list(CASES)
    got = run(spark, lines)
    assert {x: got.get(i) for i, x in enumerate(lines)} == CASES


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, GOOD_O), (2, GOOD_R), (3, "bad")], "line_id long, line string")
    op = rejects.load_operations(df).first()
    assert (op.source_file, op.version, int(op.statement_index), op.raw_sql, str(op.applied_at)) == ("a.sql", "1.2_3", 4, "", "2024-02-29 23:59:59")
    res = rejects.load_results(df).first()
    assert res.skipped and res.errors == ["x", "é"]


def test_null_repeated_and_clashing(spark):
    rows = [(None, "bad", 1), (None, GOOD_O, 2), (7, "bad", 3), (7, "bad", 4), (7, GOOD_O, 5), (8, None, 6)]
    df = spark.createDataFrame(rows, "line_id long, line string, reason long")
    got = sorted((str(r.line_id), r.reason, r.line) for r in rejects.rejected(df).collect())
    assert got == [("7", "invalid_value", "bad"), ("8", "invalid_value", None), ("None", "invalid_value", "bad")]
    assert rejects.rejected(df.limit(0)).count() == 0


def test_very_long_line(spark):
    long = 'O,"' + '""' * 200_000 + '",1,4,COMMENT,T,' + "x" * 500_000 + ",2024-01-01T00:00:00Z"
    assert run(spark, [long, long + '"']) == {1: "quoting"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a,"\n\x01bc', max_size=6), min_size=8, max_size=8), min_size=1, max_size=20))
def test_fields_round_trip(spark, rows):
    from pyspark.sql import functions as F

    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select(rejects._fields(rejects._segments(F.col("line"))).alias("f"), rejects._well_quoted(rejects._segments(F.col("line"))).alias("q"))
    assert [(r.q, list(r.f)) for r in got.collect()] == [(True, r) for r in rows]


@pytest.mark.parametrize("value", ['["a\\"b"]', '["a", "b\\\\"]', '["\\u12"]', '["a" "b"]', "{}", '"a"', "[[]]", '[["a"]]', ' [ ] ', '["\t"]'])
def test_string_list_like_a_json_parser(spark, value):
    from pyspark.sql import functions as F

    try:
        x = json.loads(value)
        want = isinstance(x, list) and all(isinstance(y, str) for y in x)
    except ValueError:
        want = False
    df = spark.createDataFrame([(value,)], "v string").select(rejects._is_string_list(F.col("v")).alias("ok"))
    assert df.first().ok is want
