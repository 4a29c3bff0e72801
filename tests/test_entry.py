from __future__ import annotations

import pytest

import __spark_entry__ as entry
from terrane.plans.registry import QUERIES

FOUND = {
    "p2_found": [("line_id", "bigint"), ("reason", "string")],
    "p3_found": [("category_code", "string"), ("cycle_code", "string")],
    "p4_found": [("ref_source", "string"), ("ref_id", "bigint"), ("status", "string")],
    "p5_found": [("table_name", "string"), ("column_name", "string"), ("data_type", "string")],
}


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", FOUND)
def test_found_queries(spark, tiny, name):
    df = entry.queries()[name](spark, tiny)
    assert df.dtypes == FOUND[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


def test_plans_prune_columns_and_push_filters(spark, tiny):
    from terrane.operators import changefeed
    from terrane.plans.registry import table

    ops = table(spark, tiny, "operations")
    plan = changefeed.change_rows(ops)._jdf.queryExecution().executedPlan().toString()
    assert "raw_sql" not in plan and "PushedFilters: [In(operation" in plan
