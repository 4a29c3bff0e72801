from __future__ import annotations

import pytest

from terrane.llm.queries import QUERIES, SQL

FOUND = {
    "p1_found": [("chunk_id", "string")],
    "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("lang", "string")],
}


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", FOUND)
def test_found_queries(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert df.dtypes == FOUND[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))
