"""Column lineage of views and tables made from queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.ddl.extract import _name, _Reader
from terrane.ddl.tokens import Token, split_top, statements

# Words that end a select list or a table list.
_AFTER_FROM = {"WHERE", "GROUP", "ORDER", "HAVING", "UNION", "MINUS", "INTERSECT", "EXCEPT", "CONNECT", "START", "LIMIT", "FETCH", "WITH"}
_JOIN_WORDS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL"}


def _select_parts(own: list[Token]) -> tuple[list[list[Token]], list[Token]]:
    """The select list's items and the tokens of FROM, of the first SELECT outside brackets."""
    depth, start, stop, end = 0, None, None, len(own)
    for i, t in enumerate(own):
        if t.kind == "mark":
            depth += (t.text == "(") - (t.text == ")")
        elif depth == 0 and t.kind == "word":
            if t.up == "SELECT" and start is None:
                start = i + 1
            elif t.up == "FROM" and start is not None and stop is None:
                stop = i
            elif stop is not None and t.up in _AFTER_FROM:
                end = i
                break
    if start is None or stop is None:
        return [], []
    items = own[start:stop]
    if items and items[0].up in ("DISTINCT", "ALL"):
        items = items[1:]
    return split_top(items), own[stop + 1 : end]


def _sources(own: list[Token]) -> dict[str, str]:
    """Alias (and short name) to table of a FROM clause; queries in brackets are passed over."""
    out: dict[str, str] = {}
    for part in split_top(own):
        r, expect = _Reader(part), True
        while r.at < len(part):
            if r.peek() == "(":
                r.inside()
                expect = False
            elif r.peek() in _JOIN_WORDS and part[r.at].kind == "word":
                expect = True
                r.at += 1
            elif expect and r.is_name():
                table = r.name()
                r.take("AS")
                alias = r.peek()
                if r.is_name() and alias not in _JOIN_WORDS | {"ON", "USING"}:
                    out[_name(part[r.at])] = table
                    r.at += 1
                out[table.split(".")[-1]] = table
                out[table] = table
                expect = False
            else:
                r.at += 1
    return out


def view_lineage(own: list[Token]) -> list[tuple[str, str]]:
    """(source column, target column) of one CREATE VIEW or CREATE TABLE AS statement, all names with their table."""
    r = _Reader(own)
    if not r.take("CREATE"):
        return []
    while r.peek() in ("OR", "REPLACE", "MATERIALIZED", "FORCE", "GLOBAL", "TEMPORARY"):
        r.at += 1
    if not (r.take("VIEW") or r.take("TABLE")):
        return []
    r.take("IF", "NOT", "EXISTS")
    target = r.name()
    named = r.names() if r.peek() == "(" else []
    if target is None or not r.take("AS"):
        return []
    items, source = _select_parts(r.rest())
    tables = _sources(source)
    only = next(iter(set(tables.values()))) if len(set(tables.values())) == 1 else None
    out = []
    for i, item in enumerate(items):
        cut = len(item)
        if len(item) > 2 and item[-2].up == "AS":
            cut = len(item) - 2
        elif len(item) > 1 and item[-1].kind in ("word", "quoted") and item[-2].text != "." and (item[-2].kind != "mark" or item[-2].text == ")"):
            cut = len(item) - 1
        name = named[i] if i < len(named) else _name(item[-1]) if item[-1].kind in ("word", "quoted") else f"COLUMN_{i + 1}"
        e, seen = _Reader(item[:cut]), []
        while e.at < len(e.own):
            if not e.is_name():
                if e.peek() == "*" and only and len(e.own) == 1:
                    seen.append(f"{only}.*")
                e.at += 1
                continue
            full = e.name()
            if e.peek() == "(":  # a function
                continue
            table, _, column = full.rpartition(".")
            if table and table in tables:
                seen.append(f"{tables[table]}.{column}")
            elif not table and only:
                seen.append(f"{only}.{column}")
        out += [(s, f"{target}.{name}") for s in dict.fromkeys(seen)]
    return out


def lineage(files: DataFrame) -> DataFrame:
    """(src, dst, via, filename) of the views and tables made from queries in (filename, sql)."""
    schema = pa.schema([(n, pa.string()) for n in ("src", "dst", "via", "filename")])

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [
                {"src": s, "dst": d, "via": d.rpartition(".")[0], "filename": f}
                for f, sql in zip(part["filename"].to_pylist(), part["sql"].to_pylist(), strict=True)
                for own in statements(sql)
                for s, d in view_lineage(own)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("filename", "sql").mapInArrow(parse, "src string, dst string, via string, filename string").distinct()
