"""Statements to operations: one row for each change that a statement makes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.ddl.tokens import Token, bracket, split_top, statements, text_of
from terrane.functions.names import version_key
from terrane.functions.versions import file_kind, file_version

_FIELDS = {
    "operation": "string",
    "table_name": "string",
    "target": "string",
    "new_name": "string",
    "data_type": "string",
    "nullable": "boolean",
    "default_expr": "string",
    "is_pk": "boolean",
    "is_unique": "boolean",
    "constraint_type": "string",
    "columns": "array<string>",
    "ref_table": "string",
    "ref_columns": "array<string>",
    "on_delete": "string",
    "check_expr": "string",
    "comment": "string",
    "guarded": "boolean",
    "start_with": "bigint",
    "increment_by": "bigint",
}
OPS = "filename string, stmt_idx int, op_idx int, raw_sql string, " + ", ".join(f"{k} {v}" for k, v in _FIELDS.items())

# Other first words, as operations.
_PLAIN = {"INSERT": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE", "TRUNCATE": "TRUNCATE", "MERGE": "MERGE"}
_ENDS_DEFAULT = {"NOT", "NULL", "CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES", "GENERATED", "ENABLE", "DISABLE", "COMMENT"}
_ENDS_TYPE = _ENDS_DEFAULT | {"DEFAULT", "AUTO_INCREMENT", "COLLATE"}


def _name(t: Token) -> str:
    return (t.text[1:-1] if t.kind == "quoted" else t.text).upper()


class _Reader:
    """A place in a statement's tokens."""

    def __init__(self, own: list[Token], at: int = 0):
        self.own, self.at = own, at

    def peek(self, n: int = 0) -> str:
        i = self.at + n
        return self.own[i].up if i < len(self.own) else ""

    def take(self, *words: str) -> bool:
        """Step over these words if they come next."""
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def is_name(self) -> bool:
        return self.at < len(self.own) and self.own[self.at].kind in ("word", "quoted")

    def name(self) -> str | None:
        """A dotted name."""
        if not self.is_name():
            return None
        parts = [_name(self.own[self.at])]
        self.at += 1
        while self.peek() == "." and self.at + 1 < len(self.own) and self.own[self.at + 1].kind in ("word", "quoted"):
            parts.append(_name(self.own[self.at + 1]))
            self.at += 2
        return ".".join(parts)

    def inside(self) -> list[Token]:
        """The tokens in the bracket that comes next, which is stepped over."""
        if self.peek() != "(":
            return []
        end = bracket(self.own, self.at)
        out = self.own[self.at + 1 : end - 1]
        self.at = end
        return out

    def names(self) -> list[str]:
        """Names in a bracket, without ASC and DESC."""
        return [_name(p[0]) for p in split_top(self.inside()) if p[0].kind in ("word", "quoted")]

    def rest(self) -> list[Token]:
        return self.own[self.at :]


def _references(r: _Reader) -> dict:
    out = {"ref_table": r.name(), "ref_columns": r.names(), "on_delete": None}
    if r.take("ON", "DELETE"):
        word = r.peek()
        r.at += 1
        if word in ("SET", "NO"):
            word += "_" + r.peek()
            r.at += 1
        out["on_delete"] = word
    return out


def _constraint(sql: str, own: list[Token]) -> dict | None:
    r = _Reader(own)
    name = None
    if r.take("CONSTRAINT"):
        name = r.name()
    if r.take("PRIMARY", "KEY"):
        return {"target": name, "constraint_type": "primary_key", "columns": r.names()}
    if r.take("FOREIGN", "KEY"):
        cols = r.names()
        return {"target": name, "constraint_type": "foreign_key", "columns": cols} | (_references(r) if r.take("REFERENCES") else {})
    if r.take("UNIQUE"):
        r.take("KEY")
        return {"target": name, "constraint_type": "unique", "columns": r.names()}
    if r.take("CHECK"):
        return {"target": name, "constraint_type": "check", "columns": [], "check_expr": text_of(sql, r.inside())}
    return None


def _column(sql: str, own: list[Token]) -> tuple[dict | None, list[dict]]:
    """A column and the constraints written with it; None where there is no column."""
    r = _Reader(own)
    if not r.is_name():
        return None, []
    col = {"target": _name(own[0]), "data_type": None, "nullable": None, "default_expr": None, "is_pk": False, "is_unique": False}
    r.at = 1
    start = r.at
    while r.at < len(own) and r.peek() not in _ENDS_TYPE:
        r.at = bracket(own, r.at) if r.peek() == "(" else r.at + 1
    if r.at > start:
        kind = text_of(sql, own[start : r.at]).upper()
        col["data_type"] = "".join(kind.split()) if "(" in kind else " ".join(kind.split())
    cons = []
    while r.at < len(own):
        if r.take("NOT", "NULL"):
            col["nullable"] = False
        elif r.take("NULL"):
            col["nullable"] = True if col["nullable"] is None else col["nullable"]
        elif r.take("DEFAULT"):
            first = r.at
            while r.at < len(own) and (r.at == first or r.peek() not in _ENDS_DEFAULT):
                r.at = bracket(own, r.at) if r.peek() == "(" else r.at + 1
            col["default_expr"] = text_of(sql, own[first : r.at])
        elif r.take("PRIMARY", "KEY"):
            col["is_pk"] = True
        elif r.take("UNIQUE"):
            col["is_unique"] = True
        elif r.take("REFERENCES"):
            cons.append({"target": None, "constraint_type": "foreign_key", "columns": [col["target"]]} | _references(r))
        else:
            r.at = bracket(own, r.at) if r.peek() == "(" else r.at + 1
    return col, cons


def _is_constraint(own: list[Token]) -> bool:
    return own[0].up in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK") and own[0].kind == "word"


def _definitions(sql: str, parts: list[list[Token]], table: str, operation: str) -> list[dict]:
    out, later = [], []
    for p in parts:
        if _is_constraint(p):
            c = _constraint(sql, p)
            later += [{"operation": "ADD_CONSTRAINT"} | c] if c else []
            continue
        col, cons = _column(sql, p)
        if col:
            out.append({"operation": operation} | col)
            later += [{"operation": "ADD_CONSTRAINT"} | c for c in cons]
    return [{"table_name": table} | x for x in out + later]


def _create(sql: str, r: _Reader) -> list[dict]:
    r.take("OR", "REPLACE")
    while r.peek() in ("GLOBAL", "TEMPORARY", "MATERIALIZED", "PUBLIC", "EDITIONABLE", "PRIVATE"):
        r.at += 1
    unique = r.take("UNIQUE") or r.take("BITMAP") and False
    if r.take("TABLE"):
        guarded = r.take("IF", "NOT", "EXISTS")
        table = r.name()
        if table is None:
            return []
        parts = split_top(r.inside())
        head = {"operation": "CREATE_TABLE", "table_name": table, "guarded": guarded}
        rows = _definitions(sql, parts, table, "CREATE_COLUMN")
        short = table.split(".")[-1]
        keys = [x["target"] for x in rows if x["operation"] == "CREATE_COLUMN" and x.get("is_pk")]
        if keys:
            rows.append({"operation": "ADD_CONSTRAINT", "table_name": table, "target": f"PK_{short}", "constraint_type": "primary_key", "columns": keys})
        # What follows in a CREATE belongs to it: it is applied, or passed over, with it.
        return [head] + [x | {"guarded": guarded, "comment": "inline"} for x in rows]
    if r.take("INDEX"):
        r.take("CONCURRENTLY")
        r.take("IF", "NOT", "EXISTS")
        name = r.name()
        if r.take("ON"):
            table = r.name()
            if r.take("USING"):
                r.at += 1
            return [{"operation": "CREATE_INDEX", "table_name": table, "target": name and name.split(".")[-1], "columns": r.names(), "is_unique": bool(unique)}]
        return []
    if r.take("SEQUENCE"):
        r.take("IF", "NOT", "EXISTS")
        row = {"operation": "CREATE_SEQUENCE", "target": r.name(), "start_with": 1, "increment_by": 1}
        while r.at < len(r.own):
            for words, key in ((("START", "WITH"), "start_with"), (("INCREMENT", "BY"), "increment_by"), (("START",), "start_with"), (("INCREMENT",), "increment_by")):
                if r.take(*words):
                    sign = -1 if r.take("-") else 1
                    row[key] = sign * int(r.peek()) if r.peek().isdigit() else row[key]
                    break
            else:
                r.at += 1
        return [row]
    kind = r.peek()
    r.at += 1
    if kind == "PACKAGE":
        r.take("BODY")
    return [{"operation": f"CREATE_{kind}", "target": r.name()}] if kind in ("VIEW", "TRIGGER", "PROCEDURE", "FUNCTION", "PACKAGE", "SYNONYM", "TYPE") else []


def _alter(sql: str, r: _Reader) -> list[dict]:
    if not r.take("TABLE"):
        return []
    r.take("IF", "EXISTS")
    table = r.name()
    if table is None:
        return []
    out: list[dict] = []
    while r.at < len(r.own):
        if r.take(","):
            continue
        if r.take("ADD"):
            r.take("COLUMN")
            r.take("IF", "NOT", "EXISTS")
            parts = split_top(r.inside()) if r.peek() == "(" else None
            if parts is None:
                parts = split_top(r.rest())
                first = parts[0] if parts else []
                r.at += next((i for i in range(len(r.rest())) if r.rest()[i].text == "," and first and r.rest()[i].start >= first[-1].stop), len(r.rest()))
                parts = [first] if first else []
            out += _definitions(sql, parts, table, "ADD_COLUMN")
        elif r.take("MODIFY") or r.take("ALTER", "COLUMN"):
            r.take("COLUMN")
            parts = split_top(r.inside()) if r.peek() == "(" else [r.rest()]
            r.at = r.at if r.at and r.own[r.at - 1].text == ")" and parts and parts[-1] is not r.rest() and r.own[r.at - 1].start > parts[-1][-1].start else len(r.own)
            for p in parts:
                p = [t for t in p if not (t.kind == "word" and t.up == "TYPE" and p.index(t) == 1)]
                col, _ = _column(sql, p)
                if col:
                    out.append({"operation": "MODIFY_COLUMN", "table_name": table} | col)
        elif r.take("DROP", "CONSTRAINT"):
            r.take("IF", "EXISTS")
            out.append({"operation": "DROP_CONSTRAINT", "table_name": table, "target": r.name()})
            r.take("CASCADE")
        elif r.take("DROP", "PRIMARY", "KEY"):
            out.append({"operation": "DROP_CONSTRAINT", "table_name": table, "constraint_type": "primary_key"})
        elif r.take("DROP", "INDEX"):
            out.append({"operation": "DROP_INDEX", "table_name": table, "target": r.name()})
        elif r.take("DROP"):
            r.take("COLUMN")
            r.take("IF", "EXISTS")
            names = r.names() if r.peek() == "(" else [r.name()]
            out += [{"operation": "DROP_COLUMN", "table_name": table, "target": n} for n in names if n]
            r.take("CASCADE", "CONSTRAINTS")
        elif r.take("RENAME", "COLUMN"):
            old = r.name()
            r.take("TO")
            out.append({"operation": "RENAME_COLUMN", "table_name": table, "target": old, "new_name": r.name()})
        elif r.take("RENAME", "TO"):
            out.append({"operation": "RENAME_TABLE", "table_name": table, "new_name": r.name()})
        else:
            r.at += 1
    return out


def operations(sql: str, own: list[Token]) -> list[dict]:
    """The operations of one statement, in order; one UNKNOWN where nothing is known of it."""
    r = _Reader(own)
    if r.take("CREATE"):
        out = _create(sql, r)
    elif r.take("ALTER"):
        out = _alter(sql, r)
    elif r.take("DROP"):
        r.take("PUBLIC")
        r.take("MATERIALIZED")
        kind = r.peek()
        r.at += 1
        guarded = r.take("IF", "EXISTS")
        name = r.name()
        if kind == "TABLE":
            out = [{"operation": "DROP_TABLE", "table_name": name, "guarded": guarded}]
        elif kind == "INDEX":
            out = [{"operation": "DROP_INDEX", "target": name and name.split(".")[-1]}]
        else:
            out = [{"operation": f"DROP_{kind}", "target": name}] if name else []
    elif r.take("COMMENT", "ON"):
        kind = r.peek()
        r.at += 1
        name = r.name() or ""
        text = r.rest()[-1].text if r.take("IS") and r.rest() else ""
        text = text[1:-1].replace("''", "'") if text.startswith("'") else None
        table, _, col = name.rpartition(".") if kind == "COLUMN" else (name, "", None)
        out = [{"operation": "COMMENT", "table_name": table, "target": col, "comment": text}]
    elif r.take("RENAME"):
        old = r.name()
        out = [{"operation": "RENAME_TABLE", "table_name": old, "new_name": r.name()}] if r.take("TO") else []
    elif r.peek() in _PLAIN:
        kind = _PLAIN[r.peek()]
        r.at += 1
        for w in ("INTO", "FROM", "TABLE", "ONLY"):
            r.take(w)
        out = [{"operation": kind, "table_name": r.name()}]
    else:
        out = []
    return out or [{"operation": "UNKNOWN"}]


def _rows(filename: str, sql: str | None) -> Iterator[dict]:
    for i, own in enumerate(statements(sql)):
        raw = text_of(sql, own)
        for k, op in enumerate(operations(sql, own)):
            yield {"filename": filename, "stmt_idx": i, "op_idx": k, "raw_sql": raw} | op


def split(files: DataFrame) -> DataFrame:
    """The statements of (filename, sql): (filename, stmt_idx, raw_sql), without their ends. Null texts give none."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(f, i, text_of(s, own)) for f, s in zip(part["filename"].to_pylist(), part["sql"].to_pylist(), strict=True) for i, own in enumerate(statements(s))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int32(), pa.string()), strict=True)], ["filename", "stmt_idx", "raw_sql"])

    return files.select("filename", "sql").mapInArrow(cut, "filename string, stmt_idx int, raw_sql string")


def extract(files: DataFrame) -> DataFrame:
    """Operations of (filename, sql): one pass in Python over the texts. Null texts give none; a file that comes twice counts once."""

    arrow = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, arrow[kind]) for name, kind in (x.split(" ") for x in OPS.split(", "))])

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [x for f, s in zip(part["filename"].to_pylist(), part["sql"].to_pylist(), strict=True) for x in _rows(f, s)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("filename", "sql").mapInArrow(parse, OPS)


def migration_ops(files: DataFrame) -> DataFrame:
    """Operations of migration files with `version` and the order of the log; rollback files are passed over.

    Files without a version come first, files of one version in the order of their names.
    """
    f = F.col("filename")
    forward = files.dropDuplicates(["filename"]).where(file_kind(f) != "rollback")
    return extract(forward).withColumn("version", file_version(f)).withColumn("file_key", version_key(F.col("version")))
