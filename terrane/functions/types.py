"""SQL types of four dialects as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each dialect's types and the canonical ones.
TYPE_MAPS = {
    "oracle": {"VARCHAR2": "VARCHAR", "NUMBER": "NUMERIC", "NVARCHAR2": "NVARCHAR", "NCHAR": "NCHAR", "LONG": "TEXT", "RAW": "BINARY"},
    "postgres": {
        "SERIAL": "INTEGER",
        "BIGSERIAL": "BIGINT",
        "SMALLSERIAL": "SMALLINT",
        "TEXT": "VARCHAR",
        "BYTEA": "BINARY",
        "BOOL": "BOOLEAN",
        "INT": "INTEGER",
        "INT2": "SMALLINT",
        "INT4": "INTEGER",
        "INT8": "BIGINT",
        "FLOAT4": "REAL",
        "FLOAT8": "DOUBLE PRECISION",
    },
    "mysql": {
        "TINYINT": "SMALLINT",
        "MEDIUMINT": "INTEGER",
        "INT": "INTEGER",
        "BIGINT": "BIGINT",
        "DATETIME": "TIMESTAMP",
        "TINYTEXT": "VARCHAR",
        "MEDIUMTEXT": "TEXT",
        "LONGTEXT": "TEXT",
        "TINYBLOB": "BINARY",
        "MEDIUMBLOB": "BINARY",
        "LONGBLOB": "BINARY",
        "DOUBLE": "DOUBLE PRECISION",
    },
    "sqlite": {"TEXT": "VARCHAR", "REAL": "FLOAT", "BLOB": "BINARY", "INT": "INTEGER"},
}
ALIASES = {"postgresql": "postgres"}


def canonical_type(data_type: Column, dialect: str) -> Column:
    """A type under its canonical name, with its length; serial types lose theirs. What begins with no name stays."""
    dialect = ALIASES.get(dialect.lower(), dialect.lower())
    if dialect not in TYPE_MAPS:
        raise ValueError(f"unknown dialect {dialect}; known are {', '.join(sorted([*TYPE_MAPS, *ALIASES]))}")
    base = F.regexp_extract(F.upper(data_type), "^([A-Z][A-Z0-9_]*)", 1)
    known = F.create_map(*(F.lit(x) for pair in TYPE_MAPS[dialect].items() for x in pair))
    length = F.when(base.endswith("SERIAL") & F.lit(dialect == "postgres"), "").otherwise(F.regexp_extract(data_type, r"(\(.*\))", 1))
    return F.when(base == "", data_type).otherwise(F.concat(F.coalesce(F.try_element_at(known, base), base), length))


def is_auto_increment(definition: Column, dialect: str) -> Column:
    up = F.upper(definition)
    identity = up.contains("GENERATED") & up.contains("IDENTITY")
    dialect = ALIASES.get(dialect.lower(), dialect.lower())
    return {
        "oracle": identity,
        "postgres": up.contains("SERIAL") | identity,
        "mysql": up.contains("AUTO_INCREMENT"),
        "sqlite": up.contains("INTEGER") & up.contains("PRIMARY KEY") & up.contains("AUTOINCREMENT"),
    }[dialect]


def render_type(base: Column, precision: Column, scale: Column) -> Column:
    """T, T(p) or T(p,s)."""
    inner = F.when(scale.isNotNull(), F.concat_ws(",", precision.cast("string"), scale.cast("string"))).otherwise(precision.cast("string"))
    return F.when(precision.isNull(), base).otherwise(F.concat(base, F.lit("("), inner, F.lit(")")))
