"""Rows as text: CSV, JSON, Graphviz, Mermaid, and a grid for drawing tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.numbering import numbered


def csv_line(*cells: str | Column) -> Column:
    """Every cell quoted, quotes doubled, null as empty."""
    shown = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells]
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in shown))


def json_line(*cells: str) -> Column:
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def identifier(name: Column) -> Column:
    """A name as an identifier of diagram languages."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def dot_edges(relationships: DataFrame) -> DataFrame:
    line = F.concat(F.lit("  "), identifier(F.col("from_table")), F.lit(" -> "), identifier(F.col("to_table")), F.lit(' [label="'), F.array_join("from_cols", ", "), F.lit('"];'))
    return relationships.where("to_table IS NOT NULL").select(F.col("from_table").alias("source"), line.alias("line"))


def mermaid_edges(relationships: DataFrame) -> DataFrame:
    """Crow's feet by cardinality."""
    foot = F.when(F.col("cardinality") == "one_to_one", "||--||").otherwise("}o--||")
    line = F.concat(F.lit("    "), identifier(F.col("from_table")), F.lit(" "), foot, F.lit(" "), identifier(F.col("to_table")), F.lit(' : "'), F.array_join("from_cols", ", "), F.lit('"'))
    return relationships.where("to_table IS NOT NULL").select(F.col("from_table").alias("source"), line.alias("line"))


def grid(tables: DataFrame, columns: int = 3, width: int = 320, height: int = 240) -> DataFrame:
    """(full_name, x, y): tables of each schema in name order on a grid of `columns` columns."""
    at = F.col("place")
    rows = numbered(tables.select("schema_name", "full_name"), ["schema_name"], ["full_name"])
    return rows.select("schema_name", "full_name", (F.pmod(at, F.lit(columns)) * width).cast("int").alias("x"), (F.floor(at / columns) * height).cast("int").alias("y"))
