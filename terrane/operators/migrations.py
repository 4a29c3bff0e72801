"""Migration files as a graph: what each creates and changes, and which others it depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.names import norm_name
from terrane.functions.versions import file_description
from terrane.operators.numbering import numbered
from terrane.operators.rules import creator_dependencies

# Colours of a migration that creates, one that changes, and any other.
COLOURS = ("lightgreen", "lightyellow", "lightblue")


def nodes(ops: DataFrame) -> DataFrame:
    """(source_file, version, description, creates, alters) of each file of a log; the lists are distinct names in order.

    The version is the least that the file's statements carry, as text. Names of a file are gathered in one row, as the file itself is.
    """
    named = F.when(F.col("table_name").isNotNull(), norm_name(F.col("table_name")))
    creates = F.col("operation") == "CREATE_TABLE"
    changes = F.col("operation").isin("ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN", "ADD_CONSTRAINT", "DROP_TABLE", "CREATE_INDEX")
    by = ops.groupBy("source_file").agg(
        F.min("version").alias("version"), F.array_sort(F.collect_set(F.when(creates, named))).alias("creates"), F.array_sort(F.collect_set(F.when(changes, named))).alias("alters")
    )
    return by.select("source_file", "version", file_description(F.col("source_file")).alias("description"), "creates", "alters")


def edges(ops: DataFrame) -> DataFrame:
    """(source_file, depends_on): each file depends on those that created, last of all, the tables it changes."""
    return creator_dependencies(ops).select("source_file", "depends_on")


def timeline(files: DataFrame) -> DataFrame:
    """`nodes` with their place, from 0, by version as text (so V10 comes before V2), then by file."""
    return numbered(files, [], ["version", "source_file"])


def dot_lines(files: DataFrame, links: DataFrame, circular: DataFrame | None = None, critical: DataFrame | None = None) -> DataFrame:
    """(part, source_file, line) of a Graphviz graph: files (part 0) and what they depend on (part 1).

    Files of `circular` (source_file) are salmon, of `critical` gold; others are coloured by what they do.
    """
    made, changed, other = COLOURS
    colour = F.when(F.size("creates") > 0, made).when(F.size("alters") > 0, changed).otherwise(other)
    rows = files.withColumn("colour", colour)
    for marked, name in ((critical, "gold"), (circular, "salmon")):
        if marked is not None:
            m = marked.select(F.col("source_file").alias("_m")).distinct()
            rows = rows.join(m, F.col("source_file") == F.col("_m"), "left").withColumn("colour", F.when(F.col("_m").isNotNull(), name).otherwise(F.col("colour"))).drop("_m")
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    node = F.concat(F.lit('  "'), quoted(F.col("source_file")), F.lit('" [label="'), quoted(F.concat_ws("\\n", "version", "description")), F.lit('", fillcolor='), "colour", F.lit(', style="filled,rounded"];'))
    edge = F.concat(F.lit('  "'), quoted(F.col("source_file")), F.lit('" -> "'), quoted(F.col("depends_on")), F.lit('";'))
    return rows.select(F.lit(0).alias("part"), "source_file", node.alias("line")).unionByName(links.select(F.lit(1).alias("part"), "source_file", edge.alias("line")))
