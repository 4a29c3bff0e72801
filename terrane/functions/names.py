"""Identifiers and versions as the migration log writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(name: Column) -> Column:
    """Without double quotes and outer blanks, upper-cased. Null stays null."""
    return F.upper(F.btrim(F.replace(name, F.lit('"'), F.lit("")), F.lit(" \t\r\n")))


def version_key(version: Column) -> Column:
    """A string that sorts as the version does: part by part as numbers, missing parts as 0.

    Each part is its digit count (three places) and its digits without leading zeros, so parts of any
    length compare as numbers; trailing zero parts go. A null or empty version sorts first. Anything
    but digits and the separators `.` and `_` is passed over.
    """
    parts = F.split(F.regexp_replace(F.coalesce(version, F.lit("")), "[^0-9._]", ""), "[._]")
    digits = F.transform(parts, lambda p: F.ltrim(p, F.lit("0")))
    coded = F.transform(digits, lambda d: F.concat(F.lpad(F.length(d).cast("string"), 3, "0"), d))
    places = F.transform(coded, lambda p, i: F.when(p != "000", i + 1).otherwise(0))
    return F.array_join(F.slice(coded, F.lit(1), F.array_max(places)), ".")


def sequence_key(version: Column, statement_index: Column) -> Column:
    """The place of a statement in the whole log, as a string in sort order."""
    index = F.lpad((F.coalesce(statement_index.cast("long"), F.lit(-(2**31))) + F.lit(2**31)).cast("string"), 10, "0")
    return F.concat(version_key(version), F.lit(" "), index)


def domain_prefix(table: Column) -> Column:
    """The word of a table's name that tells its domain, upper-cased: the last but one of a name with schema, else the first; null if it has one word only."""
    words = F.split(F.replace(table, F.lit("."), F.lit("_")), "_")
    return F.when(F.size(words) > 1, F.upper(F.when(table.contains("."), F.element_at(words, -2)).otherwise(F.get(words, F.lit(0)))))
