"""Migration file names and versions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file name grammar (kind letter, version, description) and a version's four weights.
FILE_PATTERN = r"^([VUR])([0-9][0-9._]*)?__(.+?)(\.sql)?$"
PR_PATTERNS = (r"merge pull request #(\d+)", r"pull request #(\d+)", r"\bpr #?(\d+)\b", r"merge branch 'refs/pull/(\d+)/merge'", r"merge branch 'pr/(\d+)'")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_kind(path: Column) -> Column:
    """versioned, rollback, repeatable or unknown."""
    kind = F.regexp_extract(base_name(path), FILE_PATTERN, 1)
    version = F.regexp_extract(base_name(path), FILE_PATTERN, 2)
    return (
        F.when((kind == "V") & (version != ""), "versioned")
        .when((kind == "U") & (version != ""), "rollback")
        .when((kind == "R") & (version == ""), "repeatable")
        .otherwise("unknown")
    )


def file_version(path: Column) -> Column:
    """The version part of a file name, or '0' where there is none."""
    v = F.regexp_extract(base_name(path), FILE_PATTERN, 2)
    return F.when(v == "", F.lit("0")).otherwise(v)


def file_description(path: Column) -> Column:
    """The description with blanks for underscores."""
    return F.replace(F.regexp_extract(base_name(path), FILE_PATTERN, 3), F.lit("_"), F.lit(" "))


def version_order(version: Column) -> Column:
    """The order number: each part times 1000^3, 1000^2, 1000, 1, and so on in fractions; wide enough for 14-digit versions."""
    parts = F.filter(F.split(version, "[._]"), lambda p: p != "")
    places = F.transform(parts, lambda p, i: p.try_cast("decimal(20,0)") * F.pow(F.lit(1000.0), F.lit(3) - i).cast("decimal(16,6)"))
    return F.aggregate(places, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)"))


def next_version(version: Column) -> Column:
    """The version after: a whole number plus 1, a dotted one with its last part plus 1, else with .1 behind it."""
    last = F.element_at(F.split(version, "[.]"), -1)
    head = F.substring(version, F.lit(1), F.length(version) - F.length(last))
    up = (last.try_cast("decimal(38,0)") + 1).cast("string")
    return F.when(version.rlike("^[0-9]+([.][0-9]+)*\\z"), F.concat(head, up)).otherwise(F.concat(version, F.lit(".1")))


def version_instant(version: Column) -> Column:
    """The time a 14-digit version stands for, else null."""
    return F.when(version.rlike("^[0-9]{14}\\z"), F.try_to_timestamp(version, F.lit("yyyyMMddHHmmss")))


def pr_number(message: Column) -> Column:
    """The number of the pull request a commit message names; the first pattern that matches tells."""
    found = [F.nullif(F.regexp_extract(message, f"(?i){p}", 1), F.lit("")) for p in PR_PATTERNS]
    return F.coalesce(*found)
