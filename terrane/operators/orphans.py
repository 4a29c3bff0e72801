"""References to keys that do not exist, by runs of integer keys (problem 4).

Sorted integer parent keys are compressed into contiguous runs, and each distinct reference key is
matched as-of to the last run that starts at or before it: a key beyond that run's end is an orphan.
Texts are read as an integer behind a stem: their last digits, else the code point of their last character.
Each side is so coded by itself, and keys with one stem are matched like integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from terrane.functions.names import norm_name
from terrane.session import cut

BUCKET_BITS = 16  # the key space is cut into buckets of 2^16 keys; a run is cut at their bounds


def key_runs(keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs (*by, bucket, start, end) of the distinct values of the BIGINT column `key` for each value of `by`; null keys are none."""
    k = keys.where("key IS NOT NULL").select(*by, "key").distinct().withColumn("bucket", F.shiftright("key", BUCKET_BITS))
    in_order = W.partitionBy(*by, "bucket").orderBy("key")  # at most 2^16 rows, as keys are distinct
    k = k.withColumn("island", F.col("key") - F.row_number().over(in_order))
    return k.groupBy(*by, "bucket", "island").agg(F.min("key").alias("start"), F.max("key").alias("end")).drop("island")


def orphan_keys(refs: DataFrame, parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The distinct (*by, key) of refs, with a BIGINT `key`, that parents lack; null keys refer to nothing.

    Each bucket is matched by one sorted pass over its run starts and its distinct reference keys, at
    most 2^17 rows whatever the number of references to one key.
    """
    none = F.lit(None).cast("bigint")
    asked = refs.where("key IS NOT NULL").select(*by, "key").distinct()
    asked = asked.select(*by, F.shiftright("key", BUCKET_BITS).alias("bucket"), "key", F.lit(1).alias("asks"), none.alias("end"))
    runs = key_runs(parents, by).select(*by, "bucket", F.col("start").alias("key"), F.lit(0).alias("asks"), "end")
    before = W.partitionBy(*by, "bucket").orderBy("key", "asks").rowsBetween(W.unboundedPreceding, 0)
    matched = runs.unionByName(asked).withColumn("run_end", F.last("end", ignorenulls=True).over(before))
    return matched.where("asks = 1 AND (run_end IS NULL OR key > run_end)").select(*by, "key")


# What the integer of a value is: digits, a character, or none as the value is empty or null.
_DIGITS, _CHARACTER, _EMPTY, _NULL = range(4)


def coded(rows: DataFrame, on: list[str]) -> DataFrame:
    """The columns `on`, the last of them as (`kind`, `stem`, `key`): no two values have the same three.

    Whole numbers are their own keys. Of a text, up to 18 last digits that do not begin with 0 are the key, and what
    is before them the stem; without such digits the last character's code point is.
    """
    *rest, last = on
    c = F.col(last)
    if isinstance(rows.schema[last].dataType, IntegralType):
        kind, stem, key = F.lit(_DIGITS), F.lit(""), c.cast("bigint")
    else:
        c = c.cast("string")
        digits = F.regexp_extract(c, "(0|[1-9][0-9]{0,17})\\z", 1)
        kind = F.when(c == "", _EMPTY).when(digits != "", _DIGITS).otherwise(_CHARACTER)
        stem = F.substring(c, F.lit(1), F.length(c) - F.greatest(F.length(digits), F.lit(1)))
        key = F.when(c == "", 0).when(digits != "", digits.try_cast("bigint")).otherwise(F.ascii(F.right(c, F.lit(1))))
    null = F.col(last).isNull()
    return rows.select(
        *rest, F.when(null, _NULL).otherwise(kind).alias("kind"), F.when(null, "").otherwise(stem).alias("stem"), F.when(null, 0).otherwise(key).cast("bigint").alias("key")
    )


def orphan_values(refs: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """The distinct values of the columns `on` in refs that parents lack; a null is a value like any other.

    The last column is coded as integers; the others and its stem say which keys are matched with which.
    """
    *rest, last = on
    kind = refs.schema[last].dataType
    found = orphan_keys(coded(refs, on), coded(parents, on), [*rest, "kind", "stem"])
    if isinstance(kind, IntegralType):
        value = F.when(F.col("kind") != _NULL, F.col("key")).cast(kind)
    else:
        end = F.when(F.col("kind") == _DIGITS, F.col("key").cast("string")).when(F.col("kind") == _CHARACTER, F.decode(F.unhex(F.lpad(F.hex("key"), 8, "0")), "UTF-32")).otherwise("")
        value = F.when(F.col("kind") != _NULL, F.concat("stem", end))
    return found.select(*rest, value.alias(last))


def references(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """All references to tables: (ref_source, ref_id, name, cols, at), exact repeats once.

    A finding without a table name (null or blank) refers to nothing; a relationship without one refers to
    a table that does not exist. Null or empty `to_cols` name no column.
    """
    rel = changes.select(
        F.lit("relationship_changes").alias("ref_source"),
        F.col("rel_id").alias("ref_id"),
        F.coalesce(norm_name(F.col("to_table")), F.lit("")).alias("name"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("to_cols", F.array().cast("array<string>")), norm_name))).alias("cols"),
        F.col("detected_at").alias("at"),
    )
    found = findings.select(
        F.lit("findings").alias("ref_source"),
        F.col("finding_id").alias("ref_id"),
        norm_name(F.col("table_name")).alias("name"),
        F.array().cast("array<string>").alias("cols"),
        F.col("found_at").alias("at"),
    ).where("name <> ''")
    return rel.unionByName(found).distinct()


def reference_status(changes: DataFrame, findings: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The references that do not hold: (ref_source, ref_id, name, at, status).

    Names and columns compare by `norm_name`. The first that holds is the status: `missing_table`,
    `dropped` (dropped_at <= at), `late` (created_at > at), `missing_column`. A null time is neither
    dropped nor late. Where rows of one table differ in their times, the last drop (none beats any) and
    the first creation count. A null column name is a missing column.
    """
    refs = cut(references(changes, findings), "references")
    owned = tables.select(norm_name(F.col("full_name")).alias("name"), "created_at", "dropped_at").where("name IS NOT NULL")
    owned = owned.groupBy("name").agg(
        F.min("created_at").alias("created_at"),
        F.when(F.bool_and(F.col("dropped_at").isNotNull()), F.max("dropped_at")).alias("dropped_at"),
    )
    owned = cut(owned, "owned")
    have = columns.select(norm_name(F.col("table_name")).alias("scope"), norm_name(F.col("column_name")).alias("item"))
    have = have.where("scope IS NOT NULL AND item IS NOT NULL")
    # Lists of columns are distinct, so a popular key counts once.
    lists = cut(refs.where("size(cols) > 0").select("name", "cols").distinct(), "lists")
    none = F.lit(None).cast("string")
    # Tables are items without a scope, columns are items of their table: one match finds both.
    asked = refs.select(none.alias("scope"), F.col("name").alias("item")).unionByName(lists.select(F.col("name").alias("scope"), F.explode("cols").alias("item")))
    missing = cut(orphan_values(asked, have.unionByName(owned.select(none.alias("scope"), F.col("name").alias("item"))), ["scope", "item"]), "missing")

    bad = lists.select("name", "cols", F.explode("cols").alias("col")).alias("l").join(
        missing.where("scope IS NOT NULL").alias("m"),
        (F.col("l.name") == F.col("m.scope")) & F.col("l.col").eqNullSafe(F.col("m.item")),
        "left_semi",
    )
    bad = bad.select(F.col("name").alias("_bn"), F.col("cols").alias("_bc")).distinct().withColumn("missing_col", F.lit(True))

    # One row per name: its times, or that it is missing. References to a popular name stay where they are
    # if this is small, and adaptive execution splits their partition if it is not.
    time = F.lit(None).cast(refs.schema["at"].dataType)
    facts = owned.select(F.col("name").alias("_n"), F.lit(False).alias("missing"), "created_at", "dropped_at")
    facts = facts.unionByName(missing.where("scope IS NULL").select(F.col("item").alias("_n"), F.lit(True).alias("missing"), time.alias("created_at"), time.alias("dropped_at")))
    joined = refs.join(facts, F.col("name") == F.col("_n"), "left")
    joined = joined.join(bad, (F.col("name") == F.col("_bn")) & (F.col("cols") == F.col("_bc")), "left")
    status: Column = (
        F.when(F.col("missing"), "missing_table")
        .when(F.col("dropped_at") <= F.col("at"), "dropped")
        .when(F.col("created_at") > F.col("at"), "late")
        .when(F.col("missing_col"), "missing_column")
    )
    return joined.select("ref_source", "ref_id", "name", "at", status.alias("status")).where("status IS NOT NULL")


def orphan_counts(statuses: DataFrame) -> DataFrame:
    """Orphan references per referring table, referred table, month and status; a null time has a null month."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return statuses.groupBy("ref_source", F.col("name").alias("table_name"), month, "status").agg(F.count("*").alias("refs"))
