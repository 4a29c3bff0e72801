"""Records that break their contract: strict load, anti-join, diagnosis (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operation kinds an exported record may carry.
OPERATION_KINDS = (
    "CREATE_TABLE",
    "DROP_TABLE",
    "RENAME_TABLE",
    "ADD_COLUMN",
    "DROP_COLUMN",
    "MODIFY_COLUMN",
    "RENAME_COLUMN",
    "ADD_CONSTRAINT",
    "DROP_CONSTRAINT",
    "CREATE_INDEX",
    "DROP_INDEX",
    "CREATE_SEQUENCE",
    "DROP_SEQUENCE",
    "COMMENT",
    "UNKNOWN",
)
# Fields of each record type, in order.
OPERATION_FIELDS = ("kind", "source_file", "version", "statement_index", "operation", "table_name", "raw_sql", "applied_at")
RESULT_FIELDS = ("kind", "filename", "version", "skipped", "errors", "applied_at")

_ESC, _COMMA = "\x01a", "\x01b"
_STRING = "\x01"
_JSON_SPACE = "[ \t\r\n]"


def _body(line: Column) -> Column:
    return F.regexp_replace(F.coalesce(line, F.lit("")), "\r\\z", "")


def _segments(line: Column) -> Column:
    """The line between two commas, cut at its double quotes: outside quotes at even places, inside at odd ones."""
    return F.split(F.concat(F.lit(","), line, F.lit(",")), '"', -1)


def _well_quoted(segments: Column) -> Column:
    """Whether quotes enclose whole fields only.

    The number of quotes is even, and each outer piece starts and ends at a comma; an empty one, between
    two quoted pieces, is a doubled quote. This takes time in proportion to the line, and no backtracking.
    The checks of a piece look at nothing but the piece: an array used inside would be made anew for each.
    """
    fits = F.transform(segments, lambda p, at: (at % 2 == 1) | (p == "") | (p.startswith(",") & p.endswith(",")))
    return (F.size(segments) % 2 == 1) & F.forall(fits, lambda ok: ok)


def _fields(segments: Column) -> Column:
    """The field values of a well quoted line. Commas inside quotes are coded until the others are split at."""

    def coded(p: Column, at: Column) -> Column:
        plain = F.replace(p, F.lit("\x01"), F.lit(_ESC))
        return F.when(at % 2 == 1, F.replace(plain, F.lit(","), F.lit(_COMMA))).when(p == "", F.lit('"')).otherwise(plain)

    joined = F.regexp_replace(F.array_join(F.transform(segments, coded), ""), "^,|,\\z", "")
    return F.transform(
        F.split(joined, ",", -1),
        lambda f: F.replace(F.replace(f, F.lit(_COMMA), F.lit(",")), F.lit(_ESC), F.lit("\x01")),
    )


def _is_version(v: Column) -> Column:
    return v.rlike("^[0-9][0-9._]*\\z") & v.rlike("[0-9]\\z") & ~v.rlike("[._][._]")


def _is_instant(t: Column) -> Column:
    shaped = t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\\z")
    return shaped & ~t.startswith("0000") & F.substring(t, 1, 10).try_cast("date").isNotNull()


def _is_string_list(text: Column) -> Column:
    """Whether `text` is a JSON array that holds strings only (an empty one included)."""
    no_escape = F.regexp_replace(text, r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})', "e")
    marked = F.regexp_replace(no_escape, '"[^"\\\\\\x00-\\x1f]*"', _STRING)
    tight = F.regexp_replace(marked, f"{_JSON_SPACE}*([\\[\\],]){_JSON_SPACE}*", "$1")
    listed = tight.startswith("[" + _STRING) & (F.replace(tight, F.lit("," + _STRING), F.lit("")) == "[" + _STRING + "]")
    return ~text.contains(_STRING) & ((tight == "[]") | listed)


def _value_checks(kind: Column, f: Column) -> Column:
    """Whether the values of a record with the right number of fields are valid."""
    op = (
        (F.get(f, F.lit(1)) != "")
        & _is_version(F.get(f, F.lit(2)))
        & F.get(f, F.lit(3)).rlike("^[0-9]+\\z")
        & F.get(f, F.lit(4)).isin(*OPERATION_KINDS)
        & _is_instant(F.get(f, F.lit(7)))
    )
    res = (F.get(f, F.lit(1)) != "") & _is_version(F.get(f, F.lit(2))) & F.get(f, F.lit(3)).isin("true", "false") & _is_string_list(F.get(f, F.lit(4))) & _is_instant(F.get(f, F.lit(5)))
    return F.coalesce(F.when(kind == "O", op).otherwise(res), F.lit(False))


def _width(kind: Column) -> Column:
    return F.when(kind == "O", len(OPERATION_FIELDS)).when(kind == "R", len(RESULT_FIELDS))


def _offsets(raw: DataFrame, id_col: str, line_col: str) -> DataFrame:
    line = raw[line_col]
    return raw.select(raw[id_col].alias("line_id"), F.xxhash64(line).alias("_h"), _body(line).alias("_body"))


def strict_load(raw: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """The conforming records, each with its offset (`line_id`, `_h`), its `kind` and its `fields`."""
    rows = _offsets(raw, id_col, line_col).withColumn("_s", _segments(F.col("_body"))).where(_well_quoted(F.col("_s")))
    rows = rows.select("line_id", "_h", _fields(F.col("_s")).alias("fields"))
    rows = rows.withColumn("kind", F.get("fields", F.lit(0))).where(F.size("fields") == _width(F.col("kind")))
    return rows.where(_value_checks(F.col("kind"), F.col("fields")))


def load_operations(raw: DataFrame, **cols: str) -> DataFrame:
    """Valid operation records as typed rows. An index above 38 digits becomes null; empty raw_sql stays ''."""
    f = F.col("fields")
    return strict_load(raw, **cols).where("kind = 'O'").select(
        "line_id",
        F.get(f, F.lit(1)).alias("source_file"),
        F.get(f, F.lit(2)).alias("version"),
        F.get(f, F.lit(3)).try_cast("decimal(38,0)").alias("statement_index"),
        F.get(f, F.lit(4)).alias("operation"),
        F.get(f, F.lit(5)).alias("table_name"),
        F.get(f, F.lit(6)).alias("raw_sql"),
        F.rtrim(F.regexp_replace(F.get(f, F.lit(7)), "[TZ]", " ")).cast("timestamp_ntz").alias("applied_at"),
    )


def load_results(raw: DataFrame, **cols: str) -> DataFrame:
    """Valid migration results as typed rows."""
    f = F.col("fields")
    return strict_load(raw, **cols).where("kind = 'R'").select(
        "line_id",
        F.get(f, F.lit(1)).alias("filename"),
        F.get(f, F.lit(2)).alias("version"),
        (F.get(f, F.lit(3)) == "true").alias("skipped"),
        F.from_json(F.get(f, F.lit(4)), "array<string>").alias("errors"),
        F.rtrim(F.regexp_replace(F.get(f, F.lit(5)), "[TZ]", " ")).cast("timestamp_ntz").alias("applied_at"),
    )


def rejected(raw: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """Each record that breaks the contract: `line_id`, `reason` and the `line` as it came.

    The offsets of the strictly loaded records are subtracted from all offsets (only these numbers are
    shuffled, not the lines), and only what remains is fetched again and diagnosed. An offset is the id
    with a hash of the line, compared null-safely: rows with a null or repeated id are each judged by
    their own line, and exact repeats give one row. A null or empty line has an empty first field, so
    it is an `invalid_value`. An empty table gives no rows.
    """
    everything = _offsets(raw, id_col, line_col).select("line_id", "_h").distinct()
    loaded = strict_load(raw, id_col, line_col).select(F.col("line_id").alias("_id"), F.col("_h").alias("_lh"))
    remain = everything.join(loaded, F.col("line_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_lh")), "left_anti")
    remain = remain.select(F.col("line_id").alias("_id"), F.col("_h").alias("_lh"))
    lines = raw.select(raw[id_col].alias("line_id"), F.xxhash64(raw[line_col]).alias("_h"), raw[line_col].alias("line"))
    lines = lines.join(remain, F.col("line_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_lh")), "left_semi")

    lines = lines.withColumn("_s", _segments(_body(F.col("line")))).withColumn("_ok", _well_quoted(F.col("_s")))
    lines = lines.withColumn("_f", F.when(F.col("_ok"), _fields(F.col("_s")))).withColumn("_k", F.get("_f", F.lit(0)))
    reason = (
        F.when(~F.col("_ok"), "quoting")
        .when(~F.col("_k").isin("O", "R"), "invalid_value")
        .when(F.size("_f") != _width(F.col("_k")), "column_count")
        .otherwise("invalid_value")
    )
    return lines.select("line_id", reason.alias("reason"), "line").distinct()
