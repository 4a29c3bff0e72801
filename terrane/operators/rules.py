"""Rules over single statements and files: kinds, risk, cost, rollback, names, order, personal data, lint."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.names import sequence_key, version_key
from terrane.functions.versions import base_name, file_description, file_kind, file_version
from terrane.operators.numbering import numbered
from terrane.session import cut

LEVELS = ("SAFE", "MEDIUM_RISK", "HIGH_RISK", "DANGEROUS")


@dataclass(frozen=True)
class Rule:
    """What a kind of statement is. `pattern` is matched against the upper-cased statement with single blanks."""

    kind: str
    pattern: str
    category: str
    level: str
    weight: int
    penalty: int | None  # of its rollback; None: it cannot be rolled back
    unless: str = ""  # a pattern that must not match


# Statement kinds in the order they are tried, with category, risk level, cost weight and rollback penalty.
RULES = (
    Rule("CREATE TABLE AS SELECT", r"^CREATE (GLOBAL |TEMPORARY )*TABLE .* AS SELECT\b", "table_creation", "SAFE", 60, 10),
    Rule("CREATE TABLE", r"^CREATE (GLOBAL |TEMPORARY )*TABLE\b", "table_creation", "SAFE", 20, 10),
    Rule("CREATE INDEX CONCURRENTLY", r"^CREATE (UNIQUE )?INDEX CONCURRENTLY\b", "index_management", "SAFE", 20, 5),
    Rule("CREATE INDEX", r"^CREATE (UNIQUE )?INDEX\b", "index_management", "MEDIUM_RISK", 40, 5),
    Rule("CREATE SEQUENCE", r"^CREATE SEQUENCE\b", "mixed", "SAFE", 10, 10),
    Rule("CREATE PROC/VIEW", r"^CREATE (OR REPLACE )?(MATERIALIZED )?(VIEW|TRIGGER|PROCEDURE|FUNCTION|PACKAGE)\b", "view_trigger_procedure", "SAFE", 5, 0),
    Rule("DROP TABLE", r"^DROP TABLE\b", "cleanup", "DANGEROUS", 10, None),
    Rule("DROP VIEW", r"^DROP (MATERIALIZED )?VIEW\b", "cleanup", "HIGH_RISK", 10, None),
    Rule("DROP INDEX", r"^DROP INDEX\b", "index_management", "MEDIUM_RISK", 5, 5),
    Rule("DROP", r"^DROP\b", "cleanup", "MEDIUM_RISK", 10, None),
    Rule("DROP COLUMN", r"^ALTER TABLE .* DROP (COLUMN |\()", "column_removal", "HIGH_RISK", 70, None),
    Rule("DROP CONSTRAINT", r"^ALTER TABLE .* DROP (CONSTRAINT|PRIMARY KEY|UNIQUE|FOREIGN KEY)\b", "constraint_modification", "MEDIUM_RISK", 30, 5),
    Rule("ADD CONSTRAINT", r"^ALTER TABLE .* ADD (CONSTRAINT|PRIMARY KEY|FOREIGN KEY|UNIQUE|CHECK)\b", "constraint_modification", "MEDIUM_RISK", 60, 5),
    Rule("ADD COLUMN NOT NULL", r"^ALTER TABLE .* ADD\b.* NOT NULL\b", "column_addition", "HIGH_RISK", 80, 15, r"\bDEFAULT\b"),
    Rule("ADD COLUMN", r"^ALTER TABLE .* ADD\b", "column_addition", "SAFE", 10, 15),
    Rule("MODIFY COLUMN", r"^ALTER TABLE .* (MODIFY|ALTER COLUMN)\b", "constraint_modification", "HIGH_RISK", 80, None),
    Rule("RENAME", r"^(ALTER TABLE .* )?RENAME\b", "refactor", "MEDIUM_RISK", 30, 0),
    Rule("COMMENT", r"^COMMENT ON\b", "mixed", "SAFE", 10, 0),
    Rule("INSERT ... SELECT", r"^INSERT INTO .*\bSELECT\b", "data_migration", "SAFE", 60, None),
    Rule("INSERT", r"^INSERT\b", "data_migration", "SAFE", 10, None),
    Rule("DELETE (where)", r"^DELETE\b.* WHERE\b", "data_migration", "HIGH_RISK", 50, None),
    Rule("DELETE (no where)", r"^DELETE\b", "data_migration", "DANGEROUS", 90, None),
    Rule("UPDATE (where)", r"^UPDATE\b.* WHERE\b", "data_migration", "HIGH_RISK", 50, None),
    Rule("UPDATE (no where)", r"^UPDATE\b", "data_migration", "DANGEROUS", 90, None),
    Rule("TRUNCATE", r"^TRUNCATE\b", "data_migration", "DANGEROUS", 80, None),
    Rule("MERGE", r"^MERGE\b", "data_migration", "MEDIUM_RISK", 90, None),
)
OTHER = Rule("UNCLASSIFIED", "", "mixed", "MEDIUM_RISK", 30, 0)

# Categories by priority, and their risk.
CATEGORIES = {
    "data_migration": "high",
    "cleanup": "high",
    "column_removal": "high",
    "table_creation": "medium",
    "constraint_modification": "medium",
    "refactor": "medium",
    "view_trigger_procedure": "medium",
    "column_addition": "low",
    "index_management": "low",
    "mixed": "medium",
}
RISKS = ("low", "medium", "high")

# Weight profiles; the first fragment found in the lower-cased kind tells the factor, '*' is for the rest.
PROFILES = {
    "default": {"*": 1.0},
    "plsql": {"create proc/view": 0.1, "unclassified": 0.2, "command": 0.2, "insert ... select": 0.8, "insert": 0.5, "*": 1.0},
    "data-migration": {
        "insert ... select": 1.5,
        "merge": 1.5,
        "update (no where)": 1.5,
        "delete (no where)": 1.5,
        "insert": 1.3,
        "create proc/view": 0.3,
        "unclassified": 0.5,
        "*": 1.0,
    },
}
# Factors of the time to read or write a table.
RUNTIME_FACTORS = {
    "CREATE TABLE AS SELECT": 2.4,
    "CREATE INDEX": 1.2,
    "CREATE INDEX CONCURRENTLY": 1.2,
    "ADD COLUMN NOT NULL": 1.5,
    "MODIFY COLUMN": 1.5,
    "DROP COLUMN": 1.5,
    "DELETE (where)": 0.8,
    "DELETE (no where)": 0.8,
    "UPDATE (where)": 1.2,
    "UPDATE (no where)": 1.2,
    "MERGE": 1.5,
}
# Categories of personal data and the patterns that tell them in a column's name.
PII_PATTERNS = {
    "name": (r"(first|last|full|display|user|person|customer|client)_?name", r"\bname\b"),
    "email": (r"e_?mail", r"email_?addr"),
    "phone": (r"(phone|mobile|cell|fax|tel)(_?num(ber)?)?",),
    "address": (r"(addr|address|street|city|state|province|postal|zip|postcode)",),
    "date_of_birth": (r"(dob|birth_?date|birth_?dt|birthdate|date_of_birth)",),
    "ssn": (r"(ssn|social_?security|sin\b|national_?id|tax_?id|vat_?id)",),
    "gender": (r"\bgender\b", r"\bsex\b"),
    "ip_address": (r"ip_?addr(ess)?", r"\bip\b"),
    "location": (r"(latitude|longitude|lat\b|lon\b|lng\b|geo_?loc)",),
    "national_id": (r"(passport|driver_?licen[cs]e|driving_?licen[cs]e|id_?number|govt_?id)",),
    "financial": (r"(credit_?card|card_?number|iban|account_?num|bank_?account|routing_?num)",),
    "health": (r"(diagnosis|medication|health|medical|patient|icd_?\d)", r"\bweight\b", r"\bheight\b"),
    "username": (r"(username|login|user_?id|screen_?name|handle)",),
    "password": (r"(password|passwd|pwd|secret|token|api_?key|auth_?key)",),
    "cookie": (r"(session_?id|cookie|jwt|bearer)",),
}


def one_line(sql: Column) -> Column:
    """Upper-cased, with single blanks, without comments and the final semicolon."""
    bare = F.regexp_replace(F.regexp_replace(sql, "--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.upper(F.regexp_replace(F.btrim(F.regexp_replace(bare, r"(?U)\s+", " ")), " ?;$", ""))


def statement_kind(sql: Column) -> Column:
    """The first rule that matches; null statements have none."""
    text = one_line(sql)

    def matches(r: Rule) -> Column:
        return text.rlike(r.pattern) & ~text.rlike(r.unless) if r.unless else text.rlike(r.pattern)

    ladder = reduce(lambda c, r: c.when(matches(r), r.kind), RULES[1:], F.when(matches(RULES[0]), RULES[0].kind))
    return F.when(sql.isNull(), F.lit(None)).otherwise(ladder.otherwise(OTHER.kind))


def _lookup(kind: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), kind)


def _of(field: str) -> dict:
    return {r.kind: getattr(r, field) for r in (*RULES, OTHER) if getattr(r, field) is not None}


def with_kinds(ops: DataFrame) -> DataFrame:
    """Statements counted once (by file and index, first delivery with a text), with what their kind tells."""
    said = ops.where("raw_sql IS NOT NULL").groupBy("source_file", "statement_index")
    s = said.agg(F.min_by(F.struct("raw_sql", "version"), F.struct("arrived_at", "op_id")).alias("s"))
    s = s.select("source_file", "statement_index", "s.raw_sql", "s.version").withColumn("kind", statement_kind(F.col("raw_sql")))
    return s.select(
        "*",
        _lookup(F.col("kind"), _of("category")).alias("category"),
        _lookup(F.col("kind"), _of("level")).alias("level"),
        _lookup(F.col("kind"), _of("weight")).alias("weight"),
        _lookup(F.col("kind"), _of("penalty")).alias("penalty"),
    )


def statement_findings(kinds: DataFrame) -> DataFrame:
    """Findings of single statements: (source_file, statement_index, code, severity)."""
    text = one_line(F.col("raw_sql"))
    view = text.rlike(r"^CREATE (OR REPLACE )?(MATERIALIZED )?VIEW\b")
    trigger = text.rlike(r"^CREATE (OR REPLACE )?TRIGGER\b") & text.rlike(r"\b(IF|CASE)\b") & (F.length("raw_sql") > 500)
    codes = F.array_compact(F.array(
        F.when(F.col("kind") == "ADD COLUMN NOT NULL", F.struct(F.lit("ADD_NOT_NULL_NO_DEFAULT").alias("code"), F.lit("error").alias("severity"))),
        F.when(view & text.rlike(r"\bSELECT \*"), F.struct(F.lit("SELECT_STAR_VIEW").alias("code"), F.lit("warning").alias("severity"))),
        F.when(trigger, F.struct(F.lit("TRIGGER_WITH_BUSINESS_LOGIC").alias("code"), F.lit("warning").alias("severity"))),
        F.when(F.col("kind") == "DELETE (no where)", F.struct(F.lit("LARGE_DELETE_NO_WHERE").alias("code"), F.lit("warning").alias("severity"))),
    ))
    return kinds.select("source_file", "statement_index", F.explode(codes).alias("f")).select("source_file", "statement_index", "f.code", "f.severity")


def classify(kinds: DataFrame) -> DataFrame:
    """Per file its primary category (the first by priority), the others, and the worst risk of all."""
    names = list(CATEGORIES)
    rank = _lookup(F.col("category"), {n: i for i, n in enumerate(names)})
    risk = _lookup(F.col("category"), {n: RISKS.index(r) for n, r in CATEGORIES.items()})
    by = kinds.groupBy("source_file").agg(F.min_by("category", rank).alias("primary"), F.array_sort(F.collect_set("category")).alias("all"), F.max(risk).alias("risk"))
    secondary = F.array_join(F.filter("all", lambda c: c != F.col("primary")), ",")
    level = F.element_at(F.array(*map(F.lit, RISKS)), F.col("risk") + 1)
    return by.select("source_file", "primary", secondary.alias("secondary"), level.alias("risk"))


def safety(kinds: DataFrame) -> DataFrame:
    """Per file its worst level, the statements at each level, and whether it needs approval."""
    order = _lookup(F.col("level"), {x: i for i, x in enumerate(LEVELS)})
    counts = [F.count_if(F.col("level") == x).alias(x.lower()) for x in LEVELS]
    by = kinds.groupBy("source_file").agg(F.max_by("level", order).alias("level"), *counts)
    return by.withColumn("needs_approval", F.col("level").isin("HIGH_RISK", "DANGEROUS"))


def gate(safe: DataFrame, level: str = "HIGH_RISK") -> DataFrame:
    """(files, blocked, exit_code) in one row: files at `level` or above are blocked, and any of them makes the exit code 1."""
    order = _lookup(F.col("level"), {x: i for i, x in enumerate(LEVELS)})
    blocked = F.count_if(order >= LEVELS.index(level))
    return safe.agg(F.count("*").alias("files"), blocked.alias("blocked"), F.when(blocked > 0, 1).otherwise(0).alias("exit_code"))


def cost(kinds: DataFrame, profile: str = "default", mib_per_second: float = 100.0, rows: int = 100_000, row_bytes: int = 200) -> DataFrame:
    """Per file the clamped sum of weights, its grade, and the time estimated for tables of `rows` rows."""
    factors = PROFILES[profile]
    kind = F.lower("kind")
    hits = [(kind.contains(k), v) for k, v in factors.items() if k != "*"]
    factor = reduce(lambda c, h: c.when(h[0], F.lit(h[1])), hits, F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(factors["*"]))
    weight = F.greatest(F.lit(1), F.bround(F.col("weight") * factor, 0).cast("int"))
    read = rows * row_bytes / (mib_per_second * 1024 * 1024)
    seconds = F.coalesce(
        _lookup(F.col("kind"), {k: v * read for k, v in RUNTIME_FACTORS.items()}),
        F.when(F.col("kind") == "TRUNCATE", 1.0).otherwise(F.greatest(F.lit(0.1), F.col("weight") * 0.02)),
    )
    by = kinds.groupBy("source_file").agg(
        F.least(F.lit(100), F.sum(weight)).cast("int").alias("score"), F.sum(seconds).cast("decimal(18,3)").alias("seconds"), F.count("*").alias("statements")
    )
    s = F.col("score")
    return by.withColumn("grade", F.when(s < 25, "low").when(s < 50, "medium").when(s < 75, "high").otherwise("critical"))


def rollback(kinds: DataFrame) -> DataFrame:
    """Per file whether it can be rolled back and how well: 0 with anything irreversible, less by each penalty, 95 without any."""
    by = kinds.groupBy("source_file").agg(F.bool_or(F.col("penalty").isNull()).alias("bad"), F.sum(F.coalesce("penalty", F.lit(0))).alias("penalty"))
    score = F.when(F.col("bad"), 0).when(F.col("penalty") > 0, F.greatest(F.lit(20), 100 - F.col("penalty"))).otherwise(95)
    name = F.when(F.col("bad"), "irreversible").when(F.col("penalty") > 0, "partial").otherwise("reversible")
    return by.select("source_file", name.alias("feasibility"), score.cast("int").alias("score"))


def health(severities: DataFrame, irreversible: DataFrame, key: str) -> DataFrame:
    """Score and grade per `key` from findings (key, severity) and the number of its irreversible files (key, files)."""
    by = severities.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = by.join(irreversible.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").withColumn("files", F.coalesce("files", F.lit(0)))
    score = F.greatest(F.lit(0), 100 - 20 * F.col("errors") - 5 * F.col("warnings") - 10 * F.col("files")).cast("int")
    s = F.col("score")
    grade = F.when(s >= 90, "excellent").when(s >= 75, "good").when(s >= 50, "warning").otherwise("critical")
    return rows.withColumn("score", score).select(key, "errors", "warnings", "files", "score", grade.alias("grade"))


def stability(mods: DataFrame, total: int | Column, high: float = 20.0, stable: float = 10.0) -> DataFrame:
    """Per (name, changes): share of versions that change it in percent, score and grade.

    `total` is the number of versions. The score is 100 less twice the unrounded share, cut to a whole number.
    """
    m = 1 + F.col("changes")
    churn = m * 100 / F.col("_total")
    score = F.greatest(F.lit(0), 100 - F.floor(m * 200 / F.col("_total"))).cast("int")
    s = F.col("score")
    grade = F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 50, "D").otherwise("F")
    rows = mods.withColumn("_total", F.lit(total) if isinstance(total, int) else total)
    rows = rows.select("name", m.cast("bigint").alias("modifications"), churn.cast("decimal(18,2)").alias("churn"), churn.alias("_c"), score.alias("score"))
    return rows.select(
        "name", "modifications", "churn", "score", grade.alias("grade"),
        F.when(F.col("_c") >= high, "high").when(F.col("_c") < stable, "stable").otherwise("medium").alias("class"),
    )


def pii(columns: DataFrame, extra: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Columns whose lower-cased name or whose comment, as written, tells personal data: categories, confidence and the pattern that told last.

    Categories are those of the name, then those of the comment, each as often as one of its patterns is found.
    Confidence is 0.6, 0.8 if a pattern with an underscore is in the name, and 1 if one of the first category's is the
    whole name. `extra` patterns are added to a category, or make one. All patterns are tested in one pass, without a join.
    """
    extra = extra or {}
    every = {k: (*ps, *extra.get(k, ())) for k, ps in PII_PATTERNS.items()} | {k: tuple(ps) for k, ps in extra.items() if k not in PII_PATTERNS}
    patterns = [(k, p) for k, ps in every.items() for p in ps]
    name = F.lower("column_name")

    def found(text: Column) -> list[Column]:
        return [F.when(text.rlike(p), F.struct(F.lit(k).alias("category"), F.lit(p).alias("pattern"))) for k, p in patterns]

    comment = found(F.col("column_comment")) if "column_comment" in columns.columns else []
    rows = columns.withColumn("h", F.array_compact(F.array(*found(name), *comment))).where(F.size("h") > 0)
    first = F.get("h", F.lit(0))["category"]
    whole = reduce(lambda a, b: a | b, [(first == k) & name.rlike(f"^(?:{p})\\z") for k, p in patterns])
    strong = reduce(lambda a, b: a | b, [name.rlike(p) for _, p in patterns if "_" in p])
    conf = F.when(whole, 1.0).when(strong, 0.8).otherwise(0.6)
    return rows.select(
        "table_name", "column_name", first.alias("category"), F.array_join(F.transform("h", lambda x: x["category"]), ",").alias("categories"),
        conf.cast("decimal(3,1)").alias("confidence"), F.element_at("h", -1)["pattern"].alias("evidence"),
    )


def pii_tables(found: DataFrame, top: int = 5) -> DataFrame:
    """The `top` tables with the most columns of personal data: (table_name, columns, surest)."""
    by = found.groupBy("table_name").agg(F.count("*").alias("columns"), F.max("confidence").alias("surest"))
    return by.orderBy(F.desc("columns"), "table_name").limit(top)


# What undoes an operation, what is lost by it, and the penalty; an operation without a reverse cannot be undone. {t}, {o} and {n} are
# its table, object and new name.
REVERSE = {
    "CREATE_TABLE": ("DROP TABLE {t} CASCADE CONSTRAINTS;", "Rollback will drop table {t} - all data will be lost", 10),
    "CREATE_VIEW": ("DROP VIEW {o};", None, 0),
    "CREATE_INDEX": ("DROP INDEX {o};", "Rollback will drop index {o} - queries may be slower", 5),
    "CREATE_SEQUENCE": ("DROP SEQUENCE {o};", "Rollback will drop sequence {o} - ID generation will reset", 10),
    "ADD_COLUMN": ("ALTER TABLE {t} DROP COLUMN {o};", "Rollback will drop column {t}.{o} - data will be lost", 15),
    "ADD_CONSTRAINT": ("ALTER TABLE {t} DROP CONSTRAINT {o};", None, 5),
    "RENAME_COLUMN": ("ALTER TABLE {t} RENAME COLUMN {n} TO {o};", None, 0),
    "RENAME_TABLE": ("ALTER TABLE {n} RENAME TO {t};", None, 0),
    "DROP_TABLE": (None, "Cannot restore table {t} without full backup and schema definition", None),
    "DROP_VIEW": (None, "Cannot restore view {o} without original CREATE VIEW statement", None),
    "DROP_INDEX": (None, "Cannot restore index {o} without original CREATE INDEX statement", None),
    "DROP_SEQUENCE": (None, "Cannot restore sequence {o} without knowing original start value", None),
    "DROP_COLUMN": (None, "Cannot restore dropped column {t}.{o} without backup", None),
    "MODIFY_COLUMN": (None, "Cannot undo MODIFY on {t} without knowing original column definitions", None),
    "INSERT": (None, "Cannot undo INSERT without knowing exact rows inserted", None),
    "UPDATE": (None, "Cannot undo UPDATE without knowing original values", None),
    "DELETE": (None, "Cannot undo DELETE - data is permanently lost", None),
    "TRUNCATE": (None, "Cannot undo TRUNCATE - all data is permanently lost", None),
}
UNNAMED = "Rollback constraint name must be specified manually"


def reverse_operations(ops: DataFrame) -> DataFrame:
    """`ops` (operation, table_name, target, new_name, ...) with `reverse` and `warning` statements and whether they are `irreversible`.

    Operations of other kinds (comments and the like) need no undoing: all three are null or false. A constraint
    without a name has a warning in place of its reverse.
    """

    def filled(template: str | None) -> Column:
        out = F.lit(template)
        for mark, name in (("{t}", "table_name"), ("{o}", "target"), ("{n}", "new_name")):
            if template and mark in template:
                out = F.replace(out, F.lit(mark), F.coalesce(name, F.lit("?")))
        return out.cast("string")

    kind = F.when(F.col("comment").eqNullSafe("inline"), "INLINE").otherwise(F.col("operation"))  # what is written in a CREATE goes with it
    unnamed = (kind == "ADD_CONSTRAINT") & F.col("target").isNull()
    reverse, warning = F.when(unnamed, F.lit(None).cast("string")), F.when(unnamed, UNNAMED)
    for k, (undo, lost, _) in REVERSE.items():
        reverse, warning = reverse.when(kind == k, filled(undo)), warning.when(kind == k, filled(lost))
    lost = kind.isin(*(k for k, (undo, _, _) in REVERSE.items() if undo is None))
    return ops.withColumn("reverse", reverse).withColumn("warning", warning).withColumn("irreversible", F.coalesce(lost, F.lit(False)))


def rollback_plan(ops: DataFrame) -> DataFrame:
    """Per file of `ops` (filename, stmt_idx, op_idx, ...): feasibility, its script, its distinct warnings, and what cannot be undone.

    The script has the reverse statements in the order of the file, and is null where anything is irreversible or
    nothing is to be undone. Texts of a file are gathered in one row, as the file itself is.
    """
    r = reverse_operations(ops)
    at = F.struct("stmt_idx", "op_idx")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("x"))))), lambda e: e["x"])
    penalty = reduce(lambda c, k: c.when(F.col("operation") == k, REVERSE[k][2] or 0), REVERSE, F.when(F.lit(False), 0)).otherwise(0)
    by = r.groupBy("filename").agg(
        F.bool_or("irreversible").alias("bad"), F.sum(penalty).alias("penalty"), F.array_join(listed("reverse"), "\n").alias("script"),
        F.array_distinct(listed("warning")).alias("warnings"), F.count_if("irreversible").alias("lost"),
    )
    partial = (F.col("penalty") > 0) | (F.size("warnings") > 0)
    return by.select(
        "filename",
        F.when(F.col("bad"), "irreversible").when(partial, "partial").otherwise("reversible").alias("feasibility"),
        F.when(F.col("bad"), 0).when(partial, F.greatest(F.lit(20), 100 - F.col("penalty"))).otherwise(95).cast("int").alias("score"),
        F.when(~F.col("bad") & (F.col("script") != ""), F.col("script")).alias("script"), "warnings", F.col("lost").cast("int").alias("lost"),
    )


def naming(files: DataFrame, path_col: str, pattern: str = "^[a-z0-9_]+$", longest: int = 120) -> DataFrame:
    """File names that break the naming rules: (filename, code)."""
    name, desc = base_name(F.col(path_col)), F.replace(file_description(F.col(path_col)), F.lit(" "), F.lit("_"))
    codes = F.array(
        F.when(F.length(name) > longest, "LONG_FILENAME"),
        F.when((file_kind(F.col(path_col)) != "unknown") & ~desc.rlike(pattern), "DESC_FORMAT"),
        F.when(desc.startswith("_"), "DESC_UNDERSCORE"),
        F.when(file_kind(F.col(path_col)) == "unknown", "INVALID_FILENAME"),
    )
    return files.select(F.col(path_col).alias("filename"), F.explode(F.array_compact(codes)).alias("code"))


def duplicate_versions(files: DataFrame, path_col: str) -> DataFrame:
    """Versions that several distinct files of one folder carry, leading zeros and separators aside."""
    p = F.col(path_col)
    rows = files.select(p.alias("f")).distinct()
    folder = F.regexp_extract("f", "^(.*)/", 1)
    by = rows.groupBy(folder.alias("folder"), version_key(file_version(F.col("f"))).alias("k")).agg(F.count("*").alias("files"), F.min("f").alias("first_file"))
    return by.where("files > 1").select("folder", "first_file", "files")


def version_gaps(numbers: DataFrame, group: str, value: str) -> DataFrame:
    """Per group, missing stretches between successive whole numbers: (group, after, before, missing).

    Numbers are put in ranges by group and value, so a group can span several tasks; each range's last number is
    followed by the first of the next range of its group, and these ends, one row a range, are matched by themselves.
    """
    parts = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = numbers.select(group, value).distinct().repartitionByRange(parts, group, value)
    n = cut(n.withColumn("_part", F.spark_partition_id()), "numbers")
    rows = n.withColumn("before", F.lead(value).over(W.partitionBy(group, "_part").orderBy(value)))
    first = n.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min(value).alias("_first"))
    first = first.select("_g", "_p", F.lead("_first").over(W.partitionBy("_g").orderBy("_p")).alias("_next"))
    rows = rows.join(first, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")), "left").withColumn("before", F.coalesce("before", "_next"))
    return rows.where(F.col("before") - F.col(value) > 1).select(group, F.col(value).alias("after"), "before", (F.col("before") - F.col(value) - 1).alias("missing"))


def order_check(files: DataFrame, path_col: str, version_col: str) -> DataFrame:
    """Per folder each file's rank by name and by version; `renumbered` is the rank by version, `moved` where they differ."""
    rows = files.select(F.col(path_col).alias("filename"), F.regexp_extract(path_col, "^(.*)/", 1).alias("folder"), version_key(F.col(version_col)).alias("k")).distinct()
    rows = numbered(numbered(rows, ["folder"], ["filename", "k"], "by_name"), ["folder"], ["k", "filename"], "renumbered")
    rows = rows.select("folder", "filename", (F.col("by_name") + 1).cast("int").alias("by_name"), (F.col("renumbered") + 1).cast("int").alias("renumbered"))
    return rows.withColumn("moved", F.col("by_name") != F.col("renumbered"))


# Words that lint takes as keywords.
KEYWORDS = ("select", "from", "where", "insert", "into", "update", "delete", "create", "alter", "drop", "table", "index", "view", "join", "group", "order", "values", "constraint")


def lint(texts: DataFrame, id_col: str, text_col: str, longest: int = 120) -> DataFrame:
    """Line rules per text, and its score: 100 less 10 for each error, 5 for each warning, 1 for each note; passed from 80.

    Errors are lines with a tab and brackets or quotes that do not close; warnings are long lines, comma-first lines and
    lines that mix upper-case and lower-case keywords; notes are trailing blanks and more than one blank line in a row.
    """
    text = F.coalesce(text_col, F.lit(""))
    lines = F.split(text, "\r\n|\r|\n")
    count = lambda test: F.size(F.filter(lines, test))
    of = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    open_ends = F.when(of("(") != of(")"), 1).otherwise(0) + F.when(of("'") % 2 != 0, 1).otherwise(0)
    word = "|".join(KEYWORDS)
    mixed = lambda x: x.rlike(rf"\b({word})\b") & x.rlike(rf"\b({word.upper()})\b")
    blank = F.regexp_count(text, F.lit(r"(\r\n|\r|\n)[ \t]*(\r\n|\r|\n)[ \t]*(\r\n|\r|\n)"))
    rows = texts.select(
        F.col(id_col),
        (count(lambda x: x.contains("\t")) + open_ends).alias("errors"),
        count(lambda x: (F.length(x) > longest) | x.rlike(r"^\s*,") | mixed(x)).alias("warnings"),
        (count(lambda x: x.rlike("[ \t]$")) + blank).alias("notes"),
    )
    score = F.greatest(F.lit(0), 100 - 10 * F.col("errors") - 5 * F.col("warnings") - F.col("notes"))
    return rows.withColumn("score", score).withColumn("passed", score >= 80)


def creator_dependencies(ops: DataFrame) -> DataFrame:
    """(source_file, depends_on, tables): files that change a table depend on the file that created it last of all, even if that came later."""
    from terrane.functions.names import norm_name

    s = ops.select(norm_name(F.col("table_name")).alias("t"), "operation", "source_file", sequence_key(F.col("version"), F.col("statement_index")).alias("seq"))
    created = s.where("operation = 'CREATE_TABLE'").groupBy("t").agg(F.max_by("source_file", "seq").alias("creator"))
    used = s.where("operation IN ('ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX')").select("t", "source_file").distinct()
    pairs = used.join(created.withColumnRenamed("t", "_t"), F.col("t") == F.col("_t")).where("creator <> source_file")
    return pairs.groupBy("source_file", F.col("creator").alias("depends_on")).agg(F.count("*").alias("tables"))


def creators_before(ops: DataFrame) -> DataFrame:
    """(source_file, depends_on, tables): each statement that changes a table depends on the file of the last CREATE_TABLE before it.

    Statements are put in ranges by table and place, so a hot table spans several; each range looks up its own
    creations and then the last of the ranges before. Statements of one place do not come before each other; a file does not depend on itself.
    """
    from terrane.functions.names import norm_name

    creates = F.col("operation") == "CREATE_TABLE"
    s = ops.where("operation IN ('CREATE_TABLE', 'ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX')")
    s = s.select(norm_name(F.col("table_name")).alias("t"), sequence_key(F.col("version"), F.col("statement_index")).alias("seq"), creates.alias("creates"), "source_file")
    s = s.where("t IS NOT NULL").distinct()
    parts = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = cut(s.repartitionByRange(parts, "t", "seq").withColumn("part", F.spark_partition_id()), "statements")
    creator = F.when(F.col("creates"), F.col("source_file"))
    # At one place uses come first, so that they do not see its creations.
    inside = W.partitionBy("t", "part").orderBy("seq", "creates", "source_file").rowsBetween(W.unboundedPreceding, -1)
    uses = s.withColumn("near", F.last(creator, True).over(inside)).where("NOT creates")
    last = s.groupBy("t", "part").agg(F.max(F.when(F.col("creates"), F.struct("seq", "source_file"))).alias("m"))
    earlier = W.partitionBy("t").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range of the table
    last = last.select(F.col("t").alias("_t"), F.col("part").alias("_part"), F.last("m.source_file", True).over(earlier).alias("far"))
    pairs = uses.join(last, (F.col("t") == F.col("_t")) & (F.col("part") == F.col("_part"))).select("t", "source_file", F.coalesce("near", "far").alias("depends_on"))
    return pairs.where("depends_on <> source_file").distinct().groupBy("source_file", "depends_on").agg(F.count("*").alias("tables"))


def dependency_issues(ops: DataFrame) -> DataFrame:
    """(code, severity, source_file, object) of the files of a log.

    UNREFERENCED_OBJECT: a file changes a table that no file creates. ISOLATED_MIGRATION: a file depends on no other
    and creates no table. CIRCULAR_DEPENDENCY: files that depend on one another, with the least of them; a file depends on
    the file that created its table last of all.
    """
    from terrane.functions.names import norm_name
    from terrane.operators.graph import strong_components

    s = cut(ops.select(norm_name(F.col("table_name")).alias("t"), "operation", "source_file").distinct(), "uses")
    creates = s.where("operation = 'CREATE_TABLE' AND t IS NOT NULL")
    changes = s.where("operation IN ('ADD_COLUMN', 'DROP_COLUMN', 'MODIFY_COLUMN', 'ADD_CONSTRAINT', 'DROP_TABLE', 'CREATE_INDEX') AND t IS NOT NULL").select("source_file", "t").distinct()
    unknown = changes.join(creates.select(F.col("t").alias("_t")).distinct(), F.col("t") == F.col("_t"), "left_anti")
    deps = cut(creator_dependencies(ops).select("source_file", "depends_on"), "dependencies")
    files = s.select("source_file").distinct()
    active = deps.select(F.col("source_file").alias("_f")).unionByName(creates.select(F.col("source_file").alias("_f"))).distinct()
    alone = files.join(active, F.col("source_file") == F.col("_f"), "left_anti")
    circles = strong_components(deps.select(F.col("depends_on").alias("src"), F.col("source_file").alias("dst")), files.select(F.col("source_file").alias("node"))).where("cyclic")

    def issue(df: DataFrame, code: str, severity: str, file: str, what: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(file).alias("source_file"), what.alias("object"))

    none = F.lit(None).cast("string")
    rows = issue(unknown, "UNREFERENCED_OBJECT", "error", "source_file", F.col("t")).unionByName(issue(alone, "ISOLATED_MIGRATION", "warning", "source_file", none))
    return rows.unionByName(issue(circles, "CIRCULAR_DEPENDENCY", "error", "node", F.col("component")))


def missing_versions(files: DataFrame, path_col: str) -> DataFrame:
    """(folder, after, before, missing) of gaps between the whole first parts of the versions of a folder's files."""
    major = F.regexp_extract(file_version(F.col(path_col)), "^[0-9]+", 0).try_cast("decimal(38,0)")
    n = files.select(F.regexp_extract(path_col, "^(.*)/", 1).alias("folder"), major.alias("n")).where("n IS NOT NULL").distinct()
    return version_gaps(n, "folder", "n").select("folder", "after", "before", "missing")
