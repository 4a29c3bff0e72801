"""Lookups, joins and counts over the snapshot: tables, their columns, indexes and foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.names import domain_prefix, norm_name
from terrane.operators import graph
from terrane.session import cut

# Name endings of a column that looks like a reference.
REFERENCE_SUFFIX = "(?i)_(id|key|fk|ref)$"
# The name prefixes of sequences.
SEQUENCE_PREFIXES = "^(SEQ_|SQ_|S_)"


def snapshot(tables: DataFrame) -> DataFrame:
    """One row per table; exact repeats go. Of rows that differ the one created last counts, then the one dropped last (not at all is latest), then the greatest."""
    return _one_each(tables, ["full_name"], ["created_at", "dropped_at"])


def column_rows(columns: DataFrame) -> DataFrame:
    """One row per column of a table; of rows that differ the one with the greatest place counts, then the greatest."""
    return _one_each(columns, ["table_name", "column_name"], ["ord"])


def _one_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by `order`, then by all its values as text. Nulls of `dropped_at` come last, other nulls first."""
    at = [F.col(c).isNull() if c == "dropped_at" else F.col(c) for c in order]
    at = [x.alias(f"_{i}") for i, x in enumerate([*at, *(F.col(c) for c in order if c == "dropped_at")])]
    whole = F.struct(*(F.col(c) for c in rows.columns))
    last = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(whole, F.struct(*at, F.to_json(whole))).alias("_r"))
    return last.select("_r.*")


def relationships(tables: DataFrame) -> DataFrame:
    """Foreign keys as (from_table, name, from_cols, to_table, to_cols, on_delete, cardinality).

    A key that is the table's whole primary key makes a one-to-one relationship, any other many-to-one.
    """
    c = F.col("c")
    keys = tables.select("full_name", "pk_columns", F.explode("constraints").alias("c")).where("c.type = 'foreign_key'")
    whole = F.array_sort(F.array_distinct(c["columns"])) == F.array_sort(F.array_distinct("pk_columns"))
    return keys.select(
        F.col("full_name").alias("from_table"),
        c["name"].alias("name"),
        c["columns"].alias("from_cols"),
        c["ref_table"].alias("to_table"),
        c["ref_columns"].alias("to_cols"),
        c["on_delete"].alias("on_delete"),
        F.when(F.coalesce(whole, F.lit(False)), "one_to_one").otherwise("many_to_one").alias("cardinality"),
    )


def fk_edges(tables: DataFrame) -> DataFrame:
    """Distinct (src, dst) of foreign keys between tables of the snapshot."""
    names = tables.select(F.col("full_name").alias("dst"))
    edges = relationships(tables).select(F.col("from_table").alias("src"), F.col("to_table").alias("dst")).distinct()
    return edges.join(names, "dst", "left_semi").select("src", "dst")


def degrees(tables: DataFrame) -> DataFrame:
    """Per table its foreign keys out and in; the hot end of a key is counted map-side before the shuffle."""
    r = relationships(tables)
    out = r.select(F.col("from_table").alias("t"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = r.select(F.col("to_table").alias("t"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("t").agg(F.sum("o").alias("fk_out"), F.sum("i").alias("fk_in"))


def with_degrees(tables: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    joined = tables.join(degrees(tables), F.col("full_name") == F.col("t"), "left").drop("t")
    return joined.withColumn("fk_out", F.coalesce("fk_out", zero)).withColumn("fk_in", F.coalesce("fk_in", zero))


def filter_tables(
    tables: DataFrame,
    pattern: str | None = None,
    schema: str | None = None,
    has_pk: bool | None = None,
    is_orphan: bool | None = None,
    min_cols: int | None = None,
    max_cols: int | None = None,
    created_in: str | None = None,
) -> DataFrame:
    """Tables by a case-insensitive pattern found in the full name, schema, key, links, width and creating version."""
    orphan = (F.col("fk_out") == 0) & (F.col("fk_in") == 0)
    tests = [
        pattern is not None and F.col("full_name").rlike(f"(?i){pattern}"),
        schema is not None and F.upper("schema_name") == (schema or "").upper(),
        has_pk is not None and F.col("has_pk") == has_pk,
        is_orphan is not None and orphan == is_orphan,
        min_cols is not None and F.col("column_count") >= min_cols,
        max_cols is not None and F.col("column_count") <= max_cols,
        created_in is not None and F.col("created_in") == created_in,
    ]
    kept = reduce(lambda df, t: df.where(t), [t for t in tests if not isinstance(t, bool)], with_degrees(tables))
    mark = lambda c: F.when(c, "✓").otherwise("✗")
    return kept.select("full_name", "column_count", mark(F.col("has_pk")).alias("pk"), "fk_out", "fk_in", mark(orphan).alias("orphan"), "created_in")


def tables_in_schema(tables: DataFrame, *schemas: str) -> DataFrame:
    return tables.where(F.upper("schema_name").isin(*(x.upper() for x in schemas)))


def find_table(tables: DataFrame, name: str) -> DataFrame:
    """The table of that full name, else the first by full name of those with that short name, in any case; no row if there is none."""
    full, short = F.upper("full_name") == name.upper(), F.upper("name") == name.upper()
    return tables.where(full | short).orderBy(F.when(full, 0).otherwise(1), "full_name").limit(1)


def filter_findings(findings: DataFrame, severity: str | None = None, codes: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Distinct findings of a severity, of some codes, and of tables whose normalised name begins with `prefix`."""
    kept = findings if severity is None else findings.where(F.col("severity") == severity)
    kept = kept.where(F.col("code").isin(*codes)) if codes else kept
    return (kept.where(norm_name(F.col("table_name")).startswith(prefix)) if prefix else kept).distinct()


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings and their distinct tables per severity and code; exact repeats count once."""
    return findings.distinct().groupBy("severity", "code").agg(F.count("*").alias("n"), F.countDistinct(norm_name(F.col("table_name"))).alias("tables"))


def top_findings(findings: DataFrame, k: int = 20) -> DataFrame:
    """The `k` findings first by severity, table (none is first), code and id."""
    f = findings.distinct().withColumn("table_name", F.coalesce("table_name", F.lit("")))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return f.orderBy(rank, "table_name", "code", "finding_id").limit(k).select("finding_id", "severity", "table_name", "code")


def latest(rows: DataFrame, key: str, order: list[str], field: str) -> DataFrame:
    """Per key the `field` of its last row by `order`, the greatest first order column, and the number of rows."""
    return rows.groupBy(key).agg(F.max_by(field, F.struct(*order)).alias(field), F.max(order[0]).alias(order[0]), F.count("*").alias("n"))


def filter_columns(
    columns: DataFrame,
    table: str | None = None,
    pattern: str | None = None,
    type_like: str | None = None,
    is_pk: bool | None = None,
    is_fk: bool | None = None,
    is_unique: bool | None = None,
    nullable: bool | None = None,
    has_default: bool | None = None,
) -> DataFrame:
    """Columns by patterns found in table, name and type, and by flags; an empty default is none."""
    default = F.coalesce(F.col("default_expr"), F.lit("")) != ""
    kept = columns
    for name, p in (("table_name", table), ("column_name", pattern), ("data_type", type_like)):
        kept = kept if p is None else kept.where(F.col(name).rlike(f"(?i){p}"))
    for col, want in ((F.col("is_pk"), is_pk), (F.col("is_fk"), is_fk), (F.col("is_unique"), is_unique), (F.col("nullable"), nullable), (default, has_default)):
        kept = kept if want is None else kept.where(col == want)
    flag = lambda c, s: F.when(c, s)
    flags = F.concat_ws(" ", flag(F.col("is_pk"), "PK"), flag(F.col("is_fk"), "FK"), flag(F.col("is_unique"), "UQ"), flag(~F.col("nullable"), "NN"))
    return kept.select("table_name", "column_name", "data_type", flags.alias("flags"))


def filter_indexes(tables: DataFrame, table: str | None = None, unique_only: bool = False) -> DataFrame:
    rows = tables.select("full_name", F.explode("indexes").alias("i"))
    rows = rows if table is None else rows.where(F.col("full_name").rlike(f"(?i){table}"))
    rows = rows.where("i.is_unique") if unique_only else rows
    return rows.select("full_name", F.col("i.name").alias("index_name"), F.array_join("i.columns", ", ").alias("columns"), F.col("i.is_unique").alias("is_unique"))


def missing_pk(tables: DataFrame) -> DataFrame:
    return tables.where(~F.coalesce("has_pk", F.lit(False))).select("full_name", "column_count")


def missing_fk(columns: DataFrame) -> DataFrame:
    """Columns named like references that are neither foreign nor primary keys."""
    c = columns.where(F.col("column_name").rlike(REFERENCE_SUFFIX) & ~F.col("is_fk") & ~F.col("is_pk"))
    return c.select("table_name", "column_name", "data_type")


def references_of(tables: DataFrame, pattern: str) -> DataFrame:
    """Foreign keys out of and into the tables matching `pattern`, with the width of the table at the far end."""
    r, width = relationships(tables), tables.select(F.col("full_name").alias("_n"), F.col("column_count").alias("far_columns"))

    def side(near: str, far: str, mark: str, name: str) -> DataFrame:
        own = r.where(F.col(near).rlike(f"(?i){pattern}")).join(width, F.col(far) == F.col("_n"), "left")
        return own.select(F.lit(mark).alias("mark"), F.lit(name).alias("direction"), F.col(near).alias("near"), F.col(far).alias("far"), "name", "far_columns")

    return side("from_table", "to_table", "▶", "out").unionByName(side("to_table", "from_table", "◀", "in"))


def referencing(tables: DataFrame, target: str) -> DataFrame:
    """The tables that refer to `target` (left semi)."""
    into = relationships(tables).where(F.col("to_table") == target).select(F.col("from_table").alias("_f"))
    return tables.join(into, F.col("full_name") == F.col("_f"), "left_semi").select("full_name", "column_count")


def orphans(tables: DataFrame) -> DataFrame:
    """Tables without a foreign key in or out (left anti)."""
    return tables.join(degrees(tables), F.col("full_name") == F.col("t"), "left_anti").select("full_name", "column_count")


def unresolved_fks(tables: DataFrame) -> DataFrame:
    """Foreign keys whose target is no table of the snapshot; an empty target is passed over."""
    names = tables.select(F.col("full_name").alias("_n"))
    r = relationships(tables).where(F.coalesce("to_table", F.lit("")) != "")
    return r.join(names, F.col("to_table") == F.col("_n"), "left_anti").select("from_table", "name", "to_table")


def orphan_sequences(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """Sequences whose stem and no table name begin with one another.

    Instead of comparing every pair, each side is looked up among the prefixes of the other: two hash joins.
    """

    def prefixes(c: Column) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))

    stem = F.regexp_replace(F.upper("sequence"), SEQUENCE_PREFIXES, "")
    s = sequences.where("sequence IS NOT NULL").select("sequence", stem.alias("stem")).distinct()
    names = names.select(F.upper("name").alias("name")).where("name <> ''").distinct()
    longer = s.where("stem <> ''").select("sequence", prefixes(F.col("stem")).alias("p")).join(names, F.col("p") == F.col("name"), "left_semi")
    starts = names.select(prefixes(F.col("name")).alias("_p")).distinct()
    shorter = s.join(starts, F.col("stem") == F.col("_p"), "left_semi")
    found = longer.select("sequence").unionByName(shorter.select("sequence")).withColumnRenamed("sequence", "_s")
    return s.join(found, F.col("sequence") == F.col("_s"), "left_anti").select("sequence")


def table_stats(tables: DataFrame, stats: DataFrame) -> DataFrame:
    """Each table's row of `stats` (table_name, row_count): by full name, else by short name, else by the stats' short name.

    Three keys per table and one per statistic meet in one hash join; the best rank wins, then the least name.
    """
    t = tables.select(F.lower("full_name").alias("f"), F.lower("name").alias("n"), "full_name")
    asked = t.select("full_name", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.col("f").alias("k")), F.struct(F.lit(2).alias("rank"), F.col("n").alias("k")))).alias("a"))
    asked = asked.select("full_name", "a.rank", "a.k").unionByName(t.select("full_name", F.lit(3).alias("rank"), F.concat(F.lit("."), F.col("n")).alias("k")))
    name = F.lower("table_name")
    held = stats.select(name.alias("_k"), "table_name", "row_count").unionByName(
        stats.where(name.contains(".")).select(F.concat(F.lit("."), F.element_at(F.split(name, "[.]"), -1)).alias("_k"), "table_name", "row_count")
    )
    best = asked.join(held, F.col("k") == F.col("_k")).groupBy("full_name").agg(F.min(F.struct("rank", "table_name", "row_count")).alias("b"))
    return best.select("full_name", "b.rank", F.col("b.table_name").alias("stats_name"), "b.row_count")


def state_stats(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts of the whole snapshot in one row."""
    t = tables.agg(
        F.count("*").alias("tables"),
        F.sum(F.size("indexes")).alias("indexes"),
        F.sum(F.size(F.filter("constraints", lambda c: c["type"] == "foreign_key"))).alias("relationships"),
        F.count_if(~F.col("has_pk")).alias("tables_without_pk"),
        F.count_if(F.col("dropped_at").isNotNull()).alias("dropped"),
    )
    return t.withColumn("columns", columns.select(F.count("*")).scalar())


def god_tables(tables: DataFrame, top: int = 10) -> DataFrame:
    """The `top` tables whose degree is above the mean by more than two (population) deviations; all if all are equal."""
    d = with_degrees(tables).select("full_name", "fk_in", "fk_out", (F.col("fk_in") + F.col("fk_out")).alias("degree"))
    stats = d.select(F.struct(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("sd"))).scalar()
    high = d.withColumn("_s", stats).where((F.col("_s.sd") == 0) | (F.col("degree") > F.col("_s.mean") + 2 * F.col("_s.sd")))
    return high.orderBy(F.desc("degree"), "full_name").limit(top).select("full_name", "degree", "fk_in", "fk_out")


def god_columns(tables: DataFrame, min_refs: int) -> DataFrame:
    """Columns with at least `min_refs` references and distinct columns that refer to them together."""
    pairs = relationships(tables).select("from_table", "to_table", F.explode(F.arrays_zip("from_cols", "to_cols")).alias("p")).where("p.to_cols IS NOT NULL")
    src = F.concat_ws(".", "from_table", "p.from_cols")
    by = pairs.groupBy(F.concat_ws(".", "to_table", "p.to_cols").alias("column")).agg(F.count("*").alias("refs"), F.countDistinct(src).alias("users"))
    return by.where(F.col("refs") + F.col("users") >= min_refs).select("column", "refs", "users")


def mentioned_columns(tables: DataFrame) -> DataFrame:
    """Distinct (_t, _c): columns that a key, index or foreign key of any table mentions."""
    c = F.col("c")
    cons = tables.select("full_name", F.explode("constraints").alias("c"))
    used = [
        cons.select(F.col("full_name").alias("_t"), F.explode(c["columns"]).alias("_c")),
        cons.where("c.ref_table IS NOT NULL").select(c["ref_table"].alias("_t"), F.explode(c["ref_columns"]).alias("_c")),
        tables.select(F.col("full_name").alias("_t"), F.explode("indexes").alias("i")).select("_t", F.explode("i.columns").alias("_c")),
    ]
    return reduce(DataFrame.unionByName, used).distinct()


def unused_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns that nothing mentions (left anti)."""
    mentioned = mentioned_columns(tables)
    return columns.join(mentioned, (F.col("table_name") == F.col("_t")) & (F.col("column_name") == F.col("_c")), "left_anti").select("table_name", "column_name")


def drops_in_use(drops: DataFrame, tables: DataFrame) -> DataFrame:
    """Of distinct (table_name, column_name) that are dropped, those that something still mentions (left semi)."""
    return drops.distinct().join(mentioned_columns(tables), (F.col("table_name") == F.col("_t")) & (F.col("column_name") == F.col("_c")), "left_semi")


def table_roles(tables: DataFrame) -> DataFrame:
    i, o = F.col("fk_in") > 0, F.col("fk_out") > 0
    role = F.when(i & ~o, "root").when(i & o, "junction").when(o, "leaf").otherwise("standalone")
    return with_degrees(tables).select("full_name", role.alias("role"))


def cross_domain(tables: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Foreign keys between schemas, or between the groups (node, community) of tables, counted and named by strength."""
    own = tables.select("full_name", "schema_name") if groups is None else groups.select("node", "community")
    names = ("from_schema", "to_schema") if groups is None else ("from_community", "to_community")
    r = relationships(tables).select("from_table", "to_table")
    r = r.join(own.toDF("_f", names[0]), F.col("from_table") == F.col("_f")).join(own.toDF("_t", names[1]), F.col("to_table") == F.col("_t"))
    n = F.col("fks")
    by = r.where(F.col(names[0]) != F.col(names[1])).groupBy(*names).agg(F.count("*").alias("fks"))
    return by.withColumn("strength", F.when(n >= 10, "strong").when(n >= 5, "medium").otherwise("weak"))


def domains(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(community, size, inside, cohesion, name) of groups (node, community) of tables.

    The name is the most frequent prefix of the tables' names (the least on ties) if half of them have it, else
    the name of the least table. Prefixes are counted map-side.
    """
    g = groups.select("node", "community")
    counted = g.where(domain_prefix(F.col("node")).isNotNull()).groupBy("community", domain_prefix(F.col("node")).alias("prefix")).agg(F.count("*").alias("n"))
    modal = counted.groupBy(F.col("community").alias("_m")).agg(F.min(F.struct((-F.col("n")).alias("n"), "prefix")).alias("m"))
    sizes = graph.group_cohesion(edges, g)
    least = g.groupBy(F.col("community").alias("_l")).agg(F.min("node").alias("least"))
    rows = sizes.join(least, F.col("community") == F.col("_l")).join(modal, F.col("community") == F.col("_m"), "left")
    word = F.when(-F.col("m.n") * 2 >= F.col("size"), F.col("m.prefix")).otherwise(F.element_at(F.split("least", "[.]"), -1))
    name = F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, F.lit(2), F.length(word))), F.lit(" Domain"))
    return rows.select("community", "size", "inside", F.col("cohesion").cast("decimal(18,6)").alias("cohesion"), name.alias("name"))


def modal_labels(columns: DataFrame) -> DataFrame:
    """Per table its most frequent base type (the least on ties), and it as label if at least half the columns have it."""
    by = columns.groupBy("table_name", "raw_type").agg(F.count("*").alias("n"))
    top = by.groupBy("table_name").agg(F.sum("n").alias("columns"), F.max("n").alias("most"))
    least = by.join(top.select(F.col("table_name").alias("_t"), "most", "columns"), (F.col("table_name") == F.col("_t")) & (F.col("n") == F.col("most")))
    least = least.groupBy("table_name", "columns", "most").agg(F.min("raw_type").alias("modal"))
    return least.select("table_name", "modal", "most", "columns", F.when(F.col("most") * 2 >= F.col("columns"), F.col("modal")).otherwise("mixed").alias("label"))


def fingerprints(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Per schema the first 16 hex digits of a digest of its tables' columns and constraint types, in name order."""
    names = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("ord", "column_name"))).alias("cs"))
    cols = F.array_join(F.transform("cs", lambda x: x["column_name"]), ",")
    cons = F.array_join(F.transform("constraints", lambda c: c["type"]), ",")
    rows = tables.join(names, F.col("full_name") == F.col("table_name"), "left")
    rows = rows.select("schema_name", "full_name", F.concat_ws("|", "full_name", F.coalesce(cols, F.lit("")), cons).alias("line"))
    digest = rows.select("schema_name", F.sha2("line", 256).alias("h"), "full_name")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("full_name", "h"))), lambda x: x["h"]), "")
    return digest.groupBy("schema_name").agg(F.substring(F.sha2(ordered, 256), 1, 16).alias("fingerprint"))


def property_graph(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Nodes and edges of the property graph, counted by kind."""
    kinds = [
        tables.select(F.lit("node:table").alias("kind")),
        columns.select(F.lit("node:column").alias("kind")),
        tables.where("created_in IS NOT NULL").select("created_in").distinct().select(F.lit("node:migration").alias("kind")),
        columns.select(F.lit("edge:contains").alias("kind")),
        fk_edges(tables).select(F.lit("edge:foreign_key").alias("kind")),
        tables.where("created_in IS NOT NULL").select(F.lit("edge:creates").alias("kind")),
        tables.select("full_name", F.explode(F.array_distinct("modified_in")).alias("v"), "created_in").where("v <> created_in").select(F.lit("edge:modifies").alias("kind")),
        tables.where("dropped_at IS NOT NULL").select(F.lit("edge:drops").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, kinds).groupBy("kind").agg(F.count("*").alias("n"))


def graph_metrics(tables: DataFrame, top: int = 10) -> DataFrame:
    """The `top` tables by degree in the simple graph of foreign keys, with degree centrality and the graph's density."""
    both = fk_edges(tables).where("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    by = both.select("e.src", "e.dst").distinct().groupBy("src").agg(F.count("*").alias("degree"))
    n = tables.select(F.count("*")).scalar()
    m = by.select(F.sum("degree")).scalar()
    rows = by.withColumn("n", n).withColumn("m", m)
    rows = rows.select(
        F.col("src").alias("full_name"),
        "degree",
        F.try_divide("degree", F.col("n") - 1).cast("decimal(18,6)").alias("centrality"),
        F.try_divide("m", F.col("n") * (F.col("n") - 1)).cast("decimal(18,6)").alias("density"),
    )
    return rows.orderBy(F.desc("degree"), "full_name").limit(top)


def cohesion(tables: DataFrame) -> DataFrame:
    """Per schema the share of its possible table pairs that a foreign key links; 1 for a single table."""
    schema = tables.select("full_name", "schema_name")
    e = fk_edges(tables).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = e.join(schema.toDF("_a", "sa"), F.col("a") == F.col("_a")).join(schema.toDF("_b", "sb"), F.col("b") == F.col("_b")).where("sa = sb")
    inside = e.groupBy(F.col("sa").alias("_s")).agg(F.count("*").alias("inside"))
    sizes = tables.groupBy("schema_name").agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    share = F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("inside", F.lit(0)) / pairs)
    return sizes.join(inside, F.col("schema_name") == F.col("_s"), "left").select("schema_name", "n", share.cast("decimal(18,6)").alias("cohesion"))


def surprising_joins(tables: DataFrame, top: int = 20) -> DataFrame:
    """Foreign keys between schemas whose ends share the fewest other neighbours.

    Surprise is 1 - |common| / |all| of the ends' neighbours besides each other, 1 without any. Common neighbours
    come from a join of edges on the shared neighbour, so no table's neighbours are gathered in one row.
    """
    e = fk_edges(tables).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = both.groupBy(F.col("a").alias("_d")).agg(F.count("*").alias("deg"))
    schema = tables.select("full_name", "schema_name")
    far = e.join(schema.toDF("_x", "sa"), F.col("a") == F.col("_x")).join(schema.toDF("_y", "sb"), F.col("b") == F.col("_y")).where("sa <> sb").select("a", "b")
    near = both.toDF("p", "q")
    common = far.join(near, F.col("a") == F.col("p")).select("a", "b", "q")
    common = common.join(both.toDF("r", "s"), (F.col("b") == F.col("r")) & (F.col("q") == F.col("s")), "left_semi").groupBy("a", "b").agg(F.count("*").alias("common"))
    rows = far.join(common.toDF("_a", "_b", "common"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").fillna(0, ["common"])
    rows = rows.join(deg.toDF("_da", "da"), F.col("a") == F.col("_da")).join(deg.toDF("_db", "db"), F.col("b") == F.col("_db"))
    every = F.col("da") - 1 + F.col("db") - 1 - F.col("common")
    surprise = F.when(every <= 0, 1.0).otherwise(1 - F.col("common") / every)
    return rows.select("a", "b", surprise.cast("decimal(18,4)").alias("surprise")).orderBy(F.desc("surprise"), "a", "b").limit(top)


def insights(tables: DataFrame, columns: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Findings of the snapshot's rules: (code, severity, table_name, column_name).

    A circle of foreign keys is one finding for each cycle that `graph.circular` writes, as column_name from its table_name; an
    island of two tables or more one for its least table. Sequences (sequence) without a table are named as table_name.
    """
    none = F.lit(None).cast("string")
    tables, columns = cut(tables, "tables"), cut(columns, "columns")  # a dozen rules read them

    def found(df: DataFrame, code: str, severity: str, table: str = "full_name", column: Column = none) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(table).alias("table_name"), column.alias("column_name"))

    col = F.col("column_name")
    key = columns.where(F.col("column_name").rlike(REFERENCE_SUFFIX) & ~F.col("is_pk"))
    idx = tables.select("full_name", F.posexplode("indexes").alias("i", "x")).select("full_name", "i", F.array_sort("x.columns").alias("cols"))
    dup = idx.groupBy("full_name", "cols").agg(F.count("*").alias("n")).where("n > 1")
    uniq = tables.select("full_name", F.explode("constraints").alias("c")).where("c.type = 'unique'").select("full_name", F.array_sort(F.array_distinct("c.columns")).alias("cols"))
    have = idx.select(F.col("full_name").alias("_t"), F.array_sort(F.array_distinct("cols")).alias("_cols"))
    uncovered = uniq.join(have, (F.col("full_name") == F.col("_t")) & (F.col("cols") == F.col("_cols")), "left_anti")
    rules = [
        found(orphans(tables), "ORPHAN_TABLE", "warning"),
        found(missing_pk(tables), "NO_PK", "error"),
        found(tables.where((F.size("indexes") <= 0) & (F.col("column_count") > 2)), "NO_INDEXES", "info"),
        found(tables.where("column_count > 20"), "WIDE_TABLE", "info"),
        found(tables.where("coalesce(table_comment, '') = ''"), "EMPTY_TABLE_COMMENT", "info"),
        found(key.where("NOT is_fk"), "MISSING_FK_CANDIDATE", "warning", "table_name", col),
        found(columns.where("is_fk AND nullable"), "NULLABLE_FK", "info", "table_name", col),
        found(unresolved_fks(tables), "UNRESOLVED_FK", "error", "from_table", F.col("to_table")),
        found(columns.where("is_pk AND nullable"), "NULLABLE_PK", "error", "table_name", col),
        found(key.where(F.col("raw_type").isin("VARCHAR", "VARCHAR2", "CHAR", "NVARCHAR", "NCHAR", "TEXT")), "VARCHAR_ID", "warning", "table_name", col),
        found(dup, "DUPLICATE_INDEX", "warning", "full_name", F.array_join("cols", ",")),
        found(uncovered, "UNIQUE_WITHOUT_INDEX", "info", "full_name", F.array_join("cols", ",")),
        found(god_tables(tables), "GOD_TABLE", "info"),
        found(surprising_joins(tables), "SURPRISING_JOIN", "info", "a", F.col("b")),
    ]
    edges = fk_edges(tables)
    circles = graph.circular(edges).withColumn("first", F.split_part("cycle", F.lit(" → "), F.lit(1)))
    rules.append(found(circles, "CIRCULAR_FK", "warning", "first", F.col("cycle")))
    apart = graph.islands(edges, tables.select(F.col("full_name").alias("node"))).where("rank > 0 AND size > 1")
    rules.append(found(apart, "ISLAND", "warning", "component"))
    if sequences is not None:
        rules.append(found(orphan_sequences(sequences, tables), "ORPHAN_SEQUENCE", "info", "sequence"))
    return reduce(DataFrame.unionByName, rules)


def property_nodes(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(node, type, label) of tables, columns and the migrations that create or change tables."""
    versions = tables.select(F.explode(F.array_compact(F.concat(F.array("created_in"), F.coalesce("modified_in", F.array().cast("array<string>"))))).alias("v")).distinct()
    return (
        tables.select(F.col("full_name").alias("node"), F.lit("table").alias("type"), F.element_at(F.split("full_name", "[.]"), -1).alias("label"))
        .unionByName(columns.select(F.concat_ws(".", "table_name", "column_name").alias("node"), F.lit("column").alias("type"), F.col("column_name").alias("label")))
        .unionByName(versions.select(F.concat(F.lit("migration:"), "v").alias("node"), F.lit("migration").alias("type"), F.concat(F.lit("V"), "v").alias("label")))
    )


def property_edges(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(src, dst, relation) of the property graph: contains, foreign_key, creates, modifies."""
    version = lambda c: F.concat(F.lit("migration:"), c)
    changed = tables.select("full_name", F.explode(F.array_distinct("modified_in")).alias("v"), "created_in").where("NOT v <=> created_in")
    return (
        columns.select(F.col("table_name").alias("src"), F.concat_ws(".", "table_name", "column_name").alias("dst"), F.lit("contains").alias("relation"))
        .unionByName(fk_edges(tables).withColumn("relation", F.lit("foreign_key")))
        .unionByName(tables.where("created_in IS NOT NULL").select(version("created_in").alias("src"), F.col("full_name").alias("dst"), F.lit("creates").alias("relation")))
        .unionByName(changed.select(version("v").alias("src"), F.col("full_name").alias("dst"), F.lit("modifies").alias("relation")))
    )


def graph_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(warning, n) of a property graph (node, type, label), (src, dst, relation): what lacks an attribute, nodes but migrations that no edge
    touches, ends of edges that are no nodes, and the number of components if there are several. What is well has no row."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("_n")).distinct()
    alone = nodes.where("type <> 'migration'").join(touched, F.col("node") == F.col("_n"), "left_anti")
    loose = touched.join(nodes.select("node"), F.col("node") == F.col("_n"), "left_anti")
    parts = graph.components(edges, nodes).select("component").distinct()
    counts = [
        nodes.select(F.lit("missing type or label").alias("warning"), F.count_if(F.col("type").isNull() | F.col("label").isNull()).alias("n")),
        edges.select(F.lit("missing relation").alias("warning"), F.count_if(F.col("relation").isNull()).alias("n")),
        alone.select(F.lit("isolated nodes").alias("warning"), F.count("*").alias("n")),
        loose.select(F.lit("unknown ends of edges").alias("warning"), F.count("*").alias("n")),
        parts.select(F.lit("components").alias("warning"), F.when(F.count("*") > 1, F.count("*")).otherwise(0).alias("n")),
    ]
    return reduce(DataFrame.unionByName, counts).where("n > 0")
