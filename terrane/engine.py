"""One schema from its migration files: everything that can be asked of it."""

from __future__ import annotations

import json
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import sinks
from terrane.ddl import extract, fold, lineage
from terrane.functions.names import version_key
from terrane.functions.versions import file_version, next_version
from terrane.operators import catalog, diff, graph, migrations, retrieval, rules
from terrane.session import cut, ship
from terrane.sources import git


class Schema:
    """The schema that a log of migrations (filename, sql) leaves. Parsed once; results are DataFrames."""

    def __init__(self, files: DataFrame):
        ship(files.sparkSession)
        self.files = files

    @classmethod
    def read(cls, spark: SparkSession, folder: str, recursive: bool = True) -> Schema:
        from terrane.sources.migrations import sql_files

        return cls(sql_files(spark, folder, recursive))

    @cached_property
    def ops(self) -> DataFrame:
        return cut(extract.migration_ops(self.files), "ops")

    @cached_property
    def tables(self) -> DataFrame:
        return cut(fold.snapshot(self.ops), "tables")

    @cached_property
    def columns(self) -> DataFrame:
        return fold.column_state(self.tables)

    @property
    def sequences(self) -> DataFrame:
        return fold.sequences(self.ops)

    @property
    def relationships(self) -> DataFrame:
        return catalog.relationships(self.tables)

    def at(self, version: str) -> Schema:
        """The schema after all files up to `version`; files without a version always count."""
        key = version_key(F.lit(version))
        return Schema(self.files.where(version_key(file_version(F.col("filename"))) <= key))

    def query(self, kind: str, **args) -> DataFrame:
        """tables, columns, indexes, refs, orphans, islands, cycles, missing-pk, missing-fk, impact, fk-path, insights, pii, stats."""
        t, c = self.tables, self.columns
        edges, nodes = catalog.fk_edges(t), t.select(F.col("full_name").alias("node"))
        known = {
            "tables": lambda: catalog.filter_tables(t, **args),
            "columns": lambda: catalog.filter_columns(c, **args),
            "indexes": lambda: catalog.filter_indexes(t, **args),
            "refs": lambda: catalog.references_of(t, **args),
            "orphans": lambda: catalog.orphans(t),
            "islands": lambda: graph.islands(edges, nodes),
            "cycles": lambda: graph.circular(edges, **args),
            "missing-pk": lambda: catalog.missing_pk(t),
            "missing-fk": lambda: catalog.missing_fk(c),
            "impact": lambda: graph.cascade(self.relationships, **args),
            "fk-path": lambda: graph.shortest_path(edges, **args),
            "insights": lambda: catalog.insights(t, c, self.sequences),
            "pii": lambda: rules.pii(c, **args),
            "stats": lambda: catalog.state_stats(t, c),
            "domains": lambda: graph.communities(edges, nodes),
            "levels": lambda: graph.levels(edges, nodes),
            "property-nodes": lambda: catalog.property_nodes(t, c),
            "property-edges": lambda: catalog.property_edges(t, c),
            "graph-warnings": lambda: catalog.graph_warnings(catalog.property_nodes(t, c), catalog.property_edges(t, c)),
            "table": lambda: catalog.find_table(t, **args),
        }
        if kind not in known:
            raise ValueError(f"no query {kind}; there are {', '.join(sorted(known))}")
        return known[kind]()

    @cached_property
    def kinds(self) -> DataFrame:
        """Statements with kind, category, risk, cost weight and rollback penalty."""
        o = self.ops.where("op_idx = 0").select(
            F.col("filename").alias("source_file"), F.col("stmt_idx").alias("statement_index"), "raw_sql", "version", F.lit(None).cast("timestamp").alias("arrived_at"), F.lit(0).alias("op_id")
        )
        return rules.with_kinds(o)

    def lineage(self) -> DataFrame:
        return lineage.lineage(self.files)

    def diff(self, other: Schema) -> tuple[DataFrame, DataFrame]:
        """Changes of tables and of columns from this schema to `other`."""
        c = diff.column_changes(self.columns, other.columns)
        return diff.table_changes(self.tables, other.tables, c), c

    def object_diff(self, other: Schema) -> tuple[DataFrame, DataFrame]:
        """Changes of constraints, indexes and relationships, and of sequences."""
        return diff.object_changes(self.tables, other.tables), diff.sequence_changes(self.sequences, other.sequences)

    def drift(self, other: Schema) -> DataFrame:
        return diff.drift(self.tables, self.columns, other.tables, other.columns)

    def constraint_drift(self, other: Schema) -> DataFrame:
        return diff.constraint_drift(self.tables, other.tables)

    def simulate(self, sql: str) -> Schema:
        """The schema if `sql` were the next migration."""
        spark = self.files.sparkSession
        last = self.ops.agg(F.max(F.struct("file_key", "version")).alias("m")).select("m.version")
        version = last.select(next_version(F.coalesce("version", F.lit("0")))).first()[0]
        more = spark.createDataFrame([(f"V{version}__simulated.sql", sql)], "filename string, sql string")
        return Schema(self.files.select("filename", "sql").unionByName(more))

    def simulation(self, sql: str) -> dict:
        """What the next migration `sql` would do: version, changes, findings by severity, score, grade, and whether it can be undone."""
        after = self.simulate(sql)
        tables, columns = self.diff(after)
        found = {r.severity: r.n for r in after.query("insights").groupBy("severity").agg(F.count("*").alias("n")).collect()}
        score = max(0, 100 - 20 * found.get("error", 0) - 5 * found.get("warning", 0))
        new = after.ops.where("filename LIKE '%__simulated.sql'")
        unknown = new.where("operation = 'UNKNOWN'").count()
        undo = rules.rollback_plan(new).first()
        return {
            "sql": sql[:100], "success": unknown == 0, "unknown_statements": unknown, "score": score,
            "grade": "excellent" if score >= 90 else "good" if score >= 75 else "warning" if score >= 50 else "critical", "findings": found,
            "tables": [r.asDict() for r in tables.orderBy("full_name").limit(1_000).collect()], "columns": [r.asDict() for r in columns.orderBy("table_name", "column_name").limit(1_000).collect()],
            "rollback": undo.feasibility if undo else "reversible", "rollback_script": undo.script if undo else None,
        }

    def simulation_text(self, sql: str, lines: int = 20) -> str:
        """`simulation` as text, with the first `lines` changes."""
        r = self.simulation(sql)
        changes = [f"  {x['change']} {x['full_name']}" for x in r["tables"]] + [f"  {x['change']} {x['table_name']}.{x['column_name']} {x['diffs']}".rstrip() for x in r["columns"]]
        more = [f"  and {len(changes) - lines} more"] if len(changes) > lines else []
        head = [f"SQL: {r['sql']}", f"Success: {r['success']}", f"Score: {r['score']} ({r['grade']})", f"Rollback: {r['rollback']}", f"{len(changes)} changes:"]
        return "\n".join([*head, *changes[:lines], *more]) + "\n"

    @cached_property
    def log(self) -> DataFrame:
        """The operations in the columns of a log: (source_file, version, statement_index, operation, table_name)."""
        return self.ops.select(F.col("filename").alias("source_file"), "version", F.col("stmt_idx").alias("statement_index"), "operation", "table_name")

    def migration_graph(self) -> tuple[DataFrame, DataFrame]:
        """Files, and what they depend on."""
        return migrations.nodes(self.log), migrations.edges(self.log)

    def critical_path(self) -> DataFrame:
        """A longest chain of files that depend on one another."""
        files, links = self.migration_graph()
        return graph.critical_path(links.select(F.col("depends_on").alias("src"), F.col("source_file").alias("dst")), files.select(F.col("source_file").alias("node")))

    def changed_tables(self, files: DataFrame) -> DataFrame:
        """(node) of the tables that statements of `files` (filename) name; files are compared by their base name."""
        base = lambda c: F.element_at(F.split(c, "/"), -1)
        named = files.select(base(F.col("filename")).alias("_b")).distinct()
        return self.ops.join(named, base(F.col("filename")) == F.col("_b"), "left_semi").where("table_name IS NOT NULL").select(F.col("table_name").alias("node")).distinct()

    def impact_of(self, starts: DataFrame, max_depth: int = 5, direction: str = "in") -> DataFrame:
        """Objects of the property graph that changes to `starts` (node) affect."""
        return graph.impact(catalog.property_edges(self.tables, self.columns), catalog.property_nodes(self.tables, self.columns), starts, max_depth, direction)

    def impact_of_diff(self, folder: str, ref: str = "HEAD", staged: bool = False, **args) -> DataFrame:
        """The merged impact of the tables in .sql files of a git folder that differ from `ref`, or that are staged."""
        return self.impact_of(self.changed_tables(git.changed_files(self.files.sparkSession, folder, ref, staged)), **args)

    def build(self, folder: str) -> list[str]:
        """Everything in one folder: graph, communities, hubs, answers, findings, score, diagrams, page, report, migrations and a manifest. The paths written."""
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        t, c = self.tables, cut(self.columns, "columns")
        edges, nodes = catalog.fk_edges(t), t.select(F.col("full_name").alias("node"))
        groups = cut(graph.communities(edges, nodes, min_cohesion=0.1), "communities")
        files, links = self.migration_graph()
        texts = {
            "graph.json": sinks.graph_json(t, groups), "graph.html": sinks.graph_html(t, groups), "schema.html": sinks.html(t, c, catalog.insights(t, c, self.sequences)), "report.md": sinks.report(t, c, groups),
            "snapshot.json": sinks.snapshot_json(t, c), "snapshot.yaml": sinks.snapshot_yaml(t, c), "migrations.dot": sinks.migration_dot(files, links), "migrations.json": sinks.migration_json(files, links),
            "timeline.txt": sinks.timeline(files, links), "dependencies.txt": sinks.dependency_text(files, links, rules.dependency_issues(self.log), self.critical_path()),
            "manifest.json": json.dumps(sinks.snapshot_manifest(t, c), indent=1, default=str),
        }
        written = []
        for name, text in texts.items():
            sinks.write_text(text, str(out / name))
            written.append(str(out / name))
        rows = {
            "findings": catalog.insights(t, c, self.sequences), "communities": catalog.domains(edges, groups), "god_tables": catalog.god_tables(t), "god_columns": catalog.god_columns(t, 4),
            "orphans": catalog.orphans(t), "islands": graph.islands(edges, nodes), "cycles": graph.circular(edges), "missing_pk": catalog.missing_pk(t), "missing_fk": catalog.missing_fk(c), "pii": rules.pii(c),
        }
        for name, df in rows.items():
            df.write.mode("overwrite").json(str(out / name))
            written.append(str(out / name))
        return written + sinks.export(t, c, folder)

    def chunks(self) -> DataFrame:
        """The summary, one chunk per table, and the relationship map."""
        whole = retrieval.schema_chunks(self.tables, self.columns, self.relationships, self.sequences)
        return whole.unionByName(retrieval.table_chunks(self.tables, self.columns, self.relationships))

    def ask(self, question: str, k: int = 6) -> str:
        """The prompt for a question: the best chunks and the question."""
        c = cut(self.chunks().select("chunk_id", F.col("chunk_id").alias("title"), F.lit("").alias("hint"), "content", F.lit(None).cast("timestamp").alias("built_at")), "chunks")
        return retrieval.prompt(question, retrieval.bm25(c, question, k), c)
