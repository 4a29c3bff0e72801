"""python -m terrane FOLDER COMMAND [ARGUMENT]: questions to the migrations in a folder."""

from __future__ import annotations

import sys

from terrane import sinks
from terrane.config import Settings
from terrane.engine import Schema
from terrane.operators import graph, rules
from terrane.session import build_session

SETTINGS = Settings.load()
COMMANDS = {
    "dump": lambda s, a: sinks.snapshot_json(s.tables, s.columns),
    "dot": lambda s, a: sinks.dot(s.tables),
    "summary": lambda s, a: sinks.summary(s.tables),
    "mermaid": lambda s, a: sinks.mermaid(s.tables, s.columns),
    "excalidraw": lambda s, a: sinks.excalidraw(s.tables),
    "drawio": lambda s, a: sinks.drawio(s.tables),
    "html": lambda s, a: sinks.html(s.tables, s.columns, s.query("insights")),
    "report": lambda s, a: sinks.report(s.tables, s.columns, s.query("domains")),
    "classify": lambda s, a: rules.classify(s.kinds),
    "safety": lambda s, a: rules.safety(s.kinds),
    "cost": lambda s, a: rules.cost(s.kinds, a or SETTINGS.cost_profile),
    "gate": lambda s, a: rules.gate(rules.safety(s.kinds), a or SETTINGS.gate_level),
    "rollback": lambda s, a: rules.rollback_plan(s.ops),
    "naming": lambda s, a: rules.naming(s.files, "filename", SETTINGS.naming_pattern),
    "yaml": lambda s, a: sinks.snapshot_yaml(s.tables, s.columns),
    "build": lambda s, a: "\n".join(s.build(a or "schema-build")),
    "export": lambda s, a: "\n".join(sinks.export(s.tables, s.columns, a or "schema-build")),
    "graph": lambda s, a: sinks.graph_html(s.tables, s.query("domains")),
    "timeline": lambda s, a: sinks.timeline(*s.migration_graph()),
    "migrations": lambda s, a: sinks.migration_dot(*s.migration_graph()),
    "dependencies": lambda s, a: sinks.dependency_text(*s.migration_graph(), rules.dependency_issues(s.log), s.critical_path()),
    "lineage-from": lambda s, a: sinks.lineage_mermaid(s.lineage(), a.upper()),
    "objects": lambda s, a: s.at(a).object_diff(s)[0],
    "impact-diff": lambda s, a: s.impact_of_diff(s.folder, a or "HEAD"),
    "lint": lambda s, a: rules.lint(s.files, "filename", "sql"),
    "lineage": lambda s, a: s.lineage(),
    "simulate": lambda s, a: s.simulation_text(a),
    "diff": lambda s, a: s.at(a).diff(s)[1],
    "ask": lambda s, a: s.ask(a, SETTINGS.question_chunks),
    "impact": lambda s, a: graph.cascade(s.relationships, a.upper()),
}


def main(args: list[str]) -> int:
    args = [SETTINGS.migrations_dir, *args] if len(args) == 1 else args
    if len(args) < 2:
        print(__doc__, "\nCommands:", ", ".join(sorted(COMMANDS)), "and the kinds of Schema.query", file=sys.stderr)
        return 2
    folder, command, argument = args[0], args[1], args[2] if len(args) > 2 else None
    spark = build_session("terrane", **{"spark.sql.shuffle.partitions": "8"})
    s = Schema.read(spark, folder, SETTINGS.recursive)
    s.folder = folder
    out = COMMANDS[command](s, argument) if command in COMMANDS else s.query(command)
    if isinstance(out, str):
        print(out)
        return 0
    for line in out.toJSON().toLocalIterator():
        print(line)
    return out.first().exit_code if command == "gate" else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
