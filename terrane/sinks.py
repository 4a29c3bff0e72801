"""Writing manifests, caches, diagrams and reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrane.operators import catalog, graph, migrations, render
from terrane.operators.diff import full_diff

MAX_DRAWN = 20_000  # objects of one diagram or page; more are refused, as they are drawn on the driver


def write_text(text: str, path: str | None = None) -> None:
    """To a file, replaced at once, or to standard output."""
    if path is None:
        print(text)
        return
    draft = Path(f"{path}.part")
    draft.write_text(text)
    os.replace(draft, path)


def update_manifest(known: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """A manifest (filename, hash, first_seen, last_modified) brought up to the files there are; vanished files go."""
    d = full_diff(known, current.withColumn("first_seen", F.lit(None).cast("string")).withColumn("last_modified", F.lit(None).cast("string")), ["filename"], ["hash", "first_seen", "last_modified"])
    d = d.where("b_hash IS NOT NULL")
    same = F.col("a_hash").eqNullSafe(F.col("b_hash"))
    return d.select(
        "filename", F.col("b_hash").alias("hash"), F.coalesce("a_first_seen", F.lit(now)).alias("first_seen"), F.when(same, F.col("a_last_modified")).otherwise(F.lit(now)).alias("last_modified")
    )


class ChunkCache:
    """Chunks by the fingerprint of the files they were made from; the newest `keep` fingerprints stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, fingerprint: str, chunks: DataFrame, created_at: str) -> None:
        rows = chunks.withColumn("created_at", F.lit(created_at)).withColumn("fingerprint", F.lit(fingerprint))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(self.path)

    def get(self, fingerprint: str) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.path).where(F.col("fingerprint") == fingerprint)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return None if rows.isEmpty() else rows.drop("fingerprint", "created_at")

    def expired(self, keep: int) -> DataFrame:
        """(fingerprint, created_at) beyond the `keep` newest; one row per fingerprint."""
        ages = self.spark.read.parquet(self.path).groupBy("fingerprint").agg(F.max("created_at").alias("created_at"))
        rank = F.row_number().over(W.orderBy(F.desc("created_at"), "fingerprint"))
        return ages.withColumn("_r", rank).where(F.col("_r") > keep).drop("_r")

    def collect_garbage(self, keep: int) -> int:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = [r.fingerprint for r in self.expired(keep).collect()]
        for f in gone:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/fingerprint={f}")
            p.getFileSystem(conf).delete(p, True)
        return len(gone)


def _few(df: DataFrame) -> list:
    rows = df.limit(MAX_DRAWN + 1).collect()
    if len(rows) > MAX_DRAWN:
        raise ValueError(f"more than {MAX_DRAWN} objects; write the rows of terrane.operators.render instead")
    return rows


def dot(tables: DataFrame, title: str = "schema") -> str:
    """The tables and foreign keys as a Graphviz graph; tables without links in a cluster of their own."""
    rows = _few(catalog.with_degrees(tables).select("full_name", "column_count", "fk_in", "fk_out", render.identifier(F.col("full_name")).alias("i")).orderBy("full_name"))
    edges = _few(render.dot_edges(catalog.relationships(tables)).orderBy("source", "line"))
    node = lambda r: f'  {r.i} [label="{r.full_name}\\n{r.column_count} columns"];'
    lone = [node(r) for r in rows if not r.fk_in and not r.fk_out]
    linked = [node(r) for r in rows if r.fk_in or r.fk_out]
    return "\n".join([f'digraph "{title}" {{', "  node [shape=box];", *linked, "  subgraph cluster_lone {", '  label="no links";', *lone, "  }", *(e.line for e in edges), "}"]) + "\n"


def summary(tables: DataFrame) -> str:
    """One line per table with what it refers to and what refers to it."""
    r = catalog.relationships(tables)
    out = r.groupBy(F.col("from_table").alias("_o")).agg(F.array_join(F.array_sort(F.collect_set("to_table")), ", ").alias("to"))
    into = r.groupBy(F.col("to_table").alias("_i")).agg(F.array_join(F.array_sort(F.collect_set("from_table")), ", ").alias("by"))
    rows = tables.select("full_name", "column_count").join(out, F.col("full_name") == F.col("_o"), "left").join(into, F.col("full_name") == F.col("_i"), "left")
    lines = []
    for t in _few(rows.orderBy("full_name")):
        lines.append(f"{t.full_name} ({t.column_count})" + (f" -> {t.to}" if t.to else "") + (f" <- {t.by}" if t.by else ""))
    return "\n".join(lines) + "\n"


def mermaid(tables: DataFrame, columns: DataFrame) -> str:
    cols: dict[str, list[str]] = {}
    kind = F.regexp_replace(F.col("data_type"), r"\(.*\)", "")
    marks = F.concat_ws(",", F.when(F.col("is_pk"), "PK"), F.when(F.col("is_fk"), "FK"))
    for r in _few(columns.select("table_name", "ord", render.identifier(kind).alias("k"), "column_name", marks.alias("m")).orderBy("table_name", "ord")):
        cols.setdefault(r.table_name, []).append(f"        {r.k} {r.column_name} {r.m}".rstrip())
    out = ["erDiagram"]
    for r in _few(tables.select("full_name", render.identifier(F.col("full_name")).alias("i")).orderBy("full_name")):
        out += [f"    {r.i} {{", *cols.get(r.full_name, []), "    }"]
    return "\n".join(out + [e.line for e in _few(render.mermaid_edges(catalog.relationships(tables)).orderBy("source", "line"))]) + "\n"


def excalidraw(tables: DataFrame) -> str:
    """Boxes on a grid with their names, and arrows for foreign keys, as a drawing's JSON."""
    elements, at = [], {}
    for r in _few(render.grid(tables).orderBy("schema_name", "full_name")):
        i = f"t{len(at)}"
        at[r.full_name] = i
        elements.append({"type": "rectangle", "id": i, "x": r.x, "y": r.y, "width": 260, "height": 120})
        elements.append({"type": "text", "id": f"{i}-name", "x": r.x + 10, "y": r.y + 10, "text": r.full_name, "containerId": i})
    for n, r in enumerate(_few(catalog.relationships(tables).orderBy("from_table", "to_table", "name"))):
        if r.to_table in at and r.from_table in at:
            elements.append({"type": "arrow", "id": f"e{n}", "startBinding": {"elementId": at[r.from_table]}, "endBinding": {"elementId": at[r.to_table]}})
    return json.dumps({"type": "excalidraw", "version": 2, "elements": elements}, indent=1)


def drawio(tables: DataFrame) -> str:
    from xml.sax.saxutils import quoteattr

    cells, at = [], {}
    for r in _few(render.grid(tables).orderBy("schema_name", "full_name")):
        at[r.full_name] = f"t{len(at)}"
        geometry = f'<mxGeometry x="{r.x}" y="{r.y}" width="260" height="120" as="geometry"/>'
        cells.append(f'<mxCell id="{at[r.full_name]}" value={quoteattr(r.full_name)} vertex="1" parent="1">{geometry}</mxCell>')
    for n, r in enumerate(_few(catalog.relationships(tables).orderBy("from_table", "to_table", "name"))):
        if r.to_table in at and r.from_table in at:
            cells.append(f'<mxCell id="e{n}" edge="1" parent="1" source="{at[r.from_table]}" target="{at[r.to_table]}"><mxGeometry relative="1" as="geometry"/></mxCell>')
    return '<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>' + "".join(cells) + "</root></mxGraphModel></diagram></mxfile>\n"


def html(tables: DataFrame, columns: DataFrame, findings: DataFrame | None = None, title: str = "Schema") -> str:
    """One page with a card per table, and the findings."""
    from html import escape

    cols: dict[str, list] = {}
    for r in _few(columns.orderBy("table_name", "ord")):
        cols.setdefault(r.table_name, []).append(r)
    cards = []
    for t in _few(tables.select("full_name", "table_comment", "created_in").orderBy("full_name")):
        lines = "".join(f"<tr><td>{escape(c.column_name)}</td><td>{escape(c.data_type or '')}</td><td>{'' if c.nullable else 'not null'}</td></tr>" for c in cols.get(t.full_name, []))
        cards.append(f"<section><h2>{escape(t.full_name)}</h2><p>{escape(t.table_comment or '')}</p><table>{lines}</table></section>")
    said = ""
    if findings is not None:
        items = "".join(f"<li class={r.severity}>{escape(r.code)} {escape(r.table_name or '')} {escape(r.column_name or '')}</li>" for r in _few(findings.orderBy("severity", "code", "table_name", "column_name")))
        said = f"<section><h2>Findings</h2><ul>{items}</ul></section>"
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>{said}{''.join(cards)}\n"


def graph_json(tables: DataFrame, communities: DataFrame) -> str:
    """Nodes with community and degree, and links."""
    return json.dumps(_graph(tables, communities), indent=1)


def _graph(tables: DataFrame, communities: DataFrame) -> dict:
    d = catalog.with_degrees(tables).select("full_name", (F.col("fk_in") + F.col("fk_out")).alias("degree"))
    nodes = d.join(communities.withColumnRenamed("node", "full_name"), "full_name", "left").orderBy("full_name")
    links = catalog.fk_edges(tables).orderBy("src", "dst")
    return {"nodes": [{"id": r.full_name, "degree": r.degree, "community": r.community} for r in _few(nodes)], "links": [{"source": r.src, "target": r.dst} for r in _few(links)]}


# The ten colours of communities.
COLOURS = ("#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC")

_PAGE = """<!doctype html><meta charset=utf-8><title>{title}</title><style>body{{font:13px sans-serif;margin:0}}#q{{position:fixed;left:1em;top:1em}}circle{{stroke:#fff}}line{{stroke:#bbb}}</style>
<input id=q placeholder="name"><svg id=s width=1200 height=800></svg><script>
const g={body},colours={colours},svg=document.getElementById("s"),make=(n,a)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",n);for(const k in a)e.setAttribute(k,a[k]);svg.append(e);return e}};
const names=[...new Set(g.nodes.map(n=>n.community))],at={{}};
g.nodes.forEach((n,i)=>{{const c=names.indexOf(n.community),t=2*Math.PI*i/g.nodes.length;at[n.id]=[600+(250+20*(c%8))*Math.cos(t),400+(250+20*(c%8))*Math.sin(t)]}});
g.links.forEach(l=>{{const a=at[l.source],b=at[l.target];if(a&&b)make("line",{{x1:a[0],y1:a[1],x2:b[0],y2:b[1]}})}});
const drawn=g.nodes.map(n=>{{const e=make("circle",{{cx:at[n.id][0],cy:at[n.id][1],r:4+Math.sqrt(n.degree),fill:n.community=="-1"?"#999":colours[names.indexOf(n.community)%colours.length]}});const t=document.createElementNS("http://www.w3.org/2000/svg","title");t.textContent=n.id+" ("+n.degree+")";e.append(t);return [n.id.toLowerCase(),e]}});
document.getElementById("q").oninput=e=>drawn.forEach(([n,c])=>c.setAttribute("opacity",n.includes(e.target.value.toLowerCase())?1:.15));
</script>
"""


def graph_html(tables: DataFrame, communities: DataFrame, title: str = "Schema graph") -> str:
    """A page that draws tables and foreign keys, coloured by community, with a box that looks for names."""
    from html import escape

    body = json.dumps(_graph(tables, communities)).replace("</", "<\\/")
    return _PAGE.format(title=escape(title), body=body, colours=json.dumps(COLOURS))


def report(tables: DataFrame, columns: DataFrame, communities: DataFrame, most: int = 20) -> str:
    """A Markdown report: counts, density, components, the most linked tables, the `most` largest communities and how many there are besides."""
    s = catalog.state_stats(tables, columns).first()
    top = catalog.graph_metrics(tables).collect()
    parts = graph.islands(catalog.fk_edges(tables), tables.select(F.col("full_name").alias("node"))).agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    groups = catalog.domains(catalog.fk_edges(tables), communities)
    n = groups.count()
    shown = groups.orderBy(F.desc("size"), "community").limit(most).collect()
    out = ["# Schema", "", f"- tables: {s.tables}", f"- columns: {s.columns}", f"- foreign keys: {s.relationships}", f"- density: {top[0].density if top else 0}", f"- components: {parts.n}, the largest of {parts.size or 0} tables"]
    out += ["", "## Most linked", "", *(f"- {r.full_name}: {r.degree} ({r.centrality})" for r in top), "", "## Communities", ""]
    out += [f"- {r.name} ({r.community}): {r.size} tables, cohesion {r.cohesion}" for r in shown]
    return "\n".join([*out, *([f"- and {n - most} smaller ones"] if n > most else [])]) + "\n"


def migration_dot(files: DataFrame, links: DataFrame, circular: DataFrame | None = None, critical: DataFrame | None = None) -> str:
    """The graph of `operators.migrations`; circular files are salmon, those of a longest chain gold."""
    lines = _few(migrations.dot_lines(files, links, circular, critical).orderBy("part", "source_file", "line"))
    return "\n".join(["digraph migrations {", "  rankdir=LR;", "  node [shape=box, style=rounded];", *(r.line for r in lines), "}"]) + "\n"


def _needs(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("source_file").alias("_s")).agg(F.array_sort(F.collect_set("depends_on")).alias("depends_on"))


def timeline(files: DataFrame, links: DataFrame) -> str:
    """One block per file in the order of versions as text: what it creates, changes and depends on."""
    rows = _few(migrations.timeline(files).join(_needs(links), F.col("source_file") == F.col("_s"), "left").orderBy("place"))
    out = ["Migration timeline", ""]
    for r in rows:
        out.append(f"  {r.version}: {r.description} [{r.source_file}]")
        out += [f"    {what}: {', '.join(names)}" for what, names in (("creates", r.creates), ("alters", r.alters), ("depends on", r.depends_on)) if names]
    return "\n".join([*out, "", f"{len(rows)} migrations, {sum(len(r.depends_on or ()) for r in rows)} dependencies"]) + "\n"


def migration_json(files: DataFrame, links: DataFrame) -> str:
    rows = _few(files.join(_needs(links), F.col("source_file") == F.col("_s"), "left").drop("_s").orderBy("version", "source_file"))
    nodes = [r.asDict() | {"depends_on": r.depends_on or []} for r in rows]
    edges = [{"from": r["source_file"], "to": x} for r in nodes for x in r["depends_on"]]
    return json.dumps({"nodes": nodes, "edges": edges, "stats": {"migration_count": len(nodes), "dependency_count": len(edges)}}, indent=1)


def dependency_text(files: DataFrame, links: DataFrame, issues: DataFrame, critical: DataFrame) -> str:
    """Counts, the longest chain, and the issues of `rules.dependency_issues` by severity."""
    chain = " → ".join(r.node for r in critical.orderBy("level").collect())
    found = _few(issues.orderBy("severity", "code", "source_file", "object"))
    out = [f"{files.count()} migrations, {links.count()} dependencies", f"Longest chain: {chain or 'none'}", f"{len(found)} issues"]
    return "\n".join([*out, *(f"  [{r.severity}] {r.code} {r.source_file}{' ' + r.object if r.object else ''}" for r in found)]) + "\n"


def lineage_text(links: DataFrame, start: str, depth: int = 5) -> str:
    """The columns that (src, dst) leads to from `start`, indented by their distance."""
    found = _few(graph.reach(links, links.sparkSession.createDataFrame([(start,)], "node string"), depth).orderBy("depth", "node"))
    return "\n".join("  " * r.depth + r.node + (f" (from {r.parent})" if r.parent else "") for r in found) + "\n"


def lineage_mermaid(links: DataFrame, start: str, depth: int = 5) -> str:
    """The edges of (src, dst) within `depth` steps of `start`, as a Mermaid flow chart."""
    found = graph.reach(links, links.sparkSession.createDataFrame([(start,)], "node string"), depth)
    near = found.where(F.col("depth") < depth).select(F.col("node").alias("src"))
    rows = _few(links.join(near, "src", "left_semi").select("src", "dst", render.identifier(F.col("src")).alias("a"), render.identifier(F.col("dst")).alias("b")).distinct().orderBy("src", "dst"))
    return "\n".join(["flowchart LR", *(f'    {r.a}["{r.src}"] --> {r.b}["{r.dst}"]' for r in rows)]) + "\n"


def lineage_json(links: DataFrame, start: str, depth: int = 5) -> str:
    found = graph.reach(links, links.sparkSession.createDataFrame([(start,)], "node string"), depth).orderBy("depth", "node")
    return json.dumps({"start": start, "columns": [r.asDict() for r in _few(found)]}, indent=1)


DIAGRAMS = {"dot": ("dot", dot), "mermaid": ("mmd", mermaid), "excalidraw": ("excalidraw", excalidraw), "drawio": ("drawio", drawio)}


def export(tables: DataFrame, columns: DataFrame, folder: str, form: str = "all") -> list[str]:
    """Write the diagram of that form, or of all, to `folder`; the paths written."""
    if form != "all" and form not in DIAGRAMS:
        raise ValueError(f"no form {form}; there are all, {', '.join(DIAGRAMS)}")
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for name, (ending, draw) in DIAGRAMS.items():
        if form in ("all", name):
            out.append(str(Path(folder) / f"schema.{ending}"))
            write_text(draw(tables, columns) if name == "mermaid" else draw(tables), out[-1])
    return out


def plain_yaml(value, depth: int = 0) -> str:
    """Lists, dictionaries and scalars as YAML; texts are written as JSON strings, which YAML reads."""
    pad = "  " * depth
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:" + (f"\n{plain_yaml(v, depth + 1)}" if isinstance(v, dict | list) and v else f" {json.dumps(v, default=str, ensure_ascii=False)}\n") for k, v in value.items())
    return "".join(f"{pad}-\n{plain_yaml(v, depth + 1)}" if isinstance(v, dict | list) and v else f"{pad}- {json.dumps(v, default=str, ensure_ascii=False)}\n" for v in value)


def snapshot_yaml(tables: DataFrame, columns: DataFrame, version: str | None = None) -> str:
    return plain_yaml(json.loads(snapshot_json(tables, columns, version)))


def snapshot_manifest(tables: DataFrame, columns: DataFrame, version: str | None = None) -> dict:
    """The snapshot's version, counts and fingerprints."""
    prints = catalog.fingerprints(columns, tables).orderBy("schema_name")
    return {"version": version, "stats": catalog.state_stats(tables, columns).first().asDict(), "fingerprints": {r.schema_name or "": r.fingerprint for r in _few(prints)}}


def snapshot_json(tables: DataFrame, columns: DataFrame, version: str | None = None) -> str:
    """The whole snapshot as camel-cased JSON."""
    cols: dict[str, list] = {}
    for r in _few(columns.orderBy("table_name", "ord")):
        cols.setdefault(r.table_name, []).append(r.asDict())
    camel = lambda x: "".join(p.capitalize() if i else p for i, p in enumerate(x.split("_")))

    def shaped(x):
        if hasattr(x, "asDict"):
            x = x.asDict()
        if isinstance(x, dict):
            return {camel(k): shaped(v) for k, v in x.items()}
        return [shaped(y) for y in x] if isinstance(x, list) else x

    rows = [shaped(t.asDict()) | {"columns": shaped(cols.get(t.full_name, []))} for t in _few(tables.drop("created_at", "dropped_at", "columns").orderBy("full_name"))]
    return json.dumps({"version": version, "stats": shaped(catalog.state_stats(tables, columns).first()), "tables": rows}, indent=1, default=str)


def contract(df: DataFrame | StructType, name: str, version: int = 1) -> str:
    """The schema that a result promises, as JSON."""
    schema = df if isinstance(df, StructType) else df.schema
    return json.dumps({"contract": f"{name}@v{version}", "schema": json.loads(schema.json())}, indent=1)


def assert_contract(df: DataFrame, text: str) -> None:
    """Fails where a result's columns or types are not those of its contract."""
    want = StructType.fromJson(json.loads(text)["schema"])
    plain = lambda s: [(f.name, f.dataType) for f in s.fields]
    if plain(df.schema) != plain(want):
        raise ValueError(f"the result is {df.schema.simpleString()}, its contract {want.simpleString()}")


class Contracts:
    """Contracts by name and version: all, one, the latest of a name, those of a command."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], dict] = {}

    def add(self, name: str, version: str, schema: StructType, command: str = "", deprecated: bool = False) -> None:
        self.held[name, version] = {"name": name, "version": version, "schema": schema, "command": command, "deprecated": deprecated}

    def all(self) -> list[dict]:
        return [self.held[k] for k in sorted(self.held)]

    def get(self, name: str, version: str) -> dict | None:
        return self.held.get((name, version))

    def latest(self, name: str) -> dict | None:
        """One that is not deprecated before any that is, then the greatest version as text."""
        return max((c for (n, _), c in self.held.items() if n == name), key=lambda c: (not c["deprecated"], c["version"]), default=None)

    def of_command(self, command: str) -> list[dict]:
        return [c for c in self.all() if c["command"] == command]
