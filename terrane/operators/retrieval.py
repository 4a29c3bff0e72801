"""Documents about tables, and their retrieval by words or vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.session import cut

# Words that are no search terms.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought"
    " to of in on at by for with about from into through during before after above below between and or but not no so yet both"
    " either neither each any all few more most other some such than too very just own same s t don now i me my we our you your"
    " he she it they them their what which who whom this that these those am if as up how get got table column tables columns"
).split()
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Search terms: runs of a letter and letters, digits or underscores in lower case, without stop words and single letters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9_]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def _doc_text() -> Column:
    return F.concat_ws(" ", "title", "title", "hint", "hint", "content")


def _count(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term))


def bm25(chunks: DataFrame, question: str, k: int = 6) -> DataFrame:
    """The `k` chunks that answer a question best: (chunk_id, score), the greater id first on ties.

    Only the question's terms are counted per chunk, in the scan; document frequencies and the mean length come
    from one aggregate of a few numbers, so the texts are not shuffled. Repeated chunk ids count once (the row
    built last). A term counts as often as the question repeats it; chunks without any do not appear.
    """
    spark = chunks.sparkSession
    asked = spark.range(1).select(tokens(F.lit(question)).alias("t")).head().t
    terms = sorted(set(asked))
    if not terms:
        return chunks.select("chunk_id", F.lit(0).cast("decimal(18,4)").alias("score")).limit(0)
    one = chunks.where("chunk_id IS NOT NULL").select("chunk_id", "built_at", tokens(_doc_text()).alias("t"))
    tf = [_count("t", t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = one.select("chunk_id", "built_at", F.size("t").alias("len"), *tf)
    names = ["len", *(f"tf{i}" for i in range(len(terms)))]
    counted = counted.groupBy("chunk_id").agg(F.max(F.struct("built_at", *names)).alias("x")).select("chunk_id", "x.*")
    stats = counted.select(F.struct(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))).scalar()
    rows = counted.withColumn("s", stats)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        f, df, n = F.col(f"tf{i}").cast("double"), F.col(f"s.df{i}").cast("double"), F.col("s.n").cast("double")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
        score = score + F.lit(float(asked.count(t))) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("s.avg")))
    scored = rows.select("chunk_id", score.cast("decimal(18,4)").alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("chunk_id")).limit(k)


def cosine_top(vectors: DataFrame, query: list[float], k: int = 6) -> DataFrame:
    """The `k` vectors nearest to `query` by cosine: (vec_id, score), the greater id first on ties. Vectors of another length or null are passed over."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(x * x for x in query) ** 0.5
    rows = vectors.where(F.size("embedding") == len(query)).withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    dot = F.aggregate(F.zip_with("v", q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.select("vec_id", (dot / (size * norm + 1e-9)).cast("decimal(18,4)").alias("score"))
    return rows.orderBy(F.desc("score"), F.desc("vec_id")).limit(k)


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2_000) -> DataFrame:
    """The `k` vectors nearest to each of `queries` (vec_id, embedding): (query_id, vec_id, score, rank), the greater id first on ties.

    A stated set of queries against all rows: queries go out in blocks of `block`, each task keeps its best `k` per
    query, and only those meet in the shuffle. Null ids, and vectors that are null or of another length
    than the query, are passed over; repeated vectors count once.
    """
    spark = vectors.sparkSession
    asked = cut(queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").dropDuplicates(["vec_id"]), "queries")
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast([(r.vec_id, np.array(r.embedding, dtype=float)) for r in own])

        def nearest(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for size in {len(v) for _, v in sent.value}:
                same = [(i, v) for i, v in sent.value if len(v) == size]
                by_size[size] = np.array([i for i, _ in same]), np.stack([v for _, v in same])
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by size: ids and scores of the k best of each query so far
            for batch in batches:
                sizes = batch["embedding"].map(len)
                for size, (ids, q) in by_size.items():
                    part = batch[sizes == size].drop_duplicates("vec_id")
                    if not len(part) or not size:
                        continue
                    v, vec = np.stack(part["embedding"].to_numpy()).astype(float), part["vec_id"].to_numpy()
                    score = np.round((q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :] + 1e-9), 4)
                    vec = np.broadcast_to(vec, score.shape)
                    if size in best:
                        vec, score = np.hstack([best[size][0], vec]), np.hstack([best[size][1], score])
                    # A vector that an earlier batch had too is there twice, so a few more than k are kept.
                    top = np.lexsort((-vec, -score), axis=1)
                    vec, score = np.take_along_axis(vec, top, 1), np.take_along_axis(score, top, 1)
                    again = np.zeros(score.shape, dtype=bool)
                    again[:, 1:] = vec[:, 1:] == vec[:, :-1]
                    first = np.argsort(again, axis=1, kind="stable")[:, :k]
                    best[size] = np.take_along_axis(vec, first, 1), np.take_along_axis(np.where(again, -2.0, score), first, 1)
            for size, (vec, score) in best.items():
                ids = np.repeat(by_size[size][0], vec.shape[1])
                kept = score.ravel() >= -1.5
                yield pd.DataFrame({"query_id": ids[kept], "vec_id": vec.ravel()[kept], "score": score.ravel()[kept]})

        parts.append(rows.mapInPandas(nearest, "query_id long, vec_id long, score double"))
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").cast("decimal(18,4)").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def table_chunks(tables: DataFrame, columns: DataFrame, relationships: DataFrame) -> DataFrame:
    """(chunk_id, content): one text per table with its columns, the keys out of it and into it, its indexes and checks.

    Lines of columns are in their order, all others in that of their text. What a hub refers to or is referred to by is one
    list in one row, as it is one text.
    """

    def block(lines: Column, title: str) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n\n{title}:\n"), F.array_join(lines, "\n"))).otherwise("")

    def gathered(rows: DataFrame, key: str, line: Column, name: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias(f"_{name}")).agg(F.array_sort(F.collect_list(line)).alias(name))

    flags = F.array_join(F.array_compact(F.array(
        F.when(F.col("is_pk"), "PK"), F.when(~F.col("nullable"), "NOT NULL"), F.concat(F.lit("DEFAULT "), F.nullif("default_expr", F.lit(""))),
        F.when(F.col("is_unique") & ~F.col("is_pk"), "UNIQUE"), F.when(F.col("is_fk"), "FK"),
    )), ", ")
    line = F.concat(
        F.lit("  "), "column_name", F.lit(": "), F.coalesce("data_type", F.lit("UNKNOWN")), F.when(flags == "", "").otherwise(F.concat(F.lit(" ["), flags, F.lit("]"))),
        F.coalesce(F.concat(F.lit(" -- "), "column_comment"), F.lit("")),
    )
    cols = columns.groupBy(F.col("table_name").alias("_cols")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]).alias("cols"))
    listed = lambda c: F.array_join(c, ",")
    tail = F.concat(F.coalesce(F.concat(F.lit(" ON DELETE "), "on_delete"), F.lit("")), F.coalesce(F.concat(F.lit(" ["), "name", F.lit("]")), F.lit("")))
    named = relationships.where("to_table IS NOT NULL")
    out = gathered(named, "from_table", F.concat(F.lit("  "), listed("from_cols"), F.lit(" → "), "to_table", F.lit("("), listed("to_cols"), F.lit(")"), tail), "out")
    into = gathered(named, "to_table", F.concat(F.lit("  "), "from_table", F.lit("."), listed("from_cols"), F.lit(" → "), listed("to_cols")), "into")
    index = F.transform("indexes", lambda i: F.concat(F.lit("  "), i["name"], F.lit(": ("), F.array_join(i["columns"], ", "), F.lit(")"), F.when(i["is_unique"], "  UNIQUE").otherwise(""), F.lit(" [V"), F.coalesce(i["created_in"], F.lit("?")), F.lit("]")))
    check = F.transform(F.filter("constraints", lambda c: c["type"] == "check"), lambda c: F.concat(F.lit("  "), F.coalesce(c["name"], F.lit("unnamed")), F.lit(": CHECK ("), F.coalesce(c["check_expr"], F.lit("")), F.lit(")")))
    rows = tables.join(cols, F.col("full_name") == F.col("_cols"), "left").join(out, F.col("full_name") == F.col("_out"), "left").join(into, F.col("full_name") == F.col("_into"), "left")
    modified = F.when(F.size("modified_in") > 0, F.concat(F.lit(" | Modified: V"), F.array_join("modified_in", ", V"))).otherwise("")
    described = F.coalesce(F.concat(F.lit("\nDescription: "), F.nullif("table_comment", F.lit(""))), F.lit(""))
    head = F.concat(F.lit("TABLE: "), "full_name", described, F.lit("\nSchema: "), F.coalesce("schema_name", F.lit("default")), F.lit(" | Created: V"), F.coalesce("created_in", F.lit("?")), modified, F.lit("\n\nCOLUMNS:\n"))
    content = F.concat(
        head, F.coalesce(F.array_join("cols", "\n"), F.lit("")), block(F.col("out"), "REFERENCES (outgoing FK)"), block(F.col("into"), "REFERENCED BY"),
        block(F.array_sort(index), "INDEXES"), block(F.array_sort(check), "CHECK CONSTRAINTS"),
    )
    return rows.select(F.concat(F.lit("table:"), "full_name").alias("chunk_id"), content.alias("content"))


def map_lines(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """(full_name, content): each table's part of the relationship map, its keys out and in."""
    listed = lambda c: F.array_join(c, ",")
    named = relationships.where("to_table IS NOT NULL")
    rule = F.coalesce(F.concat(F.lit("  [ON DELETE "), "on_delete", F.lit("]")), F.lit(""))
    out = named.select(F.col("from_table").alias("t"), F.lit(0).alias("side"), F.concat(F.lit("  ──FK──▶ "), "to_table", F.lit(" via "), listed("from_cols"), rule).alias("l"))
    into = named.select(F.col("to_table").alias("t"), F.lit(1).alias("side"), F.concat(F.lit("  ◀──FK── "), "from_table", F.lit(" via "), listed("from_cols")).alias("l"))
    by = out.unionByName(into).groupBy("t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "l"))), lambda x: x["l"]), "\n").alias("body"))
    rows = tables.select("full_name").join(by, F.col("full_name") == F.col("t"), "left")
    return rows.select("full_name", F.concat("full_name", F.lit(":\n"), F.coalesce("body", F.lit("  (no FK relationships)"))).alias("content"))


def schema_chunks(tables: DataFrame, columns: DataFrame, relationships: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """(chunk_id, content) of the schema's summary and of its relationship map, each one text of all tables in order of name.

    Lines are put in ranges by their order and each range becomes one piece of text, so that only pieces meet in a text's own
    task. A text is one value of one row, which that task holds a few times over; `map_lines` has the map in rows.
    """
    from terrane.operators.catalog import with_degrees

    kind = F.when((F.col("fk_in") > 0) & (F.col("fk_out") == 0), "root/parent entity").when((F.col("fk_in") > 0) & (F.col("fk_out") > 0), "junction/child entity")
    kind = kind.when(F.col("fk_out") > 0, "leaf/detail entity").otherwise("standalone")
    role = F.concat(F.lit("  "), "full_name", F.lit(": "), kind, F.lit(" (referenced by "), "fk_in", F.lit(", references "), "fk_out", F.lit(")"))
    named = relationships.where("to_table IS NOT NULL")
    edge = F.concat(F.lit("  "), "from_table", F.lit("."), F.array_join("from_cols", ","), F.lit(" → "), "to_table", F.lit("."), F.array_join("to_cols", ","))

    def lines(rows: DataFrame, part: str, line: Column, key: Column | None = None) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), (F.lit("") if key is None else key).alias("k"), line.alias("l")).where("l IS NOT NULL")

    parts = [
        lines(tables, "names", F.col("full_name")), lines(tables.select("schema_name").distinct(), "schemas", F.col("schema_name")), lines(named, "edges", edge),
        lines(with_degrees(tables), "roles", role), lines(map_lines(tables, relationships), "map", F.col("content"), F.col("full_name")),
    ]
    if sequences is not None:
        parts.append(lines(sequences, "seqs", F.col("sequence")))

    def gathered(rows: DataFrame, by: list[str], order: str, n: Column) -> DataFrame:
        """Per group its number of lines and their text `l`, in order."""
        texts = F.transform(F.array_sort("x"), lambda y: y["l"])
        text = F.when(F.col("part").isin("names", "schemas", "seqs"), F.array_join(texts, ", ")).otherwise(F.array_join(texts, "\n"))
        return rows.groupBy(*by).agg(n.alias("n"), F.collect_list(F.struct(order, "l")).alias("x")).select(*by, "n", text.alias("l"))

    ranges = reduce(DataFrame.unionByName, parts).repartitionByRange("part", "k", "l").withColumn("_range", F.spark_partition_id())
    texts = gathered(gathered(ranges, ["part", "_range"], "k", F.count("*")), ["part"], "_range", F.sum("n"))
    summary_id, map_id = F.lit("schema:summary"), F.lit("schema:relationships")
    both = columns.agg(F.count("*").alias("n")).select(F.explode(F.array(summary_id, map_id)).alias("chunk_id"), F.lit("columns").alias("part"), "n", F.lit("").alias("l"))
    rows = texts.withColumn("chunk_id", F.when(F.col("part") == "map", map_id).otherwise(summary_id)).unionByName(both)
    one = rows.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("n", "l")))).alias("m"))
    size = lambda part: F.coalesce(F.col("m")[part]["n"], F.lit(0)).cast("string")
    text = lambda part: F.coalesce(F.col("m")[part]["l"], F.lit(""))
    summary = F.concat_ws(
        "\n", F.lit("SCHEMA SUMMARY"), F.concat(F.lit("DB Schemas: "), text("schemas")), F.concat(F.lit("Tables: "), size("names"), F.lit(" ("), text("names"), F.lit(")")),
        F.concat(F.lit("Sequences: "), size("seqs"), F.lit(" ("), text("seqs"), F.lit(")")), F.concat(F.lit("Total columns: "), size("columns")),
        F.concat(F.lit("FK relationships: "), size("edges")), F.lit("\nRELATIONSHIP MAP:"), F.col("m")["edges"]["l"], F.lit("\nTABLE ROLES:"), text("roles"),
    )
    whole = F.concat(F.lit("RELATIONSHIP GRAPH (adjacency list)\n\n"), text("map"))
    return one.select("chunk_id", F.when(F.col("chunk_id") == summary_id, summary).otherwise(whole).alias("content"))


def prompt(question: str, ranked: DataFrame, chunks: DataFrame) -> str:
    """The prompt of a question with its ranked chunks, best first."""
    rows = ranked.join(chunks.select("chunk_id", "title", "content").dropDuplicates(["chunk_id"]), "chunk_id").orderBy(F.desc("score"), F.desc("chunk_id")).collect()
    parts = [f"[{i}] {r.title}\n{r.content}" for i, r in enumerate(rows, 1)]
    return "Context:\n" + "\n\n".join(parts) + f"\n\nQuestion: {question}\n"


def history(turns: DataFrame, key: str, order: str, max_turns: int) -> DataFrame:
    """The last 2 * max_turns rows of each conversation."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_r", rank).where(F.col("_r") <= 2 * max_turns).drop("_r")


def make_retriever(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, vectors: DataFrame | None = None) -> Callable[[str, int], DataFrame]:
    """A function of question and k to (chunk_id, score): by cosine if there are an `embed` function and `vectors` (vec_id, chunk_id, embedding), else by words.

    `embed` turns texts into vectors; a question's vector is made on the driver, those of chunks by `embed_chunks`.
    """
    if embed is None or vectors is None:
        return lambda question, k=6: bm25(chunks, question, k)

    def search(question: str, k: int = 6) -> DataFrame:
        top = cosine_top(vectors, embed([question])[0], k)
        return top.join(vectors.select("vec_id", "chunk_id"), "vec_id").select("chunk_id", "score")

    return search


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 96) -> DataFrame:
    """(vec_id, chunk_id, embedding) of chunks (chunk_id, content): `embed` is called in the tasks, with at most `batch` texts at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch]
                yield pd.DataFrame({"vec_id": own["vec_id"], "chunk_id": own["chunk_id"], "embedding": [list(map(float, v)) for v in embed(own["content"].fillna("").tolist())]})

    rows = chunks.where("chunk_id IS NOT NULL").select(F.xxhash64("chunk_id").alias("vec_id"), "chunk_id", "content")
    return rows.mapInPandas(run, "vec_id long, chunk_id string, embedding array<double>")
