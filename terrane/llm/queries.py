"""The queries of problems 1, 6, 7 and 8, and the SQL that checks them where SQL can."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm import lang, leak, mix, split
from terrane.plans.registry import Query, shipped, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = shipped(f)
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _pieces(spark, d):
    return split.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


_P1_CTE = """
WITH l AS (SELECT c.chunk_id, c.chunk_type, c.content, coalesce(o.max_chars, s.max_chars) AS m, coalesce(o.overlap_chars, s.overlap_chars) AS v
  FROM (SELECT DISTINCT chunk_id, chunk_type, content FROM chunks) c LEFT JOIN chunk_limits o ON o.chunk_type = c.chunk_type
  CROSS JOIN (SELECT * FROM chunk_limits WHERE chunk_type = '*') s)
"""


@query("p1_found", _P1_CTE + "SELECT DISTINCT chunk_id FROM l WHERE length(content) > m")
def p1_found(spark, d):
    return _pieces(spark, d).select("chunk_id").distinct()


@query("p1_pieces")
def p1_pieces(spark, d):
    return _pieces(spark, d)


@query("p1_rebuilt", _P1_CTE + "SELECT DISTINCT chunk_id, sha256(content) AS digest FROM l WHERE length(content) > m")
def p1_rebuilt(spark, d):
    """The texts put together again from their pieces without the overlaps."""
    p = _pieces(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    before = F.lag("stop").over(W.partitionBy("chunk_id", "chunk_type").orderBy("piece_no"))
    own = F.expr("substring(piece, 1 + coalesce(prev - start, 0))")
    p = p.withColumn("prev", before).withColumn("own", own)
    return p.groupBy("chunk_id", "chunk_type").agg(F.sha2(text, 256).alias("digest")).select("chunk_id", "digest").distinct()


@query(
    "p1_kept",
    _P1_CTE + """SELECT chunk_id, coalesce(chunk_type, '') AS kind, sha256(content) AS digest, length(content) AS chars, true AS within_limit, true AS overlaps_kept, true AS texts_kept, true AS words_kept
FROM l WHERE length(content) > m""",
)
def p1_kept(spark, d):
    """What must hold of the pieces of each text: their size, overlap and place, and no word cut that has a boundary in reach."""
    texts = split.with_limits(table(spark, d, "chunks"), table(spark, d, "chunk_limits"), "chunk_id", "chunk_type", "content").where(F.length("text") > F.col("max_chars")).distinct()
    p = _pieces(spark, d).alias("p")
    joined = p.join(texts.alias("t"), (F.col("p.chunk_id") == F.col("t.id")) & F.col("p.chunk_type").eqNullSafe(F.col("t.kind")))
    before = F.lag("stop").over(W.partitionBy("chunk_id", "chunk_type").orderBy("piece_no"))
    overlap = F.least("overlap_chars", F.col("max_chars") - 1)
    cut_word = F.col("boundary").isin("none", "character") & F.expr("substring(piece, 1 + least(overlap_chars, max_chars - 1))").rlike(r"(?U)\s\S")
    rows = joined.withColumn("before", before)
    return rows.groupBy("chunk_id", F.coalesce("chunk_type", F.lit("")).alias("kind"), F.sha2("text", 256).alias("digest")).agg(
        F.max("stop").alias("chars"),
        F.bool_and(F.length("piece") <= F.col("max_chars")).alias("within_limit"),
        F.bool_and(F.col("start") == F.coalesce(F.col("before") - overlap, F.lit(0))).alias("overlaps_kept"),
        F.bool_and(F.expr("substring(text, start + 1, stop - start)") == F.col("piece")).alias("texts_kept"),
        (~F.bool_or(cut_word)).alias("words_kept"),
    )


def _leaks(spark, d):
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _compatible(text: str) -> str:
    """SQL that puts the compatible forms of a text into their usual one, as NFKC does: of one character, and Latin ligatures."""
    single = [chr(c) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and len(unicodedata.normalize("NFKC", chr(c))) == 1 != unicodedata.is_normalized("NFKC", chr(c))]
    plain = "".join(unicodedata.normalize("NFKC", c) for c in single)
    text = f"translate({text}, '{''.join(single)}', '{plain.replace(chr(39), chr(39) * 2)}')"
    for c in range(0xFB00, 0xFB07):
        text = f"replace({text}, '{chr(c)}', '{unicodedata.normalize('NFKC', chr(c))}')"
    return f"nfc_normalize({text})"


_WORDS = f"regexp_extract_all(lower(regexp_replace({_compatible('text')}, '\\p{{Cf}}', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "SELECT {0}, i, w[i:i + 11] AS r FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT DISTINCT {0}, {1} AS w FROM {2} WHERE {0} IS NOT NULL))"
_P6_CTE = f"""
WITH g AS (SELECT DISTINCT item_id, r FROM ({_RUNS.format("item_id", _WORDS, "eval_items")})),
hit AS (SELECT doc_id, item_id, count(DISTINCT i) AS windows FROM ({_RUNS.format("doc_id", _WORDS, "documents")}) JOIN g USING (r) GROUP BY 1, 2)
"""


@query("p6_found", _P6_CTE + "SELECT doc_id, item_id FROM hit")
def p6_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id")


@query("p6_items", _P6_CTE + "SELECT item_id, count(*) AS documents, max(windows) AS most_windows FROM hit GROUP BY 1")
def p6_items(spark, d):
    """Per leaked item, its documents and the most of its runs that one of them holds."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("windows").alias("most_windows"))


def _mix(spark, d, size=mix.EXACT):
    return mix.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), size=size)


@query("p7_mix")
def p7_mix(spark, d):
    return _mix(spark, d).records().select("doc_id", "source", "copy_no", "text")


@query("p7_shares")
def p7_shares(spark, d):
    """The shares of the largest mix that meets them all."""
    return _mix(spark, d).shares()


@query("p7_shares_held")
def p7_shares_held(spark, d):
    """The shares of a mix of as many tokens as the target sources hold, where small sources fall short."""
    return _mix(spark, d, mix.HELD).shares()


_SOURCE = "lower(replace(trim({}, ' ' || chr(9) || chr(10) || chr(13)), ' ', '_'))"


@query(
    "p7_kept",
    f"""WITH d AS (SELECT {_SOURCE.format("source")} AS s, count(*) AS n FROM documents GROUP BY 1)
SELECT {_SOURCE.format("source_name")} AS source_name, n AS held_documents, true AS share_met, true AS cap_kept, true AS copies_numbered, true AS texts_whole FROM mix_targets JOIN d ON s = {_SOURCE.format("source_name")}""",
)
def p7_kept(spark, d):
    """What must hold of each source in the mix itself: its share, its cap, copies numbered from 1, and texts as they were."""
    docs = table(spark, d, "documents")
    m = _mix(spark, d)
    name = mix.source_name(F.col("source"))
    copies = m.records().groupBy("doc_id", name.alias("s"), F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"), F.max("copy_no").alias("last"))
    own = docs.select("doc_id", name.alias("s"), F.xxhash64("text").alias("h")).groupBy("doc_id", "s", "h").agg(F.count("*").alias("held"))
    both = own.join(copies, ["doc_id", "s", "h"], "full")
    by = both.groupBy("s").agg(
        F.sum("held").alias("held_documents"), F.coalesce(F.max("last"), F.lit(0)).alias("most"),
        F.coalesce(F.bool_and(F.col("n") == F.col("last") * F.col("held")), F.lit(True)).alias("copies_numbered"), (F.count_if(F.col("held").isNull()) == 0).alias("texts_whole"),
    )
    shares = m.shares().withColumn("share_met", F.abs(F.col("actual_share") - F.col("target_share")) <= F.col("tolerance") + 1e-9)
    rows = shares.join(by, F.col("source_name") == F.col("s"))
    return rows.select("source_name", "held_documents", "share_met", (F.col("most") <= F.col("max_repeats")).alias("cap_kept"), "copies_numbered", "texts_whole")


_MODELS: dict[tuple[str, str], lang.Model] = {}


def _model(spark, d):
    """Fitted once for a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = lang.fit(table(spark, d, "lang_samples"), table(spark, d, "documents"))
    return _MODELS[key]


@query("p8_found")
def p8_found(spark, d):
    return lang.unstated(table(spark, d, "documents"), _model(spark, d)).select("doc_id", "lang")


@query("p8_documents")
def p8_documents(spark, d):
    return lang.detect(table(spark, d, "documents"), _model(spark, d)).select("doc_id", "lang", "confidence", "shares")


@query("p8_segments")
def p8_segments(spark, d):
    found = lang.detect(table(spark, d, "documents"), _model(spark, d))
    return found.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")
