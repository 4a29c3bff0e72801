"""Evaluation passages in a corpus, by a prefix-filtered set join (problem 6).

A document leaks an item if it holds `run` consecutive words of it. Each window of `run` words of an item
is a set of shingles, all of which a leaking document has, so one shingle per window, its rarest in the
corpus, is a sufficient prefix. Documents are joined with these alone; where a shingle may stand in its
window bounds where the window stands in the document, and the words there are compared. How rare a shingle
is takes one pass over the corpus, in which a filter of all item shingles leaves out the others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import cut

RUN = 12  # words
SHINGLE = 5  # words
BLOCK = 4_000_000  # item shingles (8 bytes each) that the driver reads at a time
FILTER_BITS = (20, 30)  # least and greatest size of the filter sent to every executor, as powers of two: 128 KB to 128 MB
MAX_HOT = 10_000  # shingles that are spread
HOT_DOCS = 200_000  # documents with one shingle that a task compares; more are spread

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the text after NFKC, without format characters, in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = text.translate({ord(c): None for c in set(text) if unicodedata.category(c) == "Cf"})
    return _WORD.findall(text.lower())


def _word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of words that are the same in every process."""
    codes, unique = pd.factorize(np.array(tokens, dtype=object))
    return pd.util.hash_array(np.array(unique, dtype=object), categorize=False)[codes]


def shingle_hashes(tokens: list[str], size: int = SHINGLE) -> np.ndarray:
    """The hash of each run of `size` words, in order."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = _word_hashes(tokens)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out * _MIX) ^ (h[i : i + n] + _MIX)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def item_windows(items: DataFrame, run: int, size: int) -> DataFrame:
    """(item_id, words, shingles) of each window of `run` words of the items; the words as one text."""

    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for item_id, text in zip(part["item_id"], part["text"], strict=True):
                tokens = words(text)
                n = len(tokens) - run + 1
                if n > 0:
                    h = shingle_hashes(tokens, size)
                    yield pd.DataFrame({
                        "item_id": [item_id] * n,
                        "words": [" ".join(tokens[i : i + run]) for i in range(n)],
                        "shingles": [h[i : i + run - size + 1] for i in range(n)],
                    })

    known = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    return known.mapInPandas(windows, "item_id long, words string, shingles array<long>")


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of `size` bits, a power of two."""
    u = h.view(np.uint64)
    return (u & np.uint64(size - 1)).astype(np.int64), (u >> np.uint64(33)).astype(np.int64) & (size - 1)


def shingle_filter(shingles: DataFrame, n: int, block: int = BLOCK) -> np.ndarray:
    """A Bloom filter of the `n` values of `shingle`, filled from blocks that the driver reads one after another.

    It has 16 bits a value, up to its greatest size. Beyond that it lets more pass that is not wanted, which the join then finds.
    """
    bits = 1 << min(max((16 * max(n, 1)).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    out = np.zeros(bits // 8, dtype=np.uint8)
    blocks = max(1, -(-n // block))
    for k in range(blocks):
        own = shingles.where(F.pmod("shingle", F.lit(blocks)) == k) if blocks > 1 else shingles
        for at in _bits(own.toPandas()["shingle"].to_numpy(dtype=np.int64), bits):
            np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out


def _may_have(wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter has."""
    first, second = _bits(h, len(wanted) * 8)
    hit = np.flatnonzero(wanted[first >> 3] >> (first & 7) & 1)
    second = second[hit]
    return hit[(wanted[second >> 3] >> (second & 7) & 1) > 0]


def _scan(docs: DataFrame, run: int, size: int, wanted) -> DataFrame:
    """The documents' shingles that the broadcast filter `wanted` has, each with the words around it.

    `at` is a shingle's place in its document and `around` the words from `start` on, as one text: all that a
    window of `run` words with this shingle can hold. There is no window where fewer shingles than it has follow
    one another, and they are left out.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            tokens: list[str] = []
            ends = [0]
            for text in part["text"]:
                tokens += words(text)
                ends.append(len(tokens))
            h = shingle_hashes(tokens, size)
            if not len(h):
                continue
            hit = _may_have(wanted.value, h)
            bounds = np.array(ends)
            doc = np.searchsorted(bounds, hit, side="right") - 1
            # Only shingles inside one document, and documents long enough for a window.
            fits = (hit + size <= bounds[doc + 1]) & (bounds[doc + 1] - bounds[doc] >= run)
            hit, doc = hit[fits], doc[fits]
            lengths = np.diff(np.flatnonzero(np.diff(hit, prepend=-2) != 1), append=len(hit))
            whole = np.repeat(lengths >= run - size + 1, lengths)
            hit, doc = hit[whole], doc[whole]
            if not len(hit):
                continue
            lo = np.maximum(bounds[doc], hit - run + size)
            hi = np.minimum(bounds[doc + 1], hit + run)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy()[doc],
                "n_words": bounds[doc + 1] - bounds[doc],
                "at": hit - bounds[doc],
                "shingle": h[hit],
                "start": lo - bounds[doc],
                "around": [" ".join(tokens[a:b]) for a, b in zip(lo, hi, strict=True)],
            })

    return docs.mapInPandas(scan, "doc_id long, n_words int, at int, shingle long, start int, around string")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    run: int = RUN,
    size: int = SHINGLE,
    block: int = BLOCK,
    hot_docs: int = HOT_DOCS,
) -> DataFrame:
    """(doc_id, item_id, windows): documents with at least `run` consecutive words of an item, and how many such runs.

    Exact: the shingles' hashes only nominate, words decide. Null ids and texts, and items of fewer words,
    match nothing; repeated rows count once. A filter of the items' shingles, of bounded size, is sent to the
    documents, which are read and cut into words once, and only what passes it is shuffled. A shingle that very
    many documents have is spread over tasks by document.
    """
    spark = docs.sparkSession
    windows = cut(item_windows(items, run, size).distinct(), "windows")
    wanted = windows.select(F.explode("shingles").alias("shingle")).distinct()
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = cut(wanted, "wanted")
    sent = spark.sparkContext.broadcast(shingle_filter(wanted, wanted.count(), block))
    hits = cut(_scan(texts, run, size, sent), "hits")
    sent.unpersist()

    rarity = hits.select("doc_id", "shingle").distinct().groupBy(F.col("shingle").alias("_s")).agg(F.count("*").alias("docs"))
    # The rarest shingle of each window; a window with a shingle that no document has cannot occur.
    placed = windows.select("item_id", F.col("words").alias("window"), F.posexplode("shingles").alias("place", "shingle"))
    ranked = placed.join(rarity, F.col("shingle") == F.col("_s"))
    prefix = ranked.groupBy("item_id", "window").agg(F.min(F.struct("docs", "shingle", "place")).alias("rarest"), F.count("*").alias("have"))
    prefix = prefix.where(F.col("have") == run - size + 1)
    prefix = cut(prefix.select("item_id", "window", F.col("rarest.shingle").alias("_p"), F.col("rarest.place").alias("place"), F.col("rarest.docs").alias("docs")), "prefix")
    # Hot shingles, the most frequent first: each of those not among the listed ones has less than 1 / MAX_HOT of all hits.
    hot = prefix.where(F.col("docs") > hot_docs).groupBy("_p").agg(F.max("docs").alias("docs")).orderBy(F.desc("docs")).limit(MAX_HOT)
    hot = F.broadcast(hot.select(F.col("_p").alias("_h"), F.ceil(F.col("docs") / hot_docs).cast("int").alias("ways")))
    prefix = prefix.join(hot, F.col("_p") == F.col("_h"), "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)))
    spread = hits.join(hot, F.col("shingle") == F.col("_h"), "left").withColumn("_way", F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int")))
    pairs = spread.drop("_h", "ways").join(prefix.drop("_h", "ways", "docs"), (F.col("shingle") == F.col("_p")) & (F.col("_way") == F.col("way")))
    begin = F.col("at") - F.col("place")
    pairs = pairs.where((begin >= F.col("start")) & (begin + run <= F.col("n_words")))
    own = F.slice(F.split("around", " "), begin - F.col("start") + 1, F.lit(run))
    same = F.array_join(own, " ") == F.col("window")
    runs = pairs.where(same).select("doc_id", "item_id", begin.alias("at")).distinct()
    return runs.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"))
