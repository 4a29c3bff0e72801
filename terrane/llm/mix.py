"""Mixing sources to target shares of tokens by Poisson replication (problem 7)."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 32_000_000
MAX_TARGETS = 1_000  # rows of the target table; it is a setting and is read by the driver
MAX_REPEATS = 10_000  # the greatest `max_repeats`
DRAW_BINS = 2_048  # parts of the draw's range whose tokens are counted for each source
HELD, EXACT = "held", "exact"  # sizes of a mix, see replication_rates
LONG = 1_000_000  # characters; longer texts are counted in pieces cut at line ends or blanks

_encoders: dict[str, object] = {}


def source_name(source: Column) -> Column:
    """Trimmed, lower-cased, blanks as underscores; null stays null."""
    return F.replace(F.lower(F.btrim(source, F.lit(" \t\r\n"))), F.lit(" "), F.lit("_"))


def _encoder(vocabulary: bytes):
    """The worker's encoder, made once."""
    import tiktoken

    if "own" not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders["own"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders["own"]


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > LONG:
        stop = max(text.rfind("\n", start + LONG // 2, start + LONG), text.rfind(" ", start + LONG // 2, start + LONG))
        stop = stop if stop > start else start + LONG
        yield text[start:stop]
        start = stop
    yield text[start:]


def token_counts(docs: DataFrame, vocabulary_path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, draw) of each document; `draw` is a number in [0, 1) from a hash of the row.

    Null texts have no tokens.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_path} is too large to be sent to the executors")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(sent.value).encode_ordinary
        for part in texts:
            yield pd.Series([sum(len(encode(p)) for p in _pieces(t)) if t else 0 for t in part], dtype="int64")

    return docs.select("doc_id", source_name(F.col("source")).alias("source"), count("text").alias("n_tokens"), "_draw")


def draw(seed: int) -> Column:
    """A uniform number of a document, the same wherever and however often it is computed."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(2**53))


@dataclass
class Rate:
    """How a source is replicated: the mean copies of a token that are asked for, and the bounds of the draw for 1, 2, ... copies.

    `slack` is how many tokens the mix may have more or less of it than asked for.
    """

    source: str
    share: float
    max_repeats: int
    tokens: int
    mean: float
    bounds: list[float]
    slack: float = 0.0


def capped_mean(rate: float, most: int) -> float:
    """The mean of the lesser of `most` and a Poisson variable of mean `rate`."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(most):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + most * max(0.0, 1 - below)


def rate_bounds(rate: float, most: int) -> list[float]:
    """Bounds b1 <= ... <= b_most: a draw of b_k or more makes at least k copies, Poisson with mean `rate` but for more than `most`.

    Logarithms keep the first terms of a high rate; an infinite rate makes `most` copies of everything.
    """
    if math.isinf(rate):
        return [0.0] * most
    k = np.arange(most)
    steps = np.log(np.maximum(k, 1))
    log_p = -rate + k * (math.log(rate) if rate > 0 else -math.inf) - np.cumsum(steps) if rate > 0 else np.where(k == 0, 0.0, -math.inf)
    return np.minimum(1.0, np.cumsum(np.exp(log_p))).tolist()


def poisson_bounds(mean: float, most: int) -> list[float]:
    """The bounds of the rate whose mean, after the cut at `most` copies, is `mean`; a mean of `most` makes that many of everything."""
    if mean >= most * (1 - 1e-12):
        return rate_bounds(math.inf, most)
    lo, hi = 0.0, 1.0
    while capped_mean(hi, most) < mean:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, most) < mean else (lo, mid)
    return rate_bounds(hi, most)


def _taken(by_bin: np.ndarray, bounds: list[float]) -> float:
    """The tokens of the copies that bounds make of a source whose tokens are counted by bins of the draw."""
    low = np.arange(DRAW_BINS) / DRAW_BINS
    copies = np.zeros(DRAW_BINS)
    for b in bounds:
        if b >= 1:
            break
        copies += np.clip((low + 1 / DRAW_BINS - b) * DRAW_BINS, 0, 1)
    return float(by_bin @ copies)


def solve(by_bin: np.ndarray, goal: float, most: int) -> tuple[float, list[float]]:
    """The Poisson rate and its bounds whose copies have `goal` tokens: rates make more copies the higher they are, so it is halved for.

    As draws are fixed by their hashes, these are the tokens that the mix gets, up to those of the bins that the bounds fall in.
    """
    if goal >= by_bin.sum() * most * (1 - 1e-12):
        return math.inf, rate_bounds(math.inf, most)
    lo, hi = 0.0, 1.0
    while hi < 1e6 and _taken(by_bin, rate_bounds(hi, most)) < goal:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _taken(by_bin, rate_bounds(mid, most)) < goal else (lo, mid)
    return hi, rate_bounds(hi, most)


def replication_rates(counts: DataFrame, targets: DataFrame, size: int | str = EXACT) -> list[Rate]:
    """The rate of each target source for a mix of `size` tokens.

    EXACT asks for the largest mix in which every share is met: the source that runs out first sets its size. HELD
    asks for as many tokens as the target sources hold. A source whose share of that is more than it has,
    `max_repeats` times, gives what it may, and the reached shares show it. Sources without tokens cannot
    contribute; the others keep their proportions. Rows of the targets with a null name, or a share or repeats
    that are null or not above 0, are passed over; of several rows of one source the one with the greatest
    share holds.
    """
    named = targets.select(source_name(F.col("source_name")).alias("source"), "target_share", "max_repeats")
    named = named.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    rows = named.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    if any(r.t.max_repeats > MAX_REPEATS for r in rows):
        raise ValueError(f"a source is repeated at most {MAX_REPEATS} times")
    wanted = named.select(F.col("source").alias("_source")).distinct()
    at = F.floor(F.col("_draw") * DRAW_BINS).cast("int").alias("bin")
    sizes = counts.join(wanted, F.col("source") == F.col("_source"), "left_semi").groupBy("source", at).agg(F.sum("n_tokens").alias("n"))
    bins = {r.source: np.zeros(DRAW_BINS) for r in rows}
    for r in sizes.toPandas().itertuples(index=False):  # at most MAX_TARGETS x DRAW_BINS rows
        bins[r.source][r.bin] = r.n or 0
    live = [r for r in rows if bins[r.source].sum() > 0]
    whole = sum(r.t.target_share for r in live)
    if size == HELD:
        total = float(sum(b.sum() for b in bins.values()))
    elif size == EXACT:
        total = min((float(bins[r.source].sum()) * r.t.max_repeats / (r.t.target_share / whole) for r in live), default=0.0)
    else:
        total = float(size)
    out = []
    for r in sorted(rows, key=lambda r: r.source):
        own, most = bins[r.source], r.t.max_repeats
        n = int(own.sum())
        if not n:
            out.append(Rate(r.source, r.t.target_share, most, 0, 0.0, []))
            continue
        goal = r.t.target_share / whole * total
        _, bounds = solve(own, goal, most)
        mean = min(float(most), float(goal) / n)
        split = [own[min(int(b * DRAW_BINS), DRAW_BINS - 1)] for b in bounds if 0 < b < 1]
        out.append(Rate(r.source, r.t.target_share, most, n, mean, bounds, float(sum(split))))
    return out


def _copies(source: Column, rates: list[Rate]) -> Column:
    """The number of copies of a document of `source` with `_draw`; 0 for sources without a target."""
    live = [r for r in rates if r.bounds]
    if not live:
        return F.lit(0)
    # Bounds of 1 are above every draw.
    bounds = F.create_map(*(x for r in live for x in (F.lit(r.source), F.array(*(F.lit(b) for b in r.bounds if b < 1)).cast("array<double>"))))
    own = F.coalesce(F.try_element_at(bounds, source), F.array().cast("array<double>"))
    # The bounds ascend, so the first one above the draw tells the copies.
    return F.size(F.filter(own, lambda b: F.col("_draw") >= b))


class Mix:
    """A mix of documents. Counting tokens is one pass over the texts; `records` is another, with no Python.

    Documents with a null source or one without a target are in no mix. A null doc_id is an id like any
    other; exact repeats of a row are replicated alike. Empty tables give an empty mix.
    """

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        seed: int = 0,
        size: int | str = EXACT,
        vocabulary_path: str = TOKENIZER,
    ):
        self.seed = seed
        self.docs = docs.withColumn("_draw", draw(seed))
        self.counts = cut(token_counts(self.docs, vocabulary_path), "tokens")
        self.rates = replication_rates(self.counts, targets, size)

    def records(self) -> DataFrame:
        """The documents' own columns, with `copy_no` from 1 to a document's copies, in an order shuffled over everything."""
        source = source_name(F.col("source"))
        copies = self.docs.withColumn("_n", _copies(source, self.rates)).where("_n > 0")
        copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        place = F.xxhash64("doc_id", "text", "_copy", F.lit(self.seed + 1))
        mixed = copies.withColumn("_place", place).orderBy("_place", "doc_id", "_copy")
        return mixed.select(*(F.col(c) for c in self.docs.columns if c not in ("_draw", "copy_no")), F.col("_copy").alias("copy_no"))

    def shares(self) -> DataFrame:
        """One row per target source: its target and reached share of tokens, and what the mix takes of it.

        `tolerance` is how far the reached share can be from the one asked for, as documents are not cut: the tokens
        that share a bin of the draw with a bound, of this source and in its part of all others. Where a source has
        too few tokens for its share it does not hold.
        """
        spark = self.docs.sparkSession
        counts = self.counts.withColumn("_n", _copies(F.col("source"), self.rates)).where("_n > 0")
        taken = counts.groupBy("source").agg(
            F.sum(F.col("_n") * F.col("n_tokens")).alias("tokens"),
            F.count("*").alias("documents"),
            F.sum("_n").cast("bigint").alias("copies"),
            F.max("_n").alias("most_repeats"),
        )
        goals = spark.createDataFrame(
            [(r.source, r.share, r.max_repeats, r.tokens, r.mean, r.slack, sum(x.slack for x in self.rates)) for r in self.rates],
            "source_name string, target_share double, max_repeats int, held_tokens long, mean_repeats double, slack double, slacks double",
        )
        total = taken.select(F.sum("tokens")).scalar()
        rows = goals.join(taken, F.col("source_name") == F.col("source"), "left").withColumn("_total", total)
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies", "most_repeats")]
        share = F.coalesce(F.try_divide("tokens", "_total"), F.lit(0.0)).alias("actual_share")
        tolerance = F.coalesce(F.try_divide(F.col("slack") + F.col("target_share") * F.col("slacks"), "_total"), F.lit(0.0)).alias("tolerance")
        return rows.select("source_name", "target_share", share, tolerance, "max_repeats", "mean_repeats", "held_tokens", *zero)
