"""Cutting oversized texts at natural boundaries with overlap (problem 1)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TYPE = "*"

# Strengths of a cut, weakest first.
INSIDE_CHARACTER, INSIDE_WORD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
STRENGTH_NAMES = ("character", "none", "word", "clause", "sentence", "line", "paragraph")
_SENTENCE_ENDS = ".!?…。！？؟।"
_CLAUSE_ENDS = ",;:、，；："
_CLOSERS = "\"'”’»)]}›」』"
_WIDE_ENDS = "。！？、，；："  # written without a space behind them
_LINE_ENDS = "\n\r\u0085\u2028\u2029"
_JOINERS = "\u200d\ufe0e\ufe0f"

PIECES = 5_000  # rows that a task gives back at a time

_PIECES = "row struct<id:string,kind:string>, piece_no int, n_pieces int, start int, stop int, boundary string, piece string"


@lru_cache(maxsize=200_000)
def _traits(code: int) -> int:
    """What a character is, as bits: white space, line end, closing mark, end of a sentence or clause, one written without a space, part of the one before."""
    c = chr(code)
    mark = not 0xD800 <= code < 0xE000 and unicodedata.category(c) in ("Mn", "Me", "Mc")
    tests = (
        c.isspace(), c in _LINE_ENDS, c in _CLOSERS, c in _SENTENCE_ENDS, c in _CLAUSE_ENDS, c in _WIDE_ENDS, mark or c in _JOINERS or 0x1F3FB <= code < 0x1F400,
    )
    return sum(1 << i for i, t in enumerate(tests) if t)


_SPACE, _LINE, _CLOSER, _ENDS_SENTENCE, _ENDS_CLAUSE, _WIDE, _JOINED = (1 << i for i in range(7))


def cut_strengths(codes: np.ndarray) -> np.ndarray:
    """The strength of a cut before each place 0..n of a text given as code points.

    White space stays with what is before it: only the place behind a run of it is a boundary, as strong as
    the strongest of a blank line, a line end and the punctuation before the run.
    """
    n = len(codes)
    out = np.full(n + 1, INSIDE_WORD, dtype=np.int64)
    if n < 2:
        return out
    kinds, which = np.unique(codes, return_inverse=True)
    bits = np.array([_traits(c) for c in kinds.tolist()])[which]
    space, newline = (bits & _SPACE) > 0, (bits & _LINE) > 0
    crlf = np.zeros(n, dtype=bool)
    crlf[1:] = (codes[1:] == 10) & (codes[:-1] == 13)
    lines_before = np.concatenate([[0], np.cumsum(newline & ~crlf)])  # CR LF is one line end
    at = np.arange(n)
    # For each place, the last character that is no white space, and the last that is no closing mark either.
    word_end = np.maximum.accumulate(np.where(space, -1, at))
    point = np.maximum.accumulate(np.where((bits & (_SPACE | _CLOSER)) > 0, -1, at))

    before, here = bits[:-1], bits[1:]  # a cut between these characters
    solid = (here & _SPACE) == 0
    after_space = ((before & _SPACE) > 0) & solid
    breaks = lines_before[1:n] - lines_before[word_end[:-1] + 1]
    last = np.where(point[:-1] >= 0, bits[point[:-1]], 0)
    strength = np.full(n - 1, INSIDE_WORD, dtype=np.int64)
    wide = ((before & _WIDE) > 0) & solid
    strength[wide] = CLAUSE
    strength[wide & ((before & _ENDS_SENTENCE) > 0)] = SENTENCE
    strength[after_space] = WORD
    strength[after_space & ((last & _ENDS_CLAUSE) > 0)] = CLAUSE
    strength[after_space & ((last & _ENDS_SENTENCE) > 0)] = SENTENCE
    strength[after_space & (breaks == 1)] = LINE
    strength[after_space & (breaks > 1)] = PARAGRAPH
    strength[((here & _JOINED) > 0) | crlf[1:] | (codes[:-1] == 0x200D)] = INSIDE_CHARACTER
    out[1:n] = strength
    return out


def cut_places(codes: np.ndarray, max_chars: int, overlap: int, early: bool = False) -> list[tuple[int, int, int]]:
    """(start, stop, strength of the cut at stop) of the pieces of a text longer than `max_chars`.

    The strongest cut of a window is the range maximum of strengths with the place as the lesser part of
    the key, so ties go to the right. The sparse table has the maxima of blocks of 1, 2, 4, ... places up to
    the widest window, and a query is the greater of two blocks. With `early`, where no window place is a
    boundary, the places before the window are asked in the same way, as long as the piece gets longer than its overlap.
    """
    n = len(codes)
    overlap = min(max(overlap, 0), max_chars - 1)
    shortest = min(max_chars, max(overlap + 1, -(-max_chars // 2)))
    width = max(max_chars - shortest + 1, shortest - overlap - 1 if early else 0)
    table = [(cut_strengths(codes) << 40) + np.arange(n + 1)]
    while 2 << (len(table) - 1) <= min(width, n + 1):
        block = 1 << (len(table) - 1)
        table.append(np.maximum(table[-1][:-block], table[-1][block:]))

    def strongest(lo: int, hi: int) -> int:
        row = (hi - lo + 1).bit_length() - 1
        return int(max(table[row][lo], table[row][hi - (1 << row) + 1]))

    out, start = [], 0
    while n - start > max_chars:
        lo, hi = start + shortest, start + max_chars
        key = strongest(lo, hi)
        if early and key >> 40 < WORD and lo > start + overlap + 1:
            before = strongest(start + overlap + 1, lo - 1)
            key = before if before >> 40 >= WORD else key
        stop = key & ((1 << 40) - 1)
        out.append((start, stop, key >> 40))
        start = stop - overlap
    out.append((start, n, PARAGRAPH))
    return out


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("row", "piece_no", "n_pieces", "start", "stop", "boundary", "piece")
    out: list[tuple] = []
    for part in parts:
        for row in part.itertuples(index=False):
            text, own = row.text, {"id": row.id, "kind": row.kind}
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            places = cut_places(codes, int(row.max_chars), int(row.overlap_chars), early=True)
            n = len(places)
            for i, (a, b, strength) in enumerate(places):
                out.append((own, i, n, a, b, "end" if i == n - 1 else STRENGTH_NAMES[strength], text[a:b]))
                if len(out) >= PIECES:
                    yield pd.DataFrame(out, columns=names)
                    out = []
    if out:
        yield pd.DataFrame(out, columns=names)


def with_limits(texts: DataFrame, limits: DataFrame, id_col: str, kind_col: str, text_col: str) -> DataFrame:
    """(id, kind, text, max_chars, overlap_chars); the row '*' of the limits holds for all other kinds and null.

    A limit that is null or below 1 is none; of several for one kind the smallest holds (then the smallest
    overlap; a null overlap is 0). A kind without a limit keeps its texts whole.
    """
    sizes = limits.where("max_chars >= 1").groupBy(F.col("chunk_type").alias("_kind")).agg(
        F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("_limit")
    )
    rest = sizes.where(F.col("_kind") == DEFAULT_TYPE).select(F.max("_limit")).scalar()
    own = texts.select(texts[id_col].cast("string").alias("id"), texts[kind_col].alias("kind"), texts[text_col].alias("text"))
    held = own.join(sizes, F.col("kind") == F.col("_kind"), "left").withColumn("_l", F.coalesce("_limit", rest))
    return held.select("id", "kind", "text", F.col("_l.max_chars").alias("max_chars"), F.col("_l.overlap_chars").alias("overlap_chars"))


def split_oversized(
    texts: DataFrame,
    limits: DataFrame,
    id_col: str = "chunk_id",
    kind_col: str = "chunk_type",
    text_col: str = "content",
) -> DataFrame:
    """The pieces of every text longer, in code points, than its kind's limit.

    Columns: the id and kind columns, `piece_no` from 0, `n_pieces`, `start` and `stop` (code points),
    `boundary` (what the cut at `stop` is: paragraph, line, sentence, clause, word, none, character; `end`
    for the last piece) and `piece`. Every piece but the last is between half the limit and the limit long,
    and its next starts `overlap_chars` before its end, so pieces without their overlaps are the text. An
    overlap of the limit or more is cut to one less than the limit. Where a window has no boundary the cut is
    its rightmost place that splits no character.

    Null and short texts give no rows. Exact repeats of (id, kind, text) give one set of pieces; different
    texts under one id give one set each. An empty table gives none. Other columns are ignored.
    """
    held = with_limits(texts, limits, id_col, kind_col, text_col).where(F.length("text") > F.col("max_chars"))
    long = held.dropDuplicates(["id", "kind", "text"])
    pieces = long.mapInPandas(_cut, _PIECES)
    names: list[Column] = [F.col("row.id").alias(id_col), F.col("row.kind").alias(kind_col)]
    return pieces.select(*names, "piece_no", "n_pieces", "start", "stop", "boundary", "piece")
