from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import split

LIMITS = [("note", 20, 5), ("*", 30, 6), ("none", None, 3), ("zero", 0, 3), ("wide", 10, 50)]

def codes(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

def brute(text, most, overlap):
    s = split.cut_strengths(codes(text))
    overlap = min(max(overlap, 0), most - 1)
    shortest = min(most, max(overlap + 1, -(-most // 2)))
    out, start = [], 0
    while len(text) - start > most:
        stop = max(range(start + shortest, start + most + 1), key=lambda c: (s[c], c))
        out.append((start, stop))
        start = stop - overlap
    return [*out, (start, len(text))]

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n\r!é́漢。", min_size=1, max_size=300), st.integers(1, 60), st.integers(0, 70))
def test_places_against_brute_force(text, most, overlap):
    if len(text) <= most:
        return
    got = [(a, b) for a, b, _ in split.cut_places(codes(text), most, overlap)]
    assert got == brute(text, most, overlap)
    assert all(b - a <= most for a, b in got)
    assert all(got[i + 1][0] == got[i][1] - min(overlap, most - 1) for i in range(len(got) - 1))

@pytest.mark.parametrize(
    ("text", "place", "kind"),
    [
        ("ab cd", 3, "word"), ("ab, cd", 4, "clause"), ("ab. cd", 4, "sentence"), ('ab." cd', 5, "sentence"), ("ab\ncd", 3, "line"),
        ("ab\r\ncd", 4, "line"), ("ab\r\n\r\ncd", 6, "paragraph"), ("ab\n \ncd", 5, "paragraph"), ("ab\r\ncd", 3, "character"),
        ("e\u0301ab", 1, "character"), ("abcd", 2, "none"), ("漢字。漢字", 3, "sentence"), ("ab. \n cd", 6, "line"), ("ab  cd", 3, "none"),
    ],
)
def test_strengths(text, place, kind):
    assert split.STRENGTH_NAMES[split.cut_strengths(codes(text))[place]] == kind

def run(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, chunk_type string, content string, piece string, max_chars int")
    limits = spark.createDataFrame(LIMITS, "chunk_type string, max_chars int, overlap_chars int")
    return split.split_oversized(df, limits)

def test_kinds_and_edge_rows(spark):
    text = "one two. three four five, six seven eight nine ten"
    rows = [
        ("a", "note", text, "x", 1), ("a", "note", text, "x", 1), ("b", None, text, "x", 1), ("c", "none", text, "x", 1), ("d", "wide", text, "x", 1),
        ("e", "note", None, "x", 1), ("f", "note", "", "x", 1), ("g", "note", "x" * 20, "x", 1), (None, "zero", text, "x", 1), ("a", "note", text + "!", "x", 1),
    ]
    got = {}
    for r in run(spark, rows).collect():
        got.setdefault((r.chunk_id, r.chunk_type, r.n_pieces), []).append(r)
    assert {k[:2] for k in got} == {(None, "zero"), ("a", "note"), ("b", None), ("c", "none"), ("d", "wide")}

    for (_, kind, n), pieces in got.items():
        most = {"note": 20, "wide": 10}.get(kind, 30)
        assert {p.piece_no for p in pieces} == set(range(n)) and all(len(p.piece) <= most for p in pieces)
    wide = sorted(got[("d", "wide", got_n(got, "d"))], key=lambda p: p.piece_no)
    assert all(b.start > a.start for a, b in zip(wide, wide[1:], strict=False)) and wide[-1].stop == len(text)
    assert run(spark, []).count() == 0

def got_n(got, i):
    return next(k[2] for k in got if k[0] == i)

def test_long_text(spark):
    text = ("word " * 11 + "end. ") * 40_000
    rows = run(spark, [("x", "note", text, "", 0)]).orderBy("piece_no").collect()
    out, at = [], 0
    for r in rows:
        out.append(r.piece[at - r.start :])
        at = r.stop
    assert "".join(out) == text and len(rows) > 100_000

def test_boundary_before_the_window(spark):
    text = "ab cd\n" + "x" * 40
    assert [text[a:b] for a, b, _ in split.cut_places(codes(text), 20, 3, early=True)][0] == "ab cd\n"
    rows = spark.createDataFrame([("c", "note", text)], "chunk_id string, chunk_type string, content string")
    limits = spark.createDataFrame([("*", 20, 3)], "chunk_type string, max_chars int, overlap_chars int")
    pieces = [r.piece for r in split.split_oversized(rows, limits, "chunk_id", "chunk_type", "content").orderBy("piece_no").collect()]
    assert pieces[0] == "ab cd\n" and all(len(p) <= 20 for p in pieces) and all(b.startswith(a[-3:]) for a, b in zip(pieces, pieces[1:]))
    assert pieces[0] + "".join(p[3:] for p in pieces[1:]) == text
