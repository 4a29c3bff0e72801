"""SQL text to tokens and statements. Every scan is linear in the text."""

from __future__ import annotations

import re
from typing import NamedTuple

_SCAN = re.compile(
    r"(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^']|'')*(?:'|\Z))|(?P<quoted>\"[^\"]*(?:\"|\Z)|`[^`]*(?:`|\Z))"
    r"|(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d][\w$#]*)|(?P<mark>.)",
    re.S,
)
# Objects whose body is PL/SQL, ended by a line with a slash only.
_BODIES = {"PROCEDURE", "FUNCTION", "PACKAGE", "TRIGGER", "TYPE"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    stop: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokens(sql: str) -> list[Token]:
    """Words, quoted names, strings, numbers and single marks; no blanks or comments."""
    out = []
    for m in _SCAN.finditer(sql):
        kind = m.lastgroup or "mark"
        if kind not in ("space", "comment"):
            out.append(Token(kind, m.group(), m.start(), m.end()))
    return out


def _alone_on_line(sql: str, t: Token) -> bool:
    before = sql[sql.rfind("\n", 0, t.start) + 1 : t.start]
    end = sql.find("\n", t.stop)
    return not before.strip() and not sql[t.stop : len(sql) if end < 0 else end].strip()


def statements(sql: str | None) -> list[list[Token]]:
    """The statements of a script as tokens, without their ends: `;` outside brackets and, for PL/SQL, a lone `/`."""
    out: list[list[Token]] = []
    own: list[Token] = []
    depth, body = 0, False

    def close() -> None:
        nonlocal own, depth, body
        if own:
            out.append(own)
        own, depth, body = [], 0, False

    for t in tokens(sql or ""):
        if t.kind == "mark" and t.text == "/" and _alone_on_line(sql, t):
            close()
            continue
        if t.kind == "mark" and t.text == ";" and depth <= 0 and not body:
            close()
            continue
        if t.kind == "mark":
            depth += (t.text == "(") - (t.text == ")")
        own.append(t)
        if len(own) <= 6 and not body:
            first = own[0].up
            body = first in ("BEGIN", "DECLARE") or (first == "CREATE" and t.kind == "word" and t.up in _BODIES)
    close()
    return out


def text_of(sql: str, own: list[Token]) -> str:
    return sql[own[0].start : own[-1].stop] if own else ""


def split_top(own: list[Token], mark: str = ",") -> list[list[Token]]:
    """Tokens cut at `mark` outside brackets; empty parts go."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in own:
        if t.kind == "mark":
            depth += (t.text == "(") - (t.text == ")")
            if t.text == mark and depth == 0:
                out.append([])
                continue
        out[-1].append(t)
    return [p for p in out if p]


def bracket(own: list[Token], at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(own)):
        if own[i].kind == "mark":
            depth += (own[i].text == "(") - (own[i].text == ")")
            if depth == 0:
                return i + 1
    return len(own)
