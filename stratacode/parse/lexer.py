"""A small scanner for languages with braces: which characters are code, text or comment."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from functools import lru_cache


_BODY = {q: rf"{q}(?:[^{q}\\\n]|\\.|\\\n)*{q}?" for q in "\"'"} | {"`": r"`(?:[^`\\]|\\[\s\S])*`?"}
_RUST_CHAR = r"'(?:\\[^\n]+?|[^'\\\n])'"
_NOT_END = re.compile(r"[^\n]")


@lru_cache(maxsize=16)
def _scanner(quotes: str, lifetimes: bool) -> re.Pattern:
    texts = [_RUST_CHAR if q == "'" and lifetimes else _BODY[q] for q in quotes]
    return re.compile(r"(?P<note>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>" + "|".join(texts) + ")")


def blank(source: str, quotes: str = "\"'`", lifetimes: bool = False) -> tuple[str, str, list[tuple[int, int]]]:
    """(without comments, without comments and text, spans of the comments); lengths and line ends stay.

    ``lifetimes``: a single quote that encloses no single character (Rust) is no text.
    """
    plain, code, spans, at = [], [], [], 0
    for m in _scanner(quotes, lifetimes).finditer(source):
        a, b = m.span()
        plain.append(source[at:a])
        code.append(source[at:a])
        empty = _NOT_END.sub(" ", m[0])
        if m["note"] is not None:
            spans.append((a, b))
            plain.append(empty)
            code.append(empty)
        else:
            plain.append(m[0])
            code.append(m[0][0] + empty[1:-1] + m[0][-1] if len(m[0]) > 1 else m[0])
        at = b
    return "".join([*plain, source[at:]]), "".join([*code, source[at:]]), spans


def pairs_of(text: str, signs: str) -> dict[int, int]:
    """The position of the closing bracket of each opening one that is closed, in one pass."""
    out, open_ = {}, []
    for m in re.finditer(f"[{re.escape(signs)}]", text):
        if m[0] == signs[0]:
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def line_numbers(text: str) -> Callable[[int], int]:
    """A function from a position to its line, from 1."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect.bisect_left(ends, at) + 1


def comment_text(raw: str) -> str:
    """The words of a comment without its signs."""
    out = []
    for row in raw.split("\n"):
        row = row.strip()
        for sign in ("/**", "/*!", "/*", "///", "//!", "//", "*/", "*"):
            if row.startswith(sign):
                row = row[len(sign) :]
                break
        out.append(row.removesuffix("*/").strip())
    return "\n".join(out).strip()
