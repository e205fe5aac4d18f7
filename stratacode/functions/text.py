"""Identifiers, analysed text and queries: the one analyzer that documents and queries share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F


def split_identifiers(text: Column | str) -> Column:
    """camelCase and snake_case to words, case kept; null gives ''."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.translate(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "_", " ")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9 of the split text, in order; no tokens, an empty array."""
    flat = F.trim(F.regexp_replace(F.lower(split_identifiers(text)), "[^a-z0-9]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def split_query(query: str) -> str:
    """The query side of :func:`split_identifiers`."""
    return re.sub(r"([a-z])([A-Z])", r"\1 \2", query).replace("_", " ")


@dataclass
class Query:
    """A web-style query in disjunctive form: any group of which all phrases occur and no ``negative`` one does."""

    groups: list[list[list[str]]] = field(default_factory=list)
    negative: list[list[str]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return sorted({t for g in self.groups for p in g for t in p})


def parse_query(text: str) -> Query:
    """Words must all occur; "..." is a phrase, ``or`` separates alternatives, a leading ``-`` excludes."""
    q, group = Query(), []
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', split_query(text)):
        minus, raw = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if m[2] is None and not minus and raw.lower() == "or":
            if group:
                q.groups.append(group)
            group = []
            continue
        words = re.findall(r"[a-z0-9]+", raw.lower())
        if not words:
            continue
        if minus:
            q.negative.append(words)
        elif m[2] is not None:
            group.append(words)
        else:
            group += [[w] for w in words]
    if group:
        q.groups.append(group)
    return q


def embedding_text(name: str = "name", signature: str = "signature", purpose: str = "ai_purpose", docstring: str = "docstring", code: str = "code_snippet") -> Column:
    """The text an embedding is made of: name, signature, purpose, 500 characters of documentation and 2,000 of code, without the empty ones."""
    parts = [F.col(name), F.col(signature), F.col(purpose), F.substring(docstring, 1, 500), F.substring(code, 1, 2000)]
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two float arrays in double precision; null for another length or a zero vector."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)
