"""Facts of JavaScript, TypeScript, Go, Java and Rust sources.

Definitions are found by their heads in the code without comments and texts; brackets are matched, so a definition ends
where its body does. A function within a class is one of its methods; a call belongs to the innermost function around it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from .lexer import blank, comment_text, line_numbers, pairs_of

_ID = r"[A-Za-z_$][\w$]*"
#: Words before a parenthesis that call nothing. Keywords and output statements of the languages.
NOT_CALLED = frozenset(
    "if for while switch catch return else then with elif when yield throw delete typeof instanceof void await assert print println super new do case try finally class function continue break debugger default".split()
)
_NO_METHOD = NOT_CALLED | {"synchronized", "match", "loop", "fn", "func", "import", "constructor_"}
_MODS = r"(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set|accessor|export|default|declare|final|synchronized|native|strictfp|transient)\b\s*)*"
_HEADS = {
    "javascript": [
        ("function", re.compile(rf"(?P<mods>(?:export\s+)?(?:default\s+)?(?:async\s+)?)function\b\s*\*?\s*(?P<name>{_ID})?\s*(?:<[^>(]*>)?\s*(?=\()")),
        ("variable", re.compile(rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;\n]+)?=\s*(?P<mods>async\s+)?(?:function\b\s*\*?\s*(?:{_ID})?\s*)?(?:<[^>(]*>\s*)?(?=\(|{_ID}\s*=>)")),
        ("method", re.compile(rf"(?<=[\{{\}};\n])[ \t]*(?P<mods>{_MODS})\*?\s*#?(?P<name>{_ID})\s*(?:<[^>(]*>)?\s*(?=\()")),
        ("field", re.compile(rf"(?<=[\{{\}};\n])[ \t]*(?:(?:public|private|protected|static|readonly|override)\s+)*#?(?P<name>{_ID})\s*(?::[^=;\n]+)?=\s*(?P<mods>async\s+)?(?=\(|{_ID}\s*=>)")),
    ],
    "go": [("function", re.compile(rf"(?m)^func\s*(?:\([^)]*\)\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\])?\s*(?=\()"))],
    "java": [("method", re.compile(rf"(?<=[\{{\}};\n])[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?P<mods>{_MODS})(?:<[^>(]+>\s*)?(?P<type>[\w.$]+(?:<[^;(){{}}]*>)?(?:\[\])*\s+)?(?P<name>{_ID})\s*(?=\()"))],
    "rust": [("function", re.compile(r"(?P<mods>(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default)\s+)*(?:extern\s+(?:\"[^\"]*\"\s+)?)?)\bfn\s+(?P<name>\w+)\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*(?=\()"))],
}
_HEADS["typescript"] = _HEADS["javascript"]
_CLASSES = {
    "javascript": re.compile(rf"\bclass\s+(?P<name>{_ID})"),
    "typescript": re.compile(rf"\b(?:class|interface)\s+(?P<name>{_ID})"),
    "go": re.compile(rf"(?m)^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+(?:struct|interface)\b"),
    "java": re.compile(rf"\b(?:class|interface|enum|record)\s+(?P<name>{_ID})"),
    "rust": re.compile(r"(?m)^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?(?:(?:struct|enum|trait)\s+(?P<name>\w+)|impl(?:<(?:[^<>]|<[^<>]*>)*>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?P<impl>\w+))"),
}
_IMPORTS = {
    "javascript": [re.compile(r"\bimport\s+(?:[\w$*{}\s,]+?\s+from\s+)?['\"]([^'\"\n]+)['\"]"), re.compile(r"\brequire\s*\(\s*['\"]([^'\"\n]+)['\"]\s*\)"), re.compile(r"\bexport\s+[\w$*{}\s,]+?\s+from\s+['\"]([^'\"\n]+)['\"]")],
    "go": [re.compile(r"(?m)^import\s+(?:[\w.]+\s+)?[\"`]([^\"`\n]+)[\"`]")],
    "java": [re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;")],
    "rust": [re.compile(r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)")],
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
_GO_BLOCK = re.compile(r"(?ms)^import\s*\((.*?)\)")
_BASES = re.compile(rf"\b(?P<kind>class|interface|enum|record)\s+(?P<name>{_ID})(?:\s*<[^{{]*?>)?(?P<rest>[^{{;]*)")
_CALL = re.compile(rf"({_ID})\s*(?:::<[^>()]*>)?\(")


def _params(text: str) -> list[str]:
    """The parameters between the outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[i - 1 : i] not in ("=", "-")))
        if c == "," and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def _param_types(text: str, language: str) -> dict[str, str]:
    got = {}
    for p in _params(text):
        p = re.sub(r"\s*=.*$", "", p.lstrip(".@")).strip()
        if language in ("typescript", "javascript", "rust"):
            name, colon, kind = p.partition(":")
            if colon and re.fullmatch(r"(?:(?:mut|public|private|protected|readonly)\s+)*[\w$]+\??", name.strip()):
                got[name.strip().split()[-1].rstrip("?")] = kind.strip()
        elif language == "java":
            words = re.sub(r"^(?:final\s+|@\w+\s+)*", "", p).rsplit(None, 1)
            if len(words) == 2:
                got[words[1]] = words[0]
        elif language == "go":
            words = p.split(None, 1)
            if len(words) == 2:
                got[words[0]] = words[1]
    return got


def _return_type(after: str, m: re.Match, language: str) -> str | None:
    text = after.strip()
    if language == "java":
        kind = m.groupdict().get("type")
        return kind.strip() if kind else None
    if language == "rust":
        got = re.match(r"->\s*(.+?)\s*(?:\bwhere\b.*)?$", text, re.S)
        return got[1] if got else None
    if language == "go":
        return text or None
    got = re.match(r":\s*(.+?)\s*(?:=>)?$", text, re.S)
    return got[1] if got and language == "typescript" else None


def _docs(source: str, spans: list[tuple[int, int]], line: Callable[[int], int]) -> dict[int, str]:
    """The comment block that ends on the line before each line (its number), a blank line in between ends it."""
    by_end: dict[int, tuple[int, str]] = {}
    for a, b in spans:
        if source[source.rfind("\n", 0, a) + 1 : a].strip():
            continue
        first, last = line(a), line(b)
        text = comment_text(source[a:b])
        if first - 1 in by_end:
            first, text = by_end[first - 1][0], f"{by_end[first - 1][1]}\n{text}"
        by_end[last] = (first, text)
    return {k + 1: t for k, (_, t) in by_end.items()}


_TAIL, _ARROW, _STOP, _COLON = re.compile(r"[^{;=]*(?:=(?!>)[^{;]*)?(?:=>)?\s*"), re.compile(rf"({_ID})\s*=>\s*"), re.compile(r"[;\n]"), re.compile(r"\s*:")


def _innermost(positions: Iterable[int], items: list[dict], beyond: str = "at") -> list[dict | None]:
    """For each position, in ascending order, the item of the last start whose range holds it, its ``beyond`` not after it.

    ``items`` are sorted by start; those that have ended leave the stack for good, so one sweep serves all positions.
    """
    out, stack, k = [], [], 0
    for i in positions:
        while k < len(items) and items[k]["at"] < i:
            stack.append(items[k])
            k += 1
        while stack and stack[-1]["end"] < i:
            stack.pop()
        out.append(next((x for x in reversed(stack) if i <= x["end"] and x[beyond] <= i), None))
    return out


def parse_braces(source: str, language: str) -> dict:
    """The facts; an unknown language or an empty source has none."""
    if language not in _HEADS or not source.strip():
        return {"functions": [], "classes": [], "calls": [], "imports": [], "extends": []}
    plain, code, spans = blank(source, quotes="\"'" if language in ("java", "rust") else "\"'`", lifetimes=language == "rust")
    line = line_numbers(source)
    docs = _docs(source, spans, line)
    round_, curly = pairs_of(code, "()"), pairs_of(code, "{}")
    classes = []
    for m in _CLASSES[language].finditer(code):
        brace = code.find("{", m.end())
        stop = code.find(";", m.end())
        end = curly.get(brace, -1) if brace >= 0 and not 0 <= stop < brace else (stop if stop >= 0 else m.end())
        name = m.groupdict().get("name") or m.groupdict().get("impl")
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        classes.append({"name": name, "at": start, "end": end if end >= 0 else len(code) - 1, "body": brace})

    in_class = bytearray(len(code) + 1)  # which positions lie in the body of a class
    for c in classes:
        if c["body"] >= 0 and c["end"] > c["body"]:
            in_class[c["body"] + 1 : c["end"] + 1] = b"\1" * (c["end"] - c["body"])
    class_names = {c["name"] for c in classes}
    found: dict[int, dict] = {}
    for kind, head in _HEADS[language]:
        for m in head.finditer(code):
            name = m["name"]
            if not name or name in _NO_METHOD and kind == "method":
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if code[m.end()] == "(":
                shut = round_.get(m.end(), -1)
                if shut < 0:
                    continue
                inner = source[m.end() + 1 : shut]
                tail = _TAIL.match(code, shut + 1)
                after, body = tail[0], shut + 1 + len(tail[0])
            else:
                got = _ARROW.match(code, m.end())
                inner, shut, after, body = got[1], m.end() + len(got[1]), "=>", m.end() + len(got[0])
            arrow = "=>" in after
            opens = code[body : body + 1] == "{"
            if kind in ("variable", "field") and not arrow and "function" not in m[0]:
                continue
            if kind == "method":
                inside = in_class[start]
                if language == "java":
                    if not inside or (not opens and code[body : body + 1] != ";") or re.search(r"[=.+\-*/&|?]", after.replace("throws", "")) or m["type"] and m["type"].strip() in ("return", "new", "else", "throw", "case"):
                        continue
                    if not m["type"] and name not in class_names:
                        continue
                elif not opens and not (inside and _COLON.match(after)) or arrow or after.strip()[:1] in (",", ")", ".", "?", "+"):
                    continue
            if kind == "field" and not in_class[start]:
                continue
            if opens:
                end = curly.get(body, -1)
            else:
                semi = _STOP.search(code, body)
                end = semi.start() if semi else len(code) - 1
            mods = (m.groupdict().get("mods") or "").split()
            shown = " ".join([x for x in ("static", "async", "get", "set") if x in mods] if language in ("javascript", "typescript") else [])
            signature = f"{shown} {name}({', '.join(_params(inner))})".strip() if language in ("javascript", "typescript") else " ".join(source[start : shut + 1].split())
            entry = {
                "name": name,
                "signature": signature,
                "start_line": line(start),
                "end_line": line(end if end >= 0 else len(code) - 1),
                "docstring": docs.get(line(start), ""),
                "return_type": _return_type(after, m, language),
                "param_types": _param_types(inner, language),
                "at": start,
                "name_at": m.start("name"),
                "end": end if end >= 0 else len(code) - 1,
                "body": body,
            }
            found.setdefault(shut, entry)
    defs = sorted(found.values(), key=lambda f: f["at"])

    calls = []
    named = {f["name_at"] for f in defs}
    made = [m for m in _CALL.finditer(code) if m[1] not in NOT_CALLED and m.start() not in named]
    for m, owner in zip(made, _innermost((m.start() for m in made), defs, "body"), strict=True):
        calls.append({"source": owner["name"] if owner else "<module>", "target": m[1], "line": line(m.start())})

    imports = [{"target": m[1], "line": line(m.start(1))} for p in _IMPORTS[language] for m in p.finditer(plain)]
    if language == "go":
        for b in _GO_BLOCK.finditer(plain):
            imports += [{"target": m[1], "line": line(b.start(1) + m.start(1))} for m in re.finditer(r"[\"`]([^\"`\n]+)[\"`]", b[1])]
    imports = sorted({(i["line"], i["target"]) for i in imports})

    extends = []
    if language in ("javascript", "typescript", "java"):
        for m in _BASES.finditer(code):
            for word, kind in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
                got = re.search(rf"\b{word}\s+(.+?)(?=\bimplements\b|\bextends\b|\bpermits\b|$)", m["rest"], re.S)
                for p in _params(got[1]) if got else []:
                    extends.append({"class": m["name"], "parent": re.split(r"[.]", re.sub(r"[<(].*", "", p, flags=re.S).strip())[-1], "line": line(m.start()), "rel_type": kind})
    elif language == "rust":
        for m in re.finditer(r"\bimpl(?:<(?:[^<>]|<[^<>]*>)*>)?\s+([\w:]+)(?:<[^{]*?>)?\s+for\s+(\w+)", code):
            extends.append({"class": m[2], "parent": m[1].split("::")[-1], "line": line(m.start()), "rel_type": "EXTENDS"})
        for m in re.finditer(r"\btrait\s+(\w+)(?:<[^{:]*>)?\s*:\s*([^{]+)", code):
            extends += [{"class": m[1], "parent": p.strip().split("::")[-1].split("<")[0], "line": line(m.start()), "rel_type": "EXTENDS"} for p in m[2].split("+") if not p.strip().startswith("'")]

    keys = ("name", "signature", "start_line", "end_line", "docstring", "return_type", "param_types")
    out = lambda f: {k: f[k] for k in keys}
    shown_classes, seen = [], {}
    starts, by_start = [f["at"] for f in defs], sorted(classes, key=lambda c: c["at"])
    members: dict[int, list[dict]] = {}
    free = []
    for f, c, outer in zip(defs, _innermost(starts, by_start), _innermost(starts, defs), strict=True):
        if c and not (outer and outer["at"] > c["at"]):
            members.setdefault(id(c), []).append(out(f))
        else:
            free.append(out(f))
    for c in classes:
        methods = members.get(id(c), [])
        if c["name"] in seen:
            seen[c["name"]]["methods"] += methods
            continue
        seen[c["name"]] = {"name": c["name"], "start_line": line(c["at"]), "end_line": line(c["end"]), "docstring": docs.get(line(c["at"]), ""), "methods": methods}
        shown_classes.append(seen[c["name"]])
    return {
        "functions": free,
        "classes": shown_classes,
        "calls": calls,
        "imports": [{"target": t, "line": n} for n, t in imports],
        "extends": extends,
    }
