"""Problem 7: credentials written into code, found and masked.

Every line is read, quoted or not. Quoted strings and long tokens are extracted, their Shannon entropy is compared with
a threshold adjusted to their alphabet and length, and hashes, identifiers and known placeholders are excluded. What
stands around a value only moves the threshold: after a credential's name, in a URL's user part, a header or a login
noted in a comment a value needs the share ``NAMED`` of its alphabet's entropy, a token without a name ``UNNAMED``.
Private keys are taken as whole blocks. The time is linear in the text: finds are kept in order, the closing quote is
looked up once, and no pattern scans a line again from every sign in it.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_NAMED = re.compile(
    r"""(?i)(passwd|password|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|signing[_-]?key|private[_-]?key|encryption[_-]?key|auth[_-]?key|(?<![a-z_\-])key|(?<![a-z])auth|authorization|credentials?)"""
    r"""["'`]?\]?\s*(?::\s*(?:&'?\w+\s+)?&?[A-Za-z_][\w<>\[\]]*\s*(?==))?(?::=|=>|==?|:|,)\s*[rbfRBF]?(["'`])"""
)
_INSIDE = re.compile(r"""(?i)(?:(?<=[;?&"'`\s,])|(?<=^))((?:[a-z]+[_-])*(?:passwd|password|passphrase|pwd|pass|secret|token|key|apikey|accesskey|sig|signature|auth))(?:=|: ?)([^\s;&'"`<>(){}\[\],\\]{6,})""")
_USERINFO = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@'"`]*:([^\s/@'"`]+)@""")
_CURL = re.compile(r"""(?:^|[\s"'`])(?:-u|--user)[ =]['"]?[\w.\-]+:([^\s'"`]+)""")
_SCHEME = re.compile(r"""(?:Bearer|Token|Basic|ApiKey)\s+([A-Za-z0-9+/=_.\-~]{12,})""")
_NOTED = re.compile(r"(?i)\b(?:log-?in|cred(?:ential)?s?|passwords?|passwd|pw|account)\b")
_SAID = re.compile(r"(?i)\b(?:password|passwd|passphrase|pwd|pw|pin|token|secret|key)[ \t]+(?:is[ \t]+|was[ \t]+)?([^\s:/()]{7,})(?=[\s,;.)]|$)")
_COMMENT = re.compile(r"//|#|\*|--")
_SETTING = re.compile(
    r"(?i)^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+|\*[ \t]+|#[ \t]*)?[\w.\-]*?(?:passwd|password|passphrase|passcode|pwd|pass|secret|token|api[_\-.]?key|access[_\-.]?key|secret[_\-.]?key|private[_\-.]?key|auth[_\-.]?key|credential)s?"
    r"[ \t]*(?:=|:(?![:=/]))[ \t]*([^\s\"'`(){}\[\]<>;,]{6,})[ \t]*(?:#.*)?$"
)
_TOKEN = re.compile(r"[A-Za-z0-9+/=_\-.]{20,}")
_PUBLIC = re.compile(r"-----BEGIN [A-Z0-9 ]*(?:PUBLIC KEY|CERTIFICATE)[A-Z0-9 ]*-----[\s\S]*?-----END [A-Z0-9 ]*-----")
#: What stands before a random token that is no secret.
_HARMLESS = re.compile(r"(?i)(?:(?:sha|hash|sum|digest|public|etag|alphabet|charset|integrity|image|base64|commit|trace|revision|fingerprint|nonce|uuid|guid)\w*['\"\]]?\s*(?::\s*\w+\s*)?[:=]+\s*['\"`]?|base64,|sha\d+[-:]|h1:|ssh-\w+ )$")
#: A line without any of these holds no named value.
_SIGNS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "sig", "pw", "pin", "login", "log-in", "account", "bearer", "basic", "://", "-u")
#: Shares of the entropy of a random string of the same alphabet and length.
NAMED, UNNAMED = 0.6, 0.8
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_DIGIT, _SYLLABLES = re.compile(r"[0-9]"), re.compile(r"[A-Z]?[a-z]{3,}")
_HEX = re.compile(r"(?i)(?:0x)?[0-9a-f]+")
_FAKE = re.compile(
    r"(?i)(?:^(?:example|sample|dummy|fake|secret|password|token|key|value)(?:[_\-]?(?:key|token|secret|password|value|\d{1,3}))*$|change[_-]?me|replace[_-]?me|place[_-]?holder|your[_\-]|my[_-]?(?:token|key|secret|password)|insert[_-]|redacted|^todo|^test(?:ing)?$|^foo|^bar$|none$|null$|undefined$|n/a$|x{4,}|^x{3}|\*{3}|\.{3}|<[^>]*>|\$\{|\$\(|\{\{|%\(|^%[sdv]$|#\{|\$[A-Z_]+$)"
)


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def threshold(text: str, share: float = UNNAMED) -> float:
    """The least entropy: a share of what a random string of this alphabet and length reaches, short strings having less."""
    size = 10 if text.isdigit() else 16 if _HEX.fullmatch(text) else 36 if text.islower() or text.isupper() else 64
    n = len(text)
    return share * math.log2(max(2, min(size, n))) - 0.2


def _turns(v: str) -> float:
    """How often letters change case or meet digits, per character: seldom in words and names, often in random text."""
    return sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(v, v[1:], strict=False)) / len(v)


def _identifier(v: str) -> bool:
    """A word, dotted name or path: letters and separators only, and neither long capitals nor a long mix of cases at random."""
    if re.fullmatch(r"[A-Za-z_\-./: ]*", v) is None:
        return False
    if len(v) >= 16 and v.isupper() and v.isalpha():
        return entropy(v) < 3.2
    return not (len(v) >= 20 and entropy(v) >= 3.8 and _turns(v) >= 0.2)


def _credible(v: str, strong: bool = False) -> bool:
    """Whether a named value is a credential; ``strong`` for names that mostly mean something else."""
    if len(v) < 5 or " " in v or _FAKE.search(v) or len(set(v)) < 4 or _identifier(v):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v) or v.isdigit():
        return False
    return entropy(v) >= threshold(v, NAMED) and (not strong or (len(v) >= 16 and entropy(v) >= min(threshold(v), 3.0)))


def _password(name: str, v: str) -> bool:
    """Whether a word of letters after a name that ends in a password's own is one: one that no name of a field repeats."""
    return re.fullmatch(r"(?i)(?:pass|passwd|password|pwd)", name) is not None and len(v) >= 8 and v.isalpha() and v.islower() and not _FAKE.search(v) and entropy(v) >= threshold(v, 0.7) and not re.search("pass|word|secret|token|field|input|auth|user|login|require|invalid|missing|hidden|default|string|encrypt|reset", v)


def _random(v: str, bare: bool = False) -> bool:
    """Whether an unnamed token is too random for a word, and no hash, id or alphabet; ``bare``: it stands without quotes."""
    low = v.lower()
    if v == low or v == v.upper() or not _DIGIT.search(v) or "/" in v and "." in v or "abcdef" in low or "012345" in v:
        return False
    if _HEX.fullmatch(v) or _UUID.fullmatch(v) or _FAKE.search(v):
        return False
    if all(re.fullmatch(r"[A-Za-z]*\d{0,4}", p) for p in re.split(r"[_\-./=+]" if bare else r"[_\-./]", v)):
        return False
    if sum(map(len, _SYLLABLES.findall(v))) >= 0.6 * len(v):
        return False
    return entropy(v) >= threshold(v) and _turns(v) >= 0.3


class _Spans:
    """Finds that do not overlap; the first to come stays."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_right(self.starts, start)
        if (k == 0 or self.ends[k - 1] <= start) and (k == len(self.starts) or end <= self.starts[k]):
            self.starts.insert(k, start)
            self.ends.insert(k, end)

    def free(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start)
        return (k == 0 or self.ends[k - 1] <= start) and (k == len(self.starts) or end <= self.starts[k])


_LONG_TEXT = (('"""', '"""'), ("'''", "'''"), ("`", "`"), ("/*", "*/"))


def _over_lines(code: str) -> list[tuple[int, int]]:
    """Where strings and comments lie that go over line ends, in order."""
    nearest = {o: code.find(o) for o, _ in _LONG_TEXT}
    out, at = [], 0
    while True:
        live = [(k, o, c) for o, c in _LONG_TEXT if (k := nearest[o]) >= 0]
        if not live:
            return out
        start, opener, closer = min(live)
        end = code.find(closer, start + len(opener))
        if end < 0:
            nearest[opener] = -1
            continue
        at = end + len(closer)
        if "\n" in code[start:at]:
            out.append((start, at))
        for o, _ in _LONG_TEXT:
            if 0 <= nearest[o] < at:
                nearest[o] = code.find(o, at)


def _strings(line: str) -> list[tuple[int, int]]:
    """The quoted parts of a line, in order; one that is not closed goes to the end."""
    return [m.span() for m in re.finditer(r"""(["'`])(?:[^"'`\\]|\\.|(?!\1)["'`])*(?:\1|$)""", line)]


def find_secrets(code: str | None) -> list[tuple[int, int]]:
    """(start, end) of each credential, in order and without overlap."""
    if not code:
        return []
    found = _Spans()
    if "PRIVATE KEY" in code:
        for m in _PEM.finditer(code):
            found.add(*m.span())
    public = [m.span() for m in _PUBLIC.finditer(code)] if "-----BEGIN" in code else []
    known = lambda at: any(x <= at < y for x, y in public)
    for at, end, inside in _lines_with_signs(code):
        for a, b in _in_line(code[at:end], inside):
            if not known(at + a):
                found.add(at + a, at + b)
    for m in _TOKEN.finditer(code):
        a, b = m.span()
        bare = not (a and code[a - 1] in "\"'`" and code[b : b + 1] == code[a - 1])
        v = code[a:b].rstrip(".") if bare else code[a:b]
        if bare and "=" in v.rstrip("="):  # name=value without blanks
            name = v.rstrip("=").rfind("=") + 1
            a, v = a + name, v[name:]
        if len(v) >= 20 and _random(v, bare) and found.free(a, a + len(v)) and not _HARMLESS.search(code[max(code.rfind("\n", 0, a) + 1, a - 60) : a - (not bare)]) and not known(a):
            found.add(a, a + len(v))
    return list(zip(found.starts, found.ends, strict=True))


def _lines_with_signs(code: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, inside a longer string or comment) of each line that may hold a named value."""
    low = code.lower() if code.isascii() else "".join(c.lower() if c < "\x80" else c for c in code)
    hits: list[int] = []
    for sign in _SIGNS:
        at = low.find(sign)
        while at >= 0:
            hits.append(at)
            end = low.find("\n", at)  # one hit a line is enough
            at = low.find(sign, end) if end >= 0 else -1
    if not hits:
        return
    long_texts = _over_lines(code) if "\n" in code else []
    starts, done = [a for a, _ in long_texts], 0
    for hit in sorted(hits):
        if hit >= done:
            at = code.rfind("\n", 0, hit) + 1
            end = code.find("\n", hit)
            done = len(code) if end < 0 else end
            k = bisect.bisect_right(starts, at) - 1
            yield at, done, k >= 0 and long_texts[k][0] < at < long_texts[k][1]


def _in_line(code: str, inside: bool) -> list[tuple[int, int]]:
    """The spans of one line, the surest kinds first; ``inside``: the line lies in a longer string or comment."""
    found, low = _Spans(), code.lower()
    quoted: list[tuple[int, int]] | None = None

    def in_string(at: int) -> bool:
        nonlocal quoted
        if inside:
            return True
        quoted = _strings(code) if quoted is None else quoted
        k = bisect.bisect_right(quoted, (at, 0)) - 1
        return k >= 0 and quoted[k][0] < at < quoted[k][1]

    if "://" in code:
        for m in _USERINFO.finditer(code):
            if _credible(m[1]):
                found.add(*m.span(1))
    if "-u" in code:
        for m in _CURL.finditer(code):
            if _credible(m[1]):
                found.add(*m.span(1))
    if any(w in low for w in _SIGNS[:-2]):
        last = {q: code.rfind(q) for q in "\"'`"}
        for m in _NAMED.finditer(code):
            name, quote, start = m[1].lower(), m[2], m.end()
            end = start
            while end < last[quote] and code[end] != quote:
                end += 2 if code[end] == "\\" else 1
            value = code[start:end]
            if end > last[quote] or code[end : end + 1] != quote or not value:
                continue
            if low[max(0, m.start() - 7) : m.start()].endswith(("public_", "public-", "public")):
                continue
            scheme = _SCHEME.fullmatch(value)
            if scheme:
                if _credible(scheme[1]):
                    found.add(start + scheme.start(1), start + scheme.end(1))
            elif (_credible(value, strong=name in ("key", "auth", "authorization")) or _password(name, value)) and "://" not in value and not re.search(r"[;&]\s*\w+=|\w=|^\w+: ", value[:-2]):
                found.add(start, end)
        for m in _SCHEME.finditer(code):
            if _credible(m[1], strong=True) and in_string(m.start()):
                found.add(*m.span(1))
        for m in _INSIDE.finditer(code):
            if _credible(m[2]) and in_string(m.start(1)):
                found.add(*m.span(2))
        m = _SETTING.match(code)
        if m and _credible(m[1]) and (not re.fullmatch(r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*", m[1]) or _random(m[1])):
            found.add(*m.span(1))
        sign = _COMMENT.search(code)
        if sign or inside:
            begin = 0 if inside else sign.end()
            noted = lambda v: _credible(v) and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not _UUID.fullmatch(v)
            if _NOTED.search(code, begin):
                end = len(code.rstrip().removesuffix("*/").rstrip())
                start = end
                while start > begin and code[start - 1] not in " \t:/":
                    start -= 1
                word = _NOTED.search(code, begin)
                if end - start >= 7 and word.end() <= start and re.search(r"(?i)(?:[:/=]|\bis|\bwas)[ \t]*$", code[max(word.end(), start - 40) : start]) and noted(code[start:end]):
                    found.add(start, end)
            for m in _SAID.finditer(code, begin):
                if noted(m[1]):
                    found.add(*m.span(1))
    return list(zip(found.starts, found.ends, strict=True))


def mask(code: str | None, sign: str = "*", spans: list[tuple[int, int]] | None = None) -> str | None:
    """The code with each character of a credential replaced, but for line ends: lengths, lines and quotes stay."""
    if not code:
        return code
    out, at = [], 0
    for a, b in find_secrets(code) if spans is None else spans:
        out += [code[at:a], re.sub(r"[^\r\n]", sign, code[a:b])]
        at = b
    return "".join([*out, code[at:]])


def _find(masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ids, texts = [], [], []
            for kind, i, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = find_secrets(code)
                for x in [mask(code, spans=got)] if masked and got else [] if masked else [code[s:e] for s, e in got]:
                    kinds.append(kind)
                    ids.append(i)
                    texts.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["record_table", "record_id", "text"])

    return run


def code_records(functions: DataFrame, classes: DataFrame) -> DataFrame:
    f = functions.select(F.lit("functions").alias("record_table"), F.col("id").cast("long").alias("record_id"), "code_snippet")
    return f.union(classes.select(F.lit("classes"), F.col("id").cast("long"), "code_snippet")).where("code_snippet is not null")


def credentials(records: DataFrame) -> DataFrame:
    """(record_table, record_id, secret_text), distinct. Null and empty code has none; code is read whole."""
    return records.mapInArrow(_find(False), "record_table string, record_id long, text string").withColumnRenamed("text", "secret_text").distinct()


def masked(records: DataFrame) -> DataFrame:
    """(record_table, record_id, masked_code) of the records that hold a credential."""
    return records.mapInArrow(_find(True), "record_table string, record_id long, text string").withColumnRenamed("text", "masked_code")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_records(table(spark, sf_dir, "functions"), table(spark, sf_dir, "classes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(_records(spark, sf_dir))


def p7_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(_records(spark, sf_dir))
