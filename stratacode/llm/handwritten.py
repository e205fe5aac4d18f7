"""Problem 4: files that nobody wrote by hand.

Three sources of evidence, in this order:

1. Attribute files. A repository's own ``.gitattributes`` texts, where given, decide its files line by line, and
   conventions of public tools, in the same form, stand in for repositories without a say. A pattern without a slash
   matches the name in any folder below its file's, one with a slash the path from there; ``*`` and ``?`` stay within a
   folder, ``**`` does not; later lines and deeper folders win; ``-attr`` and ``attr=false`` unset a mark; macros
   (``[attr]name ..``) stand for what they set and quoted patterns may hold blanks.
2. Shape. A file larger than people write, or with lines longer than people write, is compressed code or data.
3. Mined patterns. Folders, endings, first and last words of names are features of a path. Those of which nearly all
   files that can be judged, over several projects, are marked by 1 or 2 are equivalent patterns and mark the files of
   undeclared repositories that 1 and 2 leave open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut, table

MARKS = ("linguist-generated", "linguist-vendored")

#: Patterns of tools and package managers, in attribute-file form. The conventions of the tools named.
CONVENTIONS = """
# package managers and copied libraries
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/jspm_packages/** linguist-vendored
**/site-packages/** linguist-vendored
**/dist-packages/** linguist-vendored
**/Godeps/_workspace/** linguist-vendored
**/.cargo/registry/** linguist-vendored
**/Carthage/Checkouts/** linguist-vendored
**/Pods/** linguist-vendored
**/webjars/** linguist-vendored
shaded/*/** linguist-vendored
**/shaded/org/** linguist-vendored
**/vendor/*/** linguist-vendored
**/vendors/*/** linguist-vendored
**/_vendor/** linguist-vendored
**/_vendored/** linguist-vendored
**/*-vendored/** linguist-vendored
**/third_party/*/** linguist-vendored
**/third-party/*/** linguist-vendored
**/thirdparty/*/** linguist-vendored
**/3rdparty/*/** linguist-vendored
**/3rd-party/*/** linguist-vendored
**/extern/*/** linguist-vendored
external/*/** linguist-vendored
externals/*/** linguist-vendored
deps/*/** linguist-vendored
public/lib/*-[0-9]*/** linguist-vendored
libs/src-attach/** linguist-vendored
**/*-[0-9]*-sources/** linguist-vendored
# compressed for delivery
*.min.js linguist-generated
*.min.mjs linguist-generated
*.min.cjs linguist-generated
*-min.js linguist-generated
*.pack.js linguist-generated
*.umd.js linguist-generated
*.prod.js linguist-generated
*.bundle.js linguist-generated
*.[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f].js linguist-generated
# code generators
**/__generated__/** linguist-generated
**/_generated/** linguist-generated
**/generated/** linguist-generated
**/generated-sources/** linguist-generated
**/generated-types/** linguist-generated
**/openapi-client/** linguist-generated
**/swagger-client/** linguist-generated
**/target/gen/** linguist-generated
**/target/*/build/** linguist-generated
**/out/bindings_*.rs linguist-generated
*.generated.* linguist-generated
*.gen.* linguist-generated
*.g.dart linguist-generated
*.designer.cs linguist-generated
*_autogen.* linguist-generated
*.pb.go linguist-generated
*.pb.gw.go linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*_pb.js linguist-generated
*_pb.d.ts linguist-generated
*_grpc_pb.js linguist-generated
*_pb2.py linguist-generated
*_pb2.pyi linguist-generated
*_pb2_grpc.py linguist-generated
*OuterClass.java linguist-generated
*Grpc.java linguist-generated
*MapperImpl.java linguist-generated
bindata_*.go linguist-generated
*_gen.go linguist-generated
*_*_string.go linguist-generated
zz_generated* linguist-generated
mock_*/mocks.go linguist-generated
**/mock_*/mocks.go linguist-generated
parsetab*.py linguist-generated
lextab*.py linguist-generated
ui_*_rc.py linguist-generated
*_rc.py linguist-generated
moc_*.cpp linguist-generated
"""
#: Shape: no file of this many bytes and no line of this many characters is taken for hand-written.
MOST_BYTES, MOST_LINE = 256 * 1024, 1_000
#: A feature of paths is a mined pattern from this many projects and this least share (a lower bound at 95 %) of marked files up.
LEAST_PROJECTS, LEAST_SHARE = 5, 0.9


@lru_cache(maxsize=50_000)
def _pattern(glob: str, folder: str) -> re.Pattern:
    """The regular expression of an attribute pattern in a file of ``folder`` ('' or 'a/b/')."""
    anywhere = "/" not in glob.rstrip("/")
    glob = glob.lstrip("/")
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.+")
            i += 3
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return re.compile(re.escape(folder) + ("(?:.*/)?" if anywhere else "") + "".join(out), re.S)


_LINE = re.compile(r'\s*("(?:[^"\\\\]|\\\\.)*"|\S+)\s*(.*)')


def parse_attributes(text: str) -> list[tuple[str, dict[str, bool]]]:
    """(pattern, marks) of each line that sets or unsets one of the two marks, in order."""
    out: list[tuple[str, dict[str, bool]]] = []
    macros: dict[str, dict[str, bool]] = {}
    for line in (text or "").splitlines():
        m = _LINE.fullmatch(line.strip())
        if not m or line.lstrip()[0] == "#":
            continue
        glob, marks = m[1], {}
        if glob[0] == '"':
            glob = re.sub(r"\\(.)", r"\1", glob[1:-1])
        for a in m[2].split():
            name, _, value = a.lstrip("-!").partition("=")
            on = a[0] not in "-!" and value.lower() not in ("false", "0", "unset")
            if name in MARKS:
                marks[name] = on
            elif name in macros:
                marks |= macros[name] if on else dict.fromkeys(macros[name], False)
        if glob.startswith("[attr]"):
            macros[glob[6:]] = marks
        elif marks and glob[:1] not in ("!", ""):
            out.append((glob, marks))
    return out


class Rules:
    """Attribute lines of several folders; the last line of the deepest folder that matches decides each mark."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        lines = [(folder.strip("/") + "/" * bool(folder.strip("/")), text) for folder, text in files]
        lines.sort(key=lambda x: x[0].count("/"))
        self.lines = [(_pattern(g, folder), marks) for folder, text in lines for g, marks in parse_attributes(text)]
        self.any = re.compile("|".join(f"(?:{p.pattern})" for p, _ in self.lines), re.S) if self.lines else None

    def marks(self, path: str) -> dict[str, bool]:
        """Each mark that some line sets or unsets."""
        got: dict[str, bool] = {}
        if self.any is None or not self.any.fullmatch(path):
            return got
        for pattern, marks in reversed(self.lines):
            if len(got) == len(MARKS):
                break
            if any(m not in got for m in marks) and pattern.fullmatch(path):
                got = {**marks, **got}
        return got


def clean_path(path: str) -> str:
    """Forward slashes, no empty or ``.`` folders."""
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", "."))


def by_path(path: str, rules: Rules, own: Rules | None = None) -> str | None:
    """'generated', 'vendored', 'kept' (the repository says that it is source) or None."""
    path = clean_path(path)
    said = own.marks(path) if own else {}
    known = rules.marks(path)
    if not any(known.values()):
        low = path.lower()
        known = rules.marks(low) if low != path else known
    for mark in MARKS:
        if said.get(mark, known.get(mark, False)):
            return mark.removeprefix("linguist-")
    return "kept" if said else None


def by_shape(size: int, longest_line: int) -> str | None:
    """'compressed', 'data' or None."""
    if longest_line >= MOST_LINE:
        return "compressed"
    return "data" if size >= MOST_BYTES else None


def path_features(path: Column) -> Column:
    """The features of a path, lower case: its folders, the ending of its name from the first dot (runs of eight or more
    hexadecimal digits as one sign), and the first and last word of the name with its extension."""
    low = F.lower(F.translate(path, "\\", "/"))
    pieces = F.filter(F.split(low, "/"), lambda x: ~x.isin("", "."))
    name = F.coalesce(F.element_at(pieces, -1), F.lit(""))
    stem, ext = F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    word = lambda p: F.regexp_extract(stem, p, 1)
    tagged = lambda tag, x, end: F.when(x != "", F.concat(F.lit(tag), x, end))
    ending = F.regexp_replace(F.regexp_extract(name, r"(\..*)$", 1), r"[0-9a-f]{8,}", "#")
    folders = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.concat(F.lit("folder "), x))
    return F.array_distinct(F.filter(F.concat(folders, F.array(tagged("ending ", ending, F.lit("")), tagged("first ", word(r"^([^_\-.]+)[_\-]"), ext), tagged("last ", word(r"[_\-]([^_\-.]+)$"), ext))), lambda x: x.isNotNull()))


def mine_patterns(judged: DataFrame, least_projects: int = LEAST_PROJECTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(feature, kind, projects, files, share) of the mined patterns among ``judged(project_id, file_path, kind, shown)``.

    A file counts if it is marked (``kind``, but ``kept`` is not marked) or could have been (``shown``: its shape is
    known). ``share`` is the lower end of Wilson's interval at 95 %, so that few files prove little; ``kind`` the
    commonest one, on ties the first by name. Counts are over all files; counts per feature and project come first, so
    that a folder of very many files or projects is no task of its own.
    """
    some = judged.where("file_path is not null and (shown or kind is not null)").select("project_id", F.when(F.col("kind") != "kept", F.col("kind")).alias("kind"), F.explode(path_features(F.col("file_path"))).alias("feature"))
    by_project = some.groupBy("feature", "project_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    marked = lambda c: F.when(F.col("kind").isNotNull(), F.col(c))
    by_kind = by_project.groupBy("feature", "kind").agg(F.sum("n").alias("n"))
    projects = by_project.where("kind is not null").select("feature", "project_id").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("projects"))
    got = by_kind.groupBy("feature").agg(F.sum("n").alias("files"), F.sum(F.coalesce(marked("n"), F.lit(0))).alias("hits"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", F.col("kind")))).getField("kind").alias("kind"))
    n, p, z = F.col("files"), F.col("hits") / F.col("files"), 1.96
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    got = got.join(projects, "feature").withColumn("share", low)
    return got.where((F.col("projects") >= least_projects) & (F.col("share") >= least_share)).select("feature", "kind", "projects", "files", "share")


def judge_files(files: DataFrame, functions: DataFrame, attributes: DataFrame | None = None, conventions: str = CONVENTIONS) -> DataFrame:
    """(file_id, project_id, file_path, kind, shown): what attribute files, conventions and shape say.

    kind is generated, vendored, compressed, data, kept (an attribute file says that it is source) or null; shown is
    whether the shape is known, by some function's code or a size. See :func:`classify_files`.
    """
    longest = F.array_max(F.transform(F.split(F.coalesce("code_snippet", F.lit("")), "\n"), F.length))
    shape = functions.where("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.max(longest).alias("longest"), F.count("code_snippet").alias("n"))
    base = files.select("id", "project_id", "file_path", F.coalesce(F.col("size_bytes").cast("long"), F.lit(0)).alias("size")).join(shape, "id", "left")
    base = base.withColumns({"longest": F.coalesce("longest", F.lit(0)), "shown": (F.coalesce("n", F.lit(0)) > 0) | (F.col("size") >= MOST_BYTES)})
    if attributes is None:
        base = base.withColumn("lines", F.lit(None).cast("array<struct<folder:string,text:string>>"))
    else:
        lines = attributes.where("text is not null").groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("folder", F.lit("")).alias("folder"), "text"))).alias("lines"))
        base = base.join(lines, "project_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, own = Rules([("", conventions)]), lru_cache(maxsize=1000)(lambda key: Rules(list(key)))
        for pdf in batches:
            kinds = []
            for path, size, longest, lines in zip(pdf["file_path"], pdf["size"], pdf["longest"], pdf["lines"], strict=True):
                mine = own(tuple((x["folder"], x["text"]) for x in lines)) if lines is not None else None
                kind = by_path(path, rules, mine) if path else None
                kinds.append(by_shape(size, longest) if kind is None else kind)
            yield pd.DataFrame({"file_id": pdf["id"], "project_id": pdf["project_id"], "file_path": pdf["file_path"], "kind": kinds, "shown": pdf["shown"]})

    return base.select("id", "project_id", "file_path", "size", "longest", "shown", "lines").mapInPandas(run, "file_id long, project_id long, file_path string, kind string, shown boolean")


def classify_files(files: DataFrame, functions: DataFrame, attributes: DataFrame | None = None, conventions: str = CONVENTIONS, least_projects: int = LEAST_PROJECTS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(file_id, project_id, file_path, kind): generated, vendored, compressed, data, or null for hand-written source.

    ``attributes(project_id, folder, text)``: attribute files, where there are any; a project with one is judged by it
    first, line by line, and its unset marks hold against conventions, shape and mined patterns. Null paths have no
    verdict by path, null sizes count as 0; repeated rows stay rows of their own. Each project's attribute lines are
    joined to its files, so that a large project is not gathered in one task; mined patterns are joined by equality.
    """
    judged = cut(judge_files(files, functions, attributes, conventions))
    mined = mine_patterns(judged, least_projects, least_share)
    open_ = judged.where("kind is null and file_path is not null").select("file_id", "file_path").distinct()
    told = open_.select("file_id", "file_path", F.explode(path_features(F.col("file_path"))).alias("feature")).join(mined.select("feature", "share", F.col("kind").alias("mined")), "feature")
    told = told.groupBy("file_id", "file_path").agg(F.max_by("mined", F.struct("share", "feature")).alias("mined"))
    out = judged.join(told, ["file_id", "file_path"], "left")
    return out.select("file_id", "project_id", "file_path", F.when(F.coalesce("kind", F.lit("")) != "kept", F.coalesce("kind", "mined")).alias("kind"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "functions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("kind is not null").select("file_id").distinct()


def p4_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each kind per project."""
    kinds = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("generated", "vendored", "compressed", "data")}
    return _classified(spark, sf_dir).groupBy("project_id").agg(*kinds.values(), F.count_if(F.col("kind").isNull()).alias("hand_written"))
