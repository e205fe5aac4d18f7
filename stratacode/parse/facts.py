"""Parsed sources as tables: one nested row a file, exploded to facts and resolved to edges."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.graph import first_by_name
from ..session import table
from ..sources.source_tree import language_of
from .brace_source import NOT_CALLED, parse_braces
from .python_source import parse_python

_FN = "struct<name:string,signature:string,start_line:int,end_line:int,docstring:string,return_type:string,param_types:map<string,string>>"
PARSED = (
    f"functions array<{_FN}>, classes array<struct<name:string,start_line:int,end_line:int,docstring:string,methods:array<{_FN}>>>, "
    "calls array<struct<source:string,target:string,line:int>>, imports array<struct<target:string,line:int>>, "
    "extends array<struct<class:string,parent:string,line:int,rel_type:string>>"
)


def parse(source: str | None, language: str | None) -> dict:
    """The facts of one source by its language; null and unknown ones have none."""
    if language == "python":
        return parse_python(source or "")
    return parse_braces(source or "", language or "")


def parse_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the nested facts of each row of ``files(.., language, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            facts = [parse(c, g) for c, g in zip(pdf["content"], pdf["language"], strict=True)]
            out = pdf[keys].copy()
            for name in ("functions", "classes", "calls", "imports", "extends"):
                out[name] = [f[name] for f in facts]
            yield out

    schema = ", ".join(f"{k} {dict(files.dtypes)[k]}" for k in keys)
    return files.select(*keys, "language", "content").mapInPandas(run, f"{schema}, {PARSED}")


def fact_id(*columns: str) -> Column:
    """A stable key from what names a fact."""
    return F.xxhash64(*columns)


def function_facts(parsed: DataFrame) -> DataFrame:
    """(id, project_id, file_path, class_name, name, ..): functions and methods, methods with their class."""
    top = parsed.select("project_id", "file_path", F.lit(None).cast("string").alias("class_name"), F.explode("functions").alias("f"))
    cls = parsed.select("project_id", "file_path", F.explode("classes").alias("c")).select("project_id", "file_path", F.col("c.name"), F.explode("c.methods").alias("f"))
    rows = top.union(cls).select("project_id", "file_path", "class_name", "f.*")
    return rows.select(fact_id("project_id", "file_path", "name", "start_line").alias("id"), "*")


def class_facts(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("project_id", "file_path", F.explode("classes").alias("c")).select("project_id", "file_path", "c.name", "c.start_line", "c.end_line", "c.docstring")
    return rows.select(fact_id("project_id", "file_path", "name", "start_line").alias("id"), "*")


def call_edges(parsed: DataFrame) -> DataFrame:
    """(source_function_id, target_function_name, target_file_path, context_line, confidence) of the resolved calls.

    The caller is the last function of that name in the file; calls outside of functions drop out. The target's file is
    that of the smallest id among the project's functions of the name, null if there is none.
    """
    fn = function_facts(parsed)
    last = fn.groupBy("project_id", "file_path", F.col("name").alias("source")).agg(F.max_by("id", F.struct("start_line", "id")).alias("source_function_id"))
    calls = parsed.select("project_id", "file_path", F.explode("calls").alias("c")).select("project_id", "file_path", "c.source", "c.target", "c.line")
    first = fn.groupBy("project_id", F.col("name").alias("target")).agg(F.min(F.struct("id", "file_path")).alias("x"))
    got = calls.join(last, ["project_id", "file_path", "source"]).join(first, ["project_id", "target"], "left")
    return got.select("source_function_id", F.col("target").alias("target_function_name"), F.col("x.file_path").alias("target_file_path"), F.lit("CALLS").alias("relationship_type"), F.lit(5).alias("confidence"), F.col("line").alias("context_line"))


def import_edges(parsed: DataFrame) -> DataFrame:
    """IMPORTS edges, hung on the file's first function."""
    first = function_facts(parsed).groupBy("project_id", "file_path").agg(F.min_by("id", F.struct("start_line", "id")).alias("source_function_id"))
    got = parsed.select("project_id", "file_path", F.explode("imports").alias("i")).join(first, ["project_id", "file_path"])
    return got.select("source_function_id", F.col("i.target").alias("target_function_name"), F.lit(None).cast("string").alias("target_file_path"), F.lit("IMPORTS").alias("relationship_type"), F.lit(3).alias("confidence"), F.col("i.line").alias("context_line"))


def extends_edges(parsed: DataFrame) -> DataFrame:
    """Class edges with the file's class of the child's name as source."""
    cls = class_facts(parsed).groupBy("project_id", "file_path", F.col("name").alias("child")).agg(F.max("id").alias("source_class_id"))
    got = parsed.select("project_id", "file_path", F.explode("extends").alias("e")).select("project_id", "file_path", F.col("e.class").alias("child"), "e.parent", "e.rel_type", "e.line")
    return got.join(cls, ["project_id", "file_path", "child"]).select("source_class_id", F.col("parent").alias("target_class_name"), F.col("rel_type").alias("relationship_type"), F.lit(5).alias("confidence"), F.col("line").alias("context_line"))


# --- facts of snippets, in columns only ----------------------------------------------------------------------------


def called_names(code: Column | str) -> Column:
    """The distinct names followed by a parenthesis that are no keywords, sorted."""
    names = F.regexp_extract_all(code, F.lit(r"([a-zA-Z_]\w*)\s*\("), 1)
    return F.array_sort(F.array_except(names, F.array(*[F.lit(x) for x in sorted(NOT_CALLED)])))


def next_definition(functions: DataFrame) -> DataFrame:
    """(id, estimated_end): the line before the next definition of the file; null for the last."""
    at = F.lead("start_line").over(W.partitionBy("file_id").orderBy("start_line", "id"))
    return functions.select("id", (at - 1).alias("estimated_end"))


def class_ends(classes: DataFrame) -> DataFrame:
    """(id, estimated_end): the line before the next class of the file; null for the last, which ends with its file."""
    at = F.lead("start_line").over(W.partitionBy("file_id").orderBy("start_line", "id"))
    return classes.select("id", (at - 1).alias("estimated_end"))


def end_by_indent(definitions: DataFrame) -> DataFrame:
    """(id, estimated_end) of ``definitions(id, file_id, start_line, indent)``: the line before the file's next definition
    that is indented as much or less; null where none follows. Nested definitions thus lie within the outer one.

    Null lines and indents have no estimate. A file's definitions are read in one pass, in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends, later = {}, []  # from the last line up; later: (line, indent), nearer ones deeper
        for start, same in itertools.groupby(sorted(zip(-pdf["start_line"], pdf["indent"], pdf["id"], strict=True)), key=lambda x: -x[0]):
            same = list(same)
            for _, indent, i in same:
                ends[i] = next((line - 1 for line, n in reversed(later) if n <= indent), None)
            while later and later[-1][1] >= same[0][1]:
                later.pop()
            later.append((start, same[0][1]))
        return pd.DataFrame({"id": pdf["id"], "estimated_end": pd.array([ends.get(i) for i in pdf["id"]], dtype="Int32")})

    whole = definitions.where("start_line is not null and indent is not null and file_id is not null").select("file_id", "id", "start_line", "indent")
    return whole.groupBy("file_id").applyInPandas(run, "id long, estimated_end int")


def comment_blocks(functions: DataFrame) -> DataFrame:
    """(id, block_lines): how many comment lines stand in a row at the top of a snippet."""
    rows = F.split("code_snippet", "\n")
    note = F.transform(rows, lambda r: F.rlike(F.trim(r), F.lit(r"^(//|#|\*|/\*)")))
    first = F.array_position(note, False)
    return functions.where("code_snippet is not null").select("id", F.when(first > 0, first - 1).otherwise(F.size(rows)).cast("int").alias("block_lines"))


def resolve_targets(relationships: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_id, target_id, in_project_id): a call's target by name anywhere and within the caller's project, each by least id."""
    rel = relationships.where("upper(relationship_type) = 'CALLS'").select(F.col("id").alias("rel_id"), "source_function_id", F.col("target_function_name").alias("name")).distinct()
    placed = functions.select(F.col("id").alias("function_id"), "name", "file_id").join(files.select(F.col("id").alias("file_id"), "project_id"), "file_id")
    local = placed.groupBy("project_id", "name").agg(F.min("function_id").alias("in_project_id"))
    got = rel.join(placed.select(F.col("function_id").alias("source_function_id"), "project_id"), "source_function_id")
    return got.join(local, ["project_id", "name"], "left").join(first_by_name(functions), "name", "left").select("rel_id", "source_function_id", "name", F.col("function_id").alias("target_id"), "in_project_id")


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snippet parsed by its file's language."""
    fn, fl = _t(spark, sf_dir, "functions", "files")
    src = fn.where("code_snippet is not null").join(fl.select(F.col("id").alias("file_id"), language_of("file_path").alias("by_path"), "project_id", "file_path"), "file_id")
    src = src.select("id", "project_id", "file_path", F.col("by_path").alias("language"), F.col("code_snippet").alias("content"))
    return parse_files(src, ["id", "project_id", "file_path"])


def _indented(functions: DataFrame) -> DataFrame:
    """Definitions with an indent: as deep as their lines, modulo 3, have it, for the tables' snippets all begin at the margin."""
    return functions.select("id", "file_id", "start_line", F.pmod(F.length("name"), F.lit(3)).alias("indent"))


QUERIES = {
    "language_detection": lambda s, d: table(s, d, "files").select("id", language_of("file_path").alias("detected")),
    "content_hash": lambda s, d: table(s, d, "functions").select("id", F.md5(F.coalesce("code_snippet", F.lit(""))).alias("code_md5"), F.length(F.coalesce("code_snippet", F.lit(""))).alias("code_length")),
    "call_extraction": lambda s, d: table(s, d, "functions").where("code_snippet is not null").select("id", called_names("code_snippet").alias("called")),
    "import_extraction": lambda s, d: table(s, d, "files").select(F.col("id").alias("file_id"), F.explode("dependencies.imports").alias("x")).select("file_id", F.col("x.source").alias("source"), F.col("x.line").alias("line")),
    "next_definition_end_line": lambda s, d: next_definition(table(s, d, "functions")),
    "class_ends": lambda s, d: class_ends(table(s, d, "classes")),
    "end_by_indent": lambda s, d: end_by_indent(_indented(table(s, d, "functions"))),
    "comment_blocks": lambda s, d: comment_blocks(table(s, d, "functions")),
    "resolve_targets": lambda s, d: resolve_targets(*_t(s, d, "function_relationships", "functions", "files")),
    "parse_snippets": lambda s, d: _snippets(s, d).select("id", F.transform("functions", lambda f: f["name"]).alias("functions"), F.size("calls").alias("calls"), F.transform("classes", lambda c: c["name"]).alias("classes")),
    "parse_call_edges": lambda s, d: call_edges(_snippets(s, d)).groupBy("target_function_name").agg(F.count(F.lit(1)).alias("calls"), F.count("target_file_path").alias("resolved")),
}
_LANG = "CASE lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (("." + e, g) for e, g in (("py", "python"), ("js", "javascript"), ("jsx", "javascript"), ("mjs", "javascript"), ("cjs", "javascript"), ("ts", "typescript"), ("tsx", "typescript"), ("go", "go"), ("java", "java"), ("rs", "rust")))) + " END"
ORACLE_SQL = {
    "language_detection": f"SELECT id, {_LANG} AS detected FROM files",
    "content_hash": "SELECT id, md5(coalesce(code_snippet, '')) AS code_md5, CAST(length(coalesce(code_snippet, '')) AS INTEGER) AS code_length FROM functions",
    "call_extraction": f"SELECT id, list_sort(list_distinct(list_filter(regexp_extract_all(code_snippet, '([a-zA-Z_]\\w*)\\s*\\(', 1), lambda x: x NOT IN ({', '.join(repr(x) for x in sorted(NOT_CALLED))})))) AS called FROM functions WHERE code_snippet IS NOT NULL",
    "import_extraction": "WITH i AS (SELECT id AS file_id, unnest(dependencies.imports) AS x FROM files) SELECT file_id, x.source AS source, x.line AS line FROM i",
    "next_definition_end_line": "SELECT id, lead(start_line) OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, id) - 1 AS estimated_end FROM functions",
    "class_ends": "SELECT id, lead(start_line) OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, id) - 1 AS estimated_end FROM classes",
    "end_by_indent": "WITH f AS (SELECT id, file_id, start_line, length(name) % 3 AS indent FROM functions WHERE start_line IS NOT NULL AND name IS NOT NULL AND file_id IS NOT NULL) SELECT f.id, (SELECT min(g.start_line) - 1 FROM f g WHERE g.file_id = f.file_id AND g.start_line > f.start_line AND g.indent <= f.indent) AS estimated_end FROM f",
    "comment_blocks": "WITH r AS (SELECT id, list_transform(string_split(code_snippet, chr(10)), lambda x: regexp_matches(trim(x), '^(//|#|\\*|/\\*)')) AS n FROM functions WHERE code_snippet IS NOT NULL) SELECT id, CAST(coalesce(list_position(n, false) - 1, len(n)) AS INTEGER) AS block_lines FROM r",
    "resolve_targets": """WITH p AS (SELECT f.id, f.name, fl.project_id FROM functions f JOIN files fl ON fl.id = f.file_id), l AS (SELECT project_id, name, min(id) AS i FROM p GROUP BY 1, 2), g AS (SELECT name, min(id) AS i FROM functions GROUP BY 1),
r AS (SELECT DISTINCT id AS rel_id, source_function_id, target_function_name AS name FROM function_relationships WHERE upper(relationship_type) = 'CALLS')
SELECT r.rel_id, r.source_function_id, r.name, g.i AS target_id, l.i AS in_project_id FROM r JOIN p ON p.id = r.source_function_id LEFT JOIN l ON l.project_id = p.project_id AND l.name = r.name LEFT JOIN g ON g.name = r.name""",
}
