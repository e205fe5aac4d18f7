"""Re-deriving stored tables from sources, keeping what was generated for code that stayed the same; and backfills.

All ids are hashes of what names a fact, so a second run over the same sources gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..parse.facts import call_edges, class_facts, extends_edges, fact_id, function_facts, import_edges, parse_files
from ..session import table
from ..sources.source_tree import snippet
from .incremental import cross_project_code, new_relationships, preserve_metadata
from .topology import class_relationships

_SOURCE = ["project_id", "file_path"]


def reparse(sources: DataFrame, old_functions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of ``sources(project_id, file_path, language, file_hash, size_bytes, content)``: files with dependencies,
    functions, classes, function and class relationships.

    ``old_functions`` of the model's form give their ai_purpose to functions of the same place and code, else of equal
    code. Sources given twice are one; those that do not parse have a file and nothing else.
    """
    unique = sources.dropDuplicates(_SOURCE)
    parsed = parse_files(unique, _SOURCE)
    file_id = fact_id(*_SOURCE)
    imports = F.transform("imports", lambda i: F.struct(i["target"].alias("source"), i["line"].alias("line")))
    deps = parsed.select(*_SOURCE, F.struct(imports.alias("imports")).alias("dependencies"))
    files = unique.select(file_id.alias("id"), *_SOURCE, "file_hash", "size_bytes", "language").join(deps, _SOURCE)
    text = unique.select(*_SOURCE, "content", "language")
    fn = function_facts(parsed).dropDuplicates(["id"]).join(text, _SOURCE).withColumn("code_snippet", snippet("content", "start_line", "end_line"))
    fn = fn.select("id", file_id.alias("file_id"), "name", "language", "signature", "start_line", "end_line", "docstring", "return_type", "code_snippet", F.md5("code_snippet").alias("code_hash"))
    if old_functions is None:
        fn = fn.withColumn("ai_purpose", F.lit(None).cast("string"))
    else:
        fn = fn.join(preserve_metadata(old_functions, fn).select("id", F.col("purpose").alias("ai_purpose")), "id", "left")
    cl = class_facts(parsed).dropDuplicates(["id"]).join(text, _SOURCE)
    cl = cl.select("id", file_id.alias("file_id"), "name", "start_line", "end_line", "docstring", snippet("content", "start_line", "end_line").alias("code_snippet"))
    edges = call_edges(parsed).unionByName(import_edges(parsed))
    return {"files": files, "functions": fn, "classes": cl, "function_relationships": edges, "class_relationships": extends_edges(parsed)}


def backfill_dependencies(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``files`` with the dependencies of those that have none refilled from their sources (project_id, file_path, language, content)."""
    imports = F.transform("imports", lambda i: F.struct(i["target"].alias("source"), i["line"].alias("line")))
    got = parse_files(sources.join(files.where("dependencies is null").select(*_SOURCE), _SOURCE, "left_semi").dropDuplicates(_SOURCE), _SOURCE)
    got = got.select(*_SOURCE, F.struct(imports.alias("imports")).alias("_new"))
    return files.join(got, _SOURCE, "left").withColumn("dependencies", F.coalesce("dependencies", "_new")).select(files.columns)


def snippet_gaps(functions: DataFrame, classes: DataFrame, files: DataFrame, projects: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The dry run of a snippet backfill: (project_id, kind, missing, from_source, from_sibling, remaining).

    kind is function or class; a class has no sibling. remaining is never below 0. Projects without a gap have no row.
    """
    place = files.select(F.col("id").alias("file_id"), *_SOURCE)
    known = place.withColumn("here", F.lit(False)) if tree is None else place.join(tree.select(*_SOURCE).distinct().withColumn("here", F.lit(True)), _SOURCE, "left")
    sibling = cross_project_code(functions, files, projects).select("id", F.lit(True).alias("sibling"))
    fn = functions.where("code_snippet is null").select("id", "file_id", F.lit("function").alias("kind")).join(sibling, "id", "left")
    cl = classes.where("code_snippet is null").select("id", "file_id", F.lit("class").alias("kind"), F.lit(None).cast("boolean").alias("sibling"))
    here, other = F.coalesce("here", F.lit(False)), F.coalesce("sibling", F.lit(False))
    gap = fn.unionByName(cl).join(known, "file_id").groupBy("project_id", "kind")
    got = gap.agg(F.count(F.lit(1)).alias("missing"), F.count_if(here).alias("from_source"), F.count_if(~here & other).alias("from_sibling"))
    return got.withColumn("remaining", F.greatest(F.lit(0), F.col("missing") - F.col("from_source") - F.col("from_sibling")))


def fill_class_snippets(classes: DataFrame, files: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, code_snippet) of the classes without code whose file is in ``tree(project_id, file_path, content)``."""
    source = files.select(F.col("id").alias("file_id"), *_SOURCE).join(tree.select(*_SOURCE, "content"), _SOURCE).select("file_id", "content")
    got = classes.where("code_snippet is null").select("id", "file_id", "start_line", "end_line").join(source, "file_id")
    return got.select("id", snippet("content", "start_line", "end_line").alias("code_snippet")).where("code_snippet <> ''")


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _missing_edges(s: SparkSession, d: str) -> DataFrame:
    """Class edges that a store which holds those of even classes lacks."""
    derived = class_relationships(table(s, d, "classes"))
    return new_relationships(derived.where("source_class_id % 2 = 0"), derived)


QUERIES = {
    "snippet_gaps": lambda s, d: snippet_gaps(*_t(s, d, "functions", "classes", "files", "projects")),
    "backfill_new_edges": _missing_edges,
}
_PLAIN = r"trim(regexp_replace(regexp_replace(x.name, '(?s)[<\[].*', ''), '(?s)^.*(\.|::)', ''))"
ORACLE_SQL = {
    "snippet_gaps": """WITH p AS (SELECT f.id, f.name, f.start_line, f.code_snippet, fl.project_id, fl.file_path, pr.repo_url FROM functions f JOIN files fl ON fl.id = f.file_id LEFT JOIN projects pr ON pr.id = fl.project_id),
g AS (SELECT id, project_id, 'function' AS kind, EXISTS (SELECT 1 FROM p b WHERE b.repo_url = p.repo_url AND b.file_path = p.file_path AND b.name = p.name AND b.start_line = p.start_line AND b.project_id <> p.project_id AND b.code_snippet IS NOT NULL) AS sibling FROM p WHERE code_snippet IS NULL
UNION ALL SELECT c.id, fl.project_id, 'class', false FROM classes c JOIN files fl ON fl.id = c.file_id WHERE c.code_snippet IS NULL)
SELECT project_id, kind, count(*) AS missing, 0::BIGINT AS from_source, count(*) FILTER (sibling) AS from_sibling, greatest(0, count(*) - count(*) FILTER (sibling)) AS remaining FROM g GROUP BY 1, 2""",
    "backfill_new_edges": f"""WITH l AS (SELECT id, unnest(base_classes) AS x, 'EXTENDS' AS kind FROM classes UNION ALL SELECT id, unnest(interfaces), 'IMPLEMENTS' FROM classes)
SELECT id AS source_class_id, {_PLAIN} AS target_class_name, kind AS relationship_type, min(x.line) AS context_line FROM l WHERE {_PLAIN} <> '' AND id % 2 <> 0 GROUP BY 1, 2, 3""",
}
