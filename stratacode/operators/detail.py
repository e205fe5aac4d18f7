"""Lists and details: pages of tables, rows by key, and nested views of files, functions and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import conform
from ..session import table
from .graph import relationship_counts
from .topology import class_methods


def page(df: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows in the order of their ids, ``limit`` of them after the first ``skip``."""
    return df.orderBy("id").offset(skip).limit(limit)


def by_key(df: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` is among those of ``keys``."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def function_by_name(functions: DataFrame, files: DataFrame, name: str, project_id: int | None = None) -> DataFrame:
    """The function of smallest id with a name, anywhere or in one project; no row if there is none."""
    fl = files if project_id is None else files.where(F.col("project_id") == project_id)
    return functions.where(F.col("name") == name).join(fl.select(F.col("id").alias("file_id"), "file_path", "project_id"), "file_id").orderBy("id").limit(1)


def function_detail(functions: DataFrame, files: DataFrame, projects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Every function with its file, project, lines as text and counts of callers and callees."""
    fl = files.select(F.col("id").alias("file_id"), "file_path", "project_id")
    pr = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    base = functions.join(fl, "file_id").join(pr, "project_id").withColumn("lines", F.concat(line("start_line"), F.lit("-"), line("end_line")))
    counts = relationship_counts(functions, relationships).withColumnRenamed("function_id", "id")
    return base.join(counts, "id")


def file_detail(files: DataFrame, functions: DataFrame, relationships: DataFrame) -> DataFrame:
    """(file_id, project_id, file_path, function_id, name, start_line, callers, callees): a row a function, ordered by line within its file.

    A file without functions has one row with nulls. Rows are not nested, so that a file of any size stays distributed.
    """
    counts = relationship_counts(functions, relationships)
    fn = functions.select("file_id", F.col("id").alias("function_id"), "name", "start_line").join(counts, "function_id")
    return files.select(F.col("id").alias("file_id"), "project_id", "file_path").join(fn, "file_id", "left")


def class_detail(classes: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """(class_id, class_name, language, method_id, method_name): the methods of every class; the language is the file's."""
    fl = files.select(F.col("id").alias("file_id"), "language")
    cl = classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "file_id").join(fl, "file_id", "left")
    methods = class_methods(classes, functions).join(functions.select(F.col("id").alias("function_id"), F.col("name").alias("method_name")), "function_id")
    return cl.join(methods, "class_id", "left").select("class_id", "class_name", "language", F.col("function_id").alias("method_id"), "method_name")


def project_languages(files: DataFrame) -> DataFrame:
    """(project_id, language, files, bytes): a missing language is a group of its own."""
    return files.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [conform(table(spark, sf_dir, n), n) for n in names]


QUERIES = {
    "list_projects": lambda s, d: page(*_t(s, d, "projects"), skip=20, limit=100).select("id", "name", "analysis_mode"),
    "function_detail": lambda s, d: function_detail(*_t(s, d, "functions", "files", "projects", "function_relationships")).select("id", "name", "project_name", "file_path", "lines", "callers", "callees"),
    "file_detail": lambda s, d: file_detail(*_t(s, d, "files", "functions", "function_relationships")),
    "class_detail": lambda s, d: class_detail(*_t(s, d, "classes", "files", "functions")),
    "project_languages": lambda s, d: project_languages(*_t(s, d, "files")),
    "function_by_name": lambda s, d: function_by_name(*_t(s, d, "functions", "files"), name="toString").select("id", "name", "file_path"),
}
_COUNTS = """e AS (SELECT source_function_id AS source, target_function_name AS target FROM function_relationships WHERE relationship_type = 'CALLS'), a AS (SELECT target, count(*) AS n FROM e GROUP BY 1), b AS (SELECT source, count(*) AS n FROM e GROUP BY 1),
k AS (SELECT f.id, coalesce(a.n, 0) AS callers, coalesce(b.n, 0) AS callees FROM functions f LEFT JOIN a ON a.target = f.name LEFT JOIN b ON b.source = f.id)"""
ORACLE_SQL = {
    "list_projects": "SELECT id, name, analysis_mode FROM projects ORDER BY id LIMIT 100 OFFSET 20",
    "function_detail": f"WITH {_COUNTS} SELECT f.id, f.name, p.name AS project_name, fl.file_path, coalesce(f.start_line::VARCHAR, 'None') || '-' || coalesce(f.end_line::VARCHAR, 'None') AS lines, callers, callees FROM functions f JOIN files fl ON fl.id = f.file_id JOIN projects p ON p.id = fl.project_id JOIN k ON k.id = f.id",
    "file_detail": f"WITH {_COUNTS} SELECT fl.id AS file_id, fl.project_id, fl.file_path, f.id AS function_id, f.name, f.start_line, k.callers, k.callees FROM files fl LEFT JOIN functions f ON f.file_id = fl.id LEFT JOIN k ON k.id = f.id",
    "class_detail": """WITH m AS (SELECT c.id AS class_id, f.id AS function_id, f.name, starts_with(f.name, c.name || '.') AS by_name, f.start_line >= c.start_line AND f.end_line <= c.end_line AS inside FROM classes c JOIN functions f ON f.file_id = c.file_id),
x AS (SELECT * FROM m WHERE by_name OR (inside AND class_id NOT IN (SELECT class_id FROM m WHERE by_name)))
SELECT c.id AS class_id, c.name AS class_name, fl.language, x.function_id AS method_id, x.name AS method_name FROM classes c LEFT JOIN files fl ON fl.id = c.file_id LEFT JOIN x ON x.class_id = c.id""",
    "project_languages": "SELECT project_id, language, count(*) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM files GROUP BY 1, 2",
    "function_by_name": "SELECT f.id, f.name, fl.file_path FROM functions f JOIN files fl ON fl.id = f.file_id WHERE f.name = 'toString' ORDER BY f.id LIMIT 1",
}
