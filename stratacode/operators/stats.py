"""Coverage and statistics over the metadata tables: one pass and one aggregation per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import conform
from ..session import table

MODES = {
    "ai": ("ai_purpose", "ai_purpose"),
    "beginner": ("explanation_simple", "explanation_simple"),
    "expert": ("expert_purpose", "expert_purpose"),
}


def percent(part: str, whole: str) -> Column:
    """Share in per cent with one digit; 0.0 of nothing."""
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole) * 100, 1)).otherwise(F.lit(0.0))


def _per_project(df: DataFrame, files: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates by file before the join, so that only one row a file is shuffled."""
    names = [c for c in df.columns if c != "file_id"]
    by_file = df.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in names])
    return by_file.join(files.select(F.col("id").alias("file_id"), "project_id"), "file_id").groupBy("project_id").agg(*[F.sum(c).alias(c) for c in names])


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(c, F.lit(0)).alias(c) for c in names]


def project_stats(projects: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Per project: files, functions, classes, coverage counts and percentages, overview, last analysis."""
    one = F.lit(1)
    fn = functions.select(
        "file_id",
        one.alias("functions"),
        F.col("code_snippet").isNotNull().cast("int").alias("with_code_snippet"),
        F.col("explanation_simple").isNotNull().cast("int").alias("with_explanation"),
        (F.col("ai_purpose").isNotNull() & (F.col("ai_purpose") != "")).cast("int").alias("with_ai_purpose"),
    )
    counts = _per_project(fn, files)
    cls = _per_project(classes.select("file_id", one.alias("classes")), files)
    n_files = files.groupBy("project_id").agg(F.count(one).alias("files"))
    out = projects.withColumnRenamed("id", "project_id")
    for part in (n_files, counts, cls):
        out = out.join(part, "project_id", "left")
    numbers = ["files", "functions", "classes", "with_code_snippet", "with_explanation", "with_ai_purpose"]
    out = out.select(
        "project_id",
        "name",
        *_zero(*numbers),
        F.col("overview_analysis").isNotNull().alias("has_overview"),
        F.coalesce("updated_at", "created_at").alias("last_analyzed"),
    )
    return out.select("*", *[percent(c, "functions").alias(f"{c}_pct") for c in numbers[3:]])


def totals(projects: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row of grand totals."""
    named = {"projects": projects, "files": files, "functions": functions, "classes": classes, "relationships": relationships}
    rows = None
    for name, df in named.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        rows = one if rows is None else rows.union(one)
    return rows.agg(*[F.max(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in named])


def missing_summary(projects: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame, mode: str | None = None) -> DataFrame:
    """Per project the functions and classes without code or the content of each mode; ``mode`` keeps projects with such a gap."""
    gap = lambda c, n: F.col(c).isNull().cast("int").alias(n)
    fields = {"code": "code_snippet", **{m: c for m, (c, _) in MODES.items()}}
    fn = _per_project(functions.select("file_id", *[gap(c, f"functions_missing_{k}") for k, c in fields.items()]), files)
    cl = _per_project(classes.select("file_id", *[gap(c, f"classes_missing_{k}") for k, c in fields.items()]), files)
    names = [f"{t}_missing_{k}" for t in ("functions", "classes") for k in fields]
    out = projects.select(F.col("id").alias("project_id"), "name", F.coalesce("analysis_mode", F.lit("ai")).alias("analysis_mode")).join(fn, "project_id", "left").join(cl, "project_id", "left")
    out = out.select("project_id", "name", "analysis_mode", *_zero(*names))
    if mode is not None:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        out = out.where(F.greatest(*[F.col(f"{t}_missing_{k}") for t in ("functions", "classes") for k in (mode, "code")]) > 0)
    return out


def relationship_stats(relationships: DataFrame) -> DataFrame:
    """Relationships per type and in all (type null)."""
    return relationships.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n")).unionByName(relationships.agg(F.count(F.lit(1)).alias("n")).withColumn("relationship_type", F.lit(None).cast("string")).select("relationship_type", "n"))


def migration_gaps(projects: DataFrame, files: DataFrame, functions: DataFrame, target_mode: str) -> DataFrame:
    """Per project the functions without the content of ``target_mode`` and whether it needs migrating."""
    column = MODES[target_mode][0]
    gap = _per_project(functions.select("file_id", F.col(column).isNull().cast("int").alias("gap")), files)
    out = projects.select(F.col("id").alias("project_id"), "analysis_mode").join(gap, "project_id", "left").select("project_id", "analysis_mode", *_zero("gap"))
    ready = (F.col("analysis_mode") == target_mode) & (F.col("gap") == 0)
    return out.withColumn("status", F.when(ready, "skipped").otherwise("migrating"))


def backfill_coverage(files: DataFrame, classes: DataFrame) -> DataFrame:
    """How many files have dependencies and how many classes bases, interfaces and patterns."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    parts = [
        files.agg(F.lit("files.dependencies").alias("field"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("dependencies").isNotNull()).alias("with_value")),
        *[classes.agg(F.lit(f"classes.{c}").alias("field"), F.count(F.lit(1)).alias("total"), F.count_if(some(c)).alias("with_value")) for c in ("base_classes", "interfaces", "ai_patterns")],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("pct", percent("with_value", "total"))


def _all(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [conform(table(spark, sf_dir, n), n) for n in names]


_BASE = ("projects", "files", "functions", "classes")
QUERIES = {
    "project_stats": lambda s, d: project_stats(*_all(s, d, *_BASE)),
    "stats_totals": lambda s, d: totals(*_all(s, d, *_BASE, "function_relationships")),
    "missing_summary": lambda s, d: missing_summary(*_all(s, d, *_BASE)),
    "missing_summary_ai": lambda s, d: missing_summary(*_all(s, d, *_BASE), mode="ai"),
    "relationship_stats": lambda s, d: relationship_stats(*_all(s, d, "function_relationships")),
    "migration_gaps": lambda s, d: migration_gaps(*_all(s, d, "projects", "files", "functions"), target_mode="ai"),
    "backfill_coverage": lambda s, d: backfill_coverage(*_all(s, d, "files", "classes")),
}
_GAPS = """fn AS (SELECT fl.project_id, count(*) FILTER (code_snippet IS NULL) AS c, count(*) FILTER (ai_purpose IS NULL) AS a, count(*) AS n FROM functions f JOIN files fl ON fl.id = f.file_id GROUP BY 1),
cl AS (SELECT fl.project_id, count(*) FILTER (code_snippet IS NULL) AS c, count(*) AS n FROM classes f JOIN files fl ON fl.id = f.file_id GROUP BY 1),
g AS (SELECT p.id AS project_id, p.name, coalesce(p.analysis_mode, 'ai') AS analysis_mode,
 coalesce(fn.c, 0) AS functions_missing_code, coalesce(fn.a, 0) AS functions_missing_ai, coalesce(fn.n, 0) AS functions_missing_beginner, coalesce(fn.n, 0) AS functions_missing_expert,
 coalesce(cl.c, 0) AS classes_missing_code, coalesce(cl.n, 0) AS classes_missing_ai, coalesce(cl.n, 0) AS classes_missing_beginner, coalesce(cl.n, 0) AS classes_missing_expert
 FROM projects p LEFT JOIN fn ON fn.project_id = p.id LEFT JOIN cl ON cl.project_id = p.id)"""
ORACLE_SQL = {
    "project_stats": """WITH fl AS (SELECT project_id, count(*) AS n FROM files GROUP BY 1),
fn AS (SELECT x.project_id, count(*) AS n, count(code_snippet) AS c, count(*) FILTER (ai_purpose <> '') AS a FROM functions f JOIN files x ON x.id = f.file_id GROUP BY 1),
cl AS (SELECT x.project_id, count(*) AS n FROM classes f JOIN files x ON x.id = f.file_id GROUP BY 1),
b AS (SELECT p.id AS project_id, p.name, coalesce(fl.n, 0) AS files, coalesce(fn.n, 0) AS functions, coalesce(cl.n, 0) AS classes, coalesce(fn.c, 0) AS with_code_snippet, 0::BIGINT AS with_explanation, coalesce(fn.a, 0) AS with_ai_purpose,
 p.overview_analysis IS NOT NULL AS has_overview, coalesce(p.updated_at, p.created_at) AS last_analyzed
 FROM projects p LEFT JOIN fl ON fl.project_id = p.id LEFT JOIN fn ON fn.project_id = p.id LEFT JOIN cl ON cl.project_id = p.id)
SELECT *, CASE WHEN functions > 0 THEN round(with_code_snippet / functions * 100, 1) ELSE 0.0 END::DOUBLE AS with_code_snippet_pct, 0.0::DOUBLE AS with_explanation_pct,
 CASE WHEN functions > 0 THEN round(with_ai_purpose / functions * 100, 1) ELSE 0.0 END::DOUBLE AS with_ai_purpose_pct FROM b""",
    "stats_totals": "SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM classes) AS classes, (SELECT count(*) FROM function_relationships) AS relationships",
    "missing_summary": f"WITH {_GAPS} SELECT * FROM g",
    "missing_summary_ai": f"WITH {_GAPS} SELECT * FROM g WHERE greatest(functions_missing_ai, functions_missing_code, classes_missing_ai, classes_missing_code) > 0",
    "relationship_stats": "SELECT relationship_type, count(*) AS n FROM function_relationships GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM function_relationships",
    "migration_gaps": """WITH fn AS (SELECT fl.project_id, count(*) FILTER (ai_purpose IS NULL) AS a FROM functions f JOIN files fl ON fl.id = f.file_id GROUP BY 1)
SELECT p.id AS project_id, p.analysis_mode, coalesce(a, 0) AS gap, CASE WHEN p.analysis_mode = 'ai' AND coalesce(a, 0) = 0 THEN 'skipped' ELSE 'migrating' END AS status FROM projects p LEFT JOIN fn ON fn.project_id = p.id""",
    "backfill_coverage": """WITH x AS (SELECT 'files.dependencies' AS field, count(*) AS total, count(dependencies) AS with_value FROM files
UNION ALL SELECT 'classes.base_classes', count(*), count(*) FILTER (len(base_classes) > 0) FROM classes UNION ALL SELECT 'classes.interfaces', count(*), count(*) FILTER (len(interfaces) > 0) FROM classes
UNION ALL SELECT 'classes.ai_patterns', count(*), count(*) FILTER (len(ai_patterns) > 0) FROM classes)
SELECT *, CASE WHEN total > 0 THEN round(with_value / total * 100, 1) ELSE 0.0 END::DOUBLE AS pct FROM x""",
}
