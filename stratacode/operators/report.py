"""Reports: a project's Markdown, and the file summary that overviews are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import table


def _short(column: str, n: int) -> Column:
    return F.substring(F.coalesce(column, F.lit("")), 1, n)


def file_summary(files: DataFrame, functions: DataFrame, classes: DataFrame, docs: int = 200) -> DataFrame:
    """(file_id, project_id, file_path, functions, classes, doc): names by id and the first ``docs`` characters of the first docstring.

    The docstring is that of the function of smallest id that has one, else that of such a class.
    """
    fn = functions.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("f"), F.min_by("docstring", F.when(F.trim("docstring") != "", F.col("id"))).alias("doc"))
    cl = classes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("c"), F.min_by("docstring", F.when(F.trim("docstring") != "", F.col("id"))).alias("class_doc"))
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["name"]), ", "), F.lit(""))
    base = files.select(F.col("id").alias("file_id"), "project_id", "file_path")
    return base.join(fn, "file_id", "left").join(cl, "file_id", "left").select("file_id", "project_id", "file_path", names("f").alias("functions"), names("c").alias("classes"), F.substring(F.coalesce("doc", "class_doc", F.lit("")), 1, docs).alias("doc"))


REPORT_ORDER = ["project_id", "file_path", "file_id", "kind", "first_line", "item_id", "line"]


def project_report(projects: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """The Markdown of every project as lines: the columns of ``REPORT_ORDER``, to be sorted by them.

    kind -2 and -1 are the project's title and totals (their file is null, which sorts first), 0 a file's heading, 1 its
    classes and 2 its functions by first line. Descriptions are cut to 100 characters and line ends become blanks. Lines
    stay rows, so a project or file of any size is never put together in one task; :func:`write_reports` sorts them.
    """
    lines = F.concat(F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")))
    doc = F.translate(_short("docstring", 100), "\n\r", "  ")
    entry = lambda kind: F.concat(F.lit(f"- {kind} `"), F.coalesce("name", F.lit("?")), F.lit("` (lines "), lines, F.lit(")"), F.when(doc != "", F.concat(F.lit(": "), doc)).otherwise(F.lit("")))
    where = files.select(F.col("id").alias("file_id"), "project_id", "file_path")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

    def rows(df: DataFrame, kind: int, word: str) -> DataFrame:
        return df.join(where, "file_id").select("project_id", "file_path", "file_id", F.lit(kind).alias("kind"), F.coalesce("start_line", F.lit(0)).alias("first_line"), F.col("id").cast("long").alias("item_id"), entry(word).alias("line"))

    body = rows(classes, 1, "class").union(rows(functions, 2, "function"))
    heads = where.select("project_id", "file_path", "file_id", F.lit(0), F.lit(0), zero, F.concat(F.lit("## "), F.coalesce("file_path", F.lit("?"))))
    counted = body.groupBy("project_id").agg(F.count_if(F.col("kind") == 2).alias("functions"), F.count_if(F.col("kind") == 1).alias("classes"))
    n_files = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    top = projects.select(F.col("id").alias("project_id"), "name").join(counted, "project_id", "left").join(n_files, "project_id", "left")
    title = top.select("project_id", F.lit(None).cast("string"), none, F.lit(-2), F.lit(0), zero, F.concat(F.lit("# "), F.coalesce("name", F.lit("?"))))
    total = top.select("project_id", F.lit(None).cast("string"), none, F.lit(-1), F.lit(0), zero, F.concat(F.lit("Files: "), n("files"), F.lit(", functions: "), n("functions"), F.lit(", classes: "), n("classes")))
    return title.toDF(*REPORT_ORDER).union(total).union(heads).union(body).where("project_id is not null")


def write_reports(lines: DataFrame, path: str) -> None:
    """Writes the reports as text, one folder a project; the files' names sort as their parts follow on each other."""
    ordered = lines.repartitionByRange(*REPORT_ORDER).sortWithinPartitions(*REPORT_ORDER)
    gap = F.when(F.col("kind").isin(-1, 0), F.concat(F.lit("\n"), "line")).otherwise(F.col("line"))
    ordered.select("project_id", gap.alias("value")).write.partitionBy("project_id").mode("overwrite").text(path)


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


QUERIES = {
    "file_summary": lambda s, d: file_summary(*_t(s, d, "files", "functions", "classes")),
    "report_markdown": lambda s, d: project_report(*_t(s, d, "projects", "files", "functions", "classes")),
}
_ENTRY = "'- {0} `' || coalesce(name, '?') || '` (lines ' || coalesce(start_line::VARCHAR, '?') || '-' || coalesce(end_line::VARCHAR, '?') || ')' || CASE WHEN left(coalesce(docstring, ''), 100) <> '' THEN ': ' || translate(left(docstring, 100), chr(10) || chr(13), '  ') ELSE '' END"
ORACLE_SQL = {
    "file_summary": """WITH fn AS (SELECT file_id, string_agg(name, ', ' ORDER BY id) AS f, arg_min(docstring, id) FILTER (trim(docstring) <> '') AS doc FROM functions GROUP BY 1), cl AS (SELECT file_id, string_agg(name, ', ' ORDER BY id) AS c, arg_min(docstring, id) FILTER (trim(docstring) <> '') AS doc FROM classes GROUP BY 1)
SELECT fl.id AS file_id, fl.project_id, fl.file_path, coalesce(fn.f, '') AS functions, coalesce(cl.c, '') AS classes, left(coalesce(fn.doc, cl.doc, ''), 200) AS doc FROM files fl LEFT JOIN fn ON fn.file_id = fl.id LEFT JOIN cl ON cl.file_id = fl.id""",
    "report_markdown": f"""WITH b AS (SELECT fl.project_id, fl.file_path, fl.id AS file_id, i.* FROM (
 SELECT file_id AS f, 1 AS kind, coalesce(start_line, 0) AS first_line, id AS item_id, {_ENTRY.format('class')} AS line FROM classes UNION ALL SELECT file_id, 2, coalesce(start_line, 0), id, {_ENTRY.format('function')} FROM functions) i JOIN files fl ON fl.id = i.f),
c AS (SELECT project_id, count(*) FILTER (kind = 2) AS nf, count(*) FILTER (kind = 1) AS nc FROM b GROUP BY 1), n AS (SELECT project_id, count(*) AS n FROM files GROUP BY 1)
SELECT id AS project_id, NULL::VARCHAR AS file_path, NULL::BIGINT AS file_id, -2 AS kind, 0 AS first_line, 0::BIGINT AS item_id, '# ' || coalesce(name, '?') AS line FROM projects
UNION ALL SELECT id, NULL, NULL, -1, 0, 0, 'Files: ' || coalesce(n, 0) || ', functions: ' || coalesce(nf, 0) || ', classes: ' || coalesce(nc, 0) FROM projects LEFT JOIN c ON c.project_id = id LEFT JOIN n ON n.project_id = id
UNION ALL SELECT project_id, file_path, id, 0, 0, 0, '## ' || coalesce(file_path, '?') FROM files WHERE project_id IS NOT NULL
UNION ALL SELECT project_id, file_path, file_id, kind, first_line, item_id, line FROM b WHERE project_id IS NOT NULL""",
}
