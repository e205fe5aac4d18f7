"""Incremental runs: manifests, caches by content, preserved metadata, tasks and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import table

UNFINISHED = ("pending", "running", "failed")


def remaining(counts: DataFrame, total: str, done: str) -> DataFrame:
    """``counts`` with what is left to do, never below 0; nulls count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return counts.withColumn("remaining", F.greatest(F.lit(0), zero(total) - zero(done)))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, file_path, state) of two manifests (project_id, file_path, file_hash): new, changed, same or deleted.

    A null hash equals only a null hash. Paths given twice count by their greatest hash.
    """
    key = ["project_id", "file_path"]
    a = old.groupBy(*key).agg(F.max("file_hash").alias("a"), F.lit(True).alias("was"))
    b = new.groupBy(*key).agg(F.max("file_hash").alias("b"), F.lit(True).alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))


def pending_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files that are not processed yet with the same content: an anti-join on project, path and hash."""
    return files.join(processed.select("project_id", "file_path", "file_hash").distinct(), ["project_id", "file_path", "file_hash"], "left_anti")


def processed_paths(saved: DataFrame, stored: DataFrame) -> DataFrame:
    """The union of a checkpoint's paths and the stored ones, (project_id, file_path), distinct."""
    return saved.select("project_id", "file_path").union(stored.select("project_id", "file_path")).distinct()


def cached_metadata(functions: DataFrame) -> DataFrame:
    """(id, cached_purpose, cached_from): for a function without purpose, that of the smallest id with equal code that has one."""
    have = functions.where("code_hash is not null and ai_purpose is not null").groupBy("code_hash").agg(F.min(F.struct("id", "ai_purpose")).alias("x"))
    need = functions.where("code_hash is not null and ai_purpose is null").select("id", "code_hash")
    return need.join(have, "code_hash").select("id", F.col("x.ai_purpose").alias("cached_purpose"), F.col("x.id").alias("cached_from"))


def preserve_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, purpose, how) of re-parsed functions (id, file_id, name, start_line, code_hash): that of the same place and code, else of any equal code."""
    place = ["file_id", "name", "start_line", "code_hash"]
    exact = old.where("ai_purpose is not null").groupBy(*place).agg(F.min(F.struct("id", "ai_purpose")).alias("e"))
    any_ = old.where("ai_purpose is not null and code_hash is not null").groupBy("code_hash").agg(F.min(F.struct("id", "ai_purpose")).alias("h"))
    got = new.select("id", *place).join(exact, place, "left").join(any_, "code_hash", "left")
    how = F.when(F.col("e").isNotNull(), "same place").when(F.col("h").isNotNull(), "same code").otherwise("none")
    return got.select("id", F.coalesce("e.ai_purpose", "h.ai_purpose").alias("purpose"), how.alias("how"))


def cross_project_code(functions: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, donor_id): for a function without code, the same function in a project of the same repository.

    Equal repository, path, name and first line; of several donors the one of the smallest project id, then id.
    """
    url = F.col("repo_url")
    placed = functions.select("id", "file_id", "name", "start_line", F.col("code_snippet").isNotNull().alias("full"))
    placed = placed.join(files.select(F.col("id").alias("file_id"), "project_id", "file_path"), "file_id").join(projects.select(F.col("id").alias("project_id"), url).where(url.isNotNull()), "project_id")
    key = ["repo_url", "file_path", "name", "start_line"]
    donors = placed.where("full").select(*key, F.col("project_id").alias("donor_project"), F.col("id").alias("donor_id"))
    return placed.where("not full").join(donors, key).where("project_id <> donor_project").groupBy("id").agg(F.min(F.struct("donor_project", "donor_id")).alias("x")).select("id", F.col("x.donor_id").alias("donor_id"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the non-null values of ``new`` over it and the rows that are only in ``new``; ready to be written as a new version."""
    names = [c for c in old.columns if c != key]
    b = new.select(key, *[F.col(c).alias(f"_{c}") for c in names if c in new.columns])
    return old.join(b, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in names])


def delete_projects(gone: DataFrame, projects: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame, relationships: DataFrame) -> dict[str, DataFrame]:
    """The tables without the projects of ``gone(id)`` and all that hangs on them; edges into deleted files keep a null file."""
    out = {"projects": projects.join(gone, "id", "left_anti")}
    lost = files.join(gone.withColumnRenamed("id", "project_id"), "project_id", "left_semi").select(F.col("id").alias("file_id"))
    out["files"] = files.join(gone.withColumnRenamed("id", "project_id"), "project_id", "left_anti")
    out["functions"], out["classes"] = functions.join(lost, "file_id", "left_anti"), classes.join(lost, "file_id", "left_anti")
    gone_fn = functions.join(lost, "file_id", "left_semi").select(F.col("id").alias("source_function_id"))
    rel = relationships.join(gone_fn, "source_function_id", "left_anti")
    dead = lost.select(F.col("file_id").alias("target_file_id")).withColumn("dead", F.lit(True))
    out["function_relationships"] = rel.join(dead, "target_file_id", "left").withColumn("target_file_id", F.when(F.col("dead").isNull(), F.col("target_file_id"))).drop("dead").select(relationships.columns)
    return out


def new_relationships(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived edges that are not stored yet: an anti-join on source, target and type."""
    key = ["source_class_id", "target_class_name", "relationship_type"]
    return derived.join(stored.select(*key).distinct(), key, "left_anti")


def task_view(events: DataFrame) -> DataFrame:
    """A task table from an event stream: one task per event, its project the user, its state from the kind of event."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "running", "failed", "completed")]), (F.pmod(F.length("event_type"), F.lit(4)) + 1).cast("int"))
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("value"))


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """The task of the greatest id of each project."""
    return tasks.withColumn("place", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("id")))).where("place = 1").drop("place")


def unfinished_tasks(tasks: DataFrame) -> DataFrame:
    """Pending, running and failed tasks, the newest first, on ties by id."""
    return tasks.where(F.col("status").isin(*UNFINISHED)).orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def resumable_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that may be taken up again: failed or pending ones."""
    return tasks.where(F.col("status").isin("failed", "pending"))


def checkpoint(tasks: DataFrame, saved: DataFrame) -> DataFrame:
    """``tasks`` with the state saved for them: ``saved(id, processed_files, last_processed_file, total_files)``; completed tasks lose theirs."""
    out = upsert(tasks, saved.join(tasks.select("id"), "id", "left_semi"))
    done = F.col("status") == "completed"
    clear = {c: F.when(done, None).otherwise(F.col(c)) for c in ("processed_files", "last_processed_file") if c in tasks.columns}
    return out.withColumns(clear)


def set_mode(projects: DataFrame, chosen: DataFrame, mode: str) -> DataFrame:
    """``projects`` with the analysis mode of those in ``chosen(id)`` set."""
    if mode not in ("ai", "beginner", "expert"):
        raise ValueError("mode must be ai, beginner or expert")
    mark = chosen.select("id").distinct().withColumn("_set", F.lit(True))
    return projects.join(mark, "id", "left").withColumn("analysis_mode", F.when(F.col("_set"), mode).otherwise(F.col("analysis_mode"))).drop("_set").select(projects.columns)


def progress_percent(step: str, index: str, total: str) -> Column:
    """Progress of a step: 10 clone, 30 to 90 while parsing, 85 overview, 90 report, 100 completed."""
    share = F.when(F.col(total) > 0, F.col(index) / F.col(total)).otherwise(F.lit(0.0))
    steps = {"clone": F.lit(10), "parse": F.least(F.lit(90), F.floor(30 + share * 60)), "overview": F.lit(85), "report": F.lit(90), "completed": F.lit(100)}
    out = F.lit(0)
    for name, value in steps.items():
        out = F.when(F.col(step) == name, value).otherwise(out)
    return out.cast("int")


def public_status(state: str) -> Column:
    """A worker's state as the interface shows it."""
    names = {"PENDING": "pending", "STARTED": "running", "PROGRESS": "running", "RETRY": "running", "SUCCESS": "completed", "FAILURE": "failed", "REVOKED": "failed"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.upper(state)), F.lit("unknown"))


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new manifest of the files: the old lacks those of odd days, the new has another hash on Mondays and lacks those of Sundays."""
    f = table(spark, sf_dir, "files").select("project_id", "file_path", "file_hash", "created_at")
    day = F.dayofweek("created_at")
    old = f.where(F.dayofmonth("created_at") % 2 == 0)
    new = f.where(day != 1).withColumn("file_hash", F.when(day == 2, F.md5(F.coalesce("file_hash", F.lit("")))).otherwise(F.col("file_hash")))
    return old, new


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each table when the projects of one language are deleted."""
    tables = _t(spark, sf_dir, "projects", "files", "functions", "classes", "function_relationships")
    left = delete_projects(tables[0].where("language = 'go'").select("id"), *tables)
    out = None
    for name, df in left.items():
        extra = F.count("target_file_id") if name == "function_relationships" else F.lit(0).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("n"), extra.alias("with_file")).select(F.lit(name).alias("table_name"), "n", "with_file")
        out = row if out is None else out.union(row)
    return out


_STEPS, _STATES = ("clone", "parse", "overview", "report", "completed"), ("PENDING", "started", "PROGRESS", "RETRY", "SUCCESS", "FAILURE", "odd")


def _checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of the events after a checkpoint of every second one."""
    tasks = task_view(table(spark, sf_dir, "events")).select("id", "status", F.lit(None).cast("array<string>").alias("processed_files"), F.lit(None).cast("string").alias("last_processed_file"), F.lit(9).alias("total_files"))
    saved = tasks.where("id % 2 = 0").select("id", F.array(F.concat(F.lit("a"), F.col("id")), F.lit("b")).alias("processed_files"), F.lit("b").alias("last_processed_file"), F.lit(7).alias("total_files"))
    return checkpoint(tasks, saved).select("id", "status", F.array_join("processed_files", ",").alias("files"), "last_processed_file", "total_files")


QUERIES = {
    "incremental_manifest": lambda s, d: manifest_diff(*_halves(s, d)),
    "pending_files": lambda s, d: pending_files(_halves(s, d)[1], _halves(s, d)[0]).select("project_id", "file_path"),
    "processed_paths": lambda s, d: processed_paths(*_halves(s, d)),
    "upsert_purposes": lambda s, d: upsert(table(s, d, "functions").where("id % 3 <> 0").select("id", "name", "ai_purpose"), table(s, d, "functions").where("id % 2 = 0").select("id", F.upper("ai_purpose").alias("ai_purpose"))),
    "set_mode": lambda s, d: set_mode(table(s, d, "projects"), table(s, d, "projects").where("language = 'python'").select("id"), "expert").select("id", "analysis_mode"),
    "task_progress": lambda s, d: table(s, d, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in _STEPS]), F.pmod("event_id", F.lit(5)).cast("int") + 1).alias("step"), F.pmod("event_id", F.lit(23)).alias("at"), F.lit(20).alias("total")).select("event_id", progress_percent("step", "at", "total").alias("percent")),
    "public_status": lambda s, d: table(s, d, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in _STATES]), F.pmod("event_id", F.lit(7)).cast("int") + 1).alias("state")).select("event_id", public_status("state").alias("status")),
    "task_checkpoint": _checkpointed,
    "remaining_files": lambda s, d: remaining(table(s, d, "files").groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), (F.count_if(F.col("language").isNull()) * 40).alias("done")), "total", "done").select("project_id", "total", "done", "remaining"),
    "content_hash_cache": lambda s, d: cached_metadata(*_t(s, d, "functions")),
    "metadata_preserve": lambda s, d: preserve_metadata(table(s, d, "functions").where("llm_processed"), *_t(s, d, "functions")),
    "cross_project_fill": lambda s, d: cross_project_code(*_t(s, d, "functions", "files", "projects")),
    "cascade_delete": _deleted,
    "latest_task_per_project": lambda s, d: latest_tasks(task_view(table(s, d, "events"))),
    "unfinished_tasks": lambda s, d: unfinished_tasks(task_view(table(s, d, "events"))),
}
_TASK = "t AS (SELECT event_id AS id, user_id AS project_id, ['pending', 'running', 'failed', 'completed'][length(event_type) % 4 + 1] AS status, ts AS created_at, value FROM events)"
ORACLE_SQL = {
    "incremental_manifest": """WITH o AS (SELECT project_id, file_path, max(file_hash) AS a FROM files WHERE day(created_at) % 2 = 0 GROUP BY 1, 2),
n AS (SELECT project_id, file_path, max(CASE WHEN dayofweek(created_at) = 1 THEN md5(coalesce(file_hash, '')) ELSE file_hash END) AS b FROM files WHERE dayofweek(created_at) <> 0 GROUP BY 1, 2)
SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN a IS NOT DISTINCT FROM b THEN 'same' ELSE 'changed' END AS state
FROM o FULL JOIN n ON o.project_id = n.project_id AND o.file_path = n.file_path""",
    "pending_files": """SELECT n.project_id, n.file_path FROM (SELECT project_id, file_path, CASE WHEN dayofweek(created_at) = 1 THEN md5(coalesce(file_hash, '')) ELSE file_hash END AS h FROM files WHERE dayofweek(created_at) <> 0) n
WHERE NOT EXISTS (SELECT 1 FROM files o WHERE day(o.created_at) % 2 = 0 AND o.project_id = n.project_id AND o.file_path = n.file_path AND o.file_hash = n.h)""",
    "processed_paths": "SELECT project_id, file_path FROM files WHERE day(created_at) % 2 = 0 UNION SELECT project_id, file_path FROM files WHERE dayofweek(created_at) <> 0",
    "upsert_purposes": "WITH o AS (SELECT id, name, ai_purpose FROM functions WHERE id % 3 <> 0), n AS (SELECT id, upper(ai_purpose) AS p FROM functions WHERE id % 2 = 0) SELECT coalesce(o.id, n.id) AS id, o.name, coalesce(n.p, o.ai_purpose) AS ai_purpose FROM o FULL JOIN n ON n.id = o.id",
    "set_mode": "SELECT id, CASE WHEN language = 'python' THEN 'expert' ELSE analysis_mode END AS analysis_mode FROM projects",
    "task_progress": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN least(90, floor(30 + (event_id % 23) / 20 * 60)) WHEN 2 THEN 85 WHEN 3 THEN 90 ELSE 100 END::INTEGER AS percent FROM events",
    "public_status": "SELECT event_id, ['pending', 'running', 'running', 'running', 'completed', 'failed', 'unknown'][event_id % 7 + 1] AS status FROM events",
    "task_checkpoint": "WITH t AS (SELECT event_id AS id, ['pending', 'running', 'failed', 'completed'][length(event_type) % 4 + 1] AS status FROM events) SELECT id, status, CASE WHEN id % 2 = 0 AND status <> 'completed' THEN 'a' || id || ',b' END AS files, CASE WHEN id % 2 = 0 AND status <> 'completed' THEN 'b' END AS last_processed_file, CASE WHEN id % 2 = 0 THEN 7 ELSE 9 END::INTEGER AS total_files FROM t",
    "remaining_files": "WITH c AS (SELECT project_id, count(*) AS total, count(*) FILTER (language IS NULL) * 40 AS done FROM files GROUP BY 1) SELECT *, greatest(0, total - done) AS remaining FROM c",
    "content_hash_cache": "WITH h AS (SELECT code_hash, arg_min(ai_purpose, id) AS p, min(id) AS i FROM functions WHERE code_hash IS NOT NULL AND ai_purpose IS NOT NULL GROUP BY 1) SELECT f.id, h.p AS cached_purpose, h.i AS cached_from FROM functions f JOIN h USING (code_hash) WHERE f.ai_purpose IS NULL",
    "metadata_preserve": """WITH o AS (SELECT * FROM functions WHERE llm_processed AND ai_purpose IS NOT NULL), e AS (SELECT file_id, name, start_line, code_hash, arg_min(ai_purpose, id) AS p FROM o WHERE file_id IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL AND code_hash IS NOT NULL GROUP BY 1, 2, 3, 4),
h AS (SELECT code_hash, arg_min(ai_purpose, id) AS p FROM o WHERE code_hash IS NOT NULL GROUP BY 1)
SELECT f.id, coalesce(e.p, h.p) AS purpose, CASE WHEN e.p IS NOT NULL THEN 'same place' WHEN h.p IS NOT NULL THEN 'same code' ELSE 'none' END AS how FROM functions f
LEFT JOIN e ON e.file_id = f.file_id AND e.name = f.name AND e.start_line = f.start_line AND e.code_hash = f.code_hash LEFT JOIN h ON h.code_hash = f.code_hash""",
    "cross_project_fill": """WITH p AS (SELECT f.id, f.name, f.start_line, f.code_snippet, fl.project_id, fl.file_path, pr.repo_url FROM functions f JOIN files fl ON fl.id = f.file_id JOIN projects pr ON pr.id = fl.project_id WHERE pr.repo_url IS NOT NULL)
SELECT a.id, arg_min(b.id, (b.project_id, b.id)) AS donor_id FROM p a JOIN p b ON a.repo_url = b.repo_url AND a.file_path = b.file_path AND a.name = b.name AND a.start_line = b.start_line AND a.project_id <> b.project_id WHERE a.code_snippet IS NULL AND b.code_snippet IS NOT NULL GROUP BY 1""",
    "cascade_delete": """WITH g AS (SELECT id FROM projects WHERE language = 'go'), lf AS (SELECT id FROM files WHERE project_id IN (SELECT id FROM g)), lfn AS (SELECT id FROM functions WHERE file_id IN (SELECT id FROM lf))
SELECT 'projects' AS table_name, count(*) AS n, 0::BIGINT AS with_file FROM projects WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'files', count(*), 0 FROM files WHERE id NOT IN (SELECT id FROM lf) UNION ALL SELECT 'functions', count(*), 0 FROM functions WHERE id NOT IN (SELECT id FROM lfn)
UNION ALL SELECT 'classes', count(*), 0 FROM classes WHERE file_id NOT IN (SELECT id FROM lf)
UNION ALL SELECT 'function_relationships', count(*), count(*) FILTER (target_file_id IS NOT NULL AND target_file_id NOT IN (SELECT id FROM lf)) FROM function_relationships WHERE source_function_id NOT IN (SELECT id FROM lfn)""",
    "latest_task_per_project": f"WITH {_TASK} SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) = 1",
    "unfinished_tasks": f"WITH {_TASK} SELECT * FROM t WHERE status IN ('pending', 'running', 'failed')",
}
