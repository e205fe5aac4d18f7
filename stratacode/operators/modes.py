"""Content in three modes: short structured replies, explanations for beginners and notes for experts.

A mode is a set of columns that one reply fills. Filling asks for the functions that lack the mode's first column,
regenerating for all; migrating fills the gaps of projects and then sets their mode. Equal code is asked for once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import conform
from ..session import table
from .enrich import Provider, ask, json_object, normalise_patterns, normalise_reply
from .incremental import set_mode, upsert
from .stats import migration_gaps

#: The columns of each mode by the names in its replies.
COLUMNS = {
    "ai": {"purpose": "ai_purpose"},
    "beginner": {"simple": "explanation_simple", "logic": "explanation_logic"},
    "expert": {"purpose": "expert_purpose", "tech_details": "expert_tech_details", "error_handling": "expert_error_handling", "concurrency": "expert_concurrency", "tradeoffs": "expert_tradeoffs"},
}
LEAST_CODE = 10


class OfflineWriter:
    """A stand-in for a model: replies made of an item's name, some of them without JSON."""

    def __init__(self, mode: str) -> None:
        self.mode = mode

    def reply(self, items: list[dict]) -> list[str]:
        out = []
        for x in items:
            name = x.get("name") or "it"
            if self.mode == "beginner" and "_" in name:
                out.append(f"explains {name}\nstep one\nstep two")
            elif self.mode == "patterns":
                out.append(json.dumps([{"pattern": "Holder", "confidence": "HIGH", "evidence": name}] if "class" in (x.get("code") or "") else []))
            else:
                out.append("Here: " + json.dumps({k: f"{k} of {name}" for k in COLUMNS[self.mode]}))
        return out


def reply_columns(text: Column | str, mode: str) -> dict[str, Column]:
    """The columns of a reply. Without JSON a beginner's reply is its first line and the rest, others are blank."""
    text = F.col(text) if isinstance(text, str) else text
    if mode == "ai":
        return {"ai_purpose": normalise_reply(text)["purpose"]}
    r = F.from_json(json_object(text), ", ".join(f"{k} string" for k in COLUMNS[mode]))
    plain = json_object(text).isNull()
    lines = F.split(text, "\n")
    rest = {"simple": F.element_at(lines, 1), "logic": F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")}
    return {c: F.coalesce(F.when(plain, rest[k]) if k in rest else r[k], r[k], F.lit("")) for k, c in COLUMNS[mode].items()}


def mode_content(functions: DataFrame, mode: str, provider: Provider, regenerate: bool = False, batch: int = 10) -> DataFrame:
    """(id, the mode's columns) of the functions with code that lack the mode's first column, or of all with ``regenerate``.

    Null and blank code is not asked for; equal code (by code_hash) is asked for once, by its smallest id.
    """
    if mode not in COLUMNS:
        raise ValueError(f"mode must be one of {', '.join(COLUMNS)}")
    first = next(iter(COLUMNS[mode].values()))
    open_ = F.lit(True) if regenerate else F.col(first).isNull() | (F.col(first) == "")
    todo = functions.where(open_ & F.col("code_snippet").rlike(r"\S")).select("id", "name", "return_type", F.col("code_snippet").alias("code"), F.coalesce("code_hash", F.concat(F.lit("id:"), F.col("id"))).alias("key"))
    one = todo.groupBy("key").agg(F.min(F.struct("id", "name", "return_type", "code")).alias("x"))
    replies = ask(one.select("x.*"), provider, batch).select(F.col("id").alias("first_id"), *[c.alias(n) for n, c in reply_columns("reply", mode).items()])
    keyed = one.select("key", F.col("x.id").alias("first_id")).join(replies, "first_id").drop("first_id")
    return todo.select("id", "key").join(keyed, "key").drop("key")


def fill_mode(functions: DataFrame, mode: str, provider: Provider, regenerate: bool = False) -> DataFrame:
    """``functions`` with the mode's columns filled."""
    return upsert(functions, mode_content(functions, mode, provider, regenerate)).select(functions.columns)


def migrate(projects: DataFrame, files: DataFrame, functions: DataFrame, mode: str, provider: Provider) -> dict[str, DataFrame]:
    """``projects`` and ``functions`` after a migration to ``mode``, and its ``status`` per project.

    Projects that have the mode and no gap are skipped; of the others the gaps are filled and the mode is set.
    """
    status = migration_gaps(projects, files, functions, mode)
    moving = status.where("status = 'migrating'").select(F.col("project_id").alias("id"))
    theirs = files.join(moving.withColumnRenamed("id", "project_id"), "project_id", "left_semi").select(F.col("id").alias("file_id"))
    content = mode_content(functions.join(theirs, "file_id", "left_semi"), mode, provider)
    return {"projects": set_mode(projects, moving, mode), "functions": upsert(functions, content).select(functions.columns), "status": status}


def fill_patterns(classes: DataFrame, provider: Provider, batch: int = 15) -> DataFrame:
    """(id, ai_patterns) of the classes without patterns; code of fewer than ``LEAST_CODE`` signs and failed replies give an empty list."""
    todo = classes.where("ai_patterns is null").select("id", "name", F.lit(None).cast("string").alias("return_type"), F.col("code_snippet").alias("code"))
    enough = F.length(F.trim(F.coalesce("code", F.lit("")))) >= LEAST_CODE
    form = "array<struct<pattern:string,confidence:string,evidence:string>>"
    replies = ask(todo.where(enough), provider, batch).select("id", normalise_patterns(F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), form)).alias("ai_patterns"))
    return replies.select("id", F.coalesce("ai_patterns", F.array().cast(form)).alias("ai_patterns")).union(todo.where(~enough).select("id", F.array().cast(form)))


def _fn(s: SparkSession, d: str) -> DataFrame:
    return conform(table(s, d, "functions"), "functions")


def _migrated(s: SparkSession, d: str) -> DataFrame:
    projects, files = (conform(table(s, d, n), n) for n in ("projects", "files"))
    out = migrate(projects, files, _fn(s, d), "expert", OfflineWriter("expert"))
    return out["projects"].select("id", "analysis_mode").join(out["status"].select(F.col("project_id").alias("id"), "gap", "status"), "id")


_NEW = {m: tuple(c.values()) for m, c in COLUMNS.items()}
QUERIES = {
    "mode_fill_beginner": lambda s, d: mode_content(_fn(s, d), "beginner", OfflineWriter("beginner")).select("id", *_NEW["beginner"]),
    "mode_fill_expert": lambda s, d: mode_content(_fn(s, d), "expert", OfflineWriter("expert")).select("id", *_NEW["expert"]),
    "mode_regenerate_ai": lambda s, d: mode_content(_fn(s, d), "ai", OfflineWriter("ai"), regenerate=True).select("id", "ai_purpose"),
    "mode_migrate": _migrated,
    "pattern_fill": lambda s, d: fill_patterns(table(s, d, "classes"), OfflineWriter("patterns")).select("id", F.size("ai_patterns").alias("patterns"), F.element_at(F.col("ai_patterns.confidence"), F.when(F.size("ai_patterns") > 0, 1)).alias("confidence")),
}
_K = "WITH t AS (SELECT id, name, coalesce(code_hash, 'id:' || id) AS key FROM functions WHERE regexp_matches(code_snippet, '\\S')), k AS (SELECT key, coalesce(nullif(arg_min(coalesce(name, ''), id), ''), 'it') AS n FROM t GROUP BY 1)"
ORACLE_SQL = {
    "mode_fill_beginner": _K + " SELECT id, CASE WHEN contains(n, '_') THEN 'explains ' || n ELSE 'simple of ' || n END AS explanation_simple, CASE WHEN contains(n, '_') THEN 'step one' || chr(10) || 'step two' ELSE 'logic of ' || n END AS explanation_logic FROM t JOIN k USING (key)",
    "mode_fill_expert": _K + " SELECT id, " + ", ".join(f"'{k} of ' || n AS {c}" for k, c in COLUMNS["expert"].items()) + " FROM t JOIN k USING (key)",
    "mode_regenerate_ai": _K + " SELECT id, 'purpose of ' || n AS ai_purpose FROM t JOIN k USING (key)",
    "mode_migrate": "WITH n AS (SELECT fl.project_id, count(*) AS gap FROM functions f JOIN files fl ON fl.id = f.file_id GROUP BY 1), s AS (SELECT id, analysis_mode, coalesce(gap, 0) AS gap, CASE WHEN analysis_mode = 'expert' AND coalesce(gap, 0) = 0 THEN 'skipped' ELSE 'migrating' END AS status FROM projects LEFT JOIN n ON project_id = id) SELECT id, CASE WHEN status = 'migrating' THEN 'expert' ELSE analysis_mode END AS analysis_mode, gap, status FROM s",
    "pattern_fill": "WITH p AS (SELECT id, length(trim(coalesce(code_snippet, ''))) >= 10 AND contains(code_snippet, 'class') AS y FROM classes WHERE ai_patterns IS NULL) SELECT id, CASE WHEN y THEN 1 ELSE 0 END::INTEGER AS patterns, CASE WHEN y THEN 'high' END AS confidence FROM p",
}
