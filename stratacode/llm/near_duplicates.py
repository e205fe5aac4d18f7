"""Problem 1: near-duplicate snippets, paths and repository URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.components import connected_components
from ..session import is_empty, table
from .fragment_join import SetField, expand_pairs, similar_sets

FIELDS = [
    SetField(0, "code_snippet", 1, 2, by_words=True, least_words=30),
    SetField(1, "file_path", 3, 4, by_words=False),
    SetField(2, "repo_url", 3, 5, by_words=False, repo_key=True),
]


def records(functions: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """The three fields as one stream of (field, scope, id, text); paths are compared within their project.

    A path without a project has no project to share with another and takes no part.
    """
    none = F.lit(0).cast("long")
    return (
        functions.select(F.lit(0).alias("field"), none.alias("scope"), F.col("id").cast("long"), F.col("code_snippet").alias("text"))
        .union(files.where("project_id is not null").select(F.lit(1), F.col("project_id").cast("long"), F.col("id").cast("long"), "file_path"))
        .union(projects.select(F.lit(2), none, F.col("id").cast("long"), "repo_url"))
    )


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("field_name", F.element_at(F.create_map(*[F.lit(x) for f in FIELDS for x in (f.code, f.name)]), F.col("field")))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(*(table(spark, sf_dir, t) for t in ("functions", "files", "projects")))


def near_duplicate_pairs(source: DataFrame) -> DataFrame:
    """(field_name, id_a, id_b), id_a < id_b: every pair at or above its field's threshold; see :func:`similar_sets`.

    A pair can come twice only if an id has texts of two classes; only then is the result, which may be far longer than
    the input, shuffled to make it distinct.
    """
    pairs, classes = similar_sets(source, FIELDS)
    out = _named(expand_pairs(pairs, classes)).select("field_name", "id_a", "id_b")
    twice = classes.groupBy("field", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if is_empty(twice) else out.distinct()


def near_duplicate_groups(source: DataFrame) -> DataFrame:
    """(field_name, id, class_id, group_id, links): one row per record that has a near-duplicate.

    class_id names the records with an equal set, group_id the smallest id reached over links, links the number of
    other classes the record's class is linked to. Copies are not expanded into pairs, so a class of any size costs a
    row a record. Ids may be any 64-bit numbers: nodes are (field, id).
    """
    pairs, classes = similar_sets(source, FIELDS)
    node = lambda c: F.struct("field", F.col(c).alias("id"))
    comp = connected_components(pairs.select(node("a").alias("u"), node("b").alias("v")))
    ends = pairs.select("field", F.col("a").alias("class_id")).unionAll(pairs.select("field", F.col("b").alias("class_id")))
    links = ends.groupBy("field", "class_id").agg(F.count(F.lit(1)).alias("links"))
    size = classes.groupBy("field", "class_id").agg(F.count(F.lit(1)).alias("members"))
    group = comp.select("node.field", F.col("node.id").alias("class_id"), F.col("component.id").alias("group_id"))
    known = size.join(links, ["field", "class_id"], "left").join(group, ["field", "class_id"], "left").where("members > 1 or links is not null")
    out = classes.join(known, ["field", "class_id"])
    return _named(out).select("field_name", "id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(_tables(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_tables(spark, sf_dir))
