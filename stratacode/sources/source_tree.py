"""Source trees as tables: the walk, content hashes, languages and snippets."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The folders that are not source, and the languages by extension.
SKIPPED_FOLDERS = (".git", "__pycache__", "venv", "env", "node_modules", "target", "build", "dist")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".rs": "rust",
}


def language_of(path: Column | str) -> Column:
    """The language of a path by its extension in any case; null if it has none of them."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.nullif(ext, F.lit("")))


def wanted(path: Column | str) -> Column:
    """Whether a relative path has a known language and lies in no skipped folder."""
    path = F.col(path) if isinstance(path, str) else path
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return language_of(path).isNotNull() & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language, file_hash, size_bytes, content) of the source files below ``root``.

    Paths are relative; the hash is the md5 of the bytes. Files of other kinds are never opened: the reader gets their
    extensions as a glob, and the folder filter is on the path column alone.
    """
    base = root.rstrip("/") if "://" in root else "file:" + os.path.abspath(root)
    glob = "*{" + ",".join(sorted({*LANGUAGES, *(x.upper() for x in LANGUAGES)})) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    rel = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    df = raw.withColumn("file_path", F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B")))).where(wanted("file_path"))
    return df.select("file_path", language_of("file_path").alias("language"), F.md5("content").alias("file_hash"), F.length("content").cast("long").alias("size_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def snippet(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines ``start`` to ``end`` of a text, both counted from 1, with their line ends; null for null lines."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    rows = F.split(content, "(?<=\n)")
    return F.array_join(F.slice(rows, F.greatest(F.lit(1), start), F.greatest(F.lit(0), end - F.greatest(F.lit(1), start) + 1)), "")
