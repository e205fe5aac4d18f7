"""Enrichment by an external row function, behind a provider that works in batches.

The providers here need no network: ``NameProvider`` derives content from the code's own names. A provider that fails
for a batch is asked for each item; an item that fails gives a defined empty reply.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import embedding_text
from ..session import table
from ..sources.source_tree import snippet
from .incremental import cross_project_code
from .report import file_summary

REPLY = "purpose string, inputs array<struct<name:string,type:string,description:string>>, outputs struct<type:string,description:string>, side_effects array<string>"
CONFIDENCES = ("high", "medium", "low")


class Provider(Protocol):
    """Replies, JSON objects as text, to a batch of items, in their order."""

    def reply(self, items: list[dict]) -> list[str]: ...


class NameProvider:
    """A stand-in for a model: the purpose is made of the function's name."""

    def reply(self, items: list[dict]) -> list[str]:
        out = []
        for x in items:
            words = re.sub(r"([a-z])([A-Z])", r"\1 \2", x.get("name") or "").replace("_", " ").lower().strip()
            out.append(json.dumps({"purpose": f"does {words}" if words else "", "inputs": [], "outputs": {"type": x.get("return_type") or "unknown"}, "side_effects": []}))
        return out


def json_object(text: Column | str) -> Column:
    """The text from the first ``{`` to the last ``}`` of a reply."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_array(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def normalise_reply(text: Column | str) -> Column:
    """A reply as a typed struct: no nulls, inputs without a name dropped, types ``unknown`` by default."""
    r = F.from_json(json_object(text), REPLY)
    blank = lambda c: F.coalesce(c, F.lit(""))
    empty = F.array().cast("array<struct<name:string,type:string,description:string>>")
    inputs = F.transform(
        F.filter(F.coalesce(r["inputs"], empty), lambda x: x["name"].isNotNull() & (x["name"] != "")),
        lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["type"], F.lit("unknown")).alias("type"), blank(x["description"]).alias("description")),
    )
    effects = F.filter(F.coalesce(r["side_effects"], F.array().cast("array<string>")), lambda x: x.isNotNull())
    outputs = F.struct(F.coalesce(r["outputs"]["type"], F.lit("unknown")).alias("type"), blank(r["outputs"]["description"]).alias("description"))
    return F.struct(blank(r["purpose"]).alias("purpose"), inputs.alias("inputs"), outputs.alias("outputs"), effects.alias("side_effects"))


def normalise_patterns(patterns: Column | str) -> Column:
    """Patterns without a name dropped; a confidence that is none of the three is medium."""
    return F.transform(
        F.filter(patterns, lambda p: p["pattern"].isNotNull() & (p["pattern"] != "")),
        lambda p: F.struct(p["pattern"].alias("pattern"), F.when(F.lower(p["confidence"]).isin(*CONFIDENCES), F.lower(p["confidence"])).otherwise("medium").alias("confidence"), F.coalesce(p["evidence"], F.lit("")).alias("evidence")),
    )


def ask(items: DataFrame, provider: Provider, batch: int = 15) -> DataFrame:
    """``items`` (id, name, return_type, code) with the provider's raw reply, in batches of ``batch``; {} where it fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows, replies = pdf.to_dict("records"), []
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                try:
                    got = provider.reply(part)
                    if len(got) != len(part):
                        raise ValueError("another number of replies")
                except Exception:
                    got = []
                    for x in part:
                        try:
                            got += provider.reply([x])[:1] or ["{}"]
                        except Exception:
                            got.append("{}")
                replies += got
            yield pd.DataFrame({"id": pdf["id"], "reply": replies})

    return items.select("id", "name", "return_type", "code").mapInPandas(run, "id long, reply string")


def fill_purposes(functions: DataFrame, provider: Provider, batch: int = 15) -> DataFrame:
    """(id, ai_purpose) for the functions without a purpose; equal code is asked for once, by its smallest id."""
    gap = functions.where("ai_purpose is null or ai_purpose = ''").select("id", "name", "return_type", F.col("code_snippet").alias("code"), F.coalesce("code_hash", F.concat(F.lit("id:"), F.col("id"))).alias("key"))
    first = gap.groupBy("key").agg(F.min(F.struct("id", "name", "return_type", "code")).alias("x"))
    replies = ask(first.select("x.*"), provider, batch).select(F.col("id").alias("first_id"), normalise_reply("reply")["purpose"].alias("ai_purpose"))
    keyed = first.select("key", F.col("x.id").alias("first_id")).join(replies, "first_id")
    return gap.select("id", "key").join(keyed, "key").select("id", "ai_purpose")


class HashingEmbedder:
    """A stand-in for an embedding service: signed hashes of words, scaled to length one; empty text has no vector."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        import hashlib

        out: list[list[float] | None] = []
        for text in texts:
            v = [0.0] * self.width
            for w in re.findall(r"[a-z0-9]+", text.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else None)
        return out


def embed(texts: DataFrame, embedder: HashingEmbedder, batch: int = 64) -> DataFrame:
    """(id, embedding) of ``texts(id, text)``, in batches; null where the text is empty or the service fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got: list = []
            for i in range(0, len(pdf), batch):
                part = [t or "" for t in pdf["text"].iloc[i : i + batch]]
                try:
                    reply = embedder.embed(part)
                    got += reply if len(reply) == len(part) else [None] * len(part)
                except Exception:
                    got += [None] * len(part)
            yield pd.DataFrame({"id": pdf["id"], "embedding": got})

    return texts.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def overview_items(projects: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, name, return_type, code): one item a project for :func:`ask`, its text the summaries of all its files by path.

    Every file is there with all names of its functions and classes; only its doc is short (see :func:`file_summary`).
    A project's text is one value and so must fit into one task; at the 120 characters a file of sf0.1 that is 12 MB
    for 100,000 files.
    """
    summary = file_summary(files, functions, classes)
    place = F.row_number().over(W.partitionBy("project_id").orderBy("file_path", "file_id"))
    row = F.concat(F.coalesce("file_path", F.lit("?")), F.lit(": "), "functions", F.lit("; "), "classes", F.lit("; "), "doc")
    rows = summary.withColumn("place", place).select("project_id", F.struct("place", row.alias("row")).alias("x"))
    text = rows.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), "\n").alias("code"))
    return projects.select(F.col("id"), F.col("id").alias("project_id"), "name").join(text, "project_id").select("id", "name", F.lit(None).cast("string").alias("return_type"), "code")


def fill_snippets(functions: DataFrame, files: DataFrame, projects: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(id, code_snippet, origin) for functions without code: their lines in ``tree(project_id, file_path, content)``, else a sibling project's code.

    ``origin`` is ``source`` or ``sibling``; functions that neither helps have no row.
    """
    gap = functions.where("code_snippet is null").select("id", "file_id", "start_line", "end_line")
    donors = cross_project_code(functions, files, projects).join(functions.select(F.col("id").alias("donor_id"), F.col("code_snippet").alias("theirs")), "donor_id").select("id", "theirs")
    out = gap.join(donors, "id", "left")
    if tree is None:
        out = out.withColumn("own", F.lit(None).cast("string"))
    else:
        source = files.select(F.col("id").alias("file_id"), "project_id", "file_path").join(tree.select("project_id", "file_path", "content"), ["project_id", "file_path"]).select("file_id", "content")
        out = out.join(source, "file_id", "left").withColumn("own", F.nullif(snippet("content", "start_line", "end_line"), F.lit("")))
    return out.where("own is not null or theirs is not null").select("id", F.coalesce("own", "theirs").alias("code_snippet"), F.when(F.col("own").isNotNull(), "source").otherwise("sibling").alias("origin"))


def _normalised(functions: DataFrame) -> DataFrame:
    """Replies as a model writes them, prose around JSON with missing and null parts, made of the functions' columns and brought to form."""
    reply = F.struct(
        F.col("ai_purpose").alias("purpose"),
        F.array(F.struct("name", F.col("return_type").alias("type")), F.struct(F.lit("").alias("name"), F.lit("dropped").alias("type"))).alias("inputs"),
        F.struct(F.col("return_type").alias("type")).alias("outputs"),
        F.when(F.col("llm_processed"), F.array(F.lit("writes"), F.lit(None).cast("string"))).alias("side_effects"),
    )
    x = normalise_reply(F.concat(F.lit("Here it is:\n"), F.to_json(reply), F.lit("\nDone.")))
    shown = F.array_join(F.transform(x["inputs"], lambda i: F.concat_ws(":", i["name"], i["type"], i["description"])), ",")
    return functions.select("id", x["purpose"].alias("purpose"), shown.alias("inputs"), x["outputs"]["type"].alias("output_type"), F.size(x["side_effects"]).alias("effects"))


QUERIES = {
    "embedding_generate": lambda s, d: embed(table(s, d, "functions").select("id", embedding_text().alias("text")), HashingEmbedder()).select("id", F.size("embedding").alias("width")),
    "overview_items": lambda s, d: overview_items(*(table(s, d, n) for n in ("projects", "files", "functions", "classes"))).select("id", F.md5("code").alias("text_md5")),
    "snippet_fill": lambda s, d: fill_snippets(*(table(s, d, n) for n in ("functions", "files", "projects"))),
    "enrich_stub": lambda s, d: fill_purposes(table(s, d, "functions"), NameProvider()),
    "json_normalize": lambda s, d: _normalised(table(s, d, "functions")),
    "embedding_values": lambda s, d: embed(table(s, d, "functions").select("id", embedding_text().alias("text")), HashingEmbedder()).select("id", F.posexplode("embedding").alias("pos", "value")).select("id", "pos", F.round(F.col("value").cast("double"), 5).alias("value")).where("value <> 0"),
    "pattern_normalize": lambda s, d: table(s, d, "classes").select("id", F.explode(normalise_patterns("ai_patterns")).alias("p")).select("id", "p.pattern", "p.confidence"),
}
ORACLE_SQL = {
    "embedding_generate": "SELECT id, CASE WHEN regexp_matches(lower(concat_ws(' ', name, signature, ai_purpose, left(docstring, 500), left(code_snippet, 2000))), '[a-z0-9]') THEN 64 END AS width FROM functions",
    "overview_items": """WITH fn AS (SELECT file_id, string_agg(name, ', ' ORDER BY id) AS f, arg_min(docstring, id) FILTER (trim(docstring) <> '') AS doc FROM functions GROUP BY 1), cl AS (SELECT file_id, string_agg(name, ', ' ORDER BY id) AS c, arg_min(docstring, id) FILTER (trim(docstring) <> '') AS doc FROM classes GROUP BY 1),
r AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY file_path NULLS FIRST, id) AS place, coalesce(file_path, '?') || ': ' || coalesce(f, '') || '; ' || coalesce(c, '') || '; ' || left(coalesce(fn.doc, cl.doc, ''), 200) AS row FROM files LEFT JOIN fn ON fn.file_id = id LEFT JOIN cl ON cl.file_id = id)
SELECT p.id, md5(string_agg(r.row, chr(10) ORDER BY place)) AS text_md5 FROM projects p JOIN r ON r.project_id = p.id GROUP BY 1""",
    "enrich_stub": r"""WITH g AS (SELECT id, coalesce(code_hash, 'id:' || id) AS key, name FROM functions WHERE coalesce(ai_purpose, '') = ''),
f AS (SELECT key, arg_min(coalesce(name, ''), id) AS name FROM g GROUP BY 1), w AS (SELECT key, trim(lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '))) AS words FROM f)
SELECT g.id, CASE WHEN words <> '' THEN 'does ' || words ELSE '' END AS ai_purpose FROM g JOIN w USING (key)""",
    "json_normalize": """SELECT id, coalesce(ai_purpose, '') AS purpose, CASE WHEN coalesce(name, '') <> '' THEN name || ':' || coalesce(return_type, 'unknown') || ':' ELSE '' END AS inputs, coalesce(return_type, 'unknown') AS output_type, CASE WHEN llm_processed THEN 1 ELSE 0 END::INTEGER AS effects FROM functions""",
    "embedding_values": r"""WITH t AS (SELECT id, regexp_extract_all(lower(concat_ws(chr(10), nullif(name, ''), nullif(signature, ''), nullif(ai_purpose, ''), nullif(left(docstring, 500), ''), nullif(left(code_snippet, 2000), ''))), '[a-z0-9]+') AS w FROM functions),
h AS (SELECT id, md5(unnest(w)) AS m FROM t), b AS (SELECT id, ('0x' || substr(m, 1, 2))::INTEGER % 64 AS pos, CASE WHEN ('0x' || substr(m, 15, 2))::INTEGER >= 128 THEN 1.0 ELSE -1.0 END AS s FROM h),
v AS (SELECT id, pos, sum(s) AS x FROM b GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(x * x)) AS size FROM v GROUP BY 1)
SELECT id, pos, round((x / size)::FLOAT::DOUBLE, 5) AS value FROM v JOIN n USING (id) WHERE size > 0 AND round((x / size)::FLOAT::DOUBLE, 5) <> 0""",
    "pattern_normalize": "WITH p AS (SELECT id, unnest(ai_patterns) AS p FROM classes) SELECT id, p.pattern AS pattern, CASE WHEN lower(p.confidence) IN ('high', 'medium', 'low') THEN lower(p.confidence) ELSE 'medium' END AS confidence FROM p WHERE p.pattern <> ''",
}
