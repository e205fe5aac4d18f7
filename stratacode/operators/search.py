"""Ranked full-text search, vector search and their fusion.

Scoring is declared, not inherited: each field has a weight (name 1.0, signature and purpose 0.4, documentation 0.2,
code 0.1), a term's weighted count x gives x / (x + 1), and a document's rank is the sum over the query's terms.
One analyzer without stemming serves all fields. Ties go to the smaller id.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import Query, cosine, embedding_text, parse_query, split_identifiers, tokens
from ..schema import conform
from ..session import table, work_dir
from .graph import relationship_counts

MOST = 100
FUNCTION_FIELDS = {"name": 1.0, "signature": 0.4, "ai_purpose": 0.4, "docstring": 0.2, "explanation_logic": 0.2, "explanation_simple": 0.2, "code_snippet": 0.1}
CLASS_FIELDS = {"name": 1.0, "docstring": 0.4, "ai_purpose": 0.4, "patterns": 0.4, "explanation_simple": 0.2, "explanation_architecture": 0.2, "code_snippet": 0.1}
RRF = 60


def _documents(df: DataFrame, fields: dict[str, float]) -> DataFrame:
    return df.withColumns({f"_t_{f}": tokens(f) for f in fields})


def _holds(phrase: list[str], fields: dict[str, float]) -> Column:
    """Whether some field holds the words of a phrase in a row."""
    if len(phrase) == 1:
        return reduce(Column.__or__, [F.array_contains(f"_t_{f}", phrase[0]) for f in fields])
    return reduce(Column.__or__, [F.concat(F.lit(" "), F.array_join(f"_t_{f}", " "), F.lit(" ")).contains(f" {' '.join(phrase)} ") for f in fields])


def matches(query: Query, fields: dict[str, float]) -> Column:
    """The boolean of the query over the analysed fields."""
    some = reduce(Column.__or__, [reduce(Column.__and__, [_holds(p, fields) for p in g]) for g in query.groups]) if query.groups else F.lit(bool(query.negative))
    return reduce(lambda a, p: a & ~_holds(p, fields), query.negative, some)


def may_match(query: Query, fields: dict[str, float]) -> Column:
    """A cheap necessary condition, tried before any text is analysed: every word of some group stands in some field's text."""
    if not query.groups:
        return F.lit(True)
    whole = F.lower(F.concat_ws(" ", *fields))
    return reduce(Column.__or__, [reduce(Column.__and__, [whole.contains(w) for p in g for w in p]) for g in query.groups])


def rank(query: Query, fields: dict[str, float]) -> Column:
    """The sum over terms of x / (x + 1), x the weighted count of the term."""

    def count(term: str, f: str) -> Column:
        return F.size(F.filter(f"_t_{f}", lambda t: t == term)).cast("double")

    out = F.lit(0.0)
    for term in query.terms:
        x = reduce(lambda a, b: a + b, [count(term, f) * F.lit(w) for f, w in fields.items()])
        out = out + x / (x + F.lit(1.0))
    return out


def build_index(df: DataFrame, fields: dict[str, float] = FUNCTION_FIELDS) -> DataFrame:
    """(token, id, weight): the inverted index of a table, for writing out partitioned by a hash of the token.

    A query then reads its terms' rows only: ``index.where(token in terms)``, grouped by id.
    """

    def weighted(f: str, w: float) -> Column:
        return F.transform(tokens(f), lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))

    counted = F.explode(F.flatten(F.array(*[weighted(f, w) for f, w in fields.items()])))
    return df.select("id", counted.alias("x")).groupBy(F.col("x.token").alias("token"), "id").agg(F.sum("x.w").alias("weight"))


def search_index(index: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(id, score) of the documents that hold every term of ``text``, by an index of :func:`build_index`."""
    terms = parse_query(text).terms
    hit = index.where(F.col("token").isin(terms)).groupBy("id").agg(F.sum(F.col("weight") / (F.col("weight") + 1)).alias("score"), F.count(F.lit(1)).alias("n"))
    return hit.where(F.col("n") == len(terms)).select("id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(min(limit, MOST))


BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def store_index(index: DataFrame, path: str) -> None:
    """Writes an index of :func:`build_index`: a folder for each bucket of tokens, sorted by token within its files."""
    placed = index.withColumn("bucket", _bucket(F.col("token")))
    placed.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def open_index(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The part of a stored index that a query needs: only the folders of its terms' buckets are read."""
    terms = parse_query(text).terms
    wanted = sorted({r[0] for r in spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(_bucket(F.col("t"))).collect()}) if terms else []
    stored = spark.read.schema("token string, id long, weight double, bucket int").parquet(path)
    return stored.where(F.col("bucket").isin(wanted) & F.col("token").isin(terms)).drop("bucket")


def page_info(results: DataFrame, limit: int) -> DataFrame:
    """(count, limit, has_more) of one page of results: there may be more if the page is full."""
    limit = max(0, min(limit, MOST))
    return results.agg(F.count(F.lit(1)).alias("count")).select("count", F.lit(limit).alias("limit"), (F.col("count") == limit).alias("has_more"))


def full(results: DataFrame, functions: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Results with every field of the function, its file and its project, in place order."""
    fn = functions.drop("embedding", "code_hash", "llm_processed", *[c for c in results.columns if c not in ("id", "file_id", "place", "score", "file_path", "project_id", "project_name")])
    kept = [c for c in results.columns if c not in fn.columns or c == "id"]
    fl = files.select(F.col("id").alias("file_id"), "file_path", "project_id", F.col("language").alias("file_language"))
    pr = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "repo_url")
    rows = results.select(kept).drop("file_path", "project_id", "project_name", "file_id")
    return rows.join(fn, "id").join(fl, "file_id").join(pr, "project_id")


def search_functions(functions: DataFrame, files: DataFrame, projects: DataFrame, text: str, language: str | None = None, project_id: int | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best functions for a query: place, id, name, signature, language, lines, path, project and score.

    A blank query gives nothing. The language is the function's own. ``limit`` is at most ``MOST``.
    """
    query = parse_query(text)
    fn = functions if language is None else functions.where(F.col("language") == language)
    fl = files.select(F.col("id").alias("file_id"), "file_path", "project_id")
    fl = fl if project_id is None else fl.where(F.col("project_id") == project_id)
    docs = _documents(fn.where(may_match(query, FUNCTION_FIELDS)), FUNCTION_FIELDS).where(matches(query, FUNCTION_FIELDS)).withColumn("score", rank(query, FUNCTION_FIELDS))
    pr = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    got = docs.select("id", "file_id", "name", "signature", "language", "start_line", "end_line", "ai_purpose", "score").join(fl, "file_id").join(pr, "project_id")
    return _page(got.withColumn("score", F.round("score", 4)), ["score desc", "id"], limit, offset)


def _page(df: DataFrame, by: list[str], limit: int, offset: int) -> DataFrame:
    order = [F.desc(c.split()[0]) if c.endswith(" desc") else F.asc(c) for c in by]
    top = df.orderBy(*order).limit(max(0, min(limit, MOST)) + offset)
    place = F.row_number().over(W.orderBy(*order))  # over at most limit + offset rows
    return top.withColumn("place", place).where(F.col("place") > offset)


def search_classes(classes: DataFrame, files: DataFrame, projects: DataFrame, text: str = "", language: str | None = None, project_id: int | None = None, pattern: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best classes; a blank query or ``*`` matches all with score 1.0, ordered by name. The language is the file's."""
    cl = classes.withColumn("patterns", F.array_join(F.flatten(F.transform("ai_patterns", lambda p: F.array(p["pattern"], p["confidence"], p["evidence"]))), " "))
    if pattern is not None:
        cl = cl.where(F.exists("ai_patterns", lambda p: p["pattern"] == pattern))
    fl = files.select(F.col("id").alias("file_id"), "file_path", "project_id", F.col("language").alias("language"))
    if language is not None:
        fl = fl.where(F.col("language") == language)
    if project_id is not None:
        fl = fl.where(F.col("project_id") == project_id)
    pr = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    everything = text.strip() in ("", "*")
    if everything:
        docs = cl.withColumn("score", F.lit(1.0))
    else:
        query = parse_query(text)
        docs = _documents(cl.where(may_match(query, CLASS_FIELDS)), CLASS_FIELDS).where(matches(query, CLASS_FIELDS)).withColumn("score", F.round(rank(query, CLASS_FIELDS), 4))
    got = docs.select("id", "file_id", "name", "start_line", "end_line", "score").join(fl, "file_id").join(pr, "project_id")
    return _page(got, ["name", "id"] if everything else ["score desc", "id"], limit, offset)


def with_counts(results: DataFrame, functions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Results with callers and callees, both counted among the edges from functions of the result."""
    return results.join(relationship_counts(functions, relationships, within=results).withColumnRenamed("function_id", "id"), "id")


def compact(results: DataFrame) -> DataFrame:
    """Results in the short form for models: sig, ai.purpose and loc."""
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return results.select("place", "id", "name", F.col("signature").alias("sig"), F.struct(F.col("ai_purpose").alias("purpose")).alias("ai"), F.struct(F.col("file_path").alias("file"), F.concat(line("start_line"), F.lit("-"), line("end_line")).alias("lines")).alias("loc"), "score")


def group_by_file(results: DataFrame) -> DataFrame:
    """Results per (project, path): their number and the functions, best first."""
    item = F.struct(F.col("place"), F.col("id"), F.col("name"), F.col("score"))
    got = results.groupBy("project_id", "project_name", "file_path").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(item)).alias("functions"))
    return got.withColumn("functions", F.transform("functions", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["score"].alias("score"))))


def group_by_project(results: DataFrame) -> DataFrame:
    """Results per project: their number and the number per path, most first."""
    by_file = results.groupBy("project_id", "project_name", "file_path").agg(F.count(F.lit(1)).alias("n"))
    got = by_file.groupBy("project_id", "project_name").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("file_path")))).alias("files"))
    return got.withColumn("files", F.transform("files", lambda x: F.struct(x["file_path"].alias("file_path"), (-x["m"]).alias("count"))))


def semantic_search(functions: DataFrame, files: DataFrame, vector: list[float], language: str | None = None, project_id: int | None = None, limit: int = 20) -> DataFrame:
    """The functions of highest cosine to ``vector``, exactly, computed in the scan and cut by a top-k."""
    fn = functions.where("embedding is not null")
    if language is not None:
        fn = fn.where(F.col("language") == language)
    if project_id is not None:
        fn = fn.join(files.where(F.col("project_id") == project_id).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    got = fn.select("id", "name", F.round(cosine("embedding", F.array(*[F.lit(float(x)) for x in vector])), 4).alias("score")).where("score is not null")
    return _page(got, ["score desc", "id"], limit, 0)


def hybrid_search(text_leg: DataFrame, vector_leg: DataFrame, weight: float = 0.5, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two result tables with ``place`` from 1: (place, id, fused, text_score, vector_score).

    An id in one leg only gets that leg's part; an empty leg leaves the order of the other.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight must be from 0 to 1")
    a = text_leg.select("id", F.col("score").alias("text_score"), (F.lit(1 - weight) / (F.col("place") - 1 + RRF)).alias("a"))
    b = vector_leg.select("id", F.col("score").alias("vector_score"), (F.lit(weight) / (F.col("place") - 1 + RRF)).alias("b"))
    got = a.join(b, "id", "full_outer").withColumn("fused", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 8))
    return _page(got.select("id", "fused", "text_score", "vector_score"), ["fused desc", "id"], limit, 0)


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [conform(table(spark, sf_dir, n), n) for n in names]


TEXT, CLASS_TEXT = 'ledger "missing gateway" or validate planet -grant', "cursor cache"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding of the smallest id that has one of the usual width."""
    fn = table(spark, sf_dir, "functions").where("size(embedding) = 64 and exists(embedding, x -> x <> 0)")
    return fn.agg(F.min_by("embedding", "id")).first()[0]


def _text(s: SparkSession, d: str, limit: int = 20, text: str = TEXT) -> DataFrame:
    return search_functions(*_t(s, d, "functions", "files", "projects"), text=text, limit=limit)


def _vec(s: SparkSession, d: str, limit: int = 20) -> DataFrame:
    return semantic_search(*_t(s, d, "functions", "files"), vector=_first_vector(s, d), limit=limit)


def _stored(s: SparkSession, d: str, text: str) -> DataFrame:
    """A search over an index that is written to the shared folder first."""
    path = f"{work_dir(s)}/index_{uuid.uuid4().hex}"
    store_index(build_index(_t(s, d, "functions")[0]), path)
    return search_index(open_index(s, path, text), text)


def _busiest(s: SparkSession, d: str) -> int:
    """The project with most files, the smallest id on ties."""
    return table(s, d, "files").where("project_id is not null").groupBy("project_id").count().orderBy(F.desc("count"), "project_id").first().project_id


_SHOW = ("place", "id", "name", "file_path", "project_id", "score")
QUERIES = {
    "search_functions": lambda s, d: _text(s, d).select(*_SHOW),
    "search_functions_page2": lambda s, d: search_functions(*_t(s, d, "functions", "files", "projects"), text="ledger", limit=10, offset=10).select(*_SHOW),
    "search_with_counts": lambda s, d: with_counts(_text(s, d), *_t(s, d, "functions", "function_relationships")).select("id", "place", "callers", "callees"),
    "search_index": lambda s, d: search_index(build_index(_t(s, d, "functions")[0]), "ledger gateway"),
    "search_index_stored": lambda s, d: _stored(s, d, "ledger gateway"),
    "search_functions_language": lambda s, d: search_functions(*_t(s, d, "functions", "files", "projects"), text="ledger", language="python").select(*_SHOW),
    "search_functions_project": lambda s, d: search_functions(*_t(s, d, "functions", "files", "projects"), text="ledger or gateway or cursor", project_id=_busiest(s, d)).select(*_SHOW),
    "search_page_info": lambda s, d: page_info(_text(s, d, 10), 10),
    "search_full": lambda s, d: full(_text(s, d), *_t(s, d, "functions", "files", "projects")).select("place", "id", "name", "signature", "docstring", "code_snippet", "return_type", "ai_purpose", "explanation_simple", "file_path", "repo_url"),
    "search_classes": lambda s, d: search_classes(*_t(s, d, "classes", "files", "projects"), text=CLASS_TEXT).select(*_SHOW),
    "search_match_all": lambda s, d: search_classes(*_t(s, d, "classes", "files", "projects"), text=" ").select(*_SHOW),
    "pattern_filter": lambda s, d: search_classes(*_t(s, d, "classes", "files", "projects"), pattern="Observer").select(*_SHOW),
    "search_reference": lambda s, d: compact(_text(s, d, 5)).select("place", "id", "name", "sig", F.col("loc.lines").alias("lines"), "score"),
    "search_grouped_file": lambda s, d: group_by_file(_text(s, d, MOST)).select("project_id", "file_path", "count", F.transform("functions", lambda x: x["id"]).alias("ids")),
    "search_grouped_project": lambda s, d: group_by_project(_text(s, d, MOST)).select("project_id", "count", F.transform("files", lambda x: x["file_path"]).alias("paths")),
    "semantic_search": _vec,
    "hybrid_rrf": lambda s, d: hybrid_search(_text(s, d, 60), _vec(s, d, 60)),
    "embedding_text": lambda s, d: table(s, d, "functions").select("id", F.md5(embedding_text()).alias("text_md5")),
    "identifier_split": lambda s, d: table(s, d, "functions").select("id", split_identifiers("name").alias("words"), F.size(tokens("signature")).alias("signature_tokens")),
}


def _sql_tokens(c: str) -> str:
    split = f"translate(regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')"
    return f"string_split(trim(regexp_replace(lower({split}), '[^a-z0-9]+', ' ', 'g')), ' ')"


def _sql_docs(source: str, fields: dict[str, str], extra: str) -> str:
    return f"SELECT {extra}, {', '.join(f'{_sql_tokens(c)} AS t_{f}' for f, c in fields.items())} FROM {source}"


def _sql_has(phrase: list[str], fields: list[str]) -> str:
    return "(" + " OR ".join(f"contains(' ' || array_to_string(t_{f}, ' ') || ' ', ' {' '.join(phrase)} ')" for f in fields) + ")"


def _sql_search(source: str, columns: dict[str, str], weights: dict[str, float], text: str, extra: str) -> str:
    q, names = parse_query(text), list(columns)
    where = " OR ".join("(" + " AND ".join(_sql_has(p, names) for p in g) + ")" for g in q.groups)
    where = f"({where})" + "".join(f" AND NOT {_sql_has(p, names)}" for p in q.negative)
    x = lambda t: " + ".join(f"len(list_filter(t_{f}, lambda v: v = '{t}'))::DOUBLE * {weights[f]}" for f in names)
    score = " + ".join(f"({x(t)}) / (({x(t)}) + 1.0)" for t in q.terms)
    return f"WITH d AS ({_sql_docs(source, columns, extra)}), s AS (SELECT d.*, round({score}, 4) AS score FROM d WHERE {where}), j AS (SELECT s.id, s.name, fl.file_path, fl.project_id, s.score, s.signature, s.start_line, s.end_line FROM s JOIN files fl ON fl.id = s.file_id JOIN projects p ON p.id = fl.project_id)"


_FC = {f: f for f in ("name", "signature", "ai_purpose", "docstring", "code_snippet")}
_CC = {"name": "name", "docstring": "docstring", "patterns": "array_to_string(flatten(list_transform(ai_patterns, lambda p: [p.pattern, p.confidence, p.evidence])), ' ')", "code_snippet": "code_snippet"}
_FX, _CX = "id, name, file_id, signature, start_line, end_line", "id, name, file_id, NULL AS signature, start_line, end_line"
_F = _sql_search("functions", _FC, FUNCTION_FIELDS, TEXT, _FX)
_TOP = "top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM j QUALIFY place <= {})"
_PICK = "SELECT place, id, name, file_path, project_id, score FROM top"
_V = """q AS (SELECT arg_min(embedding, id) AS v FROM functions WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
vs AS (SELECT id, name, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 4) AS score FROM functions WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
vt AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM vs QUALIFY place <= {})"""
_CLS = "WITH j AS (SELECT c.id, c.name, fl.file_path, fl.project_id, 1.0::DOUBLE AS score FROM classes c JOIN files fl ON fl.id = c.file_id JOIN projects p ON p.id = fl.project_id {}), top AS (SELECT *, row_number() OVER (ORDER BY name, id) AS place FROM j QUALIFY place <= 20) " + _PICK
ORACLE_SQL: dict[str, str] = {
    "search_functions": f"{_F}, {_TOP.format(20)} {_PICK}",
    "search_functions_page2": _sql_search("functions", _FC, FUNCTION_FIELDS, "ledger", _FX) + f", {_TOP.format(20)} {_PICK} WHERE place > 10",
    "search_with_counts": f"""{_F}, {_TOP.format(20)}, e AS (SELECT source_function_id AS source, target_function_name AS target FROM function_relationships WHERE relationship_type = 'CALLS' AND source_function_id IN (SELECT id FROM top))
SELECT t.id, t.place, (SELECT count(*) FROM e WHERE e.target = t.name) AS callers, (SELECT count(*) FROM e WHERE e.source = t.id) AS callees FROM top t""",
    "search_index": _sql_search("functions", _FC, FUNCTION_FIELDS, "ledger gateway", _FX).replace(", j AS", ", unused AS") + " SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20",
    "search_functions_language": _sql_search("(SELECT * FROM functions WHERE language = 'python')", _FC, FUNCTION_FIELDS, "ledger", _FX) + f", {_TOP.format(20)} {_PICK}",
    "search_functions_project": _sql_search("(SELECT * FROM functions WHERE file_id IN (SELECT id FROM files WHERE project_id = (SELECT project_id FROM files WHERE project_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)))", _FC, FUNCTION_FIELDS, "ledger or gateway or cursor", _FX) + f", {_TOP.format(20)} {_PICK}",
    "search_page_info": f"{_F}, {_TOP.format(10)} SELECT count(*) AS count, 10::INTEGER AS \"limit\", count(*) = 10 AS has_more FROM top",
    "search_full": f"{_F}, {_TOP.format(20)} SELECT t.place, t.id, t.name, f.signature, f.docstring, f.code_snippet, f.return_type, f.ai_purpose, NULL::VARCHAR AS explanation_simple, t.file_path, p.repo_url FROM top t JOIN functions f ON f.id = t.id JOIN projects p ON p.id = t.project_id",
    "search_classes": _sql_search("classes", _CC, CLASS_FIELDS, CLASS_TEXT, _CX) + f", {_TOP.format(20)} {_PICK}",
    "search_match_all": _CLS.format(""),
    "pattern_filter": _CLS.format("WHERE len(list_filter(c.ai_patterns, lambda x: x.pattern = 'Observer')) > 0"),
    "search_reference": f"{_F}, {_TOP.format(5)} SELECT place, id, name, signature AS sig, coalesce(start_line::VARCHAR, 'None') || '-' || coalesce(end_line::VARCHAR, 'None') AS lines, score FROM top",
    "search_grouped_file": f"{_F}, {_TOP.format(MOST)} SELECT project_id, file_path, count(*) AS count, list(id ORDER BY place) AS ids FROM top GROUP BY 1, 2",
    "search_grouped_project": f"{_F}, {_TOP.format(MOST)}, x AS (SELECT project_id, file_path, count(*) AS n FROM top GROUP BY 1, 2) SELECT project_id, sum(n)::BIGINT AS count, list(file_path ORDER BY n DESC, file_path) AS paths FROM x GROUP BY 1",
    "semantic_search": f"WITH {_V.format(20)} SELECT id, name, score, place FROM vt",
    "hybrid_rrf": f"""{_F}, {_TOP.format(60)}, {_V.format(60)},
h AS (SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.5 / (a.place - 1 + 60), 0) + coalesce(0.5 / (b.place - 1 + 60), 0), 8)::DOUBLE AS fused, a.score AS text_score, b.score AS vector_score FROM top a FULL OUTER JOIN vt b ON a.id = b.id)
SELECT *, row_number() OVER (ORDER BY fused DESC, id) AS place FROM h QUALIFY place <= 20""",
    "embedding_text": "SELECT id, md5(concat_ws(chr(10), nullif(name, ''), nullif(signature, ''), nullif(ai_purpose, ''), nullif(left(docstring, 500), ''), nullif(left(code_snippet, 2000), ''))) AS text_md5 FROM functions",
    "identifier_split": f"SELECT id, translate(regexp_replace(coalesce(name, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ') AS words, CAST(len(list_filter({_sql_tokens('signature')}, lambda x: x <> '')) AS INTEGER) AS signature_tokens FROM functions",
}
ORACLE_SQL["search_index_stored"] = ORACLE_SQL["search_index"]
