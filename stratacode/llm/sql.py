"""SQL that must agree with the queries of this subpackage, where SQL can say them over whole tables.

Each says the definition directly (all pairs that share an n-gram, all cosines of a probe, all windows of 13 words), not
the operator's method, and imports nothing of it. That of p4 writes the conventions, the shape and the mining anew.
"""

from __future__ import annotations

_PAIRS = """SELECT '{name}' AS field_name, a.id AS id_a, b.id AS id_b FROM {t}_n a JOIN {t}_n b ON a.scope = b.scope AND a.id < b.id JOIN
 (SELECT x.id AS p, y.id AS q, count(*) AS n FROM {t}_g x JOIN {t}_g y ON x.scope = y.scope AND x.gram = y.gram AND x.id < y.id GROUP BY 1, 2) c ON c.p = a.id AND c.q = b.id
 WHERE c.n * ({p} + {q}) >= {p} * (a.n + b.n)"""


def _sets(t: str, grams: str) -> str:
    return f"{t}_g AS (SELECT DISTINCT id, scope, unnest(grams) AS gram FROM ({grams})), {t}_n AS (SELECT id, scope, count(*) AS n FROM {t}_g GROUP BY 1, 2)"


_CHARS = "list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substr({0}, i, 3))"
_SETS = f"""w AS (SELECT DISTINCT id, list_transform(regexp_extract_all(code_snippet, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM functions WHERE code_snippet IS NOT NULL),
u AS (SELECT DISTINCT id, regexp_replace(regexp_replace(lower(trim(repo_url)), '/+$', ''), '\\.git$', '') AS s FROM projects WHERE trim(repo_url) <> ''),
k AS (SELECT id, array_to_string(list_slice(string_split_regex(s, '[/:]'), -2, -1), '/') AS s FROM u),
{_sets('code', "SELECT id, 0 AS scope, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS grams FROM w WHERE len(w) >= 30")},
{_sets('path', f"SELECT id, project_id AS scope, {_CHARS.format('lower(file_path)')} AS grams FROM files WHERE project_id IS NOT NULL")},
{_sets('repo', f"SELECT id, 0 AS scope, {_CHARS.format('s')} AS grams FROM k")}
"""
_PARTS = (("code_snippet", "code", 1, 2), ("file_path", "path", 3, 4), ("repo_url", "repo", 3, 5))
_P1 = "WITH " + _SETS + " UNION ALL ".join(_PAIRS.format(name=n, t=t, p=p, q=q) for n, t, p, q in _PARTS)
# a class is a set of n-grams; the group is what its links reach
_P1_GROUPS = f"""WITH RECURSIVE {_SETS}, pairs AS MATERIALIZED ({" UNION ALL ".join(_PAIRS.format(name=n, t=t, p=p, q=q) for n, t, p, q in _PARTS)}),
sets AS ({" UNION ALL ".join(f"SELECT '{n}' AS field_name, scope, id, list_sort(list(gram)) AS grams FROM {t}_g GROUP BY 2, 3" for n, t, _, _ in _PARTS)}),
c AS MATERIALIZED (SELECT field_name, id, min(id) OVER (PARTITION BY field_name, scope, grams) AS class_id FROM sets),
e AS (SELECT field_name, id_a AS a, id_b AS b FROM pairs UNION ALL SELECT field_name, id_b, id_a FROM pairs),
r AS (SELECT DISTINCT field_name, a AS node, a AS to_id FROM e UNION SELECT r.field_name, r.node, e.b FROM r JOIN e ON e.field_name = r.field_name AND e.a = r.to_id),
g AS (SELECT field_name, node AS id, min(to_id) AS group_id FROM r GROUP BY 1, 2),
l AS (SELECT x.field_name, x.class_id, count(DISTINCT y.class_id) AS links FROM e JOIN c x ON x.field_name = e.field_name AND x.id = e.a JOIN c y ON y.field_name = e.field_name AND y.id = e.b WHERE x.class_id <> y.class_id GROUP BY 1, 2)
SELECT c.field_name, c.id, c.class_id, g.group_id, coalesce(l.links, 0) AS links FROM c JOIN g ON g.field_name = c.field_name AND g.id = c.id LEFT JOIN l ON l.field_name = c.field_name AND l.class_id = c.class_id"""

_P3 = """WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM functions WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT q.id, v.id AS other, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.id) AS place FROM v q JOIN v ON v.id <> q.id WHERE q.id IN (SELECT function_id FROM embedding_probes) QUALIFY place <= 10)
SELECT DISTINCT least(id, other) AS function_id_a, greatest(id, other) AS function_id_b FROM s"""

_P8 = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 11)), lambda k: array_to_string(list_slice(w, k, k + 12), ' '))) AS g FROM d),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 11)), lambda k: array_to_string(list_slice(w, k, k + 12), ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


_VENDORED = r"""(.*/)?(node_modules|bower_components|jspm_packages|site-packages|dist-packages|Godeps/_workspace|\.cargo/registry|Carthage/Checkouts|Pods|webjars|shaded/org|_vendor|_vendored|[^/]*-vendored|[^/]*-[0-9][^/]*-sources)/.+
|(.*/)?(vendor|vendors|third_party|third-party|thirdparty|3rdparty|3rd-party|extern)/[^/]*/.+|(shaded|external|externals|deps)/[^/]*/.+|public/lib/[^/]*-[0-9][^/]*/.+|libs/src-attach/.+"""
_GENERATED = r"""(.*/)?[^/]*(\.min\.[mc]?js|-min\.js|\.(pack|umd|prod|bundle|[0-9a-f]{8})\.js|\.(generated|gen)\.[^/]*|\.g\.dart|\.designer\.cs|_autogen\.[^/]*|\.pb\.(go|gw\.go|cc|h)|_pb\.(js|d\.ts)|_pb2\.pyi?|_pb2_grpc\.py|OuterClass\.java|Grpc\.java|MapperImpl\.java|_gen\.go|_[^/]*_string\.go|_rc\.py)
|(.*/)?(bindata_[^/]*\.go|zz_generated[^/]*|(parsetab|lextab)[^/]*\.py|moc_[^/]*\.cpp|mock_[^/]*/mocks\.go|out/bindings_[^/]*\.rs)
|(.*/)?(__generated__|_generated|generated|generated-sources|generated-types|openapi-client|swagger-client|target/gen|target/[^/]*/build)/.+"""
_JUDGED = f"""f AS (SELECT id, project_id, file_path, coalesce(size_bytes, 0) AS size, array_to_string(list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM files),
s AS (SELECT file_id, max(list_max(list_transform(string_split(coalesce(code_snippet, ''), chr(10)), lambda x: length(x)))) AS longest, count(code_snippet) AS n FROM functions GROUP BY 1),
j AS (SELECT f.*, coalesce(s.n, 0) > 0 OR size >= 262144 AS shown, CASE WHEN {' OR '.join(f"regexp_full_match({x}, '{_GENERATED.replace(chr(10), '')}')" for x in ('p', 'lower(p)'))} THEN 'generated'
 WHEN {' OR '.join(f"regexp_full_match({x}, '{_VENDORED.replace(chr(10), '')}')" for x in ('p', 'lower(p)'))} THEN 'vendored' WHEN s.longest >= 1000 THEN 'compressed' WHEN size >= 262144 THEN 'data' END AS kind FROM f LEFT JOIN s ON s.file_id = f.id),
w AS (SELECT j.*, string_split(lower(p), '/') AS parts, regexp_extract(lower(p), '[^/]*$') AS base FROM j WHERE file_path IS NOT NULL),
x AS (SELECT w.*, regexp_extract(base, '^(.*?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(base, '\\.[^.]*$') AS ext FROM w),
g AS (SELECT id, file_path, project_id, kind, shown, unnest(list_distinct(list_filter(list_concat(list_transform(parts[:-2], lambda y: 'folder ' || y), [nullif('ending ' || regexp_replace(regexp_extract(base, '\\..*$'), '[0-9a-f]{{8,}}', '#', 'g'), 'ending '),
 CASE WHEN regexp_matches(stem, '^[^_.-]+[_-]') THEN 'first ' || regexp_extract(stem, '^[^_.-]+') || ext END, CASE WHEN regexp_matches(stem, '[_-][^_.-]+$') THEN 'last ' || regexp_extract(stem, '[^_.-]+$') || ext END]), lambda y: y IS NOT NULL))) AS feature FROM x),
c AS (SELECT feature, count(*) AS n, count(kind) AS m, count(DISTINCT project_id) FILTER (kind IS NOT NULL) AS projects FROM g WHERE shown OR kind IS NOT NULL GROUP BY 1),
top AS (SELECT feature, arg_max(kind, (k, kind)) AS kind FROM (SELECT feature, kind, count(*) AS k FROM g WHERE kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
mined AS (SELECT feature, top.kind, (m / n + 3.8416 / (2 * n) - 1.96 * sqrt(m / n * (1 - m / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS share FROM c JOIN top USING (feature) WHERE projects >= 5),
told AS (SELECT g.id, g.file_path, arg_max(mined.kind, (share, feature)) AS kind FROM g JOIN mined USING (feature) WHERE g.kind IS NULL AND share >= 0.9 GROUP BY 1, 2),
out AS (SELECT j.id, j.project_id, coalesce(j.kind, told.kind) AS kind FROM j LEFT JOIN told ON told.id = j.id AND told.file_path = j.file_path)"""
_P4 = f"WITH {_JUDGED} SELECT DISTINCT id AS file_id FROM out WHERE kind IS NOT NULL"
_P4_PROJECTS = f"WITH {_JUDGED} SELECT project_id, {', '.join(f'count(*) FILTER (kind = {chr(39)}{k}{chr(39)}) AS {k}' for k in ('generated', 'vendored', 'compressed', 'data'))}, count(*) FILTER (kind IS NULL) AS hand_written FROM out GROUP BY 1"

_P3_ALL = _P3.replace("SELECT function_id FROM embedding_probes", "SELECT id FROM functions WHERE id % 50 = 0").replace("row_number()", "round(list_cosine_similarity(q.e, v.e), 4) AS cosine, row_number()")
_P3_ALL = _P3_ALL[: _P3_ALL.index("SELECT DISTINCT least")] + "SELECT id, other, cosine FROM s"


ORACLE_SQL: dict[str, str] = {"p1_found": _P1, "p1_groups": _P1_GROUPS, "p3_found": _P3, "p3_neighbours": _P3_ALL, "p4_found": _P4, "p4_projects": _P4_PROJECTS, "p8_found": _P8}
