import json

import pytest
from pyspark.sql import functions as F

from stratacode.functions.text import cosine, parse_query, split_identifiers, split_query, tokens
from stratacode.operators import enrich, incremental, report, search, stats, topology
from stratacode.operators.components import connected_components
from stratacode.schema import conform
from stratacode.sources.source_tree import language_of, read_tree, snippet
from stratacode.sources.tables import read_table, write_table


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


def test_identifiers(spark):
    assert one(spark, split_identifiers("v"), "getUserById_now") == "get User By Id now" and one(spark, split_identifiers("v"), None) == ""
    assert one(spark, tokens("v"), "getUser(x_1)") == ["get", "user", "x", "1"] and one(spark, tokens("v"), "--") == []
    assert split_query("getUser_id") == "get User id"


def test_queries():
    q = parse_query('getUser "by id" or other -bad -"so bad" ""')
    assert q.groups == [[["get"], ["user"], ["by", "id"]], [["other"]]] and q.negative == [["bad"], ["so", "bad"]]
    assert parse_query(" ").groups == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [1.0, None, None, None]


def _search_tables(spark):
    fn = spark.createDataFrame([(1, 1, "getUser", None, "go"), (2, 1, "setUser", "reads the user", "go"), (3, 2, "other", "no user here bad", None)], "id long, file_id long, name string, docstring string, language string")
    fl = spark.createDataFrame([(1, 1, "a/b.go", "go"), (2, 1, "c.go", None)], "id long, project_id long, file_path string, language string")
    pr = spark.createDataFrame([(1, "p")], "id long, name string")
    return conform(fn, "functions"), conform(fl, "files"), conform(pr, "projects")


def test_search_ranks_names_first_and_breaks_ties_by_id(spark):
    t = _search_tables(spark)
    assert [r.id for r in search.search_functions(*t, text="user").collect()] == [2, 1, 3]
    assert [r.id for r in search.search_functions(*t, text="user -bad").collect()] == [2, 1]
    assert [r.id for r in search.search_functions(*t, text='"the user"').collect()] == [2]
    assert [r.id for r in search.search_functions(*t, text="user", language="go", limit=1, offset=1).collect()] == [1]
    assert search.search_functions(*t, text=" ").count() == 0
    index = search.build_index(t[0])
    assert [r.id for r in search.search_index(index, "user").collect()] == [2, 1, 3]


def test_fusion_is_symmetric_at_one_half(spark):
    a = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 2)], "id long, score double, place int")
    b = spark.createDataFrame([(2, 0.9, 1), (3, 0.5, 2)], "id long, score double, place int")
    x = [(r.id, r.fused) for r in search.hybrid_search(a, b).collect()]
    y = [(r.id, r.fused) for r in search.hybrid_search(b, a).collect()]
    assert x == y and x[0][0] == 2
    assert [r.id for r in search.hybrid_search(a, b.limit(0)).collect()] == [1, 2]
    with pytest.raises(ValueError):
        search.hybrid_search(a, b, weight=2)


def test_module_and_dependency_matching(spark):
    imp = "struct<imports:array<struct<source:string,line:int>>>"
    files = spark.createDataFrame(
        [(1, 1, "pkg/a.py", {"imports": [{"source": "pkg.sub.b", "line": 1}, {"source": "os", "line": 2}]}), (2, 1, "pkg/sub/b.py", None), (3, 1, "c.py", {"imports": [{"source": "pkg.a", "line": 1}]}), (4, 2, "pkg/a.py", None), (5, 1, "x/cosine.py", None)],
        f"id long, project_id long, file_path string, dependencies {imp}",
    )
    got = {(r.file_id, r.source): r.target_id for r in topology.file_dependencies(files).collect()}
    assert got == {(1, "pkg.sub.b"): 2, (1, "os"): 5, (3, "pkg.a"): 1}
    assert {(r.file_id, r.importer_id) for r in topology.file_importers(files).collect()} == {(2, 1), (1, 3)}
    assert {(r.source, r.target, r.imports) for r in topology.module_graph(files).collect()} == {("pkg", "x", 1), (".", "pkg", 1)}


def test_manifest_and_upsert(spark):
    s = "project_id long, file_path string, file_hash string"
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", None), (1, "a", "x")], s)
    new = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", None), (1, "d", "z")], s)
    assert {r.file_path: r.state for r in incremental.manifest_diff(old, new).collect()} == {"a": "same", "b": "changed", "c": "same", "d": "new"}
    assert {r.file_path: r.state for r in incremental.manifest_diff(new, old).collect()}["d"] == "deleted"
    assert {r.file_path for r in incremental.pending_files(new, old).collect()} == {"b", "c", "d"}
    a = spark.createDataFrame([(1, "x", "k"), (2, "y", "k")], "id long, v string, w string")
    b = spark.createDataFrame([(2, None, "n"), (3, "z", "n")], "id long, v string, w string")
    assert sorted(tuple(r) for r in incremental.upsert(a, b).collect()) == [(1, "x", "k"), (2, "y", "n"), (3, "z", "n")]


def test_progress_and_states(spark):
    df = spark.createDataFrame([("parse", 0, 10), ("parse", 10, 10), ("parse", 99, 10), ("parse", 1, 0), ("completed", 0, 0), ("?", 1, 1)], "s string, i int, n int")
    assert [r[0] for r in df.select(incremental.progress_percent("s", "i", "n")).collect()] == [30, 90, 90, 30, 100, 0]
    assert one(spark, incremental.public_status("v"), "progress") == "running" and one(spark, incremental.public_status("v"), "x") == "unknown"


def test_replies_are_normalised_and_failures_are_empty(spark):
    class Flaky:
        def reply(self, items):
            if len(items) > 1:
                raise RuntimeError("too many")
            if items[0]["name"] == "bad":
                raise RuntimeError("bad item")
            return ['noise {"purpose": null, "inputs": [{"name": "a"}, {"type": "int"}, {"name": ""}], "side_effects": ["w", null]} noise']

    items = spark.createDataFrame([(1, "ok", None, "c"), (2, "bad", None, "c")], "id long, name string, return_type string, code string")
    got = {r.id: r.x for r in enrich.ask(items, Flaky()).select("id", enrich.normalise_reply("reply").alias("x")).collect()}
    assert got[1].purpose == "" and [(i.name, i.type) for i in got[1].inputs] == [("a", "unknown")] and got[1].side_effects == ["w"] and got[1].outputs.type == "unknown"
    assert got[2].inputs == [] and got[2].purpose == ""


def test_equal_code_is_asked_for_once(spark):
    fn = spark.createDataFrame([(1, "getUser", None, "x", "h", None), (2, "other", None, "x", "h", ""), (3, "full", None, "x", "h", "has"), (4, None, None, "x", None, None)], "id long, name string, return_type string, code_snippet string, code_hash string, ai_purpose string")
    assert {r.id: r.ai_purpose for r in enrich.fill_purposes(fn, enrich.NameProvider()).collect()} == {1: "does get user", 2: "does get user", 4: ""}


def test_report_and_stats(spark, tmp_path):
    pr = conform(spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string"), "projects")
    fl = conform(spark.createDataFrame([(1, 1, "a.py")], "id long, project_id long, file_path string"), "files")
    fn = conform(spark.createDataFrame([(1, 1, "f", "Doc\nmore", 2, 3, "x"), (2, 1, "g", None, None, None, None)], "id long, file_id long, name string, docstring string, start_line int, end_line int, code_snippet string"), "functions")
    cl = conform(spark.createDataFrame([(1, 1, "C", 1)], "id long, file_id long, name string, start_line int"), "classes")
    rows = report.project_report(pr, fl, fn, cl)
    ordered = [(r.project_id, r.line) for r in rows.orderBy(*report.REPORT_ORDER).collect()]
    assert [x for p, x in ordered if p == 1] == ["# p", "Files: 1, functions: 2, classes: 1", "## a.py", "- class `C` (lines 1-?)", "- function `g` (lines ?-?)", "- function `f` (lines 2-3): Doc more"]
    assert [x for p, x in ordered if p == 2] == ["# q", "Files: 0, functions: 0, classes: 0"]
    report.write_reports(rows, str(tmp_path / "r"))
    parts = sorted((tmp_path / "r" / "project_id=1").glob("*.txt"))
    assert "".join(p.read_text() for p in parts).startswith("# p\n\nFiles: 1, functions: 2, classes: 1\n\n## a.py\n- class `C`")
    got = {r.project_id: r for r in stats.project_stats(pr, fl, fn, cl).collect()}
    assert (got[1].functions, got[1].with_code_snippet_pct, got[2].with_code_snippet_pct) == (2, 50.0, 0.0)
    with pytest.raises(ValueError):
        stats.missing_summary(pr, fl, fn, cl, mode="x")


def test_source_tree(spark, tmp_path):
    for name, text in {"a b.py": "x = 1\n", "sub/c+d.JS": "l1\nl2\nl3", "node_modules/x.js": "no", "readme.md": "no", "build/y.go": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.file_path: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b.py", "sub/c+d.JS"} and rows["sub/c+d.JS"].language == "javascript" and rows["a b.py"].size_bytes == 6
    df = spark.createDataFrame([("l1\nl2\nl3",)], "v string")
    assert df.select(snippet("v", F.lit(2), F.lit(3))).first()[0] == "l2\nl3" and df.select(snippet("v", F.lit(1), F.lit(1))).first()[0] == "l1\n"
    assert one(spark, language_of("v"), "x/y.TSX") == "typescript" and one(spark, language_of("v"), "noext") is None


def test_tables_round_trip(spark, tmp_path):
    df = conform(spark.createDataFrame([(1, 7, "a"), (2, 8, "b")], "id long, project_id long, file_path string"), "files")
    for form in ("parquet", "orc", "json"):
        write_table(df, str(tmp_path), "files", form)
        assert sorted(r.file_path for r in read_table(spark, str(tmp_path), "files", form).collect()) == ["a", "b"]
    write_table(df, str(tmp_path / "p"), "files", by_project=True)
    write_table(df.where("project_id = 8").withColumn("file_path", F.lit("new")), str(tmp_path / "p"), "files", by_project=True)
    assert sorted(r.file_path for r in read_table(spark, str(tmp_path / "p"), "files").collect()) == ["a", "new"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (None, 4), (1, 2)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 161)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_class_methods_by_name_or_lines(spark):
    cl = spark.createDataFrame([(1, 1, "A", 1, 10), (2, 1, "B", 20, 30)], "id long, file_id long, name string, start_line int, end_line int")
    fn = spark.createDataFrame([(1, 1, "A.x", 40, 41), (2, 1, "y", 2, 3), (3, 1, "z", 21, 22), (4, 2, "w", 2, 3)], "id long, file_id long, name string, start_line int, end_line int")
    assert {(r.class_id, r.function_id) for r in topology.class_methods(cl, fn).collect()} == {(1, 1), (2, 3)}


def test_json_reply_text():
    assert json.loads(enrich.NameProvider().reply([{"name": "a_b"}])[0])["purpose"] == "does a b"


def test_embeddings_and_snippets(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (4, "alpha beta")], "id long, text string")
    got = {r.id: r.embedding for r in enrich.embed(texts, enrich.HashingEmbedder(8), batch=2).collect()}
    assert got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] is None and got[3] is None
    fn = spark.createDataFrame([(1, 1, "f", 2, 3, None), (2, 2, "f", 2, 3, "theirs"), (3, 3, "g", 1, 1, None)], "id long, file_id long, name string, start_line int, end_line int, code_snippet string")
    fl = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 1, "b")], "id long, project_id long, file_path string")
    pr = spark.createDataFrame([(1, "u"), (2, "u")], "id long, repo_url string")
    assert [tuple(r) for r in enrich.fill_snippets(fn, fl, pr).collect()] == [(1, "theirs", "sibling")]
    tree = spark.createDataFrame([(1, "b", "only\nline")], "project_id long, file_path string, content string")
    assert sorted(tuple(r) for r in enrich.fill_snippets(fn, fl, pr, tree).collect()) == [(1, "theirs", "sibling"), (3, "only\n", "source")]


def test_tasks_are_saved_and_resumed(spark):
    s = "id long, status string, processed_files array<string>, last_processed_file string, total_files int"
    tasks = spark.createDataFrame([(1, "running", None, None, None), (2, "completed", ["a"], "a", 1), (3, "failed", ["x"], "x", 9)], s)
    saved = spark.createDataFrame([(1, ["a", "b"], "b", 5), (7, ["z"], "z", 1)], "id long, processed_files array<string>, last_processed_file string, total_files int")
    got = {r.id: r for r in incremental.checkpoint(tasks, saved).collect()}
    assert got[1].processed_files == ["a", "b"] and got[1].total_files == 5 and got[2].processed_files is None and got[3].last_processed_file == "x" and 7 not in got
    assert [r.id for r in incremental.resumable_tasks(tasks).collect()] == [3]
    pr = spark.createDataFrame([(1, "ai"), (2, None)], "id long, analysis_mode string")
    assert {r.id: r.analysis_mode for r in incremental.set_mode(pr, pr.where("id = 2"), "expert").collect()} == {1: "ai", 2: "expert"}
    with pytest.raises(ValueError):
        incremental.set_mode(pr, pr, "x")


def test_the_innermost_class(spark):
    cl = spark.createDataFrame([(1, 1, 1, 500), (2, 1, 100, 300), (3, 1, 100, 300), (4, 2, 1, 500), (5, 1, 9, None)], "id long, file_id long, start_line int, end_line int")
    fn = spark.createDataFrame([(1, 1, 150, 160), (2, 1, 290, 310), (3, 3, 1, 2), (4, 1, None, 5), (5, 1, 499, 501)], "id long, file_id long, start_line int, end_line int")
    assert {(r.function_id, r.class_id) for r in topology.enclosing_classes(fn, cl).collect()} == {(1, 2), (2, 1)}


def test_an_overview_has_all_files_with_whole_names(spark):
    fl = spark.createDataFrame([(i, 1, f"src/f{i:03d}.py") for i in range(45)] + [(99, 2, None)], "id long, project_id long, file_path string")
    names = [f"function_{k}" for k in range(60)]
    fn = spark.createDataFrame([(k, 44, n, "d" * 300) for k, n in enumerate(names)], "id long, file_id long, name string, docstring string")
    cl = spark.createDataFrame([(1, 99, "C", None)], "id long, file_id long, name string, docstring string")
    pr = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    got = {r.id: r.code for r in enrich.overview_items(pr, fl, fn, cl).collect()}
    assert got == {1: "\n".join([*(f"src/f{i:03d}.py: ; ; " for i in range(44)), f"src/f044.py: {', '.join(names)}; ; {'d' * 200}"]), 2: "?: ; C; "}
