import subprocess

import numpy as np
from pyspark.sql import functions as F

from stratacode.operators import modes, reparse, search, vector_index
from stratacode.parse.facts import end_by_indent
from stratacode.schema import TABLES
from stratacode.sources.acquire import acquire, repo_root
from stratacode.sources.source_tree import read_tree


def functions(spark, rows):
    df = spark.createDataFrame(rows, "id long, file_id long, name string, return_type string, code_snippet string, code_hash string, ai_purpose string, explanation_simple string")
    from stratacode.schema import conform

    return conform(df, "functions")


def test_modes_fill_gaps_once_a_code_and_regenerate_all(spark):
    class Broken:
        def reply(self, items):
            raise RuntimeError

    fn = functions(spark, [(1, 1, "a_b", None, "code", "h", None, None), (2, 1, "other", None, "code", "h", "x", None), (3, 1, "kept", None, "code3", "k", "old", "there"), (4, 1, "blank", None, " ", "z", None, None), (5, 1, "none", None, None, None, None, None)])
    got = {r.id: (r.explanation_simple, r.explanation_logic) for r in modes.mode_content(fn, "beginner", modes.OfflineWriter("beginner")).collect()}
    assert got == {1: ("explains a_b", "step one\nstep two"), 2: ("explains a_b", "step one\nstep two")}
    assert {r.id for r in modes.mode_content(fn, "beginner", modes.OfflineWriter("beginner"), regenerate=True).collect()} == {1, 2, 3}
    expert = {r.id: r.expert_tradeoffs for r in modes.fill_mode(fn, "expert", modes.OfflineWriter("expert")).collect()}
    assert expert == {1: "tradeoffs of a_b", 2: "tradeoffs of a_b", 3: "tradeoffs of kept", 4: None, 5: None}
    assert {r.expert_purpose for r in modes.mode_content(fn, "expert", Broken()).collect()} == {""}


def test_migrating_fills_and_sets_the_mode(spark):
    fn = functions(spark, [(1, 1, "a", None, "code", None, None, "x"), (2, 2, "b", None, "code", None, None, None)])
    pr = spark.createDataFrame([(1, "beginner"), (2, "ai")], "id long, analysis_mode string")
    fl = spark.createDataFrame([(1, 1), (2, 2)], "id long, project_id long")
    out = modes.migrate(pr, fl, fn, "beginner", modes.OfflineWriter("beginner"))
    assert {(r.project_id, r.status) for r in out["status"].collect()} == {(1, "skipped"), (2, "migrating")}
    assert {r.analysis_mode for r in out["projects"].collect()} == {"beginner"}
    assert {r.id: r.explanation_simple for r in out["functions"].collect()} == {1: "x", 2: "simple of b"}


def test_reparse_keeps_what_was_generated(spark, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("import os\n\nclass A(B):\n    def go(self):\n        return run()\n\ndef run():\n    return 1\n")
    (src / "bad.py").write_text("def (")
    (src / "node_modules" / "x.js").write_text("function x() {}")
    folder, commit = acquire(str(src), str(tmp_path / "repo_7"))
    assert len(commit) == 40 and repo_root(7, "https://h/o/name.git", [str(tmp_path)]) == folder and repo_root(8, None, [str(tmp_path)]) is None and repo_root(9, str(src), []) == str(src)
    assert acquire(str(src), folder)[1] == commit and not (tmp_path / "repo_7" / "node_modules").exists()
    clone, same = acquire("file://" + folder + "/.git", str(tmp_path / "cloned"))
    assert same == commit and subprocess.run(["git", "-C", clone, "status", "--porcelain"], capture_output=True, text=True).stdout == ""
    tree = read_tree(spark, folder).withColumn("project_id", F.lit(7).cast("long"))
    first = reparse.reparse(tree)
    assert {r.name for r in first["functions"].collect()} >= {"run"} and {r.file_path for r in first["files"].collect()} == {"a.py", "bad.py"}
    assert [(r.target_class_name) for r in first["class_relationships"].collect()] == ["B"]
    old = first["functions"].withColumn("ai_purpose", F.concat(F.lit("does "), "name")).where("name = 'run'")
    again = {r.name: r.ai_purpose for r in reparse.reparse(tree, old)["functions"].collect()}
    assert again["run"] == "does run" and {v for k, v in again.items() if k != "run"} == {None}
    files = first["files"].withColumn("dependencies", F.lit(None).cast(first["files"].schema["dependencies"].dataType))
    filled = {r.file_path: r.dependencies for r in reparse.backfill_dependencies(files, tree).collect()}
    assert [i.source for i in filled["a.py"].imports] == ["os"] and "dependencies" in TABLES["files"]


def test_class_snippets_and_the_dry_run(spark):
    fn = spark.createDataFrame([(1, 1, "f", 1, None), (2, 2, "f", 1, "code")], "id long, file_id long, name string, start_line int, code_snippet string")
    cl = spark.createDataFrame([(1, 1, 1, 2, None), (2, 3, 1, 1, None)], "id long, file_id long, start_line int, end_line int, code_snippet string")
    fl = spark.createDataFrame([(1, 1, "a.py"), (2, 2, "a.py"), (3, 1, "gone.py")], "id long, project_id long, file_path string")
    pr = spark.createDataFrame([(1, "u"), (2, "u")], "id long, repo_url string")
    tree = spark.createDataFrame([(1, "a.py", "class A:\n    x = 1\ny = 2\n")], "project_id long, file_path string, content string")
    assert {tuple(r) for r in reparse.snippet_gaps(fn, cl, fl, pr).collect()} == {(1, "function", 1, 0, 1, 0), (1, "class", 2, 0, 0, 2)}
    assert {tuple(r) for r in reparse.snippet_gaps(fn, cl, fl, pr, tree).collect()} == {(1, "function", 1, 1, 0, 0), (1, "class", 2, 1, 0, 1)}
    assert [tuple(r) for r in reparse.fill_class_snippets(cl, fl, tree).collect()] == [(1, "class A:\n    x = 1\n")]


def test_ends_by_indent(spark):
    rows = [(1, 1, 1, 0), (2, 1, 3, 4), (3, 1, 5, 8), (4, 1, 7, 4), (5, 1, 20, 0), (6, 2, 1, 0), (7, 1, None, 0), (8, 1, 7, 2)]
    got = {r.id: r.estimated_end for r in end_by_indent(spark.createDataFrame(rows, "id long, file_id long, start_line int, indent int")).collect()}
    assert got == {1: 19, 2: 6, 3: 6, 4: 19, 5: None, 6: None, 8: 19}


def test_a_stored_text_index_reads_its_terms_only(spark, tmp_path):
    fn = functions(spark, [(i, 1, f"load_{w}", None, f"return {w}", None, None, None) for i, w in enumerate(["ledger", "gateway", "ledger", "planet"])])
    index = search.build_index(fn)
    search.store_index(index, str(tmp_path / "index"))
    opened = search.open_index(spark, str(tmp_path / "index"), "load ledger")
    assert "PartitionFilters: [" in opened._jdf.queryExecution().toString() and {r.token for r in opened.collect()} == {"load", "ledger"}
    assert search.search_index(opened, "load ledger").collect() == search.search_index(index, "load ledger").collect()
    assert search.open_index(spark, str(tmp_path / "index"), " ").count() == 0
    info = search.page_info(search.search_index(index, "load", limit=4), 4).first()
    assert tuple(info) == (4, 4, True) and tuple(search.page_info(search.search_index(index, "planet", limit=4), 4).first()) == (1, 4, False)


def test_a_stored_vector_index_finds_nearly_all(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 2000)] + 0.5 * rng.normal(size=(2000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0]), (5003, [float("nan")] * 16)]
    vector_index.store_vector_index(spark.createDataFrame(rows, "id long, vector array<float>"), str(tmp_path / "v"), lists=20)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 2000, 400):
        got = [r.id for r in vector_index.search_vector_index(spark, str(tmp_path / "v"), x[q].tolist(), 10, probes=5).collect()]
        hit += len(set(got) & set(np.argsort(-(u @ u[q]))[:10].tolist()))
    assert hit >= 0.9 * 50
    exact = vector_index.search_vector_index(spark, str(tmp_path / "v"), x[3].tolist(), 2000, probes=20)
    assert exact.count() == 2000
    vector_index.store_vector_index(spark.createDataFrame([], "id long, vector array<float>"), str(tmp_path / "e"))
    assert vector_index.search_vector_index(spark, str(tmp_path / "e"), [1.0] * 16).count() == 0
