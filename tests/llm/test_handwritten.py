import pytest

from stratacode.llm.handwritten import CONVENTIONS, MOST_BYTES, MOST_LINE, Rules, by_path, by_shape, classify_files, judge_files, mine_patterns, parse_attributes

R = Rules([("", CONVENTIONS)])


@pytest.mark.parametrize(
    "path,kind",
    [
        ("node_modules/@a/b/index.js", "vendored"), ("vendor/x/y.go", "vendored"), ("app/vendor_portal/y.go", None), ("src/vendors_report/a.py", None), ("third_party_claims/a.py", None),
        ("static/js/a.min.js", "generated"), ("tools/minify_a.js", None), ("public/a.0215a63e.bundle.js", "generated"), ("assets/chunk-a.7510d2b8.js", "generated"),
        ("a/b_pb2.py", "generated"), ("a/b.pb.go", "generated"), ("x/generated/a.js", "generated"), ("src/generated_report_a.py", None), ("lib/codegen/a.py", None), ("external/x/src/a.rs", "vendored"),
        ("app/external_orders/a.rs", None), ("./Node_Modules/a.js", "vendored"), ("a//__generated__/b.ts", "generated"), ("build_planner/a.go", None), ("a/target/debug/build/x/out/t.rs", "generated"),
    ],
)
def test_conventions(path, kind):
    assert by_path(path, R) == kind


def test_a_repository_decides_for_itself_and_deeper_folders_win():
    own = Rules([("", "*.go linguist-generated\nlib/** linguist-vendored\nlib/own/** -linguist-vendored\n# *.py linguist-generated\n*.txt text"), ("sub", "*.go linguist-generated=false"), ("vendor/fork", "** -linguist-vendored")])
    assert by_path("a/b.go", R, own) == "generated" and by_path("sub/b.go", R, own) == "kept"
    assert by_path("lib/a.py", R, own) == "vendored" and by_path("lib/own/a.py", R, own) == "kept"
    assert by_path("vendor/fork/x/a.c", R, own) == "kept" and by_path("vendor/other/a.c", R, own) == "vendored"
    assert by_path("x.py", R, own) is None


def test_attribute_lines():
    assert parse_attributes("a/*.js  linguist-generated=true text eol=lf\n\n#c\n*.x -linguist-vendored !linguist-generated") == [("a/*.js", {"linguist-generated": True}), ("*.x", {"linguist-vendored": False, "linguist-generated": False})]
    one = lambda glob, path: bool(Rules([("", f"{glob} linguist-generated")]).marks(path))
    assert one("*.js", "a/b.js") and not one("/*.js", "a/b.js") and one("a/**/b.js", "a/b.js") and one("a/**/b.js", "a/x/y/b.js") and not one("a/*/b.js", "a/x/y/b.js")
    assert one("f?o[0-9].c", "x/fxo7.c") and not one("f?o[!0-9].c", "fxo7.c") and not one("docs/**", "docs")


def test_quoted_patterns_and_macros():
    text = '[attr]tool linguist-generated -text\n"my lib/*.c" linguist-vendored\n*.y tool\n*.z -tool\n"a\\"b.c" tool'
    assert parse_attributes(text) == [("my lib/*.c", {"linguist-vendored": True}), ("*.y", {"linguist-generated": True}), ("*.z", {"linguist-generated": False}), ('a"b.c', {"linguist-generated": True})]
    own = Rules([("", text)])
    assert own.marks("my lib/x.c") == {"linguist-vendored": True} and own.marks("q/r.y") == {"linguist-generated": True} and own.marks('a"b.c') == {"linguist-generated": True}


def test_shape():
    assert by_shape(0, MOST_LINE) == "compressed" and by_shape(MOST_BYTES, 80) == "data" and by_shape(MOST_BYTES - 1, MOST_LINE - 1) is None


FILES, FUNCTIONS, ATTRIBUTES = "id long, project_id long, file_path string, size_bytes long, kind string", "id long, file_id long, code_snippet string", "project_id long, folder string, text string"


def test_patterns_are_mined_from_repositories_that_declare_them(spark):
    rows, fn = [], []
    for p in range(8):  # seven declare libq as vendored and out/*.x as generated, the last one nothing
        for k in range(8):
            for path in (f"src/libq/a{k}.py", f"src/own/b{k}.py", f"out{p}/c{k}_made.py"):
                rows.append((len(rows) + 1, p, path, 100, "clash"))
                fn.append((len(fn) + 1, len(rows), "def f(): pass"))
    rows += [(900, 7, None, None, None), (901, 8, "src/LIBQ/z.py", None, None), (902, 6, "src/libq/kept.py", 10, None)]
    attrs = spark.createDataFrame([(p, "", f"src/libq/** linguist-vendored\nout{p}/* linguist-generated\nsrc/libq/kept.py -linguist-vendored") for p in range(7)], ATTRIBUTES)
    files, fn = spark.createDataFrame(rows, FILES), spark.createDataFrame(fn, FUNCTIONS)
    mined = {r.feature: r.kind for r in mine_patterns(judge_files(files, fn, attrs, ""), least_share=0.7).collect()}
    assert mined == {"folder libq": "vendored", "last made.py": "generated"}
    kinds = {r.file_id: r.kind for r in classify_files(files, fn, attrs, "", least_share=0.7).collect()}
    assert all(kinds[i] == {"libq": "vendored", "own": None}.get(path.split("/")[1], "generated") for i, _, path, _, _ in rows if i < 900)
    assert kinds[900] is None and kinds[901] == "vendored" and kinds[902] is None
    assert not mine_patterns(judge_files(files, fn, attrs, ""), least_projects=9, least_share=0.7).count()


def test_patterns_are_mined_from_shape(spark):
    rows = [(i, i % 9, f"p{i % 9}/tables/x{i}.py", MOST_BYTES + i, None) for i in range(60)] + [(60 + i, i % 9, f"p{i % 9}/src/x{i}.py", 500, None) for i in range(60)] + [(200, 3, "tables/small.py", 9, None)]
    kinds = {r.file_id: r.kind for r in classify_files(spark.createDataFrame(rows, FILES), spark.createDataFrame([(i, 60 + i, "x") for i in range(60)], FUNCTIONS), None, "").collect()}
    assert {i for i, k in kinds.items() if k == "data"} == {*range(60), 200}


def test_tables(spark):
    files = spark.createDataFrame([(1, 1, "a.go", 10, "k"), (2, 1, None, None, "k"), (3, 2, "a.go", 10, "k"), (4, 1, "b.js", 50_000, "k"), (4, 1, "b.js", 50_000, "k")], FILES)
    fn = spark.createDataFrame([(1, 4, "x" * 1700), (2, 4, None), (3, None, "y")], FUNCTIONS)
    attrs = spark.createDataFrame([(1, None, "*.go linguist-generated"), (9, "", None)], ATTRIBUTES)
    got = [(r.file_id, r.kind) for r in classify_files(files, fn, attrs).collect()]
    assert sorted(got, key=str) == sorted([(1, "generated"), (2, None), (3, None), (4, "compressed"), (4, "compressed")], key=str)
    assert classify_files(files.limit(0), fn.limit(0)).count() == 0
