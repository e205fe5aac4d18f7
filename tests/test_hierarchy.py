import random

import pytest

from stratacode.operators.hierarchy import _cycles_by_joins, ancestors, class_links, cycle_members, descendants, hierarchy_paths

SCHEMA = "grp long, child long, parent long"


def brute(links):
    up = {}
    for _, c, p in links:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)

    def reach(v):
        seen, todo = set(), list(up.get(v, ()))
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += up.get(w, ())
        return seen

    nodes = set(up) | {p for s in up.values() for p in s}
    r = {v: reach(v) for v in nodes}
    ring = {v: min(w for w in r[v] if v in r[w]) for v in nodes if v in r[v]}

    def ways(v):
        if v in ring:
            return {f"cycle:{ring[v]}"}
        if v not in up:
            return {str(v)}
        return {f"{w}/{v}" for p in up[v] for w in ways(p)}

    return {(v, w) for v in up for w in ways(v)}, ring, {(a, v) for v in nodes for a in r[v]}


def graph(seed, n, extra, cycles):
    rnd = random.Random(seed)
    links = [(i % 3, i, rnd.randrange(max(0, i - 6), i)) for i in range(1, n) if rnd.random() < 0.8]
    links += [(1, b, a) for a, b in (sorted(rnd.sample(range(n), 2)) for _ in range(extra))]
    links += [(1, a, b) for a, b in (sorted(rnd.sample(range(n), 2)) for _ in range(cycles))]
    return [(0, c, p) for _, c, p in links]


@pytest.mark.parametrize("seed,rows", [(1, 4), (2, 9), (3, 1000)])
def test_paths_and_descendants_match_brute_force(spark, seed, rows):
    links = graph(seed, 40, 6, 3)
    paths, ring, below = brute(links)
    df = spark.createDataFrame([*links, links[0]], SCHEMA)
    got = hierarchy_paths(df, fragment_rows=rows).collect()
    assert {(r.node, r.path) for r in got} == paths and len(got) == len(paths)
    assert {r.node for r in got if r.on_cycle} == set(ring)
    assert {tuple(r) for r in descendants(df, fragment_rows=rows).collect()} == below


def test_joins_find_the_same_cycles(spark):
    links = [(0, a, b) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8)]]
    df = spark.createDataFrame(links, SCHEMA)
    want = {frozenset((1, 2, 3)), frozenset((4, 5)), frozenset((6,))}
    for found in (_cycles_by_joins(df), cycle_members(df, 2), cycle_members(df)):
        by = {}
        for r in found.collect():
            by.setdefault(r.label, set()).add(r.node)
        assert {frozenset(x) for x in by.values()} == want


def test_a_long_chain_over_many_fragments(spark):
    n = 300
    got = hierarchy_paths(spark.createDataFrame([(0, i + 1, i) for i in range(n)], SCHEMA), fragment_rows=20)
    rows = {r.node: r for r in got.collect()}
    assert len(rows) == n and rows[n].depth == n and rows[n].root == 0
    assert rows[n].path == "/".join(map(str, range(n + 1)))


@pytest.mark.parametrize("rows", [7, 4000])
def test_diamonds_cost_pairs_not_ways(spark, rows):
    n = 30  # 2 ** 30 ways from the bottom to the top
    links = [(0, 10 * (i + 1), 10 * i + k) for i in range(n) for k in (1, 2)] + [(0, 10 * i + k, 10 * i) for i in range(n) for k in (1, 2)]
    got = {(r.node, r.ancestor): r.depth for r in ancestors(spark.createDataFrame(links, SCHEMA), rows).collect()}
    up = {}
    for _, c, p in links:
        up.setdefault(c, []).append(p)
    want = {}
    for v in up:
        level, d = {v}, 0
        while level:
            level, d = {p for x in level for p in up.get(x, ()) if (v, p) not in want}, d + 1
            want |= {(v, p): d for p in level}
    assert got == want


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 2), (0, None, 2), (0, 3, None)], SCHEMA)
    assert [(r.node, r.path) for r in hierarchy_paths(df).collect()] == [(1, "2/1")]
    assert hierarchy_paths(df.limit(0)).count() == 0 and descendants(df.limit(0)).count() == 0


def test_names_are_resolved_within_the_project(spark):
    entry = "array<struct<name:string,line:int>>"
    classes = spark.createDataFrame(
        [
            (1, 10, "Base", None, None, "x"),
            (2, 10, "Base", [], None, "x"),
            (3, 10, "Kid", [(" pkg.Base<T.U> ", 1), ("Base", 2), (None, 1), ("  ", 1)], [("ns::Face[int]", 1)], "x"),
            (4, 11, "Face", None, None, "x"),
            (5, 12, "Face", None, [("base", 1)], "x"),
            (6, None, "Lost", [("Base", 1)], None, "x"),
        ],
        f"id long, file_id long, name string, base_classes {entry}, interfaces {entry}, project_id string",
    )
    files = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, project_id long")
    assert sorted((r.child, r.parent) for r in class_links(classes, files).collect()) == [(3, 1), (3, 4)]
