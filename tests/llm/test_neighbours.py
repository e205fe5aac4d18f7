import math

import numpy as np

from stratacode.llm.neighbours import chi_square_quantile, nearest


def test_chi_square():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 0.01 and abs(chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-6


def cluster(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 64))).astype(np.float32)


def test_recall_over_partitions(spark):
    x = cluster(1500, 1)
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "id long, vector array<float>, part string")
    q = [(i,) for i in range(0, 1500, 30)]
    got = {}
    for r in nearest(df, spark.createDataFrame([*q, q[0]], "id long"), part_rows=100).collect():
        got.setdefault(r.id, []).append(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for (i,) in q:
        s = u @ u[i]
        s[i] = -9
        assert len(got[i]) == 10
        hit += len(set(np.argsort(-s)[:10].tolist()) & set(got[i]))
    assert hit >= 0.9 * 10 * len(q)


def test_equal_vectors_beyond_a_partition(spark):
    v = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(i, v) for i in range(400)], "id long, vector array<float>")
    got = nearest(df, spark.createDataFrame([(7,)], "id long"), part_rows=40).collect()
    assert sorted(r.other for r in got) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_what_takes_no_part(spark):
    ok = [1.0, 2.0] + [0.0] * 62
    bad = [(2, None), (3, [0.0] * 64), (4, [1.0] * 32), (5, [None] + ok[1:]), (6, [float("nan")] + ok[1:]), (None, ok), (7, [float("inf")] + ok[1:])]
    df = spark.createDataFrame([(1, ok), (1, ok), (8, [2 * a for a in ok]), *bad], "id long, vector array<float>")
    got = nearest(df, spark.createDataFrame([(i,) for i in range(1, 9)], "id long")).collect()
    assert sorted((r.id, r.other) for r in got) == [(1, 8), (8, 1)] and abs(got[0].cosine - 1) < 1e-5
    assert nearest(df.limit(0), spark.createDataFrame([(1,)], "id long")).count() == 0


def test_vectors_of_another_width(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [1.0] * 64)], "id long, vector array<float>")
    got = [r.other for r in nearest(df, spark.createDataFrame([(3,)], "id long"), width=24).collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 10 and len(set(got) & set(np.argsort(-(u @ u[3]))[1:11].tolist())) >= 9


def test_queries_walk_together():
    """The work grows with blocks of queries, not with steps a query: the distances of a block are one product, and exact."""
    from stratacode.llm import neighbours

    x = cluster(600, 3)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    class Counted(np.ndarray):
        made = 0

        def __getitem__(self, at):
            Counted.made += 1
            return np.asarray(super().__getitem__(at))

    project = neighbours.directions()
    tree = neighbours.Tree(np.arange(600), u, project, leaf=4)
    tree.vectors = tree.vectors.view(Counted)
    got = {q: (i, d) for q, i, d in tree.search(np.arange(600), u, u @ project, np.full(600, 4.0), 10, 1e9)}
    assert Counted.made <= 600 + 3  # one look at the nearest leaves a query, one product a block
    for q, (i, d) in got.items():
        s = 2 - 2 * (u.astype(np.float64) @ u[q].astype(np.float64))
        s[q] = 9
        assert list(i) == list(np.argsort(s, kind="stable")[:10]) and np.allclose(d, np.sort(s)[:10])
