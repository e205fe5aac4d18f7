import random
from collections import Counter

import pytest

from stratacode.llm.mixing import min_cost_flow, mix, plan, token_counts

D, T = "doc_id long, text string, source string, tokens string", "source string, target_share double, max_repeats int"


def test_flow_is_greatest_and_cheapest():
    arcs = [(0, 1, 5, 0), (0, 1, 5, 3), (0, 2, 4, 1), (1, 3, 8, 0), (2, 3, 4, 0), (3, 4, 9, 0)]
    total, flow = min_cost_flow(5, arcs, 0, 4)
    assert total == 9 and sum(f * a[3] for f, a in zip(flow, arcs, strict=True)) == 4


def test_plan_prefers_first_uses_and_honours_caps():
    want, flow = plan({1: 100, 2: 100, 3: 100}, [0.5, 0.5, 0.0], [1, 3, 2], 240)
    assert want == [0.5, 0.5, 0.0] and sum(f for (_, i), f in flow.items() if i == 0) == 120
    assert all(f <= 100 * [1, 3, 2][i] for (_, i), f in flow.items())
    assert plan({}, [1.0], [1])[1] == {} and plan({1: 10}, [0.5, 0.5], [2, 2])[0] == [1.0, 0.0]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(999)) for _ in range(rnd.randrange(5, 40))), "abc"[min(2, i % 7)], "x") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "b", "x") for i in range(0, 60)]
    rows += [(2000, None, "a", "x"), (2001, "", "a", "x"), (2002, "no source", None, "x"), (2003, "other source", "zz", "x"), rows[0], (2004, "long " * 3000, "a", "x")]
    return spark.createDataFrame(rows, D)


def test_shares_are_met_and_caps_hold(spark, docs):
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 1), ("c", 0.2, 1), ("none", 0.1, 2)], T)
    selection, shares = mix(docs, targets)
    rows = {r.source: r for r in shares.collect()}
    assert rows["none"].tokens == 0 and rows["none"].wanted_share == 0
    for s in "abc":
        assert abs(rows[s].share - rows[s].wanted_share) < 0.06
    sel = selection.collect()
    caps = {"a": 3, "b": 1, "c": 1}
    assert len({(r.doc_id, r.source) for r in sel}) == len(sel) and all(1 <= r.uses <= caps[r.source] for r in sel)
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    assert all(text[r.doc_id][1] == r.source for r in sel)
    used = Counter()
    for r in sel:
        used[text[r.doc_id][0]] += r.uses
    assert max(used.values()) <= 3
    again, _ = mix(docs, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sel))


def test_edges(spark, docs):
    targets = spark.createDataFrame([("a", 1.0, 2), ("a", 0.5, 2)], T)
    selection, shares = mix(docs.limit(0), targets)
    assert selection.count() == 0 and [tuple(r) for r in shares.collect()] == [("a", 1.0, 0.0, 0, 0.0, 0)]


def test_many_targets_and_overlapping_sources(spark):
    n = 20
    rows = [(100 * k + i, f"text {k if i < 5 else 0} number {i} of it", f"s{k}", "x") for k in range(n) for i in range(10)]  # five texts stand in all sources
    selection, shares = mix(spark.createDataFrame(rows, D), spark.createDataFrame([(f"s{k}", 1 / n, 2) for k in range(n)], T))
    got = shares.collect()
    assert len(got) == n and all(abs(r.share - 1 / n) < 0.03 for r in got)
    assert all(1 <= r.uses <= 2 for r in selection.collect())


def test_buckets_do_not_change_what_is_mixed(spark, docs, monkeypatch):
    from stratacode.llm import mixing

    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.2, 1), ("c", 0.2, 1)], T)
    monkeypatch.setattr(mixing, "BUCKET_ITEMS", 7)
    selection, shares = mix(docs, targets)
    assert all(abs(r.share - r.wanted_share) < 0.06 for r in shares.collect()) and selection.count() > 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "a", ""), (2, "<|endoftext|>", "a", ""), (3, None, "a", "")], D)
    got = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] > 1 and 3 not in got
