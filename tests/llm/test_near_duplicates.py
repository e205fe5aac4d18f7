import random
import re

import pytest

from stratacode.llm.fragment_join import expand_pairs, repo_key, similar_sets
from stratacode.llm.near_duplicates import FIELDS, near_duplicate_groups, near_duplicate_pairs, records

SCHEMA = "field int, scope long, id long, text string"


def brute(rows):
    sets = {}
    for field, scope, i, text in rows:
        if i is None or not text or not text.strip():
            continue
        f = FIELDS[field]
        if f.by_words:
            w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", text)]
            s = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 30 else set()
        else:
            t = repo_key(text) if f.repo_key else text.lower()
            s = {t[k : k + 3] for k in range(len(t) - 2)}
        if s:
            sets[field, scope if scope is not None else -1, i] = s
    out = set()
    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a[:2] == b[:2] and a[2] < b[2]:
                f, n = FIELDS[a[0]], len(sets[a] & sets[b])
                if n * f.q >= f.p * (len(sets[a]) + len(sets[b]) - n):
                    out.add((f.name, a[2], b[2]))
    return out


def sample(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randrange(25, 60))]
        rows.append((0, 0, 3 * i, " ".join(text)))
        for k in (1, 2):
            copy = list(text)
            for _ in range(rnd.randrange(0, 12)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((0, 0, 3 * i + k, rnd.choice([" ", "\n", "; "]).join(copy).upper()))
        rows.append((1, i % 3, i, f"src/{rnd.choice('abc')}/name_{i // 2}{rnd.choice(['', '2', '_test'])}.py"))
        rows.append((2, 0, i, f"https://h{i}.example/owner{i // 3}/repo-{i // 2}{rnd.choice(['', '.git', '/', 'x'])}"))
    rows += [rows[0], (0, 0, 900, None), (0, 0, 901, " \n"), (0, 0, None, rows[0][3]), (1, 0, 902, "ab"), (2, 0, 903, " "), (0, 0, 904, rows[0][3]), (0, 0, 905, rows[0][3] + " " + "long " * 30_000)]
    return rows


@pytest.mark.parametrize("seed,block,fragment", [(1, 200, 100), (2, 10**6, 10**6)])
def test_pairs_match_brute_force(spark, seed, block, fragment):
    rows = sample(seed)
    pairs, classes = similar_sets(spark.createDataFrame(rows, SCHEMA).repartition(3), FIELDS, block, fragment)
    got = [(FIELDS[r.field].name, r.id_a, r.id_b) for r in expand_pairs(pairs, classes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_groups_close_over_links(spark):
    rows = sample(3)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for f, a, b in brute(rows):
        x, y = sorted((find((f, a)), find((f, b))))
        parent[y] = x
    got = {(r.field_name, r.id): r.group_id for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: find(k)[1] for k in list(parent)}


def test_the_tables_and_their_edges(spark):
    code = " ".join(f"x{k}" for k in range(40))
    fn = spark.createDataFrame([(1, code, "c"), (2, code, "c"), (2, code, "c"), (3, None, "c")], "id long, code_snippet string, scope string")
    fl = spark.createDataFrame([(1, 1, "src/a/file_name.py"), (2, 1, "SRC/a/file_name.py"), (3, 2, "src/a/file_name.py"), (4, None, "src/a/file_name.py")], "id long, project_id long, file_path string")
    pr = spark.createDataFrame([(1, "git@h:a/bcd.git"), (2, "https://other/A/BCD/"), (3, " "), (4, None)], "id long, repo_url string")
    got = {tuple(r) for r in near_duplicate_pairs(records(fn, fl, pr)).collect()}
    assert got == {("code_snippet", 1, 2), ("file_path", 1, 2), ("repo_url", 1, 2)}
    assert near_duplicate_pairs(records(fn.limit(0), fl.limit(0), pr.limit(0))).count() == 0


def test_many_copies_are_one_class_and_all_paired(spark):
    code = " ".join(f"x{k}" for k in range(40))
    rows = [(0, 0, i, code) for i in range(70)] + [(0, 0, 1000, code + " y z")]
    pairs, classes = similar_sets(spark.createDataFrame(rows, SCHEMA), FIELDS, 2000, 500)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1000)] and classes.count() == 71
    for most in (512, 16):
        got = [(r.id_a, r.id_b) for r in expand_pairs(pairs, classes, most).collect()]
        assert len(got) == len(set(got)) == 71 * 70 // 2
    groups = near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.class_id, r.group_id, r.links) for r in groups} == {(0, 0, 1), (1000, 0, 1)} and len(groups) == 71


@pytest.mark.parametrize("most,holders", [(512, 2000), (7, 5)])
def test_large_classes_and_hot_ngrams_are_paired_whole(spark, most, holders):
    words = [f"x{k}" for k in range(40)]
    rows = [(0, 0, i, (" " * (i // 4 + 1)).join(words)) for i in range(100)]
    rows += [(0, 0, 200 + i, " ".join([*words, f"y{i}", f"z{i}"])) for i in range(70)]
    rows += [(2, 0, i, f"https://host{i}.example/owner/repository{i % 9}") for i in range(70)]
    pairs, classes = similar_sets(spark.createDataFrame(rows, SCHEMA), FIELDS, holders=holders)
    found = [(FIELDS[r.field].name, r.id_a, r.id_b) for r in expand_pairs(pairs, classes, most).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


@pytest.mark.parametrize("base", [2**61, -(2**62), 2**58 + 1])
def test_groups_of_hashed_ids(spark, base):
    code = [f"x{k}" for k in range(40)]
    rows = [(0, 0, base + i, " ".join(code + ["y"] * (i % 3))) for i in range(3)] + [(1, 0, base + i, f"src/a/quite_long_file_name{i}.py") for i in range(2)]
    got = {(r.field_name, r.id): (r.class_id, r.group_id) for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: base for k in got} and len(got) == 5
    pairs, classes = similar_sets(spark.createDataFrame(rows, SCHEMA), FIELDS)
    assert expand_pairs(pairs, classes).count() == 4


def test_an_id_with_two_texts_is_no_pair_of_its_own(spark):
    code = " ".join(f"x{k}" for k in range(40))
    rows = [(0, 0, 1, code), (0, 0, 1, code + " y"), (0, 0, 2, code)]
    got = {tuple(r) for r in near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("code_snippet", 1, 2)}


def test_copies_leave_before_counting_and_what_was_written_goes(spark, monkeypatch):
    """Only one of many copies is counted, and neither blocks nor n-grams stay written once the pairs are known."""
    import os

    from stratacode import session
    from stratacode.llm import fragment_join

    held, cut = [], fragment_join.cut

    def seen(df):
        out = cut(df)
        held.append(("tokens" in out.columns and out.count(), out._cut_path.removeprefix("file://")))
        return out

    monkeypatch.setattr(fragment_join, "cut", seen)
    words = [f"w{k}" for k in range(40)]
    rows = [(0, 0, i, " ".join(words)) for i in range(30)] + [(0, 0, 30, " ".join(words[:-1] + ["other"])), (0, 0, 31, " ".join(reversed(words)))]
    pairs, classes = similar_sets(spark.createDataFrame(rows, SCHEMA).repartition(3), FIELDS, block_tokens=100)
    got = {(FIELDS[r.field].name, r.id_a, r.id_b) for r in expand_pairs(pairs, classes).collect()}
    assert got == brute(rows) and len(got) == 31 * 30 // 2
    assert [n for n, p in held if n][-1] == 2  # the copies' one and its neighbour
    assert not any(os.path.exists(p) for n, p in held if n) and session._CUTS


def test_few_trigrams_give_no_flood_of_candidates(spark, monkeypatch):
    """URLs made of few trigrams meet in many prefixes; nearly all of these pairs leave before they are shuffled, and the blocks are written once."""
    from stratacode.llm import fragment_join

    held, cut = [], fragment_join.cut

    def seen(df):
        out = cut(df)
        held.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(fragment_join, "cut", seen)
    rnd = random.Random(5)
    part = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(9, 14)))
    urls = [f"https://h.example/{part()}/{part()}" for _ in range(600)]
    rows = [(2, 0, i, u) for i, u in enumerate([*urls, *(u + "x" for u in urls[:40])])]
    pairs, classes = similar_sets(spark.createDataFrame(rows, SCHEMA), FIELDS)
    found = {(FIELDS[r.field].name, r.id_a, r.id_b) for r in expand_pairs(pairs, classes).collect()}
    assert found == brute(rows) and len(found) >= 40
    assert next(n for c, n in held if "n_a" in c and "overlap" not in c) < 2 * len(found)
    assert sum("tokens" in c for c, _ in held) == 2  # the blocks and what is left of them


@pytest.mark.parametrize("spare", [-9, -4])
def test_ngrams_that_look_equal_when_counted_change_no_result(spark, monkeypatch, spare):
    from stratacode.llm import fragment_join

    monkeypatch.setattr(fragment_join, "_SPARE_BITS", spare)
    rows = sample(4)
    pairs, classes = similar_sets(spark.createDataFrame(rows, SCHEMA).repartition(3), FIELDS, 20_000, 10_000)
    found = [(FIELDS[r.field].name, r.id_a, r.id_b) for r in expand_pairs(pairs, classes).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


@pytest.mark.parametrize("numbers", [[0], [0, 1, 255], [256, 0, 2**31], [2**64 - 1, 3]])
def test_packed_numbers_come_back(numbers):
    import numpy as np

    from stratacode.llm.fragment_join import _packed, _unpacked

    x = np.array(numbers, np.uint64)
    assert _unpacked(_packed(x), len(x)).tolist() == numbers
