import random

import numpy as np

from stratacode.llm.contamination import RUN, leaked_items, smith_waterman, words_of

D, I = "doc_id long, text string, clash string", "item_id long, text string, doc_id long"


def test_alignment():
    a = np.arange(20)
    assert smith_waterman(a, np.r_[np.full(5, 99), a, np.full(3, 98)]) == (40, 20)
    cut = np.r_[a[:10], [77], a[11:]]
    assert smith_waterman(a, cut) == (37, 10)
    assert smith_waterman(a, a[:0]) == (0, 0) and smith_waterman(a, a + 100) == (0, 0)


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words_of(t)
        grams = {tuple(w[k : k + RUN]) for k in range(len(w) - RUN + 1)}
        for i, s in items:
            x = words_of(s)
            if any(tuple(x[k : k + RUN]) in grams for k in range(len(x) - RUN + 1)):
                out.add((d, i))
    return out


def test_every_run_is_found(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(8, 60)))) for i in range(25)]
    docs = []
    for d in range(120):
        w = [rnd.choice(words) for _ in range(rnd.randrange(0, 80))]
        s = words_of(rnd.choice(items)[1])
        n, k = rnd.choice([10, 12, 13, 14, 40]), rnd.randrange(0, 30)
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(w[:20] + s[k : k + n] + w[20:]).upper()))
    docs += [(500, None), (501, " "), (502, "word " * 50_000 + items[3][1] + " end"), docs[0]]
    items += [(900, None), (901, "too short"), items[0]]
    got = leaked_items(spark.createDataFrame([(*d, "x") for d in docs], D), spark.createDataFrame([(*i, 1) for i in items], I), item_block=9)
    found = [(r.doc_id, r.item_id) for r in got.where(f"run_words >= {RUN}").collect()]
    assert len(found) == len(set(found)) and set(found) == brute([d for d in docs if d[1]], [i for i in items if i[1]])


def test_edited_copies_score_high_and_empty_tables_give_none(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee at dawn near the old stone bridge"
    w = item.split()
    w[9], w[17] = "when", "close"
    docs = spark.createDataFrame([(1, " ".join(w), ""), (2, "nothing of the kind here", "")], D)
    items = spark.createDataFrame([(1, item, 0)], I)
    (r,) = leaked_items(docs, items).collect()
    assert r.doc_id == 1 and r.run_words < RUN and r.alignment > 0.8
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_edited_copies_beside_a_verbatim_one(spark):
    item = [f"w{k}" for k in range(60)]
    every = lambda n: " ".join("x" if k % n == n - 1 else w for k, w in enumerate(item))
    apart = " ".join(f"{w} x" for w in item)  # no two words of the item stand together, and yet half the score
    texts = [" ".join(item), every(10), every(4), apart, every(2), "y " * 300 + every(10) + " y" * 300]
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], D)
    items = spark.createDataFrame([(1, " ".join(item), 0), (2, "too short", 0)], I)
    got = {r.doc_id: (r.run_words, r.alignment) for r in leaked_items(docs, items).collect() if r.alignment >= 0.5}
    want = {i: smith_waterman(np.array(item), np.array(words_of(t)))[::-1] for i, t in enumerate(texts)}
    assert got == {i: (n, score / 120) for i, (n, score) in want.items() if score >= 60} and set(got) == {0, 1, 2, 3, 5}
