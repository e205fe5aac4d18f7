import random

import numpy as np
import pytest

from stratacode.llm.abuse import PAD, WIDTH, Model, Texts, _word, abuse_scores, fit

GOOD = ["the build is green again after the cache fix", "please rename this function before the release", "i killed the zombie process and freed the memory", "this flaky test makes me sad", "the parser skips a table whose header is empty"]
BAD = ["you are a worthless parasite and a liar", "shut up you pathetic moron", "get lost you disgusting parasite", "nobody needs a moron like you here"]
LEET = {"moron": "m0r0n", "parasite": "p4r4s1t3"}


def corpus(n, seed, share=0.2, noise=0.03):
    rnd = random.Random(seed)
    texts, votes, truth = [], [], []
    for _ in range(n):
        s = [rnd.choice(GOOD) for _ in range(rnd.randrange(2, 7))]
        bad = rnd.random() < share
        if bad:
            b = rnd.choice(BAD)
            for a, c in LEET.items():
                b = b.replace(a, c) if rnd.random() < 0.3 else b
            s.insert(rnd.randrange(len(s) + 1), rnd.choice([b, b.upper(), b.capitalize() + "!!"]))
        texts.append(". ".join(s))
        truth.append(bad)
        votes.append(int(bad != (rnd.random() < noise)))
    return texts, votes, truth


def test_words_are_normalised():
    assert _word("P4R4S1T3") == "parasite" and _word("`x y`") == "0id" and _word("loadUser") == "0id" and _word("1234") == "0nr" and _word("nooooo") == "no"
    t = Texts(["you m o r o n! go", None, "", " ".join(["word"] * 20)])
    words = [[t.words[i] for i in t.ids[a:b]] for a, b in zip(t.start, t.end, strict=True)]
    assert words == [["you", "moron"], ["go"], *[["word"] * WIDTH] * 3] and t.of.tolist() == [0, 0, 3, 3, 3]


@pytest.fixture(scope="module")
def model():
    texts, votes, _ = corpus(700, 1)
    return fit(texts, votes, epochs=4)


def test_held_out_accuracy(model):
    texts, _, truth = corpus(500, 2)
    got = np.array([model.score(t) >= 0.5 for t in texts])
    truth = np.array(truth)
    assert (got == truth).mean() > 0.97 and (got & truth).sum() / truth.sum() > 0.95


def test_windows_by_running_sums(model):
    texts, _, _ = corpus(30, 3)

    def logit(t, a, b):
        flat = np.concatenate([*(t.buckets[t.first[w] : t.first[w + 1]] for w in t.ids[a:b]), t.pairs[a : b - 1]])
        return model.weight[flat].astype(float).sum() / (len(flat) + PAD) + model.bias

    for t in texts:
        one = Texts([t])
        z = max(logit(one, a, b) for a, b in zip(one.start, one.end, strict=True))
        assert abs(model.score(t) - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.allclose(model.scores([*texts, None, ""]), [*(model.score(t) for t in texts), 0.0, 0.0])
    assert model.score(None) == model.score("") == model.score(" \n ") == 0.0 and model.score(". ".join(GOOD * 10_000)) < 0.5


def test_tables(spark):
    texts, votes, _ = corpus(300, 5)
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in enumerate(texts)] + [(900, None, None, 0.0), (901, "", "s", 0.0), (0, texts[0], "s", 1.0)], "doc_id long, text string, source string, abuse double")
    vote = spark.createDataFrame([(i, v) for i, v in enumerate(votes)] + [(None, 1), (1, None), (5, votes[5])], "doc_id long, abusive int")
    rows = abuse_scores(docs, vote).collect()
    assert len(rows) == 303 and {r.doc_id: r.abuse for r in rows}[900] == 0.0
    assert {r.abuse for r in abuse_scores(docs, vote.limit(0)).collect()} <= {0.0, Model(np.zeros(1 << 18, np.float32), -30.0).score("x")}
    assert abuse_scores(docs.limit(0), vote).count() == 0
