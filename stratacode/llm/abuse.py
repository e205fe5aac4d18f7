"""Problem 10: abusive, hateful or sexual content.

A text is read as overlapping windows of words. A window is the average of the embeddings of its subwords (whole words,
character n-grams and word pairs, hashed) under a linear softmax; embeddings and softmax are trained together in numpy,
so that an unseen misspelling is close to the words it shares n-grams with. Votes are on whole texts: training picks in
each text voted abusive the windows that explain the vote, and sets aside votes that no window explains. A text's score
is that of its worst window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table

BUCKETS, DIM, WIDTH, STRIDE, PAD = 1 << 18, 16, 12, 4, 24
TRAIN_ROWS = 10_000
TELLING = 16.0
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*\-_][^\W\d_]){3,}(?![^\W_])")
_PIECE = re.compile(r"[.!?…:;]+(?=\s|$)|\n+|```")
_TOKEN = re.compile(r"`[^`\n]*`|[\w@$*']+")
_LEET = str.maketrans("013457@$8", "oieastasb")
_RUN = re.compile(r"(.)\1{2,}")
_CAMEL = re.compile(r"[a-z][A-Z]|[A-Z]{2,}[a-z]|\w_\w")


def _word(raw: str) -> str:
    """The normal form of a token: names of code become one token, digits and signs amid letters become letters."""
    if raw[0] == "`" or (_CAMEL.search(raw) and not raw.isupper()) or ("_" in raw.strip("_")):
        return "0id"
    w = raw.strip("_*'").lower()
    if w.isdigit() or not w:
        return "0nr"
    if not w.isalpha() and any(c.isalpha() for c in w):
        w = w.translate(_LEET).replace("*", "").replace("'", "")
    return _RUN.sub(r"\1", w)


_PART = re.compile(r"`[^`\n]*`|[\w@$*']+|\n+")


def parts_of(text: str) -> list[str]:
    """The raw tokens of a text; a line end stands for each end of a piece, a sentence or line."""
    return _PART.findall(_PIECE.sub("\n", _SPACED.sub(lambda m: m.group(0)[::2], text)))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class _Features(dict):
    """Word -> the buckets of its subwords; the first is the word's own."""

    def __missing__(self, word: str) -> np.ndarray:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        parts = [word]
        if word[0] != "0":
            s = f"<{word}>"
            parts += {s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1)}
        got = self[word] = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], dtype=np.uint64)
        return got


_FEATURES = _Features()


class _Numbers(dict):
    """Raw token -> the number of its normal form; -1 for the end of a piece."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}

    def __missing__(self, raw: str) -> int:
        got = self[raw] = -1 if raw[0] == "\n" else self.of.setdefault(_word(raw), len(self.of))
        return got


class Texts:
    """Texts as flat arrays: the words, numbered, of all pieces; the pair that a word makes with the next; the windows."""

    def __init__(self, texts: list[str | None]) -> None:
        number = _Numbers()
        flat: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                flat += [number[x] for x in parts_of(text)]
            flat.append(-1)
            ends[k] = len(flat)
        every = np.array(flat, np.int64)
        stops = np.flatnonzero(every < 0)
        size = np.diff(np.r_[-1, stops]) - 1
        owner = np.searchsorted(ends, stops, side="right")[size > 0]
        size = size[size > 0]
        self.n_texts, self.words, self.ids = len(texts), list(number.of), every[every >= 0]
        feats = [_FEATURES[w] for w in self.words]
        self.count = np.array([len(f) for f in feats], np.int64)
        self.first = np.r_[0, np.cumsum(self.count)]
        hashes = np.concatenate([np.empty(0, np.uint64), *feats])
        self.buckets = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        own = hashes[self.first[:-1]][self.ids] if len(self.ids) else np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            self.pairs = (_mix(own[:-1] * np.uint64(3) + _mix(own[1:])) % np.uint64(BUCKETS)).astype(np.int64)
        begin = np.cumsum(size) - size
        n = np.where(size <= WIDTH, 1, -(-(size - WIDTH + STRIDE) // STRIDE))
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start = np.repeat(begin, n) + STRIDE * step
        self.end = np.minimum(self.start + WIDTH, np.repeat(begin + size, n))
        self.of = np.repeat(owner, n)

    def logits(self, weight: np.ndarray, bias: float) -> np.ndarray:
        """The logit of each window: the average of its subwords' weights by differences of running sums."""
        if not len(self.start):
            return np.empty(0)
        word = np.add.reduceat(weight[self.buckets].astype(np.float64), self.first[:-1])
        total, some = np.r_[0, np.cumsum(word[self.ids])], np.r_[0, np.cumsum(self.count[self.ids])]
        pair = np.r_[0, np.cumsum(weight[self.pairs].astype(np.float64))]
        s = total[self.end] - total[self.start] + pair[self.end - 1] - pair[self.start]
        return s / (some[self.end] - some[self.start] + self.end - 1 - self.start + PAD) + bias

    def worst(self, logits: np.ndarray) -> np.ndarray:
        """The greatest logit of each text, -inf without words."""
        out = np.full(self.n_texts, -np.inf)
        np.maximum.at(out, self.of, logits)
        return out


class Model:
    """One number per bucket and a bias (an average counts ``PAD`` empty places, so that few words prove little): the difference of the two classes' logits, all that scoring needs."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the worst window of each text; 0 for one without words."""
        t = Texts(texts)
        z = t.worst(t.logits(self.weight, self.bias))
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _run(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, ``n`` of each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _sum_by(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the sum of their rows)."""
    by = np.argsort(key)
    key = key[by]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.add.reduceat(rows[by], at, axis=0)


def _train(t: Texts, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, seed: int) -> Model:
    """Embeddings and softmax by Adagrad over some windows of ``t``; the loss of a window is weighted.

    A batch looks up each of its words once: its vector is the sum of its subwords', and so is its gradient shared out.
    """
    rng = np.random.default_rng(seed)
    emb = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    soft += rng.normal(0, 0.1, soft.shape).astype(np.float32)
    size, lr = 128, 0.25
    start, length = t.start[windows], (t.end - t.start)[windows]
    buckets, weight = t.buckets.astype(np.int32), weight.astype(np.float32)
    pairs = t.pairs.astype(np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), size):
            at = order[i : i + size]
            n, row = length[at], np.arange(len(at))
            word, occurs = np.unique(t.ids[_run(start[at], n)], return_inverse=True)
            of_word, some = buckets[_run(t.first[word], t.count[word])], t.count[word]
            of_pair, pair_row = pairs[_run(start[at], n - 1)], np.repeat(row, n - 1)
            vector = np.add.reduceat(emb[of_word], np.cumsum(some) - some, axis=0)
            pair = np.r_[np.zeros((1, DIM), np.float64), np.cumsum(emb[of_pair], axis=0, dtype=np.float64)]
            ends = np.cumsum(n - 1)
            total = np.add.reduceat(vector[occurs], np.cumsum(n) - n, axis=0) + (pair[ends] - pair[ends - n + 1]).astype(np.float32)
            inverse = (1 / (np.add.reduceat(some[occurs], np.cumsum(n) - n) + n - 1 + PAD)).astype(np.float32)[:, None]
            hidden = total * inverse
            z = hidden @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[row, y[at]] -= 1
            p *= weight[at][:, None]
            back = (p @ soft.T) * inverse
            gs, gb = hidden.T @ p / size, p.mean(0)
            g_soft += gs * gs
            g_bias += gb * gb
            soft -= lr * gs / np.sqrt(g_soft)
            bias -= lr * gb / np.sqrt(g_bias)
            _, by_word = _sum_by(occurs, back[np.repeat(row, n)])
            key, ge = _sum_by(np.r_[of_word, of_pair], np.concatenate([np.repeat(by_word, some, axis=0), back[pair_row]]))
            g_emb[key] += (ge * ge).mean(1)
            emb[key] -= lr * ge / np.sqrt(g_emb[key])[:, None]
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(texts: list[str], votes: list[int], rounds: int = 3, epochs: int = 6, negatives: int = 30_000, seed: int = 17) -> Model:
    """Trains on voted texts. Deterministic for the same rows in the same order; without both kinds of votes every score is 0."""
    rng = np.random.default_rng(seed)
    t = Texts(texts)
    vote = np.array(votes, np.int64)
    has = np.zeros(len(texts), bool)
    has[t.of] = True
    n_pos, n_neg = int((has & (vote == 1)).sum()), int((has & (vote == 0)).sum())
    if not n_pos or not n_neg:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    base = n_pos / (n_pos + n_neg)
    # how many texts of each vote hold a unit: a word or a pair of words of one window
    n = t.end - t.start
    at, of, last, row = _run(t.start, n), np.repeat(t.of, n), np.repeat(t.end, n) - 1, np.repeat(np.arange(len(n)), n)
    v = len(t.words)
    unit = np.r_[t.ids[at], v + t.ids[at[at < last]] * v + t.ids[at[at < last] + 1]]
    units, unit = np.unique(unit, return_inverse=True)
    seen = np.unique(unit * len(texts) + np.r_[of, of[at < last]])
    held = np.bincount(seen // len(texts), minlength=len(units))
    p = np.bincount(seen // len(texts), weights=vote[seen % len(texts)], minlength=len(units))
    share = p / held
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (p * np.log(share / base) + np.where(held > p, (held - p) * np.log((1 - share) / (1 - base)), 0.0))
    # log-likelihood ratio of a unit that most of its texts' votes call abusive; 0 if chance explains it
    odds = np.where((share >= 0.5) & (share > base) & (g > TELLING), g, 0.0)
    whole = odds[unit]
    rank = np.bincount(row, weights=whole[: len(at)], minlength=len(n)) + np.bincount(row[at < last], weights=whole[len(at) :], minlength=len(n))

    model, abusive = None, vote[t.of] == 1
    for r in range(rounds):
        score = t.logits(model.weight, model.bias) if model else rank
        top = t.worst(score)
        # in each text voted abusive the windows that explain the vote; a vote that none explains is set aside
        explained = abusive & (top[t.of] > 0)
        first = np.zeros(len(score), bool)
        best = np.flatnonzero(explained & (score == top[t.of]))
        first[best[np.unique(t.of[best], return_index=True)[1]]] = True
        pos = np.flatnonzero(explained & (first | (score > (0.5 if model else 0.6 * top[t.of]))))
        hard = np.flatnonzero(~abusive | (explained & ~first & (score <= 0.5) & (score < -2)) if model else ~abusive)
        worst = np.argsort(-score[hard], kind="stable")[: negatives // 3]
        pick = hard[np.unique(np.r_[worst, rng.choice(len(hard), min(len(hard), negatives), replace=False)])]
        y = np.array([1] * len(pos) + [0] * len(pick))
        weight = np.array([max(1.0, 0.05 * len(pick) / max(1, len(pos)))] * len(pos) + [1.0] * len(pick), np.float32)
        model = _train(t, np.r_[pos, pick], y, weight, epochs if r == rounds - 1 else max(1, epochs // 2), seed + r)
    return model


def _scorer(weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weight, bias)
        for b in batches:
            s = model.scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "source", "abuse"])

    return run


def abuse_scores(documents: DataFrame, votes: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, source, abuse): a score from 0 to 1 for every document.

    The model is fitted on at most ``train_rows`` voted documents, those with the smallest hash of doc_id; a document
    with several votes counts by their majority, a tie as abusive. Null and blank texts score 0; repeated rows stay
    rows of their own; texts are read whole. Without votes of both kinds every score is 0.
    """
    vote = votes.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg((F.avg("abusive") >= 0.5).cast("int").alias("abusive"))
    few = vote.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = documents.select("doc_id", "text").where("text is not null").join(few, "doc_id").groupBy("doc_id", "abusive").agg(F.max("text").alias("text"))
    rows = texts.orderBy("doc_id").toPandas()
    model = fit(rows["text"].tolist(), rows["abusive"].tolist())
    return documents.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(_scorer(model.weight, model.bias), "doc_id long, source string, abuse double")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("abuse >= 0.5").select("doc_id").distinct()


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive documents and their rate per source; a missing source is a source of its own (null)."""
    got = _scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("abuse") >= 0.5).alias("abusive"))
    return got.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
