"""Problem 8: evaluation texts that leaked into the corpus.

Every window of ``run`` words of an item has a seed, the rarest of its word n-grams that the corpus holds, by their
number of occurrences there; a document with the whole window thus holds its seed. Edited copies need hold no seed, nor
any n-gram of the item; they are sought by two bounds on the alignment score that leave out no pair of ``CLOSE`` or more.
A document so found is aligned with the item: the longest common run of words decides exactly, and a Smith-Waterman
alignment scores edited and paraphrased copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, table

_WORD = re.compile(r"[a-z0-9]+")
RUN, SEED, CLOSE = 13, 5, 0.5
ITEM_BLOCK, BLOCK_CHARS = 2_000, 4_000_000  # of items and their text: what the driver and the tasks hold at once


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _grams(units: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive units; empty for shorter input."""
    if len(units) < width:
        return np.empty(0, np.int64)
    h = np.zeros(len(units) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))
            h = h + units[k : len(units) - width + 1 + k]
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _hits(wanted: np.ndarray, width: int):
    """(doc_id, gram, n) for each wanted gram that a document holds; ``wanted`` is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Hashes()
        for batch in batches:
            docs, flat, lens = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for text in batch.column(1).to_pylist():
                w = words_of(text)
                lens.append(len(w))
                flat += [words[x] for x in w]
            units, rec = np.array(flat, dtype=np.uint64), np.repeat(np.arange(len(lens)), lens)
            h = _grams(units, width)
            if not len(h) or not len(wanted):
                continue
            ok = rec[: len(h)] == rec[width - 1 :]
            ok &= wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            got = pd.DataFrame({"doc_id": docs[rec[: len(h)][ok]], "gram": h[ok]}).groupby(["doc_id", "gram"], as_index=False).size()
            yield pa.RecordBatch.from_arrays([pa.array(got[c].astype("int64")) for c in ("doc_id", "gram", "size")], names=["doc_id", "gram", "n"])

    return run


def _close(items: list[tuple[int, np.ndarray]]):
    """(doc_id, item_id) for each item whose alignment with a document may reach ``CLOSE``; none that does is left out.

    An item of n words then scores n or more: it has n / 2 words or more in common with the document, and as a word of
    the document brings 2 if the item has it and costs 1 if not, some stretch of the document sums up to n.
    """
    ids, lens = np.array([i for i, _ in items], np.int64), np.array([len(w) for _, w in items], np.int64)
    vocabulary, at = np.unique(np.concatenate([np.empty(0, np.uint64), *(w for _, w in items)]), return_inverse=True)
    of = np.split(at, np.cumsum(lens)[:-1])
    key, times = np.unique(at * len(items) + np.repeat(np.arange(len(items)), lens), return_counts=True)
    word, item = key // max(1, len(items)), key % max(1, len(items))
    first = np.searchsorted(word, np.arange(len(vocabulary) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _Hashes(), np.zeros(len(vocabulary) + 1, bool)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = np.array([words[x] for x in words_of(text)], dtype=np.uint64)
                if not len(w) or not len(vocabulary):
                    continue
                d = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
                d = np.where(vocabulary[d] == w, d, len(vocabulary))
                u, n = np.unique(d[d < len(vocabulary)], return_counts=True)
                size = first[u + 1] - first[u]
                entry = np.repeat(first[u] - np.cumsum(size) + size, size) + np.arange(size.sum())
                common = np.bincount(item[entry], np.minimum(times[entry], np.repeat(n, size)), len(items))
                for k in np.flatnonzero(2 * common >= lens):
                    known[of[k]] = True
                    total = np.cumsum(np.r_[0, np.where(known[d], 2, -1)])
                    known[of[k]] = False
                    if (total - np.minimum.accumulate(total)).max() >= lens[k]:
                        out.append((doc, ids[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "item_id"])

    return run


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = 1) -> tuple[int, int]:
    """(best local alignment score, longest common run) of two arrays of word hashes."""
    best = longest = 0
    if not len(a) or not len(b):
        return 0, 0
    h, run, step = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64), gap * np.arange(len(b) + 1)
    for x in a:
        same = b == x
        t = np.zeros(len(b) + 1, np.int64)
        t[1:] = np.maximum(h[:-1] + np.where(same, match, miss), h[1:] - gap)
        h = np.maximum(np.maximum.accumulate(np.maximum(t, 0) + step) - step, 0)
        run[1:] = np.where(same, run[:-1] + 1, 0)
        run[0] = 0
        best, longest = max(best, int(h.max())), max(longest, int(run.max()))
    return best, longest


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = _Hashes()
        arr = lambda s: np.array([words[w] for w in words_of(s)], dtype=np.uint64)
        rows, kept = [], {}
        for doc, item, text, task in pdf.itertuples(index=False):
            if doc not in kept:
                kept = {doc: arr(text)}
            t = arr(task)
            score, run = smith_waterman(t, kept[doc])
            rows.append((doc, item, run, score / (2.0 * max(1, len(t)))))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_words", "alignment"])


def _seeds(items: list[tuple[int, np.ndarray]], grams: np.ndarray, often: np.ndarray, span: int) -> list[tuple[int, int]]:
    """(item_id, gram), distinct: of each window of ``span`` n-grams the rarest that the corpus holds, ties by the n-gram.

    ``grams``, sorted, and ``often`` are the n-grams that the corpus holds and their numbers.
    """
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, often))] = np.arange(len(grams))
    out: set[tuple[int, int]] = set()
    for item, g in items:
        if not len(g) or not len(grams):
            continue
        at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        rank = np.where(grams[at] == g, place[at], len(grams))
        n = max(1, min(span, len(g)))
        best = np.unique(np.lib.stride_tricks.sliding_window_view(rank, n).min(1))
        first = {int(r): int(x) for r, x in zip(rank, g, strict=True)}
        out |= {(item, first[int(r)]) for r in best if r < len(grams)}
    return sorted(out)


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, seed: int = SEED, item_block: int = ITEM_BLOCK, edited: bool = True) -> DataFrame:
    """(doc_id, item_id, run_words, alignment) for each document that holds a seed of an item or is close to one.

    run_words is the longest run of words in common; every pair with ``run`` or more is there. alignment is the
    Smith-Waterman score over the most that the item could reach, 1.0 for a whole verbatim copy; with ``edited`` every
    pair with ``CLOSE`` or more is there, however many other copies the corpus holds. Other pairs are those of a seed.

    Null and blank texts have no words; an item of fewer than ``run`` words is one window of its own and of fewer than
    ``seed`` takes no part. Repeated rows count once, texts are taken whole. The items are worked off in blocks of about
    ``item_block`` items and ``BLOCK_CHARS`` characters, whichever is less, so that what the driver holds and sends to the
    tasks is bounded (one item alone may be longer); the corpus is read once a block.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    tests = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    n, chars = tests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // item_block), -(-chars // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        words, grams, whole = _Hashes(), [], []
        for r in rows:
            units = np.array([words[w] for w in words_of(r.text)], dtype=np.uint64)
            if len(units) >= seed:
                whole.append((r.item_id, units))
            grams.append((r.item_id, _grams(units, seed)))
        wanted = np.unique(np.concatenate([np.empty(0, np.int64), *(g for _, g in grams)]))
        hits = cut(docs.mapInArrow(_hits(wanted, seed), "doc_id long, gram long, n long"))
        often = hits.groupBy("gram").agg(F.sum("n").alias("often")).orderBy("gram").toPandas()  # at most the block's own n-grams
        seeds = _seeds(grams, often["gram"].to_numpy(np.int64), often["often"].to_numpy(np.int64), run - seed + 1)
        pairs = hits.join(spark.createDataFrame(seeds, "item_id long, gram long"), "gram").select("doc_id", "item_id")
        if edited and whole:
            pairs = pairs.union(docs.mapInArrow(_close(whole), "doc_id long, item_id long"))
        pairs = pairs.distinct()
        texts = docs.join(pairs, "doc_id").join(tests.withColumnRenamed("text", "task"), "item_id").select("doc_id", "item_id", "text", "task")
        part = texts.mapInPandas(_align, "doc_id long, item_id long, run_words int, alignment double")
        part = part.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("alignment").alias("alignment"))
        out = part if out is None else out.union(part)
    return out


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an item."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edited=False).where(F.col("run_words") >= RUN).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents with a verbatim run, documents with an edited copy only, the best alignment.

    Below ``CLOSE`` the best alignment is that of the documents that hold a seed; 0.0 where none does.
    """
    got = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    per = got.groupBy("item_id").agg(
        F.count_if(F.col("run_words") >= RUN).alias("verbatim_documents"),
        F.count_if((F.col("run_words") < RUN) & (F.col("alignment") >= CLOSE)).alias("edited_documents"),
        F.round(F.max("alignment"), 4).alias("best_alignment"),
    )
    items = table(spark, sf_dir, "eval_items").select("item_id", "task").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.join(per, "item_id", "left").select("item_id", "task", zero("verbatim_documents"), zero("edited_documents"), F.coalesce("best_alignment", F.lit(0.0)).alias("best_alignment"))
