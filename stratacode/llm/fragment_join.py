"""Set-similarity self-join by vertical partitioning of the n-gram order.

Records become sets of hashed n-grams. The global order of the n-grams is by how many records hold them, rarest
first, and it is cut into fragments twice:

1. Of records with equal sets, by a 128-bit key and the size, one representative stays; the others leave before anything
   is counted. To count the n-grams, every block of representatives sends each of its distinct n-grams once, with a count, to the
   fragment of its hash range; the fragment answers with the counts alone, in the order of the n-grams. A hot n-gram
   thus costs one entry a block, wherever a third of all records may hold it. N-grams are sent and counted by their
   hash's first bits, eight more than would number them all: a count may then be too high, never too low, and orders
   the n-grams in the same way for every record, which is all that the following needs. Overlaps are of whole hashes.
2. A representative with fewer shared n-grams than the threshold demands leaves here. A pair of the others is a candidate if the rare ends of both orders meet and the
   length and position bounds hold and a bitmap of each set (128 bits, each odd or even by the n-grams that fall on it)
   leaves room for the overlap demanded. Its overlap is then counted per fragment of the frequency order (cut at powers
   of two) and summed over the fragments. An n-gram that very many representatives keep as one of their rarest meets
   itself in pairs of blocks of ``HOLDERS``, each a key of its own.

The tasks in Python are bounded by n-grams, ``_TASK_TOKENS``, and so grow in number with the input, not in size; the
joins are Spark's own, which spill and are split by size. The result is exact up to collisions of 64-bit n-gram hashes; nothing is capped or sampled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, drop_cut, parts

_WORD = re.compile(r"[A-Za-z0-9_]+")
_U = np.uint64
_BLOCK_TOKENS = 300_000
_FRAGMENT_TOKENS = 1_500_000
_TASK_TOKENS = 400_000
MEMBERS = 512
HOLDERS = 2_000
_SPARE_BITS = 8  # of the n-grams that only one record holds, about one in 2 ** 8 or fewer are taken for shared


@dataclass(frozen=True)
class SetField:
    """How one field becomes sets: ``code`` below 100, ``words`` or characters, the threshold ``p``/``q``."""

    code: int
    name: str
    p: int
    q: int
    by_words: bool
    least_words: int = 0
    repo_key: bool = False
    width: int = 3


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), without overflow warnings."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def repo_key(url: str) -> str:
    """owner/name of a repository URL in any notation."""
    s = url.strip().lower().rstrip("/")
    s = s[:-4] if s.endswith(".git") else s
    return "/".join(re.split(r"[/:]", s)[-2:])


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return got


def _ngrams(units: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive units within each record, and the record of each."""
    rec = np.repeat(np.arange(len(lens)), lens)
    if len(units) < width:
        return np.empty(0, _U), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = mix(units[: len(units) - width + 1] + _U(0x9E3779B97F4A7C15))
        for k in range(1, width):
            h = mix(h * _U(3) + units[k : len(units) - width + 1 + k])
    ok = rec[: len(rec) - width + 1] == rec[width - 1 :]
    return h[ok], rec[: len(rec) - width + 1][ok]


def _sets(field: SetField, scopes: np.ndarray, texts: list[str], words: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted by text, and their number per text."""
    if field.by_words:
        units, lens = [], np.zeros(len(texts), np.int64)
        for i, s in enumerate(texts):
            w = _WORD.findall(s)
            if len(w) >= field.least_words:
                lens[i] = len(w)
                units += [words[x] for x in w]
        flat = np.array(units, dtype=_U)
    else:
        keys = [repo_key(s) if field.repo_key else s.lower() for s in texts]
        raw = [k.encode("utf-32-le", "surrogatepass") for k in keys]
        lens = np.array([len(b) // 4 for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(_U)
    h, rec = _ngrams(flat, lens, field.width)
    with np.errstate(over="ignore"):
        h = mix(h ^ mix(scopes.astype(np.int64).view(_U)[rec] * _U(131) + _U(field.code)))
    order = np.lexsort((h, rec))
    h, rec = h[order], rec[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
    return h[first], np.bincount(rec[first], minlength=len(texts))


_BLOCK = "block long, tokens_n long, recs binary, fields binary, sizes binary, key_a binary, key_b binary, tokens binary"


def _build_blocks(fields: dict[int, SetField], block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            recs, codes, ns, ka, kb, toks = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[uuid.uuid4().int >> 65], [int(ns.sum())], *([x.tobytes()] for x in (recs, codes, ns, ka, kb, toks))]
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(row, [pa.int64(), pa.int64(), *[pa.binary()] * 6], strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            code = batch.column("field").to_numpy(zero_copy_only=False)
            scope = batch.column("scope").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            text = batch.column("text")
            for c in np.unique(code):
                rows = np.flatnonzero(code == c)
                toks, ns = _sets(fields[int(c)], scope[rows], text.take(pa.array(rows)).to_pylist(), words)
                rec = np.repeat(np.arange(len(rows)), ns)
                with np.errstate(over="ignore"):
                    a, b = np.zeros(len(rows), _U), np.zeros(len(rows), _U)
                    np.add.at(a, rec, mix(toks))
                    np.add.at(b, rec, mix(toks * _U(0xD6E8FEB86659FD93) + _U(7)))
                k = ns > 0
                held.append((ids[rows][k].astype(np.int64), np.full(int(k.sum()), c, np.int8), ns[k].astype(np.int32), a[k], b[k], toks))
                size += len(toks)
            if size >= block_tokens:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    return run


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 0 or more byte by byte, lowest bytes first, so that what is mostly zero compresses well; no zero bytes above the largest."""
    wide = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, : max(1, -(-int(x.max()).bit_length() // 8))].T).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return wide.view("<u8").ravel()


def _chosen(b, places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, fields, sizes and n-grams of the records of a block at these places."""
    ns = np.frombuffer(b.sizes, np.int32).astype(np.int64)
    k = np.zeros(len(ns), bool)
    for x in places:
        k[np.asarray(x)] = True
    return np.frombuffer(b.recs, np.int64)[k], np.frombuffer(b.fields, np.int8)[k], ns[k], np.frombuffer(b.tokens, _U)[np.repeat(k, ns)]


def _to_fragments(n_fragments: int, bits: int):
    """The distinct n-grams of a block's chosen records, by their first ``bits`` bits, as steps from one to the next."""

    def run(blocks: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in blocks.itertuples(index=False) if len(chosen) else ():
            codes, counts = np.unique(_chosen(b, chosen.places)[3] >> _U(64 - bits), return_counts=True)
            frag = ((codes >> _U(max(0, bits - 32))) * _U(n_fragments)) >> _U(min(bits, 32))
            cuts = np.searchsorted(frag, np.arange(n_fragments + 1).astype(_U))
            out += [(f, b.block, j - i, _packed(np.diff(codes[i:j], prepend=_U(0))), _packed(counts[i:j])) for f, i, j in zip(range(n_fragments), cuts[:-1], cuts[1:], strict=True) if j > i]
        return pd.DataFrame(out, columns=["fragment", "block", "size", "steps", "counts"])

    return run


def _count_fragment(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers each block with the number of records that hold each of its n-grams, in the order of the n-grams."""
    flat = np.concatenate([np.cumsum(_unpacked(x, n), dtype=_U) for x, n in zip(pdf.steps, pdf["size"], strict=True)])
    uniq, at = np.unique(flat, return_inverse=True)
    df = np.bincount(at, weights=np.concatenate([_unpacked(x, n) for x, n in zip(pdf["counts"], pdf["size"], strict=True)]), minlength=len(uniq)).astype(np.int64)
    df, out, i = np.minimum(df, 2**31 - 1)[at], [], 0
    for fragment, block, n in zip(pdf.fragment, pdf.block, pdf["size"], strict=True):
        out.append((block, fragment, n, _packed(df[i : i + n]), None))
        i += n
    return pd.DataFrame(out, columns=["block", "fragment", "size", "dfs", "places"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each block with their key and place in it."""
    for batch in batches:
        for b in batch.to_pylist():
            code = np.frombuffer(b["fields"], np.int8).astype(np.int32)
            ids, ka, kb = (np.frombuffer(b[c], np.int64) for c in ("recs", "key_a", "key_b"))
            cols = [code, ids, np.frombuffer(b["sizes"], np.int32), ka, kb, np.full(len(ids), b["block"]), np.arange(len(ids), dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["field", "id", "n", "key_a", "key_b", "block", "place"])


def _survivors(fields: dict[int, SetField], bits: int):
    p_of = np.zeros(128, np.int64)
    q_of = np.ones(128, np.int64)
    for c, f in fields.items():
        p_of[c], q_of[c] = f.p, f.q

    def run(blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """``told``: the answers to a block, and a row with the places of its chosen records."""
        out, cols = [], ["field", "class_id", "n", "need", "tokens", "dfs", "odd_a", "odd_b"]
        answers = told[told.places.isna()].sort_values("fragment")
        for b in blocks.itertuples(index=False) if len(answers) else ():
            ids, code, ns, toks = _chosen(b, told.places.dropna())
            # fragments are ranges of hashes, so their answers one after the other are those of the sorted n-grams
            known_df = np.concatenate([_unpacked(x, n) for x, n in zip(answers.dfs, answers["size"], strict=True)]).astype(np.int32)
            df = known_df[np.unique(toks >> _U(64 - bits), return_inverse=True)[1]]
            rec = np.repeat(np.arange(len(ns)), ns)
            need = -(-ns * p_of[code] // q_of[code])
            keep = np.bincount(rec[df > 1], minlength=len(ns)) >= need
            m = (df > 1) & keep[rec]
            toks, df, rec = toks[m], df[m], rec[m]
            order = np.lexsort((toks, df, rec))
            toks, df, rec = toks[order], df[order], rec[order]
            live = np.flatnonzero(keep)
            cuts = np.searchsorted(rec, np.append(live, len(ns)))
            bit, half = _U(1) << (toks & _U(63)), (toks >> _U(6)) & _U(1)
            odd = [np.bitwise_xor.reduceat(np.where(half == h, bit, _U(0)), cuts[:-1]).view(np.int64) if len(live) else () for h in (0, 1)]
            toks = toks.view(np.int64)
            out += [(int(code[r]), ids[r], ns[r], need[r], toks[i:j], df[i:j], x, y) for r, i, j, x, y in zip(live, cuts[:-1], cuts[1:], *odd, strict=True)]
        return pd.DataFrame(out, columns=cols)

    return run


def _total(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("tokens_n"), F.lit(0))).first()[0]


def similar_sets(records: DataFrame, fields: list[SetField], block_tokens: int = _BLOCK_TOKENS, fragment_tokens: int = _FRAGMENT_TOKENS, holders: int = HOLDERS) -> tuple[DataFrame, DataFrame]:
    """The exact self-join: ``(pairs, classes)``.

    ``records``: (field int, scope bigint, id bigint, text string). Sets are compared within a field and scope.
    ``classes``: (field, class_id, id), one row for each record with an n-gram; records with equal sets have one class,
    named by its smallest id. ``pairs``: (field, a, b, overlap, n_a, n_b) between class
    ids, a < b, for all pairs of different sets that reach the field's threshold.

    Null ids, null or blank texts and texts too short for one n-gram take no part; repeated rows are one record; texts
    of any length are taken whole; ties do not exist, the threshold is inclusive. An empty input gives empty results.
    """
    by_code = {f.code: f for f in fields}
    clean = records.select(F.col("field").cast("int"), F.coalesce("scope", F.lit(-1)).cast("long").alias("scope"), F.col("id").cast("long"), "text")
    clean = clean.where(r"id is not null and text is not null and text rlike '\\S'")
    blocks = cut(clean.mapInArrow(_build_blocks(by_code, block_tokens), _BLOCK))
    n = max(parts(records.sparkSession), -(-_total(blocks) // _TASK_TOKENS))

    # equal sets first: all but one of them leave before an n-gram is counted
    listed = cut(blocks.select("block", "recs", "fields", "sizes", "key_a", "key_b").mapInArrow(_listed, "field int, id long, n int, key_a long, key_b long, block long, place int"))
    key = ["field", "key_a", "key_b", "n"]
    least = cut(listed.groupBy(*key).agg(F.min(F.struct("id", "block", "place")).alias("x")).select(*key, F.col("x.id").alias("class_id"), "x.block", "x.place"))
    classes = cut(listed.join(least.select(*key, "class_id"), key).select("field", "class_id", "id").distinct())
    drop_cut(listed)
    chosen = least.groupBy("block").agg(F.collect_list("place").alias("places"))  # no more than a block's records

    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_fragments = max(8, -(-total // fragment_tokens))
    bits = max(1, min(64, int(total).bit_length() + _SPARE_BITS))
    # one shuffle of the blocks serves both the counting and what comes of it
    near_by = blocks.select("block", "recs", "fields", "sizes", "tokens").repartition(n, "block").groupBy("block")
    answers = (
        near_by.cogroup(chosen.repartition(n, "block").groupBy("block"))
        .applyInPandas(_to_fragments(n_fragments, bits), "fragment int, block long, size int, steps binary, counts binary")
        .repartition(n_fragments, "fragment")
        .groupBy("fragment")
        .applyInPandas(_count_fragment, "block long, fragment int, size int, dfs binary, places array<int>")
    )
    told = answers.union(chosen.select("block", F.lit(-1), F.lit(0), F.lit(None).cast("binary"), "places"))
    reps = cut(near_by.cogroup(told.repartition(n, "block").groupBy("block")).applyInPandas(_survivors(by_code, bits), "field int, class_id long, n int, need int, tokens array<long>, dfs array<int>, odd_a long, odd_b long"))
    drop_cut(blocks)
    drop_cut(least)

    posting = reps.select("field", "class_id", "n", "odd_a", "odd_b", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("need") + 1)).alias("pos", "token"), (F.size("tokens")).alias("shared"))
    posting = posting.withColumn("rest", F.col("shared") - F.col("pos")).drop("pos")
    hot = posting.groupBy("field", "token").agg(F.ceil(F.count(F.lit(1)) / holders).cast("int").alias("cuts")).where("cuts > 1")
    posting = posting.join(hot, ["field", "token"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own, other = F.pmod(F.xxhash64("class_id"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    p, q = (F.element_at(F.create_map(*[F.lit(x) for f in fields for x in (f.code, getattr(f, w))]), F.col("field")) for w in ("p", "q"))
    carried = ("class_id", "n", "rest", "shared", "odd_a", "odd_b")
    a = posting.select("field", "token", own.alias("cut_a"), other.alias("cut_b"), *[F.col(c).alias(f"{c}_a") for c in carried])
    b = posting.select("field", "token", own.alias("cut_b"), other.alias("cut_a"), *[F.col(c).alias(f"{c}_b") for c in carried])
    enough = (p + q) * F.least("rest_a", "rest_b") >= p * (F.col("n_a") + F.col("n_b"))
    near = q * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b")
    # each bit that differs stands for at least one n-gram of only one of the two; of the other entries at most every second is a common one
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ("odd_a", "odd_b")), F.lit(0))
    close = (p + q) * (F.col("shared_a") + F.col("shared_b") - differ) >= 2 * p * (F.col("n_a") + F.col("n_b"))
    met = a.join(b, ["field", "token", "cut_a", "cut_b"]).where((F.col("class_id_a") < F.col("class_id_b")) & near & enough & close)
    candidates = cut(met.select("field", F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b"), "n_a", "n_b").distinct())

    # the n-grams of a record are sorted by frequency, so a fragment's are a slice
    level = F.transform("dfs", lambda d: F.floor(F.log2(d)).cast("int"))
    cuts = reps.select("field", "class_id", "tokens", level.alias("levels")).select("field", "class_id", "tokens", "levels", F.explode(F.array_distinct("levels")).alias("fragment"))
    long = F.size(F.filter("levels", lambda x: x == F.col("fragment")))
    segment = cuts.select("field", "class_id", "fragment", F.slice("tokens", F.array_position("levels", F.col("fragment")).cast("int"), long).alias("segment"))
    seg_a = segment.select("field", F.col("class_id").alias("a"), "fragment", F.col("segment").alias("segment_a"))
    seg_b = segment.select("field", F.col("class_id").alias("b"), "fragment", F.col("segment").alias("segment_b"))
    partial = candidates.join(seg_a, ["field", "a"]).join(seg_b, ["field", "b", "fragment"])
    partial = partial.select("field", "a", "b", "n_a", "n_b", F.size(F.array_intersect("segment_a", "segment_b")).alias("part"))
    pairs = partial.groupBy("field", "a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap")).where((p + q) * F.col("overlap") >= p * (F.col("n_a") + F.col("n_b")))
    pairs = cut(pairs.select("field", "a", "b", "overlap", "n_a", "n_b"))
    drop_cut(candidates)
    drop_cut(reps)
    return pairs, classes


def expand_pairs(pairs: DataFrame, classes: DataFrame, most: int = MEMBERS) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: every pair between the members of similar classes and within a class.

    Members meet in pairs of blocks of about ``most``, each a key of its own, so that no task holds a whole class. The
    result is as long as its definition makes it, quadratic in the members of a class; where a class may be large,
    ``pairs`` and ``classes`` themselves tell the same in a row a record.
    """
    sizes = classes.groupBy("field", "class_id").agg(F.count(F.lit(1)).alias("members"))
    both = pairs.select("field", "a", "b").union(sizes.where("members > 1").select("field", F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    large = cut(sizes.where(F.col("members") > most).select("field", "class_id", F.ceil(F.col("members") / most).cast("int").alias("blocks")))
    shown = classes.join(large, ["field", "class_id"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    shown = shown.select("field", "class_id", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    for c in ("a", "b"):
        both = both.join(large.select("field", F.col("class_id").alias(c), F.col("blocks").alias(f"blocks_{c}")), ["field", c], "left")
    number = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(f"blocks_{c}", F.lit(1)) - 1)).alias(f"block_{c}")
    both = both.select("field", "a", "b", "blocks_b", number("a")).select("field", "a", "b", "block_a", number("b"))
    left, right = (shown.select("field", F.col("class_id").alias(c), F.col("block").alias(f"block_{c}"), F.col("id").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    met = both.join(left, ["field", "a", "block_a"]).join(right, ["field", "b", "block_b"]).where("x <> y and (a <> b or x < y)")
    return met.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
