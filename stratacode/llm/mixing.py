"""Problem 9: a mix of sources at target weights.

A text may stand in several sources; documents of equal text are one item whose pattern is the set of its targeted
sources. Items are aggregated by pattern, and a min-cost flow routes the patterns' tokens to the sources' quotas, each
further use of the same tokens dearer than the one before. Every pattern's items, in seeded order and repeated, form a
line of tokens that is cut to the flow's amounts. The line is cut into buckets of about ``BUCKET_ITEMS`` items, as many as
a pattern needs, so that a source of any size is summed in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut, table

BUCKET_ITEMS = 20_000


def tokenizer(path: str | None = None) -> tuple[str, str]:
    """(path of a ``.tiktoken`` vocabulary, splitting pattern); by default the public 50k byte-level BPE."""
    import public_tokenizers as P

    return path or str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, key, tokens): the length of each text in tokens and a hash of it. Null texts drop out."""
    vocabulary, pattern = tokenizer(path)
    with open(vocabulary, "rb") as f:
        words = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, words.value.splitlines())}
        enc = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64())], names=["doc_id", "source", "key_a", "key_b", "tokens"])

    docs = documents.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("key_a"), F.xxhash64("text", F.lit(1)).alias("key_b"), "text")
    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, source string, key_a long, key_b long, tokens long")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> tuple[int, list[int]]:
    """(flow, flow per arc) of the cheapest greatest flow; arcs are (from, to, capacity, cost) with costs from 0 up."""
    import heapq

    head: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)
    total, high = 0, [0] * n
    while True:
        dist, via = [None] * n, [-1] * n
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in head[x]:
                if cap[e]:
                    nd = d + cost[e] + high[x] - high[to[e]]
                    if dist[to[e]] is None or nd < dist[to[e]]:
                        dist[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if dist[t] is None:
            return total, [cap[2 * k + 1] for k in range(len(arcs))]
        high = [h + d if d is not None else h for h, d in zip(high, dist, strict=True)]
        push, x = None, t
        while x != s:
            push = cap[via[x]] if push is None else min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = t
        while x != s:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
        total += push


def plan(patterns: dict[int, int], shares: list[float], repeats: list[int], total: int | None = None) -> tuple[list[float], dict[tuple[int, int], int]]:
    """(wanted share per source, tokens per (pattern, source)).

    ``patterns``: tokens by bit set of sources. Sources without a token want nothing, and the others share their part.
    Without ``total`` the mix is the greatest in which every source reaches its wanted share exactly.
    """
    k = len(shares)
    live = [any(p >> i & 1 and n for p, n in patterns.items()) and repeats[i] > 0 and shares[i] > 0 for i in range(k)]
    base = sum(s for s, x in zip(shares, live, strict=True) if x)
    want = [s / base if x else 0.0 for s, x in zip(shares, live, strict=True)]
    kept = sorted(p for p, n in patterns.items() if n and any(p >> i & 1 and live[i] for i in range(k)))
    s, t, first = 0, 1, 2 + k

    def solve(size: int) -> tuple[int, dict[tuple[int, int], int]]:
        arcs, key = [], []
        for j, p in enumerate(kept):
            most = max(repeats[i] for i in range(k) if p >> i & 1 and live[i])
            for r in range(most):
                arcs.append((s, first + j, patterns[p], r))
                key.append(None)
            for i in range(k):
                if p >> i & 1 and live[i]:
                    arcs.append((first + j, 2 + i, patterns[p] * repeats[i], 0))
                    key.append((p, i))
        for i in range(k):
            if live[i]:
                arcs.append((2 + i, t, int(want[i] * size), 0))
                key.append(None)
        got, flow = min_cost_flow(first + len(kept), arcs, s, t)
        return got, {x: f for x, f in zip(key, flow, strict=True) if x and f}

    need = lambda size: sum(int(w * size) for w in want)
    if not kept:
        return want, {}
    if total is None:
        low, high = 0, 1 + sum(n * max(repeats) for n in patterns.values())
        while high - low > max(1, low // 10_000):
            mid = (low + high) // 2
            low, high = (mid, high) if solve(mid)[0] == need(mid) else (low, mid)
        total = low
    return want, solve(total)[1]


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(selection, shares)``.

    selection (doc_id, source, uses, tokens): documents of the mix, how often each is used for the source, and the
    tokens of one use. No text is used more often than its source's max_repeats for that source, nor more often in all
    than the greatest max_repeats of its sources. shares (source, target_share, wanted_share, tokens, share,
    documents): one row per target, with zeros where it has no documents.

    Null or empty texts, null sources and sources without a target take no part; a document given twice is one;
    of several documents of one text and source the smallest id stands for all. A target given twice counts by its
    greatest share. Without any usable text the selection is empty. ``total`` asks for a size in tokens; by default the
    mix is the greatest that meets all wanted shares. A quota is met to within the tokens of one document.
    Any number of targets may be given; the patterns that occur, sets of sources that hold one text, are planned on the
    driver, so their number, not that of texts, must fit there: no more than the distinct sets of sources of equal texts.
    """
    spark = documents.sparkSession
    goals = targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    rows = goals.orderBy("source").collect()  # one row a target
    bit = spark.createDataFrame([(r.source, i) for i, r in enumerate(rows)], "source string, number int")
    counted = token_counts(documents.join(F.broadcast(bit.select("source")), "source", "left_semi"), path)
    placed = cut(counted.where("tokens > 0").join(F.broadcast(bit), "source").groupBy("key_a", "key_b", "number").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")))
    items = placed.groupBy("key_a", "key_b").agg(F.array_join(F.sort_array(F.collect_list("number")), ",").alias("pattern"), F.max("tokens").alias("tokens"))
    items = cut(items)
    whole = items.groupBy("pattern").agg(F.sum("tokens").alias("n"), F.ceil(F.count(F.lit(1)) / BUCKET_ITEMS).cast("int").alias("buckets")).collect()  # one row a pattern that occurs
    named = {r.pattern: sum(1 << int(i) for i in r.pattern.split(",")) for r in whole}
    known = {named[r.pattern]: r.n for r in whole}
    buckets = spark.createDataFrame([(r.pattern, r.buckets) for r in whole], "pattern string, buckets int")
    items = items.join(buckets, "pattern").withColumn("bucket", F.pmod(F.xxhash64("key_a", "key_b", F.lit(seed)), F.col("buckets")).cast("int"))
    sizes = cut(items.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n")))
    want, flow = plan(known, [r.target_share for r in rows], [r.max_repeats for r in rows], total)

    at, spans, text = {}, [], {v: k for k, v in named.items()}
    for (p, i), f in sorted(flow.items()):
        spans.append((text[p], i, at.get(p, 0), at.get(p, 0) + f, known[p]))
        at[p] = at.get(p, 0) + f
    span = spark.createDataFrame(spans, "pattern string, number int, low long, high long, whole long")
    before = sizes.select("pattern", "bucket", (F.sum("n").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("before"))  # a row for BUCKET_ITEMS items
    order = W.partitionBy("pattern", "bucket").orderBy(F.xxhash64("key_b", F.lit(seed)), "key_a", "key_b")
    line = items.join(before, ["pattern", "bucket"]).withColumn("start", F.col("before") + F.sum("tokens").over(order) - F.col("tokens"))
    # copy c of an item starts at start + c * whole; those with low <= start + c * whole < high go to the span's source
    through = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - F.col("start")) / F.col("whole"))).cast("int")
    used = line.join(span, "pattern").withColumn("uses", through("high") - through("low")).where("uses > 0")
    chosen = used.join(placed.select("key_a", "key_b", "number", "doc_id"), ["key_a", "key_b", "number"])
    names = F.broadcast(bit.select("number", "source"))
    selection = cut(chosen.join(names, "number").select("doc_id", "source", "uses", "tokens"))
    got = selection.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    asked = spark.createDataFrame([(r.source, float(r.target_share), float(w)) for r, w in zip(rows, want, strict=True)], "source string, target_share double, wanted_share double")
    reached = selection.agg(F.sum(F.col("uses") * F.col("tokens"))).first()[0] or 1
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = asked.join(got, "source", "left").select(
        "source", "target_share", F.round("wanted_share", 6).alias("wanted_share"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.lit(reached), F.lit(0.0)), 6).alias("share"), zero("documents")
    )
    return selection, shares


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]
