"""Problem 3: the k most similar vectors for each query vector.

All vectors are scaled to length one and projected to ``DIM`` Gaussian (2-stable) directions. The projections are
indexed by kd-trees: the top of the tree, fitted on a bounded sample, routes every vector to a partition, and each
partition holds a tree of its own with leaves of ``LEAF`` vectors. The leaves nearest to a query in the projection give
its first k-th distance; further leaves are verified in full up to the projected distance where the chi-square test says
that a vector closer than that would have been seen by now with probability ``CONFIDENCE``. Queries of neighbouring
leaves walk together: a leaf that one of them needs is verified for all, by one matrix product. A first round searches the
query's own partition; the second visits the other partitions whose projected distance does not fail the same test
against the k-th distance of the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut, table

K, DIM, LEAF = 10, 8, 48
WIDTH = 64  # of the vectors of the tables; another is a parameter
CONFIDENCE = 0.995
PART_ROWS, SAMPLE_ROWS, QUERY_BLOCK, MOST_PARTS = 25_000, 20_000, 4_096, 4_096
SEED = 20
TOGETHER, ROUNDING = 256, 1e-5  # queries that walk together; what single precision may lose of a squared distance


def chi_square_quantile(p: float, dim: int = DIM) -> float:
    """x with P(chi-square of an even ``dim`` <= x) = p, by bisection of the closed form."""
    lo, hi = 0.0, 400.0
    for _ in range(80):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dim // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


def directions(width: int = WIDTH, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, dim)).astype(np.float32)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def _split(points: np.ndarray, order: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: halves along the widest axis until at most ``leaf`` points are left."""
    out, todo = [], [order]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        p = points[at]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        half = len(at) // 2
        by = np.argpartition(p[:, axis], half)
        todo += [at[by[:half]], at[by[half:]]]
    return out


class Tree:
    """A partition's vectors in kd-tree order, with the box of each leaf in the projected space."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray, leaf: int = LEAF) -> None:
        points = vectors @ project
        leaves = _split(points, np.arange(len(ids)), leaf)
        order = np.concatenate(leaves) if leaves else np.empty(0, int)
        self.ids, self.vectors = ids[order], vectors[order]
        self.starts = np.r_[0, np.cumsum([len(x) for x in leaves])]
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def search(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, far: np.ndarray, k: int, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position of the query, ids, squared distances) of the nearest k by the test; ``far``: k-th squared distance known before."""
        gap = np.empty((len(ids), len(self.low)), np.float32)
        for q in range(len(ids)):
            g = np.maximum(self.low - points[q], 0) + np.maximum(points[q] - self.high, 0)
            gap[q] = np.einsum("ij,ij->i", g, g)
        close = np.argsort(gap.argmin(1), kind="stable")  # queries of one leaf walk together
        for block in np.split(close, range(TOGETHER, len(close), TOGETHER)):
            limit = far[block].astype(np.float64)
            few = min(8, gap.shape[1])
            for at, q in enumerate(block):
                first = np.argpartition(gap[q], few - 1)[:few]
                rows = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in first])
                rows = rows[self.ids[rows] != ids[q]]
                if len(rows) >= k:
                    limit[at] = min(limit[at], float(np.partition(2 - 2 * (self.vectors[rows] @ vectors[q]), k - 1)[k - 1]) + ROUNDING)
            # the chi-square test: nothing nearer is to be expected in the other leaves
            leaves = np.flatnonzero((gap[block] <= reach * limit[:, None]).any(0))
            if not len(leaves):
                continue
            rows = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in leaves])
            every, names = self.vectors[rows], self.ids[rows]
            near = 2 - 2 * (vectors[block] @ every.T)
            for d, q in zip(near, block, strict=True):
                d[names == ids[q]] = np.inf
                edge = np.partition(d, k - 1)[k - 1] + ROUNDING if len(d) > k else np.inf
                at = np.flatnonzero((d <= edge) & np.isfinite(d))
                exact = 2 - 2 * np.einsum("ij,j->i", every[at].astype(np.float64), vectors[q].astype(np.float64))
                at, exact = (x[np.lexsort((names[at], exact))[:k]] for x in (at, exact))  # ties by id
                yield q, names[at], exact


def _search(project: np.ndarray, k: int, reach: float):
    """Per partition: its vectors (``query`` false) and the queries sent to it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["id", "other", "distance"]
        here, asked = pdf[~pdf["query"]], pdf[pdf["query"]]
        if not len(here) or not len(asked):
            return pd.DataFrame([], columns=cols)
        tree = Tree(here["id"].to_numpy(), _matrix(here["vector"]), project)
        ids, vectors, out = asked["id"].to_numpy(), _matrix(asked["vector"]), []
        for q, other, d in tree.search(ids, vectors, vectors @ project, asked["far"].to_numpy(), k, reach):
            out.append((np.full(len(other), ids[q]), other, d))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"id": a, "other": b, "distance": c.astype(np.float64)})

    return run


def _top_tree(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axis, value, depth) of a complete binary tree over the projected sample with ``parts`` (a power of two) ends."""
    axis, value = np.zeros(max(1, parts), np.int64), np.zeros(max(1, parts), np.float32)
    level = {1: np.arange(len(sample))}
    while level and min(level) < parts:
        new = {}
        for node, at in level.items():
            if len(at):
                p = sample[at]
                axis[node] = int(np.argmax(p.max(0) - p.min(0)))
                value[node] = np.median(p[:, axis[node]])
            left = sample[at, axis[node]] < value[node] if len(at) else np.empty(0, bool)
            new[2 * node], new[2 * node + 1] = at[left], at[~left]
        level = new
    return axis, value


def _route(points: np.ndarray, axis: np.ndarray, value: np.ndarray, parts: int) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    for _ in range(int(math.log2(parts))):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - parts


def _boxes(axis: np.ndarray, value: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full((2 * parts, DIM), -np.inf, np.float32), np.full((2 * parts, DIM), np.inf, np.float32)
    for node in range(1, parts):
        for child, side in ((2 * node, high), (2 * node + 1, low)):
            low[child], high[child] = low[node], high[node]
            side[child, axis[node]] = value[node]
    return low[parts:], high[parts:]


def _prepared(vectors: DataFrame, project: np.ndarray, axis: np.ndarray, value: np.ndarray, parts: int) -> DataFrame:
    """(id, vector of length one, part); what is no vector of the width, all zero or not finite drops out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["vector"]).astype(np.float64)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            x = (x[ok] / norm[ok][:, None]).astype(np.float32)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "vector": list(x), "part": _route(x @ project, axis, value, parts) if parts > 1 else 0})

    clean = vectors.where(f"id is not null and vector is not null and size(vector) = {len(project)} and not exists(vector, x -> x is null)")
    return clean.mapInPandas(run, "id long, vector array<float>, part int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, part_rows: int = PART_ROWS, confidence: float = CONFIDENCE, width: int = WIDTH) -> DataFrame:
    """(id, other, cosine): for each id of ``queries(id)`` the k other ids of ``vectors(id, vector)`` of highest cosine.

    Ties go to the smaller id. Null vectors, vectors of another width than ``width``, with null or infinite parts or all zero take no
    part, neither as queries nor as answers; an id given twice counts once, with its greatest vector. With fewer than k others there are
    fewer rows; empty inputs give none. The index covers every vector; only the top of the tree is fitted on a sample
    of ``SAMPLE_ROWS``. Of equal vectors the k + 1 of smallest id stand for all: no other of them can be an answer. Each
    partition holds about ``part_rows`` vectors; a fuller one is split by id, and the walk visits all its parts.
    """
    spark = vectors.sparkSession
    project = directions(width)
    reach = chi_square_quantile(confidence)
    base = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<float>")).where("id is not null and vector is not null").groupBy("id").agg(F.max("vector").alias("vector"))
    base = cut(base)  # counted, sampled and indexed
    total = base.count()
    parts = min(MOST_PARTS, 1 << max(0, math.ceil(math.log2(max(1, total) / part_rows))))
    if parts > 1:
        few = base.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // SAMPLE_ROWS))) == 0).limit(SAMPLE_ROWS)
        sample = _prepared(few, project, np.zeros(1, int), np.zeros(1), 1).mapInPandas(lambda it: (pd.DataFrame({"point": list(_matrix(x["vector"]) @ project)}) for x in it if len(x)), "point array<float>").toPandas()["point"]
        axis, value = _top_tree(np.stack(sample.to_numpy()).astype(np.float32) if len(sample) else np.zeros((0, DIM), np.float32), parts)
    else:
        axis, value = np.zeros(1, np.int64), np.zeros(1, np.float32)
    every = cut(_prepared(base, project, axis, value, parts))
    # of equal vectors only the k + 1 smallest ids can be answers, as ties go to them
    place = F.row_number().over(W.partitionBy(F.xxhash64("vector"), F.hash("vector")).orderBy("id"))
    data = cut(every.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"))
    wide = data.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / (2 * part_rows)).cast("int").alias("shares")).where("shares > 1").collect()  # one row a part, at most MOST_PARTS
    of_part = F.create_map(*[F.lit(x) for r in wide for x in (r.part, r.shares)]) if wide else None
    shares = F.lit(1) if of_part is None else F.coalesce(F.element_at(of_part, F.col("part")), F.lit(1))
    data = data.withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int"))
    low, high = _boxes(axis, value, parts)
    asked = every.join(queries.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
    asked = cut(asked.select("id", "vector", "part"))
    out = "id long, other long, distance double"

    def send(rows: DataFrame) -> DataFrame:
        """Queries (id, vector, part, far) against the partitions: once a share, in blocks of about ``QUERY_BLOCK``."""
        rows = rows.select("id", "vector", "part", "far", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(True).alias("query"))
        wanted = rows.groupBy("part", "share").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
        stock = data.select("id", "vector", "part", F.lit(0.0).alias("far"), "share", F.lit(False).alias("query")).join(wanted, ["part", "share"])
        stock = stock.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.join(wanted, ["part", "share"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        cols = ["id", "vector", "part", "far", "share", "query", "block"]
        return stock.select(cols).unionAll(rows.select(cols)).groupBy("part", "share", "block").applyInPandas(_search(project, k, reach), out)

    first = cut(send(asked.withColumn("far", F.lit(4.0))))
    best = lambda df: df.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))).where(F.col("place") <= k)
    if parts == 1:
        got = first
    else:
        kth = best(first).groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(4.0).alias("far"))

        def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    p, far, home = _matrix(pdf["vector"]) @ project, pdf["far"].to_numpy(), pdf["part"].to_numpy()
                    for q in range(len(pdf)):
                        gap = np.maximum(low - p[q], 0) + np.maximum(p[q] - high, 0)
                        at = np.flatnonzero((gap * gap).sum(1) <= reach * far[q])
                        at = at[at != home[q]]
                        if len(at):
                            yield pd.DataFrame({"id": pdf["id"].iloc[q], "vector": [pdf["vector"].iloc[q]] * len(at), "part": at.astype(np.int32), "far": far[q]})

        second = asked.join(kth, "id", "left").withColumn("far", F.coalesce("far", F.lit(4.0))).mapInPandas(elsewhere, "id long, vector array<float>, part int, far double")
        got = first.unionAll(send(second))
    return best(got).select("id", "other", (1 - F.col("distance") / 2).alias("cosine"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "functions").select("id", F.col("embedding").alias("vector"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearest(_vectors(spark, sf_dir), table(spark, sf_dir, "embedding_probes").select(F.col("function_id").alias("id")))
    return got.select(F.least("id", "other").alias("function_id_a"), F.greatest("id", "other").alias("function_id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every function whose id is divisible by 50, against all."""
    every = table(spark, sf_dir, "functions").where("id % 50 = 0").select("id")
    return nearest(_vectors(spark, sf_dir), every).select("id", "other", F.round("cosine", 4).alias("cosine"))
