"""A stored index of vectors: lists around centres, one folder each, of which a query reads the nearest.

The centres are fitted on a bounded sample, but every vector is indexed; within the lists read the cosine is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import cosine

LISTS, SAMPLE_ROWS, PROBES = 100, 20_000, 10


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _centres(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of unit vectors by cosine; an empty list takes a vector that is far from its own centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        at = near.argmax(1)
        far = np.argsort(near.max(1))
        for k in range(len(c)):
            own = x[at == k]
            c[k] = own.mean(0) if len(own) else x[far[k % len(x)]]
        c /= np.maximum(np.sqrt((c * c).sum(1)), 1e-12)[:, None]
    return c


def store_vector_index(vectors: DataFrame, path: str, lists: int = LISTS, sample_rows: int = SAMPLE_ROWS, rounds: int = 8, seed: int = 3) -> None:
    """Writes the index of ``vectors(id, vector)`` to ``path``: ``lists`` folders of (id, vector) and the centres.

    Null vectors, vectors with null or infinite parts or all zero, and those of another width than most take no part.
    The sample is of at most ``sample_rows`` vectors, the smallest by hash of id; an empty table gives an empty index.
    """
    spark = vectors.sparkSession
    ok = "id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(vector, x -> x <> 0)"
    clean = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<float>")).where(ok)
    top = clean.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = top.width if top else 0
    clean = clean.where(F.size("vector") == width)
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toPandas()["vector"]
    centres = _centres(_unit(sample), lists, rounds, seed) if len(sample) else np.zeros((0, max(1, width)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=(_unit(pdf["vector"]) @ centres.T).argmax(1).astype(np.int32))

    clean.mapInPandas(assign, "id long, vector array<float>, list int").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search_vector_index(spark: SparkSession, path: str, vector: list[float], limit: int = 20, probes: int = PROBES) -> DataFrame:
    """(id, score): the nearest by cosine among the ``probes`` lists whose centres are nearest; ties by id.

    Only the folders of those lists are read. With as many probes as lists the result is exact.
    """
    centres = spark.read.schema("list int, centre array<double>").parquet(f"{path}/centres").collect()  # one row a list
    q = np.array(vector, float)
    near = sorted(centres, key=lambda r: (-float(np.dot(r.centre, q)), r.list))[:probes] if q.any() else []
    stored = spark.read.schema("id long, vector array<float>, list int").parquet(f"{path}/lists")
    got = stored.where(F.col("list").isin([r.list for r in near])).select("id", F.round(cosine("vector", F.array(*[F.lit(float(x)) for x in vector])), 4).alias("score"))
    return got.where("score is not null").orderBy(F.desc("score"), "id").limit(limit)
