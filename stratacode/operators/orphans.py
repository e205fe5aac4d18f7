"""References to records that do not exist (problem 6).

Keys become integers (ids as they are, names through a dictionary). References and parents become compressed bitmaps per
range of keys and month; a reference's bitmap AND NOT the parents' up to that month leaves the orphans, which are decoded
and joined back to the rows that hold them. A range's bitmap is an array of 16-bit positions where it holds few and a bit
string where it holds many, so a lone key costs two bytes and a range never more than 4 KB. Equal keys of a month are one
bit before anything is shuffled, and a name meets the dictionary once a month, not once a row, however many rows have it.
Only keys whose parent appeared in the month of the reference need exact times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut, table

_FIRST, _LAST = 0, 10_000_000
_BITS = 32_768


def _month(ts: str) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


_FEW = _BITS // 16  # an array of 16-bit positions is as long as the bit string at this many


def pack(positions: np.ndarray) -> bytes:
    """A range's bitmap: ``a`` and the positions, or ``b`` and the bit string, whichever is shorter."""
    if len(positions) < _FEW:
        return b"a" + np.sort(positions).astype("<u2").tobytes()
    bits = np.zeros(_BITS, np.uint8)
    bits[positions] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The positions of a bitmap, in order."""
    if packed[:1] == b"a":
        return np.frombuffer(packed, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little"))


def _bitmaps(keys: DataFrame) -> DataFrame:
    """(field, key_range, month, bits) of (field, key, month)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="held").assign(bits=[pack(np.asarray(x, np.int64)) for x in pdf["held"]])

    held = F.collect_set(F.bitmap_bit_position("key").cast("smallint")).alias("held")
    got = keys.groupBy("field", F.bitmap_bucket_number("key").alias("key_range"), "month").agg(held)
    return got.mapInPandas(run, "field string, key_range long, month int, bits binary")


def _and_not(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """(field, key_range, month, position, certain) of the references without a parent before their month."""
    cols = ["field", "key_range", "month", "position", "certain"]
    out = []
    known = {m: unpack(b) for m, b in zip(parents["month"], parents["bits"], strict=True)}
    months, i, before = sorted(known), 0, np.zeros(_BITS, bool)
    for field, rng, month, bits in refs.sort_values("month")[["field", "key_range", "month", "bits"]].itertuples(index=False):
        while i < len(months) and months[i] < month:
            before[known[months[i]]] = True
            i += 1
        left = unpack(bits)
        left = left[~before[left]]
        certain = ~np.isin(left, known[month]) if month in known else np.ones(len(left), bool)
        if len(left):
            out.append(pd.DataFrame({"field": field, "key_range": rng, "month": month, "position": left, "certain": certain}))
    return pd.concat(out) if out else pd.DataFrame([], columns=cols)


def orphan_references(relationships: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """(relationship_id, ref_field, month): every reference that leads nowhere or to a record that came later.

    source_function_id and target_file_id: not null, and no such row or one created later; target_function_name: of
    CALLS in any case, and no function of exactly that name. Null keys refer to nothing. A time that is null on either
    side is not later. Several rows of one parent id count by the earliest. A relationship given twice is listed once if
    either version is an orphan. month is that of created_at as yyyy-MM, null if the time is null.
    """
    called = F.when(F.upper("relationship_type") == "CALLS", F.col("target_function_name"))
    rel = relationships.where("id is not null").select("id", "source_function_id", "target_file_id", called.alias("word"), "created_at", F.coalesce(_month("created_at"), F.lit(_LAST)).alias("month"))
    rel = cut(rel)
    asked = rel.where("word is not null").select("word", "month").distinct()
    words = functions.select(F.col("name").alias("word")).where("name is not null").union(asked.select("word"))
    dictionary = cut(cut(words.distinct()).select("word", (F.monotonically_increasing_id() + 1).alias("key")))
    named = asked.join(dictionary, "word").select(F.lit("target_function_name").alias("field"), "key", "month")
    by_id = [F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("key")) for c in ("source_function_id", "target_file_id")]
    ids = rel.select("id", "created_at", "month", F.explode(F.array(*by_id)).alias("x")).select("x.field", "id", "x.key", "created_at", "month").where("key is not null")

    def parents(field: str, df: DataFrame, by_time: bool) -> DataFrame:
        got = df.select(F.lit(field).alias("field"), F.col("key").cast("long"), (F.col("created_at") if by_time else F.lit(None).cast("timestamp_ntz")).alias("created_at")).where("key is not null")
        return got.groupBy("field", "key").agg(F.when(F.count_if(F.col("created_at").isNull()) == 0, F.min("created_at")).alias("created_at"))

    names = functions.select(F.col("name").alias("word"), "created_at").join(dictionary, "word").select("key", "created_at")
    there = parents("source_function_id", functions.select(F.col("id").alias("key"), "created_at"), True)
    there = there.union(parents("target_file_id", files.select(F.col("id").alias("key"), "created_at"), True)).union(parents("target_function_name", names, False))
    there = there.withColumn("month", F.coalesce(_month("created_at"), F.lit(_FIRST)))

    left = (
        _bitmaps(ids.select("field", "key", "month").union(named))
        .groupBy("field", "key_range")
        .cogroup(_bitmaps(there).groupBy("field", "key_range"))
        .applyInPandas(_and_not, "field string, key_range long, month int, position int, certain boolean")
    )
    # the inverse of the two bitmap functions: ranges from 1 up hold positive keys, the others those up to 0
    key = F.when(F.col("key_range") > 0, (F.col("key_range") - 1) * _BITS + F.col("position") + 1).otherwise(F.col("key_range") * _BITS - F.col("position"))
    left = cut(left.select("field", key.alias("key"), "month", "certain"))
    hit = ids.join(left.where("field <> 'target_function_name'"), ["field", "key", "month"])
    sure = hit.where("certain").select("id", "field", "created_at")
    later = hit.where("not certain").join(there.select("field", "key", F.col("created_at").alias("born")), ["field", "key"]).where("born > created_at").select("id", "field", "created_at")
    nameless = left.where("field = 'target_function_name'").join(dictionary, "key").select("word", "month", "field")
    out = sure.union(later).union(rel.join(nameless, ["word", "month"]).select("id", "field", "created_at"))
    return out.select(F.col("id").alias("relationship_id"), F.col("field").alias("ref_field"), F.date_format("created_at", "yyyy-MM").alias("month")).distinct()


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*(table(spark, sf_dir, t) for t in ("function_relationships", "functions", "files")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("relationship_id", "ref_field").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per field, the table it refers to and month of the reference."""
    to = F.when(F.col("ref_field") == "target_file_id", "files").otherwise("functions").alias("ref_table")
    return _orphans(spark, sf_dir).groupBy(to, "ref_field", "month").agg(F.count(F.lit(1)).alias("orphans"))


_SQL = """WITH fn AS (SELECT id, CASE WHEN count(*) = count(created_at) THEN min(created_at) END AS created_at FROM functions GROUP BY id),
fl AS (SELECT id, CASE WHEN count(*) = count(created_at) THEN min(created_at) END AS created_at FROM files GROUP BY id),
o AS (
 SELECT r.id, 'source_function_id' AS ref_field, r.created_at FROM function_relationships r LEFT JOIN fn ON fn.id = r.source_function_id WHERE r.source_function_id IS NOT NULL AND (fn.id IS NULL OR fn.created_at > r.created_at)
 UNION ALL
 SELECT r.id, 'target_file_id', r.created_at FROM function_relationships r LEFT JOIN fl ON fl.id = r.target_file_id WHERE r.target_file_id IS NOT NULL AND (fl.id IS NULL OR fl.created_at > r.created_at)
 UNION ALL
 SELECT r.id, 'target_function_name', r.created_at FROM function_relationships r WHERE upper(r.relationship_type) = 'CALLS' AND r.target_function_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM functions f WHERE f.name = r.target_function_name)),
d AS (SELECT DISTINCT id AS relationship_id, ref_field, strftime(created_at, '%Y-%m') AS "month" FROM o WHERE id IS NOT NULL)
"""
ORACLE_SQL = {
    "p6_found": _SQL + "SELECT DISTINCT relationship_id, ref_field FROM d",
    "p6_report": _SQL + """SELECT CASE WHEN ref_field = 'target_file_id' THEN 'files' ELSE 'functions' END AS ref_table, ref_field, "month", count(*) AS orphans FROM d GROUP BY 1, 2, 3""",
}
QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
