"""The queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import abuse, contamination, doc_pairs, handwritten, mixing, near_duplicates, neighbours, secrets, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": near_duplicates.p1_found,
    "p1_groups": near_duplicates.p1_groups,
    "p3_found": neighbours.p3_found,
    "p3_neighbours": neighbours.p3_neighbours,
    "p4_found": handwritten.p4_found,
    "p4_projects": handwritten.p4_projects,
    "p5_found": doc_pairs.p5_found,
    "p5_pairs": doc_pairs.p5_pairs,
    "p7_found": secrets.p7_found,
    "p7_masked": secrets.p7_masked,
    "p8_found": contamination.p8_found,
    "p8_items": contamination.p8_items,
    "p9_mix": mixing.p9_mix,
    "p9_shares": mixing.p9_shares,
    "p10_found": abuse.p10_found,
    "p10_sources": abuse.p10_sources,
}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
