"""The core's queries by name, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import detail, enrich, graph, hierarchy, incremental, modes, orphans, reparse, report, search, stats, topology
from ..parse import facts
from ..streaming import progress

_MODULES = (stats, detail, graph, search, topology, incremental, report, facts, enrich, progress, hierarchy, orphans, modes, reparse)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
