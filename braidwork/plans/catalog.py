"""All queries of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidwork.plans import links, market, pages, reads, scores, subgraphs, texts, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (market, texts, links, scores, reads, pages, subgraphs, upkeep):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
