"""Registered queries over the driver tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

from quillgraph.plans import extraction_queries, graph_queries, more_queries, quality_queries, text_queries

MODULES = [text_queries, extraction_queries, graph_queries, quality_queries, more_queries]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= module.ORACLES
    return out
