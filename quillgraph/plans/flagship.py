"""The flagship query: which evidence paths of at most two hops connect a supplier and a customer, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import graph_queries


def evidence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items merged into edges, conflicts flagged, paths searched and ranked."""
    return graph_queries.rank_paths(spark, sf_dir)
