"""Incremental processing keyed by document, content hash and pipeline version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("doc_id", "content_hash")


def pending_chunks(elements: DataFrame, registry: DataFrame, version: str) -> DataFrame:
    """Elements that the registry does not hold at this version."""
    return elements.join(registry.where(F.col("version") == version), list(KEY), "left_anti")


def mark_processed(registry: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """The registry with the chunks done at this version; one row a chunk."""
    new = done.select(*KEY).distinct()
    return registry.join(new, list(KEY), "left_anti").select(*KEY, "version").unionByName(new.withColumn("version", F.lit(version)))


def force_reset(registry: DataFrame, documents: DataFrame) -> DataFrame:
    return registry.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def needs_deprecation(elements: DataFrame, registry: DataFrame, version: str) -> DataFrame:
    """Documents with a chunk that was processed at another version."""
    met = elements.select(*KEY).join(registry, list(KEY)).where(F.col("version") != version)
    return met.select("doc_id").distinct()
