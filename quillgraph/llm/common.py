"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.checkpoints import checkpointed, ensure_checkpoint_dir


__all__ = ["checkpointed", "crc32_mod", "ensure_checkpoint_dir", "read_table", "shuffle_width"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the rule that holds rows out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
