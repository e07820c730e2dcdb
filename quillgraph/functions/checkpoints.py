"""Checkpoints in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that are sent to every task instead of dealing out the table that they are looked up in.
FEW = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder in spark.checkpoint.dir.

    Where none is set, a local master (as in tests) gets a folder of its own; on a cluster it is an error,
    as executors don't see each other's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from the reliable checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables that are made and stored within leave no shuffle files; else these stay until the driver collects its garbage.

    Only for tables that are stored at once and read from there, as whatever reads a freed shuffle again has to make it again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def broadcast_if_few(keys: DataFrame, most: int | None = None) -> DataFrame:
    """The same keys, made once and counted; up to FEW (or `most`) of them are broadcast in joins."""
    keys = checkpointed(keys)
    return F.broadcast(keys) if keys.count() <= (FEW if most is None else most) else keys
