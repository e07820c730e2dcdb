"""Streaming forms of ingest, KPI windows and the paper status fold; their batch twins define what is right."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.incremental import KEY


REGISTRY = "doc_id string, content_hash string, version string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _key(version: Column) -> Column:
    """The key as one struct, in which nulls are equal."""
    return F.struct(*KEY, version.alias("version"))


def first_seen(elements: DataFrame, registered: DataFrame, version: str) -> DataFrame:
    """Streamed elements whose (doc_id, content_hash, version) is new, with the key in `__key`, by state kept for each key.

    What others have registered is a stream of keys, all of which come in the first batch of a new checkpoint; later batches
    don't read them again and cost what their own rows cost, however many keys are known. Where an element and its
    registered key come in one batch, either may be taken for the first: `ingest` leaves such elements out of that batch.
    The state is in RocksDB, on disk. Null ids and hashes are keys like others; of rows that share a key one stays.
    """
    known = registered.select(_key(F.col("version")).alias("__key"), F.lit(True).alias("__known"))
    asked = elements.withColumn("__key", _key(F.lit(version))).withColumn("__known", F.lit(False))
    both = asked.unionByName(known, allowMissingColumns=True).dropDuplicates(["__key"])
    return both.where(~F.col("__known")).drop("__known")


def ingest(elements: DataFrame, registry_path: str, out_path: str, version: str, checkpoint: str) -> StreamingQuery:
    """Appends elements whose (doc_id, content_hash, version) the registry lacks, and registers them.

    A batch first writes its elements under its own folder, then its registry rows likewise, both by
    overwriting, so a batch that is run again after a failure leaves the same files. Folders bear the
    checkpoint's name too: one that starts anew counts its batches from 0 and must not overwrite others'.
    The first batch looks its keys up in what others have registered, later ones have these in their state. Let one at a time
    write to a registry, and take over from another with a new checkpoint instead of going back to an old one.
    """
    spark = elements.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    # The registry is a folder with a schema from the start.
    spark.createDataFrame([], REGISTRY).write.mode("ignore").parquet(f"{registry_path}/run=none/batch=0")
    others = F.col("run") != run
    registered = spark.readStream.schema(f"{REGISTRY}, run string, batch long").parquet(registry_path).where(others)

    def batch(rows: DataFrame, number: int) -> None:
        spark, place = rows.sparkSession, f"run={run}/batch={number}"
        if number == 0:
            known = spark.read.schema(f"{REGISTRY}, run string, batch long").parquet(registry_path).where(others)
            rows = rows.join(known.select(_key(F.col("version")).alias("__key")), "__key", "left_anti")
        rows = rows.drop("__key")
        rows.write.mode("overwrite").parquet(f"{out_path}/{place}")
        done = spark.read.schema(rows.schema).parquet(f"{out_path}/{place}")
        done.select(*KEY, F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{registry_path}/{place}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        # The query takes its settings when it starts.
        writer = first_seen(elements, registered, version).writeStream.foreachBatch(batch).outputMode("append")
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def kpi_windows(metrics: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, sum and extremes of each metric in tumbling windows; rows behind the watermark are dropped when streamed."""
    rows = metrics.withWatermark("ts", late) if metrics.isStreaming else metrics
    out = rows.groupBy(F.window("ts", width).alias("w"), "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("w.start").alias("window_start"), "metric", "n", "total", "low", "high")


def paper_status(events: DataFrame) -> DataFrame:
    """Latest status of each paper, in update mode when streamed."""
    return events.groupBy("paper_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("updated_at"))


def write_paper_status(events: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Streams status events in update mode; each batch's changed papers overwrite that batch's own folder, so it can run again."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return paper_status(events).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_paper_status(spark, out_path: str) -> DataFrame:
    """The status that the last batch with a change has written for each paper."""
    rows = spark.read.parquet(out_path)
    return rows.groupBy("paper_id").agg(F.max_by("status", "batch").alias("status"), F.max_by("updated_at", "batch").alias("updated_at"))
