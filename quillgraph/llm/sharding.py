"""Rendezvous (highest random weight) hashing of records over weighted shards.

Each record scores every shard with a hash of (key, shard) and goes to the shard that scores highest,
so adding a shard moves only the records that the new shard wins. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import shuffle_width


_SPREAD = 1 << 16


def _score(key: Column, shard: int, weight: float | None) -> Column:
    h = F.xxhash64(key, F.lit(shard).cast("int"))
    if weight is None:
        return h
    # -w / ln(u) with u in (0, 1): the weighted form; u from the top 52 bits of the hash.
    u = (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.lit(float(weight)) / F.log(u)


def rendezvous_shard(key: Column, n_shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard (0 to n_shards - 1) of a key; weights are relative sizes, equal when not given.

    A null key counts as one key of its own. Equal scores go to the lower shard. The choice depends
    on nothing but the key, the weights and n_shards.
    """
    if n_shards < 1 or (weights is not None and (len(weights) != n_shards or min(weights) <= 0)):
        raise ValueError("one positive weight per shard is needed")
    scores = [_score(key, i, weights[i] if weights is not None else None) for i in range(n_shards)]
    best = F.greatest(*scores) if n_shards > 1 else scores[0]
    return F.array_position(F.array(*scores), best).cast("int") - 1


def assign_slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", buckets: int | None = None) -> DataFrame:
    """Adds a gapless position from 0 within each shard, without sorting a whole shard in one task.

    Equal rows are first counted together (map-side), dealt by hash into buckets of their shard,
    numbered within the bucket from the bucket's offset, and spread out again; so neither a large shard
    nor a row repeated many times meets in one task. Columns besides `shard` and `order` are not kept.
    """
    buckets = buckets or shuffle_width(rows.sparkSession)
    cols = [shard, *order]
    counted = rows.groupBy(*cols).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    within = Window.partitionBy(shard, "__b").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("__at", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    # One row for each bucket of each shard: the table of offsets has shards x buckets rows at most.
    sizes = counted.groupBy(shard, "__b").agg(F.sum("__n").alias("__size"))
    offset = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "__b", F.coalesce(F.sum("__size").over(offset), F.lit(0)).alias("__from"))
    placed = numbered.join(offsets, [shard, "__b"]).withColumn("__first", F.col("__from") + F.col("__at"))
    # Spread out in two steps, so that no array is longer than _SPREAD or the copies divided by it.
    parts = placed.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(_SPREAD).cast("long"))))
    last = F.least(F.col("__at") + _SPREAD, F.col("__n")) - 1
    return parts.select(*cols, F.explode(F.sequence(F.col("__first") + F.col("__at"), F.col("__first") + last)).alias(slot))


def write_shards(rows: DataFrame, shard: Column, path: str) -> None:
    """Writes whole records as Parquet, one folder a shard, several files each so that no task holds a shard.

    What stands at `path` is replaced. A column `shard` that the rows have is replaced too; nulls,
    repeated rows and empty texts are written as they are, and an empty table writes no folder.
    """
    width = shuffle_width(rows.sparkSession)
    placed = rows.withColumn("shard", shard)
    placed.repartition(width, "shard", F.spark_partition_id() % 4).write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` for every document, by the `key` law.

    Ids count as long integers, whatever their column's type. Null texts have size 16 and the checksum of
    an empty text; a null doc_id is a key of its own. Repeated rows each get a slot. Other columns are
    not read; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous_shard(key, n_shards).alias("shard"),
        rendezvous_shard(key, n_shards + 1).alias("grown_shard"),
    )
    slots = assign_slots(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def weighted_shards(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """`doc_id, size, shard, grown_shard` for every document over weighted shards; grown_shard: with one more of weight 1.

    Nulls and repeated rows are treated as in `shard_documents`.
    """
    key, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        rendezvous_shard(key, len(weights), weights).alias("shard"),
        rendezvous_shard(key, len(weights) + 1, [*weights, 1.0]).alias("grown_shard"),
    )
