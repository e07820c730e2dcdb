"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits are cut into M consecutive segments on a ring. If two fingerprints differ in at
most T bits, some segment starts a chain around the ring whose first l segments differ in at most
l * T / M bits together, for every l. The leading segments of that chain have a budget below one bit,
so they are equal: they are the join key. The rest of the chain prunes candidates before the Hamming check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed
from quillgraph.functions.components import connected_components

SHINGLE_WORDS = 3
#: Shingles of the pipeline's stage.
STAGE_SHINGLE_WORDS = 5
SEED = 42
MAX_DISTANCE = 2
SEGMENTS = 9
#: Buckets above this size link through one-bit neighbours, which cost a fixed number of rows each.
HOT_BUCKET = 24
_BLOCK = 1 << 15


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of shingles of so many words: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle_words + 1
    counts = np.zeros(64, dtype=np.int64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    for start in range(0, n, _BLOCK):
        part = words[start : start + _BLOCK + shingle_words - 1]
        form = b" ".join([b"%b"] * shingle_words)
        hashes = np.array([digest(form % t, seed) for t in zip(*(part[i:] for i in range(shingle_words)))], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprint_batches(shingle_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py(), shingle_words) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["id", "version", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """`id, version, fp` for every row, version being a hash of the text; a null text counts as empty and has fingerprint zero."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return source.mapInArrow(_fingerprint_batches(shingle_words), "id long, version long, fp long")


def _segments() -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    widths = [64 // SEGMENTS + (i < 64 % SEGMENTS) for i in range(SEGMENTS)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _mask(start: int, count: int) -> int:
    """Bits of `count` consecutive segments from `start` around the ring, as a signed 64-bit value."""
    cut = _segments()
    m = 0
    for j in range(count):
        at, w = cut[(start + j) % SEGMENTS]
        m |= ((1 << w) - 1) << at
    return m - (1 << 64) if m >> 63 else m


def _equal_run(distance: int) -> int:
    """Leading segments of a chain whose budget is below one bit."""
    return max(n for n in range(1, SEGMENTS + 1) if n * distance < SEGMENTS)


def _entries(prints: DataFrame, distance: int) -> DataFrame:
    run = _equal_run(distance)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(i, run))) for i in range(SEGMENTS)])
    return prints.select("fp", F.posexplode(keys).alias("rot", "key"))


def _chain_holds(x: Column, rot: Column, distance: int) -> Column:
    """True if the chain from segment `rot` keeps within its proportional budget at every length."""
    run = _equal_run(distance)
    out = F.lit(False)
    for i in range(SEGMENTS):
        held = F.lit(True)
        for n in range(run + 1, SEGMENTS):
            held = held & (F.bit_count(x.bitwiseAND(F.lit(_mask(i, n)))) <= n * distance // SEGMENTS)
        out = F.when(rot == i, held).otherwise(out)
    return out


def near_pairs(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges `a, b` over distinct fingerprints that connect exactly those within `distance` of each other.

    Buckets up to HOT_BUCKET fingerprints are joined, pruned by their chain and checked. In a larger
    bucket (distance 2 only) every member instead names itself and its one-bit neighbours outside the
    key: two members within two bits share such a name, and members that share one are within two bits,
    so linking each to the least member of the name gives the same components with no pairs.
    """
    if distance != 2:
        raise ValueError("distance 2 is what hot buckets are exact for")
    entries = _entries(prints, distance)
    sizes = entries.groupBy("rot", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(entries.join(sizes, ["rot", "key"]))
    small = shared.where(F.col("n") <= HOT_BUCKET)
    left, right = small.select("rot", "key", F.col("fp").alias("a")), small.select("rot", "key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = left.join(right, ["rot", "key"]).where(F.col("a") < F.col("b")).where(_chain_holds(x, F.col("rot"), distance))
    pairs = pairs.where(F.bit_count(x) <= distance).select("a", "b")
    hot = shared.where(F.col("n") > HOT_BUCKET)
    run = _equal_run(distance)
    flips = []
    for i in range(SEGMENTS):
        held = _mask(i, run) % (1 << 64)
        free = [0, *[1 << j for j in range(64) if not held >> j & 1]]
        flips.append(F.array(*[F.lit(v - (1 << 64) if v >> 63 else v) for v in free]))
    own = F.lit(None)
    for i, choice in enumerate(flips):
        own = F.when(F.col("rot") == i, choice).otherwise(own)
    named = hot.select("fp", F.explode(own).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).distinct()
    least = named.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = named.join(least, "mid").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int, shingle_words: int) -> DataFrame:
    """`id, version, fp, label, component_id, component_size` for every row; label is one fingerprint of the group."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    labels = connected_components(near_pairs(classes.select("fp"), distance), "a", "b")
    labelled = classes.join(labels, classes.fp == labels.node, "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    groups = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    return prints.join(labelled.join(groups, "label").select("fp", "label", "component_id", "component_size"), "fp")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """`doc_id, fingerprint, component_id, component_size` for every row of `docs`.

    Rows with equal fingerprints are one class; classes within `distance` bits are linked, and
    component_id is the least id reachable. Null and empty texts share fingerprint zero. A null id is
    kept and never names a component (component_id is null only where no member has an id). Repeated
    rows stay repeated; other columns are not read.
    """
    return _grouped(docs, id_col, text_col, distance, shingle_words).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component_size",
    )


def keep_first_of_group(docs: DataFrame, distance: int = MAX_DISTANCE, shingle_words: int = STAGE_SHINGLE_WORDS) -> DataFrame:
    """Documents with one row of each near-duplicate group left, with their columns as they are.

    The row that stays has the group's least doc_id; of several such rows the one whose text has the
    least hash, then the one whose columns have. Rows with a null doc_id can't be named and stay. Null
    and empty texts are one group; an empty table stays empty.
    """
    groups = _grouped(docs, "doc_id", "text", distance, shingle_words).where("id = component_id")
    keep = groups.groupBy("label", "id").agg(F.min("version").alias("version")).select(F.col("id").alias("__id"), F.col("version").alias("__version"))
    version = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.where(F.col("doc_id").isNotNull()).withColumns({"__id": F.col("doc_id").cast("long"), "__version": version})
    named = marked.join(keep, ["__id", "__version"], "left_semi")
    # One row of those that repeat id and text; the rest are dropped before the shuffle, whatever their number.
    order = Window.partitionBy("__id", "__version").orderBy(F.xxhash64(*docs.columns))
    named = named.withColumn("__k", F.row_number().over(order)).where("__k = 1")
    return named.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
