"""A Merkle manifest of a dataset: bitmap ranks place the leaves, keyed slot arrays reduce the levels.

Every row is a leaf. A leaf's place among its group's is its rank, found without sorting the group: ids are split
into containers of 65,536 (compressed: a list of low halves, or a bitmap where that is shorter), partial
containers of all partitions are merged, and each gets a popcount directory. Counts of containers, of 65,536
containers and so on are summed up in windows of at most 65,536 entries, so no window holds a group. Rows
that share an id are placed by their digest within it, by the same rule over the digest's first two bytes.

Levels are reduced in blocks of 3^8 slots: one block is one array in one task, which makes eight levels of the
tree; blocks of block roots go on likewise. Coming down again, each block gets its root's path and hands its
members theirs, so a leaf's proof is never collected from single levels by joins.

Nulls: a field that is null counts as `-`; null sources are one group, the first; null ids come first in
their group. Repeated rows are leaves of their own; rows of one id and other contents go by their leaf's digest.
An empty table gives no rows. Other columns than doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed

ARITY = 3
#: Levels of one block.
BLOCK_LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Low halves that a container keeps as a list; beyond it is a bitmap of 8 KB.
LIST_LIMIT = 4096
BATCH = 2000


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    """SHA-256 (hex) of the row's fields, each `-` or its byte count, a colon and its value."""
    values = [docs[c].cast("long").cast("string") if c in ("doc_id", "n_chars") else docs[c].cast("string") for c in FIELDS]
    if text is not None:
        values[-1] = text
    return F.sha2(F.concat(*map(_field, values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """`source, doc_id, leaf, tampered`: the latter is the leaf without line ends in its text, where 2 divides crc32 of the id; else null.

    An id that is null counts as the text `-` there.
    """
    text = docs["text"].cast("string")
    tampered = F.crc32(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("-")).cast("binary")) % 2 == 0
    return docs.select(
        docs["source"].cast("string").alias("source"),
        docs["doc_id"].cast("long").alias("doc_id"),
        leaf_digest(docs).alias("leaf"),
        F.when(tampered, leaf_digest(docs, F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )


# --- Bitmap ranks ---------------------------------------------------------------------------------------


def _pack(low: np.ndarray) -> bytes:
    """A container of distinct sorted low halves: 2 bytes each, or 8 KB."""
    if len(low) <= LIST_LIMIT:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _words(container: bytes) -> np.ndarray:
    """A container's 1,024 words of 64 bits."""
    if len(container) == 1 << 13:
        return np.frombuffer(container, dtype="<u8")
    words = np.zeros(1 << 10, dtype=np.uint64)
    low = np.frombuffer(container, dtype="<u2").astype(np.int64)
    np.bitwise_or.at(words, low >> 6, np.uint64(1) << (low & 63).astype(np.uint64))
    return words


def _members(container: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(_words(container).view(np.uint8), bitorder="little"))


def rank(container: bytes, low: np.ndarray) -> np.ndarray:
    """How many members of the container are below each low half: the directory's count before its word, plus the word's bits below."""
    words = _words(container)
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    low = np.asarray(low, dtype=np.int64)
    below = words[low >> 6] & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
    return directory[low >> 6] + np.bitwise_count(below)


_PARTIAL = "source string, bucket long, bits binary, extra_at array<int>, extra array<long>"


def _partial_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of each batch of `source, bucket, low, copies`; copies above one are kept beside the bits."""
    for batch in batches:
        found: dict[tuple, list[tuple[int, int]]] = {}
        for source, bucket, low, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found.setdefault((source, bucket), []).append((low, copies))
        yield _container_batch(found)


def _container_batch(found: dict[tuple, list[tuple[int, int]]]) -> pa.RecordBatch:
    keys = list(found)
    bits, at, extra = [], [], []
    for key in keys:
        pairs = sorted(found[key])
        bits.append(_pack(np.array([low for low, _ in pairs], dtype=np.int64)))
        at.append([low for low, n in pairs if n > 1])
        extra.append([n - 1 for _, n in pairs if n > 1])
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(bits, pa.binary()), pa.array(at, pa.list_(pa.int32())), pa.array(extra, pa.list_(pa.int64()))],
        ["source", "bucket", "bits", "extra_at", "extra"],
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition by their first columns; the rest of each row as a tuple."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _merge_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial containers sorted by (source, bucket): the union of each bucket's, and its number of rows."""
    out: list[tuple] = []
    schema = pa.schema([("source", pa.string()), ("bucket", pa.int64()), ("bits", pa.binary()), ("extra_at", pa.list_(pa.int32())), ("extra", pa.list_(pa.int64())), ("rows", pa.int64())])

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for (source, bucket), parts in _runs(batches, 2):
        words = np.zeros(1 << 10, dtype=np.uint64)
        extra: dict[int, int] = {}
        for bits, at, more in parts:
            words |= _words(bits)
            extra.update(zip(at, more))
        members = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
        out.append((source, bucket, _pack(members), sorted(extra), [extra[k] for k in sorted(extra)], len(members) + sum(extra.values())))
        if len(out) == 1000:
            yield flush()
            out = []
    if out:
        yield flush()


def containers(ids: DataFrame) -> DataFrame:
    """Merged containers of `source, doc_id, copies` (ids distinct within a source), with `first`, the rank of a container's first row, and `total` of its source.

    Directories are windows over the 16-bit digits of the bucket's number, each of at most 65,536 entries.
    """
    low = F.col("doc_id").bitwiseAND(F.lit(0xFFFF)).cast("int")
    keyed = ids.select("source", F.shiftright("doc_id", 16).alias("bucket"), F.coalesce(low, F.lit(0)).alias("low"), "copies")
    partial = keyed.mapInArrow(_partial_containers, _PARTIAL)
    merged = partial.repartition("source", "bucket").sortWithinPartitions("source", "bucket").mapInArrow(_merge_containers, _PARTIAL + ", rows long")
    merged = checkpointed(merged)
    c0 = merged.select("source", "bucket", "rows")
    c1 = c0.groupBy("source", F.shiftright("bucket", 16).alias("b1")).agg(F.sum("rows").alias("rows1"))
    c2 = c1.groupBy("source", F.shiftright("b1", 16).alias("b2")).agg(F.sum("rows1").alias("rows2"))

    def before(value: str, group: list, digit: str) -> Column:
        frame = Window.partitionBy(*group).orderBy(F.col(digit).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(frame), F.lit(0))

    everything = Window.partitionBy("source")
    c2 = c2.select("source", "b2", before("rows2", ["source"], "b2").alias("from2"), F.sum("rows2").over(everything).alias("total"))
    c1 = c1.withColumn("b2", F.shiftright("b1", 16)).withColumn("from1", before("rows1", ["source", "b2"], "b1"))
    c1 = _same(c1, c2, ["source", "b2"]).select("source", "b1", (F.col("from1") + F.col("from2")).alias("from1"), "total")
    c0 = merged.withColumn("b1", F.shiftright("bucket", 16)).withColumn("from0", before("rows", ["source", F.shiftright("bucket", 16)], "bucket"))
    return _same(c0, c1, ["source", "b1"]).select("source", "bucket", "bits", "extra_at", "extra", (F.col("from0") + F.col("from1")).alias("first"), "total")


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join in which nulls are equal; the left side's columns stay."""
    b = b.select(*[F.col(c).alias(f"__{c}") for c in cols], *[c for c in b.columns if c not in cols])
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]).drop(*[f"__{c}" for c in cols])


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's container (first, as it has no low half), then its ids: the slot of each id's first row."""
    for (source, bucket), rows in _runs(batches, 2):
        _, _, bits, at, extra, first, total = rows[0]
        low = np.array([r[0] for r in rows[1:]], dtype=np.int64)
        copies = [r[1] for r in rows[1:]]
        slot = first + rank(bits, low)
        if at:
            slot = slot + np.concatenate([[0], np.cumsum(np.array(extra, dtype=np.int64))])[np.searchsorted(np.array(at), low)]
        doc = pa.nulls(len(low), pa.int64()) if bucket is None else pa.array((bucket << 16) | low, pa.int64())
        n = len(low)
        yield pa.RecordBatch.from_arrays([pa.array([source] * n, pa.string()), doc, pa.array(slot, pa.int64()), pa.array(copies, pa.int64()), pa.array([total] * n, pa.int64())], ["source", "doc_id", "slot", "copies", "total"])


def id_slots(ids: DataFrame) -> DataFrame:
    """`source, doc_id, slot, copies, total`: rank queries of all ids against their containers.

    A bucket's ids and its container meet in one run of sorted rows, of at most 65,537.
    """
    low = F.coalesce(F.col("doc_id").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    asked = ids.select("source", F.shiftright("doc_id", 16).alias("bucket"), low.alias("low"), "copies", none("binary").alias("bits"), none("array<int>").alias("extra_at"), none("array<long>").alias("extra"), none("long").alias("first"), none("long").alias("total"))
    held = containers(ids).select("source", "bucket", none("int").alias("low"), none("long").alias("copies"), "bits", "extra_at", "extra", "first", "total")
    together = held.unionByName(asked).repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("low").asc_nulls_first())
    return together.mapInArrow(_ranks, "source string, doc_id long, slot long, copies long, total long")


def place_leaves(rows: DataFrame) -> DataFrame:
    """`source, slot, total, doc_id, leaf, tampered`: each row's place among its source's, gapless from 0."""
    ids = checkpointed(rows.groupBy("source", "doc_id").agg(F.count("*").alias("copies")))
    slots = checkpointed(id_slots(ids))
    single = _same(rows, slots.where("copies = 1").drop("copies"), ["source", "doc_id"])
    shared = slots.where("copies > 1").drop("copies")
    # Rows that share their id: equal ones are counted first, others are ranked by digest in 65,536 parts.
    many = rows.groupBy("source", "doc_id", "leaf", "tampered").agg(F.count("*").alias("n"))
    many = _same(many, shared, ["source", "doc_id"]).withColumn("part", F.substring("leaf", 1, 4))
    within = Window.partitionBy("source", "doc_id", "part").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    parts = many.groupBy("source", "doc_id", "part").agg(F.sum("n").alias("rows"))
    ahead = Window.partitionBy("source", "doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "doc_id", "part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    many = _same(many.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))), parts, ["source", "doc_id", "part"])
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    many = many.withColumn("copy", spread).withColumn("slot", F.col("slot") + F.col("ahead") + F.col("at") + F.col("copy"))
    cols = ["source", "slot", "total", "doc_id", "leaf", "tampered"]
    return single.select(*cols).unionByName(many.select(*cols))


# --- Levels ---------------------------------------------------------------------------------------------


def _h(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels_of(total: int, most: int) -> int:
    """Levels that a block of a tree with so many nodes makes: `most`, or as many as lead to one node."""
    levels, left = 0, total
    while left > 1 and levels < most:
        levels, left = levels + 1, -(-left // ARITY)
    return levels


def _reduce(digests: list[str], total: int, most: int) -> list[list[str]]:
    """A block's levels, from its own digests up to its root."""
    levels = [digests]
    for _ in range(_levels_of(total, most)):
        below = levels[-1]
        levels.append([_h(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _up(most: int):
    """Sorted `grp, block, slot, total, digest`: the root of each block."""
    names = ["grp", "slot", "total", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (grp, block), rows in _runs(batches, 2):
            total = rows[0][1]
            out.append((grp, block, -(-total // ARITY**most), _reduce([r[2] for r in rows], total, most)[-1][0]))
            if len(out) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _block(most: int) -> Column:
    return F.expr(f"slot div {ARITY**most}").alias("block")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "slot")


def build_levels(nodes: DataFrame, most: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Tables `grp, slot, total, digest` of every eighth (`most`th) level, from the nodes up to one root a group; each is checkpointed."""
    levels = [nodes]
    largest = nodes.agg(F.max("total")).first()[0] or 0
    while largest > 1:
        blocks = _by_block(levels[-1].select("grp", _block(most), "slot", "total", "digest"))
        levels.append(checkpointed(blocks.mapInArrow(_up(most), "grp string, slot long, total long, digest string")))
        largest = -(-largest // ARITY**most)
    return levels


def _paths(digests: list[str], total: int, above: str, most: int) -> list[str]:
    """Each digest's path to the root: for each level, its place in the run and its siblings, then `above`."""
    levels = _reduce(digests, total, most)
    paths = [above]
    for level in range(len(levels) - 2, -1, -1):
        nodes, down = levels[level], []
        for i in range(len(nodes)):
            run = i - i % ARITY
            down.append(f"{i % ARITY}{''.join(nodes[run:i] + nodes[i + 1 : run + ARITY])};{paths[i // ARITY]}")
        paths = down
    return paths


def fold(digest: str, path: str) -> str:
    """The root that a digest and a path lead to."""
    for step in path.split(";")[:-1]:
        at = 1 + 64 * int(step[0])
        digest = sha256(f"{step[1:at]}{digest}{step[at:]}".encode()).hexdigest()
    return digest


def siblings(path: str) -> str:
    """All siblings of a path, level by level, left to right."""
    return "".join(step[1:] for step in path.split(";"))


def _down(most: int):
    """Sorted blocks, each led by its root's path: the path of every member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _), rows in _runs(batches, 2):
            above, members = rows[0][3], rows[1:]
            paths = _paths([r[2] for r in members], members[0][1], above, most)
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(members), pa.string()), pa.array([r[0] for r in members], pa.int64()), pa.array(paths, pa.string())], ["grp", "slot", "path"])

    return run


def _led(nodes: DataFrame, above: DataFrame, most: int, of_nodes: tuple[str, ...] = (), of_lead: tuple[str, ...] = ()) -> DataFrame:
    """Nodes by block, each block led by one row (slot -1) with its root's path; further columns of either side are null on the other."""
    none = lambda table, c: F.lit(None).cast(table.schema[c].dataType).alias(c)
    lead = above.select(
        "grp", F.col("slot").alias("block"), F.lit(-1).cast("long").alias("slot"), none(nodes, "total"), none(nodes, "digest"), "path", *[none(nodes, c) for c in of_nodes], *of_lead
    )
    rows = nodes.select("grp", _block(most), "slot", "total", "digest", none(above, "path"), *of_nodes, *[none(above, c) for c in of_lead])
    return _by_block(lead.unionByName(rows))


def paths_down(levels: list[DataFrame], roots: DataFrame, most: int = BLOCK_LEVELS) -> DataFrame:
    """`grp, slot, path` one table above the first: the roots' paths handed down through the upper levels."""
    above = roots
    for nodes in reversed(levels[1:-1]):
        above = _led(nodes, above, most).mapInArrow(_down(most), "grp string, slot long, path string")
    return above


def _leaf_rows(root: str, most: int):
    """Sorted leaf blocks led by their paths: each leaf's proof and the root it leads to."""
    names = ["doc_id", "source", "leaf", "subroot", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, _), rows in _runs(batches, 2):
            above, subroot, members = rows[0][3], rows[0][6], rows[1:]
            paths = _paths([r[2] for r in members], members[0][1], above, most)
            for at in range(0, len(members), BATCH):
                part, ways = members[at : at + BATCH], paths[at : at + BATCH]
                n = len(part)
                columns = [
                    pa.array([r[4] for r in part], pa.int64()),
                    pa.array([source] * n, pa.string()),
                    pa.array([r[2] for r in part], pa.string()),
                    pa.array([subroot] * n, pa.string()),
                    pa.array([sha256(siblings(w).encode()).hexdigest() for w in ways], pa.string()),
                    pa.array([fold(r[5] or r[2], w) for r, w in zip(part, ways)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def number_groups(groups: DataFrame, name: str) -> DataFrame:
    """Adds `slot`, gapless from 0 in the order of a distinct string column (nulls first, bytewise), and `total`.

    Dealt by range, numbered within each partition, and moved by the number of rows in the partitions before.
    """
    dealt = groups.repartitionByRange(F.col(name).asc_nulls_first()).sortWithinPartitions(F.col(name).asc_nulls_first())
    marked = checkpointed(dealt.withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    # One row a partition.
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__rows").over(Window.partitionBy()).alias("total"))
    return marked.withColumn("__part", part).join(sizes, "__part").withColumn("slot", F.col("__ahead") + at).drop("__id", "__part", "__ahead")


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """`doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified` for every row.

    folded_root is worked out from the row's tampered leaf (its own where it isn't tampered with) and the untampered
    siblings. `block_levels` is the number of levels made in one block; it doesn't change the result.
    """
    rows = checkpointed(leaves(docs))
    placed = checkpointed(place_leaves(rows)).withColumn("digest", F.col("leaf")).withColumnRenamed("source", "grp")
    levels = build_levels(placed.select("grp", "slot", "total", "digest"), block_levels)
    # A group with fewer levels than others goes through the upper ones unchanged, so the last table has one root each.
    subroots = number_groups(levels[-1].select(F.col("grp").alias("source"), F.col("digest")), "source")
    tops = checkpointed(subroots.select(F.lit("").alias("grp"), "slot", "total", "digest", "source"))
    top_levels = build_levels(tops.select("grp", "slot", "total", "digest"), block_levels)
    first = top_levels[-1].first()
    root = first["digest"] if first is not None else ""
    top = docs.sparkSession.range(1 if first is not None else 0).select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("slot"), F.lit("").alias("path"))
    at_top = top
    if len(top_levels) > 1:
        at_top = _led(top_levels[0], paths_down(top_levels, top, block_levels), block_levels).mapInArrow(_down(block_levels), "grp string, slot long, path string")
    roots = tops.join(at_top.select("slot", "path"), "slot").select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("slot"), "path", F.col("digest").alias("subroot"))
    roots = checkpointed(roots)
    above = roots
    if len(levels) > 2:
        above = _same(paths_down(levels, roots.select("grp", "slot", "path"), block_levels), roots.select("grp", "subroot"), ["grp"])
    out = _led(placed, above, block_levels, ("doc_id", "tampered"), ("subroot",))
    out = out.mapInArrow(_leaf_rows(root, block_levels), "doc_id long, source string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "source", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
