"""The prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

Conversations are sorted by their turns' digests, dealt by range. Neighbours in that order are linked by the
length of their longest common prefix (LCP). Each partition takes its links in descending depth: a link joins
two components, and every join makes (or widens) the branching node at that depth. What can still grow - the
nodes that touch an end of the partition - is contracted to one stub a node; all else is final. Stubs of
neighbouring partitions are joined by the same routine, with one more link across each boundary, several
blocks at a time, until one block is left. A node's path to its parent (a chain of nodes with one child and
the same members) is written out at the end.

Sums over subtrees need no second pass: a component carries its members, leaves and saved bytes below its top
node, and a join at depth d adds what lies between. A group of equal conversations is split across partitions
like any other (they share a prefix of their whole length), so no task holds a group; digests of members
are fed piece by piece. A conversation takes 24 bytes a turn of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, shuffle_width

#: Bytes of a turn's digest within a key.
DIGEST = 16
#: Blocks of stubs that one task joins in a round.
FAN_IN = 8
#: Ids in one piece of a group's members.
PIECE = 4096
#: Bytes of sampled sort keys that may reach the driver when ranges are chosen; about 60 keys a partition are drawn.
SAMPLE_BYTES = 256 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()

CLOSED, STUB, MEMBERS = 0, 1, 2
ROW = (
    "kind int, block long, place long, id binary, conv_id long, depth long, parent_depth long, parent_id binary, parent_conv_id long, "
    "n long, children long, leaves long, below long, weight long, ends string, key binary, sizes array<long>"
)
NAMES = [c.split(" ")[0] for c in ROW.split(", ")]


def turn_keys(convs: DataFrame) -> DataFrame:
    """`conv_id, turns` of every conversation: array(struct(digest, size)) in order, digest and UTF-8 size of the text of each turn.

    Turns go by turn (nulls first), then role, then the text's SHA-256; null roles and texts count as empty, repeated
    rows are turns of their own. Rows without a conv_id belong to no conversation. No text is shuffled.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text, 256)
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, sha), 256), 1, 2 * DIGEST)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), sha.alias("sha"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuild(keys: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that share openings: the first h turns of conversation c - c mod `family`, then c's own after its first h.

    h is crc32 of the decimal id, modulo `heads`. An absent base gives no turns. The remainder is not negative.
    """
    base = keys.where(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, heads - 1).alias("__opening"))
    own = keys.withColumn("__base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).withColumn("__h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    opening = F.slice(F.coalesce("__opening", F.array().cast("array<struct<digest:string,size:bigint>>")), F.lit(1), F.col("__h"))
    rest = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(base, "__base", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def _lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    if a == b:
        return len(a) // DIGEST
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * DIGEST] == b[: mid * DIGEST] else (lo, mid - 1)
    return lo


def _prefix_id(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[: depth * DIGEST]).digest()[:DIGEST]


class _Forest:
    """Items in sorted order (leaves or stubs) and the nodes made of them. Index i of a list is node i."""

    def __init__(self) -> None:
        self.depth: list[int] = []
        self.conv: list[int] = []
        self.n: list[int] = []
        self.children: list[int] = []
        self.leaves: list[int] = []
        self.below: list[int] = []
        self.weight: list[int] = []
        self.id: list[bytes | None] = []
        self.ends: list[str | None] = []
        self.links: list[tuple[int, int]] = []

    def add(self, depth: int, conv: int | None, n: int, children: int, leaves: int, below: int, weight: int, id_: bytes | None = None, ends: str | None = None) -> None:
        for name, value in zip(("depth", "conv", "n", "children", "leaves", "below", "weight", "id", "ends"), (depth, conv, n, children, leaves, below, weight, id_, ends)):
            getattr(self, name).append(value)

    def join(self) -> None:
        """Takes the links in descending depth; every merge of two components makes or widens a node.

        Sets `up` (a node's parent), `same` (the node that a node at the same depth was merged into), `lo` and `hi`
        (first and last item below a node).
        """
        items = len(self.depth)
        root, top = list(range(items)), list(range(items))
        self.up, self.same = [-1] * items, list(range(items))
        self.lo, self.hi = list(range(items)), list(range(items))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in sorted(range(items - 1), key=lambda k: (-self.links[k][0], k)):
            d, weight = self.links[i]
            a, b = find(i), find(i + 1)
            x, y = top[a], top[b]
            if self.depth[x] == d:
                node, others = x, [y]
            elif self.depth[y] == d:
                node, others = y, [x]
            else:
                self.add(d, None, 0, 0, 0, 0, weight)
                node, others = len(self.depth) - 1, [x, y]
                self.up.append(-1)
                self.same.append(node)
                self.lo.append(self.lo[x])
                self.hi.append(self.hi[y])
            for o in others:
                if self.depth[o] == d:
                    self.same[o] = node
                    self.id[node] = self.id[node] or self.id[o]
                    self.ends[node] = self.ends[node] or self.ends[o]
                    self._take(node, o, True)
                else:
                    self.up[o] = node
                self.lo[node], self.hi[node] = min(self.lo[node], self.lo[o]), max(self.hi[node], self.hi[o])
            root[b] = a
            top[a] = node

    def _take(self, to: int, of: int, same: bool) -> None:
        """Adds a node's totals to another: the same node in another part, or its parent."""
        self.n[to] += self.n[of]
        self.conv[to] = min((c for c in (self.conv[to], self.conv[of]) if c is not None), default=None)
        if same:
            self.children[to] += self.children[of]
            self.leaves[to] += self.leaves[of]
            self.below[to] += self.below[of]
        else:
            self.children[to] += 1
            self.leaves[to] += self.leaves[of] or 1
            self.below[to] += self.below[of] + (self.n[of] - 1) * (self.weight[of] - self.weight[to])

    def target(self, x: int) -> int:
        while self.same[x] != x:
            x = self.same[x]
        return x

    def rows(self, block: int, last_block: bool, first: tuple[bytes, np.ndarray], last: tuple[bytes, np.ndarray]) -> Iterator[dict]:
        """Closed nodes with their parents, and the stubs of the open ones in order."""
        self.join()
        end = max(self.hi)
        real = [x for x in range(len(self.depth)) if self.same[x] == x]
        is_open = {x: not last_block and (self.lo[x] == 0 or self.hi[x] == end) for x in real}
        real.sort(key=lambda x: -self.depth[x])
        parent = {x: self.target(self.up[x]) if self.up[x] >= 0 else -1 for x in real}
        for x in real:
            if parent[x] >= 0 and not is_open[x]:
                self._take(parent[x], x, False)
        for x in real:
            if is_open[x] and self.id[x] is None:
                self.id[x] = _prefix_id(first[0] if self.lo[x] == 0 else last[0], self.depth[x])
        for x in real:
            if is_open[x]:
                continue
            up = parent[x]
            row = self._row(x, CLOSED, block)
            row["parent_depth"] = self.depth[up] if up >= 0 else -1
            if up >= 0 and is_open[up]:
                row["parent_id"] = self.id[up]
            elif up >= 0:
                row["parent_conv_id"] = self.conv[up]
            yield row
        left = [x for x in real if is_open[x] and self.lo[x] == 0]
        right = [x for x in reversed(real) if is_open[x] and self.lo[x] != 0]
        stubs = left + right
        for place, x in enumerate(stubs):
            row = self._row(x, STUB, block) | {"place": place}
            if place == 0:
                row |= {"key": first[0], "sizes": first[1]}
            if place == len(stubs) - 1:
                row |= {"key": last[0], "sizes": last[1]} if place else {}
            yield row

    def _row(self, x: int, kind: int, block: int) -> dict:
        return dict.fromkeys(NAMES) | {
            "kind": kind, "block": block, "id": self.id[x], "conv_id": self.conv[x], "depth": self.depth[x], "n": self.n[x],
            "children": self.children[x], "leaves": self.leaves[x], "below": self.below[x], "weight": self.weight[x], "ends": self.ends[x],
        }


def _frames(rows: Iterator[dict], size: int = 20_000) -> Iterator[pd.DataFrame]:
    """Rows in bounded data frames; objects all through, so that nulls stay nulls."""
    block: list[dict] = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pd.DataFrame(block, columns=NAMES, dtype=object)
            block = []
    if block:
        yield pd.DataFrame(block, columns=NAMES, dtype=object)


def _weight(sizes: np.ndarray, depth: int) -> int:
    return int(np.asarray(sizes[:depth], dtype=np.int64).sum()) if depth else 0


def _partition(piece_size: int):
    """One sorted partition of `conv_id, key, sizes`: its forest, and the members of each group of equal keys.

    A small group within the partition gets its digest here. A large one, or one that touches an end of the
    partition, goes on in pieces of ids, as its digest is to be fed in order of all pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            forest = _Forest()
            first = before = None
            ids, in_pieces = [], True

            def piece() -> dict:
                return dict.fromkeys(NAMES) | {"kind": MEMBERS, "block": block, "place": ids[0], "id": _prefix_id(before[0], len(before[0]) // DIGEST), "ends": ",".join(map(str, ids))}

            for batch in batches:
                for conv_id, key, sizes in zip(batch["conv_id"].tolist(), batch["key"], batch["sizes"]):
                    key, sizes = bytes(key), np.asarray(sizes, dtype=np.int64)
                    if before is not None:
                        depth = _lcp(before[0], key)
                        forest.links.append((depth, _weight(sizes, depth)))
                        if key != before[0]:
                            if in_pieces:
                                yield piece()
                                forest.id[-1] = _prefix_id(before[0], len(before[0]) // DIGEST)
                            else:
                                forest.ends[-1] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                            ids, in_pieces = [], False
                        elif len(ids) == piece_size:
                            yield piece()
                            ids, in_pieces = [], True
                    else:
                        first = (key, sizes)
                    ids.append(conv_id)
                    forest.add(len(key) // DIGEST, conv_id, 1, 0, 0, 0, int(sizes.sum()))
                    before = (key, sizes)
            if before is not None:
                yield piece()
                yield from forest.rows(block, False, first, before)

        yield from _frames(rows())

    return run


def _join_blocks(last: bool, fan_in: int):
    """Joins the stubs of a few blocks in a row, with one link across each boundary."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "place"], kind="stable")
        forest, first, before, block_before = _Forest(), None, None, None
        for r in frame.to_dict("records"):
            key = None if r["key"] is None or r["key"] is pd.NA or isinstance(r["key"], float) else (bytes(r["key"]), np.asarray(r["sizes"], dtype=np.int64))
            depth = int(r["depth"])
            if block_before == r["block"]:
                link = min((depth, int(r["weight"])), (forest.depth[-1], forest.weight[-1]))
                forest.links.append(link)
            elif block_before is not None:
                shared = _lcp(before[0], key[0])
                forest.links.append((shared, _weight(key[1], shared)))
            first = first or key
            before = key or before
            block_before = r["block"]
            ends = r["ends"] if isinstance(r["ends"], str) else None
            forest.add(depth, None if pd.isna(r["conv_id"]) else int(r["conv_id"]), int(r["n"]), int(r["children"]), int(r["leaves"]), int(r["below"]), int(r["weight"]), bytes(r["id"]), ends)
        out = list(forest.rows(int(frame["block"].iloc[0]) // fan_in, last, first, before))
        return pd.DataFrame(out, columns=NAMES, dtype=object)

    return join


def _member_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by (id, place): the digest of each id's joined pieces, fed one after the other."""
    now, sha = None, None
    for batch in batches:
        out = []
        for id_, text in zip(batch["id"], batch["ends"]):
            id_ = bytes(id_)
            if id_ != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = id_, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield pd.DataFrame(out, columns=["id", "members"])
    if now is not None:
        yield pd.DataFrame([(now, sha.hexdigest())], columns=["id", "members"])


def _compressed(keys: DataFrame, fan_in: int, piece: int) -> DataFrame:
    """Branching nodes, ends of conversations and the root, each with its parent's depth and smallest member."""
    spark = keys.sparkSession
    seq = keys.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    mean = keys.agg(F.avg(F.size("turns"))).first()[0] or 0
    width = int(max(1, min(shuffle_width(spark), SAMPLE_BYTES // (60 * (DIGEST * mean + 16)))))
    dealt = seq.repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = checkpointed(dealt.mapInPandas(_partition(piece), ROW))
    members = rows.where(F.col("kind") == MEMBERS).select("id", "place", "ends")
    digests = members.repartition("id").sortWithinPartitions("id", "place").mapInPandas(_member_digests, "id binary, members string")
    closed = rows.where(F.col("kind") == CLOSED)
    stubs = rows.where(F.col("kind") == STUB)
    blocks = (stubs.agg(F.max("block")).first()[0] or 0) + 1
    while True:
        last = blocks <= fan_in
        joined = checkpointed(stubs.groupBy(F.expr(f"block div {fan_in}")).applyInPandas(_join_blocks(last, fan_in), ROW))
        closed = closed.unionByName(joined.where(F.col("kind") == CLOSED))
        if last:
            break
        stubs, blocks = joined.where(F.col("kind") == STUB), -(-blocks // fan_in)
    # Only nodes that once touched an end of a block have an id: a few a block.
    once_open = closed.where("id is not null").select(F.col("id").alias("parent_id"), F.col("conv_id").alias("__parent"))
    out = closed.join(once_open, "parent_id", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__parent"))
    ends = digests.select("id", "members")
    return out.join(ends, "id", "left").withColumn("ends", F.coalesce("members", "ends", F.lit(NO_ENDS))).drop("__parent", "members", "kind", "block", "place", "key", "sizes", "parent_id", "id")


def prefix_trie(keys: DataFrame, fan_in: int = FAN_IN, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of `conv_id, turns` (see `turn_keys`), the textless root of depth 0 included.

    `conv_id` is the smallest member, `parent_conv_id` the parent's (root: null), `n_convs` members, `n_children`, `n_leaves` childless
    nodes of the subtree, `saved_tokens` the subtree's sum of (members - 1) times the UTF-8 bytes of a node's last
    text, `ends_sha256` the digest of the ids that end here. conv_id is unique and not null; a conversation
    without turns is a member of the root. An empty table gives no rows. `fan_in` blocks are joined at a time and ids are
    digested `piece` by `piece`; neither changes the result.
    """
    keys = checkpointed(keys)
    nodes = _compressed(keys, fan_in, piece).withColumn("leaves", F.greatest("leaves", F.lit(1)))
    step = F.explode(F.sequence(F.col("parent_depth") + 1, F.col("depth")))
    alone = nodes.where("n = 1").select("*", step.alias("__at"), F.lit(0).cast("long").alias("__above"))
    # Nodes of several members need the bytes of each turn of their chain, which any member has.
    sizes = keys.select("conv_id", F.transform("turns", lambda t: t["size"]).alias("__sizes"))
    chain = F.slice("__sizes", F.greatest(F.col("parent_depth") + 1, F.lit(1)), F.greatest(F.col("depth") - F.greatest("parent_depth", F.lit(0)), F.lit(0)))
    shared = nodes.where("n > 1").join(sizes, "conv_id").withColumn("__sizes", chain).withColumn("__part", F.expr("aggregate(__sizes, 0L, (a, x) -> a + x)"))
    shared = shared.mapInPandas(_chains, "conv_id long, depth long, parent_depth long, parent_conv_id long, n long, children long, leaves long, below long, ends string, __at long, __above long")
    cols = ["conv_id", "depth", "parent_depth", "parent_conv_id", "n", "children", "leaves", "below", "ends", "__at", "__above"]
    rows = alone.select(*cols).unionByName(shared.select(*cols))
    own = F.col("__at") == F.col("depth")
    first = F.col("__at") == F.col("parent_depth") + 1
    return rows.select(
        "conv_id",
        F.col("__at").alias("depth"),
        F.when(F.col("__at") > 0, F.when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(own, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * F.col("__above")).alias("saved_tokens"),
        F.when(own, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node once for every depth of its chain, with the bytes of the turns from there down to its own."""
    kept = ["conv_id", "depth", "parent_depth", "parent_conv_id", "n", "children", "leaves", "below", "ends"]
    for batch in batches:
        for row in range(0, len(batch), 1000):
            part = batch.iloc[row : row + 1000]
            at = [np.arange(p + 1, d + 1) for p, d in zip(part["parent_depth"], part["depth"])]
            above = []
            for steps, sizes in zip(at, part["__sizes"]):
                sums = np.cumsum(np.asarray(sizes, dtype=np.int64)[::-1])[::-1]
                above.append(np.concatenate([sums[:1] if len(sums) else np.zeros(1, dtype=np.int64), sums]) if len(steps) > len(sums) else sums)
            out = part[kept].loc[part.index.repeat([len(a) for a in at])].reset_index(drop=True)
            out["__at"], out["__above"] = np.concatenate(at), np.concatenate(above)
            out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
            yield out


def conversation_trie(convs: DataFrame) -> DataFrame:
    """The trie of a table's rebuilt conversations (see `rebuild`); turns are ordered as in `turn_keys`."""
    return prefix_trie(rebuild(turn_keys(convs)))
