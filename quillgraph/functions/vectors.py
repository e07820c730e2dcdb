"""An exact similarity join of unit vectors: a metric-space partition by pivots.

The corpus is dealt into cells by nearest pivot. For unit vectors a cosine of t is a distance of r = sqrt(2 - 2t), so
the triangle inequality says which cells may hold something within r of a query: the cell's distances to its pivot
reach into [d - r, d + r], and the plane halfway between the two pivots is no farther than r. A query is copied
into those cells only. Within a cell a pair is left out where the pivot distances differ by more than r, or
where its bound in the space of a few orthogonal pivots, q'.x' + |q - q'| |x - x'|, is under t; the rest is
compared in full. Large cells are worked on in chunks, so no task holds a cell.

Where only the connected components of the near pairs are asked for (`near_links`), vectors within r / 2 of the same pivot
are near each other unseen, and a task hands on a forest of what it finds instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.checkpoints import checkpointed

#: Vectors of the corpus in one piece of a cell, and queries that meet one piece in one task.
CHUNK, QUERY_CHUNK = 4096, 65_536
#: Vectors of neighbouring cells that queries of `near_links` meet in one task, at least and at most; in between about as
#: many as make REGIONS of the table, so that a vector is sent to a few regions however many vectors there are.
REGION, WIDEST, REGIONS = 16_384, 131_072, 8
#: Scores that a task of `near_links` holds at a time.
SCORES = 4 << 20
#: Bytes of pivots that go to every task, pivots at most, and sampled vectors for each of them.
PIVOT_BYTES, MOST_PIVOTS, DRAWN = 8 << 20, 512, 4
#: Scores are rounded to six digits; bounds allow for that.
SLACK = 1e-6


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # The norm is held in a struct: within the function of single elements it would be made for each of them.
    held = F.array(F.struct(vector.alias("v"), norm.alias("n")))
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(0.0))), 0)


@dataclass
class Pivots:
    """Pivots (rows), an orthonormal basis of some of them, and what each cell holds."""

    points: np.ndarray
    basis: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (v * v).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * v @ self.points.T))

    def cells(self, v: np.ndarray, threshold: float) -> np.ndarray:
        """For each query, a mask of the cells that may hold a vector of at least that cosine."""
        filled = np.broadcast_to(self.count > 0, (len(v), len(self.points)))
        if threshold <= 0:
            return filled
        r = np.sqrt(2 - 2 * min(1.0, threshold - SLACK)) + SLACK
        d = self.distances(v)
        ring = (d - r <= self.high) & (d + r >= self.low)
        near = d.argmin(1)
        between = np.sqrt(np.maximum(0.0, ((self.points[near][:, None, :] - self.points[None, :, :]) ** 2).sum(2)))
        plane = (d**2 - d[np.arange(len(v)), near][:, None] ** 2) / np.maximum(2 * between, 1e-12)
        return filled & ring & ((plane <= r) | (between < 1e-9))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def choose_pivots(corpus: DataFrame) -> Pivots | None:
    """Pivots of `id, vector`: farthest-first among a bounded draw by hash of id; None for an empty corpus.

    About the square root of the corpus's size, within PIVOT_BYTES and MOST_PIVOTS.
    """
    n = corpus.count()
    if n == 0:
        return None
    dims = len(corpus.first()["vector"])
    most = int(max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * dims), n**0.5)))
    drawn = corpus.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(DRAWN * most).select("vector").toArrow()
    sample = _matrix(drawn.column("vector"))
    picked = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < most and gap.max() > 1e-9:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(1))
    points = sample[picked]
    # The basis takes further drawn vectors where there are too few pivots; their order keeps the farthest first.
    spread = np.vstack([points, sample])[: max(1, dims)]
    q, upper = np.linalg.qr(spread.T)
    kept = np.abs(np.diag(upper)) > 1e-6
    empty = np.zeros(len(points))
    return Pivots(points, q[:, kept].T[: max(1, dims // 2)], empty, empty, empty)


def _assign(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(_matrix(batch.column("vector")))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "vector", "cell", "far"])

    return run


def _send(pivots: Pivots, threshold: float):
    """Copies each query into the cells that it may match in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = _matrix(part.column("vector"))
                row, cell = np.nonzero(pivots.cells(v, threshold))
                far = pivots.distances(v)[row, cell]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("vector"), pa.array(cell, pa.int32()), pa.array(far)], ["id", "vector", "cell", "far"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted pieces: each piece's corpus rows (side 0) once, then its queries (side 1) batch by batch."""
    key, held, corpus = None, [], None
    for batch in batches:
        cells, chunks, parts, sides = (np.asarray(batch.column(i)) for i in range(4))
        keys = np.stack([cells, chunks, parts, sides], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi == lo:
                continue
            piece, now = batch.slice(lo, hi - lo), tuple(keys[lo, :3])
            rows = (np.asarray(piece.column("id")), _matrix(piece.column("vector")), np.asarray(piece.column("far")))
            if now != key:
                key, held, corpus = now, [], None
            if sides[lo] == 0:
                held.append(rows)
                continue
            if held:
                corpus = tuple(np.concatenate([h[i] for h in held]) for i in range(3))
                held = []
            if corpus is not None:
                yield rows, corpus


def _compare(query: tuple, corpus: tuple, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (row of query, row of corpus, score) at least `threshold` alike, and how many were compared in full."""
    (_, q, dq), (_, x, dx) = query, corpus
    if threshold > 0:
        r = np.sqrt(2 - 2 * min(1.0, threshold - SLACK)) + SLACK
        qb, xb = q @ basis.T, x @ basis.T
        rest = lambda v, b: np.sqrt(np.maximum(0.0, (v * v).sum(1) - (b * b).sum(1)))
        bound = qb @ xb.T + np.outer(rest(q, qb), rest(x, xb))
        open_ = (bound >= threshold - SLACK) & (np.abs(dq[:, None] - dx[None, :]) <= r)
    else:
        open_ = np.ones((len(q), len(x)), dtype=bool)
    i, j = np.nonzero(open_)
    if len(i) * 4 > open_.size:
        scores = np.round((q @ x.T)[i, j], 6)
    else:
        scores = np.empty(len(i))
        for at in range(0, len(i), 65_536):
            cut = slice(at, at + 65_536)
            scores[cut] = np.round(np.einsum("ij,ij->i", q[i[cut]], x[j[cut]]), 6)
    hit = scores >= threshold
    return i[hit], j[hit], scores[hit], len(i)


def _pieces(queries: DataFrame, corpus: DataFrame, threshold: float) -> tuple[DataFrame, Pivots] | None:
    """Queries and corpus by (cell, chunk, part), sorted so that a piece's corpus rows come first."""
    pivots = choose_pivots(corpus)
    if pivots is None:
        return None
    kinds = "id long, vector array<double>, cell int, far double"
    dealt = corpus.select("id", "vector").mapInArrow(_assign(pivots), kinds)
    # One row a cell reaches the driver.
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
        for name, value in (("count", r.n), ("low", r.low), ("high", r.high)):
            held = getattr(pivots, name).copy()
            held[r.cell] = value
            setattr(pivots, name, held)
    sent = queries.select("query_id", "vector").mapInArrow(_send(pivots, threshold), kinds)
    asked = np.zeros(len(pivots.points), dtype=int)
    for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect():
        asked[r.cell] = r.n
    widths = F.array(*[F.lit(max(1, -(-int(n) // CHUNK))) for n in pivots.count])
    parts = F.array(*[F.lit(max(1, -(-int(n) // QUERY_CHUNK))) for n in asked])
    chunks, groups = F.get(widths, F.col("cell")), F.get(parts, F.col("cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    left = dealt.select("cell", one(chunks).alias("chunk"), every(groups).alias("part"), F.lit(0).alias("side"), "id", "vector", "far")
    right = sent.select("cell", every(chunks).alias("chunk"), one(groups).alias("part"), F.lit(1).alias("side"), "id", "vector", "far")
    keys = ["cell", "chunk", "part"]
    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side"), pivots


def similarity_join(queries: DataFrame, corpus: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """`query_id, id, score`: all pairs of unit vectors (`query_id, vector` and `id, vector`, long ids) at least `threshold` alike.

    Scores are rounded to six digits and the result is exact. With k, only the best k of each query (then the
    least ids), with their rank `k`. Zero vectors are unlike everything. Empty tables give no rows.
    """
    met = _pieces(queries, corpus, threshold)
    if met is None:
        none = queries.sparkSession.createDataFrame([], "query_id long, id long, score double")
        return none if k is None else none.withColumn("k", F.lit(0))
    pieces, pivots = met
    basis = pivots.basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, rows in _met(batches):
            for at in range(0, len(query[0]), 1024):
                part = tuple(c[at : at + 1024] for c in query)
                i, j, scores, _ = _compare(part, rows, basis, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(part[0][i], pa.int64()), pa.array(rows[0][j], pa.int64()), pa.array(scores, pa.float64())], ["query_id", "id", "score"])

    found = pieces.mapInArrow(run, "query_id long, id long, score double")
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def compared_pairs(queries: DataFrame, corpus: DataFrame, threshold: float) -> DataFrame:
    """One row `met, compared, found`: pairs that met in a task, of these compared in full, of these found."""
    met = _pieces(queries, corpus, threshold)
    if met is None:
        return queries.sparkSession.createDataFrame([(0, 0, 0)], "met long, compared long, found long")
    pieces, pivots = met
    basis = pivots.basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, rows in _met(batches):
            for at in range(0, len(query[0]), 1024):
                i, _, _, compared = _compare(tuple(c[at : at + 1024] for c in query), rows, basis, threshold)
                yield pa.RecordBatch.from_pydict({"met": [len(query[0][at : at + 1024]) * len(rows[0])], "compared": [compared], "found": [len(i)]})

    each = pieces.mapInArrow(run, "met long, compared long, found long")
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "compared", "found")])


def _groups(points: np.ndarray, reach: float) -> np.ndarray:
    """A number for each point, the same for points that are joined by steps of at most `reach`."""
    square = (points**2).sum(1)
    near = square[:, None] + square[None, :] - 2 * points @ points.T <= reach * abs(reach)
    np.fill_diagonal(near, True)
    label = np.arange(len(points))
    while True:
        least = np.where(near, label[None, :], len(points)).min(1)
        if (least == label).all():
            return label
        label = least


def _label(pivots: Pivots, core: float, group: np.ndarray):
    """Adds each vector's cell and `far`, here the group of its cell if the vector is within `core` of the pivot, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(_matrix(batch.column("vector")))
                cell = d.argmin(1)
                held = np.where(d[np.arange(len(d)), cell] <= core, group[cell], -1).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(held)], ["id", "vector", "cell", "far"])

    return run


def _send_regions(pivots: Pivots, threshold: float, group: np.ndarray, outer: np.ndarray, regions: np.ndarray):
    """Copies each vector into its own and the later regions that may hold something near it and not yet known to be linked to it.

    `regions` says for each cell (row) which regions (columns) hold its vectors; `outer` how many of a cell's are outside its core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, held = np.asarray(part.column("region")), np.asarray(part.column("far"))
                asked = pivots.cells(_matrix(part.column("vector")), threshold) & ((outer > 0)[None, :] | (group[None, :] != held[:, None]))
                to = (asked.astype(np.float32) @ regions > 0) & (np.arange(regions.shape[1])[None, :] >= own[:, None])
                row, region = np.nonzero(to)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("vector"), pa.array(region, pa.int32()), taken.column("far")], ["id", "vector", "cell", "far"])

    return run


def _forest(threshold: float):
    """Of the near pairs of a piece those that link what no earlier pair of the piece has linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label = None, None
        for (ids, q, _), corpus in _met(batches):
            names, x, far = corpus
            if corpus is not held:
                # Members of one group are linked already.
                first = np.unique(far, return_index=True, return_inverse=True)
                held, label = corpus, np.where(far >= 0, first[1][first[2]], np.arange(len(far)))
            a, b = [], []
            step = max(1, SCORES // max(1, len(x)))
            for at in range(0, len(ids), step):
                scores = q[at : at + step] @ x.T
                for i, row in enumerate(scores):
                    j = np.flatnonzero(row >= threshold - SLACK)
                    j = j[(np.round(row[j], 6) >= threshold) & (names[j] != ids[at + i])]
                    if not len(j):
                        continue
                    seen = label[j]
                    if seen.min() == seen.max():
                        at_label = [0]
                    else:
                        met, at_label = np.unique(seen, return_index=True)
                        label[np.isin(label, met)] = met[0]
                    a.extend([ids[at + i]] * len(at_label))
                    b.extend(names[j[at_label]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_links(corpus: DataFrame, threshold: float) -> DataFrame:
    """`a, b`: links of ids (`id, vector`, unit vectors) with the same connected components as all pairs at least `threshold` alike.

    Exact, and no more than a few links for each vector and region: copies of a vector hang on one of them; vectors within half
    the radius of a pivot hang on one of these, and pivots that are near each other make their cells one group. What is
    left is compared region by region, each two regions once.
    """
    if threshold <= 0:
        pairs = similarity_join(corpus.select(F.col("id").alias("query_id"), "vector"), corpus, threshold)
        return pairs.where("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    some = corpus.where(F.exists("vector", lambda x: x != 0)).select("id", "vector")
    unique = checkpointed(some.groupBy("vector").agg(F.min("id").alias("id")))
    pivots = choose_pivots(unique)
    if pivots is None:
        return corpus.sparkSession.createDataFrame([], "a long, b long")
    copies = some.join(unique.withColumnRenamed("id", "b"), "vector").where("id <> b").select(F.col("id").alias("a"), "b")
    radius = np.sqrt(max(0.0, 2 - 2 * threshold))
    group = _groups(pivots.points, radius - SLACK)
    dealt = checkpointed(unique.select("id", "vector").mapInArrow(_label(pivots, radius / 2 - SLACK, group), "id long, vector array<double>, cell int, far double"))
    # One row a cell reaches the driver.
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.sum((F.col("far") < 0).cast("int")).alias("outer"), F.min(F.when(F.col("far") >= 0, F.col("id"))).alias("hub")).collect()
    size, outer, hub = np.zeros(len(group), dtype=int), np.zeros(len(group), dtype=int), {}
    for r in cells:
        size[r.cell], outer[r.cell] = r.n, r.outer
        if r.hub is not None:
            hub[r.cell] = r.hub
    pivots.count, pivots.low, pivots.high = size, np.full(len(size), -np.inf), np.full(len(size), np.inf)
    # Cells of one group stand together, so that few regions hold several groups.
    most = min(max(REGION, WIDEST), max(REGION, int(size.sum()) // REGIONS))
    first, width, at, room = np.zeros(len(size), dtype=int), np.maximum(1, -(-size // most)), 0, most
    for c in np.argsort(group, kind="stable"):
        if room < size[c]:
            at, room = at + 1, most
        first[c], at = at, at + width[c] - 1
        room = room - size[c] if width[c] == 1 else 0
    regions = np.zeros((len(size), at + 1), dtype=np.float32)
    for c in range(len(size)):
        regions[c, first[c] : first[c] + width[c]] = 1
    place = F.get(F.array(*[F.lit(int(x)) for x in first]), F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(F.array(*[F.lit(int(x)) for x in width]), F.col("cell"))).cast("int")
    placed = dealt.withColumn("region", place)
    sent = checkpointed(placed.mapInArrow(_send_regions(pivots, threshold, group, outer, regions), "id long, vector array<double>, cell int, far double"))
    asked = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # Queries pass batch by batch, so their number in a task may follow the table; each part brings the region's vectors along.
    passing = max(QUERY_CHUNK, int(size.sum()) // REGIONS)
    parts = F.array(*[F.lit(max(1, -(-asked.get(c, 0) // passing))) for c in range(at + 1)])
    keys = ["cell", "chunk", "part"]
    left = placed.where(F.col("region").isin(*asked) if asked else F.lit(False)).select(F.col("region").alias("cell"), "id", "vector", "far").withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1)))
    right = sent.withColumn("part", F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell"))).cast("int"))
    sides = [d.select("cell", F.lit(0).alias("chunk"), "part", F.lit(side).alias("side"), "id", "vector", "far") for side, d in enumerate((left, right))]
    pieces = sides[0].unionByName(sides[1]).repartition(*keys).sortWithinPartitions(*keys, "side")
    found = pieces.mapInArrow(_forest(threshold), "a long, b long")
    # The hub of each core's first cell stands for its group.
    heads = {}
    for c in sorted(hub):
        heads.setdefault(int(group[c]), hub[c])
    head = F.get(F.array(*[F.lit(heads.get(g)).cast("long") for g in range(len(group))]), F.col("far").cast("int"))
    cores = dealt.where("far >= 0").select(F.col("id").alias("a"), head.alias("b")).where("a <> b")
    return checkpointed(copies.unionByName(cores).unionByName(found))
