"""Greedy clustering of entities: the merge gate, the pass over one component, and rounds over giant blocks.

The greedy pass takes entities in a fixed order (most seen first, then by name); each joins the nearest cluster
that the gate lets it into, or founds one. Only clusters with a member at least BLOCK_COSINE near can
take an entity, so entities and clusters that aren't connected by such pairs don't depend on each other.

A block of a bearable size is one pass. Giant blocks are decided in rounds: the next entities in the order and the
clusters that may take one of them, which are one pass in one task. Where the near pairs among these fall into small
components a round reaches farther, and each component is one pass. A cluster goes on as one row: its distinct
names, types, section counts and vector sum. Rounds of one task each follow one another within a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph import config
from quillgraph.functions.checkpoints import checkpointed, scratch
from quillgraph.functions.components import connected_components
from quillgraph.functions.vectors import near_links, similarity_join, unit

#: Entities that one task decides.
GIANT_BLOCK = 20_000
#: How much farther a round is tried to reach at a time.
WIDER = 4
#: Clusters that a round of one task takes along unasked, and rounds at most that are one job.
HELD_CLUSTERS, TURNS = 20_000, 16
#: Places of the letter counts that bound how alike two names are.
SIGNS = 128
#: Members of one cluster are linked by pairs at least this near: the square of the merge threshold.
BLOCK_COSINE = config.MERGE_BASE**2
FEATURES = ["name", "type", "times_seen", "sections", "normalised", "tokens", "letters", "initials", "sentence_like", "blocked", "polysemous", "vector"]


def lexical(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def section_shares(sections: dict | None) -> dict:
    total = sum(v for v in (sections or {}).values() if v > 0)
    return {k: v / total for k, v in sections.items() if v > 0} if total else {}


def _top_sections(sections: dict, n: int = 2) -> set:
    return {k for k, _ in sorted(sections.items(), key=lambda kv: (-kv[1], kv[0]))[:n]}


def _sign_counts(names: list[str]) -> np.ndarray:
    """How often a name (row) has letters of each place."""
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(names)), [len(n) for n in names])
    return np.bincount(row * SIGNS + codes % SIGNS, minlength=len(names) * SIGNS).reshape(-1, SIGNS).astype(np.int32)


class Names:
    """A cluster's distinct normalised names with their tokens, letters, initials and flag.

    Those of earlier rounds stay Arrow structs, of which only what is asked for is looked at; the first `old` of them are
    kept elsewhere.
    """

    def __init__(self, earlier: Sequence[pa.StructArray] = (), old: int = 0):
        self.earlier, self.old = pa.concat_arrays(earlier).cast(_NAME) if earlier else None, old
        self.new: dict[str, dict] = {}
        self.tokens, self.letters, self.initials = set(), set(), set()
        self.blocked = bool(earlier) and bool(pc.any(self.earlier.field("blocked")).as_py())
        self.listed, self.counts, self.lengths = [], np.zeros((0, SIGNS), dtype=np.int32), np.zeros(0, dtype=int)

    def __contains__(self, name: str) -> bool:
        return name in self.new or self._held("name", name)

    def _held(self, column: str, value: str) -> bool:
        return self.earlier is not None and pc.index(self.earlier.field(column), value).as_py() >= 0

    def add(self, c: dict) -> None:
        if c["normalised"] in self:
            return
        self.new[c["normalised"]] = {"name": c["normalised"], "tokens": sorted(set(c["tokens"])), "letters": c["letters"], "initials": c["initials"], "blocked": bool(c["blocked"])}
        self.tokens.update(c["tokens"])
        self.letters.add(c["letters"])
        self.initials.add(c["initials"])
        self.blocked = self.blocked or bool(c["blocked"])

    def share(self, tokens: set) -> bool:
        if tokens & self.tokens:
            return True
        if self.earlier is None or not tokens:
            return False
        held = self.earlier.field("tokens").flatten()
        return bool(pc.any(pc.is_in(held, value_set=pa.array(sorted(tokens), held.type))).as_py())

    def bridge(self, letters: str, initials: str | None) -> bool:
        """Whether the initials are a name's letters or the letters a name's initials."""
        return bool(initials and (initials in self.letters or self._held("letters", initials)) or letters and (letters in self.initials or self._held("initials", letters)))

    def alike(self, name: str, least: float) -> bool:
        """Whether one of the names is at least `least` alike; only names whose letters allow it are compared."""
        first = len(self.earlier) if self.earlier is not None else 0
        if len(self.listed) < first + len(self.new):
            self.listed = self.listed or (self.earlier.field("name").to_pylist() if first else [])
            self.listed += list(self.new)[len(self.listed) - first :]
            known = len(self.lengths)
            more = _sign_counts(self.listed[known:])
            self.counts, self.lengths = np.concatenate([self.counts, more]), np.concatenate([self.lengths, more.sum(1)])
        # The ratio's own upper bound, by the same formula.
        both = self.lengths + len(name)
        bound = np.where(both > 0, 2.0 * np.minimum(self.counts, _sign_counts([name])).sum(1) / np.maximum(both, 1), 1.0)
        return any(lexical(name, self.listed[i]) >= least for i in np.argsort(-bound, kind="stable")[: np.count_nonzero(bound >= least)])

    def rows(self, whole: bool) -> list[pa.StructArray]:
        """All names as structs, or those that aren't kept elsewhere."""
        held = [] if self.earlier is None else [self.earlier if whole else self.earlier[self.old :]]
        return [*held, pa.array(list(self.new.values()), _NAME)]


@dataclass
class Cluster:
    """What the gate asks of a cluster."""

    founder: int
    sum: np.ndarray
    names: Names = field(default_factory=Names)
    types: set = field(default_factory=set)
    sections: dict = field(default_factory=dict)

    def take(self, c: dict, first: bool = False) -> None:
        if not first:
            self.sum = self.sum + c["vector"]
        self.names.add(c)
        self.types.add(c["type"])
        for k, n in (c["sections"] or {}).items():
            self.sections[k] = self.sections.get(k, 0) + n

    def centre(self) -> np.ndarray:
        return self.sum / (np.linalg.norm(self.sum) or 1.0)


def may_merge(candidate: dict, cluster: Cluster, score: float) -> bool:
    """Whether a candidate may join a cluster whose centroid is `score` near: names, thresholds and sections."""
    names = cluster.names
    same = candidate["normalised"] in names
    if not same and (len(candidate["tokens"]) > config.NAME_MAX_TOKENS or len(candidate["name"]) > config.NAME_MAX_CHARS or candidate["sentence_like"]):
        return False
    blocked = candidate["blocked"] or names.blocked
    poly = candidate["polysemous"] or len([v for v in cluster.sections.values() if v > 0]) >= config.POLYSEMY_SECTIONS
    if blocked:
        bar = near_bar = config.MERGE_BLOCKED
    elif poly:
        bar = near_bar = config.MERGE_POLYSEMOUS
    else:
        bar = config.MERGE_BASE + (config.MERGE_SAME_TYPE if candidate["type"] in cluster.types else config.MERGE_CROSS_TYPE)
        near_bar = bar + config.MERGE_LEXICAL
    # The search that offers a cluster has cut at the base threshold already.
    over, over_near = (score >= max(b, config.MERGE_BASE) for b in (bar, near_bar))
    if not over and not over_near:
        return False
    # Names are compared letter by letter only where that decides.
    if over != over_near and not (over_near if same or names.alike(candidate["normalised"], config.LEXICAL_HIGH) else over):
        return False
    if not same and not names.share(set(candidate["tokens"])) and not names.bridge(candidate["letters"], candidate["initials"]) and not names.alike(candidate["normalised"], config.LEXICAL_MIN):
        return False
    if blocked:
        a, b = section_shares(candidate["sections"]), section_shares(cluster.sections)
        return all(abs(a.get(k, 0) - b.get(k, 0)) <= config.SECTION_SHARE for k in a.keys() | b.keys())
    if poly:
        a, b = _top_sections(candidate["sections"] or {}), _top_sections(cluster.sections)
        return not (a | b) or len(a & b) / len(a | b) >= config.SECTION_JACCARD
    return True


def greedy_pass(candidates: Iterable[dict], clusters: list[Cluster]) -> list[int]:
    """The founder of each candidate's cluster; candidates have a place `no` and come in order, clusters by founder.

    Clusters are changed and added to. Of equally near clusters the one founded first is asked first.
    """
    centres = np.array([c.centre() for c in clusters]) if clusters else None
    owners = []
    for c in candidates:
        # Nine digits: the last bits of a product depend on how many clusters are in the matrix.
        scores = np.round(centres[: len(clusters)] @ c["vector"], 9) if clusters else np.zeros(0)
        for j in sorted(np.flatnonzero(scores >= config.MERGE_BASE), key=lambda j: (-scores[j], j)):
            if may_merge(c, clusters[j], float(scores[j])):
                clusters[j].take(c)
                centres[j] = clusters[j].centre()
                owners.append(clusters[j].founder)
                break
        else:
            new = Cluster(c["no"], c["vector"])
            new.take(c, first=True)
            clusters.append(new)
            if centres is None or len(clusters) > len(centres):
                more = np.zeros((max(16, 2 * len(clusters)), len(c["vector"])))
                more[: len(clusters) - 1] = centres[: len(clusters) - 1] if centres is not None else 0
                centres = more
            centres[len(clusters) - 1] = new.centre()
            owners.append(c["no"])
    return owners


def _candidate(row: dict) -> dict:
    return {**row, "tokens": list(row["tokens"]), "sections": dict(row["sections"] or {}), "vector": np.asarray(row["vector"], dtype=float)}


def sequence_number(entities: DataFrame) -> DataFrame:
    """Adds `no`, the place in the greedy order; dealt by range and numbered within partitions, so no task holds the table."""
    keys = [F.desc("times_seen"), F.col("normalised"), F.col("name")]
    marked = checkpointed(entities.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    ahead, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        ahead[r["part"]] = total
        total += r["n"]
    if not ahead:
        return marked.withColumn("no", F.lit(0).cast("long")).drop("__id")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv]), part)
    return marked.withColumn("no", (base + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__id")


def _small_blocks(entities: DataFrame) -> DataFrame:
    """`no, founder` of entities with `no, block`, a block at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [_candidate(r) for r in pdf.sort_values("no").to_dict("records")]
        return pd.DataFrame({"no": [r["no"] for r in rows], "founder": greedy_pass(rows, [])})

    return entities.select("no", "block", *FEATURES).groupBy("block").applyInPandas(run, "no long, founder long")


_STATE = "founder long, sum array<double>, names array<struct<name:string,tokens:array<string>,letters:string,initials:string,blocked:boolean>>, types array<string>, counts array<struct<section:string,n:long>>, taken array<long>, turn int"
_NAME = pa.struct([("name", pa.string()), ("tokens", pa.list_(pa.string())), ("letters", pa.string()), ("initials", pa.string()), ("blocked", pa.bool_())])
_COUNT = pa.struct([("section", pa.string()), ("n", pa.int64())])


def _round(component: pa.Table, turn: int = 1, last: bool = True) -> pa.Table:
    """One component: its entities with `no`, its clusters as rows with `founder`; the new states, each with the entities `taken` in this job.

    Of a job's rounds the first gets whole states (turn 0) and the last gives them. In between states are those of the turn
    before, with the names that the whole ones, which each round gets, don't have.
    """
    held = component.filter(pc.is_valid(component["founder"]))
    wholes, states = (held.filter(pc.equal(held["turn"], t)) for t in (0, turn - 1))
    kept = {f: n.values for f, n in zip(wholes["founder"].to_pylist(), wholes["names"])}
    clusters, taken = [], {}
    for r, since in zip(states.select(["founder", "sum", "types", "counts", "taken"]).to_pylist(), states["names"]):
        earlier = [x for x in (kept.get(r["founder"]), since.values if turn > 1 else None) if x is not None]
        names = Names(earlier, len(kept.get(r["founder"], ())))
        clusters.append(Cluster(r["founder"], np.asarray(r["sum"], dtype=float), names, set(r["types"]), {s["section"]: s["n"] for s in r["counts"]}))
        taken[r["founder"]] = r["taken"] if turn > 1 else []
    clusters.sort(key=lambda c: c.founder)
    entities = component.filter(pc.is_valid(component["no"])).select(["no", *FEATURES]).to_pylist()
    rows = sorted(map(_candidate, entities), key=lambda r: r["no"])
    for r, owner in zip(rows, greedy_pass(rows, clusters)):
        taken.setdefault(owner, []).append(r["no"])
    pieces = [c.names.rows(last) for c in clusters]
    ends = np.cumsum([0, *(sum(map(len, p)) for p in pieces)])
    names = pa.concat_arrays([x for p in pieces for x in p])
    columns = {
        "founder": pa.array([c.founder for c in clusters], pa.int64()),
        "sum": pa.array([c.sum.tolist() for c in clusters], pa.list_(pa.float64())),
        "names": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names),
        "types": pa.array([list(c.types) for c in clusters], pa.list_(pa.string())),
        "counts": pa.array([[{"section": k, "n": int(n)} for k, n in c.sections.items()] for c in clusters], pa.list_(_COUNT)),
        "taken": pa.array([taken[c.founder] for c in clusters], pa.list_(pa.int64())),
        "turn": pa.array([0 if last else turn] * len(clusters), pa.int32()),
    }
    return pa.table(columns)


def _turn(turn: int, last: bool):
    """A round whose rows are all one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _round(pa.Table.from_batches(list(batches)), turn, last).to_batches()

    return run


def _largest_component(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the vectors the largest component of near ones has, in one row."""
    vectors = np.array([v for batch in batches for v in batch.column("vector").to_pylist()], dtype=float)
    label = np.arange(len(vectors))
    for i, v in enumerate(vectors):
        met = np.unique(label[np.flatnonzero(vectors[: i + 1] @ v >= BLOCK_COSINE)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    yield pa.RecordBatch.from_pydict({"largest": [int(np.bincount(label).max()) if len(label) else 0]})


def _centres(states: DataFrame) -> DataFrame:
    return states.select(F.col("founder").alias("id"), unit(F.col("sum")).alias("vector"))


def _giant_blocks(entities: DataFrame, most: int) -> DataFrame:
    """`no, founder` of entities whose blocks are too large for one task, in rounds.

    Entities lie in folders of `most` places each, so a round reads its own; what a round decides is a folder of its own too.
    A cluster takes none of a round's entities unless one of them is as near to its centre as the threshold, so no pairs with the
    members are made: where all entities and clusters of a round are one task, that looks for itself. Entities that are to be
    decided apart are linked by near pairs of their own and with centres at least BLOCK_COSINE near: what joins a cluster is
    that near to its centre before the round, or to one that has joined in the round.
    """
    spark = entities.sparkSession
    order = sequence_positions(entities)
    total = order.agg(F.max("at")).first()[0]
    if total is None:
        return spark.createDataFrame([], "no long, founder long")
    places, log = scratch(spark), scratch(spark)
    placed = entities.select("no", *FEATURES).join(order, "no").drop("no").withColumnRenamed("at", "no")
    placed.withColumn("slab", F.floor(F.col("no") / most)).repartition("slab").sortWithinPartitions("slab", "no").write.partitionBy("slab").parquet(places)
    states, held_at, clusters = spark.createDataFrame([], _STATE), None, 0
    kind, both = placed.schema, StructType([*placed.schema, *states.schema])

    def window(reach: int) -> DataFrame:
        return spark.read.schema(kind).parquet(*(f"{places}/slab={i}" for i in range(done // most, min(done + reach - 1, total) // most + 1)))

    def links(rows: DataFrame) -> DataFrame:
        ids = rows.select(F.col("no").alias("id"), "vector")
        held = similarity_join(ids.withColumnRenamed("id", "query_id"), _centres(states), BLOCK_COSINE)
        return near_links(ids, BLOCK_COSINE).unionByName(held.select(F.col("id").alias("a"), F.col("query_id").alias("b")))

    # Rounds that reach farther need components; they are tried first, and after a vain trial again after twice as many jobs
    # of TURNS rounds of `most` entities, if the next `most` aren't nearly one component by themselves.
    done, reach, number, wait, pause = 0, most, 0, 0, 1
    while done <= total:
        labels, largest = None, most
        loose = number == 0 or wait == 0 and window(most).select("vector").coalesce(1).mapInArrow(_largest_component, "largest long").first()[0] * WIDER <= most
        if reach > most or loose:
            reach = max(reach, WIDER * most)
            while reach > most:
                labels = checkpointed(connected_components(links(window(reach)), "a", "b"))
                parts = window(reach).select("no").join(labels.hint("merge"), F.col("no") == F.col("node"), "left").select("no", F.coalesce("label", "no").alias("component"))
                largest = parts.groupBy("component").count().agg(F.max("count")).first()[0]
                if largest <= most:
                    break
                reach, labels = max(most, reach // WIDER), None
            wait, pause = (0, 1) if labels is not None else (pause, 2 * pause)
        elif wait:
            wait -= 1
        path = f"{log}/round={number}"
        if labels is None and clusters <= HELD_CLUSTERS:
            # All clusters go from round to round, each of which is a task and hands on what it has decided.
            turns, out = max(1, min(TURNS, HELD_CLUSTERS // most, -(-(total + 1 - done) // most))), None
            for turn in range(1, turns + 1):
                rows = spark.read.schema(both).parquet(f"{places}/slab={done // most}", *([held_at] if held_at else []))
                rows = rows if out is None else rows.unionByName(out.repartition(1), allowMissingColumns=True)
                out, done = rows.coalesce(1).mapInArrow(_turn(turn, turn == turns), _STATE), done + most
            out.write.parquet(path)
            held_at = path
        else:
            rows = window(reach)
            if labels is None:
                ids = rows.select(F.col("no").alias("query_id"), "vector")
                met = similarity_join(ids, _centres(states), config.MERGE_BASE).select(F.col("id").alias("founder")).distinct()
                rows, held = rows.withColumn("component", F.lit(0).cast("long")), states.join(met.hint("merge"), "founder", "left_semi").withColumn("component", F.lit(0).cast("long"))
            else:
                rows = rows.join(parts.hint("merge"), "no")
                held = states.join(labels.hint("merge"), states["founder"] == labels["node"]).select(F.col("label").alias("component"), *states.columns)
            out = rows.unionByName(held, allowMissingColumns=True).groupBy("component").applyInArrow(lambda table: _round(table), _STATE)
            out.write.parquet(path)
            fresh, held_at = spark.read.schema(_STATE).parquet(path), scratch(spark)
            states.join(fresh.select("founder").hint("merge"), "founder", "left_anti").select(*fresh.columns).unionByName(fresh).write.parquet(held_at)
            done += reach
            if labels is not None and largest * WIDER <= most:
                reach *= WIDER
        states, number = spark.read.schema(_STATE).parquet(held_at), number + 1
        clusters = states.count()
    decided = spark.read.schema(_STATE).parquet(log).select("founder", F.explode("taken").alias("at"))
    founders = order.select(F.col("at").alias("founder"), F.col("no").alias("by"))
    return decided.join(order, "at").join(founders, "founder").select("no", F.col("by").alias("founder"))


def sequence_positions(rows: DataFrame) -> DataFrame:
    """`no, at`: gapless places of the rows in order of `no`."""
    marked = checkpointed(rows.select("no").repartitionByRange("no").sortWithinPartitions("no").withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = sorted(marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"])
    if not sizes:
        return marked.select("no", F.lit(None).cast("long").alias("at"))
    ahead = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])])
    base = F.element_at(F.create_map(*[F.lit(x) for r, n in zip(sizes, ahead) for x in (r["part"], int(n))]), part)
    return marked.select("no", (base + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("at"))


def cluster_entities(entities: DataFrame, blocks: DataFrame, most: int = GIANT_BLOCK) -> DataFrame:
    """`name, cluster` from featured entities with unit vectors and `name, block`; names are unique.

    Blocks must keep together whatever is near by vector (a cosine of BLOCK_COSINE and more); the result doesn't
    depend on them otherwise. Blocks of over `most` entities are decided in rounds, for which the near pairs of
    their own entities are made. A cluster is called by its founder's name.
    """
    numbered = checkpointed(sequence_number(entities.join(blocks, "name")))
    giant = numbered.groupBy("block").count().where(F.col("count") > most).select("block")
    owners = _small_blocks(numbered.join(giant, "block", "left_anti"))
    owners = owners.unionByName(_giant_blocks(checkpointed(numbered.join(giant, "block", "left_semi")), most))
    founders = numbered.select(F.col("no").alias("founder"), F.col("name").alias("cluster"))
    return numbered.select("no", "name").join(owners, "no").join(founders, "founder").select("name", "cluster")
