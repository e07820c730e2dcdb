"""Graph views and access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.qa import both_directions

# Types and dominant sections of each ring, from the centre outwards.
RINGS = (
    (("method", "model", "approach", "task", "architecture", "algorithm"), ()),
    (("component", "module", "parameter", "hyperparameter", "protein", "gene", "sequence"), ("methods", "approach", "implementation")),
    (("dataset", "data", "corpus", "benchmark", "experiment"), ()),
    (("metric", "score", "measure", "accuracy", "loss"), ("results", "evaluation", "conclusion", "discussion")),
)


def graph_view(edges: DataFrame, confidence: float = 0.5, relations: Sequence[str] = (), sections: Sequence[str] = (), comentions: bool = False, papers: DataFrame | None = None, limit: int = 500, nodes: DataFrame | None = None, access: DataFrame | None = None) -> DataFrame:
    """Edges that pass every filter, best first, `limit` of them, with their place `k`.

    An edge is in the sections of its own and, if `nodes` (`node_id, sections`) are given, of both its ends;
    a section filter that no edge passes is dropped. `papers` are those asked for, `access` those that the
    user may see (`doc_id`). Filters come before the limit.
    """
    order = [F.desc("confidence"), F.desc("created_at"), F.col("edge_id")]
    kept = edges.where(F.col("confidence") >= confidence)
    if relations:
        kept = kept.where(F.col("relation").isin(*relations))
    if not comentions and "method" in edges.columns:
        kept = kept.where(F.coalesce(F.col("method") != "co-mention", F.lit(True)))
    for allowed in (papers, access):
        if allowed is not None:
            kept = kept.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    if sections:
        passes = F.coalesce(F.col("section").isin(*sections), F.lit(False))
        if nodes is not None:
            for end in ("src", "dst"):
                own = nodes.select(F.col("node_id").alias(end), F.map_keys("sections").alias(f"__{end}"))
                kept = kept.join(own, end, "left")
                passes = passes | F.coalesce(F.arrays_overlap(F.col(f"__{end}"), F.array(*map(F.lit, sections))), F.lit(False))
        # Edges that pass come first, so the first `limit` say whether there is one; it decides for all.
        first = kept.withColumn("__passes", passes.cast("int")).drop("__src", "__dst").orderBy(F.desc("__passes"), *order).limit(limit)
        some = first.withColumn("__any", F.max("__passes").over(Window.partitionBy()))
        top = some.where(F.col("__passes") == F.col("__any")).drop("__passes", "__any")
    else:
        top = kept.orderBy(*order).limit(limit)
    # The limit comes before the numbering, so one task numbers `limit` rows at most.
    return top.withColumn("k", F.row_number().over(Window.orderBy(*order)))


def view_nodes(view: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes at the ends of a view's edges."""
    ends = view.select(F.col("src").alias("node_id")).unionAll(view.select(F.col("dst").alias("node_id"))).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def view_edges(view: DataFrame) -> DataFrame:
    """Edges with the id `src->dst:relation:created_at`."""
    return view.withColumn("id", F.concat(F.col("src"), F.lit("->"), F.col("dst"), F.lit(":"), F.col("relation"), F.lit(":"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")))


def node_importance(nodes: DataFrame, edges: DataFrame, rings: Sequence[tuple[Sequence[str], Sequence[str]]] = RINGS) -> DataFrame:
    """times_seen + 2.5 * degree as a share of the greatest; ring 0 for the few most important, else the first ring that has the type or dominant section.

    The dominant section is that of the greatest count in the map `sections`, where nodes have one; of several the first by name.
    """
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    degree = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    scored = nodes.join(degree, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    scored = scored.withColumn("raw", F.col("times_seen") + 2.5 * F.col("degree"))
    # One row for the scale, three at most for the centre: no window over all nodes.
    scale = scored.agg(F.max("raw").alias("top"), F.greatest(F.lit(1), F.least(F.lit(3), F.bround(F.count("*") * 0.08).cast("int"))).alias("core"))
    first = scored.orderBy(F.desc("raw"), "node_id").limit(3).withColumn("place", F.row_number().over(Window.orderBy(F.desc("raw"), "node_id"))).select("node_id", "place")
    joined = scored.crossJoin(F.broadcast(scale)).join(F.broadcast(first), "node_id", "left")
    type_, section = F.lower(F.trim("type")), F.lit(None).cast("string")
    if "sections" in nodes.columns:
        section = F.lower(F.get(F.array_sort(F.transform(F.map_entries("sections"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name")))), 0)["name"])
    ring = F.when(F.col("place") <= F.col("core"), 0)
    for i, (types, sections) in enumerate(rings):
        ring = ring.when(type_.isin(*types) | section.isin(*sections), i + 1)
    return joined.select("node_id", "type", "degree", (F.col("raw") / F.col("top")).alias("importance"), ring.otherwise(len(rings) + 1).alias("ring"))


def partition_nodes(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """`node_id, part`: each node under each of its documents, and under `unattributed` where an edge there needs it.

    `parts` are the edges of partition_by_document.
    """
    own = nodes.select("node_id", F.explode("docs").alias("part"))
    # One pass over the edges, which may be dear to make.
    needed = parts.where("part = 'unattributed'").select(F.explode(F.array("src", "dst")).alias("node_id"), "part")
    return own.unionAll(needed).distinct()


def partition_by_document(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges under each document (`part`) that both ends share; the others under `unattributed`."""
    s, d = nodes.select(F.col("node_id").alias("src"), F.col("docs").alias("s_docs")), nodes.select(F.col("node_id").alias("dst"), F.col("docs").alias("d_docs"))
    both = edges.join(s, "src").join(d, "dst").withColumn("both", F.array_intersect("s_docs", "d_docs")).drop("s_docs", "d_docs")
    return both.select("*", F.explode(F.when(F.size("both") > 0, F.col("both")).otherwise(F.array(F.lit("unattributed")))).alias("part")).drop("both")


def node_focus(edges: DataFrame, k: int = 6) -> DataFrame:
    """The k most seen edges at each node and where they lead."""
    order = Window.partitionBy("at").orderBy(F.desc("times_seen"), "edge_id")
    ranked = both_directions(edges).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    return ranked.select(F.col("at").alias("node_id"), F.col("to").alias("other"), "edge_id", "relation", "times_seen", "k")


def accessible_papers(papers: DataFrame, user: str) -> DataFrame:
    """Papers that are public, the user's own, or shared with the user."""
    return papers.where(F.coalesce("is_public", F.lit(False)) | F.coalesce(F.col("owner_id") == user, F.lit(False)) | F.coalesce(F.array_contains("shared_with", user), F.lit(False)))


def access_violations(asked: DataFrame, papers: DataFrame, user: str) -> DataFrame:
    """Papers asked for that the user may not see."""
    return asked.join(accessible_papers(papers, user).select("paper_id"), "paper_id", "left_anti")
