"""Idempotent node and edge merges, conflicts, alias and endpoint resolution.

Nodes: `node_id, name, type, version, aliases array, sections map, times_seen, docs array`.
Edges: `src, dst, relation, doc_id, version, verbatim, confidence, times_seen, evidence, attributes map, created_at`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions.checkpoints import broadcast_if_few, checkpointed
from quillgraph.functions.components import connected_components

EDGE_KEY = ("src", "dst", "relation", "doc_id", "version")


def _add_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def _max_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def combine_staged_nodes(staged: DataFrame) -> DataFrame:
    """One row for each node_id of a batch, folded in the order of `seq`.

    An addition with documents not seen before adds its sections and the larger of its times_seen and
    those documents' number; any other raises each count to its own. Aliases and documents keep their order.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "name", "type", "version", "aliases", "sections", "times_seen", "docs")), lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int"))
    first = F.col("rows")[0]

    def fold(acc: Column, r: Column) -> Column:
        fresh = F.size(F.array_except(r["docs"], acc["docs"]))
        return F.struct(
            r["seq"].alias("seq"),
            r["name"].alias("name"),
            r["type"].alias("type"),
            r["version"].alias("version"),
            F.array_union(acc["aliases"], r["aliases"]).alias("aliases"),
            F.when(fresh > 0, _add_maps(acc["sections"], r["sections"])).otherwise(_max_maps(acc["sections"], r["sections"])).alias("sections"),
            F.when(fresh > 0, acc["times_seen"] + F.greatest(r["times_seen"], fresh.cast("long"))).otherwise(F.greatest(acc["times_seen"], r["times_seen"])).alias("times_seen"),
            F.array_union(acc["docs"], r["docs"]).alias("docs"),
        )

    grouped = staged.groupBy("node_id").agg(rows.alias("rows"))
    folded = grouped.select("node_id", F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), first, fold).alias("n"))
    return folded.select("node_id", *[F.col(f"n.{c}").alias(c) for c in ("name", "type", "version", "aliases", "sections", "times_seen", "docs")])


def upsert_nodes(existing: DataFrame, staged: DataFrame, repeat: str = "keep") -> DataFrame:
    """Staged nodes merged into existing ones by node_id.

    Name, type and version are overwritten, aliases (without the name) and documents united. With a new
    document the sections are added and times_seen grows by the payload (by the new documents where that
    is 0). Without one both stay, so a repeated run changes nothing; `repeat='add'` adds them again.
    """
    e, s = existing.alias("e"), staged.alias("s")
    both = e.join(s, F.col("e.node_id") == F.col("s.node_id"), "full_outer")
    new, old = F.col("s.node_id").isNotNull(), F.col("e.node_id").isNotNull()
    none = F.array().cast("array<string>")
    fresh = F.size(F.array_except(F.col("s.docs"), F.coalesce(F.col("e.docs"), none)))
    grows = F.lit(True) if repeat == "add" else fresh > 0
    payload = F.when(F.col("s.times_seen") > 0, F.col("s.times_seen")).otherwise(fresh.cast("long"))
    name = F.coalesce("s.name", "e.name")

    def merged(column: str, when_both: Column) -> Column:
        return F.when(new & old, when_both).when(new, F.col(f"s.{column}")).otherwise(F.col(f"e.{column}"))

    return both.select(
        F.coalesce("s.node_id", "e.node_id").alias("node_id"),
        name.alias("name"),
        F.coalesce("s.type", "e.type").alias("type"),
        F.coalesce("s.version", "e.version").alias("version"),
        F.when(new, F.array_remove(F.array_union(F.coalesce("e.aliases", none), F.coalesce("s.aliases", none)), name)).otherwise(F.col("e.aliases")).alias("aliases"),
        merged("sections", F.when(grows, _add_maps(F.col("e.sections"), F.col("s.sections"))).otherwise(F.col("e.sections"))).alias("sections"),
        merged("times_seen", F.when(grows, F.col("e.times_seen") + payload).otherwise(F.col("e.times_seen"))).alias("times_seen"),
        F.array_union(F.coalesce("e.docs", none), F.coalesce("s.docs", none)).alias("docs"),
    )


def upsert_edges(existing: DataFrame | None, staged: DataFrame) -> DataFrame:
    """Edges by (src, dst, relation, doc_id, version); `seq` orders the staged rows after the existing ones.

    The newest verbatim and evidence stay, confidence is the greatest, times_seen the sum, attributes are
    replaced only when given, created_at is the oldest, and a merged edge is no longer deprecated.
    """
    rows = staged if existing is None else existing.withColumn("seq", F.lit(-1).cast("long")).unionByName(staged, allowMissingColumns=True)
    for flag in ("deprecated", "conflicting"):
        if flag not in rows.columns:
            rows = rows.withColumn(flag, F.lit(False))
    return rows.groupBy(*EDGE_KEY).agg(
        F.max_by("verbatim", "seq").alias("verbatim"),
        F.max_by("evidence", "seq").alias("evidence"),
        F.max("confidence").alias("confidence"),
        F.sum("times_seen").alias("times_seen"),
        F.max_by("attributes", F.when(F.col("attributes").isNotNull(), F.col("seq"))).alias("attributes"),
        F.min_by("created_at", "seq").alias("created_at"),
        F.max(F.coalesce("conflicting", F.lit(False))).alias("conflicting"),
        F.min(F.when(F.col("seq") >= 0, False).otherwise(F.coalesce("deprecated", F.lit(False)))).alias("deprecated"),
    )


def _directional(relation: Column) -> Column:
    return ~relation.isin(*config.BIDIRECTIONAL)


def flag_conflicts(edges: DataFrame) -> DataFrame:
    """`conflicting` set where a directional edge meets the same relation in reverse, whatever the document; a self-loop meets itself."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    ways = edges.where(_directional(F.col("relation")) & known).select(low.alias("__low"), high.alias("__high"), F.col("relation").alias("__relation"), (F.col("src") <= F.col("dst")).alias("forth"), (F.col("src") >= F.col("dst")).alias("back"))
    # Only the ends that meet both ways are looked up, so the edges themselves are not dealt out for it.
    both = ways.groupBy("__low", "__high", "__relation").agg(F.max("forth").alias("forth"), F.max("back").alias("back")).where("forth and back")
    met = broadcast_if_few(both.select("__low", "__high", "__relation", F.lit(True).alias("met")))
    joined = edges.join(met, (low == F.col("__low")) & (high == F.col("__high")) & (F.col("relation") == F.col("__relation")) & known, "left").drop("__low", "__high", "__relation")
    was = F.col("conflicting") if "conflicting" in edges.columns else F.lit(False)
    return joined.withColumn("conflicting", was | F.coalesce("met", F.lit(False))).drop("met")


def conflict_report(edges: DataFrame) -> DataFrame:
    """Each directional edge with each of its reverse edges: both documents; every pair once."""
    a, b = edges.where(_directional(F.col("relation"))).alias("a"), edges.alias("b")
    met = a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.relation") == F.col("b.relation")))
    once = (F.col("a.src") < F.col("b.src")) | ((F.col("a.src") == F.col("b.src")) & (F.col("a.doc_id") <= F.col("b.doc_id")))
    return met.where(once).select("a.src", "a.dst", "a.relation", F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("reverse_doc_id"))


def _named(nodes: DataFrame) -> DataFrame:
    """Every lower-case name and alias with its node."""
    return nodes.select("node_id", "name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("low"))


def resolve_aliases(existing: DataFrame, staged: DataFrame) -> DataFrame:
    """`node_id, target_id, target_name`: staged nodes of which a name or alias is an existing one; the first target by id wins."""
    met = _named(staged).select(F.col("node_id").alias("staged_id"), "low").join(_named(existing), "low").where("staged_id <> node_id")
    return met.groupBy(F.col("staged_id").alias("node_id")).agg(F.min(F.struct("node_id", "name")).alias("t")).select("node_id", F.col("t.node_id").alias("target_id"), F.col("t.name").alias("target_name"))


def apply_alias_resolution(staged: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Staged nodes with the target's id and name; both names join the aliases, without the target's."""
    joined = staged.join(resolutions, "node_id", "left")
    name = F.coalesce("target_name", "name")
    aliases = F.array_sort(F.array_remove(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")), name))
    return joined.select(F.coalesce("target_id", "node_id").alias("node_id"), name.alias("name"), aliases.alias("aliases"), *[c for c in staged.columns if c not in ("node_id", "name", "aliases")])


def resolve_chains(resolutions: DataFrame) -> DataFrame:
    """Resolutions `node_id, target_id, target_name` followed to their ends, by pointer jumping.

    Of several targets of a node the least one counts. A chain ends at the node that resolves to nothing; nodes in a ring all
    end at the ring's least id, which then resolves to nothing. The number of rounds is the logarithm of the
    longest chain.
    """
    first = resolutions.where("node_id <> target_id").groupBy("node_id").agg(F.min("target_id").alias("target_id"))
    links = checkpointed(first)
    names = resolutions.groupBy(F.col("target_id").alias("id")).agg(F.min("target_name").alias("target_name"))
    labels = checkpointed(connected_components(links, "node_id", "target_id"))
    longest = labels.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    pointers = links
    for _ in range((longest - 1).bit_length()):
        onward = pointers.select(F.col("node_id").alias("target_id"), F.col("target_id").alias("next"))
        pointers = checkpointed(pointers.join(onward, "target_id", "left").select("node_id", F.coalesce("next", "target_id").alias("target_id")))
    # After that many jumps all of a component is at its end, or somewhere on its ring.
    ends = pointers.join(labels.withColumnRenamed("node", "node_id"), "node_id").groupBy("label").agg(F.min("target_id").alias("id"))
    out = links.select("node_id").join(labels.withColumnRenamed("node", "node_id"), "node_id").join(ends, "label").where("node_id <> id")
    return out.join(names, "id").select("node_id", F.col("id").alias("target_id"), "target_name")


def remap_merge_map(merge_map: DataFrame, resolutions: DataFrame) -> DataFrame:
    """`alias, node_id` with every node replaced by what it resolves to in the end."""
    ends = resolve_chains(resolutions).select("node_id", "target_id")
    return merge_map.join(ends, "node_id", "left").select("alias", F.coalesce("target_id", "node_id").alias("node_id")).distinct()


def resolve_staged(existing: DataFrame, staged: DataFrame, merge_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged nodes with their aliases resolved to existing nodes, and the merge map remapped likewise."""
    ends = resolve_chains(resolve_aliases(existing, staged))
    return apply_alias_resolution(staged, ends), remap_merge_map(merge_map, ends)


def resolve_endpoints(triples: DataFrame, nodes: DataFrame, merge_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Triples with `src` and `dst` node ids, and those of which an end has no node.

    Names come before aliases, aliases before the merge map; the least id wins among equals.
    """
    known = nodes.select(F.lower("name").alias("low"), F.lit(0).alias("rank"), "node_id").unionAll(nodes.select(F.explode("aliases").alias("a"), F.lit(1).alias("rank"), "node_id").select(F.lower("a").alias("low"), "rank", "node_id"))
    if merge_map is not None:
        known = known.unionAll(merge_map.select(F.lower("alias").alias("low"), F.lit(2).alias("rank"), "node_id"))
    lookup = known.groupBy("low").agg(F.min(F.struct("rank", "node_id")).alias("n")).select("low", F.col("n.node_id").alias("id"))
    src = lookup.select(F.col("low").alias("s_low"), F.col("id").alias("src"))
    dst = lookup.select(F.col("low").alias("d_low"), F.col("id").alias("dst"))
    joined = triples.join(src, F.lower("subject") == F.col("s_low"), "left").join(dst, F.lower("object") == F.col("d_low"), "left").drop("s_low", "d_low")
    return joined.where("src is not null and dst is not null"), joined.where("src is null or dst is null")


def known_documents(staged: DataFrame, existing: DataFrame, resolutions: DataFrame) -> DataFrame:
    """`node_id, docs`: documents of a staged node, of the existing node of that id, and of the one its aliases resolve to."""
    rows = staged.select("node_id", "docs").unionAll(existing.join(staged.select("node_id"), "node_id", "left_semi").select("node_id", "docs"))
    matched = resolutions.join(existing.select(F.col("node_id").alias("target_id"), "docs"), "target_id").select("node_id", "docs")
    return rows.unionAll(matched).groupBy("node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"))


def mark_cross_paper(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds `cross_paper`: both ends have documents and more than one between them."""
    # Edges carry no documents: whether there are several is told by their number (two at most) and, where it is one, by that one.
    own = F.array_distinct("docs")
    known = docs.select("node_id", F.when(F.size(own) > 1, 2).otherwise(F.size(own)).cast("byte").alias("n"), F.when(F.size(own) == 1, F.get(own, 0)).alias("one"))
    joined = edges.join(known.toDF("src", "s_n", "s_one"), "src", "left").join(known.toDF("dst", "d_n", "d_one"), "dst", "left")
    cross = (F.col("s_n") > 0) & (F.col("d_n") > 0) & ((F.col("s_n") > 1) | (F.col("d_n") > 1) | ~F.col("s_one").eqNullSafe(F.col("d_one")))
    return joined.withColumn("cross_paper", F.coalesce(cross, F.lit(False))).drop("s_n", "s_one", "d_n", "d_one")


def check_edges(edges: DataFrame) -> DataFrame:
    """Adds `broken`, the first rule that an edge breaks: evidence, doc_id, times_seen, confidence."""
    return edges.withColumn(
        "broken",
        F.when(F.col("evidence").isNull(), "evidence")
        .when(F.coalesce(F.trim("doc_id") == "", F.lit(True)), "doc_id")
        .when(F.coalesce(F.col("times_seen") <= 0, F.lit(True)), "times_seen")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
    )


def edge_attributes(triples: DataFrame) -> DataFrame:
    """Adds the attribute map of an accepted triple: method, section and surface relation."""
    return triples.withColumn("attributes", F.create_map(F.lit("method"), F.lit("llm"), F.lit("section"), F.col("section"), F.lit("relation"), F.col("relation_verbatim")))


def deprecate_edges(edges: DataFrame, documents: DataFrame, version: str) -> DataFrame:
    """Edges of the documents with another version are flagged; `changed` says which were not before."""
    named = documents.select("doc_id").distinct().withColumn("named", F.lit(True))
    was = F.col("deprecated") if "deprecated" in edges.columns else F.lit(False)
    hit = F.coalesce("named", F.lit(False)) & (F.col("version") != version) & ~was
    return edges.join(named, "doc_id", "left").withColumn("changed", hit).withColumn("deprecated", was | F.col("changed")).drop("named")


