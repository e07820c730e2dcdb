"""Canonicalisation: entity aggregation, name features, hashing vectors, similarity, greedy clusters, nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import vectors
from quillgraph.functions.checkpoints import checkpointed
from quillgraph.functions.components import connected_components
from quillgraph.functions.text import nfkc
from quillgraph.functions.vectors import unit
from quillgraph.operators import clustering
from quillgraph.operators.clustering import BLOCK_COSINE, cluster_entities

NODE_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def aggregate_entities(mentions: DataFrame) -> DataFrame:
    """`name, type, times_seen, docs, sections` by exact name: counts of sections, most voted type (then the greatest name).

    Mentions may be dear to make: they are counted once, by all that is grouped by.
    """
    counted = mentions.groupBy("name", "type", "section", "doc_id").agg(F.count("*").alias("n"), F.sum(F.greatest("times_seen", F.lit(0))).alias("seen"))
    counted = checkpointed(counted)
    types = counted.groupBy("name", "type").agg(F.sum("n").alias("votes")).groupBy("name").agg(F.max_by("type", F.struct("votes", "type")).alias("type"))
    sections = counted.groupBy("name", "section").agg(F.sum("n").alias("n")).groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("sections"))
    base = counted.groupBy("name").agg(F.sum("seen").alias("seen"), F.array_sort(F.collect_set("doc_id")).alias("docs"))
    joined = base.join(types, "name").join(sections, "name")
    return joined.select("name", F.coalesce("type", F.lit("Unknown")).alias("type"), F.when(F.col("seen") > 0, F.col("seen")).otherwise(F.size("docs").cast("long")).alias("times_seen"), "docs", "sections")


def normalised(name: Column) -> Column:
    """Normal form KC, lower case, punctuation to blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(name)), r"[^\p{L}\p{N} ]+", " "), " +", " "))


def name_features(entities: DataFrame) -> DataFrame:
    """Adds normalised name, tokens, letters, initials (2 to 12), sentence-like, blocked and polysemous flags."""
    low = normalised(F.col("name"))
    tokens = F.filter(F.split(low, " "), lambda t: t != "")
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*config.ACRONYM_STOP_WORDS))
    initials = F.array_join(F.transform(kept, lambda t: F.substring(t, 1, 1)), "")
    out = entities.withColumn("normalised", low).withColumn("tokens", F.array_distinct(tokens)).withColumn("letters", F.regexp_replace(low, r"[^\p{L}]", ""))
    out = out.withColumn("initials", F.when(F.length(initials).between(2, 12), initials))
    out = out.withColumn("sentence_like", F.col("name").rlike("[.!?;:]") | (F.size(tokens) > 5)).withColumn("blocked", low.isin(*config.BLOCKED_NAMES))
    return out.withColumn("polysemous", F.size("sections") >= config.POLYSEMY_SECTIONS) if "sections" in entities.columns else out.withColumn("polysemous", F.lit(False))


def hash_embedding(name: Column, dims: int = 16) -> Column:
    """The first bytes of the sha-256 of the name in normal form KC, repeated to `dims`, as a unit vector."""

    def vector(digest: Column) -> Column:
        raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double"))
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(F.struct(raw.alias("v"), norm.alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)))[0]

    # The digest is made outside the functions of single elements, in which Python can't be called.
    return F.transform(F.array(F.sha2(nfkc(name), 256)), vector)[0]


def missing_embeddings(names: DataFrame, cache: DataFrame) -> DataFrame:
    """Names without a vector in the cache, by the sha-256 of the name."""
    keyed = names.select("name", F.sha2("name", 256).alias("key")).dropDuplicates(["key"])
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def similarity_search(queries: DataFrame, corpus: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """`query_id, id, score` of unit vectors at least `threshold` alike, best first; the join by pivots of `functions.vectors`."""
    return vectors.similarity_join(queries, corpus, threshold, k)


def near_pairs(entities: DataFrame, least: float = BLOCK_COSINE) -> DataFrame:
    """`a, b`: names whose unit vectors (`name, vector`) are at least `least` near, each pair once.

    A join needs a cosine of the merge threshold t with the cluster's centroid, so some member is at least t * t near.
    """
    ids = entities.select(F.xxhash64("name").alias("id"), "name", "vector")
    near = similarity_search(ids.select(F.col("id").alias("query_id"), "vector"), ids, least).where("query_id < id")
    a, b = ids.select(F.col("id").alias("query_id"), F.col("name").alias("a")), ids.select("id", F.col("name").alias("b"))
    return near.join(a, "query_id").join(b, "id").select("a", "b")


def merge_blocks(entities: DataFrame, least: float = BLOCK_COSINE, pairs: DataFrame | None = None) -> DataFrame:
    """`name, block` from `name, vector` (unit vectors): connected components of the near pairs, so no cluster crosses a block.

    Without given pairs only as many links are made as the components need (`vectors.near_links`), not all pairs.

    With hashing vectors most names are that near to each other and blocks are large; they are meant for real vectors.
    """
    if pairs is not None:
        labels = connected_components(pairs, "a", "b")
        return entities.select("name").join(labels, F.col("name") == labels["node"], "left").select("name", F.coalesce("label", "name").alias("block"))
    ids = entities.select(F.xxhash64("name").alias("id"), "name", "vector")
    labels = checkpointed(connected_components(vectors.near_links(ids, least), "a", "b"))
    members = ids.select("id", "name").join(labels, ids["id"] == labels["node"], "left").select("name", F.coalesce("label", "id").alias("label"))
    return members.join(members.groupBy("label").agg(F.min("name").alias("block")), "label").select("name", "block")


def resolve_entities(entities: DataFrame, most: int = clustering.GIANT_BLOCK) -> DataFrame:
    """`name, cluster` from `name, type, times_seen, sections, vector` (unit vectors, unique names): blocks, greedy clusters."""
    return cluster_entities(name_features(entities), merge_blocks(entities), most)


def giant_blocks(blocks: DataFrame, most: int = clustering.GIANT_BLOCK) -> DataFrame:
    """`block, members` of merge blocks with more than `most` members, which are clustered in rounds."""
    return blocks.groupBy("block").agg(F.count("*").alias("members")).where(F.col("members") > most)


def cluster_nodes(clustered: DataFrame) -> DataFrame:
    """Nodes from `cluster, name, normalised, type, times_seen, docs` and, if there is one, the map `sections`.

    The most seen name and type (then the greatest), the other names as aliases, sums; the id is a uuid5 over
    the sorted normalised names and, where there are sections, their shares with four digits.
    """
    names = clustered.groupBy("cluster", "name").agg(F.sum("times_seen").alias("n")).groupBy("cluster").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.array_sort(F.collect_set("name")).alias("names"))
    types = clustered.groupBy("cluster", "type").agg(F.sum("times_seen").alias("n")).groupBy("cluster").agg(F.max_by("type", F.struct("n", "type")).alias("type"))
    base = clustered.groupBy("cluster").agg(F.sum("times_seen").alias("times_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"), F.array_join(F.array_sort(F.collect_set("normalised")), "|").alias("token"))
    joined = base.join(names, "cluster").join(types, "cluster")
    if "sections" in clustered.columns:
        counts = clustered.select("cluster", F.explode("sections").alias("section", "n")).where("n > 0").groupBy("cluster", "section").agg(F.sum("n").alias("n"))
        share = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
        parts = counts.withColumn("part", F.format_string("%s:%.4f", "section", share)).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("section", "part"))).alias("parts"))
        parts = parts.select("cluster", F.array_join(F.transform("parts", lambda p: p["part"]), "|").alias("shares"))
        joined = joined.join(parts, "cluster", "left").withColumn("token", F.concat_ws("::", "token", "shares"))
    digest = F.sha1(F.concat(F.unhex(F.lit(NODE_NAMESPACE)), F.col("token").cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    node_id = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return joined.select("cluster", node_id.alias("node_id"), "name", "type", F.array_remove("names", F.col("name")).alias("aliases"), "times_seen", "docs")


def merge_map(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """`alias, node_id`: an alias of several nodes carries its node's top two sections (`node_id, top`)."""
    rows = nodes.select("node_id", F.explode(F.array_union("aliases", F.array("name"))).alias("alias"))
    n = F.count("*").over(Window.partitionBy("alias"))
    marked = rows.withColumn("n", n).join(sections, "node_id", "left")
    return marked.select(F.when(F.col("n") > 1, F.concat_ws("::", "alias", F.coalesce("top", F.lit("")))).otherwise(F.col("alias")).alias("alias"), "node_id")


def merge_report(nodes: DataFrame, n: int = 20) -> DataFrame:
    size = F.size("aliases") + 1
    return nodes.select("node_id", "name", size.alias("n_aliases"), "times_seen").orderBy(F.desc("n_aliases"), F.desc("times_seen"), "name", "node_id").limit(n)
