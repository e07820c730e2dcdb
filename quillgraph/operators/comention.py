"""Sentences and co-mention mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import config


def sentences(elements: DataFrame, *more: str) -> DataFrame:
    """`doc_id, element_id, section, sent_no, sentence, start` (and the columns `more`): pieces up to . ! or ?, trimmed, with their offset in the element."""
    pieces = F.regexp_extract_all("content", F.lit(r"[.!?]*[^.!?]+[.!?]?"), F.lit(0))
    rows = elements.select("doc_id", "element_id", "section", *more, F.posexplode(pieces).alias("piece_no", "piece"))
    before = Window.partitionBy("doc_id", "element_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("piece_start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    bare = rows.withColumn("bare", F.regexp_replace("piece", r"^[.!?]+", ""))
    kept = bare.select(
        "doc_id",
        "element_id",
        "section",
        F.col("piece_no").alias("sent_no"),
        F.trim("bare").alias("sentence"),
        (F.col("piece_start") + F.length("piece") - F.length(F.ltrim("bare"))).cast("long").alias("start"),
        *more,
    )
    return kept.where("sentence <> ''")


def mention_occurrences(sents: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every non-overlapping, case-insensitive hit of each element's mentions in its sentences: adds `mention, at` (in the element)."""
    met = sents.join(mentions.select("element_id", "mention"), "element_id").where(F.contains(F.lower("sentence"), F.lower("mention")))
    parts = met.withColumn("parts", F.split(F.lower("sentence"), F.concat(F.lit("\\Q"), F.lower("mention"), F.lit("\\E")), -1))
    hits = parts.select("*", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    skipped = F.aggregate(F.slice("parts", 1, F.col("k")), F.lit(0), lambda acc, p: acc + F.length(p))
    return hits.select(*sents.columns, "mention", (F.col("start") + skipped + (F.col("k") - 1) * F.length("mention")).cast("long").alias("at"))


def comention_pairs(occurrences: DataFrame, distance: int = config.COMENTION_DISTANCE, limit: int = config.COMENTION_PAIRS) -> DataFrame:
    """Pairs of different names in one sentence whose starts are `distance` apart at most; of an element the first `limit` distinct pairs."""
    a = occurrences.select("doc_id", "element_id", "section", "sent_no", "sentence", F.col("mention").alias("a"), F.col("at").alias("a_at"))
    b = occurrences.select("element_id", "sent_no", F.col("mention").alias("b"), F.col("at").alias("b_at"))
    met = a.join(b, ["element_id", "sent_no"]).where((F.lower("a") < F.lower("b")) & (F.abs(F.col("a_at") - F.col("b_at")) <= distance))
    first = Window.partitionBy("element_id", "a", "b")
    seen = met.withColumn("first_at", F.min(F.struct(F.least("a_at", "b_at"), F.greatest("a_at", "b_at"))).over(first))
    order = Window.partitionBy("element_id").orderBy("first_at", "a", "b")
    return seen.withColumn("pair_no", F.dense_rank().over(order)).where(F.col("pair_no") <= limit).drop("first_at")


def comention_edges(pairs: DataFrame, least: int = config.COMENTION_MIN) -> DataFrame:
    """Edges `correlates-with` of pairs that occur `least` times in a document, with the first occurrence as evidence.

    Attributes mark them as co-mentions, which views hide unless asked for.
    """
    grouped = pairs.groupBy("doc_id", "a", "b").agg(
        F.count("*").alias("times_seen"),
        F.min_by(F.struct("element_id", "sentence"), F.struct("element_id", "sent_no", "a_at", "b_at")).alias("evidence"),
        F.array_sort(F.collect_set("section")).alias("sections"),
    )
    # The names and values that views look for.
    known = {"method": F.lit("co-mention"), "hidden": F.lit("true"), "sections": F.concat_ws(",", "sections"), "surface_relation": F.lit("co-mentioned")}
    attributes = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)])
    return grouped.where(F.col("times_seen") >= least).select("doc_id", "a", "b", F.lit("correlates-with").alias("relation"), F.lit(config.COMENTION_CONFIDENCE).alias("confidence"), "times_seen", "evidence", "sections", attributes.alias("attributes"))
