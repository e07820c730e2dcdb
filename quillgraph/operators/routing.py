"""Domain routing, vocabulary density and the entity inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import config


def _hits(text: Column, keywords: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for k in keywords:
        out = out + F.contains(low, F.lit(k)).cast("int")
    return out


def route_domain(papers: DataFrame, rules=config.DOMAIN_RULES) -> DataFrame:
    """`doc_id, domain, score` from `title, venue, content`: highest score, then lower priority number, then order of rules."""
    w = config.DOMAIN_WEIGHTS
    scored = F.array(
        *[
            F.struct(
                (-(w["title"] * _hits(F.col("title"), keys) + w["venue"] * _hits(F.col("venue"), keys) + w["content"] * _hits(F.col("content"), keys))).alias("minus"),
                F.lit(priority).alias("priority"),
                F.lit(i).alias("rank"),
                F.lit(name).alias("domain"),
            )
            for i, (name, priority, keys) in enumerate(rules)
        ]
    )
    best = papers.select("doc_id", F.array_min(scored).alias("best"))
    return best.select("doc_id", F.col("best.domain").alias("domain"), (-F.col("best.minus")).alias("score"))


def vocabulary_density(elements: DataFrame, terms: Sequence[str], threshold: float = config.VOCABULARY_DENSITY) -> DataFrame:
    """Share of an element's words that are in the term list, and the profile that it selects."""
    words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0))
    counted = elements.select("element_id", F.size(words).alias("n_words"), F.size(F.filter(words, lambda w: w.isin(*terms))).alias("n_terms"))
    share = F.when(F.col("n_words") > 0, F.col("n_terms") / F.col("n_words")).otherwise(0.0)
    return counted.select("element_id", "n_words", "n_terms", F.when(share >= threshold, "specialised").otherwise("general").alias("profile"))


def candidate_mentions(elements: DataFrame, vocabulary: Sequence[str], limit: int = config.MAX_CANDIDATES, spans: DataFrame | None = None, specialised: bool = False) -> DataFrame:
    """`element_id, mention, score, first_at` of each element, case-insensitively one mention each, the first `limit`.

    Vocabulary and annotated entities score 3; noun phrases annotated twice and more in the element and, in the specialised
    profile, both parts of "long form (ABBR)" score 2; annotated proper nouns and capitalised words score 1 (words all
    in capitals 2). `spans` are annotations `element_id, mention, kind` with kind `entity`, `noun` or `proper` (null: entity).
    Stop words, pronouns, mentions of less than two letters and digits, and what the element doesn't hold are out. The best score
    counts, then the earliest place, then what is written so; a place is that of the mention as written, else in another case.
    """
    content = elements.select("element_id", "content")
    vocab = content.select("element_id", "content", F.explode(F.array(*[F.lit(v) for v in vocabulary])).alias("mention"), F.lit(3).alias("score"))
    words = F.explode(F.regexp_extract_all("content", F.lit("[A-Z][A-Za-z]+"), F.lit(0)))
    token = content.select("element_id", "content", words.alias("mention")).where(~F.col("mention").isin(*config.STOP_WORDS))
    sources = vocab.unionByName(token.withColumn("score", F.when(F.col("mention").rlike("^[A-Z]{2,}$"), 2).otherwise(1)))
    if specialised:
        pairs = abbreviation_pairs(content, "content")
        sources = sources.unionByName(pairs.select("element_id", "content", F.explode(F.array("long_form", "abbreviation")).alias("mention"), F.lit(2).alias("score")))
    if spans is not None:
        trimmed = spans.select("element_id", F.trim("mention").alias("mention"), *(["kind"] if "kind" in spans.columns else [F.lit("entity").alias("kind")]))
        each = trimmed.groupBy("element_id", "mention", "kind").agg(F.count("*").alias("n"))
        said = F.sum("n").over(Window.partitionBy("element_id", F.lower("mention"), "kind"))
        score = F.when(F.coalesce("kind", F.lit("entity")) == "entity", 3).when((F.col("kind") == "noun") & (said >= 2), 2).when(F.col("kind") == "proper", 1)
        annotated = each.withColumn("score", score).where("score is not null").join(content, "element_id")
        sources = sources.unionByName(annotated.select("element_id", "content", "mention", "score"))
    low = F.lower(F.trim("mention"))
    valid = ~low.isin(*config.MENTION_STOP_WORDS, *config.PRONOUNS) & (F.length(F.regexp_replace(low, "[^a-z0-9]", "")) > 1) & F.contains(F.lower("content"), low)
    kept = sources.where(valid).withColumn("mention", F.trim("mention"))
    written = F.call_function("locate", F.col("mention"), F.col("content"))
    placed = kept.select("element_id", "mention", "score", (written == 0).alias("other_case"), (F.when(written > 0, written).otherwise(F.call_function("locate", F.lower("mention"), F.lower("content"))) - 1).alias("first_at"))
    best = placed.groupBy("element_id", F.lower("mention").alias("low")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "first_at", "other_case", "mention")).alias("b"))
    order = Window.partitionBy("element_id").orderBy("b.minus", "b.first_at", "b.mention")
    ranked = best.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    return ranked.select("element_id", F.col("b.mention").alias("mention"), (-F.col("b.minus")).alias("score"), F.col("b.first_at").alias("first_at"))


def abbreviation_pairs(elements: DataFrame, *more: str) -> DataFrame:
    """`element_id, long_form, abbreviation` (and the columns `more`) of each "long form (ABBR)"; long forms may have digits, hyphens and any length."""
    longs = F.regexp_extract_all("content", F.lit(config.ABBREVIATION), F.lit(1))
    shorts = F.regexp_extract_all("content", F.lit(config.ABBREVIATION), F.lit(2))
    pairs = elements.select("element_id", *more, F.explode(F.arrays_zip(longs.alias("l"), shorts.alias("s"))).alias("p"))
    return pairs.select("element_id", *more, F.trim("p.l").alias("long_form"), F.col("p.s").alias("abbreviation"))


def limit_mentions(rows: DataFrame, n: int = config.MAX_MENTIONS) -> DataFrame:
    """`mentions` trimmed, without blanks, the first n."""
    return rows.withColumn("mentions", F.slice(F.filter(F.transform("mentions", lambda m: F.trim(m)), lambda m: m != ""), 1, n))
