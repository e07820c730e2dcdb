"""Requests, responses, relation normalisation and validation of candidate triples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import spans


#: Triples in a group that is voted on together.
VOTE_ROWS = 20_000


def triple_budget(elements: DataFrame) -> DataFrame:
    """`element_id, budget`: one triple for 60 words or a sentence, whichever is more, within the model's limits."""
    words = F.size(F.regexp_extract_all("content", F.lit("[^ ]+"), F.lit(0)))
    sents = F.size(F.filter(F.split("content", "[.!?]+"), lambda s: F.trim(s) != ""))
    budget = F.least(F.lit(config.MAX_TRIPLES), F.greatest(F.ceil(words / config.WORDS_PER_TRIPLE), sents, F.lit(1)), F.lit(config.OUTPUT_TOKENS // config.TOKENS_PER_TRIPLE))
    return elements.select("element_id", budget.cast("int").alias("budget"))


def build_requests(elements: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """One request for each element: output-token cap, budget key and response key."""
    joined = elements.join(triple_budget(elements), "element_id")
    cap = F.least(F.lit(config.OUTPUT_TOKENS), F.greatest(F.lit(config.TOKENS_PER_TRIPLE), (F.col("budget") * config.TOKENS_PER_TRIPLE * 1.2).cast("int")))
    return joined.select(
        "doc_id",
        "element_id",
        "budget",
        cap.alias("max_tokens"),
        F.concat_ws(":", F.lit(model), F.lit(prompt_version), "content_hash", F.col("budget").cast("string")).alias("budget_key"),
        F.sha2(F.concat_ws("‖", F.lit(model), F.lit(prompt_version), "content_hash"), 256).alias("response_key"),
        F.concat(F.lit("Extract at most "), F.col("budget").cast("string"), F.lit(" triples.\n"), "content").alias("prompt"),
    )


def latest_responses(responses: DataFrame) -> DataFrame:
    """The later write of each response key (`seq` orders writes)."""
    return responses.groupBy("response_key").agg(F.max_by("body", "seq").alias("body"))


def cache_lookup(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose response is known, with its body, and the others."""
    known = latest_responses(responses)
    return requests.join(known, "response_key"), requests.join(known, "response_key", "left_anti")


def prune_cache(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Responses that a live request can still use."""
    return responses.join(requests.select("response_key").distinct(), "response_key", "left_semi")


RESPONSE = "struct<finish_reason:string,triples:array<struct<subject:string,relation:string,object:string,confidence:double,sentence:string>>>"


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status of each response (`ok`, `truncated`, `error`), and its first `budget` triples without malformed ones."""
    parsed = responses.withColumn("r", F.from_json("body", RESPONSE))
    status = F.when(F.col("r").isNull() | F.col("r.triples").isNull(), "error").when(F.col("r.finish_reason") == "length", "truncated").otherwise("ok")
    items = parsed.select("element_id", "budget", F.posexplode("r.triples").alias("pos", "t")).where("pos < budget")
    good = items.where("trim(t.subject) <> '' and trim(t.object) <> '' and trim(t.relation) <> ''")
    return parsed.select("element_id", status.alias("status")), good.select("element_id", "pos", "t.*")


def relation_patterns(spark, groups: Iterable[tuple[str, bool, Sequence[str]]] = config.RELATION_PATTERNS) -> DataFrame:
    """`phrase, canonical, swap, rank` of pattern groups (canonical relation, swap, phrases), in their order."""
    rows = [(p, c, s) for c, s, phrases in groups for p in phrases]
    return spark.createDataFrame([(p, c, s, i) for i, (p, c, s) in enumerate(rows)], "phrase string, canonical string, swap boolean, rank int")


def clean_phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def read_relation_patterns(spark, path: str) -> DataFrame:
    """Patterns from a JSON-lines file of groups `canonical, swap, phrases` in order, for lists too long for the configuration."""
    groups = spark.read.schema("canonical string, swap boolean, phrases array<string>").json(path)
    # A configuration file; its order is that of its lines.
    rows = groups.select("canonical", F.coalesce("swap", F.lit(False)).alias("swap"), "phrases").collect()
    return relation_patterns(spark, [(r.canonical, r.swap, r.phrases) for r in rows])


def normalise_relations(triples: DataFrame, column: str = "relation_text", patterns: DataFrame | None = None) -> DataFrame:
    """Adds `relation, swap` by the longest pattern that the phrase contains; first in order among equals; null without one.

    Each differing phrase is matched once; the patterns are the configured list unless a table of them is given.
    """
    phrases = triples.select(F.col(column).alias("raw")).distinct().withColumn("clean", clean_phrase(F.col("raw")))
    met = phrases.join(F.broadcast(relation_patterns(triples.sparkSession) if patterns is None else patterns), F.contains("clean", "phrase"))
    best = met.groupBy("raw").agg(F.min_by(F.struct("canonical", "swap"), F.struct(-F.length("phrase"), "rank")).alias("p"))
    joined = triples.join(best, triples[column] == best["raw"], "left")
    return joined.select(*[triples[c] for c in triples.columns], F.col("p.canonical").alias("relation"), F.coalesce("p.swap", F.lit(False)).alias("swap"))


def semantic_relations(phrases: DataFrame, patterns: DataFrame, accept: float = config.SEMANTIC_ACCEPT, review: float = config.SEMANTIC_REVIEW) -> DataFrame:
    """`phrase, pattern, score, decision` for unit vectors `phrase, vector` against the fixed pattern vectors `pattern, vector`."""
    right = patterns.select("pattern", F.col("vector").alias("w"))
    dot = F.aggregate(F.zip_with("vector", "w", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    # The pattern list is configuration: a handful of vectors, each phrase meets every one.
    met = phrases.crossJoin(F.broadcast(right)).select("phrase", "pattern", F.round(dot, 6).alias("score"))
    best = met.groupBy("phrase").agg(F.min_by(F.struct("pattern", "score"), F.struct(-F.col("score"), "pattern")).alias("b"))
    decision = F.when(F.col("b.score") >= accept, "accept").when(F.col("b.score") >= min(review, accept), "review").otherwise("reject")
    return best.select("phrase", F.col("b.pattern").alias("pattern"), F.col("b.score").alias("score"), decision.alias("decision"))


def hint_type(text: Column) -> Column:
    """Type by the first configured keyword list with a hit, else by the built-in patterns, else null."""
    out = F.lit(None).cast("string")
    rules = [(t, "|".join(k.replace(" ", r"\s+") for k in words)) for t, words in config.TYPE_HINTS]
    for type_, pattern in reversed(config.BUILTIN_TYPE_HINTS):
        out = F.when(text.rlike(f"(?i){pattern}"), type_).otherwise(out)
    for type_, words in reversed(rules):
        out = F.when(text.rlike(f"(?i)(^|[^a-z0-9])({words})($|[^a-z0-9])"), type_).otherwise(out)
    return out


def exact_type(text: Column) -> Column:
    """A configured type, whatever its case; null if unknown or ambiguous."""
    out = F.lit(None).cast("string")
    for t in config.ENTITY_TYPES:
        out = F.when(F.lower(F.trim(text)) == t.lower(), t).otherwise(out)
    return out


def resolve_entity_types(triples: DataFrame) -> DataFrame:
    """Adds `subject_type, object_type`: the given type if exact, else the votes of earlier accepted triples of the element, else hints.

    Votes depend on the order within an element, which holds at most the triples of its budget. Elements
    are dealt to groups of about VOTE_ROWS triples, so that Python is not called for each.
    """

    def hinted(c: str) -> Column:
        return hint_type(F.col(c))

    ready = triples.select("*", exact_type(F.col("raw_subject_type")).alias("exact_s"), exact_type(F.col("raw_object_type")).alias("exact_o"), hinted("subject").alias("hint_s"), hinted("object").alias("hint_o"))

    def vote(rows):
        rows = rows.sort_values(["element_id", "pos"])
        votes: dict[str, dict[str, int]] = {}
        picked, current = [], None
        columns = ("element_id", "subject", "exact_s", "hint_s", "object", "exact_o", "hint_o")
        for element, subject, se, sh, obj, oe, oh in zip(*(rows[c].tolist() for c in columns)):
            if element != current:
                votes, current = {}, element
            pair = []
            for name, exact, hint in ((subject, se, sh), (obj, oe, oh)):
                own = votes.get(name)
                pair.append(exact or (max(own, key=own.get) if own else None) or hint)
            picked.append(pair)
            if all(pair):
                for name, t in zip((subject, obj), pair):
                    votes.setdefault(name, {}).setdefault(t, 0)
                    votes[name][t] += 1
        return rows.assign(subject_type=[p[0] for p in picked], object_type=[p[1] for p in picked]).drop(columns=["exact_s", "hint_s", "exact_o", "hint_o", "dealt"])

    schema = ", ".join(f"`{n}` {t}" for n, t in triples.dtypes) + ", subject_type string, object_type string"
    groups = max(1, -(-triples.count() // VOTE_ROWS))
    return ready.withColumn("dealt", F.pmod(F.xxhash64("element_id"), F.lit(groups))).groupBy("dealt").applyInPandas(vote, schema)


link_exact = spans.exact_start


def link_spans(rows: DataFrame, text: str, target: str, threshold: float = config.SPAN_RATIO) -> DataFrame:
    """Adds `span` (start, end): exact, then case-insensitive, then the best fuzzy window."""
    return rows.withColumn("span", spans.find_spans(F.col(text), {"span": F.col(target)}, threshold)["span"])


def validate_triples(triples: DataFrame, threshold: float = config.SPAN_RATIO) -> DataFrame:
    """Adds `reason` (null if accepted), `src_text, dst_text` after the swap, and the sentence span as evidence.

    Needs content, subject, object, relation, swap, decision, subject_type, object_type, sentence, confidence.
    Names and sentences are located as `link_spans` does: as written, in another case, or by the best fuzzy window,
    all three in one pass over the row.
    """
    swap = F.coalesce("swap", F.lit(False))
    src, dst = F.when(swap, F.col("object")).otherwise(F.col("subject")), F.when(swap, F.col("subject")).otherwise(F.col("object"))
    staged = triples.select("*", src.alias("src_text"), dst.alias("dst_text"))
    found = spans.find_spans(F.col("content"), {"s": F.col("src_text"), "o": F.col("dst_text"), "sent": F.col("sentence")}, threshold)
    staged = staged.select("*", F.struct(*[v.alias(k) for k, v in found.items()]).alias("__spans"))
    ends = [F.col(f"__spans.{k}.{part}").alias(f"{k}_{name}") for k in found for part, name in (("start", "at"), ("end", "end"))]
    staged = staged.select("*", *ends).drop("__spans")
    n, s_end, o_end = F.length("content"), F.col("s_end"), F.col("o_end")
    reason = (
        F.when(F.col("decision") == "review", "relation_needs_review")
        .when(F.col("relation").isNull(), "relation_unmapped")
        .when(F.coalesce(F.trim("subject") == "", F.lit(True)) | F.coalesce(F.trim("object") == "", F.lit(True)), "empty_entity")
        .when(F.col("subject_type").isNull(), "subject_type_ambiguous")
        .when(F.col("object_type").isNull(), "object_type_ambiguous")
        .when(F.coalesce(F.trim("sentence") == "", F.lit(True)), "sentence_missing")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "invalid_confidence")
        .when(F.lower("src_text") == F.lower("dst_text"), "identical_entities")
        .when(F.col("s_at").isNull(), "subject_span_missing")
        .when(F.col("o_at").isNull(), "object_span_missing")
        .when(s_end > n, "subject_span_out_of_bounds")
        .when(o_end > n, "object_span_out_of_bounds")
        .when(F.greatest("s_at", "o_at") < F.least(s_end, o_end), "span_overlap")
        .when(F.col("sent_at").isNull(), "sentence_span_missing")
        .when(F.col("sent_end") > n, "sentence_span_out_of_bounds")
    )
    return staged.withColumn("reason", reason)


def supporting_sentence(triples: DataFrame) -> DataFrame:
    """Adds `sentence`: the given one unless blank, else the first of the content that holds both names."""
    pieces = F.transform(F.regexp_extract_all("content", F.lit(r"[^.!?]+[.!?]?"), F.lit(0)), lambda s: F.trim(s))
    both = F.filter(pieces, lambda s: F.contains(F.lower(s), F.lower(F.col("subject"))) & F.contains(F.lower(s), F.lower(F.col("object"))))
    given = F.when(F.trim("given_sentence") != "", F.col("given_sentence"))
    return triples.withColumn("sentence", F.coalesce(given, F.get(both, 0)))


def _roles(accepted: DataFrame) -> DataFrame:
    pair = F.array(F.struct(F.col("src_text").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("dst_text").alias("name"), F.col("object_type").alias("type")))
    return accepted.select("section", F.explode(pair).alias("r")).select("section", "r.*")


def section_counts(accepted: DataFrame) -> DataFrame:
    """`name, section, n`: one for each role of an accepted triple."""
    return _roles(accepted).groupBy("name", "section").agg(F.count("*").alias("n"))


def type_votes(accepted: DataFrame) -> DataFrame:
    return _roles(accepted).groupBy("name", "type").agg(F.count("*").alias("n"))


def extraction_summary(validated: DataFrame, by: str = "doc_id") -> DataFrame:
    """`attempted, accepted, rejected, reasons`: the last as `reason=count` in order."""
    grouped = validated.groupBy(by, "reason").agg(F.count("*").alias("n"))
    per = grouped.groupBy(by).agg(
        F.sum("n").alias("attempted"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("accepted"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws("=", "reason", F.col("n").cast("string"))))), ",").alias("reasons"),
    )
    return per.select(by, "attempted", "accepted", (F.col("attempted") - F.col("accepted")).alias("rejected"), "reasons")


def relation_decisions(triples: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples whose phrase was accepted by meaning, and those for review, with the match."""
    joined = triples.join(matches, triples["relation_text"] == matches["phrase"])
    return joined.where("decision = 'accept'"), joined.where("decision = 'review'")
