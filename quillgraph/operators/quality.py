"""Quality metrics: run manifests, KPIs, audits, drift, relevancy, summaries, log timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions.checkpoints import checkpointed


def level(value: Column, bars: tuple[float, float], higher: bool = True) -> Column:
    """green, amber or red."""
    good, fair = bars
    return F.when(value >= good, "green").when(value >= fair, "amber").otherwise("red") if higher else F.when(value <= good, "green").when(value <= fair, "amber").otherwise("red")


def run_manifest(metrics: DataFrame) -> DataFrame:
    """Totals of each run from one row a document: `run_id, doc_id, attempted, accepted, processed, skipped, error, completed_at`."""
    return metrics.groupBy("run_id").agg(
        F.countDistinct("doc_id").alias("documents"),
        F.sum("attempted").alias("attempted"),
        F.sum("accepted").alias("accepted"),
        F.sum("processed").alias("processed"),
        F.sum("skipped").alias("skipped"),
        F.size(F.collect_set("error")).cast("long").alias("distinct_errors"),
        F.max("completed_at").alias("completed_at"),
    )


def ordered_errors(errors: DataFrame, *group: str) -> DataFrame:
    """`errors` of each group from `text, seq`: trimmed, without blanks, each once, in the order of their first occurrence."""
    said = errors.withColumn("text", F.trim("text")).where("text <> ''").groupBy(*group, "text").agg(F.min("seq").alias("seq"))
    return said.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]).alias("errors"))


def document_manifest(metrics: DataFrame, reasons: DataFrame, relations: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each document of each run: `run_id, doc_id, metrics, rejection_reasons, relation_types, errors`.

    From rows as they are logged: `run_id, doc_id, metric, value, seq` (the latest value of a metric counts), `run_id, doc_id,
    reason, n` (summed), `run_id, doc_id, relation` (a set) and `run_id, doc_id, text, seq` (each error once, in
    order; rows without a doc_id are errors of the batch). A document that only failed has empty metrics.
    """
    key = ["run_id", "doc_id"]
    latest = metrics.groupBy(*key, "metric").agg(F.max_by("value", "seq").alias("value"))
    measured = latest.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    counted = reasons.groupBy(*key, "reason").agg(F.sum("n").alias("n")).where("n > 0")
    refused = counted.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejection_reasons"))
    kinds = relations.where("trim(relation) <> ''").groupBy(*key).agg(F.array_sort(F.collect_set(F.trim("relation"))).alias("relation_types"))
    failed = ordered_errors(errors.where("doc_id is not null"), *key)
    out = measured
    for part in (refused, kinds, failed):
        out = out.join(part, key, "full")
    none = {"metrics": "map<string,double>", "rejection_reasons": "map<string,bigint>", "relation_types": "array<string>", "errors": "array<string>"}
    empty = {c: (F.create_map() if t.startswith("map") else F.array()).cast(t) for c, t in none.items()}
    return out.select(*key, *[F.coalesce(F.col(c).cast(t), empty[c]).alias(c) for c, t in none.items()])


def batch_manifest(documents: DataFrame, runs: DataFrame, phases: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each run of `run_id, pipeline_version, started_at, completed_at`: with papers, totals, phase metrics and batch errors.

    `documents` is the document manifest, `phases` are `run_id, phase, metric, value, seq` (the latest value counts), batch errors the
    rows of `errors` without a doc_id. Totals sum each metric over the documents.
    """
    summed = documents.select("run_id", F.explode("metrics").alias("metric", "value")).groupBy("run_id", "metric").agg(F.sum("value").alias("value"))
    totals = summed.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("totals"))
    papers = documents.groupBy("run_id").agg(F.count("*").alias("documents"), F.count_if(F.size("errors") > 0).alias("failed_documents"))
    each = phases.groupBy("run_id", "phase", "metric").agg(F.max_by("value", "seq").alias("value"))
    nested = each.groupBy("run_id", "phase").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    nested = nested.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", F.map_entries("m").alias("m"))))).alias("entries"))
    nested = nested.select("run_id", F.transform_values("entries", lambda k, v: F.map_from_entries(v)).alias("phase_metrics"))
    failed = ordered_errors(errors.where("doc_id is null"), "run_id").withColumnRenamed("errors", "batch_errors")
    out = runs
    for part in (papers, totals, nested, failed):
        out = out.join(part, "run_id", "left")
    return out


def latest_quality(documents: DataFrame, runs: DataFrame, drift: DataFrame) -> DataFrame:
    """`kind, name, value` of the run that ended last (then the greatest run_id), from its document manifest.

    Sums of attempted, accepted and rejected triples, nodes and edges; acceptance and edges per node where there is a denominator;
    each rejection reason's share of the rejected; the ten relations that most documents have (ties by name);
    drift events of all runs (`alert`). Without a run only the drift is told.
    """
    latest = runs.agg(F.max(F.struct("completed_at", "run_id")).alias("r")).select(F.col("r.run_id").alias("run_id"))
    # One scan: everything is told from one row a document of the latest run, as (kind, name, value) pairs.
    mine = documents.join(F.broadcast(latest), "run_id")
    number = lambda k: F.coalesce(F.col("metrics")[k], F.lit(0.0))
    pair = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    sums = F.array(*[pair("sum", F.lit(k), number(k)) for k in ("attempted", "accepted", "rejected", "nodes", "edges")], pair("sum", F.lit("documents"), F.lit(1)))
    reasons = F.transform(F.map_entries("rejection_reasons"), lambda e: pair("rejection", e["key"], e["value"]))
    relations = F.transform("relation_types", lambda r: pair("relation", r, F.lit(1)))
    told = mine.select(F.explode(F.concat(sums, reasons, relations)).alias("t")).groupBy("t.kind", "t.name").agg(F.sum("t.value").alias("value"))
    # From here on a row for each reason and relation name, not for each document.
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "name"))
    of = lambda name: F.max(F.when((F.col("kind") == "sum") & (F.col("name") == name), F.col("value"))).over(Window.partitionBy())
    told = told.withColumns({"place": place, "rejected": of("rejected"), "attempted": of("attempted"), "nodes": of("nodes")})
    ratio = lambda kind, name, of_: told.where((F.col("kind") == "sum") & (F.col("name") == name) & (F.col(of_) > 0)).select(F.lit("ratio").alias("kind"), F.lit(kind).alias("name"), F.round(F.col("value") / F.col(of_), 6).alias("value"))
    value = F.when(F.col("kind") == "rejection", F.round(F.when(F.col("rejected") > 0, F.col("value") / F.col("rejected")), 6)).otherwise(F.col("value"))
    kept = told.where("kind <> 'relation' or place <= 10").select("kind", "name", value.alias("value"))
    events = drift.where("alert").agg(F.count("*").cast("double").alias("value")).select(F.lit("drift").alias("kind"), F.lit("all").alias("name"), "value")
    return kept.unionByName(ratio("acceptance_rate", "accepted", "attempted")).unionByName(ratio("edges_per_node", "edges", "nodes")).unionByName(events)


def run_kpis(runs: DataFrame) -> DataFrame:
    """`run_id, metric, value, status`: acceptance and pipeline success, where there is a denominator."""
    pairs = F.array(
        F.struct(F.lit("acceptance_rate").alias("metric"), F.col("accepted").alias("num"), F.col("attempted").alias("den")),
        F.struct(F.lit("pipeline_success").alias("metric"), F.col("processed").alias("num"), (F.col("processed") + F.col("skipped")).alias("den")),
    )
    rows = runs.select("run_id", F.explode(pairs).alias("p")).select("run_id", "p.*").where("den > 0")
    value = F.col("num") / F.col("den")
    status = F.when(F.col("metric") == "acceptance_rate", level(value, config.KPI_ACCEPTANCE)).otherwise(level(value, config.KPI_SUCCESS))
    return rows.select("run_id", "metric", F.round(value, 6).alias("value"), status.alias("status"))


def audit_kpis(audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KPI rows of each audit (noise control, duplicate rate), and an alert for each that isn't green."""
    pairs = F.array(F.struct(F.lit("noise_control").alias("metric"), F.col("correct_edges").alias("num")), F.struct(F.lit("duplicate_rate").alias("metric"), F.col("duplicate_edges").alias("num")))
    rows = audits.where("total_edges > 0").select("audit_id", "total_edges", F.explode(pairs).alias("p")).select("audit_id", "p.metric", (F.col("p.num") / F.col("total_edges")).alias("raw"))
    status = F.when(F.col("metric") == "noise_control", level(F.col("raw"), config.KPI_NOISE)).otherwise(level(F.col("raw"), config.KPI_DUPLICATES, higher=False))
    kpis = rows.select("audit_id", "metric", F.round("raw", 6).alias("value"), status.alias("status"))
    alerts = kpis.where("status <> 'green'").select("audit_id", "metric", "value", F.when(F.col("status") == "red", "critical").otherwise("warning").alias("level"))
    return kpis, alerts


def auto_audit(edges: DataFrame, least: int = config.AUDIT_MIN_EDGES) -> DataFrame:
    """Of each document with enough edge occurrences: all, and those beyond the first of each edge."""
    grouped = edges.groupBy("doc_id").agg(F.sum("times_seen").alias("total_edges"), F.sum(F.col("times_seen") - 1).alias("duplicate_edges"))
    return grouped.where(F.col("total_edges") >= least)


def semantic_drift(runs: DataFrame) -> DataFrame:
    """Each paper's run against its run before: drop of accepted triples and new relation types; `alert` beyond either bar."""
    order = Window.partitionBy("paper_id").orderBy("completed_at", "run_id")
    rows = runs.withColumn("before", F.lag("accepted").over(order)).withColumn("known", F.lag("relations").over(order)).withColumn("previous_run", F.lag("run_id").over(order))
    rows = rows.where("previous_run is not null")
    drop = F.when(F.col("before") > 0, F.greatest(F.lit(0.0), (F.col("before") - F.col("accepted")) / F.col("before"))).otherwise(0.0)
    new = F.array_sort(F.array_except("relations", "known"))
    return rows.select("paper_id", "run_id", "previous_run", F.round(drop, 6).alias("drop_ratio"), new.alias("new_relations"), ((drop >= config.DRIFT_DROP) | (F.size(new) >= config.DRIFT_RELATIONS)).alias("alert"))


def triple_relevancy(edges: DataFrame, least: int = config.RELEVANCY_MIN_EDGES) -> DataFrame:
    """`doc_id, edges, average, minimum, maximum, status` of cosine `score`, weighted by times_seen, of documents with enough edges."""
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    grouped = edges.where("score is not null").withColumn("score", clamped).groupBy("doc_id").agg(
        F.sum("times_seen").alias("edges"), (F.sum(F.col("score") * F.col("times_seen")) / F.sum("times_seen")).alias("avg"), F.min("score").alias("minimum"), F.max("score").alias("maximum")
    )
    good, fair = config.RELEVANCY
    status = F.when(F.col("avg") >= good, "green").when(F.col("avg") >= fair, "yellow").otherwise("red")
    return grouped.where(F.col("edges") >= least).select("doc_id", "edges", F.round("avg", 6).alias("average"), F.round("minimum", 6).alias("minimum"), F.round("maximum", 6).alias("maximum"), status.alias("status"))


def recent(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n newest rows by `order`, newest first, ties by the columns that follow."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def kpi_status(history: DataFrame, n: int = 12) -> DataFrame:
    """Of each metric the latest value and status, and its last n values in order of time."""
    order = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("seq"))
    last = history.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    values = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "value"))), lambda s: s["value"])
    return last.groupBy("metric").agg(F.max_by("value", F.struct("ts", "seq")).alias("latest"), F.max_by("status", F.struct("ts", "seq")).alias("status"), values.alias("values"))


def export_summary(shares: DataFrame, events: DataFrame) -> DataFrame:
    """One row: shares, MB (a missing size counts 0), warnings, p50 and p95 of the first download's latency, shares never downloaded."""
    state = shares.join(events, "share_id", "left")
    return state.agg(
        F.count("*").alias("shares"),
        F.round(F.sum(F.coalesce("mb", F.lit(0.0))), 6).alias("mb"),
        F.count_if(F.col("state") == "warned").alias("warned"),
        F.round(F.percentile("latency_s", 0.5), 6).alias("p50"),
        F.round(F.percentile("latency_s", 0.95), 6).alias("p95"),
        F.count_if(F.col("first_download_at").isNull()).alias("never_downloaded"),
    )


def qa_summary(rows: DataFrame) -> DataFrame:
    """Median and p95 (interpolated) of resolution and total latency, answers by fallback, answers without a path."""
    return rows.agg(
        *[F.round(F.percentile(c, p), 6).alias(f"{c}_p{int(p * 100)}") for c in ("resolution_ms", "total_ms") for p in (0.5, 0.95)],
        F.count_if(F.col("fallback_edges") > 0).alias("fallbacks"),
        F.count_if(F.col("paths") == 0).alias("without_path"),
    )


def soft_failures(runs: DataFrame, qa: DataFrame) -> DataFrame:
    """One row from two one-row aggregates: co-mention edges of recent runs, and fallback counts."""
    return runs.agg(F.sum("co_mention_edges").alias("co_mention_edges")).crossJoin(qa_summary(qa).select("fallbacks", "without_path"))


def recent_errors(errors: DataFrame, n: int = 50) -> DataFrame:
    """First occurrence of each text, batch errors (`level` 0) before document errors."""
    first = errors.groupBy("text").agg(F.min(F.struct("level", "ts", "seq")).alias("at"))
    return first.orderBy("at").limit(n).select("text", F.col("at.level").alias("level"))


def graph_quality(edges: DataFrame, nodes: DataFrame, rejections: DataFrame) -> DataFrame:
    """`kind, name, value`: edges per node, share of each rejection reason, top 10 relations by documents (ties by name)."""
    # Edges and rejections may be dear to make: each is read once, into a row for each relation and each reason.
    documents = edges.groupBy("relation", "doc_id").agg(F.count("*").alias("e"))
    relations = checkpointed(documents.groupBy("relation").agg(F.count("doc_id").alias("n"), F.sum("e").alias("e")))
    per_node = relations.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("e")).crossJoin(nodes.agg(F.count("*").alias("n"))).select(F.lit("edges_per_node").alias("kind"), F.lit("all").alias("name"), F.round(F.col("e") / F.col("n"), 6).alias("value"))
    counted = checkpointed(rejections.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n").alias("all"))
    shares = counted.crossJoin(F.broadcast(total)).select(F.lit("rejection").alias("kind"), F.col("reason").alias("name"), F.round(F.col("n") / F.col("all"), 6).alias("value"))
    top = relations.orderBy(F.desc("n"), "relation").limit(10).select(F.lit("relation").alias("kind"), F.col("relation").alias("name"), F.col("n").cast("double").alias("value"))
    return per_node.unionByName(shares).unionByName(top)


def audit_summary(kpis: DataFrame) -> DataFrame:
    """Average of each metric and its worst status."""
    rank = F.when(F.col("status") == "red", 0).when(F.col("status") == "amber", 1).otherwise(2)
    return kpis.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("average"), F.count("*").alias("audits"), F.min_by("status", rank).alias("worst"))


def relevancy_summary(rows: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "red", 0).when(F.col("status") == "yellow", 1).otherwise(2)
    return rows.agg(F.count("*").alias("documents"), F.round(F.avg("average"), 6).alias("average"), F.min("minimum").alias("minimum"), F.min_by("status", rank).alias("worst"))


_STAMP = r"^([0-9-]{10} [0-9:]{8},[0-9]{3})"


def download_durations(lines: DataFrame) -> DataFrame:
    """`stream, start_seq, seconds` of downloads: an end closes the latest start that is still open.

    Lines `stream, seq, ts, event` (start or end). Depth runs over the stream and never falls below zero,
    so an end without a start is dropped; at each depth starts and ends then alternate.
    """
    order = Window.partitionBy("stream").orderBy("seq")
    step = F.when(F.col("event") == "start", 1).otherwise(-1)
    run = lines.withColumn("sum", F.sum(step).over(order))
    # Clamping at zero: what the running sum has fallen below zero so far is given back.
    clamped = run.withColumn("low", F.least(F.lit(0), F.min("sum").over(order))).withColumn("depth", F.col("sum") - F.col("low"))
    before = F.lag("low", 1, 0).over(order)
    paired = clamped.withColumn("lost", (F.col("event") == "end") & (F.col("low") < before)).where(~F.col("lost"))
    paired = paired.withColumn("depth", F.when(F.col("event") == "end", F.col("depth") + 1).otherwise(F.col("depth")))
    same = Window.partitionBy("stream", "depth").orderBy("seq")
    ends = paired.withColumn("start_ts", F.lag("ts").over(same)).withColumn("start_seq", F.lag("seq").over(same)).where("event = 'end' and start_seq is not null")
    return ends.select("stream", "start_seq", F.col("seq").alias("end_seq"), F.round((F.unix_micros("ts") - F.unix_micros("start_ts")) / 1e6, 3).alias("seconds"))


def stage_timings(lines: DataFrame) -> DataFrame:
    """`paper, parse, extraction, total, dominant` from text lines such as `... finished parse for x.pdf in 3.1 s`."""
    pattern = r"finished (parse|extraction|conversion|total) for (.+?)(?:\.pdf)? in ([0-9.]+) s"
    parsed = lines.select(F.regexp_extract("value", pattern, 1).alias("stage"), F.regexp_extract("value", pattern, 2).alias("paper"), F.expr(f"try_cast(regexp_extract(value, '{pattern.replace(chr(92), chr(92) * 2)}', 3) as double)").alias("s")).where("stage <> ''")
    sums = parsed.groupBy("paper").agg(*[F.round(F.sum(F.when(F.col("stage") == k, F.col("s"))), 6).alias(k) for k in ("parse", "extraction", "conversion", "total")])
    stages = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(k), F.lit(0.0))).alias("s"), F.lit(k).alias("k")) for k in ("parse", "extraction", "conversion")]))
    return sums.withColumn("dominant", stages[0]["k"])


def multi_paper_chains(edges: DataFrame) -> DataFrame:
    """`via, chains`: the number of two-hop trails over each middle node whose edges come from different documents.

    Of n edges at a node, n_d of them from document d, that is (n * n - sum of n_d * n_d) / 2: no pairs are
    made, however many edges a hub has. A self-loop is one edge at its node.
    """
    ends = edges.select(F.col("src").alias("via"), "doc_id").unionAll(edges.where("src <> dst").select(F.col("dst").alias("via"), "doc_id"))
    by_document = ends.groupBy("via", "doc_id").agg(F.count("*").alias("n"))
    counted = by_document.groupBy("via").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return counted.select("via", F.expr("(n * n - same) div 2").alias("chains")).where("chains > 0")


def multi_paper_chain_pairs(edges: DataFrame, middles: DataFrame) -> DataFrame:
    """`a, via, b, chains`: the same trails for each pair of ends, over the asked middle nodes (`via`) only.

    Steps are counted by (middle, end, document) first, so a hub meets itself once a document, not once an edge.
    """
    edges = edges.select("src", "dst", "doc_id")
    ends = edges.select(F.col("src").alias("via"), F.col("dst").alias("end"), "doc_id").unionAll(edges.select(F.col("dst").alias("via"), F.col("src").alias("end"), "doc_id"))
    steps = ends.join(middles.select("via").distinct(), "via", "left_semi").groupBy("via", "end", "doc_id").agg(F.count("*").alias("n"))
    left, right = steps.toDF("via", "a", "doc_a", "n"), steps.toDF("via", "b", "doc_b", "m")
    met = left.join(right, "via").where("a < b and doc_a <> doc_b")
    return met.groupBy("a", "via", "b").agg(F.sum(F.col("n") * F.col("m")).alias("chains"))


def audit_overview(audits: DataFrame) -> DataFrame:
    """One row over all audits: their number and edges, averages of ratios where an audit has edges, the latest time, reviewers by name."""
    total = F.col("total_edges")
    return audits.agg(
        F.count("*").alias("reviews"),
        F.sum(total.cast("long")).alias("total_edges"),
        F.round(F.avg(F.when(total > 0, F.col("correct_edges") / total)), 6).alias("average_correct"),
        F.round(F.avg(F.when(total > 0, F.col("duplicate_edges") / total)), 6).alias("average_duplicate"),
        F.max("reviewed_at").alias("last_reviewed_at"),
        F.array_sort(F.collect_set(F.nullif(F.trim("reviewer"), F.lit("")))).alias("reviewers"),
    )


def audit_findings(audits: DataFrame, n: int = 5) -> DataFrame:
    """The n latest audits with their ratios; a missing reviewer is `Unknown`."""
    total = F.col("total_edges")
    named = audits.withColumn("reviewer", F.coalesce(F.nullif(F.trim("reviewer"), F.lit("")), F.lit("Unknown")))
    rated = named.withColumns({"correct_ratio": F.when(total > 0, F.col("correct_edges") / total), "duplicate_ratio": F.when(total > 0, F.col("duplicate_edges") / total)})
    return recent(rated, n, "reviewed_at", "audit_id")
