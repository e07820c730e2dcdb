"""Queries for canonicalisation and quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import canonical, quality
from quillgraph.plans.extraction_queries import _ROLES, _TRIPLES, _validated
from quillgraph.plans.graph_queries import _EDGE_TABLE, _edges
from quillgraph.sources import tables
from quillgraph.streaming import jobs


def _events(spark, sf):
    return tables.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _metrics(spark, sf):
    e = _events(spark, sf)
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("user_id").alias("doc_id")).agg(
        F.count("*").alias("attempted"), F.count_if(F.col("event_type") == "click").alias("accepted"), F.count_if(F.col("event_type") != "error").alias("processed"), F.count_if(F.col("event_type") == "error").alias("skipped"),
        F.max(F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("event_id") % 5).cast("string")))).alias("error"), F.max("ts").alias("completed_at"),
    )


def run_manifest(spark, sf):
    return quality.run_manifest(_metrics(spark, sf))


def _run_id():
    return F.date_format("ts", "yyyy-MM-dd").alias("run_id")


def _document_manifest(spark, sf):
    """Days as runs, users as documents: counts by event type as metrics, other types than clicks as reasons, errors by text."""
    e = _events(spark, sf).select(_run_id(), F.col("user_id").alias("doc_id"), "event_id", "event_type", "value")
    n = e.groupBy("run_id", "doc_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("event_type") == "click").alias("accepted"), F.countDistinct("event_type").alias("nodes"), F.max("event_id").alias("seq"))
    values = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in (("attempted", F.col("attempted")), ("accepted", F.col("accepted")), ("rejected", F.col("attempted") - F.col("accepted")), ("nodes", F.col("nodes")), ("edges", F.col("accepted") * 2))])
    # An older value of each metric is logged too; the latest counts.
    metrics = n.select("run_id", "doc_id", "seq", F.explode(values).alias("m")).select("run_id", "doc_id", "m.*", "seq")
    metrics = metrics.unionByName(metrics.withColumns({"value": F.lit(-1.0), "seq": F.col("seq") - 1}))
    reasons = e.where("event_type <> 'click'").select("run_id", "doc_id", F.col("event_type").alias("reason"), F.lit(1).alias("n"))
    return quality.document_manifest(metrics, reasons, e.select("run_id", "doc_id", F.col("event_type").alias("relation")), _errors_of(spark, sf))


def _errors_of(spark, sf):
    """Errors of documents, and every third one of the batch."""
    e = _events(spark, sf).where("event_type = 'error'")
    return e.select(_run_id(), F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("doc_id"), F.concat(F.lit(" e"), (F.col("event_id") % 5).cast("string"), F.lit(" ")).alias("text"), F.col("event_id").alias("seq"))


def _runs(spark, sf):
    return _events(spark, sf).groupBy(_run_id()).agg(F.lit("v1").alias("pipeline_version"), F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"))


def document_manifest(spark, sf):
    d = _document_manifest(spark, sf)
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ",")
    return d.select("run_id", "doc_id", pairs("metrics").alias("metrics"), pairs("rejection_reasons").alias("reasons"), F.array_join("relation_types", ",").alias("relations"), F.array_join("errors", ",").alias("errors"))


def batch_manifest(spark, sf):
    e = _events(spark, sf)
    phases = e.select(_run_id(), F.col("event_type").alias("phase"), F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("metric"), F.col("event_id").cast("double").alias("value"), F.col("event_id").alias("seq"))
    m = quality.batch_manifest(_document_manifest(spark, sf), _runs(spark, sf), phases, _errors_of(spark, sf))
    return m.select("run_id", "documents", "failed_documents", F.col("totals")["accepted"].cast("long").alias("accepted"), F.size("phase_metrics").alias("phases"), F.col("phase_metrics")["view"]["m0"].cast("long").alias("view_m0"), F.array_join("batch_errors", ",").alias("batch_errors"))


def latest_quality(spark, sf):
    return quality.latest_quality(_document_manifest(spark, sf), _runs(spark, sf), semantic_drift(spark, sf))


def run_kpis(spark, sf):
    return quality.run_kpis(quality.run_manifest(_metrics(spark, sf)))


def _audits(spark, sf):
    return tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("audit_id"), (F.col("o_custkey") % 20).alias("total_edges"), (F.col("o_custkey") % 17).alias("correct_edges"), (F.col("o_custkey") % 3).alias("duplicate_edges"))


def audit_kpis(spark, sf):
    return quality.audit_kpis(_audits(spark, sf))[0]


def audit_alerts(spark, sf):
    return quality.audit_kpis(_audits(spark, sf))[1].groupBy("metric", "level").agg(F.count("*").alias("n"))


def audit_summary(spark, sf):
    return quality.audit_summary(quality.audit_kpis(_audits(spark, sf))[0])


def _reviews(spark, sf):
    rows = _audits(spark, sf).join(tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("audit_id"), "o_custkey"), "audit_id")
    return rows.withColumn("reviewer", F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")))).withColumn("reviewed_at", F.timestamp_seconds(F.col("audit_id"))).drop("o_custkey")


def audit_overview(spark, sf):
    return quality.audit_overview(_reviews(spark, sf)).withColumn("reviewers", F.concat_ws("|", "reviewers"))


def audit_findings(spark, sf):
    return quality.audit_findings(_reviews(spark, sf)).select("audit_id", "reviewer", "total_edges", F.round("correct_ratio", 6).alias("correct_ratio"), F.round("duplicate_ratio", 6).alias("duplicate_ratio"))


def auto_audit(spark, sf):
    return quality.auto_audit(_edges(spark, sf))


def semantic_drift(spark, sf):
    e = _events(spark, sf)
    runs = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("user_id").alias("paper_id")).agg(F.count_if(F.col("event_type") == "click").alias("accepted"), F.array_sort(F.collect_set("event_type")).alias("relations"), F.max("ts").alias("completed_at"))
    return quality.semantic_drift(runs).withColumn("new_relations", F.concat_ws("|", "new_relations"))


def triple_relevancy(spark, sf):
    t = _validated(spark, sf).where("reason is null")
    score = F.aggregate(F.zip_with(canonical.hash_embedding(F.concat_ws(" ", "src_text", "relation", "dst_text")), canonical.hash_embedding(F.col("sentence")), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return quality.triple_relevancy(t.select("doc_id", F.lit(1).cast("long").alias("times_seen"), score.alias("score")))


def recent_runs(spark, sf):
    return quality.recent(quality.run_manifest(_metrics(spark, sf)), 5, "completed_at", "run_id").select("run_id", "documents", "attempted")


def kpi_status(spark, sf):
    h = _events(spark, sf).select(F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("seq"), "value", F.when(F.col("value") > 50, "green").otherwise("red").alias("status"))
    return quality.kpi_status(h).withColumn("values", F.concat_ws(",", F.transform("values", lambda v: v.cast("decimal(20,2)").cast("string"))))


def recent_alerts(spark, sf):
    a = _events(spark, sf).where("event_type = 'error'").select("event_id", "ts", "props")
    return quality.recent(a, 20, "ts", "event_id").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def export_summary(spark, sf):
    from quillgraph.plans.extraction_queries import share_state

    shares = tables.read(spark, sf, "documents").groupBy((F.col("doc_id") % 200).alias("share_id")).agg((F.sum(F.octet_length("text").cast("long")) / 100000.0).alias("mb"), F.lit("x").alias("s")).withColumn("state", F.when(F.col("mb") > 0.2, "warned").otherwise("ok"))
    return quality.export_summary(shares.select("share_id", "mb", "state"), share_state(spark, sf).select("share_id", "first_download_at", "latency_s"))


def _qa_rows(spark, sf):
    e = _events(spark, sf)
    return e.select(F.col("value").alias("resolution_ms"), (F.col("value") * 2 + F.col("event_id") % 7).alias("total_ms"), (F.col("event_id") % 3).alias("fallback_edges"), (F.col("event_id") % 4).alias("paths"))


def qa_summary(spark, sf):
    return quality.qa_summary(_qa_rows(spark, sf))


def soft_failures(spark, sf):
    runs = _events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("co_mention_edges"))
    return quality.soft_failures(runs, _qa_rows(spark, sf))


def recent_errors(spark, sf):
    e = _events(spark, sf).where("event_type = 'error'").select(F.col("props").alias("text"), (F.col("event_id") % 2).alias("level"), "ts", F.col("event_id").alias("seq"))
    return quality.recent_errors(e)


def graph_quality(spark, sf):
    return quality.graph_quality(_edges(spark, sf), tables.graph_nodes(spark, sf), _validated(spark, sf))


def log_downloads(spark, sf):
    e = _events(spark, sf).where("event_type in ('view', 'click')").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "view", "start").otherwise("end").alias("event"))
    return quality.download_durations(e)


def log_stages(spark, sf):
    stage = F.get(F.array(F.lit("parse"), F.lit("extraction"), F.lit("conversion"), F.lit("total"), F.lit("other")), (F.col("event_id") % 5).cast("int"))
    line = F.concat(F.lit("2024 finished "), stage, F.lit(" for paper"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".pdf").otherwise(""), F.lit(" in "), (F.col("event_id") % 1000).cast("string"), F.lit(".5 s"))
    return quality.stage_timings(_events(spark, sf).select(line.alias("value")))


def multi_paper_chains(spark, sf):
    return quality.multi_paper_chains(_edges(spark, sf).where("confidence >= 0.5"))


def multi_paper_chain_pairs(spark, sf):
    """Over the nations' first parts, as asked for."""
    middles = tables.read(spark, sf, "nation").select(F.concat(F.lit("p"), (F.col("n_nationkey") + 1).cast("string")).alias("via"))
    return quality.multi_paper_chain_pairs(_edges(spark, sf).where("confidence >= 0.5"), middles)


def kpi_windows(spark, sf):
    return jobs.kpi_windows(_events(spark, sf).select(F.col("event_type").alias("metric"), "ts", "value"))


def aggregate_entities(spark, sf):
    v = _validated(spark, sf).where("reason is null")
    m = v.select("doc_id", "section", F.explode(F.array(F.struct(F.col("src_text").alias("name"), F.lit("Method").alias("type")), F.struct(F.col("dst_text").alias("name"), F.lit("Task").alias("type")))).alias("r")).select("doc_id", "section", "r.*", F.lit(1).alias("times_seen"))
    return canonical.aggregate_entities(m).select("name", "type", "times_seen", F.size("docs").alias("n_docs"), F.size("sections").alias("n_sections"))


def name_features(spark, sf):
    p = tables.read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lit("of the"), "p_type").alias("name"))
    out = canonical.name_features(p)
    return out.select("p_partkey", "normalised", F.size("tokens").alias("n_tokens"), "letters", "initials", "sentence_like")


def hash_embedding(spark, sf):
    p = tables.read(spark, sf, "customer").select("c_name", F.sha2("c_name", 256).alias("key"), canonical.hash_embedding(F.col("c_name")).alias("v"))
    return p.select("c_name", F.round(F.get("v", 0), 9).alias("v0"), F.round(F.get("v", 15), 9).alias("v15"))


def missing_embeddings(spark, sf):
    n = tables.read(spark, sf, "part").select(F.col("p_name").alias("name"))
    cache = tables.read(spark, sf, "part").where("p_partkey < 20").select(F.sha2("p_name", 256).alias("key"))
    return canonical.missing_embeddings(n, cache).select("name")


def similarity_search(spark, sf):
    e = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), canonical.unit(F.col("embedding")).alias("vector"))
    return canonical.similarity_search(e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e, 0.2, 10).select("query_id", "id", "k")


def _clustered(spark, sf):
    c = tables.read(spark, sf, "customer")
    return c.select((F.col("c_custkey") % 300).cast("string").alias("cluster"), F.concat(F.lit("Name "), (F.col("c_custkey") % 700).cast("string")).alias("name"), F.concat(F.lit("name "), (F.col("c_custkey") % 700).cast("string")).alias("normalised"), F.col("c_mktsegment").alias("type"), (F.col("c_custkey") % 7 + 1).alias("times_seen"), F.array((F.col("c_custkey") % 10).cast("string")).alias("docs"))


def cluster_nodes(spark, sf):
    return canonical.cluster_nodes(_clustered(spark, sf)).select("cluster", "name", "type", F.concat_ws("|", "aliases").alias("aliases"), "times_seen", F.concat_ws("|", "docs").alias("docs"))


def merge_map(spark, sf):
    nodes = canonical.cluster_nodes(_clustered(spark, sf)).withColumn("node_id", F.col("cluster"))
    tops = nodes.select("node_id", F.concat_ws("+", F.slice("docs", 1, 2)).alias("top"))
    return canonical.merge_map(nodes, tops)


def merge_report(spark, sf):
    nodes = canonical.cluster_nodes(_clustered(spark, sf)).withColumn("node_id", F.col("cluster"))
    return canonical.merge_report(nodes)


_METRICS = """met AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, user_id AS doc_id, count(*) AS attempted, count(*) FILTER (event_type = 'click') AS accepted, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS skipped, max(CASE WHEN event_type = 'error' THEN 'e' || event_id % 5 END) AS error, max(ts) AS completed_at FROM events GROUP BY ALL),
man AS (SELECT run_id, count(DISTINCT doc_id) AS documents, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(skipped) AS BIGINT) AS skipped, count(DISTINCT error) AS distinct_errors, max(completed_at) AS completed_at FROM met GROUP BY run_id)"""
_AUDIT = """a AS (SELECT o_orderkey AS audit_id, o_custkey % 20 AS t, o_custkey % 17 AS c, o_custkey % 3 AS d FROM orders WHERE o_custkey % 20 > 0),
k AS (SELECT audit_id, 'noise_control' AS metric, round(c / t, 6) AS value, CASE WHEN c / t >= 0.9 THEN 'green' WHEN c / t >= 0.85 THEN 'amber' ELSE 'red' END AS status FROM a UNION ALL SELECT audit_id, 'duplicate_rate', round(d / t, 6), CASE WHEN d / t <= 0.05 THEN 'green' WHEN d / t <= 0.1 THEN 'amber' ELSE 'red' END FROM a)"""
_QA = "q AS (SELECT value AS r, value * 2 + event_id % 7 AS t, event_id % 3 AS f, event_id % 4 AS p FROM events)"
_CLUSTERS = """c AS (SELECT CAST(c_custkey % 300 AS VARCHAR) AS cluster, 'Name ' || c_custkey % 700 AS name, c_mktsegment AS type, c_custkey % 7 + 1 AS n, CAST(c_custkey % 10 AS VARCHAR) AS doc FROM customer),
nm AS (SELECT cluster, arg_max(name, (n, name)) AS name, list_sort(list(DISTINCT name)) AS names FROM (SELECT cluster, name, sum(n) AS n FROM c GROUP BY ALL) GROUP BY cluster),
ty AS (SELECT cluster, arg_max(type, (n, type)) AS type FROM (SELECT cluster, type, sum(n) AS n FROM c GROUP BY ALL) GROUP BY cluster),
bs AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS times_seen, list_sort(list(DISTINCT doc)) AS docs FROM c GROUP BY cluster),
cn AS (SELECT cluster, name, type, names, list_filter(names, lambda x: x <> name) AS aliases, times_seen, docs FROM bs JOIN nm USING (cluster) JOIN ty USING (cluster))"""


def _emb(column: str) -> str:
    return f"list_transform(range(0, 16), lambda i: CAST(CAST('0x' || substr(sha256({column}), i * 2 + 1, 2) AS INT) AS DOUBLE))"


QUERIES = {f"g_{f.__name__}": f for f in (aggregate_entities, name_features, hash_embedding, missing_embeddings, similarity_search, cluster_nodes, merge_map, merge_report)}
QUERIES |= {f"m_{f.__name__}": f for f in (run_manifest, document_manifest, batch_manifest, latest_quality, run_kpis, audit_kpis, audit_alerts, audit_summary, audit_overview, audit_findings, auto_audit, semantic_drift, triple_relevancy, recent_runs, kpi_status, recent_alerts, export_summary, qa_summary, soft_failures, recent_errors, graph_quality, log_downloads, log_stages, multi_paper_chains, multi_paper_chain_pairs)}
QUERIES |= {"s_kpi_windows": kpi_windows}

_MANIFEST = """ev AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, * FROM events), err AS (SELECT run_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS doc_id, 'e' || (event_id % 5) AS text, min(event_id) AS at_id FROM ev WHERE event_type = 'error' GROUP BY ALL),
man AS (SELECT run_id, user_id AS doc_id, count(*) AS attempted, count(*) FILTER (event_type = 'click') AS accepted, count(DISTINCT event_type) AS nodes, list_sort(list(DISTINCT event_type)) AS kinds FROM ev GROUP BY ALL),
why AS (SELECT run_id, user_id AS doc_id, event_type AS reason, count(*) AS n FROM ev WHERE event_type <> 'click' GROUP BY ALL)"""

ORACLES = {
    "m_document_manifest": f"""WITH {_MANIFEST} SELECT m.run_id, m.doc_id, 'accepted=' || accepted || ',attempted=' || attempted || ',edges=' || accepted * 2 || ',nodes=' || nodes || ',rejected=' || (attempted - accepted) AS metrics,
        coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM why w WHERE w.run_id = m.run_id AND w.doc_id = m.doc_id), '') AS reasons, array_to_string(kinds, ',') AS relations,
        coalesce((SELECT string_agg(text, ',' ORDER BY at_id) FROM err e WHERE e.run_id = m.run_id AND e.doc_id = m.doc_id), '') AS errors FROM man m""",
    "m_batch_manifest": f"""WITH {_MANIFEST}, d AS (SELECT run_id, count(*) AS documents, CAST(sum(accepted) AS BIGINT) AS accepted FROM man GROUP BY run_id), f AS (SELECT run_id, count(DISTINCT doc_id) AS failed FROM err WHERE doc_id IS NOT NULL GROUP BY run_id),
        b AS (SELECT run_id, string_agg(text, ',' ORDER BY at_id) AS batch_errors FROM err WHERE doc_id IS NULL GROUP BY run_id), p AS (SELECT run_id, count(DISTINCT event_type) AS phases, max(event_id) FILTER (event_type = 'view' AND event_id % 2 = 0) AS view_m0 FROM ev GROUP BY run_id)
        SELECT run_id, documents, coalesce(failed, 0) AS failed_documents, accepted, CAST(phases AS INTEGER) AS phases, view_m0, batch_errors FROM d LEFT JOIN f USING (run_id) LEFT JOIN b USING (run_id) JOIN p USING (run_id)""",
    "m_latest_quality": f"""WITH {_MANIFEST}, last AS (SELECT arg_max(run_id, (ts, run_id)) AS run_id FROM ev), mine AS (SELECT * FROM man SEMI JOIN last USING (run_id)), s AS (SELECT sum(attempted) AS attempted, sum(accepted) AS accepted, sum(attempted - accepted) AS rejected, sum(nodes) AS nodes, sum(accepted * 2) AS edges, count(*) AS documents FROM mine),
        r AS (SELECT reason, sum(n) AS n FROM why SEMI JOIN last USING (run_id) GROUP BY reason), t AS (SELECT unnest(kinds) AS kind_of FROM mine), o AS (SELECT kind_of, count(*) AS n FROM t GROUP BY kind_of ORDER BY n DESC, kind_of LIMIT 10)
        SELECT 'sum' AS kind, name, CAST(value AS DOUBLE) AS value FROM (UNPIVOT s ON attempted, accepted, rejected, nodes, edges, documents INTO NAME name VALUE value) UNION ALL SELECT 'rejection', reason, round(n / rejected, 6) FROM r, s UNION ALL SELECT 'relation', kind_of, CAST(n AS DOUBLE) FROM o
        UNION ALL SELECT 'ratio', 'acceptance_rate', round(accepted / attempted, 6) FROM s WHERE attempted > 0 UNION ALL SELECT 'ratio', 'edges_per_node', round(edges / nodes, 6) FROM s WHERE nodes > 0 UNION ALL SELECT 'drift', 'all', CAST(count(*) AS DOUBLE) FROM (__DRIFT__) WHERE alert""",
    "g_aggregate_entities": f"WITH {_ROLES.replace('SELECT section, src_text', 'SELECT doc_id, section, src_text').replace('SELECT section, dst_text', 'SELECT doc_id, section, dst_text')}, v AS (SELECT name, type, count(*) AS n FROM roles GROUP BY ALL), t AS (SELECT name, arg_max(type, (n, type)) AS type FROM v GROUP BY name) SELECT name, t.type, count(*) AS times_seen, count(DISTINCT doc_id) AS n_docs, count(DISTINCT section) AS n_sections FROM roles JOIN t USING (name) GROUP BY name, t.type",
    "g_name_features": """WITH n AS (SELECT p_partkey, lower(p_name || ' of the ' || p_type) AS normalised FROM part), t AS (SELECT *, string_split(normalised, ' ') AS l FROM n)
        SELECT p_partkey, normalised, len(list_distinct(l)) AS n_tokens, replace(normalised, ' ', '') AS letters, CASE WHEN len(list_filter(l, lambda x: length(x) > 2 AND x NOT IN ('of', 'the'))) BETWEEN 2 AND 12 THEN array_to_string(list_transform(list_filter(l, lambda x: length(x) > 2 AND x NOT IN ('of', 'the')), lambda x: x[1]), '') END AS initials, len(l) > 5 AS sentence_like FROM t""",
    "g_hash_embedding": f"WITH e AS (SELECT c_name, {_emb('c_name')} AS v FROM customer), n AS (SELECT c_name, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM e) SELECT c_name, round(v[1] / s, 9) AS v0, round(v[16] / s, 9) AS v15 FROM n",
    "g_missing_embeddings": "SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 20)",
    "g_similarity_search": """WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM u),
        p AS (SELECT q.id AS query_id, c.id, round(list_dot_product(q.e, c.e) / (q.s * c.s), 6) AS score FROM n q, n c WHERE q.id % 100 = 0) SELECT query_id, id, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM p WHERE score >= 0.2) WHERE k <= 10""",
    "g_cluster_nodes": f"WITH {_CLUSTERS} SELECT cluster, name, type, array_to_string(aliases, '|') AS aliases, times_seen, array_to_string(docs, '|') AS docs FROM cn",
    "g_merge_map": f"WITH {_CLUSTERS}, r AS (SELECT cluster AS node_id, unnest(names) AS alias, array_to_string(docs[1:2], '+') AS top FROM cn) SELECT CASE WHEN count(*) OVER (PARTITION BY alias) > 1 THEN alias || '::' || top ELSE alias END AS alias, node_id FROM r",
    "g_merge_report": f"WITH {_CLUSTERS} SELECT cluster AS node_id, name, len(aliases) + 1 AS n_aliases, times_seen FROM cn ORDER BY n_aliases DESC, times_seen DESC, name, node_id LIMIT 20",
    "m_run_manifest": f"WITH {_METRICS} SELECT * FROM man",
    "m_run_kpis": f"""WITH {_METRICS} SELECT run_id, 'acceptance_rate' AS metric, round(accepted / attempted, 6) AS value, CASE WHEN accepted / attempted >= 0.7 THEN 'green' WHEN accepted / attempted >= 0.6 THEN 'amber' ELSE 'red' END AS status FROM man WHERE attempted > 0 UNION ALL
        SELECT run_id, 'pipeline_success', round(processed / (processed + skipped), 6), CASE WHEN processed / (processed + skipped) >= 0.97 THEN 'green' WHEN processed / (processed + skipped) >= 0.95 THEN 'amber' ELSE 'red' END FROM man WHERE processed + skipped > 0""",
    "m_audit_kpis": f"WITH {_AUDIT} SELECT * FROM k",
    "m_audit_alerts": f"WITH {_AUDIT} SELECT metric, CASE status WHEN 'red' THEN 'critical' ELSE 'warning' END AS level, count(*) AS n FROM k WHERE status <> 'green' GROUP BY ALL",
    "m_audit_summary": f"WITH {_AUDIT} SELECT metric, round(avg(value), 6) AS average, count(*) AS audits, arg_min(status, CASE status WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END) AS worst FROM k GROUP BY metric",
    "m_audit_overview": """WITH a AS (SELECT o_orderkey AS id, o_custkey % 20 AS t, o_custkey % 17 AS c, o_custkey % 3 AS d, o_custkey % 7 AS r FROM orders)
        SELECT count(*) AS reviews, CAST(sum(t) AS BIGINT) AS total_edges, round(avg(c / t) FILTER (t > 0), 6) AS average_correct, round(avg(d / t) FILTER (t > 0), 6) AS average_duplicate, make_timestamp(max(id) * 1000000) AS last_reviewed_at, string_agg(DISTINCT CASE WHEN r > 0 THEN 'r' || r END, '|' ORDER BY CASE WHEN r > 0 THEN 'r' || r END) AS reviewers FROM a""",
    "m_audit_findings": "SELECT o_orderkey AS audit_id, CASE WHEN o_custkey % 7 = 0 THEN 'Unknown' ELSE 'r' || o_custkey % 7 END AS reviewer, o_custkey % 20 AS total_edges, CASE WHEN o_custkey % 20 > 0 THEN round((o_custkey % 17) / (o_custkey % 20), 6) END AS correct_ratio, CASE WHEN o_custkey % 20 > 0 THEN round((o_custkey % 3) / (o_custkey % 20), 6) END AS duplicate_ratio FROM orders ORDER BY o_orderkey DESC LIMIT 5",
    "m_auto_audit": f"WITH {_EDGE_TABLE} SELECT doc_id, CAST(sum(times_seen) AS BIGINT) AS total_edges, CAST(sum(times_seen - 1) AS BIGINT) AS duplicate_edges FROM merged GROUP BY doc_id HAVING sum(times_seen) >= 10",
    "m_semantic_drift": """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, user_id AS paper_id, count(*) FILTER (event_type = 'click') AS accepted, list_sort(list(DISTINCT event_type)) AS rel, max(ts) AS c FROM events GROUP BY ALL),
        w AS (SELECT *, lag(run_id) OVER o AS previous_run, lag(accepted) OVER o AS b, lag(rel) OVER o AS known FROM r WINDOW o AS (PARTITION BY paper_id ORDER BY c, run_id)), x AS (SELECT *, CASE WHEN b > 0 THEN greatest(0.0::DOUBLE, (b - accepted) / b) ELSE 0 END AS drop, list_filter(rel, lambda y: NOT list_contains(known, y)) AS fresh FROM w WHERE previous_run IS NOT NULL)
        SELECT paper_id, run_id, previous_run, round(drop, 6) AS drop_ratio, array_to_string(fresh, '|') AS new_relations, drop >= 0.25 OR len(fresh) >= 3 AS alert FROM x""",
    "m_triple_relevancy": f"""WITH {_TRIPLES}, v AS (SELECT doc_id, {_emb("src_text || ' ' || relation || ' ' || dst_text")} AS a, {_emb('sentence')} AS b FROM val WHERE reason IS NULL), s AS (SELECT doc_id, least(1.0, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))) AS score FROM v)
        SELECT doc_id, count(*) AS edges, round(avg(score), 6) AS average, round(min(score), 6) AS minimum, round(max(score), 6) AS maximum, CASE WHEN avg(score) >= 0.7 THEN 'green' WHEN avg(score) >= 0.6 THEN 'yellow' ELSE 'red' END AS status FROM s GROUP BY doc_id HAVING count(*) >= 5""",
    "m_recent_runs": f"WITH {_METRICS} SELECT run_id, documents, attempted FROM man ORDER BY completed_at DESC, run_id DESC LIMIT 5",
    "m_kpi_status": "WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type AS metric, arg_max(value, (ts, event_id)) AS latest, CASE WHEN arg_max(value, (ts, event_id)) > 50 THEN 'green' ELSE 'red' END AS status, string_agg(CAST(CAST(value AS DECIMAL(20, 2)) AS VARCHAR), ',' ORDER BY ts, event_id) AS values FROM h WHERE k <= 12 GROUP BY event_type",
    "m_recent_alerts": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "m_export_summary": """WITH d AS (SELECT doc_id % 200 AS share_id, sum(strlen(text)) / 100000.0::DOUBLE AS mb FROM documents GROUP BY 1), s AS (SELECT user_id AS share_id, min(ts) FILTER (event_type = 'signup') AS c, min(ts) FILTER (event_type = 'view') AS f FROM events WHERE event_type IN ('signup', 'view', 'error') GROUP BY 1),
        j AS (SELECT d.*, f, CASE WHEN f >= c THEN round((epoch_us(f) - epoch_us(c)) / 1e6, 3) END AS l FROM d LEFT JOIN s USING (share_id)) SELECT count(*) AS shares, round(sum(mb), 6) AS mb, count(*) FILTER (mb > 0.2) AS warned, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.95), 6) AS p95, count(*) FILTER (f IS NULL) AS never_downloaded FROM j""",
    "m_qa_summary": f"WITH {_QA} SELECT round(quantile_cont(r, 0.5), 6) AS resolution_ms_p50, round(quantile_cont(r, 0.95), 6) AS resolution_ms_p95, round(quantile_cont(t, 0.5), 6) AS total_ms_p50, round(quantile_cont(t, 0.95), 6) AS total_ms_p95, count(*) FILTER (f > 0) AS fallbacks, count(*) FILTER (p = 0) AS without_path FROM q",
    "m_soft_failures": f"WITH {_QA} SELECT (SELECT count(*) FILTER (event_type = 'view') FROM events) AS co_mention_edges, count(*) FILTER (f > 0) AS fallbacks, count(*) FILTER (p = 0) AS without_path FROM q",
    "m_recent_errors": "WITH g AS (SELECT props AS text, min((event_id % 2, ts, event_id)) AS f FROM events WHERE event_type = 'error' GROUP BY props) SELECT text, f[1] AS level FROM g ORDER BY f LIMIT 50",
    "m_graph_quality": f"""WITH {_EDGE_TABLE}, {_TRIPLES}, r AS (SELECT reason, count(*) AS n FROM val WHERE reason IS NOT NULL GROUP BY reason)
        SELECT 'edges_per_node' AS kind, 'all' AS name, round((SELECT count(*) FROM merged) / ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)), 6) AS value UNION ALL
        SELECT 'rejection', reason, round(n / (SELECT sum(n) FROM r), 6) FROM r UNION ALL SELECT * FROM (SELECT 'relation', relation, CAST(count(DISTINCT doc_id) AS DOUBLE) AS v FROM merged GROUP BY relation ORDER BY v DESC, relation LIMIT 10)""",
    "m_log_stages": """WITH g AS (SELECT 'paper' || user_id AS paper, event_id % 5 AS k, event_id % 1000 + 0.5::DOUBLE AS s FROM events WHERE event_id % 5 < 4), p AS (SELECT paper, round(sum(s) FILTER (k = 0), 6) AS parse, round(sum(s) FILTER (k = 1), 6) AS extraction, round(sum(s) FILTER (k = 2), 6) AS conversion, round(sum(s) FILTER (k = 3), 6) AS total FROM g GROUP BY paper)
        SELECT *, list_sort([(-coalesce(parse, 0), 'parse'), (-coalesce(extraction, 0), 'extraction'), (-coalesce(conversion, 0), 'conversion')])[1][2] AS dominant FROM p""",
    "m_multi_paper_chains": f"WITH {_EDGE_TABLE}, n AS (SELECT a AS via, doc_id, count(*) AS n FROM steps WHERE confidence >= 0.5 GROUP BY ALL), c AS (SELECT via, CAST((sum(n) * sum(n) - sum(n * n)) // 2 AS BIGINT) AS chains FROM n GROUP BY via) SELECT * FROM c WHERE chains > 0",
    "m_multi_paper_chain_pairs": f"WITH {_EDGE_TABLE}, s AS (SELECT b AS via, a AS e, doc_id FROM steps WHERE confidence >= 0.5 AND b IN (SELECT 'p' || (n_nationkey + 1) FROM nation)) SELECT x.e AS a, x.via, y.e AS b, count(*) AS chains FROM s x JOIN s y ON x.via = y.via AND x.e < y.e AND x.doc_id <> y.doc_id GROUP BY ALL",
    "m_log_downloads": """WITH e AS (SELECT user_id AS stream, event_id AS seq, ts, event_type, sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events WHERE event_type IN ('view', 'click')),
        m AS (SELECT a.stream, a.seq AS start_seq, a.ts, min(b.seq) AS end_seq FROM e a JOIN e b ON a.stream = b.stream AND b.s = a.s - 1 AND b.seq > a.seq WHERE a.event_type = 'view' GROUP BY ALL)
        SELECT m.stream, start_seq, end_seq, round((epoch_us(e.ts) - epoch_us(m.ts)) / 1e6, 3) AS seconds FROM m JOIN e ON e.stream = m.stream AND e.seq = m.end_seq""",
    "s_kpi_windows": "SELECT date_trunc('day', ts) AS window_start, event_type AS metric, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL",
}
ORACLES["m_latest_quality"] = ORACLES["m_latest_quality"].replace("__DRIFT__", ORACLES["m_semantic_drift"])
