"""Queries over candidate triples, incremental state, the registry and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.operators import comention, export, extraction, incremental, registry
from quillgraph.plans import sql
from quillgraph.plans.graph_queries import _EDGE_TABLE, _edges
from quillgraph.plans.text_queries import _elements
from quillgraph.sources import logs, tables

PHRASES = ("It uses", "is used by the", "was trained on!", "focuses on", "performs better than", "is caused by", "has nothing", "leads to")


def triple_budget(spark, sf):
    return extraction.triple_budget(_elements(spark, sf))


def build_requests(spark, sf):
    return extraction.build_requests(_elements(spark, sf), "m1", "p1").select("element_id", "budget", "budget_key", "response_key")


def _responses(spark, sf):
    """A stored response for every third document, some of them written twice."""
    r = extraction.build_requests(_elements(spark, sf), "m1", "p1").where(F.col("doc_id").cast("int") % 3 == 0)
    first = r.select("response_key", F.lit(1).alias("seq"), F.lit("old").alias("body"))
    return first.unionByName(r.where(F.col("doc_id").cast("int") % 2 == 0).select("response_key", F.lit(2).alias("seq"), F.lit("new").alias("body"))).distinct()


def cache_hits(spark, sf):
    return extraction.cache_lookup(extraction.build_requests(_elements(spark, sf), "m1", "p1"), _responses(spark, sf))[0].select("element_id", "body")


def cache_misses(spark, sf):
    return extraction.cache_lookup(extraction.build_requests(_elements(spark, sf), "m1", "p1"), _responses(spark, sf))[1].select("element_id")


def _bodies(spark, sf):
    k = F.col("doc_id") % 4
    good = F.concat(F.lit('{"finish_reason":"'), F.when(k == 1, "length").otherwise("stop"), F.lit('","triples":[{"subject":"a'), F.col("doc_id").cast("string"), F.lit('","relation":"uses","object":"b","confidence":0.5},{"subject":" ","relation":"uses","object":"b"},{"subject":"c","relation":"uses","object":"d"}]}'))
    return tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("element_id"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(15).alias("budget"), F.when(k == 3, "{bad").otherwise(good).alias("body"))


def parse_responses(spark, sf):
    return extraction.parse_responses(_bodies(spark, sf))[1].select("element_id", "pos", "subject", "object")


def response_status(spark, sf):
    return extraction.parse_responses(_bodies(spark, sf))[0]


def _triples(spark, sf):
    """First and last capitalised word of each sentence; relation, type and confidence by document."""
    s = comention.sentences(_elements(spark, sf), "content")
    caps = s.withColumn("caps", tables.capitalised(F.col("sentence"))).where(F.size("caps") >= 1).withColumn("d", F.col("doc_id").cast("int"))
    pick = F.get(F.array(*[F.lit(p) for p in PHRASES]), F.col("d") % len(PHRASES))
    return caps.select(
        "doc_id", "element_id", "section", "sent_no", "content", "sentence", F.get("caps", 0).alias("subject"), F.element_at("caps", -1).alias("object"), pick.alias("relation_text"),
        F.when(F.col("d") % 9 == 0, None).otherwise("Method").alias("subject_type"), F.when(F.col("d") % 11 == 0, None).otherwise("Task").alias("object_type"), (F.col("d") * 37 % 120 / 100).alias("confidence"), F.lit("none").alias("decision"),
    )


def normalise_relations(spark, sf):
    return extraction.normalise_relations(_triples(spark, sf).select("element_id", "sent_no", "relation_text"))


def _validated(spark, sf):
    return extraction.validate_triples(extraction.normalise_relations(_triples(spark, sf)))


def validate_triples(spark, sf):
    return _validated(spark, sf).select("element_id", "sent_no", "reason", "src_text", "dst_text")


def supporting_sentence(spark, sf):
    t = _triples(spark, sf).withColumn("given_sentence", F.when(F.col("sent_no") % 2 == 0, F.lit(" ")).otherwise(F.lit("given"))).drop("sentence")
    return extraction.supporting_sentence(t).select("element_id", "sent_no", "sentence")


def section_counts(spark, sf):
    return extraction.section_counts(_validated(spark, sf).where("reason is null"))


def type_votes(spark, sf):
    return extraction.type_votes(_validated(spark, sf).where("reason is null"))


def extraction_summary(spark, sf):
    return extraction.extraction_summary(_validated(spark, sf))


def entity_types(spark, sf):
    words = F.array(*[F.lit(w) for w in ("a network", "Corpus", "error  rate", "nanotube x", "models", "plain", "BLEU")])
    d = tables.read(spark, sf, "documents").select("doc_id", F.get(words, (F.col("doc_id") % 7).cast("int")).alias("name"))
    return d.select("doc_id", "name", extraction.hint_type(F.col("name")).alias("type"))


def _registry(spark, sf):
    e = _elements(spark, sf)
    return e.where(F.col("doc_id").cast("int") % 2 == 0).select("doc_id", "content_hash", F.when(F.col("doc_id").cast("int") % 3 == 0, "v0").otherwise("v1").alias("version")).distinct()


def pending_chunks(spark, sf):
    return incremental.pending_chunks(_elements(spark, sf), _registry(spark, sf), "v1").select("element_id")


def mark_processed(spark, sf):
    done = _elements(spark, sf).where(F.col("doc_id").cast("int") % 3 == 0)
    return incremental.mark_processed(_registry(spark, sf), done, "v1").groupBy("version").agg(F.count("*").alias("chunks"))


def force_reset(spark, sf):
    docs = tables.read(spark, sf, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return incremental.force_reset(_registry(spark, sf), docs).groupBy("version").agg(F.count("*").alias("chunks"))


def needs_deprecation(spark, sf):
    return incremental.needs_deprecation(_elements(spark, sf), _registry(spark, sf), "v1")


def _paper_events(spark, sf):
    e = tables.read(spark, sf, "events")
    status = F.when(F.col("event_type") == "signup", "uploaded").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed")
    return e.select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.when(F.col("value") > 80, F.concat(F.lit("title "), F.col("event_id").cast("string"))).alias("title"))


def registry_state(spark, sf):
    return registry.registry_state(_paper_events(spark, sf), ("status", "title"))


def search_papers(spark, sf):
    state = registry.registry_state(_paper_events(spark, sf), ("status", "title"))
    return registry.search_papers(state, text="9").select("paper_id", "title")


def search_authors(spark, sf):
    """Parts as papers: the words of a name are its authors."""
    p = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_type").alias("file_name"), F.split("p_name", " ").alias("authors"))
    return registry.search_papers(p, text="al", author="O").select("paper_id")


def active_papers(spark, sf):
    return registry.active_papers(registry.registry_state(_paper_events(spark, sf), ("status", "title"))).select("paper_id", "status", "updated_at")


def paper_counts(spark, sf):
    return registry.paper_counts(registry.registry_state(_paper_events(spark, sf), ("status", "title")))


def queue_snapshot(spark, sf):
    return registry.queue_snapshot(registry.registry_state(_paper_events(spark, sf), ("status", "title"))).select("status", "n")


def assign_paper_ids(spark, sf):
    p = tables.read(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    return registry.assign_paper_ids(p).select("seq", "paper_id")


def export_edges(spark, sf):
    v = comention.sentences(_elements(spark, sf)).select("element_id", "sent_no", "sentence")
    return export.export_edges(v, chars=60)


def export_graphml(spark, sf):
    return export.graphml_lines(tables.graph_nodes(spark, sf), _edges(spark, sf))


def export_manifest(spark, sf):
    return export.export_manifest(export.graphml_lines(tables.graph_nodes(spark, sf), _edges(spark, sf)))


def share_records(spark, sf):
    d = tables.read(spark, sf, "documents").groupBy(F.col("source").alias("share_id")).agg((F.sum(F.octet_length("text").cast("long")) * 20).alias("bytes"))
    return export.share_records(d)


def share_state(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "download").when(F.col("event_type") == "error", "revoke")
    e = tables.read(spark, sf, "events").select(F.col("user_id").alias("share_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("ts")).where("event_type is not null")
    return export.share_state(e)


def section_maps(spark, sf):
    e = _elements(spark, sf).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("element_id"), (F.length("content") % 4).alias("n"))))).alias("m"))
    enc = e.select("doc_id", logs.encode_sections(F.col("m")).alias("s"))
    return enc.select("doc_id", F.concat_ws(",", "s.names").alias("names"), F.concat_ws(",", F.transform("s.counts", lambda x: x.cast("string"))).alias("counts"), F.size(logs.decode_sections(F.col("s.names"), F.col("s.counts"))).alias("n"))


def evidence_json(spark, sf):
    flat = F.concat(F.lit('{"element_id":"'), F.col("element_id"), F.lit('","doc_id":"'), F.col("doc_id"), F.lit('",'))
    span = F.concat(F.lit('"start":'), F.col("start_char").cast("string"), F.lit(',"end":'), F.col("end_char").cast("string"))
    n = F.col("doc_id").cast("int") % 3
    text = F.when(n == 0, F.concat(flat, span, F.lit("}"))).when(n == 1, F.concat(flat, F.lit('"text_span":{'), span, F.lit("}}"))).otherwise("not json")
    got = _elements(spark, sf).select("element_id", logs.decode_evidence(text).alias("e"))
    return got.select("element_id", F.col("e.doc_id").alias("doc_id"), F.coalesce(F.col("e.start").cast("long"), F.lit(-1)).alias("start_at"), F.coalesce(F.col("e.end").cast("long"), F.lit(-1)).alias("end_at"))


def text_log(spark, sf):
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "junk ").otherwise(""), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, "").otherwise(",250"), F.lit(" INFO "), F.col("event_type"))
    return logs.parse_text_log(tables.read(spark, sf, "events").select(line.alias("value")))


_PICK = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_PATTERNS = "(VALUES " + ", ".join(f"('{p}', '{c}', {str(s).lower()}, {i})" for i, (p, c, s) in enumerate((p, c, s) for c, s, ps in config.RELATION_PATTERNS for p in ps)) + ") AS pt(phrase, canonical, swap, rank)"
_TRIPLES = sql.SENTENCES + f""",
tr AS (SELECT doc_id, element_id, section, sent_no, sentence, l[1] AS subject, l[len(l)] AS object, {_PICK}[CAST(doc_id AS INT) % {len(PHRASES)} + 1] AS relation_text, CAST(doc_id AS INT) AS d FROM (SELECT *, {sql.caps("sentence")} AS l FROM sents) WHERE len(l) >= 1),
ph AS (SELECT DISTINCT relation_text AS raw, trim(regexp_replace(lower(relation_text), '[^a-z]+', ' ', 'g')) AS clean FROM tr),
norm AS (SELECT raw, arg_min((canonical, swap), (-length(phrase), rank)) AS p FROM ph JOIN {_PATTERNS} ON contains(clean, phrase) GROUP BY raw),
full_t AS (SELECT tr.*, p[1] AS relation, coalesce(p[2], false) AS swap, e.content FROM tr LEFT JOIN norm ON raw = relation_text JOIN elements e USING (element_id)),
st AS (SELECT *, CASE WHEN swap THEN object ELSE subject END AS src_text, CASE WHEN swap THEN subject ELSE object END AS dst_text FROM full_t),
located AS (SELECT *, instr(content, src_text) AS s1, instr(content, dst_text) AS o1, d * 37 % 120 / 100 AS conf FROM st),
val AS (SELECT *, CASE WHEN relation IS NULL THEN 'relation_unmapped' WHEN d % 9 = 0 THEN 'subject_type_ambiguous' WHEN d % 11 = 0 THEN 'object_type_ambiguous' WHEN conf > 1 THEN 'invalid_confidence'
        WHEN lower(src_text) = lower(dst_text) THEN 'identical_entities' WHEN greatest(s1, o1) < least(s1 + length(src_text), o1 + length(dst_text)) THEN 'span_overlap' END AS reason FROM located)"""
_ROLES = _TRIPLES + ", roles AS (SELECT section, src_text AS name, 'Method' AS type FROM val WHERE reason IS NULL UNION ALL SELECT section, dst_text, 'Task' FROM val WHERE reason IS NULL)"
_BUDGET = "least(15, greatest(ceil(len(regexp_extract_all(content, '[^ ]+')) / 60), len(list_filter(regexp_split_to_array(content, '[.!?]+'), lambda s: trim(s) <> '')), 1), 53)"
_REG = sql.ELEMENTS + ", reg AS (SELECT DISTINCT doc_id, content_hash, CASE WHEN CAST(doc_id AS INT) % 3 = 0 THEN 'v0' ELSE 'v1' END AS version FROM elements WHERE CAST(doc_id AS INT) % 2 = 0)"
_PAPERS = """ev AS (SELECT user_id AS paper_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' END AS status, CASE WHEN value > 80 THEN 'title ' || event_id END AS title FROM events),
state AS (SELECT paper_id, arg_max(status, (ts, seq)) FILTER (status IS NOT NULL) AS status, arg_max(title, (ts, seq)) FILTER (title IS NOT NULL) AS title, min(ts) AS uploaded_at, max(ts) AS updated_at FROM ev GROUP BY paper_id)"""
_LINES = _EDGE_TABLE + ", " + sql.NODES + """, lines AS (SELECT 0 AS part, node_id AS id, '<node id="' || node_id || '"><data key="name">' || name || '</data></node>' AS line FROM named UNION ALL SELECT 1, edge_id, '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || relation || '</data></edge>' FROM merged)"""

QUERIES = {f"d_{f.__name__}": f for f in (triple_budget, build_requests, cache_hits, cache_misses, normalise_relations, entity_types, validate_triples, supporting_sentence, section_counts, type_votes, extraction_summary)}
QUERIES |= {f"a_{f.__name__}": f for f in (parse_responses, response_status, section_maps, evidence_json, text_log)}
QUERIES |= {f"f_{f.__name__}": f for f in (pending_chunks, mark_processed, force_reset, needs_deprecation)}
QUERIES |= {f"k_{f.__name__}": f for f in (registry_state, search_papers, search_authors, active_papers, paper_counts, queue_snapshot, assign_paper_ids)}
QUERIES |= {f"l_{f.__name__}": f for f in (export_edges, export_graphml, export_manifest, share_records, share_state)}

ORACLES = {
    "d_triple_budget": f"WITH {sql.ELEMENTS} SELECT element_id, CAST({_BUDGET} AS INT) AS budget FROM elements",
    "d_build_requests": f"WITH {sql.ELEMENTS}, b AS (SELECT element_id, content_hash, CAST({_BUDGET} AS INT) AS budget FROM elements) SELECT element_id, budget, 'm1:p1:' || content_hash || ':' || budget AS budget_key, sha256('m1‖p1‖' || content_hash) AS response_key FROM b",
    "d_cache_hits": f"WITH {sql.ELEMENTS}, k AS (SELECT content_hash, max(CAST(doc_id AS INT) % 2 = 0) AS n FROM elements WHERE CAST(doc_id AS INT) % 3 = 0 GROUP BY 1) SELECT element_id, CASE WHEN n THEN 'new' ELSE 'old' END AS body FROM elements JOIN k USING (content_hash)",
    "d_cache_misses": f"WITH {sql.ELEMENTS} SELECT element_id FROM elements WHERE content_hash NOT IN (SELECT content_hash FROM elements WHERE CAST(doc_id AS INT) % 3 = 0)",
    "d_normalise_relations": f"WITH {_TRIPLES} SELECT element_id, sent_no, relation_text, relation, swap FROM full_t",
    "d_entity_types": "SELECT doc_id, ['a network', 'Corpus', 'error  rate', 'nanotube x', 'models', 'plain', 'BLEU'][doc_id % 7 + 1] AS name, ['Method', 'Dataset', 'Metric', 'Material', NULL, NULL, 'Metric'][doc_id % 7 + 1] AS type FROM documents",
    "d_validate_triples": f"WITH {_TRIPLES} SELECT element_id, sent_no, reason, src_text, dst_text FROM val",
    "d_supporting_sentence": f"WITH {_TRIPLES} SELECT element_id, sent_no, CASE WHEN sent_no % 2 = 1 THEN 'given' ELSE list_filter(list_transform(regexp_extract_all(content, '[^.!?]+[.!?]?'), lambda s: trim(s)), lambda s: contains(lower(s), lower(subject)) AND contains(lower(s), lower(object)))[1] END AS sentence FROM full_t",
    "d_section_counts": f"WITH {_ROLES} SELECT name, section, count(*) AS n FROM roles GROUP BY ALL",
    "d_type_votes": f"WITH {_ROLES} SELECT name, type, count(*) AS n FROM roles GROUP BY ALL",
    "d_extraction_summary": f"WITH {_TRIPLES}, g AS (SELECT doc_id, reason, count(*) AS n FROM val GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS attempted, CAST(coalesce(sum(n) FILTER (reason IS NULL), 0) AS BIGINT) AS accepted, CAST(sum(n) - coalesce(sum(n) FILTER (reason IS NULL), 0) AS BIGINT) AS rejected, coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) FILTER (reason IS NOT NULL), '') AS reasons FROM g GROUP BY doc_id",
    "a_parse_responses": "SELECT CAST(doc_id AS VARCHAR) AS element_id, pos, CASE pos WHEN 0 THEN 'a' || doc_id ELSE 'c' END AS subject, CASE pos WHEN 0 THEN 'b' ELSE 'd' END AS object FROM documents, (SELECT unnest([0, 2]) AS pos) WHERE doc_id % 4 <> 3 AND pos < CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 15 END",
    "a_response_status": "SELECT CAST(doc_id AS VARCHAR) AS element_id, CASE doc_id % 4 WHEN 3 THEN 'error' WHEN 1 THEN 'truncated' ELSE 'ok' END AS status FROM documents",
    "a_section_maps": f"WITH {sql.ELEMENTS} SELECT doc_id, coalesce(string_agg(element_id, ',' ORDER BY element_id) FILTER (length(content) % 4 > 0), '') AS names, coalesce(string_agg(length(content) % 4, ',' ORDER BY element_id) FILTER (length(content) % 4 > 0), '') AS counts, count(*) FILTER (length(content) % 4 > 0) AS n FROM elements GROUP BY doc_id",
    "a_evidence_json": f"WITH {sql.ELEMENTS} SELECT element_id, CASE WHEN CAST(doc_id AS INT) % 3 < 2 THEN doc_id END AS doc_id, CASE WHEN CAST(doc_id AS INT) % 3 < 2 THEN start_char ELSE -1 END AS start_at, CASE WHEN CAST(doc_id AS INT) % 3 < 2 THEN end_char ELSE -1 END AS end_at FROM elements",
    "a_text_log": "SELECT date_trunc('second', ts) + INTERVAL 250 MILLISECOND AS ts, 'INFO ' || event_type AS message FROM events WHERE event_id % 5 <> 0",
    "f_pending_chunks": f"WITH {_REG} SELECT element_id FROM elements e WHERE NOT EXISTS (SELECT 1 FROM reg r WHERE r.doc_id = e.doc_id AND r.content_hash = e.content_hash AND version = 'v1')",
    "f_mark_processed": f"WITH {_REG}, done AS (SELECT DISTINCT doc_id, content_hash FROM elements WHERE CAST(doc_id AS INT) % 3 = 0), r2 AS (SELECT version FROM reg ANTI JOIN done USING (doc_id, content_hash) UNION ALL SELECT 'v1' FROM done) SELECT version, count(*) AS chunks FROM r2 GROUP BY version",
    "f_force_reset": f"WITH {_REG} SELECT version, count(*) AS chunks FROM reg WHERE CAST(doc_id AS INT) % 4 <> 0 GROUP BY version",
    "f_needs_deprecation": f"WITH {_REG} SELECT DISTINCT doc_id FROM reg WHERE version <> 'v1'",
    "k_registry_state": f"WITH {_PAPERS} SELECT * FROM state",
    "k_search_papers": f"WITH {_PAPERS} SELECT paper_id, title FROM state WHERE contains(title, '9')",
    "k_search_authors": "SELECT p_partkey AS paper_id FROM part WHERE (contains(lower(p_name), 'al') OR contains(lower(p_type), 'al')) AND len(list_filter(string_split(p_name, ' '), lambda a: contains(lower(a), 'o'))) > 0",
    "k_active_papers": f"WITH {_PAPERS} SELECT paper_id, status, updated_at FROM state WHERE status IN ('uploaded', 'processing')",
    "k_paper_counts": f"WITH {_PAPERS} SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed FROM state",
    "k_queue_snapshot": f"WITH {_PAPERS} SELECT status, count(*) AS n FROM state GROUP BY status",
    "k_assign_paper_ids": "WITH s AS (SELECT p_partkey AS seq, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq) - 1 AS k FROM s) SELECT seq, CASE WHEN k = 0 THEN slug ELSE slug || '-' || k END AS paper_id FROM r",
    "l_export_edges": f"WITH {sql.SENTENCES} SELECT element_id, sent_no, CASE WHEN length(sentence) > 60 THEN rtrim(substr(sentence, 1, 60)) || '...' ELSE sentence END AS sentence FROM sents",
    "l_export_graphml": f"WITH {_LINES} SELECT part, id, line FROM lines",
    "l_export_manifest": f"WITH {_LINES} SELECT part, count(*) AS rows, CAST(sum(strlen(line)) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(sha256(line), 1, 15) AS BIGINT)) AS VARCHAR) AS digest, '1' AS version, '' AS filters FROM lines GROUP BY part",
    "l_share_records": "WITH s AS (SELECT source AS share_id, sum(strlen(text)) * 20 / 1048576.0::DOUBLE AS mb FROM documents GROUP BY source) SELECT share_id, round(mb, 6) AS mb, CASE WHEN mb > 5 THEN 'blocked' WHEN mb > 3 THEN 'warned' ELSE 'ok' END AS state FROM s",
    "l_share_state": """WITH s AS (SELECT user_id AS share_id, min(ts) FILTER (event_type = 'signup') AS created_at, min(ts) FILTER (event_type = 'view') AS first_download_at, count(*) FILTER (event_type = 'view') AS downloads, bool_or(event_type = 'error') AS revoked, coalesce(epoch_us(max(ts)) > epoch_us(min(ts) FILTER (event_type = 'signup')) + 30 * 86400000000, false) AS expired FROM events WHERE event_type IN ('signup', 'view', 'error') GROUP BY user_id)
        SELECT *, CASE WHEN first_download_at >= created_at THEN round((epoch_us(first_download_at) - epoch_us(created_at)) / 1e6, 3) END AS latency_s FROM s""",
}
