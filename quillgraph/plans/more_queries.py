"""Further queries: metadata, meaning of relations, resolution by vector, clusters, access."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions.checkpoints import ensure_checkpoint_dir
from quillgraph.operators import canonical, elements, extraction, qa, quality, views
from quillgraph.plans.extraction_queries import _TRIPLES, _responses, _triples, _validated
from quillgraph.plans.graph_queries import _EDGE_TABLE, _edges, _mentions
from quillgraph.plans.quality_queries import _emb, triple_relevancy
from quillgraph.plans.text_queries import _elements
from quillgraph.plans import quality_queries, sql
from quillgraph.plans.graph_queries import _NAMED
from quillgraph.sources import logs, tables
from quillgraph.streaming import jobs

PATTERNS = ("uses", "trained on", "causes", "improves")


def paper_authors(spark, sf):
    """Names made from the words of each line, so that runs of names occur."""
    caps = tables.capitalised(F.col("text"))
    items = tables.text_items(spark, sf)
    line = F.when(F.size(caps) >= 4, F.concat(F.get(caps, 0), F.lit(" "), F.get(caps, 1), F.lit(", "), F.get(caps, 2), F.lit(" "), F.get(caps, 3))).otherwise(F.lit("no names"))
    return elements.paper_authors(items.withColumn("text", line)).select("doc_id", F.concat_ws("|", "authors").alias("authors"))


def _phrases(spark, sf):
    return _triples(spark, sf).select(F.col("relation_text").alias("phrase")).distinct().withColumn("vector", canonical.hash_embedding(F.col("phrase")))


def _patterns(spark):
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string").withColumn("vector", canonical.hash_embedding(F.col("pattern")))


def semantic_relations(spark, sf):
    return extraction.semantic_relations(_phrases(spark, sf), _patterns(spark))


def relation_decisions(spark, sf):
    accepted, review = extraction.relation_decisions(_triples(spark, sf).drop("decision"), semantic_relations(spark, sf).drop("decision").withColumn("decision", F.when(F.col("score") >= 0.75, "accept").otherwise("review")))
    return accepted.unionByName(review).groupBy("decision", "pattern").agg(F.count("*").alias("triples"))


def prune_cache(spark, sf):
    live = extraction.build_requests(_elements(spark, sf).where(F.col("doc_id").cast("int") % 2 == 0), "m1", "p1")
    return extraction.prune_cache(_responses(spark, sf), live)


def resolve_entity_types(spark, sf):
    t = _triples(spark, sf).select("element_id", F.col("sent_no").alias("pos"), "subject", "object", F.when(F.col("sent_no") % 2 == 0, "method").otherwise("unknown").alias("raw_subject_type"), F.when(F.col("sent_no") % 3 == 0, "Task").alias("raw_object_type"))
    return extraction.resolve_entity_types(t).groupBy("subject_type", "object_type").agg(F.count("*").alias("triples"))


def link_spans(spark, sf):
    """Part names with one letter in the middle changed, sought in a sentence; every seventh is nothing like it."""
    p = tables.dealt(tables.read(spark, sf, "part").select("p_partkey", "p_name", F.length("p_name").alias("n")), "p_partkey")
    half = (F.col("n") / 2).cast("int")
    changed = F.concat(F.substring(F.upper("p_name"), F.lit(1), half), F.lit("#"), F.substring(F.upper("p_name"), half + 2, F.col("n")))
    target = F.when(F.col("p_partkey") % 7 == 0, "0123456789").when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(changed)
    t = p.select("p_partkey", F.concat(F.lit("Of <"), "p_name", F.lit("> we say 1."), F.repeat(F.lit(" It is so."), (F.col("p_partkey") % 50).cast("int"))).alias("content"), target.alias("target"))
    return extraction.link_spans(t, "content", "target").select("p_partkey", F.coalesce(F.col("span.start").cast("long"), F.lit(-1)).alias("span_start"), F.coalesce(F.col("span.end").cast("long"), F.lit(-1)).alias("span_end"))


def link_exact(spark, sf):
    t = _triples(spark, sf).select("element_id", "sent_no", "content", F.when(F.col("sent_no") % 3 == 0, F.upper("subject")).when(F.col("sent_no") % 7 == 0, F.lit("")).otherwise(F.col("object")).alias("target"))
    return t.select("element_id", "sent_no", F.coalesce(extraction.link_exact(F.col("content"), F.col("target")).cast("long"), F.lit(-1)).alias("span_start"))


def _scratch(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def write_read_parsed(spark, sf):
    """Papers and elements written as tagged JSON lines and read again."""
    papers = tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.lit(2020).alias("year"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("doi"))
    path = _scratch(spark)
    logs.write_parsed(papers, _elements(spark, sf), path)
    back, elements = logs.read_parsed(spark, path)
    return back.select("doc_id", F.col("title").alias("content"), F.lit("paper").alias("kind")).unionByName(elements.select("doc_id", "content", F.col("element_id").alias("kind")))


def append_read_log(spark, sf):
    """Events appended to a log in two writes and read again."""
    e = tables.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = _scratch(spark)
    logs.append_log(e.where("event_id % 2 = 0"), path)
    logs.append_log(e.where("event_id % 2 = 1"), path)
    return logs.read_log(spark, path, "event_id long, ts timestamp, event_type string", 1000, "ts")


def stream_ingest(spark, sf):
    """Elements streamed twice: the second run finds nothing new."""
    path = _scratch(spark)
    _elements(spark, sf).write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    for run in ("a", "b"):
        jobs.ingest(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/registry", f"{path}/out", "v1", f"{path}/state-{run}").awaitTermination()
    return spark.read.parquet(f"{path}/registry").groupBy("doc_id").agg(F.count("*").alias("chunks"))


def stream_paper_status(spark, sf):
    """Status events streamed in several files; the fold of each batch is written, the latest one of a paper counts."""
    path = _scratch(spark)
    e = tables.read(spark, sf, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    e.repartition(3, "seq").write.parquet(f"{path}/in")
    events = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    jobs.write_paper_status(events, f"{path}/out", f"{path}/state").awaitTermination()
    return jobs.read_paper_status(spark, f"{path}/out").select("paper_id", "status")


def resolve_mentions(spark, sf):
    names = qa.node_names(tables.graph_nodes(spark, sf)).select(F.col("low").alias("text")).distinct()
    texts = names.unionByName(_mentions(spark, sf).select(F.col("mention").alias("text"))).distinct()
    vectors = texts.withColumn("vector", canonical.hash_embedding(F.col("text")))
    return qa.resolve_mentions(_mentions(spark, sf), tables.graph_nodes(spark, sf), vectors).select("mention", "node_id", F.round("similarity", 6).alias("similarity"))


def _entities(spark, sf):
    """Vectors of the first four numbers, which lie near each other; names share a word and little else."""
    name = F.concat(F.lit("entity "), F.md5(F.col("vec_id").cast("string")))
    vector = canonical.unit(F.slice("embedding", 1, 4))
    return tables.read(spark, sf, "embeddings").select(name.alias("name"), F.col("label").cast("string").alias("type"), (F.col("vec_id") % 7 + 1).cast("int").alias("times_seen"), vector.alias("vector"), F.create_map(F.lit("Results"), F.lit(1)).alias("sections"))


def cluster_entities(spark, sf):
    """All entities of one giant block, decided in rounds of at most 200 a task."""
    return canonical.resolve_entities(_entities(spark, sf), most=200)


def normal_forms(spark, sf):
    """Part names with a ligature, in full width, with a combining accent, and plain."""
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, F.concat(F.lit("\ufb01ne "), "p_name")).when(n == 1, F.concat(F.lit("\uff26ine "), "p_name")).when(n == 2, F.concat(F.lit("fine\u0301 "), "p_name")).otherwise(F.concat(F.lit("Fine "), "p_name"))
    p = canonical.name_features(tables.read(spark, sf, "part").select("p_partkey", "p_name", name.alias("name")))
    same = canonical.hash_embedding(F.col("name")) == canonical.hash_embedding(F.when(n == 0, F.concat(F.lit("fine "), "p_name")).when(n == 1, F.concat(F.lit("Fine "), "p_name")).when(n == 2, F.concat(F.lit("fin\u00e9 "), "p_name")).otherwise(F.col("name")))
    return p.select("p_partkey", "normalised", same.alias("same_vector"))


def giant_blocks(spark, sf):
    return canonical.giant_blocks(canonical.merge_blocks(_entities(spark, sf)), 20).select("members")


def near_pairs(spark, sf):
    """Near names of four-number vectors at the clusters' base threshold, by pivots."""
    e = tables.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), canonical.unit(F.slice("embedding", 1, 4)).alias("vector"))
    p = canonical.near_pairs(e, 0.88)
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def merge_blocks(spark, sf):
    e = tables.read(spark, sf, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("name"), canonical.unit(F.col("embedding")).alias("vector"))
    return canonical.merge_blocks(e, 0.45).groupBy("block").agg(F.count("*").alias("members"), F.min("name").alias("least")).select("least", "members")


def view_edges(spark, sf):
    return views.view_edges(views.graph_view(_edges(spark, sf), confidence=0.99, limit=300)).select("edge_id", "id")


def access_violations(spark, sf):
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("u"), (F.col("doc_id") % 15).cast("string")).alias("owner_id"), F.array().cast("array<string>").alias("shared_with"), (F.col("doc_id") % 10 == 0).alias("is_public"))
    return views.access_violations(d.select("paper_id"), d, "u2")


def relevancy_summary(spark, sf):
    return quality.relevancy_summary(triple_relevancy(spark, sf))


def needs_review(spark, sf):
    """Triples of the validation ladder by first reason and relation."""
    return _validated(spark, sf).groupBy("reason", "relation").agg(F.count("*").alias("triples"))


_PAT = "[" + ", ".join(f"'{p}'" for p in PATTERNS) + "]"
_SEM = f"""ph_v AS (SELECT DISTINCT relation_text AS phrase, {_emb("relation_text")} AS v FROM tr), pt_v AS (SELECT p AS pattern, {_emb("p")} AS w FROM (SELECT unnest({_PAT}) AS p)),
sc AS (SELECT phrase, pattern, round(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 6) AS score FROM ph_v, pt_v),
sem AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY score DESC, pattern) = 1)"""

QUERIES = {"b_paper_authors": paper_authors}
QUERIES |= {f"d_{f.__name__}": f for f in (semantic_relations, relation_decisions, prune_cache, resolve_entity_types, link_spans, link_exact, needs_review)}
QUERIES |= {f"a_{f.__name__}": f for f in (write_read_parsed, append_read_log)} | {"s_ingest": stream_ingest, "s_paper_status": stream_paper_status}
QUERIES |= {"i_resolve_mentions": resolve_mentions, "g_cluster_entities": cluster_entities, "g_merge_blocks": merge_blocks, "g_giant_blocks": giant_blocks, "g_normal_forms": normal_forms, "g_near_pairs": near_pairs, "j_view_edges": view_edges, "j_access_violations": access_violations, "m_relevancy_summary": relevancy_summary}

_NEAR = "v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"
_RELEVANT = quality_queries.ORACLES["m_triple_relevancy"]
_MENTIONS = "m AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'PART ' || c_custkey ELSE 'ring' END AS mention FROM customer)"

ORACLES = {
    "b_paper_authors": f"""WITH {sql.ITEMS}, c AS (SELECT doc_id, pos, {sql.caps('text')} AS w FROM items WHERE label = 'text' AND page <= {config.METADATA_PAGES}), n AS (SELECT doc_id, pos, CASE WHEN len(w) >= 4 THEN w[1] || ' ' || w[2] || ', ' || w[3] || ' ' || w[4] ELSE 'no names' END AS t FROM c),
        g AS (SELECT doc_id, pos, list_filter(list_transform(string_split(regexp_extract(t, '^(.*?)(?:(?i:proceedings|conference|published|doi:|[0-9])|{"|".join(config.KNOWN_VENUES)}|$)', 1), ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '[A-Z][a-z]+( [A-Z][a-z]+)+')) AS names FROM n WHERE NOT regexp_matches(lower(t), '^(published|doi)')),
        f AS (SELECT doc_id, min(pos) AS first FROM g WHERE len(names) > 0 GROUP BY doc_id), b AS (SELECT g.doc_id, min(pos) AS stop FROM g JOIN f ON f.doc_id = g.doc_id AND pos > first WHERE len(names) = 0 GROUP BY g.doc_id),
        r AS (SELECT g.doc_id, pos, unnest(names) AS name, unnest(range(len(names))) AS i FROM g JOIN f ON f.doc_id = g.doc_id AND pos >= first LEFT JOIN b ON b.doc_id = g.doc_id WHERE stop IS NULL OR pos < stop), o AS (SELECT doc_id, name, min((pos, i)) AS place FROM r GROUP BY ALL)
        SELECT doc_id, string_agg(name, '|' ORDER BY place) AS authors FROM o GROUP BY doc_id""",
    "d_prune_cache": f"""WITH {sql.ELEMENTS}, k AS (SELECT sha256('m1‖p1‖' || content_hash) AS response_key, CAST(doc_id AS INT) AS d FROM elements), r AS (SELECT DISTINCT response_key, 1 AS seq, 'old' AS body FROM k WHERE d % 3 = 0 UNION SELECT response_key, 2, 'new' FROM k WHERE d % 6 = 0)
        SELECT * FROM r WHERE response_key IN (SELECT response_key FROM k WHERE d % 2 = 0)""",
    # One letter of n is wrong, so the ratio of the name's own window is (n - 1) / n, and no other can be higher.
    "d_link_spans": f"""WITH p AS (SELECT *, p_partkey % 7 <> 0 AND (p_partkey % 5 = 0 OR (length(p_name) - 1) / length(p_name) >= {config.SPAN_RATIO}) AS hit FROM part)
        SELECT p_partkey, CAST(CASE WHEN hit THEN 4 ELSE -1 END AS BIGINT) AS span_start, CAST(CASE WHEN hit THEN 4 + length(p_name) ELSE -1 END AS BIGINT) AS span_end FROM p""",
    "d_link_exact": f"WITH {_TRIPLES}, t AS (SELECT element_id, sent_no, content, CASE WHEN sent_no % 3 = 0 THEN upper(subject) WHEN sent_no % 7 = 0 THEN '' ELSE object END AS target FROM full_t) SELECT element_id, sent_no, CASE WHEN target = '' THEN -1 WHEN contains(content, target) THEN instr(content, target) - 1 WHEN contains(lower(content), lower(target)) THEN instr(lower(content), lower(target)) - 1 ELSE -1 END AS span_start FROM t",
    "a_write_read_parsed": f"WITH {sql.ELEMENTS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS content, 'paper' AS kind FROM documents UNION ALL SELECT doc_id, content, element_id FROM elements",
    "a_append_read_log": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC LIMIT 1000",
    "s_ingest": f"WITH {sql.ELEMENTS} SELECT doc_id, count(DISTINCT content_hash) AS chunks FROM elements GROUP BY doc_id",
    "s_paper_status": "SELECT user_id AS paper_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id",
    "g_merge_blocks": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
        n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND round(list_dot_product(a.e, b.e), 6) >= 0.45), reach AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT reach.a, n.b FROM reach JOIN n ON n.a = reach.b),
        c AS (SELECT a, min(b) AS root FROM reach GROUP BY a) SELECT min('e' || a) AS least, count(*) AS members FROM c GROUP BY root""",
    "g_giant_blocks": f"""WITH RECURSIVE {_NEAR}, n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND round(list_dot_product(a.e, b.e), 6) >= {config.MERGE_BASE**2}),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT reach.a, n.b FROM reach JOIN n ON n.a = reach.b), c AS (SELECT a, min(b) AS root FROM reach GROUP BY a) SELECT count(*) AS members FROM c GROUP BY root HAVING count(*) > 20""",
    "g_normal_forms": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'fin\u00e9 ' ELSE 'fine ' END || trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS normalised, true AS same_vector FROM part",
    "g_near_pairs": f"WITH {_NEAR} SELECT least(CAST(a.vec_id AS VARCHAR), CAST(b.vec_id AS VARCHAR)) AS a, greatest(CAST(a.vec_id AS VARCHAR), CAST(b.vec_id AS VARCHAR)) AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND round(list_dot_product(a.e, b.e), 6) >= 0.88",
    "m_relevancy_summary": f"SELECT count(*) AS documents, round(avg(average), 6) AS average, min(minimum) AS minimum, arg_min(status, CASE status WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END) AS worst FROM ({_RELEVANT})",
    "i_resolve_mentions": f"""WITH {_NAMED}, {_MENTIONS}, ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY times_seen DESC, name, node_id) AS k FROM (SELECT DISTINCT mention, node_id, name, times_seen FROM m JOIN lows ON lower(mention) = low)) WHERE k <= 3),
        rest AS (SELECT mention FROM m WHERE mention NOT IN (SELECT mention FROM ex)), terms AS (SELECT DISTINCT mention, unnest(list_append(list_filter(regexp_extract_all(lower(mention), '[a-z0-9]+'), lambda w: length(w) > 2), lower(mention))) AS term FROM rest),
        met AS (SELECT mention, node_id, name, times_seen, max(CAST(low = lower(mention) AS INT)) AS exact FROM lows JOIN terms ON contains(low, term) GROUP BY ALL), con AS (SELECT mention, node_id FROM met QUALIFY row_number() OVER (PARTITION BY mention ORDER BY exact DESC, times_seen DESC, name, node_id) <= 500),
        top AS (SELECT node_id FROM named ORDER BY times_seen DESC, name, node_id LIMIT 500), cand AS (SELECT * FROM con UNION ALL SELECT mention, node_id FROM rest, top WHERE mention NOT IN (SELECT mention FROM con)),
        mv AS (SELECT mention, {_emb('mention')} AS v FROM rest), lv AS (SELECT low, {_emb('low')} AS w FROM (SELECT DISTINCT low FROM lows)),
        near AS (SELECT mention, node_id, name, times_seen, max(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w))) AS similarity FROM cand JOIN lows USING (node_id) JOIN mv USING (mention) JOIN lv USING (low) GROUP BY ALL),
        best AS (SELECT mention, node_id, name, times_seen, 1.0::DOUBLE AS similarity FROM ex UNION ALL SELECT mention, node_id, name, times_seen, similarity FROM near WHERE similarity >= {config.MENTION_SIMILARITY})
        SELECT mention, node_id, round(similarity, 6) AS similarity FROM best QUALIFY row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, times_seen DESC, name, node_id) <= {config.MENTION_TOP}""",
    "d_semantic_relations": f"WITH {_TRIPLES}, {_SEM} SELECT phrase, pattern, score, CASE WHEN score >= 0.75 THEN 'accept' WHEN score >= 0.6 THEN 'review' ELSE 'reject' END AS decision FROM sem",
    "d_relation_decisions": f"WITH {_TRIPLES}, {_SEM} SELECT CASE WHEN score >= 0.75 THEN 'accept' ELSE 'review' END AS decision, pattern, count(*) AS triples FROM tr JOIN sem ON phrase = relation_text GROUP BY ALL",
    "d_needs_review": f"WITH {_TRIPLES} SELECT reason, relation, count(*) AS triples FROM val GROUP BY ALL",
    "j_view_edges": f"WITH {_EDGE_TABLE} SELECT edge_id, src || '->' || dst || ':' || relation || ':' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS id FROM merged WHERE confidence >= 0.99 ORDER BY confidence DESC, created_at DESC, edge_id LIMIT 300",
    "j_access_violations": "SELECT CAST(doc_id AS VARCHAR) AS paper_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 15 <> 2",
}
