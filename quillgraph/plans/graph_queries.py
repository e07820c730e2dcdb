"""Queries over the graph: merges, conflicts, resolution, paths, neighbours, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions.checkpoints import checkpointed
from quillgraph.operators import canonical, graph, qa, views
from quillgraph.plans import sql
from quillgraph.sources import tables


def _nodes(spark, sf):
    """Nodes with a section map, so that merges have something to add."""
    n = tables.graph_nodes(spark, sf)
    sections = F.when(F.col("times_seen") % 2 == 0, F.create_map(F.lit("Results"), F.col("times_seen"))).otherwise(F.create_map(F.lit("Methods"), F.lit(1).cast("long")))
    return n.withColumn("sections", sections).withColumn("version", F.lit("v1"))


def _staged(spark, sf):
    """A second batch: every other node again with one more document."""
    n = _nodes(spark, sf).where("times_seen in (2, 4, 6)")
    return n.withColumn("docs", F.when(F.col("times_seen") == 6, F.col("docs")).otherwise(F.array(F.lit("new")))).withColumn("version", F.lit("v2"))


def upsert_nodes(spark, sf):
    out = graph.upsert_nodes(_nodes(spark, sf), _staged(spark, sf))
    return out.select("node_id", "name", "version", F.concat_ws("|", "aliases").alias("aliases"), "times_seen", F.coalesce(F.try_element_at("sections", F.lit("Results")), F.lit(0)).alias("results"), F.concat_ws("|", F.array_sort("docs")).alias("docs"))


def combine_staged_nodes(spark, sf):
    n = _nodes(spark, sf).where("type = 'part'")
    again = n.withColumn("seq", F.lit(1)).unionByName(n.withColumn("seq", F.lit(2)).withColumn("docs", F.when(F.col("times_seen") > 3, F.array(F.lit("x"), F.lit("y"))).otherwise(F.col("docs"))))
    return graph.combine_staged_nodes(again).select("node_id", "times_seen", F.aggregate(F.map_values("sections"), F.lit(0).cast("long"), lambda a, x: a + x).alias("in_sections"), F.size("docs").alias("n_docs"))


def _staged_edges(spark, sf):
    e = tables.graph_edges(spark, sf)
    return e.select(
        "src", "dst", "relation", "doc_id", "version",
        F.concat_ws(" ", "relation", F.col("line").cast("string")).alias("verbatim"), "confidence", F.lit(1).cast("long").alias("times_seen"),
        F.concat_ws(":", "doc_id", F.col("line").cast("string")).alias("evidence"), F.create_map(F.lit("section"), F.col("section")).alias("attributes"),
        "created_at", (F.col("line").cast("long") * 100000 + F.datediff("created_at", F.lit("1990-01-01"))).alias("seq"), "line",
    )


def _edges(spark, sf):
    return graph.upsert_edges(None, _staged_edges(spark, sf)).withColumn("edge_id", F.concat_ws("|", *graph.EDGE_KEY))


def upsert_edges(spark, sf):
    return _edges(spark, sf).select(*graph.EDGE_KEY, "verbatim", "confidence", "times_seen", "evidence", "created_at", F.col("attributes")["section"].alias("section"))


def flag_conflicts(spark, sf):
    out = graph.flag_conflicts(_edges(spark, sf))
    return out.groupBy("relation").agg(F.count("*").alias("edges"), F.sum(F.col("conflicting").cast("long")).alias("conflicting"))


def conflict_report(spark, sf):
    return graph.conflict_report(_edges(spark, sf))


def _aliased(spark, sf):
    n = tables.graph_nodes(spark, sf).where("type in ('supplier', 'customer')")
    return n.select(F.concat(F.lit("new-"), "node_id").alias("node_id"), F.concat_ws(" ", F.lit("n"), "name").alias("name"), F.array(F.upper("name"), F.lit("zz")).alias("aliases"), "times_seen", "docs")


def resolve_aliases(spark, sf):
    return graph.resolve_aliases(tables.graph_nodes(spark, sf), _aliased(spark, sf))


def apply_alias_resolution(spark, sf):
    staged = _aliased(spark, sf)
    out = graph.apply_alias_resolution(staged, graph.resolve_aliases(tables.graph_nodes(spark, sf), staged))
    return out.select("node_id", "name", F.concat_ws("|", "aliases").alias("aliases"))


def merge_map_remap(spark, sf):
    """Suppliers resolve to the one before, in chains of up to four; customers in rings of three."""
    s, c = tables.read(spark, sf, "supplier"), tables.read(spark, sf, "customer")
    row = lambda kind, key, to: (F.concat(F.lit(kind), key.cast("string")).alias("node_id"), F.concat(F.lit(kind), to.cast("string")).alias("target_id"), F.concat(F.lit("name "), to.cast("string")).alias("target_name"))
    k, q = F.col("s_suppkey"), F.col("c_custkey")
    ring = F.when(q % 3 == 2, q - 2).otherwise(q + 1)
    resolutions = s.where(k % 5 > 0).select(*row("s", k, k - 1)).unionByName(c.select(*row("c", q, ring)))
    aliases = s.select(F.col("s_name").alias("alias"), F.concat(F.lit("s"), k.cast("string")).alias("node_id")).unionByName(c.select(F.col("c_name").alias("alias"), F.concat(F.lit("c"), q.cast("string")).alias("node_id")))
    return graph.remap_merge_map(aliases, resolutions)


def _triples(spark, sf):
    o = tables.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("triple_id"), F.concat(F.lit("customer "), F.when(F.col("o_orderkey") % 4 == 0, F.lit("none")).otherwise(F.col("o_custkey").cast("string"))).alias("subject"), F.concat(F.lit("PART "), (F.col("o_orderkey") % 50).cast("string")).alias("object"))


def resolve_endpoints(spark, sf):
    return graph.resolve_endpoints(_triples(spark, sf), tables.graph_nodes(spark, sf))[0].select("triple_id", "src", "dst")


def unresolved_endpoints(spark, sf):
    return graph.resolve_endpoints(_triples(spark, sf), tables.graph_nodes(spark, sf))[1].select("triple_id", "subject")


def known_documents(spark, sf):
    staged = _aliased(spark, sf)
    existing = tables.graph_nodes(spark, sf)
    return graph.known_documents(staged, existing, graph.resolve_aliases(existing, staged)).select("node_id", F.concat_ws("|", "docs").alias("docs"))


def mark_cross_paper(spark, sf):
    out = graph.mark_cross_paper(tables.graph_edges(spark, sf), tables.graph_nodes(spark, sf).select("node_id", "docs"))
    return out.groupBy("relation", "cross_paper").agg(F.count("*").alias("edges"))


def check_edges(spark, sf):
    e = _staged_edges(spark, sf).withColumn("times_seen", F.when(F.col("line") == 7, 0).otherwise(F.col("times_seen"))).withColumn("doc_id", F.when(F.col("line") == 6, " ").otherwise(F.col("doc_id"))).withColumn("confidence", F.col("confidence") + F.when(F.col("line") == 5, 1.5).otherwise(0.0))
    return graph.check_edges(e).groupBy("broken").agg(F.count("*").alias("edges"))


def edge_attributes(spark, sf):
    t = tables.graph_edges(spark, sf).select("doc_id", "line", "src", "section", F.col("relation").alias("relation_verbatim"))
    return graph.edge_attributes(t).select("doc_id", "line", "src", F.col("attributes")["method"].alias("method"), F.col("attributes")["section"].alias("section"), F.col("attributes")["relation"].alias("relation"))


def deprecate_edges(spark, sf):
    docs = tables.read(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    return graph.deprecate_edges(tables.graph_edges(spark, sf), docs, "v2").groupBy("version").agg(F.count("*").alias("edges"), F.sum(F.col("deprecated").cast("long")).alias("deprecated"))


def _mentions(spark, sf):
    o = tables.read(spark, sf, "customer")
    return o.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("PART "), F.col("c_custkey").cast("string"))).otherwise("ring").alias("mention"))


def match_exact(spark, sf):
    return qa.match_exact(_mentions(spark, sf), tables.graph_nodes(spark, sf))


def match_contains(spark, sf):
    words = tables.read(spark, sf, "nation").select(F.concat(F.lit("green "), F.lower(F.substring("n_name", 1, 3))).alias("mention"))
    return qa.match_contains(words, tables.graph_nodes(spark, sf))


def top_nodes(spark, sf):
    return qa.top_nodes(tables.graph_nodes(spark, sf), 100)


def _pairs(spark, sf):
    """Every supplier with the customer of its number."""
    return tables.read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("goal"))


def _edges_at(spark, sf, ends, columns=("confidence", "created_at")):
    """Edges at the ends (`node_id`), made once; the ids are put together from the keys, not stored."""
    kept = qa.edges_at(graph.upsert_edges(None, _staged_edges(spark, sf)).select(*graph.EDGE_KEY, *columns), ends)
    return checkpointed(kept).withColumn("edge_id", F.concat_ws("|", *graph.EDGE_KEY))


def _pair_edges(spark, sf):
    """Edges at the ends of the pairs."""
    pairs = _pairs(spark, sf)
    ends = pairs.select(F.col("start").alias("node_id")).unionByName(pairs.select(F.col("goal").alias("node_id")))
    return _edges_at(spark, sf, ends)


def _ranked(spark, sf, edges):
    """Ranked paths of the pairs over the edges at their ends; conflicts are looked up for the paths' edges alone."""
    paths = checkpointed(qa.find_paths(_pairs(spark, sf), edges.withColumn("conflicting", F.lit(False)), max_hops=2))
    return qa.rank_paths(paths, _nodes(spark, sf), conflicts=qa.path_conflicts(paths, edges))


def find_paths(spark, sf):
    paths = qa.find_paths(_pairs(spark, sf), _edges(spark, sf).withColumn("conflicting", F.lit(False)), max_hops=2)
    return paths.select("start", "goal", F.concat_ws(",", F.transform("hops", lambda h: h["edge_id"])).alias("signature"))


def long_paths(spark, sf):
    """Trails of up to four hops over the firmest edges, from every supplier to the next one."""
    edges = _edges(spark, sf).withColumn("conflicting", F.lit(False))
    near = tables.read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("start"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("goal"))
    paths = qa.find_paths(near, edges, max_hops=4, confidence=1.0, relations=("uses",))
    return paths.select("start", "goal", F.concat_ws(",", F.transform("hops", lambda h: h["edge_id"])).alias("signature"), F.size("hops").alias("n_hops"))


def contains_customers(spark, sf):
    """Every customer's name and its number as mentions."""
    c = tables.read(spark, sf, "customer")
    words = c.select(F.col("c_name").alias("mention")).unionByName(c.select(F.concat(F.lit("number "), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("mention")))
    return qa.match_contains(words, tables.graph_nodes(spark, sf))


def rank_paths(spark, sf):
    return _ranked(spark, sf, _pair_edges(spark, sf)).select("start", "goal", "signature", "score", "n_hops", "conflicting", "k")


def _asked(spark, sf):
    return tables.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))


def neighbours(spark, sf):
    return qa.neighbours(_asked(spark, sf), _edges(spark, sf), 0.9, 12).select("node_id", "other", "edge_id", "k")


def document_edges(spark, sf):
    docs = tables.read(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    return qa.document_edges(docs, _edges(spark, sf), 0.9, 6).select("doc_id", "node_id", "other", "edge_id", "k")


def fallback_neighbours(spark, sf):
    return qa.fallback_neighbours(_asked(spark, sf), _edges(spark, sf).withColumn("confidence", F.round(F.col("confidence") - F.when(F.col("src") < "s5", 0.3).otherwise(0.0), 2))).select("question_id", "edge_id", "confidence", "k")


def summary_neighbours(spark, sf):
    asked = _asked(spark, sf).withColumn("question_id", F.floor(F.col("question_id") / 5))
    return qa.summary_neighbours(asked, _edges(spark, sf)).select("question_id", "edge_id", "n")


def summary_documents(spark, sf):
    asked = tables.read(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("question_id"), F.col("o_orderkey").cast("string").alias("doc_id"))
    return qa.summary_documents(asked, _edges(spark, sf)).select("question_id", "edge_id", "n")


def _questions(spark, sf):
    c = tables.read(spark, sf, "conversations").where("role = 'user'")
    lead = F.get(F.array(*[F.lit(x) for x in ("Summarize paper doc:12 ", "What is ", "Summarize the cluster of ", "An overview of Paper_a.1, ", "Describe document-x9; ")]), (F.col("conv_id") % 5).cast("int"))
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.concat(lead, "text").alias("text"))


def classify_intent(spark, sf):
    return qa.classify_intent(_questions(spark, sf)).select("question_id", "intent", F.concat_ws("|", "documents").alias("documents"))


def question_mentions(spark, sf):
    return qa.question_mentions(_questions(spark, sf))


def answer_table(spark, sf):
    edges = _pair_edges(spark, sf)
    ranked = _ranked(spark, sf, edges).withColumn("question_id", F.substring("start", 2, 20).cast("long"))
    near = qa.fallback_neighbours(_asked(spark, sf), edges)
    return qa.answer_table(_asked(spark, sf), ranked, near)


def answers(spark, sf):
    """A question for each supplier, of every intent; edges at the supplier stand for its paths of one step."""
    asked = _asked(spark, sf)
    edges = _edges_at(spark, sf, asked)
    intent = F.get(F.array(*map(F.lit, ("paper_summary", "entity_summary", "cluster_summary", "factoid", "factoid"))), (F.col("question_id") % 5).cast("int"))
    questions = asked.select("question_id", intent.alias("intent"), F.array(F.col("question_id").cast("string"), F.lit("b")).alias("documents"))
    nodes = tables.graph_nodes(spark, sf)
    candidates = asked.where("question_id % 5 < 4").join(nodes, "node_id").select("question_id", F.lit(0).alias("pos"), F.lit(1).alias("k"), "node_id", "name", F.lit(1.0).alias("similarity"), "times_seen", F.array().cast("array<string>").alias("sections"))
    near = asked.where("question_id % 10 <> 3").join(qa.neighbours(asked, edges, 0.97, 2), "node_id")
    paths = near.select("question_id", "k", F.lit(0).alias("i"), F.col("src").alias("src_name"), "relation", F.col("dst").alias("dst_name"), "doc_id", "confidence", (F.col("relation") == "improves").alias("conflicting"))
    fallback = qa.fallback_neighbours(asked, edges).select("question_id", "k", F.col("src").alias("src_name"), "relation", F.col("dst").alias("dst_name"), F.split_part("edge_id", F.lit("|"), F.lit(4)).alias("doc_id"), "confidence")
    return qa.answers(questions, candidates, paths, fallback, qa.summary_neighbours(asked, edges))


def answer_context(spark, sf):
    near = qa.summary_neighbours(_asked(spark, sf), _edges(spark, sf))
    return qa.answer_context(near).select("question_id", F.concat_ws("|", "documents").alias("documents"), "prompt")


def ask(spark, sf):
    """Every conversation's first turn, asking how the supplier and the customer of its number go together."""
    first = tables.read(spark, sf, "conversations").where("turn = 0")
    n = tables.read(spark, sf, "supplier").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("least"))
    number = (F.col("conv_id") % F.col("n") + F.col("least")).cast("string")
    questions = first.crossJoin(F.broadcast(n)).select(F.col("conv_id").alias("question_id"), F.concat(F.lower(F.substring("text", 1, 20)), F.lit(" How do S"), number, F.lit(" and C"), number, F.lit(" fit?")).alias("text"))
    nodes = _nodes(spark, sf).withColumns({"name": F.upper("node_id"), "aliases": F.array().cast("array<string>")})
    edges = _edges(spark, sf).withColumns({"citation": F.col("evidence"), "sentence": F.col("verbatim")})
    words = questions.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z0-9]+"), F.lit(0))).alias("text")).distinct()
    vectors = words.withColumn("vector", canonical.hash_embedding(F.col("text")))
    out = qa.ask(questions, nodes, edges, vectors, flag=True)
    return out.select("question_id", "intent", "mode", "summary", F.concat_ws("|", "documents").alias("documents"), "prompt")


def citation_check(spark, sf):
    o = tables.read(spark, sf, "orders")
    answers = o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("see [d"), (F.col("o_orderkey") % 7).cast("string"), F.lit(":1] and [d"), (F.col("o_orderkey") % 5).cast("string"), F.lit(":2] not [this]")).alias("answer"))
    evidence = o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("d"), (F.col("o_custkey") % 5).cast("string"), F.lit(":2")).alias("citation"))
    return qa.citation_check(answers, evidence)


def graph_view(spark, sf):
    return views.graph_view(_edges(spark, sf).withColumn("section", F.col("attributes")["section"]), confidence=0.95, relations=("uses", "improves"), sections=("Results",), limit=500).select("edge_id", "k")


def accessible_view(spark, sf):
    """Results of the edges or of either end, in documents that user u3 may see."""
    docs = tables.read(spark, sf, "orders").where("o_orderkey % 10 = 0 or o_orderkey % 15 = 3").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    nodes = _nodes(spark, sf).where("times_seen in (2, 5)")
    edges = _edges(spark, sf).withColumn("section", F.col("attributes")["section"]).where("section = 'Methods'")
    return views.graph_view(edges, confidence=0.95, sections=("Results",), limit=500, nodes=nodes, access=docs).select("edge_id", "k")


def view_nodes(spark, sf):
    view = views.graph_view(_edges(spark, sf).withColumn("section", F.col("attributes")["section"]), confidence=0.98, limit=500)
    return views.view_nodes(view, tables.graph_nodes(spark, sf)).select("node_id", "name")


def node_importance(spark, sf):
    rings = ((("supplier",), ()), (("part",), ()), ((), ("results",)))
    nodes = tables.graph_nodes(spark, sf).withColumn("sections", F.create_map(F.lit("Methods"), F.col("times_seen") % 3, F.lit("Results"), F.col("times_seen") % 2))
    return views.node_importance(nodes, _edges(spark, sf), rings).select("node_id", "degree", F.round("importance", 9).alias("importance"), "ring")


def partition_by_document(spark, sf):
    return views.partition_by_document(_edges(spark, sf), tables.graph_nodes(spark, sf)).groupBy("part").agg(F.count("*").alias("edges"))


def partition_nodes(spark, sf):
    nodes = tables.graph_nodes(spark, sf)
    return views.partition_nodes(views.partition_by_document(_edges(spark, sf), nodes), nodes).groupBy("part").agg(F.count("*").alias("nodes"))


def node_focus(spark, sf):
    return views.node_focus(_edges(spark, sf), 6).select("node_id", "other", "edge_id", "k")


def accessible_papers(spark, sf):
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("u"), (F.col("doc_id") % 15).cast("string")).alias("owner_id"), F.array(F.concat(F.lit("u"), (F.col("doc_id") % 4).cast("string"))).alias("shared_with"), (F.col("doc_id") % 10 == 0).alias("is_public"))
    return views.accessible_papers(d, "u3").select("paper_id")


_EDGE_TABLE = sql.EDGES + """,
merged AS (SELECT src, dst, relation, doc_id, version, arg_max(relation || ' ' || line, seq) AS verbatim, max(confidence) AS confidence, count(*) AS times_seen, arg_max(doc_id || ':' || line, seq) AS evidence,
           arg_max(section, seq) AS section, arg_min(created_at, seq) AS created_at, src || '|' || dst || '|' || relation || '|' || doc_id || '|' || version AS edge_id FROM (SELECT *, line * 100000 + date_diff('day', DATE '1990-01-01', CAST(created_at AS DATE)) AS seq FROM edges) GROUP BY src, dst, relation, doc_id, version),
reversed AS (SELECT DISTINCT dst AS src, src AS dst, relation FROM merged WHERE relation <> 'correlates-with'),
flagged AS (SELECT m.*, r.src IS NOT NULL AS conflicting FROM merged m LEFT JOIN reversed r ON m.src = r.src AND m.dst = r.dst AND m.relation = r.relation),
steps AS (SELECT *, src AS a, dst AS b FROM flagged UNION ALL SELECT *, dst, src FROM flagged WHERE src <> dst)"""

_PATHS = _EDGE_TABLE + """,
qpairs AS (SELECT 's' || s_suppkey AS start, 'c' || s_suppkey AS goal FROM supplier),
good AS (SELECT * FROM steps WHERE confidence >= 0.7),
weights AS (SELECT 's' || s_suppkey AS node_id, CASE WHEN (s_suppkey % 7 + 1) % 2 = 0 THEN 1.2 ELSE 1.1 END::DOUBLE AS w FROM supplier UNION ALL SELECT 'p' || p_partkey, CASE WHEN (p_partkey % 7 + 1) % 2 = 0 THEN 1.2 ELSE 1.1 END FROM part
            UNION ALL SELECT 'c' || c_custkey, CASE WHEN (c_custkey % 7 + 1) % 2 = 0 THEN 1.2 ELSE 1.1 END FROM customer UNION ALL SELECT 'n' || n_nationkey, CASE WHEN (n_nationkey % 7 + 1) % 2 = 0 THEN 1.2 ELSE 1.1 END FROM nation),
weighted AS (SELECT g.*, g.confidence * x.w * y.w AS f FROM good g JOIN weights x ON x.node_id = g.a JOIN weights y ON y.node_id = g.b),
paths AS (SELECT start, goal, edge_id AS signature, f AS score, created_at AS latest, conflicting, 1 AS n_hops FROM qpairs JOIN weighted ON a = start AND b = goal UNION ALL
          SELECT start, goal, g.edge_id || ',' || h.edge_id, g.f * h.f, greatest(g.created_at, h.created_at), g.conflicting OR h.conflicting, 2 FROM qpairs JOIN weighted g ON g.a = start JOIN weighted h ON h.a = g.b AND h.b = goal AND h.edge_id <> g.edge_id),
ranked AS (SELECT * FROM (SELECT start, goal, signature, round(score, 9) AS score, latest, conflicting, n_hops, row_number() OVER (PARTITION BY start, goal ORDER BY round(score, 9) DESC, latest DESC, signature) AS k FROM paths) WHERE k <= 50)"""

_ASKED = "asked AS (SELECT s_suppkey AS question_id, 's' || s_suppkey AS node_id FROM supplier)"
_NAMED = sql.NODES + ", lows AS (SELECT DISTINCT node_id, name, times_seen, unnest([lower(name), lower(aliases[2])]) AS low FROM named)"
_ALIASED = sql.NODES + """, staged AS (SELECT 'new-' || node_id AS node_id, 'n ' || name AS name, [upper(name), 'zz'] AS aliases, docs FROM named WHERE type IN ('supplier', 'customer')),
elows AS (SELECT DISTINCT node_id, name, unnest([lower(name), lower(aliases[2])]) AS low FROM named), slows AS (SELECT node_id, unnest([lower(name), lower(aliases[1]), 'zz']) AS low FROM staged),
resolved AS (SELECT s.node_id, min((e.node_id, e.name)) AS t FROM slows s JOIN elows e USING (low) GROUP BY s.node_id)"""
_SUMMARY = _EDGE_TABLE + """, {asked}, caps AS (SELECT *, ceil(12 / count(*) OVER (PARTITION BY question_id)) AS cap FROM (SELECT DISTINCT question_id, node_id FROM asked)),
near AS (SELECT a AS node_id, src, dst, relation, doc_id, edge_id, confidence, created_at, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, created_at DESC, edge_id) AS k FROM steps WHERE confidence >= 0.45),
firsts AS (SELECT question_id, src, dst, relation, doc_id, min((-confidence, -epoch_us(created_at), edge_id)) AS f FROM caps JOIN near USING (node_id) WHERE k <= cap GROUP BY ALL),
summary AS (SELECT * FROM (SELECT *, f[3] AS edge_id, row_number() OVER (PARTITION BY question_id ORDER BY f) AS n FROM firsts) WHERE n <= 12)"""
_FALLBACK = """met AS (SELECT question_id, s.*, max(CASE WHEN confidence >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id) AS strong FROM asked JOIN {steps} s ON a = node_id WHERE confidence >= 0.45),
fb AS (SELECT question_id, src, dst, relation, min((-confidence, -epoch_us(created_at), edge_id)) AS f FROM met WHERE strong = 0 OR confidence >= 0.7 GROUP BY ALL),
fallback AS (SELECT * FROM (SELECT question_id, f[3] AS edge_id, -f[1] AS confidence, row_number() OVER (PARTITION BY question_id ORDER BY f) AS k FROM fb) WHERE k <= 50)"""
_QUESTIONS = "q AS (SELECT conv_id || ':' || turn AS question_id, ['Summarize paper doc:12 ', 'What is ', 'Summarize the cluster of ', 'An overview of Paper_a.1, ', 'Describe document-x9; '][conv_id % 5 + 1] || text AS text FROM conversations WHERE role = 'user')"


def _share(*words: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + f") / {len(words)}.0"


def _named_documents() -> str:
    parts = []
    for p in config.DOCUMENT_PREFIXES:
        parts.append(f"regexp_extract_all(text, '(?i){p}(?:[\\s:=]+[''\"]?)([A-Za-z0-9][A-Za-z0-9_.-]*)', 1)")
        parts.append(f"regexp_extract_all(text, '(?i)({p}[-_][A-Za-z0-9][A-Za-z0-9_.-]*)', 1)")
    return f"flatten([{', '.join(parts)}])"


_I = config.INTENT_KEYWORDS
QUERIES = {f"h_{f.__name__}": f for f in (upsert_nodes, combine_staged_nodes, upsert_edges, flag_conflicts, conflict_report, resolve_aliases, apply_alias_resolution, resolve_endpoints, unresolved_endpoints, known_documents, mark_cross_paper, check_edges, edge_attributes, merge_map_remap)}
QUERIES |= {"f_deprecate_edges": deprecate_edges}
QUERIES |= {f"i_{f.__name__}": f for f in (match_exact, match_contains, contains_customers, top_nodes, find_paths, long_paths, rank_paths, neighbours, document_edges, fallback_neighbours, summary_neighbours, summary_documents, classify_intent, question_mentions, answer_table, answers, answer_context, ask, citation_check)}
QUERIES |= {f"j_{f.__name__}": f for f in (graph_view, accessible_view, view_nodes, node_importance, partition_by_document, partition_nodes, node_focus, accessible_papers)}

ORACLES = {
    "h_upsert_nodes": f"""WITH {sql.NODES}, s AS (SELECT * FROM named WHERE times_seen IN (2, 4, 6))
        SELECT n.node_id, n.name, CASE WHEN s.node_id IS NULL THEN 'v1' ELSE 'v2' END AS version, CASE WHEN s.node_id IS NULL THEN n.name || '|' || n.aliases[2] ELSE n.aliases[2] END AS aliases,
        CASE WHEN n.times_seen IN (2, 4) THEN 2 * n.times_seen ELSE n.times_seen END AS times_seen, CASE WHEN n.times_seen IN (2, 4) THEN 2 * n.times_seen WHEN n.times_seen = 6 THEN 6 ELSE 0 END AS results,
        array_to_string(list_sort(list_distinct(CASE WHEN n.times_seen IN (2, 4) THEN list_append(n.docs, 'new') WHEN n.times_seen = 6 THEN n.docs ELSE n.docs END)), '|') AS docs FROM named n LEFT JOIN s ON n.node_id = s.node_id""",
    "h_combine_staged_nodes": f"WITH {sql.NODES} SELECT node_id, CASE WHEN times_seen > 3 THEN 2 * times_seen ELSE times_seen END AS times_seen, CASE WHEN times_seen % 2 = 0 THEN times_seen ELSE 1 END * CASE WHEN times_seen > 3 THEN 2 ELSE 1 END AS in_sections, CASE WHEN times_seen > 3 THEN len(list_distinct(docs)) + 2 ELSE len(list_distinct(docs)) END AS n_docs FROM named WHERE type = 'part'",
    "h_upsert_edges": f"WITH {_EDGE_TABLE} SELECT src, dst, relation, doc_id, version, verbatim, confidence, times_seen, evidence, created_at, section FROM merged",
    "h_flag_conflicts": f"WITH {_EDGE_TABLE} SELECT relation, count(*) AS edges, CAST(sum(CAST(conflicting AS INT)) AS BIGINT) AS conflicting FROM flagged GROUP BY relation",
    "h_conflict_report": f"WITH {sql.EDGES}, k AS MATERIALIZED (SELECT DISTINCT src, dst, relation, doc_id, version FROM edges WHERE relation <> 'correlates-with') SELECT f.src, f.dst, f.relation, f.doc_id, r.doc_id AS reverse_doc_id FROM k f JOIN k r ON f.src = r.dst AND f.dst = r.src AND f.relation = r.relation WHERE f.src < f.dst OR (f.src = f.dst AND f.doc_id <= r.doc_id)",
    "h_resolve_aliases": f"WITH {_ALIASED} SELECT node_id, t[1] AS target_id, t[2] AS target_name FROM resolved",
    "h_apply_alias_resolution": f"WITH {_ALIASED} SELECT coalesce(t[1], s.node_id) AS node_id, coalesce(t[2], s.name) AS name, array_to_string(list_sort(list_filter([s.name, s.aliases[1], 'zz'], lambda x: x <> coalesce(t[2], s.name))), '|') AS aliases FROM staged s LEFT JOIN resolved r ON s.node_id = r.node_id",
    "h_merge_map_remap": """WITH RECURSIVE r AS (SELECT 's' || s_suppkey AS node_id, 's' || (s_suppkey - 1) AS target FROM supplier WHERE s_suppkey % 5 > 0), walk AS (SELECT node_id, target, 1 AS n FROM r UNION ALL SELECT w.node_id, r.target, n + 1 FROM walk w JOIN r ON r.node_id = w.target),
        ends AS (SELECT node_id, arg_max(target, n) AS target FROM walk GROUP BY node_id)
        SELECT s_name AS alias, coalesce(target, 's' || s_suppkey) AS node_id FROM supplier LEFT JOIN ends ON node_id = 's' || s_suppkey UNION
        SELECT c_name, CASE WHEN part_of IS NULL THEN 'c' || (c_custkey + CASE WHEN c_custkey % 3 = 2 THEN -2 ELSE 1 END) ELSE part_of END FROM (SELECT c_name, c_custkey, (SELECT min(x) FROM (SELECT 'c' || (c_custkey // 3 * 3) AS x UNION ALL SELECT 'c' || (c_custkey // 3 * 3 + 1) UNION ALL SELECT 'c' || (c_custkey // 3 * 3 + 2))) AS part_of FROM customer)""",
    "h_resolve_endpoints": "WITH t AS (SELECT o_orderkey AS triple_id, o_custkey AS c, o_orderkey % 50 AS p FROM orders WHERE o_orderkey % 4 <> 0) SELECT triple_id, 'c' || c AS src, 'p' || p AS dst FROM t JOIN customer ON c_custkey = c JOIN part ON p_partkey = p",
    "h_unresolved_endpoints": "SELECT o_orderkey AS triple_id, CASE WHEN o_orderkey % 4 = 0 THEN 'customer none' ELSE 'customer ' || o_custkey END AS subject FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = o_orderkey % 50 WHERE o_orderkey % 4 = 0 OR c_custkey IS NULL OR p_partkey IS NULL",
    "h_known_documents": f"WITH {_ALIASED}, r AS (SELECT node_id, docs FROM staged UNION ALL SELECT resolved.node_id, docs FROM resolved JOIN named ON named.node_id = t[1]) SELECT node_id, array_to_string(list_sort(list_distinct(flatten(list(docs)))), '|') AS docs FROM r GROUP BY node_id",
    "h_mark_cross_paper": f"WITH {sql.NODES}, {sql.EDGES} SELECT relation, coalesce(len(list_distinct(s.docs || d.docs)) > 1, false) AS cross_paper, count(*) AS edges FROM edges LEFT JOIN named s ON s.node_id = src LEFT JOIN named d ON d.node_id = dst GROUP BY ALL",
    "h_check_edges": f"WITH {sql.EDGES} SELECT CASE WHEN line = 6 THEN 'doc_id' WHEN line = 7 THEN 'times_seen' WHEN line = 5 THEN 'confidence' END AS broken, count(*) AS edges FROM edges GROUP BY 1",
    "h_edge_attributes": f"WITH {sql.EDGES} SELECT doc_id, line, src, 'llm' AS method, section, relation FROM edges",
    "f_deprecate_edges": f"WITH {sql.EDGES} SELECT version, count(*) AS edges, CAST(sum(CASE WHEN version <> 'v2' AND CAST(doc_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS deprecated FROM edges GROUP BY version",
    "i_match_exact": f"""WITH {_NAMED}, m AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'PART ' || c_custkey ELSE 'ring' END AS mention FROM customer),
        met AS (SELECT DISTINCT mention, node_id, name, times_seen FROM m JOIN lows ON lower(mention) = low) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY times_seen DESC, name, node_id) AS k FROM met) WHERE k <= 5""",
    "i_match_contains": f"""WITH {_NAMED}, m AS (SELECT DISTINCT 'green ' || lower(substr(n_name, 1, 3)) AS mention FROM nation), terms AS (SELECT DISTINCT mention, unnest(list_append(list_filter(regexp_extract_all(lower(mention), '[a-z0-9]+'), lambda w: length(w) > 2), lower(mention))) AS term FROM m),
        met AS (SELECT mention, node_id, name, times_seen, max(CAST(low = lower(mention) AS INT)) AS exact FROM lows JOIN terms ON contains(low, term) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY exact DESC, times_seen DESC, name, node_id) AS k FROM met) WHERE k <= 5""",
    "i_top_nodes": f"WITH {sql.NODES} SELECT node_id, name, times_seen FROM named ORDER BY times_seen DESC, name, node_id LIMIT 100",
    "i_contains_customers": f"""WITH {_NAMED}, m AS (SELECT c_name AS mention FROM customer UNION SELECT 'number ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer), terms AS (SELECT DISTINCT mention, unnest(list_append(list_filter(regexp_extract_all(lower(mention), '[a-z0-9]+'), lambda w: length(w) > 2), lower(mention))) AS term FROM m),
        met AS (SELECT mention, node_id, name, times_seen, max(CAST(low = lower(mention) AS INT)) AS exact FROM lows JOIN terms ON contains(low, term) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY exact DESC, times_seen DESC, name, node_id) AS k FROM met) WHERE k <= 5""",
    "i_long_paths": f"""WITH RECURSIVE {sql.EDGES}, e AS (SELECT DISTINCT src, dst, src || '|' || dst || '|' || relation || '|' || doc_id || '|' || version AS edge_id FROM edges WHERE relation = 'uses' AND confidence >= 1.0),
        steps AS (SELECT src AS a, dst AS b, edge_id FROM e UNION ALL SELECT dst, src, edge_id FROM e WHERE src <> dst), q AS (SELECT 's' || s_suppkey AS start, 's' || (s_suppkey + 1) AS goal FROM supplier),
        walk AS (SELECT start, goal, b AS here, [edge_id] AS hops FROM q JOIN steps ON a = start UNION ALL SELECT start, goal, b, list_append(hops, edge_id) FROM walk JOIN steps ON a = here WHERE len(hops) < 4 AND NOT list_contains(hops, edge_id))
        SELECT start, goal, array_to_string(hops, ',') AS signature, CAST(len(hops) AS INTEGER) AS n_hops FROM walk WHERE here = goal""",
    "i_find_paths": f"WITH {_PATHS} SELECT start, goal, signature FROM paths",
    "i_rank_paths": f"WITH {_PATHS} SELECT start, goal, signature, score, n_hops, conflicting, k FROM ranked",
    "i_neighbours": f"WITH {_EDGE_TABLE}, {_ASKED}, r AS (SELECT a AS node_id, b AS other, edge_id, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, created_at DESC, edge_id) AS k FROM steps WHERE confidence >= 0.9) SELECT * FROM r SEMI JOIN asked USING (node_id) WHERE k <= 12",
    "i_document_edges": f"WITH {_EDGE_TABLE}, r AS (SELECT doc_id, a AS node_id, b AS other, edge_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, created_at DESC, edge_id, a) AS k FROM steps WHERE confidence >= 0.9) SELECT * FROM r WHERE k <= 6 AND doc_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice > 300000)",
    "i_fallback_neighbours": f"WITH {_EDGE_TABLE}, {_ASKED}, low_steps AS (SELECT * REPLACE (round(confidence - CASE WHEN src < 's5' THEN 0.3 ELSE 0 END, 2) AS confidence) FROM steps), {_FALLBACK.format(steps='low_steps')} SELECT question_id, edge_id, confidence, k FROM fallback",
    "i_summary_neighbours": f"WITH {_SUMMARY.format(asked=_ASKED.replace('s_suppkey AS question_id', 's_suppkey // 5 AS question_id'))} SELECT question_id, edge_id, n FROM summary",
    "i_summary_documents": f"""WITH {_EDGE_TABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, created_at DESC, edge_id, a) AS k FROM steps WHERE confidence >= 0.45),
        g AS (SELECT CAST(doc_id AS BIGINT) % 500 AS question_id, edge_id, max(confidence) AS confidence, max(created_at) AS created_at FROM r WHERE k <= 24 GROUP BY ALL) SELECT question_id, edge_id, n FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, created_at DESC, edge_id) AS n FROM g) WHERE n <= 12""",
    "i_classify_intent": f"""WITH {_QUESTIONS}, d AS (SELECT *, {_named_documents()} AS raw, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.-]{{2,}}'), lambda w: regexp_matches(lower(w), '^(paper|doc|document)')) AS words FROM q),
        t AS (SELECT *, list_filter(list_transform(CASE WHEN len(raw) > 0 THEN raw ELSE words END, lambda x: trim(x, ' ''".,;')), lambda x: x <> '') AS l FROM d), u AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS docs FROM t),
        k AS (SELECT question_id, docs, CASE WHEN {_share(*_I['paper'])} >= 0.33 AND len(docs) > 0 THEN 'paper_summary' WHEN {_share(*_I['cluster'])} >= 0.5 THEN 'cluster_summary' WHEN {_share(*_I['entity'])} >= 0.25 THEN 'entity_summary' ELSE 'factoid' END AS intent FROM u)
        SELECT question_id, intent, CASE WHEN intent = 'paper_summary' THEN array_to_string(docs, '|') ELSE '' END AS documents FROM k""",
    "i_question_mentions": f"WITH {_QUESTIONS}, w AS (SELECT question_id, list_filter(regexp_extract_all(text, '[A-Z][A-Za-z0-9]+'), lambda w: lower(w) NOT IN {config.WH_WORDS}) AS l FROM q), r AS (SELECT question_id, l[p] AS mention, p - 1 AS pos FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM w)) SELECT question_id, arg_min(mention, pos) AS mention, min(pos) AS pos FROM r GROUP BY question_id, lower(mention)",
    "i_answer_table": f"""WITH {_PATHS}, {_ASKED}, {_FALLBACK.format(steps='steps')}, p AS (SELECT CAST(substr(start, 2) AS BIGINT) AS question_id, count(*) AS n, bool_or(conflicting) AS c, arg_min(signature, k) AS best FROM ranked GROUP BY 1), f AS (SELECT question_id, count(*) AS m FROM fallback GROUP BY 1)
        SELECT question_id, CASE WHEN n IS NULL THEN 'insufficient' WHEN c THEN 'conflicting' ELSE 'direct' END AS mode, CASE WHEN n IS NOT NULL THEN n || ' paths, best by edges ' || best WHEN m IS NOT NULL THEN 'no path; ' || m || ' related findings' ELSE 'no evidence' END AS summary FROM asked LEFT JOIN p USING (question_id) LEFT JOIN f USING (question_id)""",
    "i_answers": f"""WITH {_SUMMARY.format(asked=_ASKED)}, {_FALLBACK.format(steps='steps')}, pr AS (SELECT question_id, src || ' ' || relation || ' ' || dst || ' (doc ' || doc_id || ', conf=' || printf('%.2f', confidence) || ')' AS t, relation = 'improves' AS x, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, created_at DESC, edge_id) AS pk FROM steps JOIN asked ON node_id = a WHERE confidence >= 0.97 AND question_id % 10 <> 3),
        p AS (SELECT question_id, max(t) FILTER (pk = 1) AS path, bool_or(x) AS x FROM pr WHERE pk <= 2 GROUP BY 1), f AS (SELECT question_id, string_agg(split_part(edge_id, '|', 1) || ' ' || split_part(edge_id, '|', 3) || ' ' || split_part(edge_id, '|', 2) || ' (doc ' || split_part(edge_id, '|', 4) || ', conf=' || printf('%.2f', confidence) || ')', '; ' ORDER BY k) AS near FROM fallback GROUP BY 1), s AS (SELECT question_id, count(*) AS n FROM summary GROUP BY 1),
        j AS (SELECT question_id, question_id % 5 AS i, s_name AS name, 'Insufficient evidence from graph relations. Known entity profiles: ' || s_name || ' (similarity 1.00, seen ' || (s_suppkey % 7 + 1) || 'x, sections: unknown sections).' AS profile, path, x, near, n FROM asked JOIN supplier ON s_suppkey = question_id LEFT JOIN p USING (question_id) LEFT JOIN f USING (question_id) LEFT JOIN s USING (question_id))
        SELECT question_id, CASE WHEN i < 3 THEN CASE WHEN n > 0 THEN 'direct' ELSE 'insufficient' END WHEN i = 4 OR path IS NULL THEN 'insufficient' WHEN x THEN 'conflicting' ELSE 'direct' END AS mode,
        CASE WHEN i = 0 THEN coalesce('Summary for documents ' || question_id || ', b derived from ' || n || ' graph findings.', 'No extracted findings available for documents: ' || question_id || ', b.') WHEN i = 1 THEN coalesce('Summary for ' || name || ' derived from ' || n || ' graph findings.', profile) WHEN i = 2 THEN coalesce('Cluster summary for ' || name || ' derived from ' || n || ' graph findings.', profile)
        WHEN i = 4 THEN 'Unable to resolve any entities for the question.' ELSE coalesce(path, 'Insufficient evidence to answer. Related findings: ' || near, profile) END AS summary FROM j""",
    "i_answer_context": f"WITH {_SUMMARY.format(asked=_ASKED)} SELECT question_id, array_to_string(list_sort(list(DISTINCT doc_id)), '|') AS documents, string_agg(n || '. ' || src || ' ' || relation || ' ' || dst || ' [' || doc_id || ']', chr(10) ORDER BY n) AS prompt FROM summary GROUP BY question_id",
    "i_ask": f"""WITH {_PATHS}, n AS (SELECT count(*) AS n, min(s_suppkey) AS least FROM supplier), qk AS (SELECT conv_id AS question_id, conv_id % n + least AS key, text FROM conversations, n WHERE turn = 0),
        qq AS (SELECT question_id, key, lower(substr(text, 1, 20)) || ' How do S' || key || ' and C' || key || ' fit?' AS text FROM qk),
        tp AS (SELECT question_id, r.k, unnest(string_split(signature, ',')) AS edge_id, unnest(range(len(string_split(signature, ',')))) AS i, r.conflicting FROM qq JOIN ranked r ON start = 's' || key AND goal = 'c' || key),
        asked AS (SELECT question_id, unnest(['s' || key, 'c' || key]) AS node_id FROM qq WHERE question_id NOT IN (SELECT question_id FROM tp)), {_FALLBACK.format(steps='steps')},
        said AS (SELECT edge_id, doc_id, upper(src) || ' ' || relation || ' ' || upper(dst) AS core, format('{{:.2f}}', confidence) AS conf, evidence, verbatim FROM merged),
        shown AS (SELECT question_id, 0 AS part, k, i, doc_id, 'path ' || k || '.' || (i + 1) || ' ' || core || ' [' || evidence || '] (' || conf || '): ' || verbatim AS line, core || ' (doc ' || doc_id || ', conf=' || conf || ')' AS finding FROM tp JOIN said USING (edge_id)
                  UNION ALL SELECT question_id, 1, k, 0, doc_id, 'near ' || k || ' ' || core || ' [' || evidence || '] (' || conf || '): ' || verbatim, core || ' (doc ' || doc_id || ', conf=' || conf || ')' FROM fallback JOIN said USING (edge_id)),
        g AS (SELECT question_id, string_agg(line, chr(10) ORDER BY part, k, i) AS lines, array_to_string(list_sort(list_distinct(list(doc_id))), '|') AS documents, string_agg(finding, '; ' ORDER BY i) FILTER (part = 0 AND k = 1) AS path, string_agg(finding, '; ' ORDER BY k) FILTER (part = 1) AS near FROM shown GROUP BY question_id),
        c AS (SELECT question_id, bool_or(conflicting) AS conflict FROM tp GROUP BY question_id), o AS (SELECT qq.*, lines, documents, path, near, conflict, ' (similarity 1.00, seen ' || (key % 7 + 1) || 'x, sections: ' || CASE WHEN (key % 7 + 1) % 2 = 0 THEN 'Results' ELSE 'Methods' END || ')' AS profile FROM qq LEFT JOIN g USING (question_id) LEFT JOIN c USING (question_id))
        SELECT question_id, 'factoid' AS intent, CASE WHEN path IS NULL THEN 'insufficient' WHEN conflict THEN 'conflicting' ELSE 'direct' END AS mode, coalesce(path, 'Insufficient evidence to answer. Related findings: ' || near, 'Insufficient evidence from graph relations. Known entity profiles: S' || key || profile || '; C' || key || profile || '.') AS summary,
        coalesce(documents, '') AS documents, 'Question: ' || text || chr(10) || coalesce(lines, 'no evidence') AS prompt FROM o""",
    "i_citation_check": "SELECT o_orderkey AS question_id, 2 AS cited, CASE WHEN o_orderkey % 5 = o_custkey % 5 THEN 1 ELSE 0 END AS valid FROM orders",
    "j_graph_view": f"WITH {_EDGE_TABLE} SELECT edge_id, row_number() OVER (ORDER BY confidence DESC, created_at DESC, edge_id) AS k FROM merged WHERE confidence >= 0.95 AND relation IN ('uses', 'improves') AND section = 'Results' ORDER BY k LIMIT 500",
    "j_accessible_view": f"""WITH {_EDGE_TABLE}, {sql.NODES}, r AS (SELECT node_id FROM named WHERE times_seen = 2), v AS (SELECT * FROM merged WHERE confidence >= 0.95 AND section = 'Methods' AND (CAST(doc_id AS BIGINT) % 10 = 0 OR CAST(doc_id AS BIGINT) % 15 = 3)), p AS (SELECT *, src IN (SELECT node_id FROM r) OR dst IN (SELECT node_id FROM r) AS ok FROM v)
        SELECT edge_id, row_number() OVER (ORDER BY confidence DESC, created_at DESC, edge_id) AS k FROM p WHERE ok OR NOT (SELECT coalesce(bool_or(ok), false) FROM p) ORDER BY k LIMIT 500""",
    "j_view_nodes": f"WITH {_EDGE_TABLE}, {sql.NODES}, v AS (SELECT src, dst FROM merged WHERE confidence >= 0.98 ORDER BY confidence DESC, created_at DESC, edge_id LIMIT 500) SELECT node_id, name FROM named WHERE node_id IN (SELECT src FROM v UNION SELECT dst FROM v)",
    "j_node_importance": f"""WITH {_EDGE_TABLE}, {sql.NODES}, d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM merged UNION ALL SELECT dst FROM merged) GROUP BY 1), i AS (SELECT n.node_id, type, times_seen, coalesce(degree, 0) AS degree, times_seen + 2.5 * coalesce(degree, 0) AS raw FROM named n LEFT JOIN d USING (node_id)),
        r AS (SELECT *, raw / max(raw) OVER () AS importance, row_number() OVER (ORDER BY raw DESC, node_id) AS k FROM i) SELECT node_id, degree, round(importance, 9) AS importance, CASE WHEN k <= 3 THEN 0 WHEN type = 'supplier' THEN 1 WHEN type = 'part' THEN 2 WHEN times_seen % 2 > times_seen % 3 THEN 3 ELSE 4 END AS ring FROM r""",
    "j_partition_by_document": f"WITH {_EDGE_TABLE}, {sql.NODES}, p AS (SELECT list_intersect(s.docs, d.docs) AS shared FROM merged JOIN named s ON s.node_id = src JOIN named d ON d.node_id = dst) SELECT part, count(*) AS edges FROM (SELECT unnest(CASE WHEN len(shared) = 0 THEN ['unattributed'] ELSE list_distinct(shared) END) AS part FROM p) GROUP BY part",
    "j_partition_nodes": f"WITH {_EDGE_TABLE}, {sql.NODES}, p AS (SELECT src, dst FROM merged JOIN named s ON s.node_id = src JOIN named d ON d.node_id = dst WHERE len(list_intersect(s.docs, d.docs)) = 0), a AS (SELECT node_id, unnest(docs) AS part FROM named UNION SELECT src, 'unattributed' FROM p UNION SELECT dst, 'unattributed' FROM p) SELECT part, count(*) AS nodes FROM a GROUP BY part",
    "j_node_focus": f"WITH {_EDGE_TABLE} SELECT * FROM (SELECT a AS node_id, b AS other, edge_id, row_number() OVER (PARTITION BY a ORDER BY times_seen DESC, edge_id) AS k FROM steps) WHERE k <= 6",
    "j_accessible_papers": "SELECT CAST(doc_id AS VARCHAR) AS paper_id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 15 = 3 OR doc_id % 4 = 3",
}
