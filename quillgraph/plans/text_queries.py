"""Queries over text: elements, metadata, routing, sentences, co-mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.operators import comention, elements, routing
from quillgraph.plans import sql
from quillgraph.sources import tables

TERMS = ("the", "der", "que", "les")


def _elements(spark, sf):
    return elements.build_elements(elements.clean_items(tables.text_items(spark, sf)))


def clean_items(spark, sf):
    return elements.clean_items(tables.text_items(spark, sf))


def build_elements(spark, sf):
    return _elements(spark, sf).drop("pos")


def sections_exact(spark, sf):
    """Headings drawn from the alias list, so that exact hits and misses both occur."""
    names = F.array(*[F.lit(n) for n in ("Intro", "findings", "Conclusion", "Methods", "Zzz 0")])
    rows = tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.get(names, (F.col("doc_id") % 5).cast("int")).alias("section"))
    return elements.normalise_sections(rows)


def paper_titles(spark, sf):
    return elements.paper_titles(tables.text_items(spark, sf))


def paper_years(spark, sf):
    items = tables.text_items(spark, sf).withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("20"), (F.length("text") % 40).cast("string"))))
    return elements.paper_years(items)


def paper_venues(spark, sf):
    return elements.paper_venues(tables.text_items(spark, sf), ("Est", "Ing", "Der ", "La "))


def paper_dois(spark, sf):
    items = tables.text_items(spark, sf).withColumn("text", F.when(F.col("pos") % 3 == 1, F.concat(F.lit("see 10."), (1000 + F.col("pos")).cast("string"), F.lit("/x"), F.col("doc_id"), F.lit(" now"))).otherwise(F.col("text")))
    return elements.paper_dois(items)


def validate_contracts(spark, sf):
    rows = _elements(spark, sf).select("element_id", "doc_id", "section", "content", "start_char", F.when(F.length("content") % 7 == 0, F.col("start_char")).otherwise(F.col("end_char")).alias("end_char"), F.when(F.length("content") % 5 == 0, F.upper("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    return elements.validate_contracts(rows, elements.element_rules()).select("element_id", "broken")


def validate_nodes(spark, sf):
    key = F.col("c_custkey")
    rows = tables.read(spark, sf, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("node_id"), F.col("c_name").alias("name"), F.when(key % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("type"), (key % 10 - 1).alias("times_seen"))
    return elements.validate_contracts(rows, elements.node_rules()).select("node_id", "broken")


def validate_papers(spark, sf):
    rows = tables.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 400 + 1800).alias("year"))
    return elements.validate_contracts(rows, elements.paper_rules()).select("doc_id", "broken")


def validate_triples(spark, sf):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = tables.read(spark, sf, "orders").select(
        order.cast("string").alias("doc_id"), customer.cast("string").alias("element_id"), F.when(order % 11 == 0, "").otherwise(F.concat(F.lit("o"), order.cast("string"))).alias("src_text"), F.lit("uses").alias("relation"), F.concat(F.lit("c"), customer.cast("string")).alias("dst_text"),
        (customer % 12 / 10).alias("confidence"), (customer % 30 - 1).alias("span_start"), (order % 60).alias("span_end"), F.lit("v1").alias("version"),
    )
    return elements.validate_contracts(rows, elements.triple_rules()).select("doc_id", "broken")


def validate_edges(spark, sf):
    rows = tables.graph_edges(spark, sf).withColumns({"element_id": F.col("line").cast("string"), "span_start": F.col("line") - 1, "span_end": F.col("line") % 5})
    return elements.validate_contracts(rows, elements.edge_rules()).groupBy("broken").agg(F.count("*").alias("n"))


def route_domain(spark, sf):
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("venue"), F.col("text").alias("content"))
    return routing.route_domain(d, (("a", 2, ("tion", "src1")), ("b", 1, ("ung", "est")), ("c", 1, ("ción", "src2"))))


def vocabulary_density(spark, sf):
    return routing.vocabulary_density(_elements(spark, sf), TERMS)


def candidate_mentions(spark, sf):
    return routing.candidate_mentions(_elements(spark, sf), ("tion", "ich"))


def abbreviation_pairs(spark, sf):
    """Texts built around part names with abbreviations that have digits and hyphens, and long forms of all lengths."""
    short = F.get(F.array(*[F.lit(x) for x in ("IL-6", "HER2", "p53", "NNM", "x")]), (F.col("p_partkey") % 5).cast("int"))
    long = F.concat(F.lit("type-2 "), F.repeat(F.concat(F.col("p_name"), F.lit(" ")), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("unit"))
    p = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("element_id"), F.concat(F.lit("1. "), long, F.lit(" ("), short, F.lit("), and so (see 3.2) on.")).alias("content"))
    return routing.abbreviation_pairs(p)


def inventory(spark, sf):
    """Annotations of parts: an entity, a noun phrase said twice, one said once, a pronoun, a lone letter, a word that isn't there."""
    parts = tables.dealt(tables.read(spark, sf, "part").select(F.col("p_partkey").alias("element_id"), "p_name", "p_type"), "element_id")
    p = parts.select("element_id", F.concat(F.lit("so "), F.lower("p_name"), F.lit(" of "), F.lower("p_type"), F.lit("; beta-cell unit (BCU), it is in z")).alias("content"))
    rows = F.array(*[F.struct(F.lit(m).alias("mention"), F.lit(k).alias("kind")) for m, k in (("so", "proper"), ("is in", "noun"), ("IS in", "noun"), ("of", "noun"), ("it", "entity"), ("z", "entity"), ("quite absent", "entity"), (" unit ", "entity"))])
    spans = parts.select("element_id", F.explode(rows).alias("r")).select("element_id", "r.*")
    return routing.candidate_mentions(p, ("beta",), spans=spans, specialised=True)


def limit_mentions(spark, sf):
    rows = _elements(spark, sf).select("element_id", F.split("content", " ").alias("mentions"))
    return routing.limit_mentions(rows).select("element_id", F.concat_ws("|", "mentions").alias("mentions"))


def sentences(spark, sf):
    return comention.sentences(_elements(spark, sf)).drop("section")


def _mentions(spark, sf):
    return _elements(spark, sf).select("element_id", F.explode(F.slice(F.array_distinct(tables.capitalised(F.col("content"))), 1, config.MAX_MENTIONS)).alias("mention"))


def _occurrences(spark, sf):
    return comention.mention_occurrences(comention.sentences(_elements(spark, sf)), _mentions(spark, sf))


def mention_occurrences(spark, sf):
    return _occurrences(spark, sf).select("element_id", "sent_no", "mention", "at")


def comention_pairs(spark, sf):
    return comention.comention_pairs(_occurrences(spark, sf)).select("element_id", "sent_no", "a", "b", "a_at", "b_at", "pair_no")


def comention_edges(spark, sf):
    return comention.comention_edges(comention.comention_pairs(_occurrences(spark, sf))).select("doc_id", "a", "b", "relation", "confidence", "times_seen", F.col("evidence.element_id").alias("element_id"), F.col("evidence.sentence").alias("sentence"), F.concat_ws("|", "sections").alias("sections"), F.col("attributes")["method"].alias("method"), F.col("attributes")["hidden"].alias("hidden"))


_OCC = sql.SENTENCES + f""",
mentions AS (SELECT element_id, m.mention FROM elements, LATERAL (SELECT unnest(c.l) AS mention FROM (SELECT list_filter(d, lambda x, i: i <= {config.MAX_MENTIONS}) AS l FROM (SELECT list_filter(q, lambda x, i: list_position(q, x) = i) AS d FROM (SELECT {sql.caps("content")} AS q))) c) m),
parts AS (SELECT s.*, mention, string_split(lower(sentence), lower(mention)) AS parts FROM sents s JOIN mentions USING (element_id) WHERE contains(lower(sentence), lower(mention))),
occ AS (SELECT doc_id, element_id, section, sent_no, sentence, mention, CAST(start + list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(mention) AS BIGINT) AS at FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM parts)),
met AS (SELECT a.doc_id, a.element_id, a.section, a.sent_no, a.sentence, a.mention AS a, b.mention AS b, a.at AS a_at, b.at AS b_at FROM occ a JOIN occ b ON a.element_id = b.element_id AND a.sent_no = b.sent_no AND lower(a.mention) < lower(b.mention) AND abs(a.at - b.at) <= 200),
firsts AS (SELECT *, min((least(a_at, b_at), greatest(a_at, b_at))) OVER (PARTITION BY element_id, a, b) AS f FROM met),
pairs AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY element_id ORDER BY f, a, b) AS pair_no FROM firsts) WHERE pair_no <= 10)"""

QUERIES = {f"b_{f.__name__}": f for f in (clean_items, build_elements, sections_exact, paper_titles, paper_years, paper_venues, paper_dois, validate_contracts, validate_nodes, validate_papers, validate_triples, validate_edges)}
QUERIES |= {f"c_{f.__name__}": f for f in (route_domain, vocabulary_density, candidate_mentions, inventory, abbreviation_pairs, limit_mentions)}
QUERIES |= {f"e_{f.__name__}": f for f in (sentences, mention_occurrences, comention_pairs, comention_edges)}

_ROUTE = "(3 * ({t}) + 4 * ({v}) + 2 * ({c}))"


def _score(*keys: str) -> str:
    hits = {n: " + ".join(f"CAST(contains(lower({col}), '{k}') AS INT)" for k in keys) for n, col in (("t", "title"), ("v", "venue"), ("c", "content"))}
    return _ROUTE.format(**hits)


ORACLES = {
    "b_clean_items": f"WITH {sql.ITEMS} SELECT doc_id, pos, label, page, text FROM items",
    "b_build_elements": f"WITH {sql.ELEMENTS} SELECT doc_id, element_id, section, content, content_hash, start_char, end_char FROM elements",
    "b_sections_exact": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, ['Introduction', 'Results', 'Conclusion', 'Methods', '_auto_'][doc_id % 5 + 1] AS section FROM documents",
    "b_paper_titles": f"WITH {sql.ITEMS} SELECT doc_id, arg_min(text, pos) AS title FROM items WHERE label = 'section_header' AND lower(trim(text)) <> 'abstract' GROUP BY doc_id",
    "b_paper_years": f"WITH {sql.ITEMS}, y AS (SELECT doc_id, pos, TRY_CAST(regexp_extract(text || ' 20' || CAST(length(text) % 40 AS VARCHAR), '20[1-2][0-9]') AS INT) AS year FROM items) SELECT doc_id, arg_min(year, pos) AS year FROM y WHERE year BETWEEN 2015 AND 2025 GROUP BY doc_id",
    "b_paper_venues": f"WITH {sql.ITEMS}, v AS (SELECT unnest(['Est', 'Ing', 'Der ', 'La ']) AS venue, unnest([0, 1, 2, 3]) AS rank) SELECT doc_id, arg_min(venue, (pos, rank)) AS venue FROM items JOIN v ON contains(text, venue) GROUP BY doc_id",
    "b_paper_dois": f"WITH {sql.ITEMS}, d AS (SELECT doc_id, pos, regexp_extract(CASE WHEN pos % 3 = 1 THEN 'see 10.' || (1000 + pos) || '/x' || doc_id || ' now' ELSE text END, '10\\.[0-9]{{4,}}/[^ ]+') AS doi FROM items) SELECT doc_id, arg_min(doi, pos) AS doi FROM d WHERE doi <> '' GROUP BY doc_id",
    "b_validate_contracts": f"WITH {sql.ELEMENTS} SELECT element_id, CASE WHEN trim(doc_id) = '' THEN 'doc_id' WHEN length(content) % 5 = 0 AND regexp_matches(content_hash, '[a-f]') THEN 'content_hash' WHEN start_char < 0 THEN 'start_char' WHEN length(content) % 7 = 0 THEN 'end_char' END AS broken FROM elements",
    "b_validate_nodes": "SELECT 'c' || c_custkey AS node_id, CASE WHEN c_custkey % 7 = 0 THEN 'type' WHEN c_custkey % 10 = 0 THEN 'times_seen' END AS broken FROM customer",
    "b_validate_papers": "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 400 NOT BETWEEN 100 AND 300 THEN 'year' END AS broken FROM part",
    "b_validate_triples": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'src_text' WHEN o_custkey % 12 > 10 THEN 'confidence' WHEN o_custkey % 30 = 0 THEN 'span_start' WHEN o_orderkey % 60 <= o_custkey % 30 - 1 THEN 'span_end' END AS broken FROM orders",
    "b_validate_edges": "SELECT CASE WHEN l_linenumber % 5 <= l_linenumber - 1 THEN 'span_end' WHEN l_shipdate IS NULL THEN 'created_at' END AS broken, count(*) * 2 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "c_route_domain": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(text, 1, 60) AS title, source AS venue, text AS content FROM documents),
        s AS (SELECT doc_id, {_score("tion", "src1")} AS score, 2 AS p, 0 AS r, 'a' AS domain FROM d UNION ALL SELECT doc_id, {_score("ung", "est")}, 1, 1, 'b' FROM d UNION ALL SELECT doc_id, {_score("ción", "src2")}, 1, 2, 'c' FROM d)
        SELECT doc_id, domain, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p, r) = 1""",
    "c_vocabulary_density": f"WITH {sql.ELEMENTS}, w AS (SELECT element_id, regexp_extract_all(lower(content), '[a-z]+') AS l FROM elements), n AS (SELECT element_id, len(l) AS n_words, len(list_filter(l, lambda x: x IN {TERMS})) AS n_terms FROM w) SELECT element_id, n_words, n_terms, CASE WHEN n_words > 0 AND n_terms / n_words >= 0.2 THEN 'specialised' ELSE 'general' END AS profile FROM n",
    "c_candidate_mentions": f"""WITH {sql.ELEMENTS}, src AS (
        SELECT element_id, content, v AS mention, 3 AS score FROM elements, (SELECT unnest(['tion', 'ich']) AS v) WHERE contains(lower(content), v) UNION ALL
        SELECT element_id, content, m, CASE WHEN regexp_full_match(m, '[A-Z]{{2,}}') THEN 2 ELSE 1 END FROM (SELECT element_id, content, unnest(regexp_extract_all(content, '[A-Z][A-Za-z]+')) AS m FROM elements) WHERE m NOT IN {sql.STOPS} AND lower(m) NOT IN {config.MENTION_STOP_WORDS + config.PRONOUNS}),
        placed AS (SELECT element_id, mention, score, CASE WHEN contains(content, mention) THEN instr(content, mention) ELSE instr(lower(content), lower(mention)) END - 1 AS first_at, NOT contains(content, mention) AS other_case FROM src WHERE length(mention) > 1),
        best AS (SELECT element_id, min((-score, first_at, other_case, mention)) AS b FROM placed WHERE first_at >= 0 GROUP BY element_id, lower(mention))
        SELECT element_id, b[4] AS mention, -b[1] AS score, b[2] AS first_at FROM best QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY b[1], b[2], b[4]) <= {config.MAX_CANDIDATES}""",
    "c_abbreviation_pairs": "SELECT p_partkey AS element_id, 'type-2 ' || repeat(p_name || ' ', p_partkey % 4 + 1) || 'unit' AS long_form, ['IL-6', 'HER2', 'p53', 'NNM'][p_partkey % 5 + 1] AS abbreviation FROM part WHERE p_partkey % 5 < 4",
    "c_inventory": """WITH p AS (SELECT p_partkey AS element_id, 'so ' || lower(p_name) || ' of ' || lower(p_type) AS head FROM part), n AS (SELECT element_id, length(head) AS n, head || '; beta-cell unit (BCU), it is in z' AS c, head FROM p)
        SELECT element_id, m AS mention, score, CAST(CASE WHEN m = 'BCU' THEN n + 18 ELSE instr(c, m) - 1 END AS INTEGER) AS first_at FROM n, (VALUES ('beta', 3), ('unit', 3), ('is in', 2), ('beta-cell unit', 2), ('BCU', 2), ('so', 1)) AS v(m, score)""",
    "c_limit_mentions": f"WITH {sql.ELEMENTS} SELECT element_id, array_to_string(list_filter(list_transform(string_split(content, ' '), lambda x: trim(x)), lambda x: x <> '')[1:12], '|') AS mentions FROM elements",
    "e_sentences": f"WITH {sql.SENTENCES} SELECT doc_id, element_id, sent_no, sentence, start FROM sents",
    "e_mention_occurrences": f"WITH {_OCC} SELECT element_id, sent_no, mention, occ.\"at\" FROM occ",
    "e_comention_pairs": f"WITH {_OCC} SELECT element_id, sent_no, a, b, a_at, b_at, pair_no FROM pairs",
    "e_comention_edges": f"""WITH {_OCC}, g AS (SELECT doc_id, a, b, count(*) AS times_seen, arg_min((element_id, sentence), (element_id, sent_no, a_at, b_at)) AS ev, list_sort(list(DISTINCT section)) AS sections FROM pairs GROUP BY doc_id, a, b)
        SELECT doc_id, a, b, 'correlates-with' AS relation, 0.3::DOUBLE AS confidence, times_seen, ev[1] AS element_id, ev[2] AS sentence, array_to_string(sections, '|') AS sections, 'co-mention' AS method, 'true' AS hidden FROM g WHERE times_seen >= 2""",
}
