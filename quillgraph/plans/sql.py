"""DuckDB fragments that the oracle queries share; they mirror quillgraph.sources.tables."""

ITEMS = """
arr AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
items AS (SELECT doc_id, p - 1 AS pos, CASE WHEN (p - 1) % 5 = 0 THEN 'section_header' ELSE 'text' END AS label, (p - 1) // 20 + 1 AS page, l[p] AS text
          FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM arr))"""

ELEMENTS = ITEMS + """,
marked AS (SELECT *, coalesce(last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '_auto_') AS section FROM items),
elements AS (SELECT doc_id, doc_id || ':' || CAST(row_number() OVER w - 1 AS VARCHAR) AS element_id, section, text AS content, sha256(text) AS content_hash,
             CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start_char, CAST(sum(length(text)) OVER w AS BIGINT) AS end_char, pos
             FROM marked WHERE label = 'text' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""

SENTENCES = ELEMENTS + """,
pieces AS (SELECT doc_id, element_id, section, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT *, regexp_extract_all(content, '[.!?]*[^.!?]+[.!?]?') AS l FROM elements)),
sents AS (SELECT doc_id, element_id, section, k - 1 AS sent_no, trim(regexp_replace(l[k], '^[.!?]+', '')) AS sentence,
          CAST(list_sum(list_transform(l[1:k], lambda x: length(x))) - length(ltrim(regexp_replace(l[k], '^[.!?]+', ''))) AS BIGINT) AS start FROM pieces
          WHERE trim(regexp_replace(l[k], '^[.!?]+', '')) <> '')"""

NODES = """
nodes AS (SELECT 's' || s_suppkey AS node_id, s_name AS name, 'supplier' AS type, s_suppkey AS k FROM supplier UNION ALL
          SELECT 'p' || p_partkey, p_name, 'part', p_partkey FROM part UNION ALL
          SELECT 'c' || c_custkey, c_name, 'customer', c_custkey FROM customer UNION ALL
          SELECT 'n' || n_nationkey, n_name, 'nation', n_nationkey FROM nation),
named AS (SELECT node_id, name, type, [name, type || ' ' || k] AS aliases, k % 7 + 1 AS times_seen, [CAST(k % 10 AS VARCHAR), CAST(k % 3 AS VARCHAR)] AS docs FROM nodes)"""

EDGES = """
both_ends AS (SELECT l.*, 'p' || l_partkey AS part, unnest(['s' || l_suppkey, 'c' || o_custkey]) AS e FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT CASE WHEN l_linenumber % 5 = 0 THEN part ELSE e END AS src, CASE WHEN l_linenumber % 5 = 0 THEN e ELSE part END AS dst,
          CASE l_returnflag WHEN 'R' THEN 'uses' WHEN 'A' THEN 'improves' ELSE 'correlates-with' END AS relation, CAST(l_orderkey AS VARCHAR) AS doc_id,
          CASE WHEN l_linenumber % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, round(1 - l_discount, 2) AS confidence, l_shipdate AS created_at,
          CASE WHEN l_linestatus = 'O' THEN 'Results' ELSE 'Methods' END AS section, l_linenumber AS line FROM both_ends)"""

STOPS = "('The', 'This', 'That', 'These', 'And', 'With', 'From')"
CAPS = f"list_filter(regexp_extract_all({{}}, '[A-Z][a-z]{{{{3,}}}}'), lambda w: w NOT IN {STOPS})"


def caps(column: str) -> str:
    return CAPS.format(column)
