"""DuckDB twins of the operators that SQL can express; each is written from its contract, not from the operator."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a decimal number's characters, bit by bit: numbers from 0 on are xored in, -1 shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT)] || list_resize([CAST(-1 AS BIGINT)], 8, CAST(-1 AS BIGINT))))"
    step = "CASE WHEN o >= 0 THEN xor(a, o) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {steps}, lambda a, o: {step}), 4294967295)"


# Lengths of the default template's marks (begin; system, user, assistant; other) and its control strings.
_CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "</s>", "<s>", "[ROLE]", "[TEXT]", "[/TEXT]"]


def _escaped_chars(column: str) -> str:
    added = [rf"length({column}) - length(replace({column}, '\', ''))"]
    added += [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in _CONTROLS]
    return f"length({column}) + " + " + ".join(added)


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, row_number() OVER w - 1 AS pos, lag(role) OVER w AS before, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
-- Up to the first turn out of order the machine's state is the role before.
s AS (SELECT *, CASE WHEN role = 'system' THEN before IS NULL WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN role = 'assistant' THEN before = 'user' ELSE false END AS fits FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum({_escaped_chars('text')} + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 23 + {_escaped_chars('role')} END) AS BIGINT) AS formatted_chars,
       bool_and(coalesce(fits, false)) AND bool_or(is_last AND role = 'assistant') AS valid, CAST(min(pos) FILTER (WHERE NOT coalesce(fits, false)) AS INTEGER) AS bad_turn
FROM s GROUP BY conv_id
"""

TRIE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - ((c % 5) + 5) % 5 AS b, {_crc32('CAST(c AS VARCHAR)')} % 9 AS h, len FROM (SELECT c, count(*) AS len FROM t GROUP BY c)),
heads AS (SELECT i.c, i.h, i.b, least(i.h, coalesce(b.len, 0)) AS n FROM ids i LEFT JOIN ids b ON b.c = i.b),
rebuilt AS (SELECT h.c, t.k AS d, t.r, t.x FROM heads h JOIN t ON t.c = h.b AND t.k <= h.h UNION ALL SELECT h.c, h.n + t.k - h.h, t.r, t.x FROM heads h JOIN t ON t.c = h.c AND t.k > h.h),
paths AS (SELECT c, d, strlen(x) AS b, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM ids),
members AS (SELECT *, lag(p) OVER w AS up, lead(p) OVER w IS NULL AS is_end FROM paths WINDOW w AS (PARTITION BY c ORDER BY d)),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, any_value(b) AS b, any_value(up) AS up, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends FROM members GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY up),
counted AS (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (p)),
below AS (SELECT m.p, count(*) FILTER (WHERE q.kids = 0) AS leaves, sum((q.n - 1) * q.b) AS saved FROM counted q JOIN members m ON m.c = q.c AND m.d <= q.d GROUP BY m.p)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, u.c AS parent_conv_id, n.n AS n_convs, CAST(n.kids AS BIGINT) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM counted n JOIN below USING (p) LEFT JOIN nodes u ON u.p = n.up
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text])) + ")"


MERKLE = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '-')")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves),
tree AS (SELECT s, 0 AS lvl, slot, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM placed
         UNION ALL SELECT s, lvl + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY s, lvl, slot // 3, n),
subroots AS (SELECT s, h, lvl AS levels FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, s AS slot, h, count(*) OVER () AS n FROM subroots
        UNION ALL SELECT lvl + 1, slot // 3, sha256(string_agg(h, '' ORDER BY slot)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, slot // 3, n),
own AS (SELECT p.s, p.slot, t.lvl, t.slot AS pos, t.h, p.slot // CAST(pow(3, t.lvl) AS BIGINT) AS me FROM placed p JOIN tree t ON t.s = p.s AND t.n > 1 AND t.slot // 3 = p.slot // CAST(pow(3, t.lvl + 1) AS BIGINT)),
upper_part AS (SELECT r.s, t.lvl + r.levels AS lvl, t.slot AS pos, t.h, r.s // CAST(pow(3, t.lvl) AS BIGINT) AS me FROM subroots r JOIN top t ON t.n > 1 AND t.slot // 3 = r.s // CAST(pow(3, t.lvl + 1) AS BIGINT)),
every AS (SELECT * FROM own UNION ALL SELECT p.s, p.slot, u.lvl, u.pos, u.h, u.me FROM placed p JOIN upper_part u ON u.s = p.s),
steps AS (SELECT s, slot, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < me), '') AS pre, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > me), '') AS post FROM every GROUP BY s, slot, lvl),
folded AS (SELECT s, slot, 0 AS lvl, tampered AS h FROM placed UNION ALL SELECT f.s, f.slot, f.lvl + 1, sha256(pre || f.h || post) FROM folded f JOIN steps t ON t.s = f.s AND t.slot = f.slot AND t.lvl = f.lvl),
ends AS (SELECT s, slot, arg_max(h, lvl) AS folded_root FROM folded GROUP BY s, slot),
proofs AS (SELECT p.s, p.slot, sha256(coalesce(string_agg(pre || post, '' ORDER BY lvl), '')) AS proof_sha256 FROM placed p LEFT JOIN steps t ON t.s = p.s AND t.slot = p.slot GROUP BY p.s, p.slot)
SELECT doc_id, source, leaf, r.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots r USING (s) JOIN ends USING (s, slot) JOIN proofs USING (s, slot), (SELECT h AS root FROM top WHERE n = 1)
"""

ORACLES = {"op11_chat_formatting": CHAT, "op12_conversation_trie": TRIE, "op13_merkle_manifest": MERKLE}
