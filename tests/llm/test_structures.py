"""Chat template, prefix trie and Merkle manifest: round trips, and results that don't depend on how rows are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, merkle, trie


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(5)
    pieces = [*chat.DEFAULT_TEMPLATE.controls(), "\\", "\\\\", " ", "\n", "x", "<", "[", "é", "$0"]
    rows = [("".join(rng.choices(pieces, k=rng.randint(0, 9))),) for _ in range(2000)]
    got = spark.createDataFrame(rows, "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    assert all(r.back == r.t for r in got)
    assert not [r for r in got for c in chat.DEFAULT_TEMPLATE.controls() if c in r.e]


def test_turn_order_and_loss_flags(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "user"), (2, 1, "user"), (2, 2, "assistant"), (3, 0, "assistant"), (4, 0, "user"), (5, 0, "user"), (5, 1, "assistant"), (5, 2, "system")]
    convs = spark.createDataFrame([(*r, f"text {i}") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(convs).collect()}
    assert {k: (r.valid, r.bad_turn, r.last_state) for k, r in got.items()} == {1: (True, None, "answered"), 2: (False, 1, "answered"), 3: (False, 0, "start"), 4: (False, None, "asked"), 5: (False, 2, "answered")}
    assert [s.text for s in got[2].segments if s.loss] == ["text 5"]
    masked = {r.conv_id: [s.text for s in r.segments if s.loss] for r in chat.format_conversations(convs, invalid="mask").collect()}
    assert masked == {1: ["text 2"], 2: [], 3: [], 4: [], 5: []}
    assert [r.conv_id for r in chat.format_conversations(convs, invalid="drop").collect()] == [1]


def test_another_template_is_read_back(spark):
    marks = {r: chat.RoleMarks(f"<|{r}|>\n", "<|end|>\n", loss=r == "assistant") for r in ("user", "assistant")}
    template = chat.Template(begin="<|begin|>", roles=marks, name_before="<|role|>", other=chat.RoleMarks("<|text|>", "<|end|>\n"))
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "<|end|>\n"), ("assistant", "<|user|>\n x \\"), ("tool|>", "<|text|>"), ("user", "")])]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    read = out.select(chat.read_turns(chat.formatted_text(F.col("segments")), template).alias("t"), chat.loss_text(F.col("segments")).alias("l")).first()
    assert [(t.role, t.text) for t in read.t] == [r[2:] for r in rows] and read.l == rows[1][3]


@pytest.mark.parametrize("bad", [dict(begin="x\\"), dict(name_before=""), dict(roles={"user": chat.RoleMarks("[A] ", " [B]"), "assistant": chat.RoleMarks("[A] x", " [B]")})])
def test_templates_that_cannot_be_read_back_are_refused(bad):
    with pytest.raises(ValueError):
        chat.Template(**bad)


def brute_trie(seqs):
    """Every prefix of every sequence, with sums over all pairs of prefixes."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = set()
    for p, m in members.items():
        subtree = [q for q in members if q[: len(p)] == p]
        childless = [q for q in subtree if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in subtree)]
        saved = sum((len(members[q]) - 1) * (len(q[-1].encode()) if q else 0) for q in subtree)
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        children = sum(len(x) == len(p) + 1 and x[: len(p)] == p for x in subtree)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, len(childless), saved, merkle.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [1, 3, 17])
def test_trie_of_any_partitioning(spark, width):
    rng = random.Random(width)
    seqs = {c: tuple(rng.choice(["a", "bé", ""]) for _ in range(rng.choice([1, 2, 3, 7]))) for c in range(90)}
    seqs |= {c: ("a", "a", "bé") for c in range(100, 140)}
    rows = [(c, i, "u", t) for c, s in seqs.items() for i, t in enumerate(s)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        keys = trie.turn_keys(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = [tuple(r) for r in trie.prefix_trie(keys, fan_in=2, piece=7).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == brute_trie(seqs)


def test_ranks(spark):
    rng = random.Random(2)
    for n in (0, 1, 500, 30_000):
        low = sorted(rng.sample(range(1 << 16), n))
        container = merkle._pack(merkle.np.array(low, dtype="int64"))
        assert len(container) <= 1 << 13 and merkle._members(container).tolist() == low
        asked = [0, 1, 63, 64, 4095, 65_535, *low[:50]]
        assert merkle.rank(container, asked).tolist() == [sum(x < a for x in low) for a in asked]


def test_manifest_of_any_block_size(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        doc = rng.choice([None, i, i, -i, i << 40, -(i << 20) - 7, 5])
        rows += [(doc, rng.choice([None, "", "a\nbé", f"x{i}\n"]), "en", rng.choice([None, "", "é", *map(str, range(12))]), i)] * rng.choice([1, 1, 3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    whole = sorted(map(str, merkle.manifest(docs).collect()))
    assert len(whole) == len(rows)
    for levels in (1, 3):
        assert sorted(map(str, merkle.manifest(docs, levels).collect())) == whole
    ids = [(r.source, r.doc_id) for r in docs.collect()]
    placed = merkle.place_leaves(merkle.leaves(docs)).collect()
    for s in {s for s, _ in ids}:
        mine = sorted((r for r in placed if r.source == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert [(r.doc_id is not None, r.doc_id or 0, r.leaf) for r in mine] == sorted((r.doc_id is not None, r.doc_id or 0, r.leaf) for r in mine)
