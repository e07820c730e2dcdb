
import random

from quillgraph.llm import linededup, pii, toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def test_lines_two_edits_apart_and_short_copies_go(spark):
    line = "a line of words that is long enough to be compared " * 10
    two = line[:100] + "#" + line[101:400] + "#" + line[401:]
    three = line[:50] + "%%%" + line[53:]
    texts = [f"{line}\nMenu\n\nHome", f"{two}\nHome\n\nMenu", f"Menu\n{three}\nhome"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in linededup.line_duplicates(docs).collect()}
    assert got == {0: [], 1: [0, 1, 3], 2: [0]}


def test_line_dedup_equals_brute_force_at_two_edits(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("eantxyz ") for _ in range(n)) + "." for n in (15, 30, 30, 45, 45, 60)]
    pool = ["short", "shorx", ""]
    for line in base:
        for _ in range(6):
            w = list(line)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(1, len(w) - 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "q"])
            pool.append("".join(w).strip())
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            if line:
                first.setdefault(line, (i, k))
    late = {a for a in first for b in first if first[b] < first[a] and edit_distance(a, b) <= min(2, min(len(a), len(b)) // 20)}
    want = {i: [k for k, line in enumerate(t.split("\n")) if line and (first[line] != (i, k) or line in late)] for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.removed_lines for r in linededup.line_duplicates(docs).collect()} == want


def test_pii_finds_every_wide_pattern_alone(spark):
    texts = {
        "write to joe (at) site.org": "email",
        "write to joe[at]site(dot)com": "email",
        "host fe:ab:cd:ef:aa:bb:cc:dd is down": "ip",
        "seen by Dr. Anna Weber": "name",
    }
    model = pii.Model({k: (9.0, *[0.0] * (len(pii.LABELERS) + 3)) for k in pii.KINDS}, {})
    for text, kind in texts.items():
        assert not any(c.isdigit() for c in text)
        assert [s[0] for s in pii.candidates(text, [])] == [kind]
        assert [s[0] for s in pii.find_pii(text, model)[1]] == [kind]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(pii.train(docs).weights) == {"email", "ip", "name"}


def test_shouting_counts_wherever_it_stands():
    calm, loud = "plain words go on " * 1000, "SHOUTED WORDS GO ON " * 1000
    shouting = toxicity.LEXICONS + 4
    assert toxicity.features(calm + loud, {})[shouting] == toxicity.features(loud + calm, {})[shouting] > 0.4
