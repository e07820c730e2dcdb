"""Fuzzy spans by the sliding bound against comparing every window; the ladder's plan."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillgraph.functions import spans
from quillgraph.operators import extraction
from quillgraph.plans import extraction_queries


def every_window(text, target, threshold):
    if not text or not target:
        return None
    n, best, at = min(len(target), len(text)), 0.0, -1
    for i in range(len(text) - n + 1):
        ratio = SequenceMatcher(None, text[i : i + n].lower(), target.lower()).ratio()
        if ratio > best:
            best, at = ratio, i
    return (at, at + n) if best >= threshold else None


def test_windows_equal_brute_force():
    rng = random.Random(9)
    alphabet = "aabbccdde  éİΣσ"
    for k in range(1500):
        letters = alphabet if k % 4 == 0 else alphabet[:11]
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        target = "".join(rng.choices(letters, k=rng.randint(0, 12)))
        if text and rng.random() < 0.7:
            i = rng.randrange(len(text))
            target = list(text[i : i + rng.randint(1, 14)])
            for _ in range(rng.randint(0, 2)):
                target[rng.randrange(len(target))] = rng.choice(letters)
            target = "".join(target)
        for threshold in (0.5, 0.88):
            assert spans.window_ratio(text, target, threshold) == every_window(text, target, threshold), (text, target, threshold)


def test_long_targets_and_texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    text = " ".join(rng.choices(words, k=400))
    sentence = text[700:890]
    changed = sentence[:100] + "x" + sentence[101:150] + "y" + sentence[151:]
    assert spans.window_ratio(text, changed, 0.88) == every_window(text, changed, 0.88) is not None


def test_three_targets_in_one_call(spark):
    rows = [("The Neural Network learns Maps well.", "neural network", "maqs", "The Neural Netwark learns Maps well."), ("abc", None, " ", ""), (None, "a", "b", "c"), ("  ", "a", " ", None), ("Xyz", "xyz", "xyz", "qqq")]
    df = spark.createDataFrame(rows, "content string, s string, o string, sent string")
    found = spans.find_spans(F.col("content"), {c: F.col(c) for c in ("s", "o", "sent")}, 0.7)
    got = [tuple(tuple(x) if x else None for x in r) for r in df.select(*[v.alias(k) for k, v in found.items()]).collect()]
    assert got == [((4, 18), (26, 30), (0, 36)), (None, None, None), (None, None, None), (None, (0, 1), None), ((0, 3), (0, 3), None)]


def test_the_ladder_is_one_branch(spark, sf):
    plan = extraction_queries.validate_triples(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4 and plan.count("ArrowEvalPython") <= 1 and "Union" not in plan


def test_patterns_from_a_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"canonical":"binds-to","phrases":["binds to","attaches"]}\n{"canonical":"binds-to","swap":true,"phrases":["is bound by"]}\n')
    patterns = extraction.read_relation_patterns(spark, str(tmp_path / "p.json"))
    rows = spark.createDataFrame([("It binds to",), ("is bound by",), ("uses",)], "relation_text string")
    got = {r.relation_text: (r.relation, r.swap) for r in extraction.normalise_relations(rows, patterns=patterns).collect()}
    assert got == {"It binds to": ("binds-to", False), "is bound by": ("binds-to", True), "uses": (None, False)}
