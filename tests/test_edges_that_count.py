"""Answers from the edges that count equal those from all edges."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import checkpoints
from quillgraph.operators import canonical, qa

_EDGE = "edge_id string, src string, dst string, relation string, confidence double, created_at string, doc_id string, conflicting boolean, citation string, sentence string"


def _edges(spark, rows):
    return spark.createDataFrame(rows, _EDGE).withColumn("created_at", F.to_timestamp("created_at"))


def _graph(spark, seed, nodes=30, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A hub, repeated kinds of edges, self-loops, missing ends, dates, confidences and documents.
        a, b = (rng.choice([0, rng.randrange(nodes)]) for _ in range(2))
        src, dst = (None if rng.random() < 0.01 else f"n{x}" for x in (a, b))
        date = rng.choice([None, f"20{rng.randint(18, 22)}-0{rng.randint(1, 9)}-01"])
        confidence = rng.choice([None, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
        rows.append((f"e{i}", src, dst, rng.choice(["uses", "improves", "correlates-with"]), confidence, date, rng.choice([None, f"D{i % 40}"]), rng.choice([None, False, True]), f"c{i}", None))
    return _edges(spark, rows)


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 50)])
def test_answers_equal_those_from_all_edges(spark, monkeypatch, seed, k):
    words = {kind: " ".join(w) for kind, w in config.INTENT_KEYWORDS.items()}
    rng = random.Random(seed)
    asked = [f"how do Node{rng.randrange(33)} and Node{rng.randrange(33)} fit?" for _ in range(25)]
    asked += [f"{words['entity']} Node{i}" for i in range(4)] + [f"{words['cluster']} Node{i} Node{i + 5}" for i in range(4)] + [f"{words['paper']} doc:d{i}" for i in range(3)] + ["Node1 Node1", None]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, text string")
    nodes = spark.createDataFrame([(f"n{i}", f"Node{i}", ["Node1"] if i == 2 else [], i, {"Results": 1} if i % 2 else {}) for i in range(32)], "node_id string, name string, aliases array<string>, times_seen long, sections map<string,long>")
    vectors = spark.createDataFrame([(f"Node{i}",) for i in range(33)], "text string").withColumn("vector", canonical.hash_embedding(F.col("text")))
    edges = checkpoints.checkpointed(_graph(spark, seed))
    few = []
    some = qa.edges_that_count

    def counted(*args, **more):
        out = some(*args, **more)
        few.append(out.count())
        return out

    monkeypatch.setattr(qa, "edges_that_count", counted)
    got = sorted(qa.ask(questions, nodes, edges, vectors, k=k, flag=True).collect())
    monkeypatch.setattr(qa, "edges_that_count", lambda edges, *args, **more: edges)
    want = sorted(qa.ask(questions, nodes, edges, vectors, k=k, flag=True).collect())
    assert got == want and {r.intent for r in got} == {"factoid", "entity_summary", "cluster_summary", "paper_summary"}
    assert len({r.mode for r in got}) == 3 and (k > 3 or few[0] < 1400)


def test_an_asked_hub_brings_its_best_edges_only(spark):
    # The first 2,000 are of one kind; others are of lower confidence.
    rows = [(f"a{i}", "hub", "x", "uses", 0.9, "2020-01-01", f"d{i}", False, "c", "s") for i in range(2000)]
    rows += [(f"b{i}", f"y{i}", "hub", "uses", 0.8 if i < 50 else 0.7, "2020-01-01", f"d{i}", False, "c", "s") for i in range(1000)]
    edges = _edges(spark, [*rows, ("m1", "s", "p", "uses", 0.7, "2019-01-01", "d", False, "c", "s"), ("m2", "p", "g", "uses", 0.7, "2019-01-01", "d", False, "c", "s"), ("m3", "g", "p", "uses", 0.1, None, "d", False, "c", "s")])
    asked, none = spark.createDataFrame([("hub",)], "node_id string"), spark.createDataFrame([], "node_id string, doc_id string")
    pairs = spark.createDataFrame([("s", "g"), ("s", "hub")], "start string, goal string")
    kept = {r.edge_id for r in qa.edges_that_count(edges, asked, pairs, none, none, 5).collect()}
    # Those of one kind, and the class that has four others; a trail's edges, and what lies between its ends whatever the confidence.
    assert kept == {f"a{i}" for i in range(2000)} | {f"b{i}" for i in range(50)} | {"m1", "m2", "m3"}
    limited = {r.edge_id for r in qa.edges_that_count(edges, asked.where("false"), pairs, asked, none, 5).collect()}
    assert limited == {"m1", "m2", "m3"}


def test_freed_shuffles_leave_the_setting_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with pytest.raises(ValueError), checkpoints.shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        made = checkpoints.checkpointed(spark.range(1000).groupBy(F.col("id") % 7).count())
        raise ValueError
    assert spark.conf.get(key) == was and made.count() == 7
