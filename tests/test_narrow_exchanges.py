"""What is dealt out at nodes is kept small: the same results, from fewer and narrower rows."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from quillgraph.operators import graph, qa, views

_EDGES = "src string, dst string, relation string, doc_id string, confidence double, created_at timestamp, edge_id string"


def _edges(spark, n=600):
    r = random.Random(5)
    rows = []
    for i in range(n):
        a, b = f"s{r.randrange(4)}", f"p{r.randrange(30)}"
        a, b = r.choice([(a, b), (b, a), (a, a)])
        when = None if r.random() < 0.1 else datetime(r.choice([1969, 1970, 1971, 1999, 2020]), r.choice([1, 12]), r.choice([1, 31]), r.randrange(24))
        rows.append((a, b, "uses", str(i), r.choice([0.5, 0.8, 0.9, 0.9, float("nan")]), when, f"e{i:04d}"))
    return rows, spark.createDataFrame(rows, _EDGES)


def _order(row):
    """Falling confidence (NaN is the greatest), then the newest (none last), then the id."""
    c, t = row[4], row[5]
    return (-1e9 if c != c else -c, t is None, -(t - datetime(1, 1, 1)).total_seconds() if t else 0, row[6])


@pytest.mark.parametrize("few", [500_000, 0])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_neighbours_are_the_k_best(spark, monkeypatch, few, k):
    monkeypatch.setattr(qa, "FEW", few)
    rows, edges = _edges(spark)
    asked = ["s0", "s2", "p3", "none"]
    got = qa.neighbours(spark.createDataFrame([(a,) for a in asked + asked[:1]], "node_id string"), edges, 0.6, k).collect()
    want = []
    for a in asked:
        at = sorted((e for e in rows if a in e[:2] and not e[4] < 0.6), key=_order)[:k]
        want += [(a, e[6], i + 1) for i, e in enumerate(at)]
    assert sorted((r.node_id, r.edge_id, r.k) for r in got) == sorted(want)


def test_only_the_best_classes_of_a_node_are_dealt_out(spark):
    edges = spark.range(20_000).selectExpr("concat('s', id % 2) as src", "concat('p', id) as dst", "'uses' as relation", "cast(id as string) as doc_id", "(id % 100) / 100 as confidence", "timestamp'2020-01-01' + make_interval(0, 0, 0, int(id % 2000)) as created_at", "cast(id as string) as edge_id")
    met = qa.both_directions(edges).where("at like 's%'")
    kept = qa._within_best(met, 12)
    assert kept.columns == met.columns and 24 <= kept.count() <= 200


def test_cross_paper_from_the_number_of_documents_and_the_only_one(spark):
    docs = {"none": None, "empty": [], "null": [None], "a": ["a"], "aa": ["a", "a"], "b": ["b"], "ab": ["a", "b"], "a-null": ["a", None]}
    nodes = spark.createDataFrame(list(docs.items()), "node_id string, docs array<string>")
    ends = [*docs, "unknown", None]
    edges = spark.createDataFrame([(s, d) for s in ends for d in ends], "src string, dst string")
    marked = graph.mark_cross_paper(edges, nodes)
    want = {(s, d): bool(docs.get(s) and docs.get(d) and len({*docs[s], *docs[d]}) > 1) for s in ends for d in ends}
    assert set(marked.columns) == {"src", "dst", "cross_paper"} and {(r.src, r.dst): r.cross_paper for r in marked.collect()} == want
    # The documents themselves don't travel with the edges.
    assert "array_union" not in marked._jdf.queryExecution().optimizedPlan().toString()


def test_partition_nodes_reads_the_edges_once(spark):
    edges = spark.range(40).selectExpr("concat('n', id % 5) as src", "concat('n', id % 7) as dst")
    nodes = spark.createDataFrame([(f"n{i}", [str(i % 3)]) for i in range(7)], "node_id string, docs array<string>")
    got = views.partition_nodes(views.partition_by_document(edges, nodes), nodes)
    pairs = {(i % 5, i % 7) for i in range(40)}
    apart = {n for p in pairs if p[0] % 3 != p[1] % 3 for n in p}
    assert {(r.node_id, r.part) for r in got.collect()} == {(f"n{i}", str(i % 3)) for i in range(7)} | {(f"n{i}", "unattributed") for i in apart}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
