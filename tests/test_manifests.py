"""Run manifests from logged rows, the latest run's quality, and questions answered with their context."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import canonical, qa, quality


@pytest.fixture(scope="module")
def logged(spark):
    metrics = spark.createDataFrame([("r1", "a", "attempted", 4.0, 1), ("r1", "a", "attempted", 6.0, 2), ("r1", "a", "accepted", 3.0, 1), ("r1", "b", "attempted", 4.0, 1), ("r0", "a", "attempted", 9.0, 1)], "run_id string, doc_id string, metric string, value double, seq long")
    reasons = spark.createDataFrame([("r1", "a", "x", 2), ("r1", "a", "x", 1), ("r1", "b", "y", 1), ("r1", "b", "z", 0)], "run_id string, doc_id string, reason string, n long")
    relations = spark.createDataFrame([("r1", "a", "uses"), ("r1", "a", " uses"), ("r1", "a", " "), ("r1", "b", "uses"), ("r1", "b", "improves")], "run_id string, doc_id string, relation string")
    errors = spark.createDataFrame([("r1", "a", " second", 5), ("r1", "a", "first", 3), ("r1", "a", "second ", 1), ("r1", "a", " ", 2), ("r1", "c", "only", 1), ("r1", None, "batch b", 9), ("r1", None, "batch a", 7), ("r1", None, "batch b", 8)], "run_id string, doc_id string, text string, seq long")
    return metrics, reasons, relations, errors


def test_documents_of_a_run(logged):
    got = {(r.run_id, r.doc_id): r for r in quality.document_manifest(*logged).collect()}
    assert set(got) == {("r1", "a"), ("r1", "b"), ("r1", "c"), ("r0", "a")}
    a, c = got["r1", "a"], got["r1", "c"]
    assert (a.metrics, a.rejection_reasons, a.relation_types, a.errors) == ({"attempted": 6.0, "accepted": 3.0}, {"x": 3}, ["uses"], ["second", "first"])
    assert (c.metrics, c.rejection_reasons, c.relation_types, c.errors) == ({}, {}, [], ["only"])


def test_batch_and_latest_quality(spark, logged):
    documents = quality.document_manifest(*logged)
    runs = spark.createDataFrame([("r1", "v", "2024-01-01", "2024-01-03"), ("r0", "v", "2024-01-01", "2024-01-02")], "run_id string, pipeline_version string, started_at string, completed_at string")
    phases = spark.createDataFrame([("r1", "graph", "s", 1.0, 1), ("r1", "graph", "s", 2.0, 2), ("r1", "parse", "s", 3.0, 1)], "run_id string, phase string, metric string, value double, seq long")
    r1 = {r.run_id: r for r in quality.batch_manifest(documents, runs, phases, logged[3]).collect()}["r1"]
    assert (r1.documents, r1.failed_documents, r1.totals, r1.phase_metrics, r1.batch_errors) == (3, 2, {"attempted": 10.0, "accepted": 3.0}, {"graph": {"s": 2.0}, "parse": {"s": 3.0}}, ["batch a", "batch b"])
    drift = spark.createDataFrame([(True,), (False,), (True,)], "alert boolean")
    got = {(r.kind, r.name): r.value for r in quality.latest_quality(documents, runs, drift).collect()}
    assert got["sum", "attempted"] == 10 and got["sum", "documents"] == 3 and got["ratio", "acceptance_rate"] == 0.3 and got["drift", "all"] == 2
    assert got["rejection", "x"] is None and got["relation", "uses"] == 2 and ("ratio", "edges_per_node") not in got
    none = {(r.kind, r.name): r.value for r in quality.latest_quality(documents, runs.where("false"), drift).collect()}
    assert none == {("drift", "all"): 2.0}


def test_questions_to_cited_context(spark):
    nodes = spark.createDataFrame([("b", "BERT", ["Bidirectional"], 5, {"Results": 1}), ("s", "SQuAD", [], 3, {"Methods": 1}), ("g", "GLUE", [], 2, {}), ("t", "T5", [], 1, {})], "node_id string, name string, aliases array<string>, times_seen long, sections map<string,long>")
    edge = "edge_id string, src string, dst string, relation string, confidence double, created_at string, doc_id string, conflicting boolean, citation string, sentence string"
    edges = spark.createDataFrame([("1", "b", "g", "evaluated-on", 0.9, "2024-01-01", "d1", False, "d1:3", "BERT on GLUE."), ("2", "s", "g", "part-of", 0.8, "2024-01-02", "d2", None, "d2:1", None), ("3", "t", "g", "uses", 0.5, "2024-01-03", "d3", False, "d3:9", "T5.")], edge).withColumn("created_at", F.to_timestamp("created_at"))
    questions = spark.createDataFrame([(1, "how does BERT relate to SQuAD?"), (2, "what about T5"), (3, "nothing here"), (4, None), (5, "Summarize doc:d1 paper")], "question_id long, text string")
    words = [(w,) for w in ("BERT", "SQuAD", "T5", "Summarize", "bert", "squad", "t5", "glue", "bidirectional")]
    vectors = spark.createDataFrame(words, "text string").withColumn("vector", canonical.hash_embedding(F.col("text")))
    got = {r.question_id: r for r in qa.ask(questions, nodes, edges, vectors).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].mode, got[1].summary, got[1].documents) == ("direct", "BERT evaluated-on GLUE (doc d1, conf=0.90); SQuAD part-of GLUE (doc d2, conf=0.80)", ["d1", "d2"])
    assert got[1].prompt == "Question: how does BERT relate to SQuAD?\npath 1.1 BERT evaluated-on GLUE [d1:3] (0.90): BERT on GLUE.\npath 1.2 SQuAD part-of GLUE [d2:1] (0.80)"
    assert got[2].mode == "insufficient" and got[2].prompt.endswith("\nnear 1 T5 uses GLUE [d3:9] (0.50): T5.")
    assert got[3].prompt == "Question: nothing here\nno evidence" and got[4].prompt == "Question: \nno evidence"
    assert (got[5].intent, got[5].summary) == ("paper_summary", "Summary for documents d1 derived from 1 graph findings.")
    cited = qa.citation_check(spark.createDataFrame([(1, "As [d1:3] and [d2:1] say, not [d9:9].")], "question_id long, answer string"), spark.createDataFrame([(1, "d1:3"), (1, "d2:1")], "question_id long, citation string"))
    assert [(r.cited, r.valid) for r in cited.collect()] == [(3, 2)]
