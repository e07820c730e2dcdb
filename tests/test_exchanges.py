"""What is dealt out: edges once by document, and no more for what is looked up in few rows."""

from pyspark.sql import functions as F

from quillgraph.operators import graph, qa, views
from quillgraph.plans import graph_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_dealt_by_document_only(spark, sf):
    assert "hashpartitioning(src" not in plan(graph_queries.upsert_edges(spark, sf))


def test_both_directions_in_one_pass(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "c"), ("d", None)], "src string, dst string")
    steps = qa.both_directions(edges)
    assert "Union" not in plan(steps)
    assert sorted((r.at, r.to or "") for r in steps.collect()) == [("a", "b"), ("b", "a"), ("c", "c"), ("d", "")]


def test_conflicts_are_looked_up_without_dealing_the_edges(spark):
    rows = [("a", "b", "uses"), ("b", "a", "uses"), ("c", "c", "uses"), ("c", None, "uses"), ("a", "d", "uses"), ("e", "f", "correlates-with"), ("f", "e", "correlates-with")]
    flagged = graph.flag_conflicts(spark.createDataFrame(rows, "src string, dst string, relation string"))
    assert "SortMergeJoin" not in plan(flagged)
    assert {(r.src, r.dst) for r in flagged.collect() if r.conflicting} == {("a", "b"), ("b", "a"), ("c", "c")}
    assert flagged.count() == len(rows)


def test_a_word_of_all_names_is_ranked_before_it_meets_its_mentions(spark):
    n = 400
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node_id"), F.concat(F.lit("Thing "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), F.array().cast("array<string>").alias("aliases"), (F.col("id") % 7).alias("times_seen"))
    names = [(r.node_id, r.name, r.times_seen) for r in nodes.collect()]
    mentions = [r[1] for r in names[:100]] + ["thing", "a very long mention of thing 000009 and more", "00001", "x"]
    got = {}
    for r in qa.match_contains(spark.createDataFrame([(m,) for m in mentions], "mention string"), nodes, 3).collect():
        got.setdefault(r.mention, {})[r.k] = r.node_id
    want = {}
    for m in mentions:
        low = m.lower()
        terms = [low, *(w for w in "".join(c if c.isalnum() else " " for c in low).split() if len(w) > 2)]
        met = [(name.lower() != low, -seen, name, node) for node, name, seen in names if any(t in name.lower() for t in terms)]
        if met:
            want[m] = {k + 1: x[3] for k, x in enumerate(sorted(met)[:3])}
    assert got == want
    terms = spark.createDataFrame([(f"{i:06d}",) for i in range(n)], "term string")
    assert qa.term_candidates(terms, nodes.select(F.lower("name").alias("low"))).count() == n


def stored(monkeypatch, *modules):
    """Columns of what the modules write to checkpoints, as they write it."""
    seen = []
    for m in modules:
        before = m.checkpointed
        monkeypatch.setattr(m, "checkpointed", lambda df, before=before: seen.append(df.columns) or before(df))
    return seen


def test_answers_store_the_edges_at_their_ends_in_few_columns(spark, sf, monkeypatch):
    seen = stored(monkeypatch, graph_queries)
    graph_queries.answers(spark, sf)
    assert seen and all("attributes" not in c and "edge_id" not in c for c in seen)


def test_conflicts_are_looked_up_for_the_edges_of_paths(spark, sf, monkeypatch):
    rows = [("s", "p", "uses", "1"), ("p", "s", "uses", "2"), ("p", "c", "uses", "3"), ("x", "y", "uses", "4"), ("y", "x", "uses", "5")]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, doc_id string")
    edges = edges.selectExpr("*", "doc_id edge_id", "0.9D confidence", "timestamp'2020-01-01' created_at", "false conflicting")
    pairs = spark.createDataFrame([("s", "c")], "start string, goal string")
    near = qa.edges_at(edges, pairs.selectExpr("start node_id").unionAll(pairs.selectExpr("goal")))
    assert {r.edge_id for r in near.collect()} == {"1", "2", "3"}
    paths = qa.find_paths(pairs, edges, 2)
    conflicts = qa.path_conflicts(paths, edges)
    assert {r.edge_id for r in conflicts.collect()} == {"1", "2"}
    nodes = spark.createDataFrame([], "node_id string, sections map<string,long>")
    got = {(r.signature, r.conflicting) for r in qa.rank_paths(paths, nodes, conflicts=conflicts).collect()}
    assert got == {("1,3", True), ("2,3", True)}
    flagged = []
    before = graph.flag_conflicts
    monkeypatch.setattr(graph, "flag_conflicts", lambda e: flagged.append(e.count()) or before(e))
    graph_queries.answer_table(spark, sf)
    assert flagged == [flagged[0]] and flagged[0] * 10 < graph_queries.upsert_edges(spark, sf).count()


def test_a_view_reads_its_edges_once(spark, sf):
    plan_of = plan(graph_queries.accessible_view(spark, sf))
    assert plan_of.split("+- == Initial Plan ==")[-1].count("lineitem.parquet") == 1
    edges = spark.createDataFrame([("1", "a", 0.9), ("2", "b", 0.8), ("3", "b", 0.95)], "edge_id string, section string, confidence double").selectExpr("*", "'u' src", "'v' dst", "timestamp'2020-01-01' created_at")
    assert [r.edge_id for r in views.graph_view(edges, sections=("b",), limit=1).orderBy("k").collect()] == ["3"]
    assert [r.edge_id for r in views.graph_view(edges, sections=("a",), limit=2).orderBy("k").collect()] == ["1"]
    assert [r.edge_id for r in views.graph_view(edges, sections=("zz",), limit=2).orderBy("k").collect()] == ["3", "1"]
    assert views.graph_view(edges.where("false"), sections=("a",)).count() == 0
