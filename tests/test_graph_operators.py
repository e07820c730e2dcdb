"""Operators whose rules SQL can't say, on literal tables."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import canonical, elements, extraction, graph, qa, quality, registry, routing, views
from quillgraph.sources import logs
from quillgraph.streaming import jobs


def test_sections_exact_fuzzy_and_unknown(spark):
    rows = spark.createDataFrame([("d", s) for s in ("Intro", "METHODS", "Resultss", "Conclusion", "qqqq", None)], "doc_id string, section string")
    got = [r.section for r in elements.normalise_sections(rows).collect()]
    assert sorted(got) == sorted(["Introduction", "Methods", "Results", "Conclusion", "_auto_", "_auto_"])


def test_indel_ratio():
    assert elements.indel_ratio("methods", "methods") == 100.0
    assert elements.indel_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert elements.indel_ratio("", "") == 100.0


def test_authors_first_run_only(spark):
    items = [("d", 0, "section_header", 1, "Title"), ("d", 1, "text", 1, "published 2020"), ("d", 2, "text", 1, "Ada Lovelace, Alan Turing and Grace Hopper Proceedings of X"), ("d", 3, "text", 1, "Ada Lovelace"), ("d", 4, "text", 1, "no names here"), ("d", 5, "text", 1, "Kurt Godel")]
    got = elements.paper_authors(spark.createDataFrame(items, "doc_id string, pos int, label string, page int, text string")).collect()
    assert got[0].authors == ["Ada Lovelace", "Alan Turing", "Grace Hopper"]


def test_type_votes_follow_the_order_of_a_chunk(spark):
    rows = [("e", 0, "X", "Y", "method", "dataset"), ("e", 1, "X", "a corpus", "unknown", "other"), ("f", 0, "X", "Z", None, "task")]
    t = spark.createDataFrame(rows, "element_id string, pos int, subject string, object string, raw_subject_type string, raw_object_type string")
    got = {(r.element_id, r.pos): (r.subject_type, r.object_type) for r in extraction.resolve_entity_types(t).collect()}
    assert got == {("e", 0): ("Method", "Dataset"), ("e", 1): ("Method", "Dataset"), ("f", 0): (None, "Task")}


def test_spans_exact_case_and_fuzzy(spark):
    rows = [(1, "The Neural Network learns", "Neural Network"), (2, "the neural network learns", "Neural Network"), (3, "the neurol network learns", "neural network"), (4, "nothing", "neural network"), (5, "", "x")]
    got = {r.i: r.span for r in extraction.link_spans(spark.createDataFrame(rows, "i int, text string, target string"), "text", "target").collect()}
    assert (got[1].start, got[1].end) == (4, 18) and (got[2].start, got[2].end) == (4, 18) and (got[3].start, got[3].end) == (4, 18)
    assert got[4] is None and got[5] is None


def node(i, seen, docs, sections, seq=0, version="v1"):
    return (i, f"n{i}", "T", version, [f"a{i}"], sections, seen, docs, seq)


NODE = "node_id string, name string, type string, version string, aliases array<string>, sections map<string,bigint>, times_seen bigint, docs array<string>, seq int"


def test_repeated_upsert_changes_nothing(spark):
    existing = spark.createDataFrame([node("1", 2, ["d1"], {"R": 2})], NODE).drop("seq")
    staged = spark.createDataFrame([node("1", 3, ["d2"], {"R": 1, "M": 2}), node("2", 0, ["d9"], {})], NODE).drop("seq")
    once = graph.upsert_nodes(existing, staged)
    twice = graph.upsert_nodes(once, staged)
    key = lambda df: sorted((r.node_id, r.times_seen, sorted(r.docs), sorted(r.sections.items())) for r in df.collect())
    assert key(once) == key(twice)
    assert key(once)[0] == ("1", 5, ["d1", "d2"], [("M", 2), ("R", 3)])
    assert key(graph.upsert_nodes(once, staged, repeat="add"))[0][1] == 8


def test_edges_merge_and_come_back_from_deprecation(spark):
    schema = "src string, dst string, relation string, doc_id string, version string, verbatim string, confidence double, times_seen bigint, evidence string, attributes map<string,string>, created_at string, seq bigint"
    old = graph.upsert_edges(None, spark.createDataFrame([("a", "b", "uses", "d", "v", "x", 0.5, 1, "e1", {"k": "1"}, "2020", 0)], schema)).withColumn("deprecated", F.lit(True))
    new = spark.createDataFrame([("a", "b", "uses", "d", "v", "y", 0.4, 2, "e2", None, "2021", 1)], schema)
    r = graph.upsert_edges(old, new).collect()[0]
    assert (r.verbatim, r.confidence, r.times_seen, r.evidence, r.attributes, r.created_at, r.deprecated) == ("y", 0.5, 3, "e2", {"k": "1"}, "2020", False)


def test_self_loop_conflicts_with_itself(spark):
    e = spark.createDataFrame([("a", "a", "uses"), ("a", "b", "uses"), ("a", "c", "correlates-with"), ("c", "a", "correlates-with")], "src string, dst string, relation string")
    got = {(r.src, r.dst): r.conflicting for r in graph.flag_conflicts(e).collect()}
    assert got == {("a", "a"): True, ("a", "b"): False, ("a", "c"): False, ("c", "a"): False}


def test_clusters_do_not_depend_on_blocks(spark):
    names = [("alpha net", 4), ("alpha nets", 3), ("beta set", 2), ("beta sets", 1), ("gamma", 1)]
    e = canonical.name_features(spark.createDataFrame([(n, "T", t, {"R": 1}) for n, t in names], "name string, type string, times_seen int, sections map<string,int>"))
    e = e.withColumn("vector", F.when(F.col("name").startswith("alpha"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    one = e.select("name", F.lit(0).alias("block"))
    many = e.select("name", F.when(F.col("name").startswith("alpha"), 1).otherwise(2).alias("block"))

    def groups(blocks):
        out = {}
        for r in canonical.cluster_entities(e, blocks).collect():
            out.setdefault(r.cluster, set()).add(r.name)
        return sorted(map(sorted, out.values()))

    assert groups(one) == groups(many) == [["alpha net", "alpha nets"], ["beta set", "beta sets"], ["gamma"]]


def test_node_id_is_a_uuid5(spark):
    schema = "cluster string, name string, normalised string, type string, times_seen bigint, docs array<string>, sections map<string,int>"
    rows = spark.createDataFrame([("c", "Net", "net", "T", 2, ["d"], {"R": 2, "M": 1}), ("c", "Nets", "nets", "T", 1, ["e"], {"R": 1}), ("e", "Map", "map", "T", 1, [], {})], schema)
    space = uuid.UUID(canonical.NODE_NAMESPACE)
    got = {r.cluster: r.node_id for r in canonical.cluster_nodes(rows).collect()}
    assert got == {"c": str(uuid.uuid5(space, "net|nets::M:0.2500|R:0.7500")), "e": str(uuid.uuid5(space, "map"))}
    plain = {r.cluster: r.node_id for r in canonical.cluster_nodes(rows.drop("sections")).collect()}
    assert plain["c"] == str(uuid.uuid5(space, "net|nets"))


def test_downloads_close_the_latest_open_start(spark):
    events = ["end", "start", "start", "end", "end", "end", "start", "end"]
    rows = spark.createDataFrame([("s", i, f"2024-01-01 00:00:{i:02d}", e) for i, e in enumerate(events)], "stream string, seq int, t string, event string").withColumn("ts", F.to_timestamp("t"))
    got = sorted((r.start_seq, r.end_seq, r.seconds) for r in quality.download_durations(rows).collect())
    assert got == [(1, 4, 3.0), (2, 3, 1.0), (6, 7, 1.0)]


def test_section_filter_that_matches_nothing_is_dropped(spark):
    e = spark.createDataFrame([("e1", 0.9, "uses", "Results", "2020"), ("e2", 0.8, "uses", "Methods", "2021")], "edge_id string, confidence double, relation string, section string, created_at string")
    assert [r.edge_id for r in views.graph_view(e, sections=("Results",)).orderBy("k").collect()] == ["e1"]
    assert [r.edge_id for r in views.graph_view(e, sections=("None",)).orderBy("k").collect()] == ["e1", "e2"]


def test_paths_use_no_edge_twice(spark):
    e = spark.createDataFrame([("1", "a", "b", "uses", 0.9, "t", False), ("2", "b", "c", "uses", 0.8, "t", False), ("3", "a", "c", "uses", 0.6, "t", False)], "edge_id string, src string, dst string, relation string, confidence double, created_at string, conflicting boolean")
    p = spark.createDataFrame([("a", "c"), ("a", "a")], "start string, goal string")
    got = sorted((r.start, r.goal, [h.edge_id for h in r.hops]) for r in qa.find_paths(p, e, 3, 0.7).collect())
    assert got == [("a", "c", ["1", "2"])]


def test_slugs_step_over_taken_ids(spark):
    up = spark.createDataFrame([("A b", 1), ("a-b", 2), ("a b 1", 3)], "name string, seq int")
    got = {r.seq: r.paper_id for r in registry.assign_paper_ids(up).collect()}
    assert got[1] == "a-b" and got[3] == "a-b-1" and len(set(got.values())) == 3


def test_null_and_empty_rows_do_not_crash(spark):
    e = spark.createDataFrame([("d", "d:0", None), ("d", "d:1", "")], "doc_id string, element_id string, content string")
    assert routing.vocabulary_density(e, ("a",)).count() == 2
    assert extraction.triple_budget(e).count() == 2


def test_logs_skip_bad_lines_and_round_trip(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"ts":"2024-01-01","v":1}\n\nnot json\n[1]\n{"ts":"2024-01-02","v":2}\n')
    got = logs.read_log(spark, str(tmp_path / "log.json"), "ts string, v int", last=1).collect()
    assert [(r.ts, r.v) for r in got] == [("2024-01-02", 2)]
    logs.append_log(spark.createDataFrame([("b", 1)], "z string, a int"), str(tmp_path / "out"))
    logs.append_log(spark.createDataFrame([("c", 2)], "z string, a int"), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ['{"a":1,"z":"b"}', '{"a":2,"z":"c"}']


def test_parsed_round_trip(spark, tmp_path):
    papers = spark.createDataFrame([("d", "T", 2020, None, None)], "doc_id string, title string, year int, venue string, doi string")
    el = spark.createDataFrame([("d", "d:0", "S", "text", "h", 0, 4)], "doc_id string, element_id string, section string, content string, content_hash string, start_char bigint, end_char bigint")
    logs.write_parsed(papers, el, str(tmp_path / "p"))
    got_papers, got_el = logs.read_parsed(spark, str(tmp_path / "p"))
    assert got_papers.collect() == papers.collect() and got_el.collect() == el.collect()


def test_stream_ingest_equals_batch_and_repeats_nothing(spark, tmp_path):
    schema = "doc_id string, content_hash string, content string"
    rows = spark.createDataFrame([("d", "h1", "x"), ("d", "h1", "x"), ("d", "h2", "y")], schema)
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        jobs.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "reg"), str(tmp_path / "out"), "v1", str(tmp_path / f"ck{k}")).awaitTermination()
    assert sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["h1", "h2"]


def test_stream_ingest_keeps_state_over_restarts_and_checkpoints(spark, tmp_path):
    schema = "doc_id string, content_hash string, content string, n long"
    source, registry, out = str(tmp_path / "in"), str(tmp_path / "reg"), str(tmp_path / "out")

    def run(rows, state, version="v1"):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        jobs.ingest(spark.readStream.schema(schema).parquet(source), registry, out, version, str(tmp_path / state)).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("doc_id", "content_hash", "content", "n").collect()), key=str)

    big = (1 << 53) + 1
    first = run([("d", "h1", "x", big), (None, "h1", "y", None), ("d", None, None, 2)], "a")
    assert first == sorted([("d", "h1", "x", big), (None, "h1", "y", None), ("d", None, None, 2)], key=str)
    # The same checkpoint goes on; a known key doesn't come again, a new one does.
    second = run([("d", "h1", "again", 3), ("e", "h1", "z", 4)], "a")
    assert second == sorted([*first, ("e", "h1", "z", 4)], key=str)
    # A new checkpoint takes what is known from the registry and overwrites nothing.
    third = run([("e", "h2", "w", 5), (None, "h1", "again", 6)], "b")
    assert third == sorted([*second, ("e", "h2", "w", 5)], key=str)
    # So does the next one, of both.
    assert len(run([("f", "h", "v", 7)], "c")) == len(third) + 1
    # Another version starts from nothing.
    assert len(run([], "d", "v2")) == len(third) + 1 + 6


def test_stream_ingest_keeps_its_keys_without_python_and_takes_over_in_later_batches(spark, tmp_path):
    schema = "doc_id string, content_hash string, content string"
    registry, out = str(tmp_path / "reg"), str(tmp_path / "out")

    def run(name, files, state):
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        query = jobs.ingest(stream, registry, out, "v1", str(tmp_path / state))
        query.awaitTermination()
        return query

    query = run("in", [[("d", "h1", "x"), ("d", "h2", "x")], [("d", "h1", "y"), (None, "h3", "y")]], "a")
    operators = [o["operatorName"] for p in query.recentProgress for o in json.loads(p.json)["stateOperators"]]
    assert operators and set(operators) == {"dedupe"}
    # Keys of the first run come back in the first and in a later batch of the second one.
    run("more", [[("d", "h1", "z"), ("e", "h1", "z")], [("d", "h2", "z"), (None, "h3", "z"), (None, None, "z")], [("e", "h1", "w"), (None, None, "w")]], "b")
    got = [(r.doc_id, r.content_hash) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=str) == sorted([("d", "h1"), ("d", "h2"), (None, "h3"), ("e", "h1"), (None, None)], key=str)


def test_stream_status_and_windows_equal_batch(spark, tmp_path):
    schema = "paper_id string, seq int, ts timestamp, status string, metric string, value double"
    rows = spark.sql("select 'p' || (id % 3) as paper_id, cast(id as int) as seq, timestamp_seconds(id * 4000) as ts, 's' || (id % 4) as status, 'm' || (id % 2) as metric, cast(id as double) as value from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = jobs.paper_status(stream).writeStream.outputMode("complete").format("memory").queryName("fold").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("fold").collect())) == sorted(map(tuple, jobs.paper_status(rows).collect()))
    w = jobs.kpi_windows(stream).writeStream.outputMode("append").format("memory").queryName("win").trigger(availableNow=True).start()
    w.awaitTermination()
    batch = {(r.window_start, r.metric): r.n for r in jobs.kpi_windows(rows).collect()}
    got = {(r.window_start, r.metric): r.n for r in spark.table("win").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_paper_ids_take_the_next_free_number(spark):
    uploads = spark.createDataFrame([(1, "A"), (2, "a"), (3, "a-1"), (4, "a!"), (5, "A 1"), (6, "a-3"), (7, "a"), (8, "b-01"), (9, "b"), (10, "B")], "seq long, name string")
    got = {r.seq: r.paper_id for r in registry.assign_paper_ids(uploads).collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-1", 4: "a-4", 5: "a-1-1", 6: "a-3", 7: "a-5", 8: "b-01", 9: "b", 10: "b-1"}


def test_rings_by_type_then_dominant_section(spark):
    rows = [(f"top{i}", "x", 100, None) for i in range(3)]
    rows += [("m", " Method ", 1, {"results": 9}), ("g", "gene", 1, None), ("s", "dataset", 1, {"Methods": 2, "Results": 1}), ("d", "corpus", 1, {"Intro": 1}), ("e", "other", 1, {"Evaluation": 3, "Methods": 2}), ("z", None, 1, {})]
    nodes = spark.createDataFrame([*rows, *[(f"f{i}", "x", 1, None) for i in range(30)]], "node_id string, type string, times_seen long, sections map<string,long>")
    edges = spark.createDataFrame([], "src string, dst string")
    ring = {r.node_id: r.ring for r in views.node_importance(nodes, edges).collect()}
    assert [ring[k] for k in ("top0", "top1", "top2", "m", "g", "s", "d", "e", "z")] == [0, 0, 0, 1, 2, 2, 3, 4, 5]


def test_answers_by_intent(spark):
    questions = spark.createDataFrame(
        [(1, "factoid", None), (2, "factoid", None), (3, "factoid", None), (4, "factoid", None), (5, "entity_summary", None), (6, "cluster_summary", None), (7, "paper_summary", ["d1", "d2"]), (8, "paper_summary", ["d9"]), (9, "paper_summary", []), (10, "entity_summary", None), (11, "entity_summary", None), (12, "factoid", None)],
        "question_id long, intent string, documents array<string>",
    )
    candidates = [(q, 0, 1, "n1", "BERT", 0.9, 4, ["Results", "Methods"]) for q in (1, 2, 3, 5, 6, 10, 12)] + [(q, 1, 1, "n2", "GPT", 0.95, 2, []) for q in (3, 5, 6)] + [(6, 1, 2, "n3", "T5", 0.5, 1, None), (6, 2, 1, "n1", "BERT", 1.0, 4, None), (6, 2, 2, "n4", "X", 0.4, 1, None)]
    candidates = spark.createDataFrame(candidates, "question_id long, pos int, k int, node_id string, name string, similarity double, times_seen long, sections array<string>")
    form = "question_id long, k int, i int, src_name string, relation string, dst_name string, doc_id string, confidence double, conflicting boolean"
    paths = spark.createDataFrame([(1, 1, 1, "b", "uses", "c", "d2", 0.8, False), (1, 1, 0, "a", "uses", "b", "d1", 0.9, None), (1, 2, 0, "a", "uses", "c", "d3", 0.7, False), (12, 1, 0, "a", "uses", "c", "d3", 0.7, False), (12, 2, 0, "a", "hurts", "c", "d3", 0.7, True), (5, 1, 0, "a", "uses", "c", "d3", 0.7, True)], form)
    fallback = spark.createDataFrame([(2, 2, None, "x", "uses", "y", "d2", 0.5, None), (2, 1, None, "x", "uses", "z", "d1", 0.6, None)], form)
    findings = spark.createDataFrame([(5,), (5,), (6,), (7,), (7,), (7,)], "question_id long")
    got = {r.question_id: (r.mode, r.summary) for r in qa.answers(questions, candidates, paths, fallback, findings).collect()}
    profile = "BERT (similarity 0.90, seen 4x, sections: Methods, Results)"
    assert got == {
        1: ("direct", "a uses b (doc d1, conf=0.90); b uses c (doc d2, conf=0.80)"),
        2: ("insufficient", "Insufficient evidence to answer. Related findings: x uses z (doc d1, conf=0.60); x uses y (doc d2, conf=0.50)"),
        3: ("insufficient", f"Insufficient evidence from graph relations. Known entity profiles: {profile}; GPT (similarity 0.95, seen 2x, sections: unknown sections)."),
        4: ("insufficient", "Unable to resolve any entities for the question."),
        5: ("direct", "Summary for GPT derived from 2 graph findings."),
        6: ("direct", "Cluster summary for BERT, GPT, T5 derived from 1 graph findings."),
        7: ("direct", "Summary for documents d1, d2 derived from 3 graph findings."),
        8: ("insufficient", "No extracted findings available for documents: d9."),
        9: ("insufficient", "Unable to identify which document to summarize."),
        10: ("insufficient", f"Insufficient evidence from graph relations. Known entity profiles: {profile}."),
        11: ("insufficient", "Unable to resolve any entities for the question."),
        12: ("conflicting", "a uses c (doc d3, conf=0.70)"),
    }
