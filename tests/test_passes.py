"""What is dear to make is made once and in as many tasks as its rows need."""

from pyspark.sql import functions as F

from quillgraph.operators import canonical, quality
from quillgraph.plans import extraction_queries, more_queries, text_queries
from quillgraph.sources import tables


def counting(spark, df):
    """The rows, and how often each was made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mentions_are_made_once(spark):
    rows = [("a", "T", "1", "R", 2), ("a", "T", "1", "R", 1), ("a", "U", "2", "M", 0), ("b", None, "1", "R", -1), ("b", None, "3", "R", 0)]
    mentions, made = counting(spark, spark.createDataFrame(rows, "name string, type string, doc_id string, section string, times_seen int"))
    got = {r.name: (r.type, r.times_seen, r.docs, r.sections) for r in canonical.aggregate_entities(mentions).collect()}
    assert got == {"a": ("T", 3, ["1", "2"], {"R": 2, "M": 1}), "b": ("Unknown", 2, ["1", "3"], {"R": 2})}
    assert made.value == len(rows)


def test_edges_and_rejections_are_read_once(spark):
    edges, edges_made = counting(spark, spark.createDataFrame([("r", "1"), ("r", "1"), ("r", None), ("q", "2"), ("q", "3")], "relation string, doc_id string"))
    rejected, rejected_made = counting(spark, spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "reason string"))
    got = {(r.kind, r.name): r.value for r in quality.graph_quality(edges, spark.range(4), rejected).collect()}
    assert got == {("edges_per_node", "all"): 1.25, ("rejection", "x"): 0.666667, ("rejection", "y"): 0.333333, ("relation", "q"): 2.0, ("relation", "r"): 1.0}
    assert (edges_made.value, rejected_made.value) == (5, 4)


def test_sentences_bring_their_content(spark, sf):
    assert "SortMergeJoin" not in plan(extraction_queries._triples(spark, sf)) and "BroadcastHashJoin" not in plan(extraction_queries._triples(spark, sf))


def test_parts_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    rows = spark.range(95).withColumn("name", F.lit("x"))
    assert tables.dealt(rows, "id", 10).rdd.getNumPartitions() == 10
    for query in (more_queries.link_spans, text_queries.inventory):
        assert "REPARTITION_BY_NUM" in plan(query(spark, sf))
