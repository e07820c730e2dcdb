"""Odd rows and empty tables: every operator and stage has a defined result for them."""

import pytest

import corpus_pipeline
from quillgraph.llm import decontamination, language, linededup, packing, passages, pii, registry, sharding, simhash, spotsigs, toxicity

BENCH = [(1, None), (None, "x"), (2, ""), (3, "the thing that is never there at all in any of the rows")]


def operators(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 1), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    return {
        "op1": simhash.near_duplicate_groups,
        "op2": lambda d: decontamination.find_contamination(d, bench),
        "op3": lambda d: toxicity.score_documents(d, labels),
        "op4": packing.pack_documents,
        "op5": linededup.line_duplicates,
        "op6": language.predict_languages,
        "op7": spotsigs.fingerprint_documents,
        "op8": sharding.shard_documents,
        "op9": pii.find_documents_pii,
        "op10": passages.repeated_passages,
    }


PER_ROW = {"op1": 10, "op3": 10, "op5": 10, "op6": 10, "op7": 10, "op8": 10, "op9": 10}


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_odd_rows(spark, odd, name):
    rows = operators(spark)[name](odd).collect()
    if name in PER_ROW:
        assert len(rows) == PER_ROW[name]
    if name == "op4":
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    if name == "op6":
        assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    if name in ("op2", "op10"):
        assert not rows


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_empty_table(spark, empty, name):
    assert operators(spark)[name](empty).collect() == []


def test_stages_take_odd_rows_and_keep_the_columns(spark, odd, empty, sf):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_every_operator_has_a_query():
    names = registry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
