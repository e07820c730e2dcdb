"""The pipeline's stages do what the operators say, one after the other."""

import corpus_pipeline
from quillgraph.llm import decontamination, language, linededup, simhash


def test_stages_take_effect(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rejected = {r.doc_id for r in language.predict_languages(docs).where("rejected").collect()}
    known = corpus_pipeline.language_stage(spark, docs, sf)
    assert {r.doc_id for r in known.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - rejected
    lines = corpus_pipeline.lines_stage(spark, known, sf)
    removed = {r.doc_id: r.removed_lines for r in linededup.line_duplicates(known).collect()}
    before = {r.doc_id: r.text for r in known.collect()}
    for r in lines.collect():
        assert r.text == "\n".join(x for k, x in enumerate(before[r.doc_id].split("\n")) if k not in removed[r.doc_id])
    unique = corpus_pipeline.near_duplicates_stage(spark, lines, sf)
    groups = {r.component_id for r in simhash.near_duplicate_groups(lines, shingle_words=5).collect()}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(groups)
    clean = corpus_pipeline.decontamination_stage(spark, unique, sf)
    assert decontamination.find_contamination(clean, bench).count() == 0
    hit = {r.doc_id for r in decontamination.find_contamination(unique, bench).collect()}
    assert {r.doc_id for r in clean.collect()} == groups - hit
    packed = corpus_pipeline.packing_stage(spark, clean, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == groups - hit


def test_run_equals_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
