"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet
in the shared folder and reads them back as the next stage's documents. All stages but the last return
the columns of `documents`:

- language: documents whose language the classifier rejects (no letter, or far from every language) go;
- lines: repeated and near-repeated lines go from the texts, every document stays;
- near_duplicates: of each SimHash group the document with the least id stays;
- decontamination: documents that hold a benchmark passage go;
- packing: the remaining documents' pieces in sequences of 2048 ids.

Nulls, empty texts, repeated rows and empty tables are treated as each operator's docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontamination, language, linededup, packing, simhash
from quillgraph.llm.common import ensure_checkpoint_dir, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known_languages(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.remove_duplicate_lines(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first_of_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Hashing, clustering and greedy packing are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all documents; the last one's rows."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
