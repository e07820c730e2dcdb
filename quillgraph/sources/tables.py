"""The driver tables in the roles that the operators expect. Whole tables, no sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import config


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents`: every fifth is a header, twenty make a page."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(lines).alias("pos", "text"))
    return rows.select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, "section_header").otherwise("text").alias("label"), (F.floor(F.col("pos") / 20) + 1).cast("int").alias("page"), "text")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts, customers and nations as nodes."""
    parts = []
    for table, key, name, type_ in (("supplier", "s_suppkey", "s_name", "supplier"), ("part", "p_partkey", "p_name", "part"), ("customer", "c_custkey", "c_name", "customer"), ("nation", "n_nationkey", "n_name", "nation")):
        parts.append(
            read(spark, sf_dir, table).select(
                F.concat(F.lit(type_[0]), F.col(key).cast("string")).alias("node_id"),
                F.col(name).alias("name"),
                F.lit(type_).alias("type"),
                F.array(F.col(name), F.concat_ws(" ", F.lit(type_), F.col(key).cast("string"))).alias("aliases"),
                (F.col(key) % 7 + 1).cast("long").alias("times_seen"),
                F.transform(F.array(F.col(key) % 10, F.col(key) % 3), lambda x: x.cast("string")).alias("docs"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Line items of one task, and rows of one task where each is dear.
TASK_LINES, TASK_ROWS = 500_000, 20_000


def dealt(rows: DataFrame, key: str, most: int = TASK_ROWS) -> DataFrame:
    """The rows dealt out by a key; the number of tasks follows the rows, as a small file of many rows would be one task."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(tasks, key)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges: supplier to part and customer to part, every fifth line the other way round.

    Both tables are dealt by document, so what is grouped by document afterwards isn't dealt again. The number of tasks
    follows the line items, as each of them becomes several times larger after the join.
    """
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    tasks = max(spark.sparkContext.defaultParallelism, -(-line.count() // TASK_LINES))
    line = line.withColumn("doc_id", F.col("l_orderkey").cast("string")).drop("l_orderkey").repartition(tasks, "doc_id")
    orders = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), "o_custkey").repartition(tasks, "doc_id")
    joined = line.join(orders, "doc_id")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    ends = F.explode(F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))))
    rows = joined.select("*", ends.alias("end"))
    flip = F.col("l_linenumber") % 5 == 0
    return rows.select(
        F.when(flip, part).otherwise(F.col("end")).alias("src"),
        F.when(flip, F.col("end")).otherwise(part).alias("dst"),
        F.when(F.col("l_returnflag") == "R", "uses").when(F.col("l_returnflag") == "A", "improves").otherwise("correlates-with").alias("relation"),
        "doc_id",
        F.when(F.col("l_linenumber") % 2 == 0, "v1").otherwise("v2").alias("version"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.when(F.col("l_linestatus") == "O", "Results").otherwise("Methods").alias("section"),
        F.col("l_linenumber").alias("line"),
    )


def capitalised(text):
    """Capitalised words of a text that are no stop words, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit("[A-Z][a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*config.STOP_WORDS))
