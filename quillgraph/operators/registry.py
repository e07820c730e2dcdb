"""Paper registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def registry_state(events: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The latest record of each paper; a null field keeps its earlier value. `seq` breaks ties of `ts`."""
    at = F.struct("ts", "seq")
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return events.groupBy("paper_id").agg(*latest, F.min("ts").alias("uploaded_at"), F.max("ts").alias("updated_at"))


def search_papers(papers: DataFrame, text: str | None = None, status: str | None = None, author: str | None = None) -> DataFrame:
    """Papers whose title or, where the table has it, `file_name` contains the text and one of whose `authors` contains `author`; case is ignored."""
    out = papers
    if text:
        places = [c for c in ("title", "file_name") if c in papers.columns]
        met = F.lit(False)
        for c in places:
            met = met | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
        out = out.where(met)
    if author:
        out = out.where(F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(author.lower()))))
    if status:
        out = out.where(F.col("status") == status)
    return out


def paper_counts(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "processing", "failed")])


def assign_paper_ids(uploads: DataFrame) -> DataFrame:
    """Slug of each name; the next free of `-1`, `-2` and so on in upload order where the slug is taken.

    A number whose slug another upload has as its own isn't free.
    """
    slug = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    rows = uploads.withColumn("__slug", slug).withColumn("__k", F.row_number().over(Window.partitionBy("__slug").orderBy("seq")) - 1)
    own = rows.where("__k = 0").select("__slug")
    # Slugs that end in a number take it from their stem; the i-th such number t leaves t - i free ones below it.
    form = "^(.+)-([1-9][0-9]{0,8})$"
    numbers = own.select(F.regexp_extract("__slug", form, 1).alias("stem"), F.regexp_extract("__slug", form, 2).alias("t")).where("stem <> ''")
    numbers = numbers.withColumn("t", F.col("t").cast("int"))
    below = numbers.select(F.col("stem").alias("__slug"), (F.col("t") - F.row_number().over(Window.partitionBy("stem").orderBy("t"))).alias("__at"), F.lit(1).alias("__step"))
    wanted = rows.where("__k > 0").withColumns({"__at": F.col("__k"), "__step": F.lit(0)})
    # The k-th upload comes after every taken number with fewer than k free ones below it.
    order = Window.partitionBy("__slug").orderBy("__at", "__step").rowsBetween(Window.unboundedPreceding, 0)
    numbered = wanted.unionByName(below, allowMissingColumns=True).withColumn("__n", F.col("__at") + F.sum("__step").over(order)).where("__step = 0")
    numbered = numbered.select(*uploads.columns, F.concat_ws("-", "__slug", F.col("__n").cast("string")).alias("paper_id"))
    return rows.where("__k = 0").select(*uploads.columns, F.col("__slug").alias("paper_id")).unionByName(numbered)


def queue_snapshot(papers: DataFrame) -> DataFrame:
    return papers.groupBy("status").agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"))


def active_papers(papers: DataFrame, statuses: tuple[str, ...] = ("uploaded", "processing")) -> DataFrame:
    """Papers that wait or are worked on, newest first; those without a time come last."""
    return papers.where(F.col("status").isin(*statuses)).orderBy(F.desc_nulls_last("updated_at"), "paper_id")
