"""Reading and writing parsed documents and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARSED = "type string, doc_id string, element_id string, section string, content string, content_hash string, start_char long, end_char long, title string, year int, venue string, doi string"


def read_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Papers and elements from tagged JSON lines."""
    rows = spark.read.schema(PARSED).json(path)
    return rows.where("type = 'paper_metadata'").select("doc_id", "title", "year", "venue", "doi"), rows.where("type = 'parsed_element'").select("doc_id", "element_id", "section", "content", "content_hash", "start_char", "end_char")


BUCKETS = 64


def write_parsed(papers: DataFrame, elements: DataFrame, path: str) -> None:
    """Papers and elements as tagged JSON lines; a document is in one of BUCKETS folders, so that many small ones share files."""
    tagged = papers.withColumn("type", F.lit("paper_metadata")).unionByName(elements.withColumn("type", F.lit("parsed_element")), allowMissingColumns=True)
    tagged = tagged.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    tagged.repartition("part").write.mode("overwrite").partitionBy("part").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType | str, last: int | None = None, order: str = "ts") -> DataFrame:
    """Rows of a JSON-lines log; blank, malformed and non-object lines are skipped; the `last` ones by time if asked."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    # A line that is valid JSON but no object leaves every field null.
    rows = rows.where(F.coalesce(*[F.col(c).isNotNull() for c in [order]], F.lit(False)))
    return rows if last is None else rows.orderBy(F.desc(order)).limit(last).orderBy(order)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines with sorted keys and times in UTC."""
    times = [c for c, t in rows.dtypes if t.startswith("timestamp")]
    for c in times:
        rows = rows.withColumn(c, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def encode_sections(sections):
    """A map as sorted names and counts, without empty names and counts that aren't positive."""
    entries = F.array_sort(F.map_entries(F.map_filter(sections, lambda k, v: (k != "") & (v > 0))))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("names"), F.transform(entries, lambda e: e["value"]).alias("counts"))


def decode_sections(names, counts):
    return F.map_filter(F.map_from_arrays(names, counts), lambda k, v: (k != "") & (v > 0))


EVIDENCE = "struct<element_id:string,doc_id:string,text_span:struct<start:int,end:int>,start:int,end:int,full_sentence:string>"


def encode_evidence(evidence):
    return F.to_json(evidence)


def decode_evidence(text):
    """Evidence with a nested span or flat start and end; null if it can't be read."""
    e = F.from_json(text, EVIDENCE)
    return F.when(e["element_id"].isNotNull(), F.struct(e["element_id"].alias("element_id"), e["doc_id"].alias("doc_id"), F.coalesce(e["text_span"]["start"], e["start"]).alias("start"), F.coalesce(e["text_span"]["end"], e["end"]).alias("end"), e["full_sentence"].alias("full_sentence")))


def encode_attributes(attributes):
    """A map of attributes as a JSON object with its keys in order; empty keys and null values are left out."""
    kept = F.map_filter(attributes, lambda k, v: (k != "") & v.isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def decode_attributes(text):
    """Attributes from a JSON object; whatever can't be read is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def parse_text_log(lines: DataFrame) -> DataFrame:
    """Lines that carry a `yyyy-MM-dd HH:mm:ss,SSS` stamp: `ts, message`; others are dropped."""
    stamp = F.regexp_extract("value", "([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3})", 1)
    parsed = lines.select(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"), F.trim(F.regexp_replace("value", "^.*[0-9]{2},[0-9]{3}", "")).alias("message"))
    return parsed.where("ts is not null")


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_text_log(spark.read.text(path))
