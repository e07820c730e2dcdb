"""Elements and paper metadata from converted text items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import config


def clean_items(items: DataFrame) -> DataFrame:
    """`orig`, where there is one, else `text`, trimmed; blank items and labels other than text and section_header go."""
    text = F.coalesce(F.col("orig"), F.col("text")) if "orig" in items.columns else F.col("text")
    return items.select("doc_id", "pos", "label", "page", F.trim(text).alias("text")).where((F.col("text") != "") & F.col("label").isin("text", "section_header"))


def build_elements(items: DataFrame) -> DataFrame:
    """Body items as elements: the section is the last header before, ids and offsets run through the document."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    header = F.col("label") == "section_header"
    marked = items.withColumn("section", F.coalesce(F.last(F.when(header, F.col("text")), ignorenulls=True).over(order), F.lit(config.AUTO_SECTION)))
    body = marked.where(~header)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    return body.select(
        "doc_id",
        F.concat_ws(":", "doc_id", (F.row_number().over(order) - 1).cast("string")).alias("element_id"),
        "section",
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
        start.cast("long").alias("start_char"),
        (start + F.length("text")).cast("long").alias("end_char"),
        "pos",
    )


def section_aliases(spark) -> DataFrame:
    """One row for each alias; of an alias that is listed twice the later section counts."""
    rows = {alias.lower(): section for section, aliases in config.SECTION_ALIASES for alias in aliases}
    return spark.createDataFrame([(a, s, i) for i, (a, s) in enumerate(rows.items())], "alias string, canonical string, rank int")


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / (len(a) + len(b))."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def normalise_sections(elements: DataFrame, fuzzy: float = config.SECTION_FUZZY) -> DataFrame:
    """`section` mapped to its canonical name: alias, else the first best alias with ratio `fuzzy` or more, else `_auto_`.

    Only headings that differ, and no alias matches, reach Python.
    """
    aliases = section_aliases(elements.sparkSession)
    headings = elements.select(F.col("section").alias("heading")).distinct()
    exact = headings.join(F.broadcast(aliases), F.lower(F.trim("heading")) == F.col("alias"), "left").select("heading", "canonical")
    known = [(a, s) for a, s in {alias.lower(): section for section, aliases in config.SECTION_ALIASES for alias in aliases}.items()]

    @F.pandas_udf("string")
    def nearest(names):
        def best(name):
            score, found = max(((indel_ratio(name.strip().lower(), a), -i), s) for i, (a, s) in enumerate(known))
            return found if score[0] >= fuzzy else None

        return names.map(best, na_action="ignore")

    missed = exact.where("canonical is null").select("heading", nearest("heading").alias("canonical"))
    mapped = exact.where("canonical is not null").unionAll(missed)
    mapped = mapped.select("heading", F.coalesce("canonical", F.lit(config.AUTO_SECTION)).alias("canonical"))
    joined = elements.join(mapped, elements["section"].eqNullSafe(F.col("heading")), "left")
    return joined.select(*[F.coalesce("canonical", F.lit(config.AUTO_SECTION)).alias(c) if c == "section" else elements[c] for c in elements.columns])


def paper_titles(items: DataFrame, not_titles: Sequence[str] = ("abstract",)) -> DataFrame:
    """The first header of each document that is not an abstract's."""
    heads = items.where((F.col("label") == "section_header") & ~F.lower(F.trim("text")).isin(*not_titles))
    return heads.groupBy("doc_id").agg(F.min_by("text", "pos").alias("title"))


_VENUE_CUT = r"(?i)(proceedings|conference|published|doi:|[0-9])"


def paper_authors(items: DataFrame, pages: int = config.METADATA_PAGES) -> DataFrame:
    """Names in the first run of body items that yield any, in order and without repeats."""
    body = items.where((F.col("label") == "text") & (F.col("page") <= pages) & ~F.lower("text").rlike("^(published|doi)"))
    cut = F.element_at(F.split("text", _VENUE_CUT + "|" + "|".join(config.KNOWN_VENUES), 2), 1)
    names = F.filter(F.transform(F.split(cut, r",|\band\b"), lambda s: F.trim(s)), lambda s: s.rlike(r"^[A-Z][a-z]+( [A-Z][a-z]+)+$"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    scored = body.select("doc_id", "pos", names.alias("names")).withColumn("hit", F.size("names") > 0)
    # The run goes on while neither its start nor a break after it lies behind.
    started = scored.withColumn("seen", F.max(F.col("hit").cast("int")).over(order)).withColumn("broken", F.max(F.when((F.col("seen") == 1) & ~F.col("hit"), 1).otherwise(0)).over(order))
    run = started.where("hit and broken = 0")
    return run.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "names"))), lambda s: s["names"]))).alias("authors"))


def paper_years(items: DataFrame) -> DataFrame:
    """The first item's year whose first 20[1-2]x is from 2015 to 2025."""
    found = items.select("doc_id", "pos", F.expr("try_cast(regexp_extract(text, '20[1-2][0-9]', 0) as int)").alias("year")).where("year between 2015 and 2025")
    return found.groupBy("doc_id").agg(F.min_by("year", "pos").alias("year"))


def paper_venues(items: DataFrame, venues: Sequence[str] = config.KNOWN_VENUES) -> DataFrame:
    """The venue of the first item that contains one; within an item by order of configuration."""
    known = items.sparkSession.createDataFrame([(v, i) for i, v in enumerate(venues)], "venue string, rank int")
    met = items.join(F.broadcast(known), F.contains("text", "venue"))
    return met.groupBy("doc_id").agg(F.min_by("venue", F.struct("pos", "rank")).alias("venue"))


def paper_dois(items: DataFrame) -> DataFrame:
    doi = items.select("doc_id", "pos", F.regexp_extract("text", r"10\.[0-9]{4,}/[^ ]+", 0).alias("doi")).where("doi <> ''")
    return doi.groupBy("doc_id").agg(F.min_by("doi", "pos").alias("doi"))


def validate_contracts(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds `broken`: the name of the first rule that a row breaks or leaves undecided, else null."""
    broken = F.lit(None).cast("string")
    for name, holds in reversed(list(rules)):
        broken = F.when(F.coalesce(holds, F.lit(False)), broken).otherwise(F.lit(name))
    return rows.withColumn("broken", broken)


def _filled(*columns: str) -> list[tuple[str, Column]]:
    return [(c, F.length(c) > 0) for c in columns]


def _span(start: str, end: str) -> list[tuple[str, Column]]:
    return [(start, F.col(start) >= 0), (end, F.col(end) > F.col(start))]


def element_rules() -> list[tuple[str, Column]]:
    return [
        ("doc_id", F.trim("doc_id") != ""),
        *_filled("element_id", "section", "content"),
        ("content_hash", F.col("content_hash").rlike("^[0-9a-f]{64}$")),
        *_span("start_char", "end_char"),
    ]


def evidence_rules() -> list[tuple[str, Column]]:
    return [*_filled("doc_id", "element_id"), *_span("span_start", "span_end")]


def triple_rules() -> list[tuple[str, Column]]:
    return [*_filled("src_text", "relation", "dst_text"), ("confidence", F.col("confidence").between(0, 1)), *evidence_rules(), *_filled("version")]


def node_rules() -> list[tuple[str, Column]]:
    return [*_filled("node_id", "name", "type"), ("times_seen", F.col("times_seen") >= 0)]


def edge_rules() -> list[tuple[str, Column]]:
    return [*_filled("src", "dst", "relation"), *evidence_rules(), ("confidence", F.col("confidence").between(0, 1)), *_filled("version"), ("created_at", F.col("created_at").isNotNull())]


def paper_rules() -> list[tuple[str, Column]]:
    """A year may be missing."""
    return [*_filled("doc_id"), ("year", F.col("year").isNull() | F.col("year").between(1900, 2100))]
