"""Export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import config


def export_edges(view: DataFrame, snippets: bool = True, chars: int = config.SNIPPET_CHARS) -> DataFrame:
    """Edges with their sentence cut to `chars` and marked, or without it."""
    cut = F.when(F.length("sentence") > chars, F.concat(F.rtrim(F.substring("sentence", 1, chars)), F.lit("..."))).otherwise(F.col("sentence"))
    return view.withColumn("sentence", cut if snippets else F.lit(None).cast("string"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`part, id, line`: node lines, then edge lines; written in order of (part, id)."""
    n = nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("id"), F.concat(F.lit('<node id="'), escaped(F.col("node_id")), F.lit('"><data key="name">'), escaped(F.col("name")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("edge_id").alias("id"), F.concat(F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('"><data key="relation">'), escaped(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return n.unionByName(e)


def write_graphml(lines: DataFrame, path: str, files: int = 8) -> None:
    """Text files whose names and rows are in order of (part, id)."""
    lines.repartitionByRange(files, "part", "id").sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)


def export_manifest(parts: DataFrame, version: str = "1", filters: str = "") -> DataFrame:
    """`part, rows, bytes, digest, version, filters` of exported lines `part, id, line`.

    The digest is the sum of 60 bits of each line's sha-256: it doesn't depend on the lines' order, counts
    repeated lines, and takes no task that holds a part. version and filters say what was exported.
    """
    each = parts.select("part", F.octet_length("line").alias("b"), F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("decimal(20,0)").alias("h"))
    summed = each.groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.col("b").cast("long")).alias("bytes"), F.sum("h").cast("string").alias("digest"))
    return summed.withColumn("version", F.lit(version)).withColumn("filters", F.lit(filters))


def share_records(sizes: DataFrame) -> DataFrame:
    """Size in MB of each share and whether it is warned about or blocked."""
    mb = F.col("bytes") / F.lit(1024.0 * 1024.0)
    return sizes.select("share_id", F.round(mb, 6).alias("mb"), F.when(mb > config.EXPORT_BLOCK_MB, "blocked").when(mb > config.EXPORT_WARN_MB, "warned").otherwise("ok").alias("state"))


def share_state(events: DataFrame, lifetime: int = 30, now: str | None = None) -> DataFrame:
    """`share_id, created_at, first_download_at, latency_s, downloads, revoked, expired` from create, download and revoke events.

    A share has expired if its last event, or `now` if given, is later than `lifetime` days after its creation.
    """

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("ts")))

    out = events.groupBy("share_id").agg(
        first("create").alias("created_at"),
        first("download").alias("first_download_at"),
        F.count_if(F.col("event_type") == "download").alias("downloads"),
        F.max(F.col("event_type") == "revoke").alias("revoked"),
        F.max("ts").alias("__last"),
    )
    seen = F.col("__last") if now is None else F.lit(now).cast("timestamp")
    out = out.withColumn("expired", F.coalesce(F.unix_micros(seen) > F.unix_micros("created_at") + lifetime * 86_400_000_000, F.lit(False))).drop("__last")
    latency = (F.unix_micros("first_download_at") - F.unix_micros("created_at")) / 1e6
    return out.withColumn("latency_s", F.round(F.when(latency >= 0, latency), 3))
