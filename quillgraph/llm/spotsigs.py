"""Document fingerprints by SpotSigs. DataFrame functions only.

A spot is a common word (an anchor); its signature is the chain of the next CHAIN content words. The set of
a document's signatures is its fingerprint, likeness is the Jaccard coefficient. Sets whose sizes
differ too much can't be alike, so documents are partitioned by set size and compared within a
partition and the next one; within those, only documents that share one of their rarest signatures
are compared at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, shuffle_width

CHAIN = 2
#: A stretch of so many words without an anchor (a list, another language) has its runs of neighbouring words as signatures.
STRETCH = 24
#: Hexadecimal digits of a signature in a fingerprint.
DIGITS = 8
# Common words that serve as anchors.
ANCHORS = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"),
    "de": ("auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"),
    "fr": ("au", "aux", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
    "es": ("al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"),
}
_FIRST = -(1 << 63)


def _anchor_words() -> list[str]:
    return sorted({w for words in ANCHORS.values() for w in words})


def signature_set(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of a text, as 32-bit integers.

    Words are runs of letters and digits in lower case. A stretch of STRETCH words
    and more without an anchor adds its runs of `chain` neighbouring words. Where that leaves nothing,
    every such run is taken, of a shorter text its words together; no words give an empty set. Null
    counts as empty.
    """
    anchors = _anchor_words()
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _let(words, lambda ws: _signatures(ws, anchors, chain))


def _let(value: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _signatures(words: Column, anchors: list[str], chain: int) -> Column:
    # The anchor with j others before it, at word p, has p - j content words before it: its chain starts there.
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i)), lambda p: p.isNotNull())
    parts = F.struct(F.filter(words, lambda w: ~w.isin(anchors)).alias("content"), spots.alias("spots"), F.size(words).alias("n"))
    none = F.array().cast("array<int>")

    def runs(starts: Column) -> Column:
        return F.transform(starts, lambda k: _hash([F.get(words, k + i) for i in range(chain)]))

    def chosen(s: Column) -> Column:
        content, last = s["content"], F.size(s["content"]) - chain
        starts = F.filter(F.array_distinct(F.transform(s["spots"], lambda p, j: p - j)), lambda k: k <= last)
        by_spot = F.transform(starts, lambda k: _hash([F.get(content, k + i) for i in range(chain)]))
        before, after = F.concat(F.array(F.lit(-1)), s["spots"]), F.concat(s["spots"], F.array(s["n"]))
        stretches = F.zip_with(before, after, lambda a, b: F.when(b - a > STRETCH, F.sequence(a + 1, b - chain)).otherwise(none))
        return F.concat(by_spot, runs(F.flatten(stretches)))

    def helped(found: Column) -> Column:
        every = runs(F.sequence(F.lit(0), F.size(words) - chain))
        whole = F.array(_hash([F.array_join(words, " ")]))
        return F.when(F.size(found) > 0, found).when(F.size(words) >= chain, every).when(F.size(words) > 0, whole).otherwise(none)

    return F.sort_array(F.array_distinct(_let(_let(parts, chosen), helped)))


def _hash(words: list[Column]) -> Column:
    """32 bits of the words' hash, as a signed integer."""
    h = F.xxhash64(*words)
    return (F.shiftrightunsigned(h, 32) - F.lit(1 << 31)).cast("int")


def fingerprint(signatures: Column) -> Column:
    """The set as a string: its signatures in order, DIGITS hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s.cast("long") + F.lit(1 << 31)), DIGITS, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets; 0 without comparing them if their sizes alone keep it below `least`.

    Two empty sets are alike (1), an empty one and another are not (0).
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < large * F.lit(least)), 0.0).otherwise(shared / (small + large - shared))


def size_partition(size: Column, threshold: float) -> Column:
    """Partition of a set size: sets at least `threshold` alike are in the same partition or neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(math.log(1 / threshold)) + F.lit(1e-9)).cast("int")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`a, b, likeness` over fingerprint classes at least `threshold` alike (a < b, each named by its least id).

    Documents with equal fingerprints are one class. A class is looked up under its rarest signatures
    only - so many that two alike sets must share one of them - and in its own partition of set sizes
    and the next larger one. Documents without a word, or whose class has no id, have no pairs.
    """
    sets = docs.select(F.col(id_col).cast("long").alias("id"), signature_set(F.col(text_col)).alias("sigs")).where(F.size("sigs") > 0)
    classes = checkpointed(sets.groupBy("sigs").agg(F.min("id").alias("id")).where("id is not null"))
    listed = classes.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = listed.groupBy("sig").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "sig")
    prefix = listed.join(rarity, "sig").withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1)
    prefix = prefix.where("df > 1").select("id", "n", "sig", size_partition(F.col("n"), threshold).alias("part"))
    other = prefix.select(F.col("id").alias("other"), F.col("n").alias("m"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    met = prefix.join(other, ["sig", "part"]).where("id <> other and n <= m").where(F.col("n") >= F.col("m") * threshold)
    met = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    left, right = classes.select(F.col("id").alias("a"), F.col("sigs").alias("s")), classes.select(F.col("id").alias("b"), F.col("sigs").alias("t"))
    scored = met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("s"), F.col("t"), threshold).alias("likeness"))
    return scored.where(F.col("likeness") >= threshold)


def next_keys(keys: DataFrame) -> DataFrame:
    """`key, next`: for each distinct key the next smaller one; after the smallest comes the largest.

    Keys are dealt by range, numbered within their range, and the ends of the ranges - one row for each -
    are joined up, so no task sorts all keys.
    """
    ranges = max(1, shuffle_width(keys.sparkSession))
    dealt = checkpointed(keys.select("key").distinct().repartitionByRange(ranges, F.col("key").desc()).select("key", F.spark_partition_id().alias("part")))
    inside = dealt.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy(F.col("key").desc())))
    # As many rows as ranges: small enough for one task.
    heads = dealt.groupBy("part").agg(F.max("key").alias("head"))
    whole = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(whole), F.first("head").over(whole)).alias("head"))
    return inside.join(F.broadcast(heads), "part").select("key", F.coalesce("next", "head").alias("next"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next` for every document.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the
    next document's (descending doc_id; after the last comes the first). Null texts count as empty; a
    null doc_id counts as the smallest of all. Rows that repeat a doc_id each get a row; as the next
    document the text with the least hash stands for them. An only document is its own next. Other columns
    are not read; an empty table gives an empty table.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    texts = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # Signatures are found once, before the texts are dealt by key; both joins below read that one shuffle,
    # and Spark can split a key that very many rows have, as neither join is by the text.
    base = texts.select("key", "text", signature_set(F.col("text")).alias("sigs"))
    third = F.floor(F.length("text") / 3).cast("int")
    wanted = checkpointed(texts.groupBy("key").agg(F.max(third).alias("third"), F.min(F.xxhash64("text")).alias("least")))
    links = next_keys(wanted).join(wanted.select("key", "third"), "key").select(F.col("key").alias("owner"), F.col("next").alias("key"), "third")
    picked = links.join(wanted.select("key", "least"), "key")
    # Of the rows that share a key the text with the least hash is lent. Not written as an equality, which would deal the texts anew.
    own = F.xxhash64("text")
    lent = base.join(picked, (base["key"] == picked["key"]) & (own >= F.col("least")) & (own <= F.col("least")))
    lent = lent.select(F.col("owner").alias("key"), F.expr("substring(text, 1, third)").alias("lent"), F.col("sigs").alias("next_sigs"))
    lent = lent.groupBy("key").agg(F.first("lent").alias("lent"), F.first("next_sigs").alias("next_sigs"))
    joined = base.join(lent, "key").withColumn("n", F.length("text"))
    edited = joined.withColumn("edited", F.expr("concat(substring(text, 1, n - cast(floor(n / 3) as int)), substring(lent, 1, cast(floor(n / 3) as int)))"))
    sets = edited.select("key", "n", "next_sigs", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sigs", signature_set(F.col("edited")).alias("edited_sigs"))
    return sets.select(
        F.when(F.col("key") != _FIRST, F.col("key")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
