"""Near-duplicate lines by a segment-partition edit join. DataFrame functions only.

Two lines within K edits: cut the shorter into K + 1 segments and at least one of them is in the longer
one unchanged, close to where it was. Every distinct line names its segments by (length, number, text)
and the substrings that can be a segment of a line near it; two lines that share such a name are
candidates, which a banded bit-parallel edit distance verifies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed

MAX_EDITS = 2
#: Characters of the shorter line for each edit that is allowed, up to MAX_EDITS.
CHARS_PER_EDIT = 20
#: Frequent letters whose counts are compared before a pair becomes a candidate (8 at most).
COUNTED = "eantiors"
#: Most hashes of candidate lines (8 bytes each) that are broadcast to pick out their texts.
BROADCAST_LINES = 1_000_000
_LAST = (1 << 63) - 1


def folded(line: Column) -> Column:
    """The line as bytes, one for each character: those beyond ASCII become one and the same, which keeps near lines near."""
    plain = F.octet_length(line) == F.length(line)
    return F.when(plain, line).otherwise(F.regexp_replace(line, r"[^\x00-\x7F]", "?")).cast("binary")


def budget(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Edits allowed between two lines: one for every CHARS_PER_EDIT characters of the shorter one, `edits` at most."""
    return F.least(F.lit(edits), (F.least(F.length(a), F.length(b)) / CHARS_PER_EDIT).cast("int"))


def same_numbers(a: Column, b: Column) -> Column:
    """Whether two lines have the same digits in the same order: lines that differ in a number say different things."""
    return F.regexp_replace(a, "[^0-9]", "") == F.regexp_replace(b, "[^0-9]", "")


def name_shapes(edits: int) -> list[tuple[int, int, int, int]]:
    """(own, shorter, segment, shift) of each name of a line.

    Own names are the line's segments. The others are the substrings that can be a segment of a line
    shorter by 0 to `edits` characters: segment i of that begins at p; edits before it are at most i from
    the left view and edits - i from the right view, which bounds the shift (multi-match-aware). Of two
    lines of one length each is the other's shorter one: what moves left from here moves right from there,
    so substrings moved to the right are enough, and those in place are the own segments.
    """
    shapes = [(1, 0, i, 0) for i in range(edits + 1)]
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low = max(-i, shorter - (edits - i), -((edits - shorter) // 2))
            high = min(i, shorter + (edits - i), (edits + shorter) // 2)
            shapes += [(0, shorter, i, shift) for shift in range(low if shorter else 1, high + 1)]
    return shapes


def banded_edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most `edits`, else null.

    The longer string runs down, the shorter across. Vertical differences of the 2 * edits + 1 cells
    around the diagonal are two bit vectors that move down a row with each column; the score is followed
    along the diagonal that ends in the last cell. Null if either string is null.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    long_first = F.length(a) >= F.length(b)
    chars = F.struct(
        F.split(F.when(long_first, a).otherwise(b), "").alias("down"),
        F.split(F.when(long_first, b).otherwise(a), "").alias("across"),
        F.abs(F.length(a) - F.length(b)).alias("gap"),
        F.least(F.length(a), F.length(b)).alias("n"),
    )
    none = F.array().cast("array<int>")
    close = F.abs(F.length(a) - F.length(b)) <= edits
    found = F.transform(
        F.array(chars),
        lambda c: F.aggregate(
            F.when(c["n"] > 0, F.sequence(F.lit(1), c["n"])).otherwise(none),
            _start(c["gap"], edits, full),
            # The score never falls along its diagonal: beyond the edits allowed the rest is skipped.
            lambda acc, j: F.when(acc["d"] > edits, acc).otherwise(_column(c, acc, j, edits, width, full)),
            lambda acc: acc["d"],
        ),
    )[0]
    d = F.when(close, found)
    return F.when(d <= edits, d)


def _let(value: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _start(gap: Column, edits: int, full: int) -> Column:
    # Rows above the first have no vertical difference, rows from the first on have +1.
    return F.struct(F.lit((full << edits) & full).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), gap.cast("long").alias("d"))


def _column(c: Column, acc: Column, j: Column, edits: int, width: int, full: int) -> Column:
    """The vectors and the score after one more character of the shorter string."""
    char, x = F.get(c["across"], j - 1), F.lit(0).cast("long")
    for bit in range(width):
        x = x + F.when(F.get(c["down"], j + (bit - edits - 1)) == char, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    vp, vn = acc["vp"], acc["vn"]

    def zero_diagonals(x: Column) -> Column:
        return (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

    def moved_down(d0: Column) -> Column:
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(full))
        lower = F.shiftright(d0, 1)
        on_path = F.call_function("shiftright", d0, (c["gap"] + edits).cast("int")).bitwiseAND(F.lit(1))
        return F.struct(
            d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(lower.bitwiseOR(hp))).bitwiseAND(F.lit(full)).cast("long").alias("vp"),
            lower.bitwiseAND(hp).cast("long").alias("vn"),
            (acc["d"] + 1 - on_path).cast("long").alias("d"),
        )

    return _let(zero_diagonals(x), moved_down)


def _occurrences(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank, trimmed of blanks, with document, number of line and rank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    rank = F.coalesce("doc_id", F.lit(_LAST)).cast("decimal(38,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("line_no")
    return rows.select("doc_id", "version", "line_no", "line", rank.cast("decimal(38,0)").alias("rank"))


def letter_counts(line: Column) -> Column:
    """How often each of the COUNTED letters occurs, a byte each (modulo 256)."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(COUNTED):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(255)), 8 * i))
    return out


def counts_allow(a: Column, b: Column, edits: int) -> Column:
    """Whether lines with these counts can be within `edits` edits: one edit raises one count at most and lowers one."""
    up = down = F.lit(0).cast("long")
    for i in range(len(COUNTED)):
        d = F.pmod(F.shiftright(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(b, 8 * i).bitwiseAND(F.lit(255)), F.lit(256))
        up = up + F.when(d < 128, d).otherwise(0)
        down = down + F.when(d >= 128, 256 - d).otherwise(0)
    return (up <= edits) & (down <= edits)


def _names(lines: DataFrame, edits: int) -> DataFrame:
    """`key, h, counts, own` for each name of each distinct line; own is 1 for its segments, 0 for what it only probes."""
    counts = F.col("counts") if "counts" in lines.columns else letter_counts(F.col("line"))
    known = lines.select(folded(F.col("line")).alias("b"), F.xxhash64("line").alias("h"), F.length("line").alias("n"), counts.alias("counts")).where(F.col("n") > edits)
    # One expression for all shapes: generated code stays small enough to be compiled.
    shapes = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(shape, ("own", "shorter", "i", "shift"))]) for shape in name_shapes(edits)])
    listed = known.select("b", "h", "n", "counts", F.explode(shapes).alias("s")).select("b", "h", "n", "counts", "s.*")
    parts = edits + 1
    listed = listed.withColumn("other", F.col("n") - F.col("shorter")).withColumn("base", (F.col("other") / parts).cast("int"))
    # The last segments are one character longer if need be.
    listed = listed.withColumn("longer", F.col("other") - F.col("base") * parts)
    start = F.col("base") * F.col("i") + F.greatest(F.lit(0), F.col("longer") - (parts - F.col("i"))) + 1 + F.col("shift")
    size = F.col("base") + (F.col("i") >= F.lit(parts) - F.col("longer")).cast("int")
    listed = listed.select("b", "h", "n", "counts", "own", "other", "i", start.alias("at"), size.alias("size")).where("at >= 1 and at + size - 1 <= n")
    key = F.xxhash64("other", "i", F.col("b").substr(F.col("at"), F.col("size")))
    return listed.select(key.alias("key"), "h", "counts", F.col("own").cast("byte").alias("own"))


def candidates(lines: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """`x, y`: hashes of each two of the distinct lines (column `line`) of which one holds a segment of the other; x < y.

    Pairs whose letter counts alone put them more than `edits` apart are left out within the join, so many
    versions of one line, which share most of their segments, don't all become candidates of each other.
    Both sides of the join are one and the same shuffle.
    """
    names = _names(lines, edits)
    a, b = names.alias("a"), names.alias("b")
    # Two own segments meet once, an own segment and a probe from the segment's side.
    met = ((F.col("a.own") > F.col("b.own")) & (F.col("a.h") != F.col("b.h"))) | ((F.col("a.own") + F.col("b.own") == 2) & (F.col("a.h") < F.col("b.h")))
    alike = (F.col("a.key") == F.col("b.key")) & met & counts_allow(F.col("a.counts"), F.col("b.counts"), edits)
    return a.join(b, alike).select(F.least("a.h", "b.h").alias("x"), F.greatest("a.h", "b.h").alias("y")).distinct()


def verified(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """`a, b, distance` of the candidates within `edits` edits, by the lines' texts; a < b."""
    text = texts.select(F.xxhash64("line").alias("h"), "line")
    pairs = met.join(text.select(F.col("h").alias("x"), F.col("line").alias("s")), "x").join(text.select(F.col("h").alias("y"), F.col("line").alias("t")), "y")
    pairs = pairs.withColumn("distance", banded_edit_distance(F.col("s"), F.col("t"), edits)).where("distance is not null")
    return pairs.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "distance")


def near_lines(lines: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """`a, b, distance` for each two of the distinct lines (column `line`) within `edits` edits; a < b.

    Lines must be longer than `edits` characters; shorter and null ones have no links.
    """
    return verified(candidates(lines, edits), lines, edits)


def _marked(docs: DataFrame, edits: int) -> DataFrame:
    """Lines of which occurrences go: two hashes, the first rank, whether an earlier line is near, links."""
    occurrences = _occurrences(docs)
    # Letters are counted once, before the lines are dealt out: both sides of the join read that shuffle.
    # Shorter lines have a budget of no edits.
    lines = occurrences.where(F.length("line") >= CHARS_PER_EDIT).groupBy("line", letter_counts(F.col("line")).alias("counts")).agg(F.count("*").alias("copies"))
    met = checkpointed(candidates(lines, edits))
    # The texts of candidates alone are fetched again; the rest of the work is on hashes.
    wanted = met.select(F.explode(F.array("x", "y")).alias("h")).distinct()
    small = met.count() * 2 <= BROADCAST_LINES
    texts = occurrences.join(F.broadcast(wanted) if small else wanted, F.xxhash64("line") == F.col("h"), "left_semi")
    texts = checkpointed(texts.groupBy("line").agg(F.min("rank").alias("first")))
    links = verified(met, texts, edits).where((F.col("distance") <= budget(F.col("a"), F.col("b"), edits)) & same_numbers(F.col("a"), F.col("b")))
    ends = links.select(F.col("a").alias("line"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("line"), F.col("a").alias("other")))
    ends = ends.join(texts, "line").join(texts.select(F.col("line").alias("other"), F.col("first").alias("other_first")), "other")
    near = ends.groupBy("line").agg(F.count("*").alias("links"), F.max(F.col("other_first") < F.col("first")).alias("late"))
    near = near.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "links", "late")
    lines = _hashed(occurrences).groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.count("*").alias("copies"))
    out = lines.join(near, ["h1", "h2"], "left").where("copies > 1 or links > 0")
    return out.select("h1", "h2", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("late", F.lit(False)).alias("late"))


def _hashed(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("doc_id", "version", "line_no", "rank", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _decisions(docs: DataFrame, edits: int) -> DataFrame:
    # Cut here, both sides of the join come straight from a shuffle, and Spark can split a line that
    # very many documents hold.
    met = _hashed(_occurrences(docs)).join(checkpointed(_marked(docs, edits)), ["h1", "h2"])
    gone = F.col("late") | (F.col("rank") != F.col("first"))
    return met.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.when(gone, F.col("line_no")))).alias("removed"),
        F.max("copies").alias("most_copies"),
        F.sum("links").alias("links"),
    )


def line_duplicates(docs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """`doc_id, n_lines, removed_lines, n_links, most_copies` for every document.

    removed_lines are the numbers (from 0) of lines that go: all occurrences of a line but the first by
    (doc_id, line number), and all occurrences of a line that is near an earlier line: of one edit for every
    CHARS_PER_EDIT characters of the shorter line, `edits` at most, and with the same digits. Lines are
    compared without the blanks around them; blank lines stay.
    n_links counts links of the document's lines to different lines. A null text has no lines; a null
    doc_id ranks last; rows that repeat a doc_id and text share one decision. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"), F.col("text").isNull().alias("none"))
    got = _decisions(docs, edits)
    joined = base.join(got.withColumnRenamed("doc_id", "d").withColumnRenamed("version", "v"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("none"), 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("most_copies", F.lit(1)).cast("long").alias("most_copies"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """An array without the elements at the sorted positions `gone`: the slices between those, so it takes one pass."""
    parts = F.struct(lines.alias("all"), F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1)).alias("from"), F.concat(gone, F.array(F.size(lines))).alias("to"))
    cut = lambda p: F.flatten(F.zip_with(p["from"], p["to"], lambda a, b: F.slice(p["all"], a + 1, b - a)))
    return F.transform(F.array(parts), cut)[0]


def remove_duplicate_lines(docs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """Documents with the lines that `line_duplicates` names taken out of `text`; every row stays, n_chars is renewed if there is one.

    Null and empty texts stay as they are; rows that repeat a doc_id and text lose the same lines.
    """
    got = _decisions(docs, edits).where(F.size("removed") > 0).select(F.col("doc_id").alias("__d"), F.col("version").alias("__v"), F.col("removed").alias("__gone"))
    joined = docs.join(got, docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__v")), "left")
    kept = _without(F.split(docs["text"], "\n", -1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.length(text).cast("long").alias("n_chars") if c == "n_chars" else docs[c] for c in docs.columns]
    return joined.select(*columns)
