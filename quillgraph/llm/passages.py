"""Repeated passages by hashing of lines and of units within them.

Whole lines of LINE_WORDS words and more are units. Passages that are pasted into the middle of a line
have no line of their own, so lines are cut into pieces too: a word ends a piece if its hash is the least
of the words within REACH of it, so the same passage falls into the same pieces wherever it stands, but
for REACH words at its ends and what they cut off. Digests of normalised units (lower case, white space
dropped) are grouped globally; the earliest occurrence by (doc_id, place in the document) is kept and all
others go: lines by themselves, pieces where they add up to MIN_WORDS in a row. Offsets are those of the
original text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A piece ends at a word whose hash is the least of so many words on either side, or after MAX_UNIT words.
REACH, MAX_UNIT = 3, 32
#: A passage of 50 words loses the pieces at its ends, which it shares with its surroundings; so many words remain of almost all.
MIN_WORDS = 28
#: Lines with fewer words are no passage by themselves; such repeated lines are what line dedup is for.
LINE_WORDS = 20
_LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_BACK = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_SECOND_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LINE = np.uint64(0xA5A5A5A55A5A5A5A)
_powers: dict[int, np.ndarray] = {}


@functools.cache
def _folded() -> np.ndarray:
    """Code points in lower case; white space is 0."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        if c.isspace():
            table[i] = 0
        elif len(low := c.lower()) == 1:
            table[i] = ord(low)
    return table


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << n.bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def _spans_hash(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: np.uint64, back: np.uint64) -> np.ndarray:
    """Hash of values[start:stop] for each span: equal spans have equal hashes wherever they stand."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    h = (sums[stop] - sums[start]) * _power(back, len(values) + 1)[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _local_least(h: np.ndarray) -> np.ndarray:
    """Whether each hash is less than those of the REACH words before it and not more than those of the REACH after it."""
    n = len(h)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    wide = np.concatenate([np.full(REACH, most), h, np.full(REACH, most)])
    least = np.ones(n, dtype=bool)
    for k in range(REACH):
        least &= (h < wide[k : k + n]) & (h <= wide[REACH + 1 + k : REACH + 1 + k + n])
    return least


def _stops(hashes: np.ndarray, ends_line: np.ndarray) -> np.ndarray:
    """Ends of the pieces of a text's words: at the end of each line, at local least hashes, and after MAX_UNIT words."""
    cuts = np.flatnonzero(ends_line | _local_least(hashes)) + 1
    sizes = np.diff(cuts, prepend=0)
    if sizes.max() <= MAX_UNIT:
        return cuts
    extra = [np.arange(c - n + MAX_UNIT, c, MAX_UNIT) for c, n in zip(cuts[sizes > MAX_UNIT].tolist(), sizes[sizes > MAX_UNIT].tolist())]
    return np.unique(np.concatenate([cuts, *extra]))


_UNITS = "id long, version long, line boolean, digest long, second int, unit int, start int, end int, words int, again boolean"
_TYPES = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())


def units(text: str | None, line_words: int = LINE_WORDS) -> list[np.ndarray]:
    """Columns `line, digest, second, unit, start, end, words, again` of the pieces of a text, then of its lines of `line_words` words.

    second is 31 bits of a digest with another base; again is true where the text holds the same unit before.
    """
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _folded()[raw].astype(np.uint64)
    word = np.concatenate([[0], codes != 0, [0]]).astype(np.int8)
    edge = np.diff(word)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return [np.zeros(0, dtype=np.int64)] * 8
    with np.errstate(over="ignore"):
        hashes = _spans_hash(codes, first, last, _BASE, _BACK)
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])
        ends_line = np.append(breaks[first[1:]] != breaks[last[:-1]], True)
        stop = _stops(hashes, ends_line)
        start = np.concatenate([[0], stop[:-1]])
        line_stop = np.flatnonzero(ends_line) + 1
        line_start = np.concatenate([[0], line_stop[:-1]])
        long = line_stop - line_start >= line_words
        is_line = np.repeat([False, True], [len(stop), long.sum()])
        start, stop = np.concatenate([start, line_start[long]]), np.concatenate([stop, line_stop[long]])
        digest = _spans_hash(hashes, start, stop, _WORD, _WORD_BACK) ^ np.where(is_line, _LINE, np.uint64(0))
        second = _spans_hash(hashes ^ _SECOND, start, stop, _SECOND, _SECOND_BACK) >> np.uint64(33)
    seen = np.unique(digest, return_index=True, return_inverse=True)
    again = seen[1][seen[2]] != np.arange(len(digest))
    return [is_line, digest.view(np.int64), second.view(np.int64), np.arange(len(stop)), first[start], last[stop - 1], stop - start, again]


def _unit_batches(line_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in _UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [units(t.as_py(), line_words) for t in batch.column(2)]
            rows = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            columns = [pa.array(np.concatenate([g[k] for g in got]).astype(t.to_pandas_dtype()), t) for k, t in enumerate(_TYPES)]
            table = pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names)
            # A batch of long texts has many times the rows it came with; hand them on in parts.
            yield from (table.slice(a, 1 << 17) for a in range(0, max(1, table.num_rows), 1 << 17))

    return run


def _units_of(docs: DataFrame, line_words: int) -> DataFrame:
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("version"), "text")
    return source.mapInArrow(_unit_batches(line_words), _UNITS)


def _passages(docs: DataFrame, min_words: int, line_words: int) -> DataFrame:
    """`id, version, start, end, words, kept`: passages of which an earlier occurrence is kept, none overlapping another."""
    seen = _units_of(docs, line_words).groupBy("digest", "second").agg(F.min("id").alias("kept"), F.max("id").alias("last")).where("kept <> last").select("digest", "second", "kept")
    # A unit goes if a smaller id holds it, or its own document does before.
    later = _units_of(docs, line_words).join(seen, ["digest", "second"], "left").where("again or id <> kept").withColumn("kept", F.coalesce("kept", "id"))
    # Rows that repeat a doc_id and text bring the same units; one of each goes on, so that however many they are no task gets them all.
    later = later.dropDuplicates(["id", "version", "unit"])
    # Pieces are numbered before lines; pieces next to each other make a run, a line is one of its own.
    order = Window.partitionBy("id", "version").orderBy("unit")
    runs = later.withColumn("run", F.when(F.col("line"), -1 - F.col("unit")).otherwise(F.col("unit") - F.row_number().over(order)))
    found = runs.groupBy("id", "version", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").alias("words"),
        F.min("kept").alias("kept"),
        F.max("line").alias("line"),
    )
    found = found.where(F.col("line") | (F.col("words") >= min_words)).select("id", "version", "start", "end", "words", "kept")
    # What overlaps - a line and a run of pieces in it - is one passage.
    place = Window.partitionBy("id", "version").orderBy("start", "end")
    joined = found.withColumn("before", F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    joined = joined.withColumn("fresh", F.when(F.col("before").isNull() | (F.col("start") >= F.col("before")), F.col("words")).otherwise(0))
    joined = joined.withColumn("passage", F.sum((F.col("fresh") > 0).cast("int")).over(place))
    return joined.groupBy("id", "version", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("words"), F.min("kept").alias("kept")).drop("passage")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """`doc_id, start, end, words, kept_doc_id` for each passage that a document loses.

    A passage is a whole line of `line_words` words and more, or `min_words` words in a row of shorter
    pieces, that occurs earlier: in a document with a smaller id, or before in the same document (then
    kept_doc_id is its own id). start and end are code points of the original text; words are those of the
    longest line or run in the passage. Null and empty texts have no passages; a null doc_id ranks last,
    and rows with one and the same doc_id don't count as different documents. Other columns are not read;
    an empty table gives no rows.
    """
    found = _passages(docs, min_words, line_words)
    return found.select(
        F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"),
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        "words",
        F.when(F.col("kept") != _LAST, F.col("kept")).alias("kept_doc_id"),
    )


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """Documents with `text` without the passages, and `removed`: their (start, end) in the original text.

    Every row stays; null and empty texts lose nothing and have an empty `removed`; rows that repeat a
    doc_id and text lose the same. A column `removed` that the table has is replaced.
    """
    docs = docs.drop("removed")
    spans = _passages(docs, min_words, line_words).groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__removed"))
    spans = spans.select(F.col("id").alias("__id"), F.col("version").alias("__version"), "__removed")
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))
    joined = docs.join(spans, (own == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__version")), "left")
    # What lies between the removed spans, in order.
    none = F.array().cast("array<struct<start:int,end:int>>")
    removed = F.coalesce("__removed", none)
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["end"]))
    stops = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.length(docs["text"])))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: docs["text"].substr(p["a"] + 1, p["b"] - p["a"])), "")
    text = F.when(F.size(removed) > 0, kept).otherwise(docs["text"])
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], removed.alias("removed"))
