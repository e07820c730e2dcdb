"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items and documents are reduced to their letters and digits in lower case. An item is cut into
overlapping windows, so that every fragment of FRAGMENT letters holds a whole one; a window of n characters within e edits of a piece of text shares at least
n - q + 1 - e * q of its q-grams with it, on diagonals that differ by e at most. So q-gram hits are counted
for each window in overlapping bands of diagonals; bands that reach the bound are verified by banded
alignment with the text around them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 9
WINDOW, STRIDE = 80, 20
#: The shortest piece of a longer item that counts as a leak, wherever it starts.
FRAGMENT = WINDOW + STRIDE - 1
ERROR_RATE = 0.08
#: Letters of the benchmark that are indexed and broadcast at once; a larger benchmark is taken in blocks.
BLOCK_LETTERS = 4_000_000
_BITS = 22
_BASE = np.uint64(1_000_003)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TEXT_BLOCK = 1 << 20
#: Hits (a q-gram of the text and a place in a window) that are held at once.
_HITS = 1 << 21


@functools.cache
def _fold() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter or digit, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letters(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters and digits of a text, and where each stands in it."""
    codes = _fold()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    at = np.flatnonzero(codes)
    return codes[at], at


def _qgrams(s: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position, by doubling."""
    if len(s) < Q:
        return np.zeros(0, dtype=np.uint64)
    parts, width, h, scale, done = [], 1, s.astype(np.uint64), _BASE, 0
    with np.errstate(over="ignore"):
        while width <= Q:
            if Q & width:
                parts.append((h, width, scale))
            if 2 * width <= Q:
                h = h[:-width] * scale + h[width:]
            scale, width = scale * scale, 2 * width
        n = len(s) - Q + 1
        out = np.zeros(n, dtype=np.uint64)
        for h, width, scale in parts:
            out = out * scale + h[done : done + n]
            done += width
        return out * _MIX


def edit_budget(n: int) -> int:
    """Edits allowed in n characters: the error rate, and no more than leaves a q-gram to be shared."""
    return max(0, min(int(n * ERROR_RATE), (n - Q) // Q))


@dataclass(frozen=True)
class Index:
    """Windows of the benchmark and their q-grams, grouped by hash; `bitmap` says which hashes can occur."""

    items: list[int]
    windows: list[np.ndarray]
    #: Distinct hashes, the first entry of each and after the last, and the narrowest band of a window that has it.
    hashes: np.ndarray
    starts: np.ndarray
    narrowest: np.ndarray
    #: Window and place in it of each entry.
    window: np.ndarray
    pos: np.ndarray
    bitmap: np.ndarray
    budgets: np.ndarray
    #: q-grams that a window must share.
    need: np.ndarray


def window_starts(n: int) -> list[int]:
    """First letters of the windows of an item of n letters: every STRIDE, and one that ends with the item."""
    starts = list(range(0, max(1, n - WINDOW + 1), STRIDE))
    return starts if n <= WINDOW or starts[-1] == n - WINDOW else [*starts, n - WINDOW]


def build_index(rows: list[tuple[int, np.ndarray]]) -> Index:
    """Of items as letters; those shorter than Q letters are too short to be evidence and have no window."""
    items, windows = [], []
    for item, s in rows:
        if len(s) < Q:
            continue
        for a in window_starts(len(s)):
            items.append(item)
            windows.append(s[a : a + WINDOW])
    grams = [_qgrams(w) for w in windows]
    hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    bitmap = np.zeros(1 << _BITS, dtype=bool)
    bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
    pos = (np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64))[order]
    sizes, budgets = np.array([len(w) for w in windows], dtype=np.int64), np.array([edit_budget(len(w)) for w in windows], dtype=np.int64)
    distinct, starts = np.unique(hashes[order], return_index=True)
    narrowest = np.minimum.reduceat(2 * budgets[window] + 1, starts) if len(starts) else starts
    return Index(items, windows, distinct, np.append(starts, len(window)), narrowest, window, pos, bitmap, budgets, sizes - Q + 1 - budgets * Q)


def banded_alignment(pattern: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int] | None:
    """Least edits between the whole pattern and a piece of text, and where that piece ends.

    Row i of the table holds text positions i + first to i + last only; the piece may start anywhere in
    that band. None if it takes more than `most` edits.
    """
    width, n = last - first + 1, len(text)
    k = np.arange(width)
    j = k + first
    big = most + 1
    row = np.where((j >= 0) & (j <= n), 0, big)
    for i in range(1, len(pattern) + 1):
        j = k + first + i
        inside = (j >= 1) & (j <= n)
        same = np.zeros(width, dtype=bool)
        same[inside] = text[j[inside] - 1] == pattern[i - 1]
        diagonal = np.where(inside, row + ~same, big)
        down = np.full(width, big)
        down[:-1] = row[1:] + 1
        new = np.where((j >= 0) & (j <= n), np.minimum(diagonal, down), big)
        row = np.minimum(np.minimum.accumulate(new - k) + k, big)
        row[(j < 0) | (j > n)] = big
        if row.min() > most:
            return None
    best = int(row.argmin())
    return (int(row[best]), best + first + len(pattern)) if row[best] <= most else None


def exact_alignment(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int] | None:
    """No edits and the end of the first equal piece, if there is one."""
    raw, key = text.tobytes(), pattern.tobytes()
    at = raw.find(key)
    while at % 4 and at > 0:
        at = raw.find(key, at + 1)
    return (0, at // 4 + len(pattern)) if at >= 0 else None


def _hash_hits(s: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the index's hashes that occur in a text, and where, sorted by number, then place."""
    numbers, places = [], []
    for a in range(0, len(s) - Q + 1, _TEXT_BLOCK):
        h = _qgrams(s[a : a + _TEXT_BLOCK + Q - 1])
        maybe = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(index.hashes, h[maybe])
        real = index.hashes[np.minimum(at, len(index.hashes) - 1)] == h[maybe]
        numbers.append(at[real])
        places.append(maybe[real] + a)
    number, place = np.concatenate(numbers), np.concatenate(places)
    order = np.argsort(number, kind="stable")
    return number[order], place[order]


def _thinned(number: np.ndarray, place: np.ndarray, narrowest: np.ndarray) -> np.ndarray:
    """Which hits to keep so that every band of diagonals that had one of a hash still has one.

    Of a hash that the text repeats, places go whose kept neighbours on either side are within the
    narrowest band: a band that holds such a place holds one of the neighbours as well.
    """
    n = len(number)
    keep = np.ones(n, dtype=bool)
    same = np.zeros(n, dtype=bool)
    same[1:-1] = (number[1:-1] == number[:-2]) & (number[1:-1] == number[2:])
    crowded = same.copy()
    crowded[1:-1] &= place[2:] - place[:-2] <= narrowest[number[1:-1]]
    last = -1
    for i in np.flatnonzero(crowded).tolist():
        left = i - 1 if keep[i - 1] else last
        if place[i + 1] - place[left] <= narrowest[number[i]]:
            keep[i] = False
            last = left
    return keep


def _full_bands(number: np.ndarray, place: np.ndarray, index: Index, promising: np.ndarray, n_letters: int) -> list[tuple[int, int]]:
    """(window, band) where enough of the window's q-grams occur on the band's diagonals."""
    budgets, bands_each, off = index.budgets, n_letters + 4 * WINDOW, 2 * WINDOW
    first, counts = index.starts[number], index.starts[number + 1] - index.starts[number]
    ends, seen, at = np.cumsum(counts), np.zeros(0, dtype=np.int64), 0
    while at < len(number):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _HITS, "right")))
        n = counts[at:stop]
        entry = np.repeat(first[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        where = np.repeat(place[at:stop], n)[promising[index.window[entry]]]
        entry = entry[promising[index.window[entry]]]
        window, gram = index.window[entry], index.pos[entry]
        # Bands are two spans wide and start a span apart, so every alignment lies whole in one of them.
        band = np.floor_divide(where - gram, 2 * budgets[window] + 1)
        key = np.concatenate([(window * bands_each + band + off) * WINDOW + gram, (window * bands_each + band - 1 + off) * WINDOW + gram])
        # A q-gram of the window counts once for each band, however often the text repeats it.
        seen = np.union1d(seen, key)
        at = stop
    bands, shared = np.unique(seen // WINDOW, return_counts=True)
    owner = bands // bands_each
    full = shared >= index.need[owner]
    return list(zip(owner[full].tolist(), (bands[full] % bands_each - off).tolist()))


def matches(text: str | None, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, least edits, windows) for each item of which some window is in the text.

    start and end are code points of the original text around all windows that were found. Memory is
    bounded by the text's length times the windows that it shares enough q-grams with, in blocks of hits.
    """
    s, at = letters(text)
    if not len(index.hashes) or len(s) < Q:
        return []
    number, place = _hash_hits(s, index)
    if not len(number):
        return []
    # Places of a window whose q-grams occur anywhere bound those on any band.
    hit = np.unique(number)
    n = index.starts[hit + 1] - index.starts[hit]
    entry = np.repeat(index.starts[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    promising = np.bincount(index.window[entry], minlength=len(index.budgets)) >= index.need
    if not promising.any():
        return []
    useful = np.isin(number, hit[np.add.reduceat(promising[index.window[entry]], np.cumsum(n) - n) > 0])
    number, place = number[useful], place[useful]
    keep = _thinned(number, place, index.narrowest)
    found: dict[int, list[int]] = {}
    windows: dict[int, set[int]] = {}
    for w, b in _full_bands(number[keep], place[keep], index, promising, len(s)):
        pattern, budget = index.windows[w], int(index.budgets[w])
        first = b * (2 * budget + 1)
        last = first + 2 * (2 * budget + 1) - 1
        start = max(0, first - budget)
        text_part = s[start : last + budget + len(pattern)]
        got = exact_alignment(pattern, text_part) or banded_alignment(pattern, text_part, first - budget - start, last + budget - start, budget)
        if got is None:
            continue
        edits, end = got[0], got[1] + start
        begin = max(0, end - len(pattern) - edits)
        while begin < end - len(pattern) + edits and s[begin] != pattern[0]:
            begin += 1
        item = found.setdefault(index.items[w], [int(at[begin]), int(at[end - 1]) + 1, edits])
        item[:] = [min(item[0], int(at[begin])), max(item[1], int(at[end - 1]) + 1), min(item[2], edits)]
        windows.setdefault(index.items[w], set()).add(w)
    return [(i, *v, len(windows[i])) for i, v in sorted(found.items())]


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over blocks of the benchmark of at most BLOCK_LETTERS letters.

    The benchmark is the stated query set and streams through the driver block by block. A longer item
    is looked for in parts, which overlap by a window.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null and item_id is not null").distinct()
    block: list[tuple[int, np.ndarray]] = []
    size, step = 0, max(1, (BLOCK_LETTERS - WINDOW) // STRIDE) * STRIDE
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        whole, _ = letters(row[1])
        for a in range(0, max(1, len(whole) - WINDOW + 1), step):
            part = whole[a : a + step + WINDOW - 1] if len(whole) > BLOCK_LETTERS else whole
            if block and size + len(part) > BLOCK_LETTERS:
                yield build_index(block)
                block, size = [], 0
            block.append((row[0], part))
            size += len(part)
            if part is whole:
                break
    if block:
        yield build_index(block)


_FOUND = "doc_id long, item_id long, start long, end long, edits long, windows long"


def _finder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = [(i.as_py(), *m) for i, t in zip(batch.column(0), batch.column(1)) for m in matches(t.as_py(), index)]
            names = [c.split()[0] for c in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, item_id, start, end, edits, windows` for each document and benchmark item found in it.

    A window of up to WINDOW letters and digits of the item must occur within 8 % edits; case, spacing
    and punctuation don't count. So whole items of up to WINDOW letters are found, and of longer ones
    every fragment of FRAGMENT letters. Null and empty texts contain nothing; items without 9 letters,
    with a null id or a null text are not looked for. A null doc_id is carried as null; repeated rows are
    found each; an item longer than BLOCK_LETTERS may have several rows for a document. Other columns
    are not read; empty tables give no rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for index in _benchmark_blocks(benchmark):
        out = out.unionAll(source.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(index)), _FOUND))
    return out


def _dropper(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            clean = pa.array([not matches(t.as_py(), index) for t in batch.column("text")], pa.bool_())
            yield batch.filter(clean)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark item is found, with their columns as they are.

    Null and empty texts stay; repeated rows stay or go together. An empty benchmark takes nothing.
    """
    for index in _benchmark_blocks(benchmark):
        docs = docs.mapInArrow(_dropper(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
