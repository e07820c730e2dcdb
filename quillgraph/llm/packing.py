"""Lexical retrieval packing.

Documents are tokenized and cut: windows that one document fills are done at once; the tails are dealt to
shards of a bounded number of documents. Tails that share a least hash of their token runs follow the
first of them, all others stand with those of the same leading token, and that order is cut every
SHARD_DOCS tails: so a tail's close neighbours are in its shard however large the corpus is. In a shard, a
BM25 inverted index over token ids returns the unused neighbours of each seed, which fill its window
greedily; the neighbour that no longer fits is cut there and its rest seeds the next window, so only the
last window of a shard isn't full. That one is split into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, shuffle_width

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 1000
K1, B_LENGTH = 1.2, 0.75
#: Tokens of a run, and how many least hashes of runs a tail is filed under.
RUN, KEYS = 4, 4
#: Words whose ids a Python worker remembers; beyond that it goes on with those of the latest texts.
CACHE_WORDS = 1_000_000
#: What may follow a word and has ids of its own: ASCII signs but the apostrophe, which the vocabulary's rule joins to letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CONTROL = "\x1c\x1d\x1e\x1f"

#: By vocabulary: words, the number of ids of each, and the ids of all.
_cache: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}
_tokenizers: dict[str, object] = {}
# How a vocabulary must treat a text so that words can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_by_words: dict[str, bool] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        if _tokenizers[path].get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        _cache[path] = (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint16))
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        _by_words[path] = rules.get("normalizer") == _NORMALIZER and rules.get("pre_tokenizer") == _PRE_TOKENIZER
    return _tokenizers[path]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _encoded(words: pa.Array, tok) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and the ids of all in order.

    Latin letters in lower case are one piece to the vocabulary and the model is asked for them directly;
    other words go the whole way.
    """
    found, tokenize, others = [], tok.model.tokenize, []
    for i, word in enumerate(words.to_pylist()):
        ascii_only = word.isascii()
        if word.isalpha() and (ascii_only or max(word) < "\u0130"):
            found.append([t.id for t in tokenize(word if ascii_only else word.encode().decode("latin-1").translate(_LETTERS))])
        else:
            found.append(())
            others.append((i, word))
    for (i, _), e in zip(others, tok.encode_batch_fast([w for _, w in others], add_special_tokens=False)):
        found[i] = e.ids
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return sizes, np.fromiter(chain.from_iterable(found), dtype=np.uint16, count=int(sizes.sum()))


def _looked_up(words: pa.Array, path: str) -> np.ndarray:
    """The place of each word in the cache, which gets the new ones."""
    known, sizes, pool = _cache[path]
    at = pc.index_in(words, value_set=known)
    missing = words.filter(pc.is_null(at))
    if not len(missing):
        return at.to_numpy(zero_copy_only=False)
    new = missing.unique()
    new_sizes, new_pool = _encoded(new, _tokenizer(path))
    if len(known) + len(new) > CACHE_WORDS:
        # Only what these texts hold is kept of the old ones.
        used = np.unique(at.drop_null().to_numpy(zero_copy_only=False))
        known, pool, sizes = known.take(pa.array(used)), _joined(pool, sizes, used)[0], sizes[used]
        at = pc.index_in(words, value_set=known)
    added = pc.add(pc.index_in(words, value_set=new), len(known))
    _cache[path] = (pa.concat_arrays([known, new]), np.concatenate([sizes, new_sizes]), np.concatenate([pool, new_pool]))
    return pc.coalesce(at, added).to_numpy(zero_copy_only=False)


def _bare_words(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For each word what is looked up, and the SIGNS that follow it.

    The vocabulary's own rule lowers case and parts letters from signs. So a word of Latin letters, with or
    without signs after it, has the ids of its letters in lower case and of the signs. Any other
    word is looked up as it stands; none of those is made of Latin letters alone.
    """
    core = pc.utf8_rtrim(words, characters=SIGNS)
    latin = pc.and_(pc.utf8_is_alpha(core), pc.match_substring_regex(core, r"^[\x{0}-\x{12F}]+$"))
    signed = pc.and_(latin, pc.not_equal(core, words))
    signs = pc.replace_substring_regex(words.filter(signed), pattern=r"^\pL+", replacement="")
    after = pc.replace_with_mask(pa.repeat(pa.scalar("", words.type), len(words)), signed, signs)
    return pc.if_else(latin, pc.utf8_lower(core), words), after


def _joined(pool: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a pool one after the other, and the place after each; `sizes` are those of the pool's entries in order."""
    n = sizes[entries]
    after = np.cumsum(n)
    shift = ((np.cumsum(sizes) - sizes)[entries] - (after - n)).astype(np.int32)
    return pool[np.repeat(shift, n) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)], after


def token_bytes(texts: pa.Array, path: str) -> list[bytes]:
    """Ids of each text as little-endian 16-bit integers, with END_ID at the end.

    The vocabulary never joins characters across white space, so the differing words of all texts, without
    case and closing signs, are encoded once, remembered, and put together by their numbers. Splitting also cuts at four control
    characters that the vocabulary does not treat as white space; texts that hold one are encoded whole.
    So is every text with a vocabulary that has other rules.
    """
    tok, end = _tokenizer(path), struct.pack("<H", END_ID)
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not _by_words[path]:
        return [struct.pack(f"<{len(e.ids)}H", *e.ids) + end for e in tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    words = pc.utf8_split_whitespace(texts)
    bounds = words.offsets.to_numpy(zero_copy_only=False)
    numbered = words.flatten().dictionary_encode()
    bare, signs = (x.dictionary_encode() for x in _bare_words(numbered.dictionary))
    places = _looked_up(pa.concat_arrays([bare.dictionary, signs.dictionary]), path)
    # Each differing word is what was looked up and its signs; each text is its words.
    entries = places[np.stack([bare.indices.to_numpy(zero_copy_only=False), len(bare.dictionary) + signs.indices.to_numpy(zero_copy_only=False)], axis=1).ravel()]
    _, sizes, pool = _cache[path]
    pool, after = _joined(pool, sizes, entries)
    ids, after = _joined(pool, np.diff(after[1::2], prepend=0), numbered.indices.to_numpy(zero_copy_only=False))
    at = np.concatenate([[0], after])[bounds - bounds[0]]
    out = [ids[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:])]
    for i in np.flatnonzero(pc.match_substring_regex(texts, f"[{_CONTROL}]").to_numpy(zero_copy_only=False)):
        whole = tok.encode(texts[i].as_py(), add_special_tokens=False).ids
        out[i] = struct.pack(f"<{len(whole)}H", *whole) + end
    return out


def _blocks(texts: pa.Array, size: int = 1 << 24) -> Iterator[pa.Array]:
    """Slices of about `size` bytes, of one text at least."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else []
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(lengths, (lengths[start - 1] if start else 0) + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def ids_crc32(ids: bytes) -> int:
    """CRC-32 of 16-bit ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())


_TAILS = "doc_id long, doc_tokens long, crcs array<long>, tail binary, keys array<long>, topic int"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407][:KEYS], dtype=np.uint64)
#: Leading tokens are told apart modulo this; hashes of contents are taken modulo _NAMES.
TOPICS, _NAMES = 128, 1 << 56


def content_keys(tails: list[bytes]) -> tuple[list[list[int]], list[int]]:
    """For each tail the least hashes of its runs of RUN ids (KEYS hash functions), and its leading id class (modulo TOPICS).

    Alike tails share a key with a chance that is the likeness of their run sets. A tail of fewer ids
    than a run is one run, filled up with nothing; an empty one has no keys.
    """
    sizes = np.array([len(t) // 2 for t in tails], dtype=np.int64)
    some = np.flatnonzero(sizes)
    ids = np.frombuffer(b"".join(tails), dtype="<u2").astype(np.uint64)
    starts = (np.cumsum(sizes) - sizes)[some]
    keys: list[list[int]] = [[] for _ in tails]
    topics = np.zeros(len(tails), dtype=np.int64)
    if len(some):
        owner = np.repeat(np.arange(len(some)), sizes[some])
        left = np.repeat(starts + sizes[some], sizes[some]) - np.arange(len(ids))
        with np.errstate(over="ignore"):
            h = np.zeros(len(ids), dtype=np.uint64)
            for k in range(RUN):
                ahead = np.zeros(len(ids), dtype=np.uint64)
                ahead[: max(0, len(ids) - k)] = ids[k:] + np.uint64(1)
                ahead[left <= k] = 0
                h = (h + ahead) * _MIX
                h ^= h >> np.uint64(32)
            # Only runs that end within their tail count, and the first of a tail that has no such run.
            inside = left >= RUN
            inside[starts] = True
            h, first = h[inside], np.searchsorted(np.flatnonzero(inside), starts)
            least = np.stack([np.minimum.reduceat((h ^ h >> np.uint64(29)) * role, first) for role in _ROLES], axis=1)
        # Each hash function has keys of its own: its number replaces the two lowest bits.
        for i, row in zip(some.tolist(), (least & ~np.uint64(3) | np.arange(KEYS, dtype=np.uint64)).view(np.int64).tolist()):
            keys[i] = row
        topics[some] = np.bincount(owner * TOPICS + (ids % np.uint64(TOPICS)).astype(np.int64), minlength=len(some) * TOPICS).reshape(-1, TOPICS).argmax(axis=1)
    return keys, topics.tolist()


def _groups(tails: list[bytes], size: int = 1 << 19) -> Iterator[list[bytes]]:
    """The tails in groups of about `size` bytes, so that the arrays made of them stay small."""
    at = held = 0
    for i, t in enumerate(tails):
        if held and held + len(t) > size:
            yield tails[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(tails):
        yield tails[at:]


def _tokenize(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, crcs, tails, keys, topics = [], [], [], [], []
            for block in _blocks(batch.column(1)):
                new = token_bytes(block, path)
                full = [len(ids) // (2 * WINDOW) * 2 * WINDOW for ids in new]
                tokens += [len(ids) // 2 for ids in new]
                crcs += [[ids_crc32(ids[i : i + 2 * WINDOW]) for i in range(0, n, 2 * WINDOW)] for ids, n in zip(new, full)]
                tails += [ids[n:] for ids, n in zip(new, full)]
                for own in _groups(tails[-len(new) :]):
                    found = content_keys(own)
                    keys += found[0]
                    topics += found[1]
            columns = [pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(topics, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in _TAILS.split(", ")])

    return run


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with a gapless `number` from 0 in the given order, which must tell all rows apart; no task sorts them all."""
    ranges = shuffle_width(rows.sparkSession)
    dealt = checkpointed(rows.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    # As many rows as ranges: small enough for one task.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("number", place).join(F.broadcast(offsets), "__part").withColumn("number", F.col("number") + F.col("__from")).drop("__part", "__from")


def _shards(tails: DataFrame, shard_docs: int) -> DataFrame:
    """`uid, shard` of tails with `uid, name, doc_id, doc_tokens, keys`: shard_docs neighbours in the order of their labels.

    A tail's label is the least name of those that share one of its keys; names begin with the topic. The
    order is one of contents; uid only parts rows that are equal in all of them, so the shards hold the same
    rows however the table is partitioned.
    """
    filed = tails.select("uid", "name", F.explode("keys").alias("key"))
    first = filed.groupBy("key").agg(F.min("name").alias("first"), F.count("*").alias("n")).where("n > 1")
    labels = filed.join(first, "key").groupBy("uid").agg(F.min("first").alias("label"))
    placed = tails.drop("keys").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "name"))
    return _numbered(placed, ["label", "name", "doc_id", "doc_tokens", "uid"]).select("uid", F.expr(f"number div {int(shard_docs)}").alias("shard"))


class Bm25Index:
    """Inverted index over the token ids of a shard's tails."""

    def __init__(self, tails: list[np.ndarray]) -> None:
        n, lengths = len(tails), np.array([len(t) for t in tails], dtype=np.float64)
        owner = np.repeat(np.arange(n, dtype=np.int64), [len(t) for t in tails])
        term = np.concatenate(tails).astype(np.int64) if n else np.zeros(0, np.int64)
        key, tf = np.unique(term * n + owner, return_counts=True)
        self.term, self.doc = key // max(n, 1), (key % max(n, 1)).astype(np.int32)
        self.terms, self.start = np.unique(self.term, return_index=True)
        self.stop = np.append(self.start[1:], len(key))
        df = self.stop - self.start
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B_LENGTH + B_LENGTH * lengths / max(lengths.mean(), 1e-9)) if n else lengths
        at = np.repeat(np.arange(len(self.terms)), df)
        self.weight = idf[at] * tf * (K1 + 1) / (tf + norm[self.doc])
        # Terms of many documents are kept as whole rows of weights, the others as postings.
        wide = df * 8 > n
        row = np.cumsum(wide) - 1
        common = wide[at]
        self.rows = np.zeros((int(wide.sum()), n), dtype=np.float32)
        self.rows[row[at[common]], self.doc[common]] = self.weight[common]
        order = np.argsort(self.doc, kind="stable")
        bounds = np.searchsorted(self.doc[order], np.arange(n + 1))
        terms = [at[order[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
        self.query = [(row[t[wide[t]]], t[~wide[t]]) for t in terms]
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for all of the seed's terms."""
        common, terms = self.query[seed]
        n = self.stop[terms] - self.start[terms]
        entry = np.repeat(self.start[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.doc[entry], weights=self.weight[entry], minlength=self.n) + self.rows[common].sum(axis=0)

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Free documents by falling score for the seed, ties by number."""
        found = np.flatnonzero(free)
        return found[np.argsort(-self.scores(seed)[found], kind="stable")]


def pack_tails(tails: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start in its tail, length): every id once, all full but powers of two at the end."""
    index, free = Bm25Index(tails), np.array([len(t) > 0 for t in tails], dtype=bool)
    lengths = np.array([len(t) for t in tails])
    seeds = iter(sorted(np.flatnonzero(free).tolist(), key=lambda i: (-lengths[i], i)))
    windows, rest = [], None
    while True:
        if rest is None:
            seed = next((i for i in seeds if free[i]), None)
            if seed is None:
                break
            free[seed] = False
            rest = (seed, 0)
        seed, at = rest
        pieces, room, rest = [(seed, at, int(lengths[seed]) - at)], window - (int(lengths[seed]) - at), None
        if room > 0:
            over = None
            for i in index.neighbours(seed, free).tolist():
                if lengths[i] <= room:
                    pieces.append((i, 0, int(lengths[i])))
                    room -= int(lengths[i])
                    free[i] = False
                    if not room:
                        break
                elif over is None:
                    over = i
            if room and over is not None:
                pieces.append((over, 0, room))
                free[over] = False
                rest = (over, room)
        windows.append(pieces)
    if windows and sum(p[2] for p in windows[-1]) < window:
        windows[-1:] = _powers(windows[-1])
    return windows


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts pieces in order into sequences whose lengths are falling powers of two."""
    left = sum(p[2] for p in pieces)
    out, room = [], 0
    for doc, start, length in pieces:
        while length:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out.append([])
            take = min(room, length)
            out[-1].append((doc, start, take))
            start, length, room = start + take, length - take, room - take
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def _pack_shard(table: pa.Table) -> pa.Table:
    # Rows that are equal in all three are alike, so the pieces don't depend on how the shuffle brought them.
    table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("name", "ascending")])
    ids, tokens = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
    shard = table.column("shard")[0].as_py()
    tails = [np.frombuffer(t.as_py(), dtype="<u2") for t in table.column("tail")]
    rows, sequence = [], shard << 32
    for i, crcs in enumerate(table.column("crcs").to_pylist()):
        for j, crc in enumerate(crcs):
            rows.append((ids[i], j * WINDOW, WINDOW, crc, tokens[i], sequence, 0, WINDOW))
            sequence += 1
    for pieces in pack_tails(tails):
        offset, total = 0, sum(p[2] for p in pieces)
        for i, start, length in pieces:
            crc = ids_crc32(tails[i][start : start + length].tobytes())
            rows.append((ids[i], tokens[i] - len(tails[i]) + start, length, crc, tokens[i], sequence, offset, total))
            offset += length
        sequence += 1
    names = [c.split()[0] for c in _PIECES.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})


def pack_documents(docs: DataFrame, vocabulary: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces of every document: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens`.

    A null text counts as empty: its only id is END_ID. Null and repeated doc_ids are packed row by row
    like others; the same rows in other partitions give the same pieces. A shard holds `shard_docs` documents, the last one fewer, and fewer than WINDOW ids of
    each, however many documents are alike. Other columns are not read; no rows give no pieces.
    """
    read = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenize(vocabulary or default_vocabulary()), _TAILS)
    # The name is of the content alone: the topic, then a hash of the ids. Cut here: texts are tokenized once, and rows keep their uids.
    name = F.col("topic") * F.lit(_NAMES) + F.pmod(F.xxhash64("doc_tokens", "crcs", "tail"), F.lit(_NAMES))
    tails = checkpointed(read.withColumn("name", name).withColumn("uid", F.monotonically_increasing_id()).drop("topic"))
    shards = _shards(tails.select("uid", "name", "doc_id", "doc_tokens", "keys"), shard_docs)
    return tails.drop("keys").join(shards, "uid").drop("uid").groupBy("shard").applyInArrow(_pack_shard, _PIECES)
