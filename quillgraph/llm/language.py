"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character 1- to 3-grams; each language has several
centroids from spherical k-means; a text takes the language of the centroid with the highest cosine,
and is rejected if that cosine is below the centroid's radius. Short texts show few n-grams and are farther from
every centroid, so the radius widens smoothly with fewer letters; no length is exempt.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.llm.common import crc32_mod

DIMS = 4096
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: Most rows of a language that the centroids are fitted on, about; a hash of the id picks them.
FIT_ROWS = 1200
#: Of the cosine that 99 % of a centroid's members reach; below that share a text is rejected.
RADIUS_SHARE = 0.4
#: Letters at which a text's expected cosine is 1 / sqrt(2) of a long text's.
HALF_LETTERS = 24
TEMPERATURE = 0.05
UNKNOWN = "und"
#: A model has CENTROIDS vectors of DIMS numbers for each language and is sent to every task.
MOST_LANGUAGES = 2000
_BLOCK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def ngram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams, with runs of other characters as one blank, and the number of letters."""
    counts, letters = np.zeros(DIMS, dtype=np.int64), 0
    if not text:
        return counts, 0
    table, last = _letters(), None
    for start in range(0, len(text), _BLOCK):
        codes = table[np.frombuffer(text[start : start + _BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        letters += int(np.count_nonzero(codes))
        codes = np.concatenate([[np.uint32(0)] if last is None else last, codes, [np.uint32(0)] if start + _BLOCK >= len(text) else []]).astype(np.uint64)
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        gram = np.zeros(len(codes), dtype=np.uint64)
        for order in range(1, max(ORDERS) + 1):
            if len(codes) < order:
                break
            gram = gram[: len(codes) - order + 1] * np.uint64(0x10FFFF + 2) + codes[order - 1 :] + np.uint64(1)
            if order in ORDERS:
                # An n-gram of blanks only says nothing; a block's overlap is counted once.
                fresh = gram if last is None or order > len(last) else gram[len(last) - order + 1 :]
                slots = (fresh * _PRIME) >> np.uint64(64 - 12)
                counts += np.bincount(slots.astype(np.int64), minlength=DIMS)
        last = codes[-(max(ORDERS) - 1) :]
    return counts, letters


@dataclass(frozen=True)
class Model:
    """Languages of the centroids, their unit vectors, radii, and the inverse document frequencies."""

    langs: tuple[str, ...]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    @functools.cached_property
    def first(self) -> np.ndarray:
        """Where each language's centroids begin; a language's centroids stand together."""
        return np.array([i for i, lang in enumerate(self.langs) if i == 0 or lang != self.langs[i - 1]], dtype=np.int64)


def expected_share(letters: np.ndarray | int) -> np.ndarray:
    """The share of a long text's cosine that a text of so many letters is expected to reach: it rises with the root of the letters at first."""
    return np.sqrt(letters / (letters + HALF_LETTERS))


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).astype(np.float32)


def _doc_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for t in batch.column(0):
            counts, letters = ngram_counts(t.as_py())
            if letters:
                total += counts > 0
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array(np.concatenate([[n], total]), pa.int64())], ["dim", "df"])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; returns unit centroids."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    c = x[seeds]
    for _ in range(rounds):
        owner = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[owner == i].sum(axis=0) if (owner == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


_VECTORS = "lang string, place long, letters int, dims array<int>, counts array<int>"


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each text: at most DIMS numbers, however long it is."""
    for batch in batches:
        got = [ngram_counts(t.as_py()) for t in batch.column(2)]
        dims = [np.flatnonzero(c) for c, _ in got]
        columns = [
            pa.array([n for _, n in got], pa.int32()),
            pa.array([d.tolist() for d in dims], pa.list_(pa.int32())),
            pa.array([np.minimum(c[d], 1 << 30).tolist() for (c, _), d in zip(got, dims)], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["lang", "place", "letters", "dims", "counts"])


def _fitter(idf: np.ndarray, k: int) -> Callable[[pa.Table], pa.Table]:
    def fit(table: pa.Table) -> pa.Table:
        # In a fixed order, so that the clusters don't depend on the shuffle.
        table = table.sort_by([("place", "ascending"), ("letters", "ascending")])
        rows, size = [], []
        for letters, dims, counts in zip(*(table.column(c).to_pylist() for c in ("letters", "dims", "counts"))):
            if letters:
                whole = np.zeros(DIMS, dtype=np.int64)
                whole[dims] = counts
                rows.append(vector(whole, idf))
                size.append(letters)
        x, size = np.stack(rows or [np.zeros(DIMS, np.float32)]), np.array(size or [0])
        c = _cluster(x, k)
        near = x @ c.T
        owner, best = near.argmax(axis=1), near.max(axis=1)
        # No centroid is stricter than its language: a cluster of a few equal texts would reject all others.
        whole = float(np.quantile(best[size > 0], 0.01)) if (size > 0).any() else 0.0
        radii = [min(whole, float(np.quantile(best[own], 0.01))) if (own := (owner == i) & (size > 0)).any() else 0.0 for i in range(len(c))]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c)), "radius": pa.array(radii, pa.float64()), "centroid": pa.array(c.tolist(), pa.list_(pa.float32()))})

    return fit


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", k: int = CENTROIDS, fit_rows: int = FIT_ROWS) -> Model:
    """Fits a model on all rows with a language: document frequencies over every row, centroids on about `fit_rows` of each.

    More than MOST_LANGUAGES values of the language column are an error, as the model goes to every task.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    # Each partition yields one count for each dimension (-1: texts); Spark sums them.
    df = dict(rows.select("text").mapInArrow(_doc_frequencies, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect())
    n = df.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))) + 1
    # A rate for each language, so that about fit_rows of its rows are taken, whatever their number; only
    # the rows drawn are shuffled, as counts.
    rates = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.count("*")).alias("rate"))
    if rates.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.withColumn("draw", draw).join(F.broadcast(rates), "lang").where("draw < rate").select("lang", F.xxhash64("id", "text").alias("place"), "text")
    vectors = sample.mapInArrow(_vector_batches, _VECTORS)
    fitted = vectors.groupBy("lang").applyInArrow(_fitter(idf, k), "lang string, radius double, centroid array<float>").orderBy("lang", "radius", "centroid").collect()
    return Model(tuple(r.lang for r in fitted), np.array([r.centroid for r in fitted], dtype=np.float32).reshape(-1, DIMS), np.array([r.radius for r in fitted]) * RADIUS_SHARE, idf)


def classify(text: str | None, model: Model) -> tuple[str, float, bool]:
    """Language, score from 0 to 1, and whether the text is rejected: no letter, or a cosine below the radius for its length."""
    counts, letters = ngram_counts(text)
    if not letters or not model.langs:
        return UNKNOWN, 0.0, True
    near = model.centroids @ vector(counts, model.idf)
    best = int(near.argmax())
    tops = np.maximum.reduceat(near, model.first)
    share = np.exp((tops - near[best]) / TEMPERATURE)
    return model.langs[best], float(1 / share.sum()), bool(near[best] < model.radii[best] * expected_share(letters))


def classifier(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: appends lang_pred, lang_score and lang_rejected by the column `text`; the rest passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [classify(t.as_py(), model) for t in batch.column("text")]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "__lang", "__score", "__rejected"])

    return run


def _classified(rows: DataFrame, model: Model) -> DataFrame:
    schema = StructType([*rows.schema.fields]).add("__lang", "string").add("__score", "double").add("__rejected", "boolean")
    return rows.mapInArrow(classifier(model), schema)


def _held_out(docs: DataFrame):
    return F.coalesce(crc32_mod(docs["doc_id"], 4) == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score, rejected` for every row of documents.

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2 and whose lang is not null; a null
    doc_id is neither held out nor learned from. Null texts and texts without a letter are `und`,
    score 0, rejected; so is everything if there is nothing to learn from. Repeated rows stay repeated.
    """
    model = train(docs.where(docs["doc_id"].isNotNull() & ~_held_out(docs)))
    out = _classified(docs.select("doc_id", _held_out(docs).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """Documents that the classifier doesn't reject, with their columns as they are.

    Null texts and texts without a letter are rejected, others by distance whatever their length; repeated rows stay or go together; without a row
    to learn from everything is rejected.
    """
    model = train(docs.where(docs["doc_id"].isNotNull() & ~_held_out(docs)))
    return _classified(docs, model).where("not __rejected").select(*docs.columns)
