"""Toxicity by weak supervision.

Terms (words and their beginnings) that lean towards toxic texts in the labelled training rows are dealt
to several lexicon voters; pattern voters look at density, shouting and repetition; the annotation itself
is one more voter. A generative label model - each voter's vote given the true class, fitted by
expectation-maximisation, with voters that say the same thing discounted by their correlation - gives
posterior labels, and a linear classifier over text features learns from those.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, crc32_mod

THRESHOLD = 0.7
#: Labelled rows the voters and the classifier are fitted on, about; a hash of the id picks them.
FIT_ROWS = 20_000
LEXICONS = 8
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _terms(words: set[str]) -> set[str]:
    return words | {f"{w[:n]}-" for w in words for n in PREFIXES if len(w) > n}


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term of a batch: texts that hold it, toxic and not."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for t, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for term in _terms(set(_words(t.as_py()))):
                counts.setdefault(term, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["term", "toxic", "clean"])


def learn_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[int, float]]:
    """Lexicon number and strength (log odds) of every term that leans clearly towards toxic texts; `fit_rows` bounds the sample, and so the terms."""
    seen = sample.select("text", "toxic").mapInArrow(_term_batches, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    rows = seen.select("term", odds.alias("odds"), z.alias("z")).where("odds > 1.5 and z > 3").orderBy(F.desc("z"), "term").collect()
    return {r.term: (i % LEXICONS, float(r.odds)) for i, r in enumerate(rows)}


FEATURES = LEXICONS + 7


def features(text: str | None, terms: dict[str, tuple[int, float]]) -> np.ndarray:
    """Hits of each lexicon (distinct terms), then: summed and greatest strength, occurrences and their share, shouting, signs, repetition."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    words = _words(text)
    if not words:
        return out
    unique = set(words)
    found = [terms[t] for t in unique if t in terms]
    hot = {w for w in unique if w in terms}
    for n in PREFIXES:
        for w in unique:
            if len(w) > n and (hit := terms.get(f"{w[:n]}-")):
                found.append(hit)
                hot.add(w)
    for lexicon, _ in found:
        out[lexicon] += 1
    strengths = [s for _, s in found]
    occurrences = sum(w in hot for w in words) if hot else 0
    out[LEXICONS:] = (
        np.log1p(sum(strengths)),
        max(strengths, default=0.0),
        np.log1p(occurrences),
        min(1.0, 20 * occurrences / len(words)),
        sum(c.isupper() for c in text) / len(text),
        min(1.0, 10 * sum(map(text.count, "!?*#$%&")) / len(words)),
        1 - len(unique) / len(words),
    )
    return out


def votes(x: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 of each text voter for rows of features: lexicons, strength, share, shouting, signs, repetition."""
    lexicon = np.where(x[:, :LEXICONS] >= 2, 1, np.where(x[:, :LEXICONS] == 0, -1, 0))
    tail = x[:, LEXICONS:]
    strength = np.where(tail[:, 1] > 3, 1, np.where(tail[:, 1] == 0, -1, 0))
    share = np.where(tail[:, 3] > 0.2, 1, np.where(tail[:, 3] < 0.02, -1, 0))
    shouting = np.where(tail[:, 4] > 0.5, 1, 0)
    signs = np.where(tail[:, 5] > 0.5, 1, 0)
    repetition = np.where(tail[:, 6] > 0.9, -1, 0)
    return np.column_stack([lexicon, strength, share, shouting, signs, repetition])


@dataclass(frozen=True)
class LabelModel:
    """Chance of each vote (-1, 0, 1) by class and voter, voters' weights after their correlations, and the prior."""

    chance: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        ratio = np.log(self.chance[1] / self.chance[0])
        score = sum(self.weight[j] * ratio[j, vote[:, j] + 1] for j in range(vote.shape[1]))
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + score)))


def fit_label_model(vote: np.ndarray, start: np.ndarray, rounds: int = 25, alone: tuple[int, ...] = ()) -> LabelModel:
    """EM from starting posteriors; then voters correlated within the classes share their weight, and EM with those weights.

    Voters in `alone` (negative numbers count from the last) neither share their weight nor lower others'.
    """
    k = vote.shape[1]
    weight, post = np.ones(k), start
    for last in (False, True):
        for _ in range(rounds):
            by_class = np.stack([1 - post, post])
            chance = np.stack([[[(c @ (vote[:, j] == v)) for v in (-1, 0, 1)] for j in range(k)] for c in by_class]) + 1.0
            chance /= chance.sum(axis=2, keepdims=True)
            model = LabelModel(chance, weight, float(np.clip(post.mean(), 0.01, 0.9)))
            post = model.posterior(vote)
        if last:
            break
        expected = (1 - post)[:, None] * (chance[0, :, 2] - chance[0, :, 0]) + post[:, None] * (chance[1, :, 2] - chance[1, :, 0])
        residual = vote - expected
        norm = np.sqrt((residual**2).sum(0)) + 1e-9
        together = np.clip((residual.T @ residual) / np.outer(norm, norm), 0, 1)
        together[list(alone), :] = together[:, list(alone)] = 0
        np.fill_diagonal(together, 1)
        weight = 1 / together.sum(axis=1)
    return model


def fit_classifier(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on soft labels by Newton steps: weights with the bias first, and the features' mean and scale."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + penalty, z.T @ (target - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


@dataclass(frozen=True)
class Model:
    terms: dict[str, tuple[int, float]]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.weights[1:] @ ((features(text, self.terms) - self.mean) / self.scale)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _feature_batches(terms: dict[str, tuple[int, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), terms).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    return run


def sample_labels(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About `fit_rows` of the labels `doc_id, toxic` (0 or 1), picked by a hash of the id; small enough to broadcast."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return known.where(draw < F.lit(min(1.0, fit_rows / max(known.count(), 1))))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the documents of about `fit_rows` labels; with one class only, every score is that class's share.

    The labels drawn go to the documents; of rows that repeat a doc_id the text with the least hash is
    taken, so the sample has one text a label at most. It is kept once for all steps.
    """
    drawn = sample_labels(labels, fit_rows)
    small = drawn.count() <= 2 * fit_rows + 1000
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    met = texts.join(F.broadcast(drawn) if small else drawn, "doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    sample = checkpointed(met.withColumn("k", F.row_number().over(order)).where("k = 1").select("text", "toxic"))
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        share = float(np.clip(sizes.get(1, 0) / max(sum(sizes.values()), 1), 1e-3, 1 - 1e-3))
        return Model({}, np.append(np.log(share / (1 - share)), np.zeros(FEATURES)), np.zeros(FEATURES), np.ones(FEATURES))
    terms = learn_terms(sample, sizes[1], sizes[0])
    got = sample.select("text", "toxic").mapInArrow(_feature_batches(terms), "x array<double>, toxic int").collect()
    x, label = np.array([r.x for r in got]), np.array([r.toxic for r in got])
    vote = np.column_stack([votes(x), label * 2 - 1])
    # The annotation speaks for itself: it is never discounted for agreeing with the lexicons learned from it.
    model = fit_label_model(vote, np.where(label == 1, 0.9, 0.05), alone=(-1,))
    return Model(terms, *fit_classifier(x, model.posterior(vote)))


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every document.

    Learns from labels whose crc32(doc_id as text) mod 3 is not 1. Null and empty texts, and texts
    without a word, get the score of a text in which nothing is found. A null doc_id is neither held out
    nor learned from; repeated rows stay repeated; other columns are not read. Without labels of both
    classes the score is the same for all.
    """
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs, labels.select("doc_id", "toxic").where(~held_out), fit_rows)
    scored = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.select("*", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
