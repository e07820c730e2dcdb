"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Wider patterns propose further
candidates (numbers and addresses in other notations, secrets, account and identity numbers, names after
a title). Labelers - patterns, gazetteers and the words around - vote on every candidate or abstain;
expectation-maximisation over the counts of vote patterns, gathered from all documents, estimates how
reliable each labeler is, and a linear classifier trained on the resulting posteriors decides on the spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn", "name")

# Gazetteers.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "courriel", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "api_key", "auth", "bearer"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security", "number"),
    "name": ("name", "named", "dear", "from", "signed"),
}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
GIVEN_NAMES = (
    "James", "Mary", "John", "Anna", "Peter", "Maria", "Hans", "Pierre", "Marie", "Juan", "Carmen", "Klaus", "Robert", "Linda", "David", "Susan", "Thomas", "Sarah",
    "Michael", "Laura", "Daniel", "Emma", "Paul", "Julia", "Martin", "Eva", "Andreas", "Sabine", "Stefan", "Petra", "Wolfgang", "Ursula", "Jean", "Claire", "Louis",
    "Camille", "Michel", "Sophie", "Luc", "Isabelle", "Carlos", "Ana", "Luis", "Elena", "Miguel", "Lucia", "Pedro", "Sofia", "Jorge", "Rosa",
)
#: How values of the other kinds begin that are known to be in use: issuers, calling codes, keys' marks, countries.
CARD_STARTS = ("34", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "6011", "62", "65")
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91", "351", "353")
SECRET_STARTS = ("sk-", "sk_", "pk_", "ghp_", "gho_", "xoxa-", "xoxb-", "xoxp-", "AKIA", "AIza", "eyJ")
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
#: Networks that no public host has.
INNER_NETWORKS = ("0.", "10.", "127.", "169.254.", "192.168.", "255.")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of the plain pattern always starts where a run of digits does, and takes whole runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Each kind has patterns; a text without any of the literals that a pattern needs (a digit, where there are none) is not searched.
_WIDE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"), ("(at)", "[at]")),
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"), ()),
    ("card", re.compile(r"(?<![0-9-])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9-])"), ()),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), (":",)),
    ("secret", re.compile(r"(?<![0-9A-Za-z])eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"), ("eyJ",)),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:sk[-_]|pk_|gh[op]_|xox[abp]-|AKIA|AIza)[0-9A-Za-z_-]{16,}+"), SECRET_STARTS),
    ("secret", re.compile(r"(?<![0-9A-Za-z+/])[0-9A-Za-z+/]{40,}+={1,2}(?![0-9A-Za-z=])"), ("=",)),
    ("secret", re.compile(r"(?<![0-9A-Za-z_])(?=[A-Za-z_]*[0-9])[0-9A-Za-z_]{32,}+"), ()),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"), ()),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ()),
    ("name", re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? [A-Z][a-zà-ÿ]{1,20}(?: [A-Z][a-zà-ÿ]{1,20})?"), TITLES),
)
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + r")(?!\w)", re.I) for k, w in CONTEXT_WORDS.items()}
#: Characters before a candidate in which context words are looked for.
CONTEXT_CHARS = 32

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long words cost no more than their length."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at += 1


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by start, then kind; code points, end exclusive."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):  # the other patterns begin with one, or with a plus and one
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 if len(p) < 10 else not p.strip("0") or int(p.lstrip("0")[:10]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=_by_start)


def _by_start(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans of the wider patterns that don't overlap a base span or an earlier candidate."""
    # Disjoint stretches that are taken, in order: where each begins and ends.
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out: list[Span] = []
    digits = _DIGIT.search(text) is not None
    for kind, pattern, literals in _WIDE:
        if not (any(x in text for x in literals) if literals else digits):
            continue
        new = []
        for m in pattern.finditer(text):
            a, b = m.span()
            i = bisect_left(starts, b) - 1
            if i < 0 or ends[i] <= a:
                new.append((a, b))
        # Matches of one pattern don't overlap each other, so they are taken together.
        out += [(kind, a, b) for a, b in new]
        both = sorted([*zip(starts, ends), *new]) if new else []
        starts, ends = ([a for a, _ in both], [b for _, b in both]) if new else (starts, ends)
    return out


LABELERS = ("pattern", "gazetteer", "context", "variety", "edges", "checksum", "quoted")


def _listed(kind: str, value: str, digits: str) -> int:
    """The gazetteers' vote: how values of a kind begin or end that are in use."""
    if kind == "email":
        return int(value.rsplit(".", 1)[-1].lower() in TOP_DOMAINS)
    if kind == "name":
        return int(any(n in value.split() for n in GIVEN_NAMES))
    if kind == "card":
        return int(digits.startswith(CARD_STARTS))
    if kind == "phone":
        return int(value.startswith("+") and digits.startswith(CALLING_CODES))
    if kind == "secret":
        return int(value.startswith(SECRET_STARTS))
    if kind == "iban":
        return 1 if value.startswith(IBAN_COUNTRIES) else -1
    if kind == "ip":
        return -1 if value.startswith(INNER_NETWORKS) else 0
    return 0


def shape(span: Span, text: str) -> tuple[int, ...]:
    """What the classifier sees of a span besides the votes: its length, digits and signs, in a few steps each."""
    _, a, b = span
    value = text[a:b]
    digits, signs = sum(c.isdigit() for c in value), sum(not c.isalnum() for c in value)
    return (min(6, (b - a).bit_length()), 4 * digits // (b - a), min(4, signs))


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote for each labeler: 1 personal, -1 not, 0 no opinion."""
    kind, a, b = span
    value, before, after = text[a:b], text[max(0, a - CONTEXT_CHARS) : a], text[b : b + 1]
    digits = re.sub("[^0-9]", "", value)
    pattern = {
        "email": value.count("@") == 1,
        "ip": ":" in value or value.count(".") == 3,
        "card": 13 <= len(digits) <= 19,
        "phone": 10 <= len(digits) <= 15,
        "secret": bool(re.fullmatch(r"[0-9a-f]{32,}", value)) or value.startswith(SECRET_STARTS),
        "iban": 15 <= len(value.replace(" ", "")) <= 34,
        "ssn": not value.startswith(("000", "666", "9")),
        "name": " " in value,
    }[kind]
    gazetteer = _listed(kind, value, digits)
    context = 1 if _CONTEXT[kind].search(before) else 0
    variety = len(set(value.lower())) if kind != "name" else 6
    check = 0
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        moved = value.replace(" ", "")[4:] + value.replace(" ", "")[:4]
        check = 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
    edges = 0 if (a == 0 or not text[a - 1].isalnum()) and not after.isalnum() else -1
    quoted = 1 if a and text[a - 1] in "\"'=:<(" else 0
        # What every candidate has says nothing for it: plain digits, enough different signs, clean edges.
    plain = kind in ("card", "iban")
    return (-1 if not pattern else 0 if plain else 1, gazetteer, context, -1 if variety < 4 else 0, edges, check, quoted)


@dataclass(frozen=True)
class Model:
    """Of each kind: the classifier's weights (bias, labelers' votes, shape), and the labelers' reliabilities."""

    weights: dict[str, tuple[float, ...]]
    reliability: dict[str, tuple[float, ...]]

    def probability(self, kind: str, vote: tuple[int, ...], form: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-(w[0] + np.dot(w[1:], (*vote, *form))))))


#: Where reliabilities begin, and how many votes that is worth; a checksum's is known and stays.
START, START_VOTES = 0.7, 10.0
KNOWN = {"checksum": 0.98}


def expectation_maximisation(vote: np.ndarray, n: np.ndarray, rounds: int = 50, prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of distinct vote patterns with counts n, and the labelers' reliabilities.

    A labeler that votes is right with its reliability, whatever the class. START keeps labelers that
    seldom vote near where they began.
    """
    known = np.array([KNOWN.get(name, 0.0) for name in LABELERS])
    right = np.where(known > 0, known, START)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + vote @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-odds))
        agree = np.where(vote > 0, post[:, None], np.where(vote < 0, 1 - post[:, None], 0)) * n[:, None]
        spoke = (vote != 0) * n[:, None]
        right = np.where(known > 0, known, np.clip((agree.sum(0) + START * START_VOTES) / (spoke.sum(0) + START_VOTES), 0.55, 0.99))
        prior = float(np.clip((post @ n + 1) / (n.sum() + 2), 0.1, 0.9))
    return post, right


def fit_kind(vote: np.ndarray, form: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns, and a logistic regression of its posteriors on votes and shape: (weights with the bias first, reliabilities)."""
    post, right = expectation_maximisation(vote, n)
    x = np.column_stack([np.ones(len(vote)), vote, form]).astype(float)
    share, w = n / n.sum(), np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (share * (p * (1 - p) + 1e-6))[:, None]) + penalty, x.T @ ((post - p) * share) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, right


def _vote_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: dict[tuple[str, str], int] = {}
        for t in batch.column(0):
            text = t.as_py() or ""
            base = base_spans(text)
            for span in base + candidates(text, base):
                key = span[0], ",".join(map(str, (*votes(text, span), *shape(span, text))))
                count[key] = count.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(count.values(), pa.int64())], ["kind", "votes", "n"])


def train(docs: DataFrame) -> Model:
    """Reliabilities and classifiers from every candidate of all documents.

    Spark sums the counts; what reaches the driver is at most 3 ** labelers patterns for each kind and shape.
    """
    rows = docs.select("text").where("text is not null").mapInArrow(_vote_patterns, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    weights, reliability, k = {}, {}, len(LABELERS)
    for kind in KINDS:
        own = [r for r in rows if r.kind == kind]
        if own:
            seen = np.array([[int(v) for v in r.votes.split(",")] for r in own])
            w, right = fit_kind(seen[:, :k], seen[:, k:], np.array([r.n for r in own], dtype=float))
            weights[kind], reliability[kind] = tuple(w), tuple(right)
    return Model(weights, reliability)


def find_pii(text: str | None, model: Model, threshold: float = 0.5) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and the candidates that the classifier takes."""
    text = text or ""
    base = base_spans(text)
    more = [s for s in candidates(text, base) if model.probability(s[0], votes(text, s), shape(s, text)) >= threshold]
    return base, sorted(base + more, key=_by_start)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _finder(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for batch in batches:
            got = [find_pii(t.as_py(), model) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string())
            spans = pa.array([written(spans) for _, spans in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, pa.array([len(s) - len(b) for b, s in got], pa.int64())], names)

    return run


def find_documents_pii(docs: DataFrame) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added` for every document.

    Counts and base_sha256 are of the base patterns' spans; spans lists those and the ones the method
    adds. Null and empty texts have none. A null doc_id is carried, repeated rows stay repeated, other
    columns are not read, and an empty table gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_finder(train(docs)), _FOUND)


def _masker(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mask(text: str | None) -> str | None:
        out, at = [], 0
        for kind, a, b in find_pii(text, model)[1]:
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
                at = b
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = pa.array([mask(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def mask_pii(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind, as `<EMAIL>`; overlapping spans count as the first.

    Null and empty texts and texts without a span stay as they are, and so do all other columns; repeated
    rows are masked alike, and an empty table stays empty.
    """
    return docs.mapInArrow(_masker(train(docs)), docs.schema)
