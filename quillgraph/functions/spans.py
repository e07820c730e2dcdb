"""Fuzzy spans: the best window of a target's length, found through a sliding bound on shared letters.

A window's ratio is at most the share of letters that it has in common with the target, repeats counted. That
bound is worked out for all windows at once from running counts of each letter; only windows whose bound
reaches the threshold are compared, best bound first, until no bound is above the best ratio.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters(text: str) -> np.ndarray | None:
    """Code points of the text in lower case, or None where lower case depends on neighbours or changes lengths."""
    low = text.lower()
    if len(low) != len(text) or "Σ" in text:
        return None
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _bounds(text: np.ndarray, target: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` letters, how many letters it shares with the target, repeats counted."""
    windows = len(text) - width + 1
    shared = np.zeros(windows, dtype=np.int64)
    for letter, n in zip(*np.unique(target, return_counts=True)):
        held = np.concatenate([[0], np.cumsum(text == letter)])
        shared += np.minimum(held[width:] - held[:windows], n)
    return shared


def window_ratio(text: str | None, target: str | None, threshold: float) -> tuple[int, int] | None:
    """The first window with the best ratio to the target, whatever its case, if it reaches the threshold.

    The ratio is difflib's. A text shorter than the target is compared whole; empty texts and targets have no window.
    """
    if not text or not target:
        return None
    n = min(len(target), len(text))
    low = target.lower()
    letters, wanted = _letters(text), _letters(target)
    if letters is None or wanted is None:
        order, bound = range(len(text) - n + 1), None
    else:
        bound = 2.0 * _bounds(letters, wanted, n) / (n + len(wanted))
        order = np.flatnonzero(bound >= threshold - 1e-12)
        order = order[np.argsort(-bound[order], kind="stable")]
    matcher = SequenceMatcher(None, "", low)
    best, at = 0.0, -1
    for i in order:
        i = int(i)
        if bound is not None and bound[i] < best - 1e-12:
            break
        matcher.set_seq1(text[i : i + n].lower())
        if bound is None and (matcher.real_quick_ratio() < max(threshold, best) or matcher.quick_ratio() < max(threshold, best)):
            continue
        ratio = matcher.ratio()
        if ratio > best or ratio == best and at >= 0 and i < at:
            best, at = ratio, i
    return (at, at + n) if at >= 0 and best >= threshold else None


def exact_start(text: Column, target: Column) -> Column:
    """Start (from 0) of a target in a text: as written, else whatever its case, else null."""
    return F.when(target == "", None).when(F.contains(text, target), F.call_function("locate", target, text) - 1).when(F.contains(F.lower(text), F.lower(target)), F.call_function("locate", F.lower(target), F.lower(text)) - 1)


def find_spans(text: Column, targets: dict[str, Column], threshold: float) -> dict[str, Column]:
    """A span (start, end) for each target in one text: exact, then in another case, then the best fuzzy window, else null.

    All targets that have no exact span go to Python in one call; for rows where every target has one, or nothing
    can be found, not even the text goes. Null texts and targets have no span, blank ones only as written.
    """
    exact = {k: exact_start(text, t) for k, t in targets.items()}
    sought = {k: F.when(exact[k].isNull() & (F.trim(t) != ""), F.trim(t)) for k, t in targets.items()}
    some = F.coalesce(*sought.values()).isNotNull() & (F.trim(text) != "")
    names = list(targets)
    span = ", ".join(f"{k}: struct<start: int, end: int>" for k in names)

    @F.pandas_udf(f"struct<{span}>")
    def fuzzy(texts: pd.Series, *wanted: pd.Series) -> pd.DataFrame:
        out = {}
        for k, series in zip(names, wanted):
            found = [window_ratio(a, b, threshold) if a and b else None for a, b in zip(texts, series)]
            out[k] = [{"start": s[0], "end": s[1]} if s else None for s in found]
        return pd.DataFrame(out)

    met = fuzzy(F.when(some, text), *sought.values())
    spans = {}
    for k, t in targets.items():
        whole = F.struct(exact[k].cast("int").alias("start"), (exact[k] + F.length(t)).cast("int").alias("end"))
        spans[k] = F.when(exact[k].isNotNull(), whole).otherwise(met[k])
    return spans
