"""Language identification in two levels: family, then language.

A text becomes hashed character n-gram counts (1 to 3 characters of the
lower-cased whole text, non-letters folded to one space), square-rooted and
scaled to length one.  One-versus-one linear support vector machines choose the
language family first; within the family, one-versus-one machines separate its
languages.  Each level is decided by votes, ties by summed margins.

Training takes a bounded sample: ``per_language`` labelled documents of each
language (chosen by a hash of doc_id).  Only their fixed-size vectors reach the
driver; the weights (families and pairs x ``DIM`` numbers) are broadcast.

Texts that are null or hold no letter get ``und`` and score 0.  Languages that
``FAMILIES`` does not list form a family each.  Repeated rows are scored row by
row; an empty or unlabelled table gives ``und`` for every text; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codepoints, hash_sample, per_worker, small_batches, texts

DIM = 4096
UNKNOWN = "und"
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance",
            "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}


def _letters() -> np.ndarray:
    """Per code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def vector(text: str | None) -> np.ndarray | None:
    """Unit vector of a text's n-grams, or None where it has no letter."""
    if not text:
        return None
    c = codepoints(text.lower())
    letter = per_worker(("letters",), _letters)[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    c = c[(c != 32) | np.concatenate(([True], c[:-1] != 32))]          # one space between words
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    count = np.bincount(np.concatenate([one, two, three]) >> np.uint32(20), minlength=DIM)
    x = np.sqrt(count)
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 40, seed: int = 3) -> np.ndarray:
    """Weights (bias last) of an L2-regularised squared-hinge machine by dual
    coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    q = (x * x).sum(1) + 0.5 / c
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1.0 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if worst < 1e-4:
            break
    return w.astype(np.float32)


class OneVersusOne:
    """Machines for every pair of classes; one class needs none."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.names = sorted(set(y.tolist()))
        self.pairs = list(combinations(range(len(self.names)), 2))
        fits = []
        for a, b in self.pairs:
            rows = (y == self.names[a]) | (y == self.names[b])
            fits.append(linear_svm(x[rows], np.where(y[rows] == self.names[a], 1.0, -1.0)))
        self.w = np.array(fits, dtype=np.float32).reshape(len(fits), x.shape[1] + 1)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row: index of the winner, and the sigmoid of its smallest margin."""
        k = len(self.names)
        margin = x @ self.w[:, :-1].T + self.w[:, -1]
        votes, total, least = np.zeros((len(x), k)), np.zeros((len(x), k)), np.full((len(x), k), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            m = margin[:, j]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            for side, value in ((a, m), (b, -m)):
                total[:, side] += value
                least[:, side] = np.minimum(least[:, side], value)
        win = np.argmax(votes + 0.5 * np.tanh(total / 10.0), axis=1)
        return win, 1.0 / (1.0 + np.exp(-4.0 * np.clip(least[np.arange(len(x)), win], -9, 9)))


class Hierarchy:
    """Family first, then the language within it."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, families: Mapping[str, str]):
        family = np.array([families.get(v, f"only {v}") for v in lang], dtype=object)
        self.top = OneVersusOne(x, family) if len(x) else None
        self.within = {f: OneVersusOne(x[family == f], lang[family == f]) for f in sorted(set(family.tolist()))}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
        if self.top is None or not len(x):
            return lang, score
        win, sure = self.top.decide(x)
        for i, f in enumerate(self.top.names):
            rows = np.flatnonzero(win == i)
            if len(rows):
                inner, p = self.within[f].decide(x[rows])
                lang[rows] = np.array(self.within[f].names, dtype=object)[inner]
                score[rows] = p * sure[rows]
        return lang, score


def train(labelled: DataFrame, per_language: int = 500, families: Mapping[str, str] = FAMILIES) -> Hierarchy:
    """Fit on about ``per_language`` documents (doc_id, text, lang) of each language."""
    picked = hash_sample(labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"),
                         "lang", per_language)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames):
            rows = [(i, lang, v.tobytes()) for i, lang, t in zip(frame["doc_id"], frame["lang"], frame["text"], strict=True)
                    if (v := vector(t)) is not None]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "x"])

    rows = picked.mapInPandas(run, f"doc_id {dict(labelled.dtypes)['doc_id']}, lang string, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(bytes(b) for b in rows["x"]), dtype=np.float32).reshape(-1, DIM)
    return Hierarchy(x, rows["lang"].to_numpy(dtype=object), families)


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for every document.  The model goes
    out with the task code (Spark broadcasts a large task command itself)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames):
            vectors = [vector(t) for t in frame["text"]]
            known = np.array([v is not None for v in vectors])
            lang, score = np.full(len(frame), UNKNOWN, dtype=object), np.zeros(len(frame))
            if known.any():
                lang[known], score[known] = model.predict(np.array([v for v in vectors if v is not None]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": lang, "score": score})

    return texts(docs).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
