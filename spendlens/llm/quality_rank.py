"""Quality classifier: Bradley-Terry pairwise ranking.

Every text becomes ``FEATURES`` numbers (lengths, character classes, word and
line repetition), computed over the whole text inside tasks.  From a bounded
sample of labelled documents the model learns weights ``w`` such that
``sigmoid(w . (f(a) - f(b)))`` is the chance that ``a`` is preferred to ``b``,
by gradient descent of the logistic loss over pairs of a good and a bad
document.  The threshold is the exact score quantile, over all labelled
documents, at the share of bad ones among them; the returned score is
``sigmoid(w . f - threshold)``, so 0.5 sits on the threshold.

Null and empty texts have all-zero counts and are scored like any other; a
table without one of the two labels gives a model with zero weights and score
0.5; repeated label rows of one document count once (the smallest label);
repeated documents are counted and scored row by row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.quantiles import exact_percentiles
from spendlens.session import materialize

from .common import hash_sample, release, small_batches, small_transfers, texts

FEATURES = ("log_chars", "log_words", "mean_word", "letters", "upper", "digits", "spaces", "symbols",
            "symbol_words", "shout_words", "distinct_words", "top_word", "repeat_pairs", "distinct_lines",
            "distinct_chars", "compress")


def features(text: str) -> list[float]:
    """The numbers of one text; all shares lie between 0 and 1."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    words = text.split()
    k = max(len(words), 1)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    count = np.bincount(data, minlength=256)
    upper = int(count[65:91].sum())
    lower = int(count[97:123].sum())
    digits = int(count[48:58].sum())
    spaces = int(count[9:14].sum() + count[32])
    high = int(count[192:].sum())                  # lead bytes of characters beyond ASCII
    plain = int(count[:128].sum())
    symbols = plain - upper - lower - digits - spaces - int(count[44] + count[46])
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split("\n")
    top = max(seen.values(), default=0)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in seen) if seen else 0
    return [np.log1p(n), np.log1p(len(words)), min(n / k, 40.0) / 40.0, (upper + lower + high) / n, upper / n,
            digits / n, spaces / n, max(symbols, 0) / n, odd / max(len(seen), 1),
            sum(w.isupper() and len(w) > 1 for w in seen) / max(len(seen), 1), len(seen) / k, top / k, repeats / k,
            len(set(lines)) / len(lines), int((count > 0).sum()) / 128.0,
            min(len(zlib.compress(data.tobytes(), 1)) / len(data), 1.0)]


@dataclass
class BradleyTerry:
    """Weights over standardised features and the score threshold."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """``w . f`` row by row: a row's sum does not depend on the rows beside it."""
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.w).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, steps: int = 300, l2: float = 1e-3,
              seed: int = 11) -> BradleyTerry:
    """Learn weights from (good, bad) pairs; ``pairs`` fresh pairs a step are
    drawn from a fixed pool, the step is Nesterov gradient descent."""
    x = x.reshape(-1, len(FEATURES)).astype(np.float64)
    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(len(FEATURES))
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return BradleyTerry(mean, scale, w, 0.0)
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    step = 4.0 / max(np.linalg.norm(d, 2) ** 2 / len(d), 1e-9)
    v = w.copy()
    for i in range(steps):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ v, -40, 40)))       # chance of the wrong order
        new = v + step * (d.T @ p / len(d) - l2 * v)
        v = new + i / (i + 3.0) * (new - w)
        w = new
    raw = z @ w
    return BradleyTerry(mean, scale, w, float(np.quantile(raw, float((y == 0).mean()))))


def numbers_of(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in small_batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": [features(t) for t in frame["text"]]})

    return texts(docs).mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2_000, numbers: DataFrame | None = None) -> BradleyTerry:
    """Weights from at most about ``per_label`` documents of each label (a
    documented bound), the threshold from all labelled documents.  Features are
    computed in tasks, or given as ``numbers`` (``numbers_of``, written); only the
    sample's numbers reach the driver."""
    one = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.min("quality").alias("quality")))

    numbers = numbers_of(docs) if numbers is None else numbers
    known = materialize(numbers.join(one, "doc_id"), "quality-features")    # numbers meet labels, texts are not dealt
    rows = hash_sample(known, "quality", per_label).toPandas().sort_values(["doc_id", "quality"], kind="stable")
    model = fit_pairs(np.array(rows["x"].tolist()), rows["quality"].to_numpy())
    count = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(count) < 2:
        return model

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"raw": model.raw(np.array(frame["x"].tolist()))})

    cut = exact_percentiles(known.select("x").mapInPandas(weigh, "raw double"), "raw", [count[0] / sum(count.values())])
    return replace(model, threshold=cut.first()["q0"])


def score(docs: DataFrame, model: BradleyTerry, numbers: DataFrame | None = None) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) for every document, whose
    features may be given as ``numbers``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = model.score(np.array(frame["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    numbers = numbers_of(docs) if numbers is None else numbers
    return numbers.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def accepted(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.5."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in small_batches(frames):
            s = model.score(np.array([features(t) if isinstance(t, str) else features("") for t in frame["text"]])
                            .reshape(-1, len(FEATURES)))
            yield frame[s >= 0.5]

    return small_transfers(docs).mapInPandas(run, docs.schema)
