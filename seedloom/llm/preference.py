"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

P(a preferred to b) = sigmoid(s(a) - s(b)) with a linear score over features of the text.
Weights minimise the logistic loss on feature differences of (good, bad) pairs drawn from
labelled documents.  The cut is a quantile of the sample's scores: the share of bad ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, hash_sample
from .quality_rules import SYMBOLS, base_counts

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:?"
BINS = 8


def measures(text: str, press: zstandard.ZstdCompressor) -> list[float]:
    """What a text looks like; all shares are 0 for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n_chars = max(1, len(raw)), max(1, len(text))
    words, chars, symbols, dup_lines, repeated = base_counts(raw, len(text))
    n = max(1, words)
    count = lambda some: len(raw) - len(raw.translate(None, some))
    split = raw.split()
    same = sum(a == b for a, b in zip(split, split[1:]))
    upper, lower = count(UPPER), count(LOWER)
    lines = raw.count(b"\n") + 1
    return [
        np.log1p(words),
        chars / n,
        symbols / n_chars,
        dup_lines / lines,
        repeated / n,
        len(set(split)) / n,
        same / n,
        upper / size,
        upper / max(1, upper + lower),
        count(DIGITS) / size,
        count(STOPS) / n,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        words / lines,
        size / n_chars,
        len(raw) / max(1, len(press.compress(raw))) if raw else 0.0,
        float(max(map(len, split), default=0)),
    ]


class PreferenceModel:
    """Additive score over binned measures, with its cut and slope."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.edges, self.weights, self.cut, self.slope = edges, weights, cut, slope

    @staticmethod
    def indicators(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """1 for each edge that the measure is above."""
        return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(float)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = 20_000, l2: float = 1e-3, seed: int = 1) -> PreferenceModel:
        """``pairs`` preferences of a good over a bad row, drawn with replacement."""
        quantiles = np.linspace(0, 1, BINS + 2)[1:-1]
        parts = [np.quantile(x[y == k], np.concatenate([[0.02], quantiles, [0.98]]), axis=0) for k in (0, 1)]
        edges = np.sort(np.concatenate(parts), axis=0).T
        z = cls.indicators(x, edges)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            g = d.T @ (p - 1) / pairs + l2 * w
            h = (d.T * (p * (1 - p))) @ d / pairs + (l2 + 1e-6) * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        s = z @ w
        cut = float(np.quantile(s, (y == 0).mean()))
        slope = 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * (s - cut), -30, 30)))
            g, h = ((p - y) * (s - cut)).mean() + 1e-3 * slope, (p * (1 - p) * (s - cut) ** 2).mean() + 1e-3
            slope = float(np.clip(slope - g / h, 0.05, 20))
        return cls(edges, w, cut, slope)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.indicators(x, self.edges) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = 12_000) -> PreferenceModel | float:
    """Fit on at most ``sample`` labelled documents (smallest hash of the id first).

    ``labels`` must only hold rows that may be learned from; null labels are left out, of
    several labels of one id the lowest counts.  With one class only, the result is the
    constant score of that class; without labels it is 0.5.
    """
    saved = Saved(docs.sparkSession)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(doc_id).agg(F.min(quality).alias("_y"))
    some = hash_sample(known, sample)
    texts = docs.select(doc_id, text).join(F.broadcast(some), doc_id).select("_y", measured(text).alias("m"))
    rows = saved(texts).collect()
    x, y = np.array([r["m"] for r in rows]), np.array([int(r["_y"] > 0) for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return PreferenceModel.fit(x, y)


def measured(text: str) -> Column:
    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            yield pd.Series([measures(t or "", press) for t in texts])

    return apply(F.col(text))


def preference_score(text: str, model: PreferenceModel | float) -> Column:
    """Score of a text column between 0 and 1."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            if isinstance(model, float) or not len(texts):
                yield pd.Series(np.full(len(texts), model if isinstance(model, float) else 0.0))
            else:
                yield pd.Series(model.score(np.array([measures(t or "", press) for t in texts])))

    return apply(F.col(text))


def classify(docs: DataFrame, model: PreferenceModel | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5); one row per row of ``docs``.

    Null texts are scored as empty ones.  Repeated rows get equal scores; an empty table gives
    an empty result; other columns are not read.
    """
    scored = docs.select(F.col(doc_id), preference_score(text, model).alias("score"))
    return scored.select(doc_id, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
