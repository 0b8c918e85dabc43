"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all thresholds t_0 < t_1 < ...
The output is the expected grade, the sum of these probabilities.  Features are words and
their beginnings; those whose document counts differ between toxic and clean labelled
documents are chosen by a signed test.  Chosen words are also pooled by how much rarer they are
in clean documents, so that one clear word tells even where it is seldom alone; all of
them are evidence for toxicity, so no weight is negative.  Labels are binary; a toxic document's
grade is 1 or 2, 2 if its share of chosen words is at least the median of toxic ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, hash_sample

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(4, 9)
GRADES = 3
#: Pools of words: at least so many times as frequent in toxic documents as in clean ones.
POOLS = (3, 20, 60, 200)
FIELDS = "severity double, grade int, toxic boolean, p_toxic double, n_words long"


def word_features(word: str) -> list[str]:
    """The word itself and its shorter beginnings, marked by a trailing dash."""
    return [word] + [word[:k] + "-" for k in BEGINNINGS if k < len(word)]


def evidence(word: str, chosen: dict[str, tuple[int, int]]) -> list[int]:
    """Features of a word: the chosen ones, and the highest of their pools."""
    hits = [chosen[f] for f in word_features(word) if f in chosen]
    return [k for k, _ in hits] + [len(chosen) + max(pool for _, pool in hits)] if hits else []


def counted(text: str, chosen: dict[str, tuple[int, int]], known: dict[str, list[int]]) -> tuple[Counter, int]:
    """How often each chosen feature occurs, and the number of words."""
    words = WORD.findall(text.lower())
    hits: Counter = Counter()
    if len(known) > 400_000:
        known.clear()
    for w in words:
        at = known.get(w)
        if at is None:
            at = known[w] = evidence(w, chosen)
        if at:
            hits.update(at)
    return hits, len(words)


def values(hits: Counter, n_words: int) -> dict[int, float]:
    """Feature values: presence, raised by how dense the feature is in the text."""
    return {f: 1.0 + np.log1p(100.0 * c / (n_words + 20)) for f, c in hits.items()}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Weights of the chosen features and their pools, and the ordered thresholds.

    ``features`` maps a name to its place and its pool.
    """

    def __init__(self, features: dict[str, tuple[int, int]], weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    @classmethod
    def fit(cls, features: dict[str, tuple[int, int]], rows: list[dict[int, float]], grades: np.ndarray, l2: float = 0.0003, steps: int = 800) -> OrdinalModel:
        """Full-batch Adam on the mean log-likelihood; thresholds are kept in order by their gaps."""
        n, d, cuts = len(rows), len(features) + len(POOLS), GRADES - 1
        of = np.repeat(np.arange(n), [len(r) for r in rows])
        col = np.array([f for r in rows for f in r], np.int64)
        val = np.array([v for r in rows for v in r.values()])
        p = np.zeros(d + cuts)
        p[d] = 2.0
        m, s = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            cut = np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))
            z = np.bincount(of, val * p[col], minlength=n)
            up = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - cut), np.zeros((n, 1))], axis=1)
            slope = up * (1 - up)
            share = np.maximum(np.take_along_axis(up, grades[:, None], 1) - np.take_along_axis(up, grades[:, None] + 1, 1), 1e-12)[:, 0]
            lo, hi = (np.take_along_axis(slope, grades[:, None] + k, 1)[:, 0] / share for k in (0, 1))
            g_z = -(lo - hi) / n
            g_cut = np.array([(np.where(grades == k + 1, lo, 0) - np.where(grades == k, hi, 0)).sum() / n for k in range(cuts)])
            g = np.concatenate([np.bincount(col, val * g_z[of], minlength=d) + l2 * p[:d], [g_cut.sum()], [g_cut[k:].sum() * np.exp(p[d + k]) for k in range(1, cuts)]])
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
            p[:d] = np.maximum(p[:d], 0)
        return cls(features, p[:d], np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])])))

    def above(self, row: dict[int, float]) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return sigmoid(sum(self.weights[f] * v for f, v in row.items()) - self.thresholds)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = 8_000, features: int = 2_000, least: int = 3) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents (smallest hash of the id first).

    Labels that are null are left out, of several labels of one id the highest counts.
    Without a toxic or without a clean sample every document gets grade 0.
    """
    saved = Saved(docs.sparkSession)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(doc_id).agg(F.max(toxic).alias("_y"))
    some = hash_sample(known, sample)
    texts = saved(docs.select(doc_id, text).where(F.col(text).isNotNull()).join(F.broadcast(some), doc_id).select("_y", text))

    def document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> Iterator[pd.DataFrame]:
            for y, c in enumerate(counts):
                names, n = list(c.keys()), list(c.values())
                for k in range(0, len(names), 50_000):
                    part = pd.Series(names[k : k + 50_000], dtype=object)
                    some = np.array(n[k : k + 50_000])
                    yield pd.DataFrame({"feature": part, "bad": some * y, "good": some * (1 - y)})
                c.clear()

        for t in batches:
            for y, x in zip(t["_y"], t[text]):
                counts[int(y > 0)].update({f for w in set(WORD.findall(x.lower())) for f in word_features(w)})
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield from told()
        yield from told()

    sizes = {bool(r["_y"]): r["count"] for r in texts.groupBy((F.col("_y") > 0).alias("_y")).count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return OrdinalModel({}, np.zeros(len(POOLS)), np.array([30.0, 31.0]))
    counts = texts.mapInPandas(document_counts, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    a, b = F.col("bad") / bad, F.col("good") / good
    pooled = (F.col("bad") + F.col("good")) / (bad + good)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / good) + F.lit(1e-9))
    top = counts.where((F.col("bad") >= least) & (a > 3 * b)).withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "feature").limit(features)
    ratio = a * good / (F.col("good") + 1)
    chosen = {r["feature"]: (k, sum(r["ratio"] >= x for x in POOLS[1:])) for k, r in enumerate(top.select("feature", ratio.alias("ratio")).collect())}

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for t in batches:
            rows = [(int(y > 0), *counted(x, chosen, seen)) for y, x in zip(t["_y"], t[text])]
            yield pd.DataFrame({"y": [r[0] for r in rows], "f": [list(r[1].keys()) for r in rows], "c": [list(r[1].values()) for r in rows], "n": [r[2] for r in rows]})

    found = texts.mapInPandas(sparse, "y int, f array<int>, c array<int>, n int").collect()
    rows = [values(Counter(dict(zip(r["f"], r["c"]))), r["n"]) for r in found]
    density = np.array([sum(c for f, c in zip(r["f"], r["c"]) if f >= len(chosen)) / (r["n"] + 20) for r in found])
    y = np.array([r["y"] for r in found])
    middle = np.median(density[y > 0])
    return OrdinalModel.fit(chosen, rows, np.where(y > 0, 1 + (density >= middle), 0))


def toxicity(text: str, model: OrdinalModel) -> Column:
    """A struct column (``FIELDS``) for a text column; null and empty texts have no feature."""

    @F.pandas_udf(FIELDS)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chosen = model.features
        known: dict[str, list[int]] = {}
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for texts in batches:
            rows = []
            for t in texts:
                hits, n = counted(t or "", chosen, known)
                above = model.above(values(hits, n))
                steps = -np.diff(np.concatenate([[1.0], above, [0.0]]))
                rows.append((float(above.sum()), int(steps.argmax()), bool(above[0] >= 0.5), float(above[0]), n))
            yield pd.DataFrame(rows, columns=names)

    return apply(F.col(text))


def grade_toxicity(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``FIELDS``, one row per row of ``docs``.

    ``severity`` is the expected grade (0 to 2), ``toxic`` says P(grade > 0) >= 0.5.  Null and
    empty texts get the score of a text without features, which is clean.  Repeated rows get
    the same grades; an empty table gives an empty result; other columns are not read.
    """
    return docs.select(F.col(doc_id), toxicity(text, model).alias("_t")).select(doc_id, "_t.*")
