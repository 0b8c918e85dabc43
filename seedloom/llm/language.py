"""Language identification by a mixture of languages per document.

Each word has a likelihood under each language from byte trigrams (hashed, multinomial,
smoothed).  A document is a mixture: expectation-maximisation estimates its proportions.
The set of languages is chosen by likelihood minus a penalty per language; the largest
proportion within the set is the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
BUCKETS = 1 << 16
#: ASCII bytes that are no letters become spaces; all other bytes stay.
TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
FIELDS = "lang_pred string, score double, n_langs int, proportions array<double>, nats double"
BLOCK = 1 << 20


def trigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte of a word, and where words start.

    ``raw`` is cleaned, begins with a space and ends with two; a word's trigrams begin at
    the space in front of it and at each of its bytes but the last.
    """
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    space = b == 32
    use = ~space[1:-1]
    first = space[:-2][use]
    return bucket[use], np.flatnonzero(first)


class LanguageModel:
    """Log probabilities of trigram buckets, one column per language; texts whose log-likelihood per trigram
    is under ``floor`` are in none of the languages (see ``with_floor``)."""

    def __init__(self, languages: list[str], logs: np.ndarray, floor: float = -np.inf):
        self.languages, self.logs, self.floor = languages, logs, floor

    def mixtures(self, texts: list[str], penalty: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a block of texts with letters: proportions (rows: texts), size of the set, log-likelihood per trigram."""
        clean = [t.lower().encode("utf-8", "surrogatepass").translate(TABLE) for t in texts]
        bucket, first = trigrams(b" " + b"  ".join(clean) + b"  ")
        # the words of each text, by the position of its first byte
        spaces = np.frombuffer(b" " + b"  ".join(clean) + b"  ", np.uint8) == 32
        starts = np.flatnonzero(spaces[:-1] & ~spaces[1:]) + 1
        ends = np.cumsum([len(c) + 2 for c in clean]) + 1
        of = np.searchsorted(ends, starts, side="right")
        n, k = len(texts), len(self.languages)
        counts = np.bincount(of, minlength=n)
        like = np.add.reduceat(self.logs[bucket], first, axis=0).astype(np.float64)
        top = like.max(axis=1, keepdims=True)
        p = np.exp(like - top)
        base = np.bincount(of, top[:, 0], minlength=n)
        cut = np.concatenate([[0], np.cumsum(counts)[:-1]])

        def climb(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                r = p * pi[of]
                r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
                pi = np.add.reduceat(r, cut, axis=0) / counts[:, None]
            seen = np.maximum((p * pi[of]).sum(axis=1), 1e-300)
            return pi, base + np.add.reduceat(np.log(seen), cut)

        whole, _ = climb(np.full((n, k), 1 / k), rounds)
        rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1)
        best, best_pi, size, nats = np.full(n, -np.inf), whole, np.ones(n, np.int64), np.zeros(n)
        steps = np.bincount(of, np.diff(first, append=len(bucket)), minlength=n)
        for m in range(1, k + 1):
            if not (whole * (rank == m - 1)).max() > 1e-4:
                break
            pi = np.where(rank < m, np.maximum(whole, 1e-6), 0)
            pi, fit = climb(pi / pi.sum(axis=1, keepdims=True), 0 if m == 1 else rounds // 2)
            plain, fit = fit, fit - penalty * m * np.log(counts + 1)
            better = fit > best + 1e-9
            nats = np.where(better, plain / steps, nats)
            best = np.where(better, fit, best)
            best_pi = np.where(better[:, None], pi, best_pi)
            size = np.where(better, m, size)
        return best_pi, size, nats


def counts_by_language(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, bucket, count over the columns of ``docs``; added up per task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for t in batches:
            for name, x in zip(t[lang], t[text]):
                bucket, _ = trigrams(b" " + x.lower().encode("utf-8", "surrogatepass").translate(TABLE) + b"  ")
                if len(bucket):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(bucket, minlength=BUCKETS)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": c[at]})

    found = docs.select(lang, text).mapInPandas(count, "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 4_000, smooth: float = 0.5) -> LanguageModel:
    """Fit on the rows given; callers leave out what must not be learned from.

    A language with more than about ``per_language`` documents is learned from a sample of
    that size, chosen by a hash of the id; smaller ones from all of theirs.  Rows without id,
    text or language teach nothing.
    """
    usable = docs.select(doc_id, text, lang).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[lang]: r["count"] for r in docs.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    rate = F.lit(0.0)
    for name, size in sizes.items():
        rate = F.when(F.col(lang) == name, min(1.0, per_language / size)).otherwise(rate)
    some = usable.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit("language")), F.lit(1 << 20)) < rate * (1 << 20))
    rows = counts_by_language(some, lang, text).collect()
    languages = sorted({r["lang"] for r in rows})
    counts = np.full((BUCKETS, max(1, len(languages))), smooth)
    for r in rows:
        counts[r["bucket"], languages.index(r["lang"])] += r["n"]
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def language(text: str, model: LanguageModel, penalty: float = 1.0) -> Column:
    """A struct column (``FIELDS``) for a text column.

    It is marked as not deterministic, although it is, so that a filter on it is not moved below
    the projection that holds it, where Spark would run the model a second time.
    """

    @F.pandas_udf(FIELDS)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred = np.full(len(texts), "und", object)
            score, size, nats = np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts))
            parts: list = [[]] * len(texts)
            block: list[tuple[int, str]] = []
            held = 0

            def flush() -> None:
                if not block:
                    return
                at = np.array([i for i, _ in block])
                pi, n, fit = model.mixtures([t for _, t in block], penalty)
                top = pi.argmax(axis=1)
                pred[at] = np.array(model.languages, object)[top]
                score[at], size[at], nats[at] = np.clip(pi[np.arange(len(at)), top], 0, 1), n, fit
                for i, row in zip(at, pi):
                    parts[i] = row.tolist()
                block.clear()

            for i, t in enumerate(texts):
                if model.languages and t and LETTER.search(t):
                    block.append((i, t))
                    held += len(t)
                    if held > BLOCK:
                        flush()
                        held = 0
            flush()
            yield pd.DataFrame({"lang_pred": pred, "score": score, "n_langs": size, "proportions": parts, "nats": nats})

    return apply.asNondeterministic()(F.col(text))


def with_floor(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", tail: float = 0.001, margin: float = 2.0) -> LanguageModel:
    """The model with the log-likelihood per trigram under which a text is in none of its languages.

    ``margin`` nats under the ``tail`` quantile of all documents with an id, a letter and a language.  Each of them is
    scored; a merged quantile summary per task is all that is shuffled (rank error 1e-5 of the rows).
    """
    known = docs.where(F.col(doc_id).isNotNull() & F.col(text).rlike("\\p{L}") & F.col(lang).isNotNull())
    found = known.select(language(text, model)["nats"].alias("nats"))
    low = found.agg(F.percentile_approx("nats", tail, 100_000)).first()[0]
    return LanguageModel(model.languages, model.logs, -np.inf if low is None else low - margin)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``FIELDS``, one row per row of ``docs``.

    A text that is null or has no letter gets ``und``, score 0 and no proportions; so does every
    text if nothing could be learned.  Equal proportions: the language first in the
    alphabet.  Repeated rows get equal results; an empty table gives an empty result; other
    columns are not read.
    """
    return docs.select(F.col(doc_id), language(text, model).alias("_l")).select(doc_id, "_l.*")
