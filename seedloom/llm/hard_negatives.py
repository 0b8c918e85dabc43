"""Hard negatives: exact integer scores by matrix products modulo several small primes.

Vectors are integers.  Each is replaced by its centred remainders modulo a few primes below 512, and
each prime's product of an anchor block and a row block is a float32 matrix product that is exact,
since 256 terms of at most 255 * 255 stay below 2**24.  The signed score is put together from its
remainders by mixed-radix Chinese remaindering in 64-bit integers.

Anchors and rows are dealt to blocks by hash, and each pair of blocks is one task group of bounded
size.  The first pass finds each anchor's best rows of its label, the second, given their scores, the best
rows of other labels inside each positive's score window.  Blocks report only their best few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved

#: Inner dimensions summed before the next reduction; ``256 * 255 * 255 < 2**24``.
INNER = 256
ANCHORS_PER_BLOCK, ROWS_PER_BLOCK = 2_048, 8_192
#: Scores held at once in a task, by anchors and rows.
TILE = 1 << 20
LOWEST = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """Largest primes below 512, as many as tell all integers of at most ``bound`` in size apart.

    Their product must fit 62 bits, that is 6 primes and scores of 53 bits; a table with
    larger ones raises an error.
    """
    found, product, p = [], 1, 511
    while product <= 2 * bound:
        while any(p % d == 0 for d in range(2, 23)):
            p -= 1
        found.append(p)
        product *= p
        p -= 1
        if product >= 1 << 62:
            raise ValueError("scores beyond 53 bits: the components of the vectors are too large")
    return found


def remainders(v: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred remainders of whole numbers held as doubles, one float32 matrix per prime."""
    whole = v.astype(np.int64)
    out = []
    for p in primes:
        r = whole % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p``, exact: float32 sums stay below 2**24."""
    total = np.zeros((len(a), len(b)), np.int64)
    for i in range(0, a.shape[1], INNER):
        total += (a[:, i : i + INNER] @ b[:, i : i + INNER].T).astype(np.int64)
    return total % p


def signed_scores(rest: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The numbers of least size with these remainders, by mixed-radix digits."""
    value, radix = rest[0].copy(), primes[0]
    for r, p in zip(rest[1:], primes[1:]):
        digit = (r - value) % p * pow(radix, -1, p) % p
        value += digit * radix
        radix *= p
    return np.where(value > radix // 2, value - radix, value)


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return signed_scores([product_mod(x, y, p) for x, y, p in zip(a, b, primes)], primes)


def best_columns(s: np.ndarray, allowed: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to ``n`` times the rows that still have an allowed column, and their best one (the first, if equal)."""
    s = np.where(allowed, s, LOWEST)
    at = np.arange(len(s))
    for _ in range(n if s.shape[1] else 0):
        col = s.argmax(axis=1)
        ok = s[at, col] != LOWEST
        yield at[ok], col[ok]
        s[at, col] = LOWEST


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, each once; components become ``floor(256 x)``."""
    x = F.transform("embedding", lambda c: F.floor(256 * c.cast("double")).cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v")).distinct()


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def blocks(n_rows: int, per_block: int) -> int:
    return max(1, -(-n_rows // per_block))


def block_of(n: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")


def per_block(anchors: DataFrame, rows: DataFrame, n_a: int, n_r: int, pick: Callable, width: int, primes: list[int], schema: str) -> DataFrame:
    """``pick`` over every pair of an anchor block and a row block."""
    a = anchors.withColumn("ab", block_of(n_a)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    # anchors and rows come from one table: new names for one of them tell the columns apart
    r = rows.select(*[F.col(c).alias(c) for c in ("vec_id", "label", "v")]).withColumn("rb", block_of(n_r)).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))

    def task(a_pdf: pd.DataFrame, r_pdf: pd.DataFrame) -> pd.DataFrame:
        r_pdf = r_pdf.sort_values("vec_id", kind="stable").reset_index(drop=True)
        step = max(1, TILE // max(1, len(r_pdf)))
        right = remainders(matrix(r_pdf["v"], width), primes)
        parts = []
        for i in range(0, len(a_pdf), step):
            some = a_pdf.iloc[i : i + step].reset_index(drop=True)
            s = scores(remainders(matrix(some["v"], width), primes), right, primes)
            parts += pick(some, r_pdf, s)
        names = [x.split()[0] for x in schema.split(", ")]
        return pd.concat(parts)[names] if parts else pd.DataFrame({c: [] for c in names})

    return a.groupBy("ab", "rb").cogroup(r.groupBy("ab", "rb")).applyInPandas(task, schema)


def pick_positives(n: int) -> Callable:
    def pick(a: pd.DataFrame, r: pd.DataFrame, s: np.ndarray) -> list[pd.DataFrame]:
        ids, labels = r["vec_id"].to_numpy(), r["label"].to_numpy()
        allowed = (labels == a["label"].to_numpy()[:, None]) & (ids != a["vec_id"].to_numpy()[:, None])
        return [
            pd.DataFrame({"anchor": a["anchor"].to_numpy()[i], "positive_id": ids[j], "positive_score": s[i, j]})
            for i, j in best_columns(s, allowed, n)
        ]

    return pick


def pick_negatives(n: int, low: int, high: int) -> Callable:
    def pick(a: pd.DataFrame, r: pd.DataFrame, s: np.ndarray) -> list[pd.DataFrame]:
        ids = r["vec_id"].to_numpy()
        other = r["label"].to_numpy() != a["label"].to_numpy()[:, None]
        out = []
        for k in range(max(map(len, a["positives"]), default=0)):
            has = [len(x) > k for x in a["positives"]]
            mine = a[has]
            at = np.flatnonzero(has)
            chosen = [x[k] for x in mine["positives"]]
            score = np.array([int(x["positive_score"]) for x in chosen], np.int64)[:, None]
            # scores have 53 bits at most (see primes_for), so these products fit
            t = 100 * s[at]
            inside = other[at] & (low * score <= t) & (t <= high * score)
            for i, j in best_columns(s[at], inside, n):
                out.append(pd.DataFrame({
                    "anchor": mine["anchor"].to_numpy()[i], "place": k, "positive_id": [chosen[x]["positive_id"] for x in i],
                    "positive_score": score[i, 0], "negative_id": ids[j], "negative_score": s[at][i, j],
                }))
        return out

    return pick


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``embeddings(vec_id, embedding, label)``; more columns are ignored.  Rows without an id, label or
    vector, or with a null or non-finite component take no part; a row that is repeated whole counts
    once; rows of one id that differ are rows of their own, but never each other's positive.
    Vectors of unequal length are compared as if filled with zeros.  Anchors are the rows whose id
    is divisible by ``every``.  A score window is ``low`` to ``high`` hundredths of the positive's score.  An
    empty table gives an empty result.
    """
    saved = Saved(rows.sparkSession)
    whole = saved(usable(rows))
    size = whole.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("anchors"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))).alias("largest"),
    ).first()
    width = size["width"] or 0
    primes = primes_for(max(1, width * int(size["largest"] or 0) ** 2))
    n_a, n_r = blocks(size["anchors"], ANCHORS_PER_BLOCK), blocks(size["n"], ROWS_PER_BLOCK)
    # an anchor is named by its id and, should ids repeat, by the hash of the rest
    anchors = whole.where(F.col("vec_id") % every == 0).withColumn("anchor", F.struct("vec_id", F.xxhash64("label", "v").alias("rest")))
    anchors = anchors.withColumn("anchor", F.concat_ws(":", "anchor.vec_id", "anchor.rest"))
    near = per_block(
        anchors, whole, n_a, n_r, pick_positives(positives), width, primes, "anchor string, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    best = saved(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
    listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asked = anchors.join(listed, "anchor")
    far = per_block(
        asked, whole, n_a, n_r, pick_negatives(negatives, low, high), width, primes,
        "anchor string, place int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    kept = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return kept.select(
        F.split("anchor", ":")[0].cast("long").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


HARD_NEGATIVES_SQL = """WITH fine AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, id, score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    inside AS (SELECT anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
        FROM positives p JOIN pairs n USING (anchor_id)
        WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 3"""
