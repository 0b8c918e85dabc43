"""Quality rules with compression bands.

Natural text shrinks by a factor that depends on its length: a zstandard ratio (bytes in
to bytes out) above the band means repetition, below it noise.  The ratio is taken over
the whole document and over fixed chunks, so that a long clean document with a stretch of
repetition is judged by its chunks as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 5

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_chunks_out long, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes: (shorter than, least ratio, greatest ratio).

    ``chunk`` bytes make a chunk; the last one joins its predecessor when shorter than half.
    A document is also rejected when more than ``chunk_share`` of its chunks are outside
    ``chunk_band``.

    The defaults are what ``fit_bands`` finds on prose in four languages, rounded outwards: a
    margin of a tenth below the least ratio of a length class and of a half above the greatest.  Under 256
    bytes noise and prose overlap, so only what shrinks not at all or too much goes.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 2.5),
        (128, 0.75, 3.0),
        (256, 0.95, 5.0),
        (512, 1.2, 2.8),
        (1_024, 1.3, 3.2),
        (2_048, 1.5, 3.6),
        (4_096, 1.7, 3.9),
        (8_192, 1.85, 4.0),
        (65_536, 1.95, 4.3),
        (float("inf"), 2.0, 4.6),
    )
    chunk: int = 4_096
    chunk_band: tuple[float, float] = (1.75, 4.0)
    chunk_share: float = 0.34
    level: int = 3


def base_counts(raw: bytes, n_chars: int) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""
    words = raw.split()
    n = len(words)
    n_space = len(raw) - len(raw.translate(None, SPACE))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    n_dup = len(lines) - len(set(lines))
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    return n, n_chars - n_space, n_symbols, n_dup, repeated


def chunk_ends(size: int, chunk: int) -> list[tuple[int, int]]:
    """Chunks cover every byte; a short last one is part of the one before."""
    whole = max(1, (size + chunk // 2) // chunk)
    return [(i * chunk, size if i == whole - 1 else (i + 1) * chunk) for i in range(whole)]


def judge(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of chunks, chunks outside their band, verdict."""
    size = len(raw)
    if not size:
        return 0.0, 0, 0, False
    ratio = size / len(press.compress(raw))
    low, high = next((lo, hi) for top, lo, hi in bands.limits if size < top)
    parts = chunk_ends(size, bands.chunk)
    out = 0
    if len(parts) > 1:
        for a, b in parts:
            r = (b - a) / len(press.compress(raw[a:b]))
            out += not bands.chunk_band[0] <= r <= bands.chunk_band[1]
    return ratio, len(parts), out, low <= ratio <= high and out <= bands.chunk_share * len(parts)


def quality(text: str, bands: Bands = Bands()) -> Column:
    """A struct column (``FIELDS``) for a text column."""

    @F.pandas_udf(FIELDS)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=bands.level)
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                raw = t.encode()
                counts = base_counts(raw, len(t))
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                ratio, chunks, out, good = judge(raw, bands, press)
                rows.append((*counts, failed, ratio, chunks, out, good and not failed))
            yield pd.DataFrame(rows, columns=names)

    return apply(F.col(text))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per row of ``docs``: its id and the fields of ``quality``.

    Null and empty texts have no words, fail the base rules and get ratio 0.  Repeated rows
    are judged alike, each on its own; an empty table gives an empty result; other columns
    of ``docs`` are not read, whatever their names.
    """
    return docs.select(F.col(doc_id), quality(text, bands).alias("_q")).select(doc_id, "_q.*")


def fit_bands(docs: DataFrame, text: str = "text", tail: float = 0.0005, below: float = 0.9, above: float = 1.5, start: Bands = Bands()) -> Bands:
    """Bands from the texts of ``docs`` that the base rules keep, all of them.

    In each length class of ``start`` the limits are the ``tail`` and ``1 - tail`` quantiles of the
    ratio times ``below`` and ``above``; the same over all chunks of longer texts.  Classes without
    texts keep their limits.  Only the quantiles, a row per class, reach the driver.
    """
    tops = [t for t, _, _ in start.limits]

    @F.pandas_udf("array<struct<top: double, ratio: double>>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=start.level)
        for texts in batches:
            out = []
            for t in texts:
                raw = (t or "").encode()
                counts = base_counts(raw, len(t or ""))
                rows = []
                if counts[0] >= 10 and 100 * counts[4] <= 20 * counts[0]:
                    rows.append({"top": float(next(x for x in tops if len(raw) < x)), "ratio": len(raw) / len(press.compress(raw))})
                    parts = chunk_ends(len(raw), start.chunk)
                    # chunks go by the class 0
                    rows += [{"top": 0.0, "ratio": (b - a) / len(press.compress(raw[a:b]))} for a, b in parts if len(parts) > 1]
                out.append(rows)
            yield pd.Series(out)

    each = docs.select(F.explode(measured(F.col(text))).alias("m"))
    found = each.groupBy("m.top").agg(F.percentile_approx("m.ratio", [tail, 1 - tail], 10_000).alias("q")).collect()
    q = {r["top"]: (r["q"][0] * below, r["q"][1] * above) for r in found}
    limits = tuple((t, *q.get(float(t), (lo, hi))) for t, lo, hi in start.limits)
    return replace(start, limits=limits, chunk_band=q.get(0.0, start.chunk_band))
