"""Cheap banded test of the 32 bases beyond each end of a chain."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import IUPAC_MASK
from ..profile import Profile

FLANK = 32
_LANES = 16
_OUT = -128  # value of a cell outside the band

_MASK_OF_BYTE = np.zeros(256, np.uint8)
for _letter, _mask in IUPAC_MASK.items():
    _MASK_OF_BYTE[ord(_letter)] = _mask


def _masks(flanks: pd.Series) -> np.ndarray:
    raw = "".join(flanks).encode("ascii")
    return _MASK_OF_BYTE[np.frombuffer(raw, np.uint8)].reshape(len(flanks), FLANK)


def band_scores(q: np.ndarray, r: np.ndarray, match: int, mismatch: int, gap: int) -> np.ndarray:
    """Best linear-gap score of each row's two flanks within a 16-cell anti-diagonal band.

    Anti-diagonal ``s`` holds the cells ``x + y == s`` (``x`` on the reference, ``y`` on
    the query) around the main diagonal; 32 anti-diagonals are filled, all rows at once.
    """
    n = len(q)
    lane = np.arange(_LANES)
    centre = _LANES // 2
    older = np.broadcast_to((2 * gap - match) * np.abs(lane - centre), (n, _LANES)).astype(np.int32)
    newer = older + gap
    newer = np.maximum(newer, np.pad(newer[:, 1:], ((0, 0), (0, 1)), constant_values=_OUT))
    best = older.max(axis=1)
    for s in range(FLANK):
        even = s % 2 == 0
        half = s // 2
        x = centre + half - lane
        y = half + lane - centre + (0 if even else 1)
        inside = (x >= 0) & (x < FLANK) & (y >= 0) & (y < FLANK)
        hit = (r[:, np.where(inside, x, 0)] & q[:, np.where(inside, y, 0)] != 0) & inside
        step = newer + gap
        if even:
            side = np.pad(step[:, :-1], ((0, 0), (1, 0)), constant_values=_OUT)
        else:
            side = np.pad(step[:, 1:], ((0, 0), (0, 1)), constant_values=_OUT)
        now = np.maximum(older + np.where(hit, match, mismatch), np.maximum(step, side))
        best = np.maximum(best, now.max(axis=1))
        older, newer = newer, now
    return best


def flank_score_udf(profile: Profile) -> Callable[..., Column]:
    p = profile.flank_scores()
    match, mismatch, gap = p["match"], p["mismatch"], p["gap"]

    @F.pandas_udf("int")
    def score(q_after: pd.Series, r_after: pd.Series, q_before: pd.Series, r_before: pd.Series) -> pd.Series:
        after = band_scores(_masks(q_after), _masks(r_after), match, mismatch, gap)
        before = band_scores(_masks(q_before), _masks(r_before), match, mismatch, gap)
        return pd.Series(after + before, dtype="int32")

    return score


def padded(c: Column) -> Column:
    """Exactly 32 letters; what lies beyond the sequence matches nothing."""
    return F.rpad(c, FLANK, "N")


def filter_flanks(windows: DataFrame, profile: Profile) -> DataFrame:
    """Keep chains that are long, or whose flanks score enough together.

    ``windows`` has ``qspan`` and the four padded flank columns, which are dropped.
    """
    flanks = ["q_after", "r_after", "q_before", "r_before"]
    if profile.filter_span is None:
        return windows.drop(*flanks)
    enough = profile.flank_scores()["min_score"]
    scored = windows.withColumn(
        "_flank",
        F.when(F.col("qspan") >= profile.filter_span + 1, F.lit(enough)).otherwise(
            flank_score_udf(profile)(*flanks)
        ),
    )
    return scored.filter(F.col("_flank") >= enough).drop("_flank", *flanks)
