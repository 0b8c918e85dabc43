"""Overlap of half-open intervals within a key: which pairs overlap, and how many.

An alignment table is the usual input: ``seq_id`` with ``qstart`` and ``qend``.  Intervals
without a key or an end, or without length, overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Positions per bin.
WIDTH = 1 << 12


def _bin(pos: Column, width: int) -> Column:
    return F.floor(pos / width).cast("long")


def _real(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull() & (F.col(start) < F.col(end)))


def overlapping_pairs(
    left: DataFrame, right: DataFrame, key: str, start: str = "qstart", end: str = "qend", width: int = WIDTH
) -> DataFrame:
    """``(a, b)``, a struct of each side, for every pair of one key with ``a.start < b.end`` and ``b.start < a.end``.

    Both sides are copied to the bins they touch and meet by (key, bin), so a long read is many
    groups.  The bin of the later start owns the pair, so it is given once.
    """

    def binned(rows: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*[F.col(c) for c in rows.columns]).alias(name)
        touched = F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1, width))).alias("_bin")
        return _real(rows, key, start, end).select(whole, F.col(key).alias("_key"), touched)

    met = binned(left, "a").join(binned(right, "b"), ["_key", "_bin"])
    a, b = F.col("a"), F.col("b")
    inside = (a[start] < b[end]) & (b[start] < a[end])
    owner = _bin(F.greatest(a[start], b[start]), width) == F.col("_bin")
    return met.filter(inside & owner).select("a", "b")


def overlap_counts(rows: DataFrame, key: str, start: str = "qstart", end: str = "qend", width: int = WIDTH) -> DataFrame:
    """``rows`` with ``n_overlaps``, the other rows of the key that overlap this one.

    No pair is made.  What overlaps ``[s, e)`` starts before ``e`` and does not end by ``s``, so two running
    counts per position answer it.  Rows are first counted by position, then summed within bins
    and over the totals of the bins (a two-level scan), so a read with any number of hits is
    spread over its bins.  The rows, the counts and the scan, which are used several times, are written to the
    checkpoint folder when this is called.
    """
    rows = stored(rows)
    real = _real(rows, key, start, end)
    ends = F.array(F.struct(F.col(start).cast("long").alias("pos"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col(end).cast("long").alias("pos"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    events = real.select(F.col(key).alias("_key"), F.explode(ends).alias("_x")).groupBy("_key", F.col("_x.pos").alias("_pos"))
    events = stored(events.agg(F.sum("_x.s").alias("_s"), F.sum("_x.e").alias("_e")).withColumn("_bin", _bin(F.col("_pos"), width)))
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = events.groupBy("_key", "_bin").agg(F.sum("_s").alias("_ts"), F.sum("_e").alias("_te"))
    totals = totals.select("_key", "_bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_ts", "_te")])
    inner = Window.partitionBy("_key", "_bin").orderBy("_pos")
    scanned = events.join(totals, ["_key", "_bin"]).select(
        "_key", "_pos",
        (F.col("_ts") + F.sum("_s").over(inner) - F.col("_s")).alias("_started"),  # before this position
        (F.col("_te") + F.sum("_e").over(inner)).alias("_ended"),  # up to this position
    )
    scanned = stored(scanned)
    to_end = scanned.select(F.col("_key").alias("_k1"), F.col("_pos").alias("_p1"), "_started")
    to_start = scanned.select(F.col("_key").alias("_k2"), F.col("_pos").alias("_p2"), "_ended")
    met = rows.join(to_end, (F.col(key) == F.col("_k1")) & (F.col(end) == F.col("_p1")), "left")
    met = met.join(to_start, (F.col(key) == F.col("_k2")) & (F.col(start) == F.col("_p2")), "left")
    real_row = F.col(key).isNotNull() & (F.col(start) < F.col(end))
    n = F.when(real_row, F.col("_started") - F.col("_ended") - 1).otherwise(0)
    return met.select(*[F.col(c) for c in rows.columns], F.coalesce(n, F.lit(0)).cast("long").alias("n_overlaps"))
