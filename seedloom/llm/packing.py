"""Conflict-constrained best-fit packing of documents into fixed-size training windows.

Bins are ordered by residual capacity and carry bitmaps of the sources and duplicate
clusters they hold.  A piece goes to the tightest bin that has room and shares no bit with
it: the search starts at the first bin with enough room and takes successors until one is
compatible; if none is, a new bin opens.  Pieces come longest first.

Packing is done in shards of bounded size, dealt by a hash of the row, so a hot source or
a large cluster is spread like anything else.  A piece as long as a bin fills it and is
not moved at all.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved

SHIFT = 32


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, in the order given.

    ``sources`` and ``clusters`` are small codes, -1 where a piece has none and conflicts
    with nothing.  Equal residuals: the older bin first.
    """
    n_sources = int(sources.max(initial=-1)) + 1
    order: list[int] = []
    residual: list[int] = []
    bitmap: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    low = (1 << SHIFT) - 1
    for k, (size, source, cluster) in enumerate(zip(lengths.tolist(), sources.tolist(), clusters.tolist())):
        bits = (1 << source if source >= 0 else 0) | (1 << (n_sources + cluster) if cluster >= 0 else 0)
        at = bisect_left(order, size << SHIFT)
        while at < len(order) and bitmap[order[at] & low] & bits:
            at += 1
        if at < len(order):
            b = order.pop(at) & low
        else:
            b = len(residual)
            residual.append(capacity)
            bitmap.append(0)
        bins[k], offsets[k] = b, capacity - residual[b]
        residual[b] -= size
        bitmap[b] |= bits
        if residual[b]:
            insort(order, residual[b] << SHIFT | b)
    return bins, offsets


def codes(values: pd.Series, shared_only: bool) -> np.ndarray:
    """Small codes of values; -1 for null, and for single values if only shared ones count."""
    out, names = pd.factorize(values)
    if shared_only and len(names):
        alone = np.bincount(out[out >= 0], minlength=len(names)) < 2
        renumber = np.where(alone, -1, np.cumsum(~alone) - 1)
        out = np.where(out >= 0, renumber[out], -1)
    return out


def pack(docs: DataFrame, capacity: int = 2_048, doc_id: str = "doc_id", length: str = "length", source: str = "source", cluster: str = "cluster", shard_rows: int = 4_096) -> DataFrame:
    """doc_id, piece, bin_id, bin_offset, length: one row per piece, at least one per row.

    A document longer than ``capacity`` is cut: whole pieces fill bins of their own, the
    rest is packed.  No bin holds more than ``capacity``, two packed pieces of one source or
    two of one duplicate cluster.  A null source or cluster conflicts with nothing.  Rows of
    length null, 0 or less keep one piece of length 0 with a null bin.  Repeated rows are packed
    each on its own; an empty table gives an empty result; other columns are not read.
    """
    saved = Saved(docs.sparkSession)
    size = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("_id"), size.alias("size"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    whole = F.floor(F.col("size") / capacity).cast("long")
    full = rows.where(F.col("size") >= capacity).select("*", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select("_id", "piece", F.concat_ws(":", F.lit("full"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(capacity).cast("long").alias("length"))
    empty = rows.where("size = 0").select("_id", F.lit(0).cast("long").alias("piece"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"), F.lit(0).cast("long").alias("length"))
    rest = rows.withColumns({"piece": whole, "length": F.col("size") % capacity}).where("length > 0")
    shards = max(1, -(-rest.count() // shard_rows))
    rest = rest.select("_id", "row", "piece", "length", "source", "cluster", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def one(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, offsets = best_fit(t["length"].to_numpy(), codes(t["source"], False), codes(t["cluster"], True), capacity)
        return pd.DataFrame({"_id": t["_id"].to_numpy(), "piece": t["piece"].to_numpy(), "bin_id": [f"{key[0]}:{b}" for b in bins], "bin_offset": offsets, "length": t["length"].to_numpy()})

    kind = rows.schema["_id"].dataType.simpleString()
    packed = rest.groupBy("shard").applyInPandas(one, f"_id {kind}, piece long, bin_id string, bin_offset long, length long")
    return packed.unionByName(full).unionByName(empty).withColumnRenamed("_id", doc_id)


def with_pack_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``length`` (words) and ``cluster`` (hash of the text, letter case and white space aside)."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    words = F.when(F.length("_t") == 0, 0).otherwise(F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(" "), F.lit(""))) + 1)
    return docs.withColumn("_t", t).withColumn("length", words.cast("long")).withColumn("cluster", F.when(F.length("_t") > 0, F.xxhash64(F.lower("_t")))).drop("_t")
