"""Soft masking: merge alignment intervals per read and lower-case them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Positions per bin.
BIN = 1 << 16


def _with_carried(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """``rows`` with ``_carried``, the greatest ``value`` of the earlier bins of the same key.

    One row per occupied bin is scanned, so a read's rows there are its length over the bin
    width at most.
    """
    order = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(key, "_bin").agg(F.max(value).alias("_top"))
    bins = bins.select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), F.max("_top").over(order).alias("_carried"))
    return rows.join(bins, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b"))).drop("_k", "_b")


def merge_intervals(alns: DataFrame, max_gap: int = 0, margin: int = 0, key: str = "qname", width: int = BIN) -> DataFrame:
    """Disjoint ``(key, start, end)``, padded by ``margin`` and joined over short gaps or where they touch.

    A two-level scan.  Of intervals that start at one position the longest is kept before
    anything is sorted, so a bin of starts has ``width`` rows at most however many hits a read has.
    Each bin is merged by itself; its disjoint rows, which are used several times, are written to the
    checkpoint folder when this is called.  How far the earlier bins reach is the running maximum over a table
    of one row per bin, and so is the start of the island that reaches into a bin.  The islands are an
    aggregate that combines before its shuffle: no task sees all intervals of a read.
    """
    padded = alns.select(
        key,
        F.greatest(F.lit(0), F.col("qstart") - margin).cast("long").alias("start"),
        F.least(F.col("qend") + margin, F.col("qlen")).cast("long").alias("end"),
    ).filter(F.col("end") > F.col("start"))
    longest = padded.groupBy(key, "start").agg(F.max("end").alias("end")).withColumn("_bin", F.floor(F.col("start") / width))
    order = Window.partitionBy(key, "_bin").orderBy("start")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)

    def opens(reach: Column) -> Column:
        apart = F.col("start") - reach
        return F.when(reach.isNull() | ((apart > 0) & (apart >= max_gap)), F.col("start"))

    inside = longest.withColumn("_first", opens(F.max("end").over(earlier))).withColumn("_island", F.max("_first").over(so_far))
    local = checkpointed(inside.groupBy(key, "_bin", F.col("_island").alias("start")).agg(F.max("end").alias("end")))

    rows = _with_carried(local, key, F.col("end")).withColumn("_first", opens(F.greatest("_carried", F.max("end").over(earlier))))
    rows = _with_carried(rows.drop("_carried"), key, F.col("_first"))
    rows = rows.withColumn("_island", F.coalesce(F.max("_first").over(so_far), "_carried"))
    return rows.groupBy(key, "_island").agg(F.max("end").alias("end")).select(key, F.col("_island").alias("start"), "end")


def lowercase_intervals(seqs: DataFrame, merged: DataFrame, name: str = "name", seq: str = "seq", key: str = "qname") -> DataFrame:
    """Lower-case the merged intervals of each read; reads without any stay as they are.

    The text is rebuilt from slices of a byte string, so the cost is linear in the read
    length plus the interval count.
    """
    spans = merged.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = seqs.join(spans, seqs[name] == spans["_key"], "left").drop("_key")
    joined = joined.withColumn("_b", F.col(seq).cast("binary"))

    def cut(start, end):
        return F.substring(F.col("_b"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    def piece(x, i):
        before = F.when(i > 0, F.get(F.col("_spans"), i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(cut(before, x["start"]), F.lower(cut(x["start"], x["end"])))

    tail_from = F.get(F.col("_spans"), F.size("_spans") - 1)["end"]
    masked = F.concat(
        F.array_join(F.transform("_spans", piece), ""), cut(tail_from, F.length("_b"))
    )
    return joined.withColumn(seq, F.when(F.col("_spans").isNull(), F.col(seq)).otherwise(masked)).drop("_spans", "_b")
