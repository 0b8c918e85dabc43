"""What several operators share: saved tables, connected components, sampling."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local master without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="seedloom-saved-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Saved:
    """Tables written in the shared folder, so that lost executors cost no recomputation.

    ``drop`` removes a table that no later step reads; the result of a query reads the rest.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.tables)}"
        df.write.parquet(path)
        self.tables.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.tables[-1][0]

    def drop(self, df: DataFrame | None) -> None:
        for known, path in self.tables:
            if known is df:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Edges that one task can hold, should they all be of one node.
SPLIT_EDGES = 1_000_000


def components(edges: DataFrame, saved: Saved) -> DataFrame:
    """Smallest id reachable from each node: columns ``node``, ``component``.

    ``edges`` has long columns ``a`` and ``b``.  Alternating star contraction: every node
    hands its larger, then its smaller neighbours to the smallest one, until nothing
    changes.  Groups are only reduced by ``min``, and each round's edges are written to the shared folder.
    So are the minima of more than ``SPLIT_EDGES`` edges, so that both sides of a join with them are plain tables and
    Spark splits the edges of a node of high degree over tasks; fewer edges fit any one task.  Nodes without an edge to
    another node are not returned.  An empty table gives an empty result.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = saved(tidy(edges))
    state = digest(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        keep = saved if state[0] > SPLIT_EDGES else (lambda df: df)
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = saved(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lowest = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = saved(tidy(small))
        for spent in (large, now, low, lowest):
            saved.drop(spent)
        now, before, state = after, state, digest(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )


def merge_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of index pairs, in bulk: ``parent`` points every index at its smallest mate."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def hash_sample(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of a narrow table, the same ones each time: smallest hash first."""
    return ids.orderBy(F.xxhash64(*ids.columns), *ids.columns).limit(rows)
