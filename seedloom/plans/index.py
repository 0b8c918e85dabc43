"""Reference index: profiles, reference sequences and the k-mer table."""

from __future__ import annotations

import dataclasses
import json
import os
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import normalize_reference
from ..operators.kmers import dense_reference_ids, filter_reference_length, reference_kmers
from ..profile import DEFAULT_PROFILE, LONGEST_REF, Profile

FORMAT_VERSION = 1


@dataclass
class Index:
    """``refs(block, rid, pid, rname, rcomment, rseq, rlen)`` and
    ``kmers(pid, rid, strand, kmer, rpos, r_next)``; ``stats`` per profile id."""

    profiles: list[Profile]
    refs: DataFrame
    kmers: DataFrame
    stats: dict[int, dict[str, int]]

    def with_parameters(self, **overrides) -> Index:
        """Index and mapping parameters are fixed once an index is built."""
        if overrides:
            warnings.warn(f"ignored for a prebuilt index: {', '.join(sorted(overrides))}", stacklevel=2)
        return self


def profile_matches(profile: Profile, name: str = "rname", comment: str = "rcomment") -> Column:
    """Whether a profile takes a reference: either pattern matches, or it has none."""
    hits = [
        F.coalesce(F.col(c).rlike(pattern), F.lit(False))
        for c, pattern in ((name, profile.name_pattern), (comment, profile.comment_pattern))
        if pattern is not None
    ]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(True)


def assign_profiles(refs: DataFrame, profiles: list[Profile]) -> DataFrame:
    """``pid`` of the first profile, in file order, that takes the reference; else the last.

    One CASE expression over the few profiles, evaluated in the scan of the references.
    """
    choice = F.lit(len(profiles) - 1)
    for pid in reversed(range(len(profiles) - 1)):
        choice = F.when(profile_matches(profiles[pid]), F.lit(pid)).otherwise(choice)
    return refs.withColumn("pid", choice)


def _count(refs: DataFrame, profiles: list[Profile]) -> dict[int, dict[str, int]]:
    """Per-profile sizes in one small aggregate; they decide what may be broadcast."""
    kmers = F.lit(0)
    for pid, p in enumerate(profiles):
        branching = F.length(F.regexp_replace("rseq", "[ACGT]", "")) * F.lit(p.k << min(p.k, p.max_amb_columns))
        kmers = F.when(F.col("pid") == pid, 2 * (F.col("rlen").cast("long") + branching)).otherwise(kmers)
    rows = (
        refs.groupBy("pid")
        .agg(F.count("*").alias("n"), F.max("rlen").alias("rlen"), F.sum("rlen").alias("bases"), F.sum(kmers).alias("k"))
        .collect()  # one row per profile
    )
    return {
        r["pid"]: {"n_refs": r["n"], "max_rlen": r["rlen"], "bases": r["bases"], "max_kmers": r["k"]} for r in rows
    }


def build_index(
    refs: DataFrame,
    profiles: list[Profile] | Profile = DEFAULT_PROFILE,
    strict: bool = True,
    order: list[str] | None = None,
    max_length: int = LONGEST_REF,
) -> Index:
    """Index of ``refs(name, seq[, comment, block, rid])``.

    ``rid`` is taken as given or numbered by ``order`` (default: block, seq_id if
    present, name).  A reference over ``max_length`` fails the job, or is skipped without ``strict``; the
    default is the longest whose seeds can be packed.  At least one reference must be left.
    """
    profiles = [profiles] if isinstance(profiles, Profile) else list(profiles)
    base = refs.withColumn("rseq", normalize_reference("seq"))
    if "block" not in base.columns:
        base = base.withColumn("block", F.lit(0))
    if "comment" not in base.columns:
        base = base.withColumn("comment", F.lit(""))
    base = filter_reference_length(base.filter(F.length("rseq") > 0), "rseq", strict, max_length)
    if "rid" not in base.columns:
        keys = order or ["block", *[c for c in ("seq_id",) if c in base.columns], "name"]
        base = dense_reference_ids(base, keys)
    base = base.select(
        F.col("block").cast("int").alias("block"),
        F.col("rid").cast("int").alias("rid"),
        F.col("name").alias("rname"),
        F.col("comment").alias("rcomment"),
        "rseq",
        F.length("rseq").alias("rlen"),
    )
    base = assign_profiles(base, profiles)
    stats = _count(base, profiles)
    if not stats:
        raise ValueError("no reference sequence is left")
    tables = [
        reference_kmers(base.filter(F.col("pid") == pid), profiles[pid].k, profiles[pid].max_amb_columns)
        .withColumn("pid", F.lit(pid))
        for pid in sorted(stats)
    ]
    return Index(profiles, base, reduce(DataFrame.unionByName, tables), stats)


def save_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    spark = index.refs.sparkSession
    index.refs.write.mode(mode).partitionBy("block").parquet(os.path.join(path, "refs"))
    index.kmers.write.mode(mode).partitionBy("pid").parquet(os.path.join(path, "kmers"))
    doc = {
        "version": FORMAT_VERSION,
        "profiles": [dataclasses.asdict(p) for p in index.profiles],
        "stats": {str(k): v for k, v in index.stats.items()},
    }
    head = spark.createDataFrame([(FORMAT_VERSION, json.dumps(doc))], "version int, document string")
    head.coalesce(1).write.mode(mode).parquet(os.path.join(path, "header"))


def load_index(spark: SparkSession, path: str) -> Index:
    head = spark.read.parquet(os.path.join(path, "header")).head()
    if head is None or head["version"] != FORMAT_VERSION:
        raise ValueError(f"not an index of format {FORMAT_VERSION}: {path}")
    doc = json.loads(head["document"])
    profiles = []
    for p in doc["profiles"]:
        if p.get("matrix"):
            p["matrix"] = tuple((tuple(k), s) for k, s in p["matrix"])
        profiles.append(Profile(**p).validate())
    return Index(
        profiles,
        spark.read.parquet(os.path.join(path, "refs")),
        spark.read.parquet(os.path.join(path, "kmers")),
        {int(k): v for k, v in doc["stats"].items()},
    )
