"""Scores, deduplication and order of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import reverse_complement
from ..functions.scoring import canonical_start, complexity_adjustment, identity, patched_score
from ..profile import Profile

OUTPUT_ORDER = ["block", "seq_id", "qstart", "rid", "strand", "rstart", "qend", "rend"]


def first_ends(extended: DataFrame, profile: Profile) -> DataFrame:
    """Ends of the first extension, one row per (query, reference, strand, end).

    ``extended`` carries ``ext.score/qadv/radv`` beside the chain.  An end on the last
    reference base must have earned its bonus.
    """
    ends = extended.withColumn("eq", F.col("qpos") + F.col("ext.qadv")).withColumn(
        "er", F.col("rpos") + F.col("ext.radv")
    )
    needed = F.when(F.col("er") == F.col("rlen"), F.lit(profile.end_bonus)).otherwise(F.lit(0))
    return ends.filter(F.col("ext.score") >= needed)


def distinct_ends(ends: DataFrame) -> DataFrame:
    """Drop chains whose first extension ended where another one's did.

    What the second extension sees depends on the end alone, so its inputs are equal in
    every duplicate; ``chain`` keeps the foremost chain in chain order.
    """
    keys = ["block", "seq_id", "name", "qlen", "rid", "rname", "strand", "rlen", "eq", "er"]
    return ends.groupBy(*keys).agg(
        F.min(F.struct("weight", "qpos", "rpos")).alias("chain"),
        F.first("q_back").alias("q_back"),
        F.first("r_back").alias("r_back"),
    )


def score_alignments(traced: DataFrame, profile: Profile) -> DataFrame:
    """Raw and complexity-adjusted scores, coordinates and identity; weak ones dropped.

    ``traced`` carries ``aln.score/qspan/rspan/matches/cigar`` of the second extension,
    whose query side ``q_back`` is reversed and complemented.
    """
    bonus = F.when(F.col("er") == F.col("rlen"), F.lit(profile.end_bonus)).otherwise(F.lit(0))
    raw = (F.col("aln.score") + bonus).alias("raw_score")
    aligned = reverse_complement(F.substring(F.col("q_back"), F.lit(1), F.col("aln.qspan")))
    scored = traced.filter(F.col("aln.score") > 0).select(
        "*", raw, complexity_adjustment(aligned, profile.rlambda).alias("_adj")
    )
    scored = scored.withColumn("score", patched_score(F.col("raw_score"), F.col("_adj")))
    kept = F.col("raw_score") if profile.use_raw_score else F.col("score")
    walked = F.col("er") - F.col("aln.rspan")
    rstart = canonical_start(F.col("strand"), walked, F.col("aln.rspan"), F.col("rlen"))
    return scored.filter(kept > profile.min_score).select(
        "block",
        "seq_id",
        F.col("name").alias("qname"),
        F.col("qlen").cast("long").alias("qlen"),
        (F.col("eq") - F.col("aln.qspan")).cast("long").alias("qstart"),
        F.col("eq").cast("long").alias("qend"),
        "strand",
        "rid",
        "rname",
        F.col("rlen").cast("long").alias("rlen"),
        rstart.cast("long").alias("rstart"),
        (rstart + F.col("aln.rspan")).cast("long").alias("rend"),
        F.col("aln.rspan").cast("long").alias("block_len"),
        F.lit(255).alias("mapq"),
        "score",
        "raw_score",
        F.col("aln.matches").alias("matches"),
        identity(F.col("aln.matches"), F.col("aln.rspan")).alias("identity"),
        F.col("aln.cigar").alias("cigar"),
        "chain",
    )


def best_per_start(alignments: DataFrame, across_references: bool = False) -> DataFrame:
    """One alignment per start: the higher raw score, then the earlier chain.

    ``across_references`` lets equal starts on different references of one index block
    collapse too.  The aggregate combines before its shuffle.
    """
    head = F.when(F.col("strand") == "-", F.col("rend")).otherwise(F.col("rstart"))
    keys = ["seq_id", "strand", "qstart", "_head", "block"] + ([] if across_references else ["rid"])
    row = F.struct(*[F.col(c) for c in alignments.columns])
    rank = F.struct(
        F.col("raw_score"), -F.col("chain.weight"), -F.col("rid"), -F.col("chain.qpos"), -F.col("chain.rpos")
    )
    return (
        alignments.withColumn("_head", head)
        .groupBy(*keys)
        .agg(F.max_by(row, rank).alias("_best"))
        .select("_best.*")
        .drop("chain")
    )


def in_output_order(alignments: DataFrame) -> DataFrame:
    """Order of index block, query and query position, with ties resolved."""
    return alignments.orderBy(*OUTPUT_ORDER)
