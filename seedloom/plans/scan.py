"""Scan: queries against an index, to scored local alignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import is_valid_query, normalize_query, reverse_complement
from ..operators.alignments import (
    best_per_start,
    distinct_ends,
    first_ends,
    score_alignments,
)
from ..operators.chains import greedy_chains
from ..operators.extension import extend_trace_udf, extend_udf
from ..operators.flanks import FLANK, filter_flanks, padded
from ..operators.kmers import PieceLayout, both_strands, coded_kmers, query_kmers, query_pieces
from ..operators.lockstep import SEEDS_PER_STEP, fits
from ..operators.seeds import (
    BROADCAST_LIMIT,
    BYTES_PER_INDEX_ROW,
    SEEDS_PER_SORT,
    seed_lists,
    seed_tasks,
    seeds,
    seeds_per_base,
)
from ..operators.sieve import KmerTable, in_runs
from ..profile import Profile
from ..session import bound_arrow_batches
from .index import Index

# What a broadcast row of a chain, and of a reference beside its bases, costs about.
BYTES_PER_CHAIN = 128
CHAIN_BROADCAST_LIMIT = 64 << 20
BYTES_PER_REF = 128
# Seeds a base from which on lists of positions are chained instead of rows.
SEEDS_FOR_LISTS = 8
# A task of lists gets no less query than this.
BASES_PER_LISTS = 1 << 16


def prepare_queries(queries: DataFrame, ambiguous: str | None = "A") -> DataFrame:
    """``(seq_id, name, seq)`` with plain bases; records that cannot be read are left out.

    ``ambiguous=None`` says that ``seq`` holds nothing but ACGT already.
    """
    if ambiguous is None:
        return queries.select("seq_id", "name", "seq", *[c for c in ("len_bound",) if c in queries.columns])
    ok = queries.filter(is_valid_query("seq")).select(
        "seq_id", "name", normalize_query("seq", ambiguous).alias("seq")
    )
    return ok.filter(F.col("seq").rlike("^[ACGT]*$")) if ambiguous == "reject" else ok


def rejected_queries(queries: DataFrame, ambiguous: str = "A") -> DataFrame:
    """The records ``prepare_queries`` leaves out, for a log or a side output."""
    bad = ~is_valid_query("seq")
    if ambiguous == "reject":
        bad = bad | ~normalize_query("seq", ambiguous).rlike("^[ACGT]*$")
    return queries.filter(bad).select("seq_id", "name")


def layout_for(index: Index, pid: int, core: int | None = None, warm: int | None = None) -> PieceLayout:
    return PieceLayout.of(index.stats[pid]["max_rlen"], index.profiles[pid], core, warm)


def seed_stage(
    queries: DataFrame, index: Index, pid: int, layout: PieceLayout, limit: int = BROADCAST_LIMIT, sieve: bool = False
) -> DataFrame:
    """Squashed seeds of one profile's references.

    With ``sieve`` only those that may be part of a chain: runs with fewer seeds than a chain may lack some or all.
    """
    profile = index.profiles[pid]
    own = index.kmers.filter(F.col("pid") == pid).drop("pid")
    # seeds are sorted where they are born: splits with too many of them are dealt out as text
    broadcast = index.stats[pid]["max_kmers"] * BYTES_PER_INDEX_ROW <= limit
    tasks = seed_tasks(queries, own, SEEDS_PER_SORT) if broadcast else 0
    tasks = tasks if tasks > queries.rdd.getNumPartitions() else 0
    pieces, table = query_pieces(queries, layout, spread=True, tasks=tasks), coded_kmers(own)
    if sieve and broadcast:
        found = KmerTable.of(table, profile.k)
        pieces = in_runs(pieces, found, profile.min_seeds, profile.window, profile.squash_interval)
    kmers = query_kmers(pieces, profile.k, coded=True)
    return seeds(kmers, table, profile.k, profile.squash_interval, index.stats[pid]["max_kmers"], limit=limit)


def list_stage(queries: DataFrame, index: Index, pid: int, layout: PieceLayout, limit: int = BROADCAST_LIMIT) -> DataFrame | None:
    """Squashed seeds as lists of positions, if k-mers are so short that there are too many for rows."""
    profile, stat = index.profiles[pid], index.stats[pid]
    own = index.kmers.filter(F.col("pid") == pid).drop("pid")
    widest = layout.core + layout.behind + layout.ahead
    if stat["max_kmers"] * BYTES_PER_INDEX_ROW > limit or not fits(stat["max_rlen"], widest, profile.window):
        return None
    if seeds_per_base(own) < SEEDS_FOR_LISTS:
        return None
    spark = queries.sparkSession
    bound_arrow_batches(spark)
    # dealt as text by (query, piece), so that the lists of a piece are made where it is
    tasks = max(seed_tasks(queries, own, SEEDS_PER_STEP, BASES_PER_LISTS), spark.sparkContext.defaultParallelism)
    kmers = query_kmers(query_pieces(queries, layout, tasks=tasks), profile.k, coded=True)
    return seed_lists(kmers, coded_kmers(own), profile.k, profile.squash_interval, stat["max_kmers"], limit)


def chain_stage(queries: DataFrame, index: Index, pid: int, layout: PieceLayout, limit: int = BROADCAST_LIMIT) -> DataFrame:
    co_located = index.stats[pid]["max_kmers"] * BYTES_PER_INDEX_ROW <= limit
    lists = list_stage(queries, index, pid, layout, limit)
    found = seed_stage(queries, index, pid, layout, limit, sieve=lists is None)
    return greedy_chains(found, index.profiles[pid], layout, co_located, lists)


def window_stage(
    queries: DataFrame, chains: DataFrame, index: Index, pid: int, layout: PieceLayout, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Chains with the stretches of both sequences that filter and extension look at.

    The chain table was checkpointed, so counting it is cheap.  While it fits, it is
    broadcast and the query text is read once more but never shuffled; beyond that the
    two meet by (query, piece), and pieces without chains are dropped before the shuffle.
    """
    pieces = query_pieces(queries, layout).drop("n_pieces")
    if chains.count() * BYTES_PER_CHAIN <= min(limit, CHAIN_BROADCAST_LIMIT):
        met = pieces.join(F.broadcast(chains), ["seq_id", "piece"])
    else:
        wanted = chains.select("seq_id", "piece").distinct()
        met = chains.join(pieces.join(wanted, ["seq_id", "piece"], "left_semi"), ["seq_id", "piece"])
    stat = index.stats[pid]
    refs = both_strands(index.refs.filter(F.col("pid") == pid)).select(
        "block", "rid", "rname", "strand", "rlen", "sseq"
    )
    if 2 * (stat["bases"] + stat["n_refs"] * BYTES_PER_REF) <= limit:
        refs = F.broadcast(refs)
    met = met.join(refs, ["rid", "strand"])

    # an extension takes two query bases at most for each reference base that it can still reach
    reach, room = 2 * F.col("rlen"), F.col("rlen") - F.col("rpos")
    rel = F.col("qpos") - F.col("pstart")

    def qcut(start, stop):
        a = F.greatest(F.lit(0), start)
        b = F.least(F.length("pseq"), stop)
        return F.substring(F.col("pseq"), (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int")).cast("string")

    def rcut(start, stop):
        a = F.greatest(F.lit(0), start)
        b = F.least(F.col("rlen"), stop)
        return F.substring(F.col("sseq"), (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))

    q_end, r_end = rel + F.col("qspan"), F.col("rpos") + F.col("rspan")
    windows = met.select(
        "block", "seq_id", "name", "qlen", "rid", "rname", "strand", "rlen", "qpos", "rpos", "qspan", "weight",
        padded(qcut(q_end, q_end + FLANK)).alias("q_after"),
        padded(rcut(r_end, r_end + FLANK)).alias("r_after"),
        padded(F.reverse(qcut(rel - FLANK, rel))).alias("q_before"),
        padded(F.reverse(rcut(F.col("rpos") - FLANK, F.col("rpos")))).alias("r_before"),
        qcut(rel - reach, rel + 2 * room).alias("q_window"),
        F.least(rel, reach).cast("int").alias("q_offset"),
        F.col("sseq").alias("r_walked"),
    )
    return filter_flanks(windows, index.profiles[pid])


def extend_stage(windows: DataFrame, profile: Profile, legacy_ops: bool = False) -> DataFrame:
    """Two extensions per chain: to the far end, and from there back with the path."""
    # dynamic programming dominates from here on: spread the rows evenly first
    rows = windows.hint("rebalance")
    room = F.col("rlen") - F.col("rpos")
    ahead_q = F.substring(F.col("q_window"), F.col("q_offset") + 1, (2 * room).cast("int"))
    ahead_r = F.substring(F.col("r_walked"), (F.col("rpos") + 1).cast("int"), F.col("rlen"))
    ends = first_ends(rows.withColumn("ext", extend_udf(profile)(ahead_q, ahead_r)), profile)
    back = F.least(2 * F.col("er"), F.col("eq")).cast("int")
    stop = (F.col("q_offset") + F.col("ext.qadv")).cast("int")
    ends = ends.withColumn(
        "q_back", reverse_complement(F.substring(F.col("q_window"), stop - back + 1, back))
    ).withColumn("r_back", reverse_complement(F.substring(F.col("r_walked"), F.lit(1), F.col("er").cast("int"))))
    single = distinct_ends(ends.drop("q_window", "r_walked"))
    traced = single.withColumn("aln", extend_trace_udf(profile, legacy_ops)("q_back", "r_back"))
    return score_alignments(traced, profile)


def scan(
    queries: DataFrame,
    index: Index,
    ambiguous: str | None = "A",
    across_references: bool = False,
    legacy_ops: bool = False,
    limit: int = BROADCAST_LIMIT,
    core: int | None = None,
    warm: int | None = None,
) -> DataFrame:
    """Alignments of ``queries(seq_id, name, seq)``, unordered.

    ``across_references`` collapses equal starts on different references.  ``core`` and
    ``warm`` set the piece length and warm-up (see ``PieceLayout``), ``limit`` the
    broadcast bound in bytes.
    """
    bound_arrow_batches(queries.sparkSession)
    ready = prepare_queries(queries, ambiguous)
    parts = []
    for pid in sorted(index.stats):
        layout = layout_for(index, pid, core, warm)
        chains = chain_stage(ready, index, pid, layout, limit)
        windows = window_stage(ready, chains, index, pid, layout, limit)
        parts.append(extend_stage(windows, index.profiles[pid], legacy_ops))
    found = reduce(DataFrame.unionByName, parts)
    return best_per_start(found, across_references)


def scan_with_rejects(queries: DataFrame, index: Index, ambiguous: str | None = "A", **options) -> tuple[DataFrame, DataFrame]:
    """Alignments as of ``scan``, and the ``(seq_id, name)`` of the queries it leaves out."""
    rejects = queries.select("seq_id", "name").limit(0) if ambiguous is None else rejected_queries(queries, ambiguous)
    return scan(queries, index, ambiguous, **options), rejects
