"""Seeding: k-mer equi-join, squash of redundant seeds, diagonal coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import rotate_u, rotate_v
from .kmers import BASE_CODES, PieceLayout, query_kmers
from .sieve import wanted_seed, with_slot_bit
from .totals import Groups, multiplied

# A hashed build-side row of the k-mer index costs about this much in an executor.
BYTES_PER_INDEX_ROW = 96
BROADCAST_LIMIT = 512 << 20
# Rows of one k-mer, of either side, that meet in one cell of the shuffled join: 4 million pairs at most.
ROWS_PER_CELL = 2_000
# Seeds that one task is to group, or to sort (three longs each): about 200 MB, so that nothing is spilled.
SEEDS_PER_TASK = 1 << 20
SEEDS_PER_SORT = 1 << 22
# No task gets less query than this, however many seeds a base has.
BASES_PER_TASK = 1 << 17
# Where groups meet as matrices, a query has a place for every k-mer: up to this k.
LONGEST_PRODUCT = 5


def on_interval(k: int, interval: int) -> Column:
    """Whether a query k-mer keeps its seeds whatever follows; every ``interval``-th does, from the end."""
    return (F.col("qlen") - (F.col("qpos") + k)) % interval == 0


def keep_seed(k: int, interval: int) -> Column:
    """False for a seed whose diagonal matches again one step on, except every ``interval``."""
    same_next = F.coalesce(F.col("q_next") == F.col("r_next"), F.lit(False))
    return ~same_next | on_interval(k, interval)


def join_kmers(q_kmers: DataFrame, r_kmers: DataFrame, n_index_rows: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Every (query k-mer, reference k-mer) pair with equal bases.

    The index side is broadcast only while its counted rows fit ``limit``; the query
    side, the big one, is then not shuffled at all.  Beyond it both sides are shuffled, and a k-mer
    that is frequent on either side is dealt to a grid of cells.
    """
    if n_index_rows * BYTES_PER_INDEX_ROW <= limit:
        return q_kmers.join(F.broadcast(r_kmers), "kmer")
    return _grid_join(q_kmers, r_kmers)


def _heavy_kmers(q_kmers: DataFrame, r_kmers: DataFrame, per_cell: int) -> DataFrame:
    """``(kmer, _rows, _cols)`` of the k-mers that need more than one cell.

    Rows are counted on both sides before the join.  At most 4**9 distinct keys exist, so
    this table has a fixed size bound.
    """
    q = q_kmers.groupBy("kmer").agg(F.count("*").alias("_q"))
    r = r_kmers.groupBy("kmer").agg(F.count("*").alias("_r"))
    grid = q.join(r, "kmer").select(
        "kmer", F.ceil(F.col("_q") / per_cell).cast("int").alias("_rows"), F.ceil(F.col("_r") / per_cell).cast("int").alias("_cols")
    )
    return grid.filter("_rows > 1 or _cols > 1")


def _grid_join(q_kmers: DataFrame, r_kmers: DataFrame, per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Join by k-mer; a heavy k-mer's pairs are spread over a grid of cells.

    A query row belongs to one row of the grid and is copied to its columns, an index row to one
    column and is copied to its rows, so each pair meets in one cell, of at most about
    ``per_cell`` squared pairs.  Light k-mers have one cell.  The join may sort and spill.
    """
    heavy = F.broadcast(_heavy_kmers(q_kmers, r_kmers, per_cell))
    one = F.lit(1)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))

    def spread(n: str, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.coalesce(n, one)).cast("int")

    left = q_kmers.join(heavy, "kmer", "left").withColumn("_row", spread("_rows", "seq_id", "qpos")).withColumn("_col", every("_cols"))
    right = r_kmers.join(heavy, "kmer", "left").withColumn("_col", spread("_cols", "rid", "strand", "rpos")).withColumn("_row", every("_rows"))
    sides = (x.drop("_rows", "_cols") for x in (left, right))
    return next(sides).join(next(sides), ["kmer", "_row", "_col"]).drop("_row", "_col")


def seed_tasks(queries: DataFrame, r_kmers: DataFrame, per_task: int = SEEDS_PER_TASK, least: int | None = None) -> int:
    """Tasks over which ``queries`` are dealt, so that each has about ``per_task`` seeds, and ``least`` bases.

    All queries are measured.  A base is taken to start as many seeds as one of the references' own
    k-mers does on average, which is more than in unrelated text.
    """
    size = F.col("len_bound") if "len_bound" in queries.columns else F.length("seq")
    bases = queries.agg(F.sum(size.cast("long"))).first()[0] or 0
    per_base = seeds_per_base(r_kmers)
    return max(1, min(math.ceil(bases * per_base / per_task), math.ceil(bases / (least or BASES_PER_TASK))))


def seeds_per_base(r_kmers: DataFrame) -> float:
    """Seeds that a base starts, if it is one of the references' own."""
    n = r_kmers.groupBy("kmer").agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0


def seeds(
    q_kmers: DataFrame,
    r_kmers: DataFrame,
    k: int,
    interval: int,
    n_index_rows: int,
    squash: bool = True,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``(seq_id, piece, n_pieces, qlen, rid, strand, qpos, rpos, u, v)``.

    K-mers of stretches that were sieved give the seeds on the references and strands ``wanted`` only.
    """
    sieved = "wanted" in q_kmers.columns
    hits = join_kmers(q_kmers, with_slot_bit(r_kmers) if sieved else r_kmers, n_index_rows, limit)
    if sieved:
        hits = hits.filter(wanted_seed())
    if squash:
        hits = hits.filter(keep_seed(k, interval))
    q, r = F.col("qpos").cast("long"), F.col("rpos").cast("long")
    return hits.select(
        "seq_id", "piece", "n_pieces", "qlen", "rid", "strand", "qpos", "rpos",
        rotate_u(q, r).alias("u"), rotate_v(q, r).alias("v"),
    )


def seed_lists(
    q_kmers: DataFrame, r_kmers: DataFrame, k: int, interval: int, n_index_rows: int, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """``(seq_id, piece, n_pieces, q, r)``: for every k-mer of a piece its positions and those of the index.

    The seeds of coded k-mers as products of two lists: an element of ``q`` (position, then in three bits the
    following base it refuses, zero for none, see ``keep_seed``) meets every element of ``r`` (reference and
    strand, offset in 28 bits, following base in three) but those with the refused base.  The rows of a piece
    follow each other as long as all k-mers of a piece come in one partition and the index is broadcast.
    """
    refused = F.when(on_interval(k, interval) | ~F.col("q_next").isin(*BASE_CODES), 0).otherwise(F.col("q_next"))
    q = F.col("qpos").cast("long") * 8 + refused
    left = q_kmers.groupBy("seq_id", "piece", "n_pieces", "kmer").agg(F.collect_list(q).alias("q"))
    slot = F.col("rid").cast("long") * 2 + (F.col("strand") == "-").cast("long")
    following = F.when(F.col("r_next").isin(*BASE_CODES), F.col("r_next")).otherwise(0)
    r = slot * (1 << 31) + F.col("rpos").cast("long") * 8 + following
    right = r_kmers.groupBy("kmer").agg(F.collect_list(r).alias("r"))
    # a broadcast join leaves the order of this side as it is
    left = left.sortWithinPartitions("seq_id", "piece", "n_pieces")
    return join_kmers(left, right, n_index_rows, limit).select("seq_id", "piece", "n_pieces", "q", "r")


def seed_totals(
    q_kmers: DataFrame,
    r_kmers: DataFrame,
    k: int,
    interval: int,
    n_index_rows: int,
    limit: int = BROADCAST_LIMIT,
    owned: PieceLayout | None = None,
) -> DataFrame:
    """``(seq_id, rid, strand, n_seeds, u_sum, v_min, v_max, q_sum, r_sum)`` over the squashed seeds of coded k-mers.

    The same numbers as an aggregate over ``seeds``, which with a short k has a row for every few pairs of
    positions.  Here positions are summed by k-mer on either side before the join, so that a
    pair of groups stands for the product of their seeds.  A query k-mer refuses at most one following base
    (``keep_seed``): it is grouped by that base, zero for none, and the index side has a group for each.

    With ``owned`` (their layout) ``q_kmers`` are the pieces that have the k-mers, all of a query in one partition;
    with a short k and an index that can be broadcast the groups then meet as matrices, not in a join.
    """
    n_groups = n_index_rows * (1 + len(BASE_CODES))
    refused = F.when(on_interval(k, interval) | ~F.col("q_next").isin(*BASE_CODES), 0).otherwise(F.col("q_next"))
    key = (F.col("kmer") * 10 + F.col("_refused")).alias("kmer")
    q, r = F.col("qpos").cast("long"), F.col("rpos").cast("long")
    allowed = F.filter(F.array(*[F.lit(c) for c in (0, *BASE_CODES)]), lambda c: ~c.eqNullSafe(F.col("r_next")))
    # the strand meets the seeds as a flag, since grouping by text costs twice the time
    flagged = r_kmers.withColumn("strand", F.col("strand") == "-").withColumn("_refused", F.explode(allowed))
    right = flagged.groupBy("rid", "strand", key).agg(
        F.count("*").alias("_rn"), F.sum(r).alias("_rs"), F.min(r).alias("rpos"), F.max(r).alias("_re")
    )
    if owned is not None:
        groups = Groups.of(right) if k <= LONGEST_PRODUCT and n_groups * BYTES_PER_INDEX_ROW <= limit else None
        if groups is not None:
            sums = multiplied(q_kmers, groups, k, interval, owned)
            return sums.withColumn("strand", F.when(F.col("minus"), "-").otherwise("+")).drop("minus")
        q_kmers = query_kmers(q_kmers, k, owned=owned, coded=True)
    left = q_kmers.withColumn("_refused", refused).groupBy("seq_id", key).agg(
        F.count("*").alias("_qn"), F.sum(q).alias("_qs"), F.min(q).alias("qpos"), F.max(q).alias("_qe")
    )
    met = join_kmers(left, right, n_groups, limit)
    sums = met.groupBy("seq_id", "rid", "strand").agg(
        F.sum(F.col("_qn") * F.col("_rn")).alias("n_seeds"),
        F.min(rotate_v(F.col("_qe"), F.col("rpos"))).alias("v_min"),
        F.max(rotate_v(F.col("qpos"), F.col("_re"))).alias("v_max"),
        F.sum(F.col("_qs") * F.col("_rn")).alias("q_sum"),
        F.sum(F.col("_rs") * F.col("_qn")).alias("r_sum"),
    )
    # u is linear, so its sum is that of the sums
    total_u = rotate_u(F.col("q_sum"), F.col("r_sum"))
    return sums.withColumn("u_sum", total_u).withColumn("strand", F.when(F.col("strand"), "-").otherwise("+"))


def diagonal_histogram(seed_df: DataFrame) -> DataFrame:
    """Seeds per diagonal of each (query, reference, strand)."""
    return seed_df.groupBy(
        "seq_id", "rid", "strand", (F.col("qpos") - F.col("rpos")).cast("long").alias("diagonal")
    ).agg(F.count("*").alias("n_seeds"))
