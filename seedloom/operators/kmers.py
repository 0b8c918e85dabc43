"""K-mer enumeration for references (both strands, ambiguity codes) and queries (pieces).

Coordinates are 0-based offsets on the *walked* strand: a reverse-strand k-mer's
``rpos`` counts from the start of the reverse complement, so both strands share
all the arithmetic that follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import AMBIGUOUS_CLASS, expand_ambiguous, reverse_complement
from ..profile import MAX_REF_LEN, Profile
from ..session import checkpointed


# --------------------------------------------------------------------------- references
def filter_reference_length(refs: DataFrame, seq: str = "rseq", strict: bool = True, longest: int = MAX_REF_LEN) -> DataFrame:
    """Keep references within the length limit; ``strict`` fails the job on a longer one."""
    too_long = F.length(seq) > longest
    if not strict:
        return refs.filter(~too_long)
    message = F.concat(F.lit("reference too long: "), F.length(seq).cast("string"))
    return refs.filter(F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def dense_reference_ids(refs: DataFrame, order: list[str]) -> DataFrame:
    """``rid`` 0..n-1 in input order, without one global sort task.

    Rows are range-partitioned by the order key; each partition numbers its own rows
    and adds the row count of the partitions before it (one tiny row per partition).
    The numbered table is checkpointed, so both uses see the same partitions.
    """
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = refs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_p", F.spark_partition_id()).withColumn(
        "_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    tagged = checkpointed(tagged)
    counts = tagged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (
        tagged.join(F.broadcast(offsets), "_p")
        .withColumn("rid", (F.col("_o") + F.col("_i")).cast("int"))
        .drop("_p", "_i", "_n", "_o")
    )


def both_strands(refs: DataFrame, seq: str = "rseq") -> DataFrame:
    """One row per strand with ``sseq``, the sequence as walked on that strand."""
    walked = F.array(
        F.struct(F.lit("+").alias("strand"), F.col(seq).alias("sseq")),
        F.struct(F.lit("-").alias("strand"), reverse_complement(seq).alias("sseq")),
    )
    return refs.withColumn("_w", F.explode(walked)).select(*refs.columns, "_w.strand", "_w.sseq")


def _ambiguity_variants(kmer: Column, k: int, max_columns: int) -> Column:
    """All plain k-mers an ambiguous one stands for.

    The leftmost ``max_columns`` ambiguous letters branch.  The default is the longest k, so
    that nothing is left out: 512 variants at most.
    """

    def step(acc, i):
        letter = F.substring(kmer, i, F.lit(1))
        seen = F.length(F.regexp_replace(F.substring(kmer, F.lit(1), i - 1), "[ACGT]", ""))
        bases = expand_ambiguous(letter)
        bases = F.when(seen < max_columns, bases).otherwise(F.slice(bases, 1, 1))
        return F.flatten(F.transform(acc, lambda p: F.transform(bases, lambda b: F.concat(p, b))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array(F.lit("")), step)


def reference_kmers(refs: DataFrame, k: int, max_amb_columns: int = 9, seq: str = "rseq") -> DataFrame:
    """``(rid, strand, kmer, rpos, r_next)``: every k-mer of both strands.

    ``r_next`` is the base after the k-mer on the walked strand, NULL at the end.  An
    ambiguous following base counts as the smaller of its two bases.
    """
    one = both_strands(refs, seq).filter(F.length(seq) >= k)
    # offsets into a byte string are O(1); into a UTF-8 string they scan from the start
    one = one.withColumn("_b", F.col("sseq").cast("binary"))
    pos = one.select(
        "rid", "strand", "_b", F.explode(F.sequence(F.lit(0), F.length("sseq") - k)).alias("rpos")
    )
    raw = pos.select(
        "rid",
        "strand",
        F.substring(F.col("_b"), F.col("rpos") + 1, F.lit(k)).cast("string").alias("kmer"),
        "rpos",
        F.substring(F.col("_b"), F.col("rpos") + k + 1, F.lit(1)).cast("string").alias("_n"),
    )
    ambiguous = F.col("kmer").rlike(AMBIGUOUS_CLASS)
    variants = F.when(ambiguous, _ambiguity_variants(F.col("kmer"), k, max_amb_columns)).otherwise(F.array("kmer"))
    return raw.select(
        "rid",
        "strand",
        F.explode(variants).alias("kmer"),
        "rpos",
        F.when(F.col("_n") != "", F.array_min(expand_ambiguous("_n"))).alias("r_next"),
    )


def dedup_kmers(kmers: DataFrame) -> DataFrame:
    """One row per (rid, strand, kmer, position); the smallest following base wins."""
    return kmers.groupBy("rid", "strand", "kmer", "rpos").agg(F.min("r_next").alias("r_next"))


def kmer_counts(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("rid", "kmer").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------------- queries
@dataclass(frozen=True)
class PieceLayout:
    """How a query is cut so that no task ever holds more than a bounded stretch.

    Piece ``b`` owns the chains whose first seed has ``u`` in ``[2*core*b, 2*core*(b+1))``.
    A chain advances at most ``rlen`` on the reference and twice that on the query, so
    ``ahead`` and ``behind`` bases around the owned stretch hold everything its seeds,
    flanks and extensions can touch.  ``warm`` is how far (in ``u``) before its own
    stretch a piece starts replaying the greedy chaining.
    """

    core: int
    behind: int
    ahead: int
    warm: int
    reach: int

    @classmethod
    def of(cls, max_rlen: int, profile: Profile, core: int | None = None, warm: int | None = None) -> PieceLayout:
        reach = 3 * max_rlen + 2 * max(1, profile.window)
        warm = 64 * max(1, profile.window) + reach if warm is None else warm
        core = max(1 << 16, 8 * max_rlen) if core is None else core
        if 2 * core < reach:
            raise ValueError("a piece must be longer than the farthest chain")
        return cls(
            core=core,
            behind=max(2 * max_rlen + 64, warm // 2 + 1),
            ahead=max(3 * max_rlen + 64, (reach + max_rlen) // 2 + 1) + profile.k + 1,
            warm=warm,
            reach=reach,
        )


def query_pieces(queries: DataFrame, layout: PieceLayout, spread: bool = False, tasks: int = 0) -> DataFrame:
    """``(seq_id[, name], piece, n_pieces, qlen, pstart, pseq)``; short queries stay whole.

    With ``spread`` the pieces of long queries are shuffled over the cluster, so that no
    task keeps a whole chromosome.  Short queries, the bulk, are not moved; the price is
    a second look at the input for the long ones.  A column ``len_bound``, if there is
    one, is an upper bound of the length that costs less to compute.  With ``tasks``, all pieces are
    dealt to so many tasks, which have fewer seeds each than the input's splits would.
    """
    if tasks:
        return _cut(queries, layout).repartition(tasks, "seq_id", "piece")
    if not spread:
        return _cut(queries, layout)
    size = F.col("len_bound") if "len_bound" in queries.columns else F.length("seq")
    long = size > layout.core
    moved = _cut(queries.filter(long), layout).repartition("seq_id", "piece")
    return _cut(queries.filter(~long), layout).unionByName(moved)


def _cut(queries: DataFrame, layout: PieceLayout) -> DataFrame:
    names = [c for c in ("name",) if c in queries.columns]
    base = queries.select("seq_id", *names, F.length("seq").alias("qlen"), F.col("seq").cast("binary").alias("_b"))
    n = F.greatest(F.lit(1), F.ceil(F.col("qlen") / layout.core).cast("int"))
    number = F.explode(F.sequence(F.lit(0), n - 1)).alias("piece")
    cut = base.select("seq_id", *names, "qlen", "_b", n.alias("n_pieces"), number)
    start = F.greatest(F.lit(0), F.col("piece") * layout.core - layout.behind)
    stop = F.least(F.col("qlen"), (F.col("piece") + 1) * layout.core + layout.ahead)
    return cut.withColumn("pstart", start).select(
        "seq_id",
        *names,
        "piece",
        "n_pieces",
        "qlen",
        "pstart",
        F.substring(F.col("_b"), F.col("pstart") + 1, stop - F.col("pstart")).alias("pseq"),
    )


# Base codes of the numeric k-mer form: one decimal digit per base, zero past the end.
_DIGITS = ("ACGTN", "12349")
BASE_CODES = (1, 2, 3, 4)


def coded_kmers(kmers: DataFrame) -> DataFrame:
    """A reference k-mer table with ``kmer`` as BIGINT and ``r_next`` as INT."""

    def digits(c: str) -> Column:
        return F.translate(F.col(c), *_DIGITS)

    return kmers.withColumn("kmer", digits("kmer").cast("long")).withColumn("r_next", digits("r_next").cast("int"))


def query_kmers(pieces: DataFrame, k: int, owned: PieceLayout | None = None, coded: bool = False) -> DataFrame:
    """``(seq_id, piece, n_pieces, qlen, kmer, qpos, q_next)`` for every k-mer of a piece.

    The last k-mer of a piece is left to the next piece unless the query ends there, so
    ``q_next`` is empty only at the true end.  Neighbouring pieces overlap; with ``owned``
    (their layout) each piece lists only the k-mers of its own core, so that every k-mer
    of the query appears once.  ``coded`` gives numbers instead of text (a k-mer and its
    following base come from one slice, and a join on a number probes faster).  A column ``wanted`` of the
    pieces, if there is one, goes along.
    """
    plen = F.length("pseq")
    at_end = F.col("pstart") + plen == F.col("qlen")
    first = F.lit(0)
    last = plen - k - F.when(at_end, 0).otherwise(1)
    if owned is not None:
        core_start = F.col("piece") * owned.core - F.col("pstart")
        # a stretch of a piece may begin behind the start of the core
        first, last = F.greatest(first, core_start), F.least(last, core_start + owned.core - 1)
    # a NULL array explodes to nothing; a filter here would be pushed below the text work and repeat it
    offsets = F.when(last >= first, F.sequence(first, last))
    text = F.col("pseq")
    if coded:
        text = F.translate(F.concat(text.cast("string"), F.lit("0")), *_DIGITS).cast("binary")
    along = [c for c in ("wanted",) if c in pieces.columns]
    keep = ["seq_id", "piece", "n_pieces", "qlen", "pstart", *along]
    # the text is prepared in a projection of its own, below the explode, once per piece
    ready = pieces.select(*keep, text.alias("_t"), offsets.alias("_o"))
    pos = ready.select(*keep, "_t", F.explode("_o").alias("_i"))
    qpos = (F.col("pstart") + F.col("_i")).alias("qpos")
    if coded:
        both = F.substring(F.col("_t"), F.col("_i") + 1, F.lit(k + 1)).cast("string").try_cast("long")
        one = pos.select("seq_id", "piece", "n_pieces", "qlen", *along, qpos, both.alias("_c"))
        return one.select(
            "seq_id", "piece", "n_pieces", "qlen", *along, F.expr("_c div 10").alias("kmer"), "qpos",
            (F.col("_c") % 10).cast("int").alias("q_next"),
        )
    return pos.select(
        "seq_id",
        "piece",
        "n_pieces",
        "qlen",
        *along,
        F.substring(F.col("_t"), F.col("_i") + 1, F.lit(k)).cast("string").alias("kmer"),
        qpos,
        F.substring(F.col("_t"), F.col("_i") + k + 1, F.lit(1)).cast("string").alias("q_next"),
    )
