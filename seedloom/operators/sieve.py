"""Sieve of query pieces: the stretches whose seeds can matter, before a k-mer becomes a row.

Nearly all seeds of unrelated texts stand alone, and a row for each costs more than all that follows.
Here the pieces of a step are met with the index as arrays, their seeds are counted, and a piece is cut down
to the stretches around the k-mers that have a seed worth keeping: on a diagonal with enough seeds
(``on_diagonals``), or in a run from which a chain can be made (``in_runs``).  The stretches are pieces
again, and pass through the same k-mers, join and grouping as whole pieces would; ``wanted`` tells on
which references and strands they are (``wanted_seed``).  The sieve may let more through than is needed, never less:
a group that counts has all of its seeds, the others are short of theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_arrow_batches
from .kmers import PieceLayout

# Bases and seeds that a step looks at; a piece with more seeds passes as it is.
BASES_PER_STEP = 1 << 17
SEEDS_PER_STEP = 1 << 21
# Stretches that are no farther apart are one.
JOINED = 16
# What copies of one piece share.
UNIT = ["seq_id", "piece"]
# Bits of ``wanted``: a reference and strand has the one of its number modulo this.
SLOT_BITS = 512
_NONE = 4  # no base, or none that can be read
_CODES = np.full(256, _NONE, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slot() -> Column:
    """Number of a reference and strand."""
    return F.coalesce(F.col("rid").cast("long"), F.lit(1 << 40)) * 2 + (F.col("strand") == "-").cast("long")


def with_slot_bit(r_kmers: DataFrame) -> DataFrame:
    """``r_kmers`` with the place in ``wanted`` that ``wanted_seed`` looks at."""
    bit = F.pmod(_slot(), F.lit(SLOT_BITS)).cast("int")
    # words of 32 bits, so that every one is a number without a sign
    return r_kmers.withColumn("_word", F.floor(bit / 32).cast("int")).withColumn("_bit", F.pow(F.lit(2), bit % 32).cast("long"))


def wanted_seed() -> Column:
    """Whether a seed's stretch of text has one that counts on the same reference and strand."""
    return F.get("wanted", F.col("_word")).bitwiseAND(F.col("_bit")) != 0


@dataclass(frozen=True)
class KmerTable:
    """The k-mers of an index by code: those of ``c`` are ``count[c]`` rows from ``first[c]`` on."""

    k: int
    first: np.ndarray
    count: np.ndarray
    slots: np.ndarray
    slot: np.ndarray
    bit: np.ndarray
    rpos: np.ndarray
    r_next: np.ndarray
    longest: int

    @classmethod
    def of(cls, r_kmers: DataFrame, k: int) -> KmerTable:
        """From coded k-mers, which are collected: the caller knows that they fit."""
        rows = r_kmers.select(_slot().alias("slot"), "kmer", "rpos", F.coalesce("r_next", F.lit(0)).alias("r_next")).toArrow()
        slot, digits, rpos, r_next = (rows.column(c).to_numpy() for c in ("slot", "kmer", "rpos", "r_next"))
        code = np.zeros(len(digits), np.int64)
        for i in reversed(range(k)):
            code = code * 4 + digits // 10**i % 10 - 1
        order = np.argsort(code, kind="stable")
        slot = slot[order]
        bit, (slots, slot) = slot % SLOT_BITS, np.unique(slot, return_inverse=True)
        # the last count stands for a place where no k-mer begins
        count = np.append(np.bincount(code, minlength=4**k), 0)
        first = np.cumsum(count) - count
        r_next = np.where(r_next > 0, r_next - 1, _NONE).astype(np.uint8)
        longest = int(rpos.max(initial=0)) + k
        return cls(k, first, count, slots, slot.astype(np.int64), bit, rpos[order].astype(np.int64), r_next[order], longest)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all rows in one array, and where each row starts and ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[:-1] - ends[0], ends[1:] - ends[0]


def kmer_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Base codes of all letters, and the codes of the k-mers that begin there; -1 where none does."""
    base = _CODES[data]
    code = np.full(len(base), -1, np.int32)
    n = len(code) - k + 1
    if n > 0:
        whole = (base & 3).astype(np.int32)[:n].copy()
        for j in range(1, k):
            whole *= 4
            whole += base[j : j + n] & 3
        code[:n] = whole
    for j in range(1, k):
        at = end - j
        code[at[at >= start]] = -1
    unread = np.flatnonzero(base == _NONE)
    if len(unread):
        step = np.zeros(len(code) + 1, np.int32)
        np.add.at(step, np.maximum(unread - k + 1, 0), 1)
        np.add.at(step, unread + 1, -1)
        code[np.cumsum(step)[:-1] > 0] = -1
    return base, code


class Pieces:
    """Rows of one step: bases of all pieces in one array, and where each stands."""

    def __init__(self, rows: pa.RecordBatch, unit: np.ndarray, table: KmerTable, apart: int):
        self.rows, self.table = rows, table
        self.data, self.start, self.end = texts(rows.column("pseq"))
        self.size = self.end - self.start
        self.pstart, self.qlen = (rows.column(c).to_numpy().astype(np.int64) for c in ("pstart", "qlen"))
        # units follow each other on one line, farther apart than anything reaches; copies lie on each other
        head = np.flatnonzero(np.diff(unit, prepend=-1))
        low, high = np.minimum.reduceat(self.pstart, head), np.maximum.reduceat(self.pstart + self.size, head)
        room = high - low + apart
        self.head, self.begin = head, np.cumsum(room) - room
        self.low, at = low, self.begin - low
        self.line = int(room.sum()) + apart
        self.shift = np.repeat(at, np.diff(np.append(head, len(unit)))) + self.pstart - self.start

    def kmers(self) -> np.ndarray:
        """Codes of the k-mers of all rows, by place; -1 where none begins."""
        self.base, code = kmer_codes(self.data, self.start, self.end, self.table.k)
        return code

    def pairs(self, most: int) -> bool:
        """Finds the seeds; False if there are more than ``most``."""
        t, code = self.table, self.kmers()
        n = t.count[code]
        hit = np.flatnonzero(n)
        n = n[hit]
        total = int(n.sum())
        if total > most:
            return False
        self.hit = hit
        self.row = np.searchsorted(self.end, hit, "right")
        self.n, self.before = n, np.cumsum(n) - n
        self.index = np.repeat(t.first[code[hit]] - self.before, n)
        self.index += np.arange(total)
        self.at = hit + self.shift[self.row]
        return True

    # of each seed; what is not asked for is not made
    @cached_property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.hit)), self.n)

    @cached_property
    def slot(self) -> np.ndarray:
        return self.table.slot[self.index]

    @cached_property
    def rpos(self) -> np.ndarray:
        return self.table.rpos[self.index]

    @cached_property
    def place(self) -> np.ndarray:
        return np.repeat(self.at, self.n)

    def diagonals(self) -> np.ndarray:
        """A number for the slot and diagonal of each seed."""
        t = self.table
        key = (t.slot * self.line - t.rpos + t.longest)[self.index]
        key += self.place
        return key

    def stretches(self, wanted: np.ndarray) -> pa.RecordBatch:
        """The rows cut down to the stretches around the seeds of ``wanted``."""
        k = self.table.k
        mark = np.zeros(len(self.data), bool)
        where = self.hit[np.searchsorted(self.before, wanted, "right") - 1]
        mark[where] = True
        at = np.flatnonzero(mark)
        row = np.searchsorted(self.end, at, "right")
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > JOINED) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        a, row = at[first], row[first]
        last = at[np.append(first[1:], len(at)) - 1] if len(first) else at
        # one base more than the k-mers, since it tells what follows the last
        size = np.minimum(last + k + 1, self.end[row]) - a
        begin = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(a - begin[:-1], size) + np.arange(begin[-1])
        text = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(self.data[index])])
        own = {"pseq": text, "pstart": pa.array((self.pstart[row] + a - self.start[row]).astype(np.int32))}
        flags = np.zeros((len(a), SLOT_BITS), np.uint8)
        flags[np.searchsorted(a, where, "right") - 1, self.table.bit[self.index[wanted]]] = 1
        names, take = self.rows.schema.names, pa.array(row)
        columns = [own[c] if c in own else self.rows.column(c).take(take) for c in names]
        return pa.RecordBatch.from_arrays([*columns, _words(flags)], names=[*names, "wanted"])


def _words(flags: np.ndarray) -> pa.Array:
    """Lists of numbers of 32 bits each."""
    words = np.packbits(flags, axis=1, bitorder="little").view("<u4").astype(np.int64)
    return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1], words.ravel())


def _crowded(key: np.ndarray, least: int) -> np.ndarray:
    """Which keys are given ``least`` times."""
    bits = max(10, int(2 * len(key)).bit_length())
    bucket = key.view(np.uint64) * _SPREAD
    bucket >>= np.uint64(64 - bits)
    bucket = bucket.view(np.int64)
    some = np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] >= least)
    # buckets may hold several keys; what is left is few enough to be told apart
    _, which, n = np.unique(key[some], return_inverse=True, return_counts=True)
    return some[n[which] >= least]


def _of_diagonals(least: int) -> Callable[[Pieces], np.ndarray]:
    def wanted(p: Pieces) -> np.ndarray:
        return _crowded(p.diagonals(), least)

    return wanted


def _of_runs(least: int, window: int, interval: int) -> Callable[[Pieces], np.ndarray]:
    span = max(1, (least - 1) * window)

    def wanted(p: Pieces) -> np.ndarray:
        t = p.table
        # the squash of ``keep_seed``; a piece does not know what follows its last k-mer
        after = p.hit + t.k
        q_next = np.append(p.base, _NONE)[after]
        q_next[after >= p.end[p.row]] = _NONE
        q = p.hit - p.start[p.row] + p.pstart[p.row]
        stays = (p.qlen[p.row] - (q + t.k)) % interval == 0
        q_next[stays] = _NONE
        follows = np.repeat(q_next, p.n)
        kept = np.flatnonzero((follows == _NONE) | (follows != t.r_next[p.index]))
        u = 2 * p.place[kept] - p.rpos[kept] + t.longest
        # seeds of a run lie in one cell or two neighbours
        line = 2 * p.line + t.longest + 2 * span
        key = p.slot[kept] * (line // span + 2) + u // span
        size = 1 << max(10, int(4 * len(key)).bit_length())
        cell = key & (size - 1)
        n = np.bincount(cell, minlength=size)
        near = n[cell] + np.maximum(n[cell - 1], n[(cell + 1) & (size - 1)])
        some = np.flatnonzero(near >= least)
        key = p.slot[kept[some]] * line + u[some]
        order = np.argsort(key, kind="stable")
        run = np.cumsum(np.diff(key[order], prepend=-window - 1) > window) - 1
        full = some[order[np.bincount(run)[run] >= least]] if len(run) else some
        # what lies behind the ends of a cut piece is not known here
        row = p.row[p.of[kept]]
        real = 2 * (p.place[kept] - p.shift[row] - p.start[row] + p.pstart[row]) - p.rpos[kept]
        stop = p.pstart + p.size
        cut = (p.pstart[row] > 0) & (real <= 2 * p.pstart[row] + span)
        cut |= (stop < p.qlen)[row] & (real >= 2 * (stop[row] - t.k) - t.longest - span)
        return kept[np.union1d(full, np.flatnonzero(cut))]

    return wanted


def _cut_down(wanted: Callable[[Pieces], np.ndarray]) -> tuple[Callable, Callable]:
    """Stretches of pieces that a step can look at, and the other pieces whole."""

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        every = _words(np.ones((rows.num_rows, SLOT_BITS), np.uint8))
        return pa.RecordBatch.from_arrays([*rows.columns, every], names=[*rows.schema.names, "wanted"])

    return lambda pieces: pieces.stretches(wanted(pieces)), whole


def _histogram(core: int) -> tuple[Callable, Callable]:
    """Seeds by diagonal of pieces that a step can look at; a diagonal is counted by the piece whose core it starts in."""

    def counted(p: Pieces) -> pa.RecordBatch:
        row, t = p.row[p.of], p.table
        diagonal = p.place - p.shift[row] - p.start[row] + p.pstart[row] - p.rpos
        own = np.maximum(diagonal // core, 0) == p.rows.column("piece").to_numpy()[row]
        key, n = np.unique(p.diagonals()[own], return_counts=True)
        slot, at = key // p.line, key % p.line - t.longest
        unit = np.searchsorted(p.begin - t.longest, at, "right") - 1
        value = t.slots[slot]
        return pa.RecordBatch.from_arrays(
            [
                p.rows.column("seq_id").take(pa.array(p.head[unit])), pa.array(value >> 1, mask=value >> 41 > 0).cast(pa.int32()),
                pa.array(value & 1 > 0), pa.array(at - p.begin[unit] + p.low[unit]), pa.array(n.astype(np.int64)),
            ],
            names=["seq_id", "rid", "minus", "diagonal", "n_seeds"],
        )

    return counted, lambda rows: None


def _step(rows: pa.RecordBatch, unit: np.ndarray, table: KmerTable, apart: int, made: tuple[Callable, Callable], most: int) -> Iterator[pa.RecordBatch]:
    pieces = Pieces(rows, unit, table, apart)
    of_seeds, of_others = made
    if pieces.pairs(most):
        out = of_seeds(pieces)
        if out is not None:
            yield out
    elif unit[0] == unit[-1]:
        out = of_others(rows)
        if out is not None:
            yield out
    else:
        middle = np.searchsorted(unit, (unit[0] + unit[-1] + 1) // 2)
        for part in (slice(0, middle), slice(middle, len(unit))):
            yield from _step(rows.slice(part.start, part.stop - part.start), unit[part], table, apart, made, most)


def numbered(rows: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Number of the value of ``columns`` that each row has, in the order of the rows; null is a value."""
    new = np.zeros(rows.num_rows, bool)
    for c in columns:
        column = rows.column(c)
        none = column.is_null().to_numpy(zero_copy_only=False)
        plain = pc.fill_null(column, 0).to_numpy()
        new[1:] |= (plain[1:] != plain[:-1]) | (none[1:] != none[:-1])
    return np.cumsum(new)


def _stream(table, apart: int, made: tuple[Callable, Callable], bases: int, most: int) -> Callable:
    """Arrow function over pieces in order; ``table`` is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def steps(rows: pa.RecordBatch, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
            size = np.cumsum(pc.binary_length(rows.column("pseq")).to_numpy())
            begin = 0
            while begin < len(unit):
                done = size[begin - 1] if begin else 0
                stop = max(begin, int(np.searchsorted(size, done + bases)))
                stop = int(np.searchsorted(unit, unit[min(stop, len(unit) - 1)], "right"))
                yield from _step(rows.slice(begin, stop - begin), unit[begin:stop], table.value, apart, made, most)
                begin = stop

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("pseq")))
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            unit = numbered(rows, UNIT)
            last = int(np.searchsorted(unit, unit[-1]))
            if last:
                yield from steps(rows.slice(0, last), unit[:last])
            # copies of the last piece may follow in the next batch
            held = rows.slice(last)
        if held is not None:
            yield from steps(held, numbered(held, UNIT))

    return run


def _looked_at(pieces: DataFrame, table: KmerTable, apart: int, made: tuple[Callable, Callable], schema: T.StructType | str) -> DataFrame:
    """What the two functions make of pieces that a step can look at, and of the others."""
    bound_arrow_batches(pieces.sparkSession)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    step = _stream(shared, apart, made, BASES_PER_STEP, SEEDS_PER_STEP)
    return pieces.sortWithinPartitions(*UNIT).mapInArrow(step, schema)


def _sieved(pieces: DataFrame, table: KmerTable, apart: int, wanted: Callable) -> DataFrame:
    schema = T.StructType([*pieces.schema, T.StructField("wanted", T.ArrayType(T.LongType()))])
    return _looked_at(pieces, table, apart, _cut_down(wanted), schema)


def on_diagonals(pieces: DataFrame, table: KmerTable, least: int) -> DataFrame:
    """``pieces`` without k-mers that have no seed on a diagonal of ``least`` seeds.

    Copies of a (query, piece) are counted together, so they must share a partition.  A piece has to
    show as much text around the part it owns as a reference is long.
    """
    return _sieved(pieces, table, table.longest + 1, _of_diagonals(least))


def in_runs(pieces: DataFrame, table: KmerTable, least: int, window: int, interval: int) -> DataFrame:
    """``pieces`` without k-mers that have no squashed seed in a run of ``least`` seeds.

    A run has no gap in ``u`` wider than the window, as in chains.py.  Copies of a (query, piece) in
    one partition count together.
    """
    apart = 2 * (table.longest + (least + 1) * (window + 1))
    return _sieved(pieces, table, apart, _of_runs(least, window, interval))


def diagonal_counts(pieces: DataFrame, table: KmerTable, layout: PieceLayout) -> tuple[DataFrame, DataFrame]:
    """``(seq_id, rid, strand, diagonal, n_seeds)`` of all seeds, but for pieces with too many; and those pieces.

    As ``diagonal_histogram`` of the seeds, of which none becomes a row.  Copies of a (query, piece) must share a
    partition.  A diagonal belongs to the piece whose core it starts in (``own_diagonal``).
    """
    apart, kind = table.longest + 1, pieces.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {kind}, rid int, minus boolean, diagonal long, n_seeds long"
    counts = _looked_at(pieces, table, apart, _histogram(layout.core), schema)
    others = _looked_at(pieces, table, apart, (lambda p: None, lambda rows: rows), pieces.schema)
    strand = F.when(F.col("minus"), "-").otherwise("+").alias("strand")
    return counts.select("seq_id", "rid", strand, "diagonal", "n_seeds"), others


def own_diagonal(layout: PieceLayout) -> Column:
    """Whether the diagonal of a seed of a piece belongs to it."""
    start = F.floor((F.col("qpos") - F.col("rpos")) / layout.core)
    return F.greatest(F.lit(0), start) == F.col("piece")
