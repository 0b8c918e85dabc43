"""Sums over the seeds of texts and references as products of matrices, for k-mers so short that all meet all.

A text has a row of numbers by k-mer, a reference and strand a column; what both say of a k-mer is multiplied and
summed.  The join would make a row for every k-mer that a text and a reference share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import bound_arrow_batches
from .kmers import BASE_CODES, PieceLayout
from .sieve import _NONE, kmer_codes, numbered, texts

# Texts and bases of a step, texts that are compared at a time, and cells of a matrix of the references.
TEXTS, BASES, NEAR_TEXTS = 256, 1 << 20, 64
MOST_CELLS = 1 << 22
# Sums below this are exact as doubles.
EXACT = float(1 << 52)
_FAR = {np.int32: 1 << 29, np.int64: 1 << 60}
_INT = pa.int64()


@dataclass(frozen=True)
class Groups:
    """The index by group of k-mers (rows, in order of ``key``) and by reference and strand (columns).

    Where a reference has no k-mer of a group, ``high`` is -1.
    """

    key: np.ndarray
    rid: pa.Array
    minus: np.ndarray
    n: np.ndarray
    r_sum: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, right: DataFrame) -> Groups | None:
        """From ``(rid, strand, kmer, _rn, _rs, rpos, _re)``, which are collected; None if there are too many cells."""
        rows = right.toArrow()
        key, where = np.unique(rows.column("kmer").to_numpy(), return_inverse=True)
        column = rows.column("rid").combine_chunks()
        none = column.is_null().to_numpy(zero_copy_only=False)
        minus = rows.column("strand").to_numpy().astype(np.int64)
        number = np.where(none, 1 << 40, column.fill_null(0).to_numpy().astype(np.int64)) * 2 + minus
        slots, first, slot = np.unique(number, return_index=True, return_inverse=True)
        if len(key) * len(slots) > MOST_CELLS:
            return None

        def table(c: str, empty: int) -> np.ndarray:
            cells = np.full((len(key), len(slots)), empty, np.int64)
            cells[where, slot] = rows.column(c).to_numpy()
            return cells

        return cls(
            key, column.take(pa.array(first)), minus[first] > 0, table("_rn", 0).astype(np.float64), table("_rs", 0).astype(np.float64),
            table("rpos", 0), table("_re", -1),
        )


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left @ right
    if out.max(initial=0) < EXACT:
        return out.astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64)


def _nearest(low: np.ndarray, high: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest ``2 * r - q`` of the pairs of each text and reference; a group that is empty is far away."""
    near = max(high.max(initial=0), groups.high.max(initial=0)) < _FAR[np.int32] // 4
    kind = np.int32 if near else np.int64
    far = _FAR[kind]
    r_low, r_high = np.where(groups.high < 0, far, 2 * groups.low).astype(kind), np.where(groups.high < 0, -far, 2 * groups.high).astype(kind)
    q_low, q_high = (np.ascontiguousarray(np.where(high < 0, x, y).T.astype(kind)) for x, y in ((far // 2, low), (-far // 2, high)))
    shape = (len(low), groups.n.shape[1])
    least, most = np.full(shape, 3 * (far // 2), np.int64), np.full(shape, -3 * (far // 2), np.int64)
    used = np.flatnonzero((high >= 0).any(axis=0)).tolist()
    # few texts at a time, so that what is compared stays in the cache
    for a in range(0, len(low), NEAR_TEXTS):
        rows = slice(a, min(a + NEAR_TEXTS, len(low)))
        least_, most_ = least[rows].astype(kind), most[rows].astype(kind)
        room = np.empty_like(least_)
        for g in used:
            np.subtract(r_low[g], q_high[g, rows, None], out=room)
            np.minimum(least_, room, out=least_)
            np.subtract(r_high[g], q_low[g, rows, None], out=room)
            np.maximum(most_, room, out=most_)
        least[rows], most[rows] = least_, most_
    return least, most


class Texts:
    """What the k-mers of some texts sum up to, by text (rows) and group (columns; the last for those of no reference)."""

    def __init__(self, n: int, groups: Groups):
        self.groups, shape = groups, (n, len(groups.key) + 1)
        self.n, self.q_sum = np.zeros(shape), np.zeros(shape)
        self.low, self.high = np.full(shape, _FAR[np.int64]), np.full(shape, -1)

    def add(self, rows: pa.RecordBatch, text: np.ndarray, step: Step) -> None:
        """``rows`` are pieces; ``text`` says whose each is."""
        data, start, end = texts(rows.column("pseq"))
        base, code = kmer_codes(data, start, end, step.k)
        piece, pstart, qlen = (rows.column(c).to_numpy().astype(np.int64) for c in ("piece", "pstart", "qlen"))
        row = np.repeat(np.arange(len(start)), end - start)
        q = np.arange(len(code)) + (pstart - start)[row]
        mine = np.flatnonzero((code >= 0) & (q >= (piece * step.core)[row]) & (q < ((piece + 1) * step.core)[row]))
        row, q, code = row[mine], q[mine], code[mine]
        after = mine + step.k
        refused = np.append(base, _NONE)[after] + 1
        # the squash of ``keep_seed``: no base is refused at the end of the text and on the interval
        refused[(refused > len(BASE_CODES)) | (after >= end[row]) | ((qlen[row] - (q + step.k)) % step.interval == 0)] = 0
        at = text[row] * self.n.shape[1] + step.column[code * (1 + len(BASE_CODES)) + refused]
        self.n += np.bincount(at, minlength=self.n.size).reshape(self.n.shape)
        self.q_sum += np.bincount(at, q, minlength=self.n.size).reshape(self.n.shape)
        np.minimum.at(self.low.reshape(-1), at, q)
        np.maximum.at(self.high.reshape(-1), at, q)

    def take(self, other: Texts) -> None:
        """``other`` is more of the first text."""
        self.n[0] += other.n[0]
        self.q_sum[0] += other.q_sum[0]
        np.minimum(self.low[0], other.low[0], out=self.low[0])
        np.maximum(self.high[0], other.high[0], out=self.high[0])

    def of(self, some: slice) -> Texts:
        out = Texts(0, self.groups)
        out.n, out.q_sum, out.low, out.high = (c[some] for c in (self.n, self.q_sum, self.low, self.high))
        return out

    def sums(self, ids: pa.Array) -> pa.RecordBatch:
        groups, real = self.groups, slice(0, -1)
        seeds, q_sum = _product(self.n[:, real], groups.n), _product(self.q_sum[:, real], groups.n)
        r_sum = _product(self.n[:, real], groups.r_sum)
        least, most = _nearest(self.low[:, real], self.high[:, real], groups)
        row, slot = np.nonzero(seeds)
        whole = [x[row, slot] for x in (seeds, 2 * q_sum - r_sum, least, most, q_sum, r_sum)]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row)), groups.rid.take(pa.array(slot)), pa.array(groups.minus[slot]), *[pa.array(x, _INT) for x in whole]],
            names=["seq_id", "rid", "minus", "n_seeds", "u_sum", "v_min", "v_max", "q_sum", "r_sum"],
        )


@dataclass(frozen=True)
class Step:
    """Plain numbers of a profile and a layout, and the column of each code and refused base."""

    k: int
    interval: int
    core: int
    column: np.ndarray

    @classmethod
    def of(cls, groups: Groups, k: int, interval: int, layout: PieceLayout) -> Step:
        code, digits = np.arange(4**k), np.zeros(4**k, np.int64)
        for i in range(k):
            digits += (code // 4**i % 4 + 1) * 10**i
        wanted = (digits[:, None] * 10 + np.arange(1 + len(BASE_CODES))).ravel()
        at = np.minimum(np.searchsorted(groups.key, wanted), len(groups.key) - 1)
        return cls(k, interval, layout.core, np.where(groups.key[at] == wanted, at, len(groups.key)))


def _stream(groups, step: Step) -> Callable:
    """Arrow function over pieces in order of their texts; ``groups`` are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last text may go on
        open_id, held = None, None
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("pseq")))
            if not batch.num_rows:
                continue
            number = numbered(batch, ["seq_id"])
            size = np.cumsum(pc.binary_length(batch.column("pseq")).to_numpy())
            begin = 0
            while begin < len(number):
                done = size[begin - 1] if begin else 0
                stop = min(int(np.searchsorted(number, number[begin] + TEXTS)), max(begin + 1, int(np.searchsorted(size, done + BASES))))
                rows, text = batch.slice(begin, stop - begin), number[begin:stop] - number[begin]
                ids = rows.column("seq_id").take(pa.array(np.flatnonzero(np.diff(text, prepend=-1))))
                found = Texts(len(ids), groups.value)
                found.add(rows, text, step)
                if held is not None:
                    if open_id.equals(ids.slice(0, 1)):
                        found.take(held)
                    else:
                        yield held.sums(open_id)
                if len(ids) > 1:
                    yield found.of(slice(0, -1)).sums(ids.slice(0, len(ids) - 1))
                open_id, held = ids.slice(len(ids) - 1), found.of(slice(len(ids) - 1, None))
                begin = stop
        if held is not None:
            yield held.sums(open_id)

    return run


def multiplied(pieces: DataFrame, groups: Groups, k: int, interval: int, layout: PieceLayout) -> DataFrame:
    """``(seq_id, rid, minus, n_seeds, u_sum, v_min, v_max, q_sum, r_sum)`` of every text and reference with squashed seeds.

    All pieces of a text must share a partition.
    """
    bound_arrow_batches(pieces.sparkSession)
    context = pieces.sparkSession.sparkContext
    kind = pieces.schema["seq_id"].dataType.simpleString()
    sums = ", ".join(f"{c} long" for c in ("n_seeds", "u_sum", "v_min", "v_max", "q_sum", "r_sum"))
    step = _stream(context.broadcast(groups), Step.of(groups, k, interval, layout))
    ordered = pieces.select("seq_id", "piece", "qlen", "pstart", "pseq").sortWithinPartitions("seq_id", "piece")
    return ordered.mapInArrow(step, f"seq_id {kind}, rid int, minus boolean, {sums}")
