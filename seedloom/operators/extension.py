"""X-drop affine-gap extension of two sequences from their common start.

Batched over many pairs: each reference column is a handful of array operations over
all pairs still alive.  The query axis is handled in blocks of eight rows, which live
or drop as a whole.

The path is found afterwards, also by all pairs together.  The state before every
``STRETCH``-th column is kept; the columns of a stretch, with their path marks, are computed again when
the walk back enters it, so marks never fill more than one stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.alphabet import IUPAC_LETTERS, IUPAC_MASK
from ..profile import Profile

BLOCK = 8
NEG = -(1 << 28)
PAD_SCORE = -64
STRETCH = 64  # columns between two kept states
BATCH_PAIRS, BATCH_BYTES = 2048, 1 << 28  # pairs that step together, and what their columns may take
CELL_BYTES = 48  # of a live cell: states, sums and marks

_Q_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _Q_CODE[ord(_b)] = _i
_R_CODE = np.full(256, len(IUPAC_LETTERS), np.uint8)
for _i, _b in enumerate(IUPAC_LETTERS):
    _R_CODE[ord(_b)] = _i
_Q_MASK = np.array([IUPAC_MASK[b] for b in "ACGT"] + [0], np.uint8)
_R_MASK = np.array([IUPAC_MASK[b] for b in IUPAC_LETTERS] + [0], np.uint8)

# traceback bits of a cell
S_FROM_F, S_FROM_E, U_FROM_E, F_EXTENDS, E_EXTENDS = 1, 2, 4, 8, 16
# what the walk back is in: no gap, an insertion or a deletion that goes on
IN_S, IN_F, IN_E = 0, 1, 2
OP_M, OP_I, OP_D = 0, 1, 2


class Scores:
    """Plain numbers of a profile, as they travel to the workers."""

    def __init__(self, profile: Profile):
        table = np.full((len(IUPAC_LETTERS) + 1, 5), PAD_SCORE, np.int32)
        table[: len(IUPAC_LETTERS), :4] = np.array(profile.score_table(), np.int32).T
        self.table = table.ravel()
        self.ins_open, self.ins_extend = profile.ins_open, profile.ins_extend
        self.del_open, self.del_extend = profile.del_open, profile.del_extend
        self.xdrop, self.bonus = profile.xdrop, profile.end_bonus


def _codes(seqs: list[str], lut: np.ndarray, pad: int, lengths: np.ndarray, width: int) -> np.ndarray:
    out = np.full((len(seqs), width), pad, np.uint8)
    flat = lut[np.frombuffer("".join(seqs).encode("ascii"), np.uint8)]
    mask = np.arange(width) < lengths[:, None]
    out[mask] = flat
    return out


def _column(U, lo, bottom, end_max, thr, s):
    """Fold the vertical gap into a column and find its live blocks.

    Returns ``S, F, U, first, end, ok``; block indices are absolute.
    """
    n, w = U.shape
    ramp = (lo + np.arange(w, dtype=np.int32)) * s.ins_extend

    def fold(u):
        run = np.maximum.accumulate(u + ramp, axis=1)
        f = np.full_like(u, NEG)
        f[:, 1:] = run[:, :-1] - s.ins_open - ramp[1:]
        return np.maximum(u, f), f

    S, Fv = fold(U)
    nb = w // BLOCK
    block = lo // BLOCK + np.arange(nb)
    alive = (S > thr[:, None]).reshape(n, nb, BLOCK).any(axis=2) & (block < end_max[:, None])
    first = block[alive.argmax(axis=1)]
    ok = alive.any(axis=1) & (first < bottom)
    cut = U.reshape(n, nb, BLOCK).max(axis=2) > NEG // 2
    if (cut & (block < first[:, None]) & ok[:, None]).any():
        # dropped leading blocks hand no gap down to the live ones
        keep = np.repeat(block >= first[:, None], BLOCK, axis=1)
        U = np.where(keep, U, NEG)
        S, Fv = fold(U)
        alive = (S > thr[:, None]).reshape(n, nb, BLOCK).any(axis=2) & (block < end_max[:, None])
    stop = ~alive & (block > first[:, None])
    end = np.where(stop.any(axis=1), block[stop.argmax(axis=1)], block[-1] + 1)
    return S, Fv, U, first, end, ok


@dataclass
class Front:
    """Pairs still alive (their numbers), their live blocks, and the last column from row ``lo`` on."""

    rows: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    lo: int
    S: np.ndarray | None = None
    E: np.ndarray | None = None


class Batch:
    """Pairs that are extended together, column by column of the reference."""

    def __init__(self, queries: list[str], refs: list[str], s: Scores):
        self.s = s
        self.qlen = np.array([len(x) for x in queries], np.int64)
        self.rlen = np.array([len(x) for x in refs], np.int64)
        n, longest = len(queries), int(self.qlen.max())
        self.width = int((longest + 1 + BLOCK - 1) // BLOCK * BLOCK)
        # row i of the matrix consumes query base i - 1
        self.q = np.full((n, self.width), 4, np.uint8)
        self.q[:, 1 : 1 + longest] = _codes(queries, _Q_CODE, 4, self.qlen, longest)
        self.r = _codes(refs, _R_CODE, len(IUPAC_LETTERS), self.rlen, max(1, int(self.rlen.max())))
        self.blen = (self.qlen + 1 + BLOCK - 1) // BLOCK
        self.score = np.zeros(n, np.int32)
        self.best_i = np.zeros(n, np.int64)
        self.best_j = np.zeros(n, np.int64)

    def first(self) -> Front:
        n = len(self.qlen)
        return Front(np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64), 0)

    def column(self, at: Front, j: int, score: np.ndarray, trace: bool):
        """Column ``j``: the next front (``None`` at the end), the pairs it has, its first row, marks and ``S`` of the body.

        ``score`` is each pair's best so far, which the drop is measured from.
        """
        s, q, r, rlen = self.s, self.q, self.r, self.rlen
        rows, top, bottom, lo, S_prev, E_prev = at.rows, at.top, at.bottom, at.lo, at.S, at.E
        if j > 0:
            live = rlen[rows] >= j
            if not live.all():
                rows, top, bottom = rows[live], top[live], bottom[live]
                S_prev, E_prev = S_prev[live], E_prev[live]
            if not len(rows):
                return None, rows, 0, None, None
        thr = score[rows] - s.xdrop
        end_max = self.blen[rows]
        m = len(rows)
        spare = 1
        while True:
            # slice of query rows this column may touch
            new_lo = int(top.min()) * BLOCK
            new_hi = min(self.width, (int(bottom.max()) + spare) * BLOCK)
            w = new_hi - new_lo
            if j == 0:
                U = np.full((m, w), NEG, np.int32)
                U[:, 0] = 0
                E_in = np.full((m, w), NEG, np.int32)
                diag = None
            else:
                E_in = np.full((m, w), NEG, np.int32)
                diag = np.full((m, w), NEG, np.int32)
                have = E_prev.shape[1]
                off = new_lo - lo  # blocks below the lowest live one fell away
                take = min(have - off, w)
                E_in[:, :take] = E_prev[:, off : off + take] - s.del_extend
                if off > 0:
                    span = min(have - off + 1, w)
                    diag[:, :span] = S_prev[:, off - 1 : off - 1 + span]
                else:
                    span = min(have, w - 1)
                    diag[:, 1 : 1 + span] = S_prev[:, :span]
                rc = r[rows, j - 1].astype(np.int64) * 5
                sc = s.table[rc[:, None] + q[rows, new_lo:new_hi]]
                last = rlen[rows] == j
                if s.bonus and last.any():
                    sc = sc + np.where(last, s.bonus, 0).astype(np.int32)[:, None]
                diag = np.maximum(diag + sc, NEG)
                U = np.maximum(diag, E_in)
            S, Fv, U2, first, end, ok = _column(U, new_lo, bottom, end_max, thr, s)
            if new_hi < self.width and (ok & (end * BLOCK >= new_hi) & (end < end_max)).any():
                spare += 2
                continue
            break
        block = new_lo // BLOCK + np.arange(w // BLOCK)
        inside = (block >= first[:, None]) & (block < end[:, None]) & ok[:, None]
        cells = np.repeat(inside, BLOCK, axis=1)
        code = None
        if trace:
            code = np.zeros((m, w), np.uint8)
            code[S > U2] = S_FROM_F
            if j:
                code[(S == U2) & (U2 > diag)] |= S_FROM_E
                code[U2 > diag] |= U_FROM_E
            code[:, 1:][Fv[:, :-1] >= U2[:, :-1] - s.ins_open] |= F_EXTENDS
            code[E_in >= U2 - s.del_open] |= E_EXTENDS
        body = np.where(np.repeat(inside & (block < bottom[:, None]), BLOCK, axis=1), S, NEG) if j else None
        S_next = np.where(cells, S, NEG)
        E_next = np.where(cells, np.maximum(E_in, U2 - s.del_open), NEG)
        then = Front(rows, first, end, new_lo, S_next, E_next)
        if not ok.all():
            then = Front(rows[ok], first[ok], end[ok], new_lo, S_next[ok], E_next[ok]) if ok.any() else None
        return then, rows, new_lo, code, body

    def run(self, keep: bool) -> list[tuple[Front, np.ndarray]]:
        """Scores and ends of all pairs; with ``keep`` the states before every ``STRETCH``-th column."""
        kept = []
        at: Front | None = self.first()
        for j in range(0, int(self.rlen.max()) + 1):
            if keep and j % STRETCH == 0:
                kept.append((at, self.score.copy()))
            at, rows, lo, _, body = self.column(at, j, self.score, False)
            if body is not None:
                self._note(rows, lo, j, body, self.score, self.best_i, self.best_j)
            if at is None:
                break
        return kept

    def _note(self, rows, lo, j, body, score, best_i=None, best_j=None) -> None:
        where = body.argmax(axis=1)
        top_score = body[np.arange(len(rows)), where]
        better = top_score > score[rows]
        which = rows[better]
        score[which] = top_score[better]
        if best_i is not None:
            best_i[which] = lo + where[better]
            best_j[which] = j

    def paths(self, kept: list[tuple[Front, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps of every pair from its far end back, their numbers, and the matches among them."""
        n = len(self.qlen)
        i, j = self.best_i.copy(), self.best_j.copy()
        steps = np.zeros((n, max(1, int((i + j).max(initial=0)))), np.uint8)
        count, matches = np.zeros(n, np.int64), np.zeros(n, np.int64)
        state = np.full(n, IN_S, np.uint8)
        for t in range(len(kept) - 1, -1, -1):
            a = t * STRETCH
            pairs = np.flatnonzero((j >= a) & (i + j > 0))
            if len(pairs):
                self._walk(*self._marks(a, int(j[pairs].max()), *kept[t]), a, pairs, i, j, state, steps, count, matches)
        return steps, count, matches

    def _marks(self, a: int, b: int, at: Front, score: np.ndarray):
        """Marks of the columns ``a`` to ``b`` in one flat array, with each pair's offset in each column."""
        score = score.copy()
        flat, size = [], 0
        offset = np.zeros((b - a + 1, len(self.qlen)), np.int64)
        for j in range(a, b + 1):
            at, rows, lo, code, body = self.column(at, j, score, True)
            if body is not None:
                self._note(rows, lo, j, body, score)
            offset[j - a, rows] = size + np.arange(len(rows)) * code.shape[1] - lo
            flat.append(code.ravel())
            size += code.size
        return np.concatenate(flat), offset

    def _walk(self, marks, offset, a, pairs, i, j, state, steps, count, matches) -> None:
        """Each pair takes steps back until it leaves the stretch; all pairs step together.

        Diagonal first, then insertion, then deletion.  After a deletion only a diagonal step or
        a further deletion may follow.
        """
        while len(pairs):
            pi, pj = i[pairs], j[pairs]
            c = marks[offset[pj - a, pairs] + pi]
            now = state[pairs]
            insert = (now == IN_F) | (now == IN_S) & (c & S_FROM_F > 0)
            delete = ~insert & ((c & (S_FROM_E | U_FROM_E) > 0) | (now == IN_E) & (c & E_EXTENDS > 0))
            straight = ~insert & ~delete
            hit = straight & (_Q_MASK[self.q[pairs, pi]] & _R_MASK[self.r[pairs, np.maximum(pj - 1, 0)]] > 0)
            matches[pairs] += hit
            steps[pairs, count[pairs]] = np.where(insert, OP_I, np.where(delete, OP_D, OP_M))
            count[pairs] += 1
            state[pairs] = np.where(insert & (c & F_EXTENDS > 0), IN_F, np.where(delete, IN_E, IN_S))
            i[pairs] = pi = pi - (straight | insert)
            j[pairs] = pj = pj - (straight | delete)
            pairs = pairs[(pj >= a) & (pi + pj > 0)]


def cigars(steps: np.ndarray, count: np.ndarray, swap: bool = False) -> list[str]:
    """Run lengths of each row's first ``count`` steps as text."""
    names = "MDI" if swap else "MID"
    used = np.arange(steps.shape[1]) < count[:, None]
    flat = steps[used]
    row = np.repeat(np.arange(len(count)), count)
    start = np.flatnonzero((np.diff(flat, prepend=255) != 0) | (np.diff(row, prepend=-1) != 0))
    length = np.diff(start, append=len(flat))
    runs = [f"{k}{names[op]}" for k, op in zip(length.tolist(), flat[start].tolist())]
    ends = np.cumsum(np.bincount(row[start], minlength=len(count))).tolist()
    return ["".join(runs[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def extend_batch(queries: list[str], refs: list[str], s: Scores, trace: bool, swap: bool = False):
    """Best extension of each pair.

    Returns ``score, q_end, r_end`` arrays; with ``trace`` also the CIGAR texts in the
    order from the far end back to the start, and match counts.
    """
    batch = Batch(queries, refs, s)
    kept = batch.run(trace)
    ends = batch.score, batch.best_i, batch.best_j
    if not trace:
        return ends
    steps, count, matches = batch.paths(kept)
    return *ends, cigars(steps, count, swap), matches


def _steps(q: pd.Series, r: pd.Series) -> Iterator[np.ndarray]:
    """Row numbers grouped by similar reference length, each group bounded in memory."""
    q_len, r_len = q.str.len().to_numpy(), r.str.len().to_numpy()
    order = np.lexsort((q_len, r_len))
    at = 0
    while at < len(order):
        size = BATCH_PAIRS
        while size > 1:
            some = order[at : at + size]
            if len(some) * int(q_len[some].max() * CELL_BYTES + r_len[some].max()) <= BATCH_BYTES:
                break
            size //= 2
        yield order[at : at + size]
        at += size


def extend_udf(profile: Profile) -> Callable[..., Column]:
    """``struct(score, qadv, radv)`` of the best end of a pair, without the path."""
    s = Scores(profile)

    @F.pandas_udf("score int, qadv int, radv int")
    def run(q: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(q), 3), np.int32)
        qs, rs = q.tolist(), r.tolist()
        for idx in _steps(q, r):
            a, b, c = extend_batch([qs[i] for i in idx], [rs[i] for i in idx], s, False)
            out[idx, 0], out[idx, 1], out[idx, 2] = a, b, c
        return pd.DataFrame(out, columns=["score", "qadv", "radv"])

    return run


def extend_trace_udf(profile: Profile, legacy_ops: bool = False) -> Callable[..., Column]:
    """``struct(score, qspan, rspan, matches, cigar)``, ops read from the far end back."""
    s = Scores(profile)

    @F.pandas_udf("score int, qspan int, rspan int, matches int, cigar string")
    def run(q: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(q), 4), np.int32)
        text = np.empty(len(q), object)
        qs, rs = q.tolist(), r.tolist()
        for idx in _steps(q, r):
            a, b, c, texts, m = extend_batch([qs[i] for i in idx], [rs[i] for i in idx], s, True, legacy_ops)
            out[idx, 0], out[idx, 1], out[idx, 2], out[idx, 3] = a, b, c, m
            text[idx] = texts
        frame = pd.DataFrame(out, columns=["score", "qspan", "rspan", "matches"])
        frame["cigar"] = text
        return frame

    return run
