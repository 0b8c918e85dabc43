"""Slow, plain restatement of the whole scan, written cell by cell for comparison."""

import math

MASK = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3,
        "B": 14, "D": 13, "H": 11, "V": 7}
COMP = dict(zip("ACGTRYSWKMBDHV", "TGCAYRSWMKVHDB"))
NEG = -(10**9)


def revcomp(s):
    return "".join(COMP[c] for c in reversed(s))


def seeds(q, r, k, interval, squash=True):
    out = []
    for i in range(len(q) - k + 1):
        for j in range(len(r) - k + 1):
            if q[i : i + k] != r[j : j + k]:
                continue
            more = i + k < len(q) and j + k < len(r) and q[i + k] == r[j + k]
            if squash and more and (len(q) - (i + k)) % interval:
                continue
            out.append((i, j))
    return out


def chains(pairs, window, min_seeds, k):
    pts = sorted((2 * q - r, 2 * r - q) for q, r in pairs)
    gone, out = set(), []

    def candidates(at, limit_u, limit_v):
        for nxt in range(at + 1, len(pts)):
            if pts[nxt][0] > limit_u:
                return
            if nxt in gone:
                return
            yield nxt

    for root in range(len(pts)):
        if root in gone:
            continue
        path = [root]
        while True:
            u0, v0 = pts[path[-1]]
            best = None
            for nxt in candidates(path[-1], u0 + window, None):
                if 0 <= pts[nxt][1] - v0 <= window:
                    best = nxt
                    break
            if best is None:
                break
            dv = pts[best][1] - v0
            box = pts[best][0] + dv
            probe = best + 1
            while probe < len(pts) and pts[probe][0] <= box and probe not in gone:
                d = pts[probe][1] - v0
                if 0 <= d <= dv:
                    if pts[probe][0] + d > box:
                        break
                    best, dv, box = probe, d, pts[probe][0] + d
                probe += 1
            gone.add(best)
            path.append(best)
        if len(path) >= min_seeds:
            (ua, va), (ub, vb) = pts[path[0]], pts[path[-1]]
            qa, ra, qb, rb = (2 * ua + va) // 3, (2 * va + ua) // 3, (2 * ub + vb) // 3, (2 * vb + ub) // 3
            out.append((qa, ra, qb - qa + k + 1, rb - ra + k + 1, len(path)))
    return out


def band(q, r, m, x, g):
    """Linear-gap score around the diagonal, cell by cell."""
    def inside(i, j):
        lane = 8 + (i - j) // 2 if (i + j) % 2 == 0 else 7 + (i - j + 1) // 2
        return 0 <= lane < 16

    best, cell = 0, {}
    for s in range(-2, 32):
        for lane in range(16):
            if s % 2 == 0:
                i, j = s // 2 + lane - 8, s // 2 - (lane - 8)
            else:
                h = (s - 1) // 2
                i, j = h + lane - 7, h - (lane - 8)
            if s == -2:
                cell[i, j] = (2 * g - m) * abs(lane - 8)
                continue
            near = [cell.get((i - 1, j), -128) + g, cell.get((i, j - 1), -128) + g]
            if s == -1:
                cell[i, j] = max(near)
                continue
            ok = 0 <= i < len(q) and 0 <= j < len(r) and MASK.get(q[i], 0) & MASK.get(r[j], 0)
            cell[i, j] = max(cell.get((i - 1, j - 1), -128) + (m if ok else x), *near)
            best = max(best, cell[i, j])
    return best


def xdrop(q, r, p):
    """Column by column with blocks of eight query rows that drop together."""
    rows = (len(q) + 1 + 7) // 8 * 8
    best, bi, bj = 0, 0, 0
    live = [0, 1]
    S, E = [NEG] * rows, [NEG] * rows
    history = {}
    for j in range(len(r) + 1):
        thr = best - p.xdrop
        nS, nE, nF, nU = [NEG] * rows, [NEG] * rows, [NEG] * rows, [NEG] * rows
        src = {}
        f_state = NEG
        kept = []
        b = live[0]
        top = best
        while b * 8 < rows:
            if b >= live[1] and not kept:
                break
            any_live = False
            keep_f = f_state
            for i in range(b * 8, b * 8 + 8):
                if j == 0:
                    d, e = (0 if i == 0 else NEG), NEG
                else:
                    d = NEG
                    if i > 0 and S[i - 1] > NEG and i <= len(q):
                        d = S[i - 1] + p.score(q[i - 1], r[j - 1]) + (p.end_bonus if j == len(r) else 0)
                    e = E[i] - p.del_extend if E[i] > NEG else NEG
                u = max(d, e)
                f = f_state
                s = max(u, f)
                nU[i], nF[i], nS[i] = u, f, s
                nE[i] = max(e, u - p.del_open) if u > NEG else NEG
                src[i] = (d, e, u, f)
                f_state = max(f, u - p.ins_open if u > NEG else NEG)
                f_state = f_state - p.ins_extend if f_state > NEG else NEG
                if s > thr:
                    any_live = True
            if not any_live:
                for i in range(b * 8, b * 8 + 8):
                    nS[i] = nE[i] = NEG
                if kept:
                    break
                f_state = NEG
                b += 1
                continue
            del keep_f
            kept.append(b)
            if j and b < live[1]:
                for i in range(b * 8, b * 8 + 8):
                    if nS[i] > top:
                        top, bi, bj = nS[i], i, j
            b += 1
        history[j] = src
        if not kept:
            break
        best = top
        live = [kept[0], kept[-1] + 1]
        S, E = nS, nE
    return best, bi, bj, history


def path_of(q, r, p, bi, bj, history):
    ops, i, j, state = [], bi, bj, "S"
    while i or j:
        d, e, u, f = history[j][i]
        if state == "S":
            s = max(u, f)
            state = "U" if s == u else "F"
            continue
        if state == "U":
            if u == d and (i, j) != (0, 0):
                ops.append("M")
                i, j, state = i - 1, j - 1, "S"
            else:
                state = "E"
            continue
        if state == "F":
            pu, pf = history[j][i - 1][2], history[j][i - 1][3]
            ops.append("I")
            i -= 1
            if not (pf > NEG and pf >= pu - p.ins_open):
                state = "S"
            continue
        if state == "E":
            pe, pu = history[j - 1][i][1], history[j - 1][i][2]
            ops.append("D")
            j -= 1
            if not (pe > NEG and pe >= pu - p.del_open):
                state = "U"
    return "".join(ops)


def adjust(slice_, rlambda):
    total = 0.0
    for b in "ACGT":
        c = slice_.count(b)
        if c:
            total += c * math.log(4.0 * c / len(slice_))
    return int(-total * rlambda)


def scan(queries, refs, p, seed_fn=seeds):
    """{(qname, qs, qe, strand, rname, rs, re, score, raw, path)}"""
    out = []
    fl = p.flank_scores()
    for qn, q in queries:
        best = {}
        for rid, (rn, ref) in enumerate(refs):
            ends = set()
            for strand in "+-":
                r = ref if strand == "+" else revcomp(ref)
                found = chains(seed_fn(q, r, p.k, p.squash_interval), p.window, p.min_seeds, p.k)
                found.sort(key=lambda c: (32 - max(c[3], 0).bit_length(), rid, c[0], c[1]))
                for order, (q0, r0, qs, rs, _) in enumerate(found):
                    if p.filter_span is not None and qs < p.filter_span + 1:
                        a = band(q[q0 + qs : q0 + qs + 32], r[r0 + rs : r0 + rs + 32], fl["match"], fl["mismatch"], fl["gap"])
                        b = band(q[max(0, q0 - 32) : q0][::-1], r[max(0, r0 - 32) : r0][::-1], fl["match"], fl["mismatch"], fl["gap"])
                        if a + b < fl["min_score"]:
                            continue
                    s1, qa, ra, _ = xdrop(q[q0 : q0 + 2 * (len(r) - r0)], r[r0:], p)
                    eq, er = q0 + qa, r0 + ra
                    bonus = p.end_bonus if er == len(r) else 0
                    if s1 < bonus or (strand, eq, er) in ends:
                        continue
                    ends.add((strand, eq, er))
                    q2 = revcomp(q[max(0, eq - 2 * er) : eq])
                    r2 = revcomp(r[:er])
                    s2, qspan, rspan, hist = xdrop(q2, r2, p)
                    if s2 == 0:
                        continue
                    raw = s2 + bonus
                    score = max(0, raw + adjust(q[eq - qspan : eq], p.rlambda))
                    if (raw if p.use_raw_score else score) <= p.min_score:
                        continue
                    path = path_of(q2, r2, p, qspan, rspan, hist)
                    ws = er - rspan
                    rstart = ws if strand == "+" else len(r) - er
                    key = (rid, strand, eq - qspan, ws)
                    row = (qn, eq - qspan, eq, strand, rn, rstart, rstart + rspan, score, raw, path)
                    if key not in best or best[key][8] < raw:
                        best[key] = row
        out += best.values()
    return sorted(out)


def cigar(path, swap=False):
    """Run lengths of a path, one letter for each step."""
    names = {"M": "M", "I": "D", "D": "I"} if swap else {"M": "M", "I": "I", "D": "D"}
    out = []
    for op in path:
        if out and out[-1][1] == names[op]:
            out[-1][0] += 1
        else:
            out.append([1, names[op]])
    return "".join(f"{n}{op}" for n, op in out)
