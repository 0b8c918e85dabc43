"""Single stages against hand-made cases and the plain restatement."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom.operators import chains as C
from seedloom.operators import lockstep as L
from seedloom.operators import overlaps as O
from seedloom.operators import seeds as S
from seedloom.operators import extension as X
from seedloom.operators.extension import Scores, extend_batch
from seedloom.operators.flanks import band_scores
from seedloom.operators.kmers import (
    PieceLayout,
    coded_kmers,
    dedup_kmers,
    dense_reference_ids,
    filter_reference_length,
    query_kmers,
    query_pieces,
    reference_kmers,
)
from seedloom.operators.masking import lowercase_intervals, merge_intervals
from seedloom.operators.seeds import _grid_join, seeds
from seedloom.plans.index import build_index
from seedloom.plans.mask import mask
from seedloom.profile import DEFAULT_PROFILE, Profile
from seedloom.sources.paf import paf_line, parse_paf

from . import brute


# ------------------------------------------------------------------------------- k-mers
def test_reference_kmers(spark):
    refs = spark.createDataFrame([(0, "AC"), (1, "ACG"), (2, "ACGT"), (3, "ARG")], "rid int, rseq string")
    got = sorted(tuple(r) for r in dedup_kmers(reference_kmers(refs, 3)).collect())
    assert got == sorted(
        [
            (1, "+", "ACG", 0, None), (1, "-", "CGT", 0, None),
            (2, "+", "ACG", 0, "T"), (2, "+", "CGT", 1, None), (2, "-", "ACG", 0, "T"), (2, "-", "CGT", 1, None),
            (3, "+", "AAG", 0, None), (3, "+", "AGG", 0, None), (3, "-", "CCT", 0, None), (3, "-", "CTT", 0, None),
        ],
        key=lambda t: (t[0], t[1], t[2], t[3]),
    )


def test_ambiguity_and_following_base(spark):
    refs = spark.createDataFrame([(0, "RRRRRRRRR"), (1, "AAAAY")], "rid int, rseq string")
    got = dedup_kmers(reference_kmers(refs, 9)).filter("strand = '+'").collect()
    assert len({r.kmer for r in got}) == len(got) == 512
    four = dedup_kmers(reference_kmers(refs.filter("rid = 1"), 4)).filter("strand = '+' and rpos = 0").collect()
    assert [(r.kmer, r.r_next) for r in four] == [("AAAA", "C")]


def test_length_limit(spark):
    refs = spark.createDataFrame([("a", "A" * 32767), ("b", "A" * 32768)], "name string, rseq string")
    assert [r.name for r in filter_reference_length(refs, strict=False).collect()] == ["a"]
    with pytest.raises(Exception, match="reference too long"):
        filter_reference_length(refs).collect()
    with pytest.raises(ValueError, match="no reference"):
        build_index(refs.filter("name = 'b'").withColumnRenamed("rseq", "seq"), strict=False, max_length=32767)


def test_dense_ids(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("ord")).repartition(5)
    got = dense_reference_ids(df, ["ord"]).collect()
    assert sorted((r.rid, r.ord) for r in got) == [(i, i) for i in range(500)]


def test_pieces_cover_every_kmer_once(spark):
    rng = random.Random(3)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 3, 4, 99, 100, 101, 1000])]
    q = spark.createDataFrame(seqs, "seq_id long, seq string")
    layout = PieceLayout.of(20, DEFAULT_PROFILE, core=100, warm=50)
    for spread in (False, True):
        got = query_kmers(query_pieces(q, layout, spread), 4, owned=layout).collect()
        assert sorted((r.seq_id, r.qpos, r.kmer, r.q_next) for r in got) == sorted(
            (i, p, s[p : p + 4], s[p + 4 : p + 5]) for i, s in seqs for p in range(len(s) - 3)
        )


def test_seeds_and_grid_join(spark):
    rng = random.Random(4)
    q = "".join(rng.choice("AC") for _ in range(120))
    r = "".join(rng.choice("AC") for _ in range(60))
    refs = spark.createDataFrame([(0, r)], "rid int, rseq string")
    rk = dedup_kmers(reference_kmers(refs, 4))
    layout = PieceLayout.of(60, DEFAULT_PROFILE)
    qk = query_kmers(query_pieces(spark.createDataFrame([(9, q)], "seq_id long, seq string"), layout), 4)
    pieces = query_pieces(spark.createDataFrame([(9, q)], "seq_id long, seq string"), layout)
    numeric = (query_kmers(pieces, 4, coded=True), coded_kmers(rk))
    for limit, (left, right) in ((1 << 30, (qk, rk)), (0, (qk, rk)), (1 << 30, numeric), (0, numeric)):
        got = seeds(left, right, 4, 16, 10**6, limit=limit).collect()
        for strand, oriented in (("+", r), ("-", brute.revcomp(r))):
            assert sorted((x.qpos, x.rpos) for x in got if x.strand == strand) == brute.seeds(q, oriented, 4, 16)
    plain = sorted(map(tuple, qk.join(rk, "kmer").collect()), key=str)
    assert sorted(map(tuple, _grid_join(qk, rk, per_cell=3).select(*qk.join(rk, "kmer").columns).collect()), key=str) == plain


def test_heavy_kmers_are_dealt_to_a_grid(spark):
    """One base only: every pair of k-mers matches, and no cell takes more than its share."""
    refs = spark.createDataFrame([(i, "A" * 30) for i in range(12)], "rid int, rseq string")
    rk = coded_kmers(dedup_kmers(reference_kmers(refs, 4))).filter("strand = '+'")
    q = spark.createDataFrame([(i, "A" * 50 + "C") for i in range(9)], "seq_id long, seq string")
    qk = query_kmers(query_pieces(q, PieceLayout.of(30, DEFAULT_PROFILE)), 4, coded=True)
    heavy = S._heavy_kmers(qk, rk, 20).collect()
    assert [(r["_rows"], r["_cols"]) for r in heavy] == [(-(-9 * 47 // 20), -(-12 * 27 // 20))]
    joined = S._grid_join(qk, rk, per_cell=20)
    assert joined.count() == 9 * 47 * 12 * 27
    assert joined.distinct().count() == 9 * 47 * 12 * 27
    assert "shuffle_hash" not in S._grid_join(qk, rk)._jdf.queryExecution().toString()


# ----------------------------------------------------------------------------- overlaps
def test_overlaps_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randint(0, 2), i, s, s + rng.choice([0, 1, 5, 40, 300])) for i in range(150) for s in [rng.randint(0, 400)]]
    rows += [(0, 1000 + i, 7, 9) for i in range(5)] + [(None, 2000, 1, 5), (1, 2001, None, 5), (1, 2002, 0, 5_000)]
    df = spark.createDataFrame(rows, "seq_id long, n int, qstart long, qend long").withColumn("pos", F.lit(3)).withColumn("bin", F.lit(3))
    real = [r for r in rows if None not in r and r[2] < r[3]]
    want = sorted((a[1], b[1]) for a in real for b in real if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3])
    for width in (8, 64, 1 << 20):
        pairs = O.overlapping_pairs(df, df, "seq_id", width=width)
        got = sorted((r["a"]["n"], r["b"]["n"]) for r in pairs.collect() if r["a"]["n"] != r["b"]["n"])
        assert got == want
        counts = {r["n"]: r["n_overlaps"] for r in O.overlap_counts(df, "seq_id", width=width).collect()}
        assert len(counts) == len(rows)
        assert counts == {r[1]: sum(a == r[1] for a, _ in want) for r in rows}
    assert O.overlap_counts(df.limit(0), "seq_id").count() == 0


def test_overlaps_of_a_very_dense_read(spark):
    """A million hits on one read: the counts need no pair and no sort of the whole read."""
    n = 1_000_000
    hits = spark.range(n).select(F.lit(1).alias("seq_id"), (F.col("id") % 5_000).alias("qstart"), (F.col("id") % 5_000 + 10).alias("qend"))
    got = O.overlap_counts(hits, "seq_id").groupBy("qstart").agg(F.min("n_overlaps").alias("a"), F.max("n_overlaps").alias("b"))
    rows = {r["qstart"]: (r["a"], r["b"]) for r in got.collect()}
    assert rows[0] == (200 * 10 - 1,) * 2 and rows[2_500] == (200 * 19 - 1,) * 2


# ------------------------------------------------------------------------------- chains
WIDE = 1 << 40  # a piece that no test query leaves


def packed_seeds(points):
    uv = np.array(sorted((2 * q - r, 2 * r - q) for q, r in points)).reshape(-1, 2)
    return uv[:, 0], uv[:, 1]


def linked(points, window, min_seeds, k=4):
    u, v = packed_seeds(points)
    rule = C.Rule(window, min_seeds, k, WIDE, 0, WIDE)
    return [x[5:10] for x in C.Run(0, 1, u, v, rule).settle()]


def test_chain_cases():
    assert linked([(i * 5, i * 5) for i in range(5)], 32, 5) == [(0, 0, 25, 25, 5)]
    assert linked([(i * 5, i * 5) for i in range(5)], 32, 6) == []
    # du = dv = 32 links, 33 does not
    assert len(linked([(0, 0), (32, 32)], 32, 2)) == 1
    assert linked([(0, 0), (33, 33)], 32, 2) == []
    # two diagonals too far apart to link (dv < 0)
    both = [(i * 4, i * 4) for i in range(4)] + [(i * 4 + 40, i * 4) for i in range(4)]
    assert sorted(c[4] for c in linked(both, 32, 2)) == [4, 4]


@pytest.mark.parametrize("seed", range(8))
def test_chains_equal_restatement(seed):
    rng = random.Random(seed)
    dense = rng.choice([40, 150, 400])
    pts = {(rng.randint(0, dense), rng.randint(0, 60)) for _ in range(rng.randint(20, 500))}
    for w in (4, 16, 32):
        assert linked(pts, w, 3) == brute.chains(pts, w, 3, 4)


def test_border_reports_settle(spark, monkeypatch):
    """Dense seeds over many short pieces: the second pass runs, once, and the result is sequential."""
    rng = random.Random(2)
    ref = "".join(rng.choice("AC") for _ in range(40))
    query = "".join(rng.choice("AC") for _ in range(3000))
    p = DEFAULT_PROFILE.replace(k=3, min_seeds=2)
    index = build_index(spark.createDataFrame([(0, "r", ref)], "rid int, name string, seq string"), p)
    q = spark.createDataFrame([(0, "q", query)], "seq_id long, name string, seq string")
    from seedloom.plans.scan import chain_stage

    calls = []
    real = C._whole_groups
    monkeypatch.setattr(C, "_whole_groups", lambda *a: calls.append(1) or real(*a))
    layout = PieceLayout.of(40, p, core=100, warm=2)
    got = chain_stage(q, index, 0, layout).collect()
    want = []
    for strand, r in (("+", ref), ("-", brute.revcomp(ref))):
        pairs = brute.seeds(query, r, 3, p.squash_interval)
        want += [(strand, *c) for c in brute.chains(pairs, p.window, p.min_seeds, 3)]
    assert sorted((x.strand, x.qpos, x.rpos, x.qspan, x.rspan, x.n_seeds) for x in got) == sorted(want)
    assert calls == [1]


@pytest.mark.parametrize("seed", range(6))
def test_stream_holds_no_more_than_can_link(seed):
    """Seeds of a tandem repeat without a gap, fed in odd steps, as pieces and whole."""
    rng = random.Random(seed)
    unit = "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 17)))
    ref, query = (unit * 20)[:60], (unit * 300)[: rng.randint(1500, 2500)]
    query = "".join(c if rng.random() < 0.97 else rng.choice("ACGT") for c in query)
    pairs = brute.seeds(query, ref, 4, 16)
    window, least = 32, 3
    want = brute.chains(pairs, window, least, 4)
    reach = 3 * len(ref) + 2 * window
    rule = C.Rule(window, least, 4, 700, 10, reach)
    u, v = packed_seeds(pairs)
    at = (u << C._POS_BITS) + np.array([r for _, r in sorted(((2 * q - r, r) for q, r in pairs), key=lambda x: x)])
    order = np.argsort(at, kind="stable")
    at = at[order]
    chainer, got, i, most = C.Chainer(rule, whole=True), [], 0, 0
    last_piece = len(query) * 2 // 700
    slot = last_piece << (C._REF_BITS + 2) | 1
    while i < len(at):
        n = rng.randint(1, 60)
        part = at[i : i + n]
        got += chainer.feed(np.zeros(len(part), int), np.full(len(part), slot), part)
        most = max(most, int(chainer.open.u[-1] - chainer.open.u[0]))
        i += n
    got += chainer.close()
    assert [x[5:10] for x in got] == want
    assert all(x[2] == min(max(2 * x[5] - x[6], 0) // 700, last_piece) for x in got)
    assert most <= 2 * reach + window * 60


# ------------------------------------------------------------------------------- flanks
def test_band_equals_restatement():
    rng = random.Random(1)
    mask = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 0}
    qs, rs = [], []
    for _ in range(40):
        r = "".join(rng.choice("ACGT") for _ in range(32))
        q = "".join(c if rng.random() < 0.8 else rng.choice("ACGT") for c in r)
        cut = rng.randint(0, 32)
        q = rng.choice([q, q[3:] + "ACG", q[:cut] + "N" * (32 - cut)])
        qs.append(q)
        rs.append(r)
    arr = lambda xs: np.array([[mask[c] for c in x] for x in xs], np.uint8)
    got = band_scores(arr(qs), arr(rs), 2, -3, -2)
    assert got.tolist() == [brute.band(q, r, 2, -3, -2) for q, r in zip(qs, rs)]
    same = band_scores(arr([rs[0]]), arr([rs[0]]), 2, -3, -2)
    assert same.tolist() == [32]  # sixteen diagonal steps


# ---------------------------------------------------------------------------- extension
P20 = DEFAULT_PROFILE.replace(max_gap_len=20, end_bonus=0)


@pytest.mark.parametrize(
    "ref,score,used", [("A", 2, 1), ("AG", 4, 2), ("AGATTTT", 9, 7), ("AGATTTTC", 11, 8), ("AGATTTTCA", 13, 9), ("TT", 0, 0)]
)
def test_known_extensions(ref, score, used):
    got = extend_batch(["AGCTTTTCATTCTGACTGCAACGGGC"], [ref], Scores(P20), True)
    assert (got[0][0], got[2][0]) == (score, used)


def test_known_gap_path():
    q, r = "ACACTTCTAGACTTTACCACTAACACTT", "ACACTTGTAGACTTCTACCACGGACACTT"
    score, qe, re_, texts, matches = extend_batch([q], [r], Scores(P20), True)
    assert (score[0], qe[0], re_[0], matches[0]) == (35, 28, 29, 25)
    assert texts == ["14M1D14M"]
    assert extend_batch([q], [r], Scores(P20), True, swap=True)[3] == ["14M1I14M"]


@pytest.mark.parametrize("stretch", (1, 7, 64))
@pytest.mark.parametrize("seed", range(4))
def test_extension_equals_restatement(seed, stretch, monkeypatch):
    monkeypatch.setattr(X, "STRETCH", stretch)
    rng = random.Random(seed)
    p = [
        DEFAULT_PROFILE,
        DEFAULT_PROFILE.replace(end_bonus=0, gap_open=2, max_gap_len=8),
        DEFAULT_PROFILE.replace(ins_open=3, del_open=7, ins_extend=2, del_extend=1, max_gap_len=6),
        DEFAULT_PROFILE.replace(gap_open=0, max_gap_len=12, mismatch=2),
    ][seed]
    qs, rs = [], []
    for _ in range(120):
        r = "".join(rng.choice("ACGTR") for _ in range(rng.randint(1, 90)))
        q = []
        for c in r:
            x = rng.random()
            if x < 0.04:
                continue
            if x < 0.08:
                q += [rng.choice("ACGT") for _ in range(rng.randint(1, 9))]
            q.append(rng.choice("ACGT") if c == "R" or rng.random() < 0.08 else c)
        qs.append("".join(q) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))))
        rs.append(r)
    got = extend_batch(qs, rs, Scores(p), True)
    for i, (q, r) in enumerate(zip(qs, rs)):
        b, bi, bj, hist = brute.xdrop(q, r, p)
        assert (got[0][i], got[1][i], got[2][i]) == (b, bi, bj), (q, r)
        path = brute.path_of(q, r, p, bi, bj, hist)
        assert got[3][i] == brute.cigar(path)
        assert got[4][i] == matches_of(path, q, r, bi, bj)


def matches_of(path, q, r, i, j):
    n = 0
    for op in path:
        if op == "M":
            n += brute.MASK[q[i - 1]] & brute.MASK[r[j - 1]] != 0
        i, j = i - (op != "D"), j - (op != "I")
    return n


def test_marks_fill_one_stretch_only(monkeypatch):
    rng = random.Random(9)
    r = "".join(rng.choice("ACGT") for _ in range(3000))
    q = "".join(c for c in r if rng.random() > 0.02)
    largest = []
    real = X.Batch._marks
    monkeypatch.setattr(X.Batch, "_marks", lambda self, *a: largest.append((out := real(self, *a))[0].size) or out)
    got = extend_batch([q], [r], Scores(DEFAULT_PROFILE.replace(end_bonus=0)), True)
    assert got[1][0] > 2800 and len(largest) == -(-(got[2][0] + 1) // X.STRETCH)
    assert max(largest) <= X.STRETCH * 400


def test_identical_long_sequence():
    s = "".join(random.Random(0).choice("ACGT") for _ in range(16384))
    p = DEFAULT_PROFILE.replace(end_bonus=0)
    got = extend_batch([s, s[:32]], [s, s[:32]], Scores(p), False)
    assert got[0].tolist() == [32768, 64]


def test_end_bonus_applies_to_the_last_base():
    p = Profile(end_bonus=10)
    assert extend_batch(["ACGA"], ["ACGT"], Scores(p), False)[0].tolist() == [13]
    # three matches, one base skipped, a mismatch that earns the bonus
    assert extend_batch(["ACGA"], ["ACGTT"], Scores(p), False)[0].tolist() == [6 - 6 - 3 + 10]


# ------------------------------------------------------------------------------ masking
def test_merge_and_lowercase(spark):
    rows = [
        ("a", 100, 10, 20), ("a", 100, 15, 30), ("a", 100, 30, 31), ("a", 100, 35, 40), ("a", 100, 45, 50),
        ("b", 12, 0, 3), ("b", 12, 9, 12),
    ]
    alns = spark.createDataFrame(rows, "qname string, qlen long, qstart long, qend long")
    got = lambda **kw: sorted((r.qname, r.start, r.end) for r in merge_intervals(alns, **kw).collect())
    assert got() == [("a", 10, 31), ("a", 35, 40), ("a", 45, 50), ("b", 0, 3), ("b", 9, 12)]
    assert got(max_gap=5) == [("a", 10, 40), ("a", 45, 50), ("b", 0, 3), ("b", 9, 12)]
    assert got(max_gap=6) == [("a", 10, 50), ("b", 0, 3), ("b", 9, 12)]
    assert got(margin=2) == [("a", 8, 42), ("a", 43, 52), ("b", 0, 5), ("b", 7, 12)]
    reads = spark.createDataFrame([("a", "A" * 100), ("b", "ACGTACGTACGT"), ("c", "ACGT")], "name string, seq string")
    out = {r.name: r.seq for r in mask(reads, alns).collect()}
    assert out["b"] == "acgTACGTAcgt" and out["c"] == "ACGT"
    assert out["a"] == "A" * 10 + "a" * 21 + "A" * 4 + "a" * 5 + "A" * 5 + "a" * 5 + "A" * 50
    assert lowercase_intervals(reads, merge_intervals(alns)).count() == 3


def merged_by_hand(rows, max_gap, margin):
    out = {}
    for name, qlen, start, end in rows:
        out.setdefault(name, []).append((max(0, start - margin), min(end + margin, qlen)))
    found = []
    for name, spans in out.items():
        islands = []
        for s, e in sorted(x for x in spans if x[0] < x[1]):
            if islands and (s <= islands[-1][1] or s - islands[-1][1] < max_gap):
                islands[-1][1] = max(islands[-1][1], e)
            else:
                islands.append([s, e])
        found += [(name, s, e) for s, e in islands]
    return sorted(found, key=str)


@pytest.mark.parametrize("width", [7, 64, 1 << 16])
@pytest.mark.parametrize("max_gap,margin", [(0, 0), (6, 0), (3, 4), (0, 9)])
def test_merge_over_bins(spark, width, max_gap, margin):
    """Islands over many bins, long intervals over empty bins, repeats, a read without a name."""
    rng = random.Random(width + max_gap)
    rows = []
    for name, qlen, n in (("a", 3000, 90), ("b", 400, 60), (None, 900, 20), ("d", 50, 1)):
        for _ in range(n):
            at = rng.randrange(qlen)
            rows.append((name, qlen, at, min(qlen, at + rng.choice([0, 3, 12, 40, 300]))))
    rows += rows[:30]
    alns = spark.createDataFrame(rows, "qname string, qlen long, qstart long, qend long")
    got = merge_intervals(alns, max_gap, margin, width=width).collect()
    assert sorted(((r.qname, r.start, r.end) for r in got), key=str) == merged_by_hand(rows, max_gap, margin)
    assert merge_intervals(alns.limit(0), max_gap, margin, width=width).collect() == []


def test_merge_of_a_dense_read_is_spread(spark):
    """Two million intervals of one read: no task after the combining aggregate holds more than a bin of starts."""
    n, qlen, width = 2_000_000, 1 << 21, 1 << 14
    alns = spark.range(n).select(
        F.lit("a").alias("qname"), F.lit(qlen).cast("long").alias("qlen"),
        F.pmod(F.xxhash64("id"), F.lit(qlen // 2)).alias("qstart"),
    ).withColumn("qend", F.col("qstart") + 3)
    got = merge_intervals(alns, width=width)
    starts = alns.select("qstart").distinct()
    covered = starts.select(F.explode(F.sequence("qstart", F.col("qstart") + 2)).alias("at")).distinct().count()
    assert got.agg(F.sum(F.col("end") - F.col("start"))).head()[0] == covered
    assert got.count() > 1000


# ---------------------------------------------------------------------------------- PAF
def test_paf_round_trip(spark):
    row = ("q 1", 100, 5, 25, "-", "r", 50, 10, 31, 19, 21, 255, 40, 44, 19 / 21, "10M1D10M")
    cols = (
        "qname string, qlen long, qstart long, qend long, strand string, rname string, rlen long, rstart long, "
        "rend long, matches int, block_len long, mapq int, score int, raw_score int, identity double, cigar string"
    )
    df = spark.createDataFrame([row], cols)
    line = df.select(paf_line().alias("value"))
    assert line.head()[0] == "q 1\t100\t5\t24\t-\tr\t50\t10\t30\t*\t21\t255\tAS:i:40\tXS:i:44\tXI:f:0.9048\tCG:Z:10M1D10M"
    back = parse_paf(line).head().asDict()
    assert back.pop("matches") is None and back.pop("identity") == 0.9048
    assert list(back.values()) == [*row[:9], 21, 255, 40, 44, "10M1D10M"]
    std = df.select(paf_line(standard=True).alias("value"))
    assert parse_paf(std, standard=True).head().asDict()["qend"] == 25
    assert std.head()[0].split("\t")[9] == "19"
    bad = spark.createDataFrame([("q\t1\t0\t0\t?\tr\t1\t0\t0\t*\t1\t255",), ("short\tline",)], "value string")
    assert parse_paf(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="malformed"):
        parse_paf(bad).collect()


# ------------------------------------------------------------- chains of lists of positions
def walked(lanes, window, least):
    """Chains of several groups at once, by ``lockstep``."""
    key, bounds = [], []
    for i, pts in enumerate(lanes):
        mine = sorted((i << L.LANE) + ((2 * q - r + 1000) << L.R_BITS) + r for q, r in pts)
        bounds.append((len(key), len(key), len(key) + len(mine), len(key) + len(mine)))
        key += mine + [((i + 1) << L.LANE) - 1] * (-len(mine) % 64)
    key = np.array(key)
    lane, first, last, n = L.Stretches(L.Walk(key, window), bounds, 3 * 61 + 2 * window).run(least)

    def place(at):
        r = key[at] & ((1 << L.R_BITS) - 1)
        return (((key[at] >> L.R_BITS) & ((1 << L.U_BITS) - 1)) - 1000 + r) >> 1, r

    (qa, ra), (qb, rb) = place(first), place(last)
    rows = zip(lane.tolist(), qa.tolist(), ra.tolist(), (qb - qa + 5).tolist(), (rb - ra + 5).tolist(), n.tolist())
    return [sorted(x[1:] for x in mine) for mine in _by_lane(rows, len(lanes))]


def _by_lane(rows, n):
    out = [[] for _ in range(n)]
    for x in rows:
        out[x[0]].append(x)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_walks_of_stretches_equal_the_single_walk(seed, monkeypatch):
    """Sparse and very dense groups, some with equal seeds, cut into stretches that rarely agree at once."""
    rng = random.Random(seed)
    stretch, replay = rng.choice([(2048, 512), (64, 8), (17, 3), (40, 0)])
    monkeypatch.setattr(L, "STRETCH", stretch)
    monkeypatch.setattr(L, "REPLAY", replay)
    lanes = [[(rng.randint(0, size), rng.randint(0, 60)) for _ in range(rng.randint(1, 900))] for size in (20, 40, 150, 400)]
    for window in (4, 32, 63):
        want = [sorted(linked(pts, window, 3)) for pts in lanes]
        assert walked(lanes, window, 3) == want
        assert sum(map(len, want)) > 20


def test_lists_equal_rows(spark, monkeypatch):
    """Both forms of the seeds give the same chains; ids that are null or twice, steps that hold few seeds."""
    from seedloom.plans import scan as stages

    rng = random.Random(4)
    rand = lambda n: "".join(rng.choice("AACGT") for _ in range(n))
    refs = [(i, "r", rand(rng.randint(30, 90))) for i in range(24)]
    index = build_index(spark.createDataFrame(refs, "rid int, name string, seq string"), DEFAULT_PROFILE)
    texts = [(i // 2, "q", rand(rng.choice([0, 3, 40, 900]))) for i in range(24)]
    q = spark.createDataFrame(texts, "seq_id long, name string, seq string")
    layout = PieceLayout.of(90, DEFAULT_PROFILE, core=300, warm=200)
    rows = lambda: sorted(map(tuple, stages.chain_stage(q, index, 0, layout).collect()))
    with monkeypatch.context() as m:
        m.setattr(stages, "SEEDS_FOR_LISTS", 10**9)
        assert stages.list_stage(q, index, 0, layout) is None
        want = rows()
    assert stages.list_stage(q, index, 0, layout) is not None
    assert rows() == want and len(want) > 300
    # a few slots a step; groups that no step holds
    monkeypatch.setattr(L, "SEEDS_PER_STEP", 300)
    assert rows() == want
    null = q.withColumn("seq_id", F.lit(None).cast("long")).limit(1).unionByName(q.limit(0))
    assert {r["seq_id"] for r in stages.chain_stage(null, index, 0, layout).collect()} <= {None}
    # the list form meets every seed once
    kmers = stages.seed_stage(q, index, 0, layout).count()
    lists = stages.list_stage(q, index, 0, layout).collect()
    met = sum(1 for x in lists for a in x["q"] for b in x["r"] if not a & 7 or a & 7 != b & 7)
    assert met == kmers


def test_many_seeds_are_chained_in_time(spark):
    """Thirty million seeds, which took minutes one by one."""
    rng = random.Random(5)
    rand = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = spark.createDataFrame([(i, "r", rand(250)) for i in range(100)], "rid int, name string, seq string")
    index = build_index(refs, DEFAULT_PROFILE)
    q = spark.createDataFrame([(i, "q", rand(3000)) for i in range(64)], "seq_id long, name string, seq string")
    from seedloom.plans.scan import chain_stage

    layout = PieceLayout.of(250, DEFAULT_PROFILE)
    began = time.time()
    assert chain_stage(q, index, 0, layout).count() > 200_000
    assert time.time() - began < 60
