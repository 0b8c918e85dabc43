import random

import pytest

from seedloom.plans.index import assign_profiles, build_index, load_index, save_index
from seedloom.plans.mask import mask
from seedloom.plans.scan import prepare_queries, rejected_queries, scan, scan_with_rejects
from seedloom.profile import DEFAULT_PROFILE

from . import brute


def mutate(rng, s, sub=0.05, gap=0.02):
    out = []
    for c in s:
        x = rng.random()
        if x < gap:
            continue
        if x < 2 * gap:
            out.append(rng.choice("ACGT"))
        out.append(rng.choice("ACGT") if rng.random() < sub else c)
    return "".join(out)


def dataset(seed, n_ref=4, n_query=6, rlen=150, flank=200):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = [(f"r{i}", rand(rng.randint(60, rlen))) for i in range(n_ref)]
    queries = []
    for i in range(n_query):
        body = rand(rng.randint(0, flank))
        for _ in range(rng.randint(1, 3)):
            r = mutate(rng, rng.choice(refs)[1])
            body += (r if rng.random() < 0.5 else brute.revcomp(r)) + rand(rng.randint(0, flank))
        queries.append((f"q{i}", body))
    return refs, queries


def run(spark, refs, queries, p, **kw):
    r = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(refs)], "rid int, name string, seq string")
    q = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(queries)], "seq_id long, name string, seq string")
    return scan(q, build_index(r, p), **kw)


def rows(df):
    return sorted(
        (a.qname, a.qstart, a.qend, a.strand, a.rname, a.rstart, a.rend, a.score, a.raw_score, a.cigar)
        for a in df.collect()
    )


def expected(refs, queries, p):
    return [(*x[:-1], brute.cigar(x[-1])) for x in brute.scan(queries, refs, p)]


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5), (3, 6)])
def test_scan_equals_brute_force(spark, seed, k):
    refs, queries = dataset(seed)
    p = DEFAULT_PROFILE.replace(k=k, min_seeds=3 if k > 4 else 5)
    want = expected(refs, queries, p)
    assert want
    assert rows(run(spark, refs, queries, p)) == want


@pytest.mark.parametrize("limit", [512 << 20, 0])
def test_pieces_and_shuffled_joins_change_nothing(spark, limit):
    refs, queries = dataset(11, n_ref=3, n_query=3, rlen=80, flank=900)
    p = DEFAULT_PROFILE.replace(k=5)
    want = expected(refs, queries, p)
    assert want
    assert rows(run(spark, refs, queries, p, limit=limit, core=256, warm=320)) == want


def test_dense_repeats_agree_across_pieces(spark):
    """No seed-free stretch anywhere: pieces must settle on the sequential result."""
    rng = random.Random(5)
    refs = [("rep", "ACACACACTCACACACACACAGACACACAC"), ("at", "AT" * 14 + "C" + "AT" * 6)]
    body = "".join(rng.choice(["AC" * 30, "AT" * 25, "ACACTC" * 8, "ATATC" * 9]) for _ in range(14))
    queries = [("long", body), ("short", body[:100])]
    p = DEFAULT_PROFILE.replace(k=4)
    want = expected(refs, queries, p)
    assert want
    got = rows(run(spark, refs, queries, p, core=128, warm=40))
    assert got == want


def test_strand_symmetry(spark):
    """Every alignment reappears, mirrored, when the queries are reverse-complemented."""
    refs, queries = dataset(7, n_query=3)
    p = DEFAULT_PROFILE.replace(k=5)
    a = rows(run(spark, refs, queries, p))
    b = rows(run(spark, refs, [(n, brute.revcomp(s)) for n, s in queries], p))
    length = {n: len(s) for n, s in queries}
    assert a

    def meets(x, y):
        lo, hi = length[x[0]] - x[2], length[x[0]] - x[1]
        return (x[0], x[4]) == (y[0], y[4]) and x[3] != y[3] and y[1] < hi and lo < y[2]

    assert all(any(meets(x, y) for y in b) for x in a)
    assert all(any(meets(y, x) for x in a) for y in b)


def test_index_round_trip(spark, tmp_path):
    refs, queries = dataset(9)
    p = DEFAULT_PROFILE.replace(k=6, min_seeds=3)
    r = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(refs)], "rid int, name string, seq string")
    q = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(queries)], "seq_id long, name string, seq string")
    built = build_index(r, p)
    save_index(built, str(tmp_path / "ix"))
    loaded = load_index(spark, str(tmp_path / "ix"))
    assert loaded.profiles == built.profiles and loaded.stats == built.stats
    assert rows(scan(q, loaded)) == rows(scan(q, built)) == expected(refs, queries, p)
    with pytest.warns(UserWarning):
        loaded.with_parameters(k=5)


def test_query_letters(spark):
    q = spark.createDataFrame(
        [(0, "ok", "acgun"), (1, "gap", "AC-GT"), (2, "z", "ACZ"), (3, "x", "AXC")], "seq_id long, name string, seq string"
    )
    assert {r.name: r.seq for r in prepare_queries(q).collect()} == {"ok": "ACGTA", "x": "AAC"}
    assert {r.name for r in rejected_queries(q).collect()} == {"gap", "z"}
    assert {r.name for r in scan_with_rejects(q, build_index(spark.createDataFrame([("r", "ACGTACGT")], "name string, seq string")))[1].collect()} == {"gap", "z"}
    assert {r.name for r in rejected_queries(q, "reject").collect()} == {"ok", "gap", "z", "x"}
    assert {r.seq for r in prepare_queries(q, "break").collect()} == {"ACGTN", "ANC"}


def test_profiles_split_references(spark):
    refs, queries = dataset(13)
    a = DEFAULT_PROFILE.replace(k=6, min_seeds=3, name="first", name_pattern="^r[01]$")
    b = DEFAULT_PROFILE.replace(k=5)
    want = sorted(
        expected_for(refs, queries, a, {"r0", "r1"}) + expected_for(refs, queries, b, {"r2", "r3"})
    )
    assert rows(run(spark, refs, queries, [a, b])) == want


def expected_for(refs, queries, p, names):
    return [x for x in expected(refs, queries, p) if x[4] in names]


def test_profile_is_taken_when_either_pattern_matches(spark):
    refs = spark.createDataFrame([("r1", "x"), ("q", "yes"), ("q", "x"), ("r1", "yes"), ("q", None)], "rname string, rcomment string")
    profiles = [DEFAULT_PROFILE.replace(name_pattern="^r", comment_pattern="^y"), DEFAULT_PROFILE]
    got = [r.pid for r in assign_profiles(refs, profiles).collect()]
    assert got == [0, 0, 1, 0, 1]
    assert {r.pid for r in assign_profiles(refs, [DEFAULT_PROFILE, DEFAULT_PROFILE]).collect()} == {0}


def test_masking_tells_reads_of_one_name_apart(spark):
    reads = spark.createDataFrame([(1, "dup", "ACGTACGT"), (2, "dup", "ACGTACGT")], "seq_id long, name string, seq string")
    alns = spark.createDataFrame([(1, "dup", 2, 5, 8)], "seq_id long, qname string, qstart long, qend long, qlen long")
    assert {r.seq_id: r.seq for r in mask(reads, alns).collect()} == {1: "ACgtaCGT", 2: "ACGTACGT"}


def test_large_reference_numbers(spark):
    """Numbers beyond 24 bits give the same hits as small ones."""
    rng = random.Random(8)
    ref = "".join(rng.choice("ACGT") for _ in range(200))
    query = spark.createDataFrame([(0, "q", mutate(rng, ref))], "seq_id long, name string, seq string")
    found = []
    for rid in (3, (1 << 24) - 1, 1 << 24, (1 << 31) - 1):
        refs = spark.createDataFrame([(rid, "r", ref)], "rid long, name string, seq string")
        index = build_index(refs, DEFAULT_PROFILE)
        rows = scan(query, index).collect()
        assert {r.rid for r in rows} == {rid}
        found.append(len(rows))
    assert found[0] > 0 and len(set(found)) == 1


def test_reference_of_a_hundred_kilobases(spark):
    """Alignments on a reference far over 32,767 bases are those on the stretch around them."""
    rng = random.Random(21)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    before, stretch, after = draw(70_000), draw(1_200), draw(50_000)
    gene = stretch[400:800]
    copy = "".join(c for i, c in enumerate(gene) if i not in (90, 91, 250))
    copy = copy[:180] + "ACGGT" + copy[180:]
    queries = [("plus", draw(30) + copy + draw(40)), ("minus", draw(20) + brute.revcomp(copy) + draw(25)), ("none", draw(300))]
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(queries)], "seq_id long, name string, seq string")
    p = DEFAULT_PROFILE.replace(k=9)

    def found(ref, offset):
        r = spark.createDataFrame([(0, "r", ref)], "rid int, name string, seq string")
        rows = scan(q, build_index(r, p)).collect()
        return sorted((x.qname, x.qstart, x.qend, x.strand, x.rstart - offset, x.rend - offset, x.score, x.matches, x.cigar) for x in rows)

    got = found(before + stretch + after, 70_000)
    assert got == found(stretch, 0)
    assert {(x[0], x[3]) for x in got} == {("plus", "+"), ("minus", "-")} and any("I" in x[8] for x in got)
