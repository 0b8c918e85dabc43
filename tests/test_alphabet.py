import pytest
from pyspark.sql import functions as F

from seedloom.functions import alphabet as A
from seedloom.functions import scoring as S
from seedloom.profile import DEFAULT_PROFILE

BASES = {c: {b for b, m in zip("ACGT", (1, 2, 4, 8)) if A.IUPAC_MASK[c] & m} for c in A.IUPAC_LETTERS}


def test_match_table_is_set_intersection(spark):
    pairs = [(q, r) for q in A.IUPAC_LETTERS for r in A.IUPAC_LETTERS]
    df = spark.createDataFrame(pairs, "q string, r string").select("q", "r", A.iupac_match("q", "r").alias("m"))
    for row in df.collect():
        assert row.m == bool(BASES[row.q] & BASES[row.r])


def test_letters_outside_the_code_match_nothing(spark):
    df = spark.createDataFrame([("N", "A"), ("", "A"), ("X", "T"), ("a", "A")], "q string, r string")
    assert [x.m for x in df.select(A.iupac_match("q", "r").alias("m")).collect()] == [False, False, False, True]


def test_ambiguity(spark):
    df = spark.createDataFrame([(c,) for c in A.IUPAC_LETTERS], "c string")
    got = df.select("c", A.is_ambiguous("c").alias("amb"), A.expand_ambiguous("c").alias("x")).collect()
    for row in got:
        assert row.amb == (row.c not in "ACGT")
        assert set(row.x) <= BASES[row.c]
        assert len(row.x) == (2 if row.amb else 1)


def test_complement_is_an_involution(spark):
    df = spark.createDataFrame([("ACGTRYSWKMBDHV",)], "s string")
    row = df.select(A.reverse_complement("s").alias("r"), A.reverse_complement(A.reverse_complement("s")).alias("rr")).head()
    assert row.r == "BDHVKMWSRYACGT" and row.rr == "ACGTRYSWKMBDHV"
    for a, b in zip(A.IUPAC_LETTERS, A.IUPAC_COMPLEMENT):
        assert {dict(zip("ACGT", "TGCA"))[x] for x in BASES[a]} == BASES[b]


def test_header_split(spark):
    df = spark.createDataFrame([(" test1",), ("test3 comment comment  ",), ("test3  comment",), ("a\tb c",), ("",)], "h string")
    n, c = A.split_header("h")
    got = [(r.n, r.c) for r in df.select(n.alias("n"), c.alias("c")).collect()]
    assert got == [("test1", ""), ("test3", "comment comment"), ("test3", " comment"), ("a\tb", "c"), ("", "")]


@pytest.mark.parametrize(
    "text,want", [("acgt", "ACGT"), ("NnXx", "RRRR"), ("RYU", "RYT"), ("bdhv", "BDHV")]
)
def test_reference_letters(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(A.normalize_reference("s")).head()[0] == want


def test_scoring_columns(spark):
    lam = DEFAULT_PROFILE.rlambda
    seqs = ["AAAA", "ACGT", "A" * 31, "A" * 32, "A" * 33, "AACCGT"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = [r[0] for r in df.select(S.complexity_adjustment("s", lam)).collect()]
    from .brute import adjust

    assert got == [adjust(s, lam) for s in seqs]
    assert got[1] == 0 and got[0] == -8
    w = spark.createDataFrame([(x,) for x in (0, 1, 32, 255, 256, 32767)], "n int")
    assert [r[0] for r in w.select(S.chain_weight("n")).collect()] == [32, 31, 26, 24, 23, 17]
    c = spark.createDataFrame([("MMMIMMDDDDM",), ("",), ("M" * 120,)], "p string")
    assert [r[0] for r in c.select(S.run_length_cigar("p")).collect()] == ["3M1I2M4D1M", "", "120M"]
    uv = spark.createDataFrame([(q, r) for q in (0, 7, 1000) for r in (0, 3, 32766)], "q long, r long")
    u, v = S.rotate_u(F.col("q"), F.col("r")), S.rotate_v(F.col("q"), F.col("r"))
    for row in uv.select("q", "r", S.unrotate_q(u, v).alias("a"), S.unrotate_r(u, v).alias("b")).collect():
        assert (row.q, row.r) == (row.a, row.b)
