"""The sieve of query pieces: what it leaves gives the same diagonals and chains, and far fewer seeds."""

import random

import pytest
from pyspark.sql import functions as F

from seedloom import catalog
from seedloom.operators import sieve as V
from seedloom.operators.kmers import PieceLayout, coded_kmers, query_kmers, query_pieces
from seedloom.operators.seeds import diagonal_histogram, seeds
from seedloom.plans import scan as stages
from seedloom.plans.index import build_index
from seedloom.profile import DEFAULT_PROFILE

from .test_scan import mutate


def case(spark, seed, k, letters="ACGT"):
    """References and texts with copies of them; ids that are null or twice, letters that are none."""
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice(letters) for _ in range(n))
    refs = [(i, "r", rand(rng.randint(k, 120))) for i in range(20)]
    texts = []
    for i in range(40):
        body = rand(rng.choice([0, 3, 60, 700]))
        for _ in range(rng.randint(0, 5)):
            body += mutate(rng, rng.choice(refs)[2], sub=0.03, gap=0.02) + rand(rng.randint(0, 50))
        texts.append((i, body))
    texts += [(3, texts[3][1]), (5, texts[5][1][:40]), (None, texts[8][1]), (None, texts[8][1]), (50, None), (51, "ACNXT" * 30)]
    p = DEFAULT_PROFILE.replace(k=k)
    index = build_index(spark.createDataFrame(refs, "rid int, name string, seq string"), p)
    return index, spark.createDataFrame(texts, "seq_id long, seq string").repartition(3, "seq_id"), p


def diagonals(pieces, index, p, layout, least):
    found = seeds(query_kmers(pieces, p.k, owned=layout, coded=True), coded_kmers(index.kmers.drop("pid")), p.k, p.squash_interval, 10**4, squash=False)
    by = found.groupBy("seq_id", "qlen", "rid", "strand", (F.col("qpos") - F.col("rpos")).alias("d"))
    rows = by.agg(F.count("*").alias("n"), F.min("qpos"), F.max("qpos"), F.min("rpos"), F.max("rpos")).filter(F.col("n") >= least)
    return sorted(map(str, rows.collect())), found.count()


@pytest.mark.parametrize("seed,k,letters,bases,most", [(1, 9, "ACGT", 1 << 17, 1 << 22), (2, 6, "AACGT", 300, 1 << 22), (3, 5, "AC", 500, 20_000)])
def test_diagonals_of_sieved_pieces(spark, monkeypatch, seed, k, letters, bases, most):
    index, docs, p = case(spark, seed, k, letters)
    table = V.KmerTable.of(coded_kmers(index.kmers.drop("pid")), k)
    monkeypatch.setattr(V, "BASES_PER_STEP", bases)
    monkeypatch.setattr(V, "SEEDS_PER_STEP", most)
    for core, least in ((None, 9), (320, 5)):
        layout = PieceLayout.of(120, p, core=core, warm=50)
        pieces = query_pieces(docs, layout)
        want, every = diagonals(pieces, index, p, layout, least)
        got, some = diagonals(V.on_diagonals(pieces, table, least), index, p, layout, least)
        assert got == want and len(want) > 20
        assert some <= every


@pytest.mark.parametrize("seed,k,letters", [(1, 9, "ACGT"), (3, 5, "AACGT"), (4, 6, "AC")])
def test_chains_of_sieved_pieces(spark, monkeypatch, seed, k, letters):
    """Rows of seeds, sieved or not, whole and in pieces so short that runs cross their borders."""
    index, docs, p = case(spark, seed, k, letters)
    docs = docs.filter("seq_id is not null and seq is not null and seq not like '%N%'")
    monkeypatch.setattr(stages, "SEEDS_FOR_LISTS", 10**9)
    calls = []
    real = stages.in_runs
    for profile, core, warm in ((p, None, None), (p.replace(min_seeds=3, window=12), 320, 20)):
        index.profiles[0] = profile
        layout = PieceLayout.of(120, profile, core=core, warm=warm)
        rows = lambda: sorted(map(tuple, stages.chain_stage(docs, index, 0, layout).collect()))
        monkeypatch.setattr(stages, "in_runs", lambda pieces, *a: pieces)
        want = rows()
        monkeypatch.setattr(stages, "in_runs", lambda *a: calls.append(1) or real(*a))
        assert rows() == want and len(want) > 20
    assert len(calls) == 2


def test_seeds_that_stand_alone_become_no_rows(spark):
    """Unrelated texts with a passage of a reference: only seeds near it get as far as the grouping."""
    rng = random.Random(7)
    rand = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = [(i, "r", rand(2_000)) for i in range(50)]
    index = build_index(spark.createDataFrame(refs, "rid int, name string, seq string"), catalog.PROFILE)
    docs = spark.createDataFrame([(i, rand(9_000) + refs[i][2][200:230]) for i in range(30)], "seq_id long, seq string")
    every = catalog.seed_rows(docs, index, squash=False)
    some = catalog.seed_rows(docs, index, squash=False, least=5)
    by = lambda s: sorted(map(str, s.groupBy("seq_id", "rid", "strand", (F.col("qpos") - F.col("rpos")).alias("d")).count().filter("count >= 5").collect()))
    assert by(some) == by(every) and len(by(some)) >= 30
    assert some.count() * 50 < every.count()
    layout = stages.layout_for(index, 0)
    every, some = (stages.seed_stage(docs, index, 0, layout, sieve=s) for s in (False, True))
    assert some.count() * 50 < every.count()


def test_spans_and_lines_are_made_once(spark, tmp_path):
    """Spans that two sides need are stored, and a line that is parsed is not made for each check."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcd") for _ in range(400))
    for name, key, rows in (("documents", "doc_id", [text, text[40:90] * 3]), ("benchmark", "item_id", [text[:150], text[30:200]])):
        spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    plan = lambda name: catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    for name in ("alignment_overlaps", "overlap_pairs", "output_order"):
        assert "MapInArrow" not in plan(name), name
    assert plan("paf_parse").count("format_string") == 1


@pytest.mark.parametrize("seed,k,letters,most", [(1, 9, "ACGT", 1 << 22), (3, 5, "AACGT", 2_500)])
def test_diagonals_counted_as_arrays(spark, monkeypatch, seed, k, letters, most):
    """Every diagonal once, whether its piece is counted as arrays or has too many seeds for that."""
    index, docs, p = case(spark, seed, k, letters)
    table = coded_kmers(index.kmers.drop("pid"))
    table = table.unionByName(table.filter("rid < 2").withColumn("rid", F.lit(None).cast("int")))
    monkeypatch.setattr(V, "SEEDS_PER_STEP", most)
    for core in (None, 320):
        layout = PieceLayout.of(120, p, core=core, warm=50)
        pieces = query_pieces(docs, layout)
        found = lambda kmers: seeds(kmers, table, k, p.squash_interval, 10**4, squash=False)
        want = diagonal_histogram(found(query_kmers(pieces, k, owned=layout, coded=True)))
        counts, others = V.diagonal_counts(pieces, V.KmerTable.of(table, k), layout)
        rest = diagonal_histogram(found(query_kmers(others, k, coded=True)).filter(V.own_diagonal(layout)))
        got = rest.unionByName(counts)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert counts.count() > 300 and (others.count() > 0) == (most < 1 << 22)
