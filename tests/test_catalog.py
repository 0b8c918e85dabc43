import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedloom import catalog
from seedloom.operators.kmers import coded_kmers
from seedloom.operators.seeds import seed_totals, seeds

from .test_scan import mutate


@pytest.fixture(scope="module")
def gapped(tmp_path_factory):
    """Texts over a-d, one letter per base: mutated copies of both strands with gaps, ends and repeats."""
    rng = random.Random(23)
    letter = dict(zip("ACGT", "abcd"))
    rand = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    other = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    refs = [rand(rng.randint(60, 220)) for _ in range(8)] + ["ACGTTGCA" * 12, "ACC" * 30]
    texts = ["", "A"]
    for _ in range(30):
        body = rand(rng.randint(0, 60))
        for _ in range(rng.randint(1, 4)):
            part = mutate(rng, rng.choice(refs), sub=0.04, gap=0.02)
            body += (part if rng.random() < 0.5 else other(part)) + rand(rng.randint(0, 40))
        texts.append(body)
    folder = tmp_path_factory.mktemp("gapped")
    plain = lambda s: "".join(letter[c] for c in s)
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", refs)):
        table = pd.DataFrame({key: range(len(rows)), "text": [plain(r) for r in rows]})
        table.to_parquet(folder / f"{name}.parquet")
    return folder


@pytest.mark.parametrize("name,least", [("chain_greedy", 60), ("flank_filter", 60), ("xdrop_extend", 50), ("scan_alignments", 50), ("scan_paf", 50), ("scan_mask", 32)])
def test_scan_stages_equal_their_sql_on_gapped_copies(spark, gapped, name, least):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{gapped}/{table}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, str(gapped)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(repr, got[order].itertuples(index=False, name=None))) == sorted(map(repr, want[order].itertuples(index=False, name=None)))
    assert len(got) >= least
    if name == "scan_alignments":
        assert set(got["strand"]) == {"+", "-"} and got["cigar"].str.contains("I").any() and got["cigar"].str.contains("D").any()


def test_default_k_chains_equal_their_sql(spark, gapped):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{gapped}/{table}.parquet'")
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in ("qpos", "rpos", "qspan", "rspan", "n_seeds"))
    want = con.execute(f"SELECT doc_id, rid, strand, count(*) AS n_chains, {sums} FROM ({catalog._chain_sql(4)}) GROUP BY ALL").df()
    got = catalog.queries()["chain_greedy_default"](spark, str(gapped)).toPandas()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, got[order].itertuples(index=False, name=None))) == sorted(map(repr, want[order].itertuples(index=False, name=None)))
    assert got["n_chains"].sum() > 500


@pytest.mark.parametrize("name", ["seed_join", "seed_squash", "seed_diagonals", "best_per_start", "paf_format"])
def test_seeds_are_not_shuffled(spark, gapped, name):
    """Documents are dealt out as text; nothing between the k-mer join and the first aggregates moves seeds."""
    plan = catalog.queries()[name](spark, str(gapped))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.rindex("BroadcastHashJoin")]
    assert "HashAggregate" in above and "Exchange" not in above.replace("BroadcastExchange", "")


def test_chains_of_dealt_pieces(spark, gapped, monkeypatch):
    """Where splits would have too many seeds to sort, pieces are dealt to more tasks, with the same chains."""
    from seedloom.plans import scan as stages

    rows = lambda: sorted(map(tuple, catalog.queries()["chain_greedy_default"](spark, str(gapped)).collect()))
    want = rows()
    docs, index = catalog.doc_sequences(spark, str(gapped)), catalog.index_of(spark, str(gapped), catalog.DEFAULT_PROFILE)
    monkeypatch.setattr(stages, "SEEDS_PER_SORT", 500)
    monkeypatch.setattr("seedloom.operators.seeds.BASES_PER_TASK", 100)
    found = stages.seed_stage(docs, index, 0, stages.layout_for(index, 0))
    most = max(found.withColumn("_p", F.spark_partition_id()).groupBy("_p").count().collect(), key=lambda r: r["count"])
    assert found.rdd.getNumPartitions() > 16 and most["count"] < found.count() / 4
    assert rows() == want


@pytest.mark.parametrize("limit", [10**9, 0])
def test_totals_equal_an_aggregate_over_seeds(spark, gapped, limit):
    """Sums by k-mer before the join give what the seeds themselves give, broadcast or by the grid."""
    docs, index = catalog.doc_sequences(spark, str(gapped)), catalog.index_of(spark, str(gapped), catalog.DEFAULT_PROFILE)
    again = docs.withColumn("seq", F.concat("seq", F.lit("ACGTN"))).unionByName(docs.withColumn("seq_id", F.lit(None).cast("long")))
    table = coded_kmers(index.kmers.drop("pid"))
    table = table.unionByName(table.filter("rid < 2").withColumn("rid", F.lit(None).cast("int")))
    kmers, rows = catalog.dealt_kmers(docs.unionByName(again), index), index.stats[0]["max_kmers"]
    want = catalog._seed_summary(seeds(kmers, table, 4, 16, rows, limit=limit)).withColumnRenamed("doc_id", "seq_id")
    got = seed_totals(kmers, table, 4, 16, rows, limit).select(*want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_default_k_seeds_are_summed_before_they_meet(spark, tmp_path):
    """Two thousand million seeds of one letter, one by one, would take an hour."""
    n_q, n_r = 60_000, 32_000
    for name, key, n in (("documents", "doc_id", n_q), ("benchmark", "item_id", n_r)):
        pd.DataFrame({key: [1], "text": ["a" * n]}).to_parquet(tmp_path / f"{name}.parquet")
    (got,) = catalog.queries()["seed_squash_default"](spark, str(tmp_path)).collect()
    kept = (n_q - 4) // 16 + 1  # query positions whose seeds all stay; the others keep the one at the end of the reference
    assert (got["doc_id"], got["rid"], got["strand"]) == (1, 1, "+")
    assert got["n_seeds"] == kept * (n_r - 3) + (n_q - 3 - kept)
    assert (got["v_min"], got["v_max"]) == (-(n_q - 4), 2 * (n_r - 4))
