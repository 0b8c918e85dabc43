"""Sums over seeds as products of matrices against an aggregate over the seeds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedloom import catalog
from seedloom.operators import totals as T
from seedloom.operators.kmers import PieceLayout, coded_kmers, query_kmers, query_pieces
from seedloom.operators.seeds import seed_totals, seeds

from .test_sieve import case


@pytest.mark.parametrize("seed,k,letters,core", [(1, 4, "ACGT", None), (2, 5, "AACGT", 320), (3, 3, "AC", 300)])
def test_products_equal_an_aggregate_over_seeds(spark, monkeypatch, seed, k, letters, core):
    index, docs, p = case(spark, seed, k, letters)
    docs = docs.filter("seq is null or seq not like '%N%'").repartition(2, "seq_id")
    layout = PieceLayout.of(120, p, core=core, warm=50)
    pieces = query_pieces(docs, layout)
    table = coded_kmers(index.kmers.drop("pid"))
    table = table.unionByName(table.filter("rid < 2").withColumn("rid", F.lit(None).cast("int")))
    met = seeds(query_kmers(pieces, k, owned=layout, coded=True), table, k, p.squash_interval, 10**4)
    want = catalog._seed_summary(met).withColumnRenamed("doc_id", "seq_id")
    monkeypatch.setattr(T, "TEXTS", 7)
    for limit in (10**9, 0):
        got = seed_totals(pieces, table, k, p.squash_interval, 10**4, limit, owned=layout).select(*want.columns)
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_products_that_doubles_cannot_hold():
    left, right = np.full((2, 3), float(1 << 30)), np.full((3, 2), float((1 << 24) + 1))
    assert T._product(left, right).tolist() == [[3 * (1 << 30) * ((1 << 24) + 1)] * 2] * 2


def test_no_row_for_each_kmer_of_a_text_and_reference(spark, tmp_path):
    """Every text meets every reference in a matrix: no join, no row for each group of k-mers."""
    text = "abcdabddbca" * 20
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([(i, text[i:]) for i in range(9)], f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = catalog.queries()["seed_squash_default"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    assert got.count() >= 81
