"""Command line, file streams and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
from seedloom import catalog, cli
from seedloom.plans.index import build_index
from seedloom.profile import DEFAULT_PROFILE
from seedloom.sources.fasta import read_fasta
from seedloom.sources.paf import read_paf
from seedloom.streaming.scan_files import query_stream, scan_stream

from . import brute
from .test_scan import dataset, expected, rows

SF = "/root/testdata/sf0.001"


def as_fasta(records):
    return "".join(f">{n} x\n{s[:70]}\n{s[70:]}\n" for n, s in records)


def test_command_line(spark, tmp_path):
    refs, queries = dataset(21, n_ref=3, n_query=3)
    (tmp_path / "r.fa").write_text(as_fasta(refs))
    (tmp_path / "q.fa").write_text(as_fasta(queries))
    (tmp_path / "opt").write_text("-k 5")
    p = DEFAULT_PROFILE.replace(k=5)
    want = expected(refs, queries, p)
    path = lambda name: str(tmp_path / name)
    assert cli.main(["index", "-d", path("ix"), "-x", path("opt"), path("r.fa")], spark) == 0
    assert cli.main(["scan", "-o", path("a"), path("ix"), path("q.fa")], spark) == 0
    assert cli.main(["scan", "-o", path("b"), "-k", "5", path("r.fa"), path("q.fa")], spark) == 0
    for name in "ab":
        got = sorted(
            (r.qname, r.qstart, r.qend, r.strand, r.rname, r.rstart, r.rend, r.score, r.raw_score, r.cigar)
            for r in read_paf(spark, path(name)).collect()
        )
        assert got == want
    assert cli.main(["mask", "-F", path("a"), "-o", path("m"), "-M", "0", path("q.fa")], spark) == 0
    masked = {r.name: r.seq for r in read_fasta(spark, path("m")).collect()}
    for name, seq in queries:
        inside = set()
        for w in want:
            if w[0] == name:
                inside |= set(range(w[1], w[2]))
        assert masked[name] == "".join(c.lower() if i in inside else c for i, c in enumerate(seq))
    (tmp_path / "mask").write_text(f"-x opt -F '{path('a')}' -G 0\n-M 0")
    assert cli.main(["mask", "-x", path("mask"), "-o", path("m2"), path("q.fa")], spark) == 0
    assert {r.name: r.seq for r in read_fasta(spark, path("m2")).collect()} == masked
    with pytest.raises(SystemExit):
        cli.main(["mask", "-o", path("m3"), path("q.fa")], spark)
    with pytest.warns(UserWarning):
        cli.main(["scan", "-o", path("c"), "-k", "6", path("ix"), path("q.fa")], spark)


def test_file_stream(spark, tmp_path):
    refs, queries = dataset(22, n_ref=2, n_query=4)
    p = DEFAULT_PROFILE.replace(k=5)
    q = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(queries)], "seq_id long, name string, seq string")
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    index = build_index(
        spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(refs)], "rid int, name string, seq string"), p
    )
    stream = scan_stream(
        query_stream(spark, str(tmp_path / "in"), 2), index, str(tmp_path / "out"), str(tmp_path / "state")
    )
    stream.awaitTermination()
    got = read_paf(spark, str(tmp_path / "out"))
    assert got.count() == len(expected(refs, queries, p))


@pytest.mark.parametrize(
    "name", ["encode_seq", "iupac_match", "kmer_ambiguity", "seed_squash", "best_per_start", "mask_lowercase"]
)
def test_registered_queries_equal_their_sql(spark, name):
    import check

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canonical(got) == check.canonical(want)


def test_scan_query_equals_restatement_on_whole_tables(spark):
    """The documents that share a passage with a benchmark text, against brute force."""
    got = rows(entry.entry(spark))
    docs = {r.name: r.seq for r in catalog.doc_sequences(spark, SF).collect()}
    refs = [(r.name, r.seq) for r in catalog.references(spark, SF).orderBy("rid").collect()]
    hit = sorted({g[0] for g in got})
    assert hit
    pairs = sorted({(g[0], g[4]) for g in got})
    def quick(q, r, k, interval, squash=True):
        at = {}
        for j in range(len(r) - k + 1):
            at.setdefault(r[j : j + k], []).append(j)
        out = []
        for i in range(len(q) - k + 1):
            for j in at.get(q[i : i + k], ()):
                more = i + k < len(q) and j + k < len(r) and q[i + k] == r[j + k]
                if not more or (len(q) - (i + k)) % interval == 0:
                    out.append((i, j))
        return out

    want = []
    for qn, rn in pairs:
        found = brute.scan([(qn, docs[qn])], [(rn, dict(refs)[rn])], catalog.PROFILE, quick)
        want += [(*x[:-1], brute.cigar(x[-1])) for x in found]
    assert got == sorted(want)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
