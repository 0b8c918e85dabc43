import bz2
import gzip
import lzma
import random

import pytest

from seedloom.cli import read_files, write_rejected
import seedloom.sources.fasta as fasta
from seedloom.sources.fasta import read_fasta, read_fastq, read_records, write_records

# wrapped bodies, CRLF, blank lines, spaces after the marker, a marker inside a header, a trailing comment
FASTA = ">chrA first arm > left\nGATTACA\n>  chrB\r\nCCGG\r\n\r\nTTAA\r\n\n\n> chrC\n\n\nGT\n>chrD  \nTTTTT\n\n"
WANT = [("chrA", "first arm > left", "GATTACA"), ("chrB", "", "CCGGTTAA"), ("chrC", "", "GT"), ("chrD", "", "TTTTT")]
# qualities that begin with, or hold, every marker; wrapped; blank lines at the end
FASTQ = (
    "@one lane=3\nGATTACA\n+\n@I+I>II\n@ two\nCCGG\nTT\n+two\n+@>!\nII\n\n\n@  three\n\nGTG\n+  three\n\n>>@\n"
    "@four  of four\nAC\n+\n++" + "\n" * 9
)
WANT_Q = [
    ("one", "lane=3", "GATTACA", "@I+I>II"),
    ("two", "", "CCGGTT", "+@>!II"),
    ("three", "", "GTG", ">>@"),
    ("four", " of four", "AC", "++"),
]


def listed(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("seq_id").collect()]


def test_fasta_both_routes(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_bytes(FASTA.encode())
    for reader in (read_fasta, read_records):
        assert listed(reader(spark, str(f)), "name", "comment", "seq") == WANT


@pytest.mark.parametrize("pack,suffix", [(gzip.compress, ".gz"), (bz2.compress, ".bz2"), (lzma.compress, ".xz")])
def test_compressed(spark, tmp_path, pack, suffix):
    f = tmp_path / f"a.fa{suffix}"
    f.write_bytes(pack(FASTA.encode()))
    assert listed(read_records(spark, str(f)), "name", "comment", "seq") == WANT
    if suffix != ".xz":
        assert listed(read_fasta(spark, str(f)), "name", "comment", "seq") == WANT


@pytest.mark.parametrize("comment", [True, False])
@pytest.mark.parametrize("qual", [True, False])
def test_fastq(spark, tmp_path, comment, qual):
    f = tmp_path / "a.fq"
    f.write_text(FASTQ)
    got = listed(read_records(spark, str(f), keep_comment=comment, keep_qual=qual), "name", "comment", "seq", "qual")
    assert got == [(n, c if comment else "", s, q if qual else "") for n, c, s, q in WANT_Q]


def four_lines(rng, n, longest):
    """Records whose qualities begin with, and hold, every marker."""
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, rng.randint(2, longest)])))
        qual = "".join(rng.choice("@+>I#") for _ in seq)
        out.append(f"@r{i} lane=@{i % 3}\n{seq}\n+{rng.choice(['', 'x', '@'])}\n{qual}\n")
    return out


@pytest.mark.parametrize("size", ["128m", "4096", "300", "41"])
def test_fastq_is_split_anywhere(spark, tmp_path, size, monkeypatch):
    """Splits shorter than a record, several splits in one task, CRLF, blank lines at the end, several files, gzip."""
    rng = random.Random(29)
    longest = 60 if size == "41" else 300
    n = 60 if size == "41" else 200
    for name, end in (("a.fq", ""), ("b.fq", "\n\n\n"), ("c.fq", "\n" * 9)):
        (tmp_path / name).write_text("".join(four_lines(rng, n, longest)) + end)
    (tmp_path / "d.fq").write_bytes("".join(four_lines(rng, 20, longest)).replace("\n", "\r\n").encode())
    (tmp_path / "e.fq.gz").write_bytes(gzip.compress("".join(four_lines(rng, 50, longest)).encode()))
    (tmp_path / "f.fq").write_text("".join(four_lines(rng, 3, 9)).removesuffix("\n"))
    files = sorted(str(f) for f in tmp_path.glob("*.fq*"))
    cols = ("seq_id", "name", "comment", "seq", "qual")
    want = listed(read_records(spark, files), *cols)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert listed(read_fastq(spark, files), *cols) == want
        if size == "300":
            monkeypatch.setattr(fasta, "SPLIT_BROADCAST_LIMIT", 0)
            assert listed(read_fastq(spark, str(tmp_path / "*.fq*")), *cols) == want
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_fastq_that_is_not_of_four_lines(spark, tmp_path):
    good = "@a\nAC\n+\nII\n"
    for i, bad in enumerate(["@a\nAC\nGT\n+\nII\nII\n", good + "\n" + good, good + "@b\nAC\n+\n", "@a\nAC\n+\nIII\n", ">a\nAC\n>b\nGT\n"]):
        (tmp_path / f"{i}.fq").write_text(bad)
        with pytest.raises(Exception, match="not a FASTQ record"):
            read_fastq(spark, str(tmp_path / f"{i}.fq")).collect()
    (tmp_path / "none.fq").write_text("")
    assert read_fastq(spark, str(tmp_path / "none.fq")).collect() == []


def test_leading_text_and_standard_input(spark, tmp_path):
    f = tmp_path / "j.fa"
    f.write_text("some words\nmore\n" + FASTA)
    for reader in (read_fasta, read_records):
        assert listed(reader(spark, str(f)), "name", "comment", "seq") == WANT
    with pytest.raises(ValueError):
        read_records(spark, "-")


def test_random_fasta_is_split_independently(spark, tmp_path):
    rng = random.Random(17)
    note = "run=7 well=C4; primer +2 @ > marks"
    want, text = [], []
    for i in range(600):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1024, 2047)))
        want.append((f"{i:06d}", note, seq))
        text.append(">" + " " * rng.randint(0, 30) + f"{i:06d} {note}" + " " * rng.randint(0, 30) + "\n")
        at = 0
        while at < len(seq):
            n = rng.randint(1, 80)
            text.append(seq[at : at + n] + "\n" * rng.randint(1, 3))
            at += n
    f = tmp_path / "big.fa"
    f.write_text("".join(text))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "100000", "40001"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_fasta(spark, str(f))
            rows = df.orderBy("seq_id").collect()
            assert [r.seq_id for r in rows] == list(range(600))
            assert [(r.name, r.comment, r.seq) for r in rows] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert listed(read_records(spark, str(f)), "name", "comment", "seq") == want


def test_write_and_read_back(spark, tmp_path):
    f = tmp_path / "a.fq"
    f.write_text(FASTQ)
    write_records(read_records(spark, str(f)), str(tmp_path / "out"))
    again = read_records(spark, str(tmp_path / "out" / "part-*"))
    got = listed(again, "name", "comment", "seq", "qual")
    assert got == WANT_Q


def test_ids_of_very_many_files_stay_apart(spark, tmp_path):
    """Thousands of files by pattern and by list, before and after a table with dense ids."""
    for i in range(5000):
        (tmp_path / f"{i:04d}.fq").write_text(f"@r{i}\nACGT\n+\nIIII\n")
    (tmp_path / "a.fa").write_text(">x\nAC\n>y\nGT\n")
    rows = read_records(spark, str(tmp_path / "*.fq"), tasks=8)
    assert [r.name for r in rows.orderBy("seq_id").collect()] == [f"r{i}" for i in range(5000)]
    some = [str(tmp_path / f"{i:04d}.fq") for i in range(3)]
    mixed = read_files(spark, [str(tmp_path / "a.fa"), *some, str(tmp_path / "a.fa")])
    assert [(r.name, r.block) for r in mixed.orderBy("seq_id").collect()] == [
        ("x", 0), ("y", 0), ("r0", 1), ("r1", 2), ("r2", 3), ("x", 4), ("y", 4)
    ]
    far = read_records(spark, some, first_file=(1 << 31) - 3).orderBy("seq_id").collect()
    assert [r.name for r in far] == ["r0", "r1", "r2"] and all(r.seq_id > 0 for r in far)
    with pytest.raises(ValueError):
        read_records(spark, some, first_file=(1 << 31) - 2)


def test_rejected_queries_are_named(spark, tmp_path):
    rows = spark.createDataFrame([(0, "good", "ACGN"), (1, "gap", "AC-G"), (2, "odd", "AZ")], "seq_id long, name string, seq string")
    assert write_rejected(rows, str(tmp_path / "no")) == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "no")).collect()) == ["gap", "odd"]
    assert write_rejected(rows.limit(1), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
