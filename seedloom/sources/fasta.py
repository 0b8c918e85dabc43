"""FASTA and FASTQ records as DataFrames, and back.

FASTA goes through Spark's own splittable text reader with a record separator.  FASTQ of four
lines a record is split too, with lines numbered by a first pass (``read_fastq``).  Wrapped FASTQ
cannot be re-synchronised inside a file (a quality line may start with any marker), so a file
is one streaming task (``read_records``); the same path reads xz files.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import split_header
from ..session import checkpointed

RECORD_SCHEMA = "seq_id long, name string, comment string, seq string, qual string"
RECORD_BITS = 32  # of an id, for the record inside its file
_RAW_SCHEMA = "file_ord int, rec int, header string, seq string, qual string"


# ------------------------------------------------------------------------------ text route
def parse_fasta_text(records: DataFrame, col: str = "value") -> DataFrame:
    """Header and body of separator-split records; line breaks and blanks removed."""
    text = F.regexp_replace(F.col(col), r"^[\s]*>", "")
    cut = F.instr(text, "\n")
    header = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    body = F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise(F.lit(""))
    name, comment = split_header(F.translate(header, "\r", ""))
    kept = [c for c in records.columns if c != col]
    return records.filter(F.length(F.trim(F.col(col))) > 0).select(
        *kept,
        name.alias("name"),
        comment.alias("comment"),
        F.translate(body, "\r\n\t ", "").alias("seq"),
        F.lit("").alias("qual"),
    )


def number_records(df: DataFrame, split_cols: list[str]) -> DataFrame:
    """``seq_id`` in file order without shuffling the sequences.

    Rows of a file split sit together in one partition, so their running ids are
    consecutive; adding the row count of all earlier splits (one small row each) makes
    them dense.
    """
    tagged = df.withColumn("_m", F.monotonically_increasing_id())
    splits = tagged.groupBy(*split_cols).agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy(*split_cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(*split_cols, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    joined = tagged.join(F.broadcast(offsets), split_cols)
    return (
        joined.withColumn("seq_id", F.col("_o") + F.col("_m") - F.col("_first"))
        .withColumn("_head", F.col("_m") == F.col("_first"))
        .drop("_m", "_o", "_first")
    )


def read_fasta(spark: SparkSession, path: str | list[str], number: bool = True) -> DataFrame:
    """FASTA files, plain or with a codec suffix Hadoop knows (.gz, .bz2)."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    raw = raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    if not number:
        return parse_fasta_text(raw.select("value")).select("name", "comment", "seq", "qual")
    raw = number_records(raw.filter(F.length(F.trim("value")) > 0), ["_file", "_block"])
    # text ahead of the first marker of a file belongs to no record
    leading = F.col("_head") & (F.col("_block") == 0) & ~F.ltrim("value").startswith(">")
    return parse_fasta_text(raw.filter(~leading)).select(
        "seq_id", "name", "comment", "seq", "qual"
    )


# ----------------------------------------------------------------------- streaming route
def open_any(path: str) -> io.TextIOBase:
    """Text stream of a file, compression told from its first bytes."""
    raw = open(path, "rb")
    magic = raw.read(6)
    raw.seek(0)
    if magic[:3] == b"\x1f\x8b\x08":
        return io.TextIOWrapper(gzip.GzipFile(fileobj=raw), newline="\n")
    if magic[:3] == b"BZh":
        return io.TextIOWrapper(bz2.BZ2File(raw), newline="\n")
    if magic == b"\xfd7zXZ\x00":
        return io.TextIOWrapper(lzma.LZMAFile(raw), newline="\n")
    return io.TextIOWrapper(raw, newline="\n")


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(header, sequence, quality) of FASTA or FASTQ lines.

    The marker of the first record decides the format.  A quality ends when it is as
    long as its sequence, so markers inside it are data.
    """
    marker, header, seq, qual = None, None, [], []
    state, want, got = "skip", 0, 0
    for line in lines:
        line = line.rstrip("\r\n")
        if marker is None:
            if line[:1] not in (">", "@"):
                continue
            marker = line[0]
        if state == "qual" and got < want:
            qual.append(line)
            got += len(line)
            continue
        if line.startswith(marker):
            if header is not None:
                yield header, "".join(seq), "".join(qual)
            header, seq, qual, state, want, got = line[1:], [], [], "seq", 0, 0
        elif state == "seq" and marker == "@" and line.startswith("+"):
            state, want = "qual", sum(map(len, seq))
        elif state == "seq" and line:
            seq.append(line.replace(" ", ""))
    if header is not None:
        yield header, "".join(seq), "".join(qual)


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file_ord", "rec", "header", "seq", "qual"]
    for pdf in batches:
        for file_ord, path in zip(pdf["file_ord"], pdf["path"]):
            rows, size = [], 0
            with open_any(path) as fp:
                for i, rec in enumerate(records(fp)):
                    rows.append((file_ord, i, *rec))
                    size += len(rec[1]) + len(rec[2])
                    if size >= 1 << 19:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def expanded(path: str | list[str]) -> list[str]:
    """The files that paths and patterns stand for, in the order given."""
    given = [path] if isinstance(path, str) else list(path)
    if "-" in given:
        raise ValueError("standard input cannot be read by a cluster; give a file")
    return [p for g in given for p in (sorted(glob.glob(g)) or [g])]


def read_records(
    spark: SparkSession, path: str | list[str], keep_comment: bool = True, keep_qual: bool = True, first_file: int = 0, tasks: int | None = None
) -> DataFrame:
    """FASTA/FASTQ files of any supported compression, one stream per file.

    Paths must be visible to every executor (a shared mount).  ``first_file`` is the number of
    the first file in the ids.  Files share at most ``tasks`` tasks; by default each has its own.
    """
    paths = expanded(path)
    if first_file + len(paths) > 1 << 31:
        raise ValueError("too many files for the record ids")
    files = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "file_ord int, path string")
    files = files.repartitionByRange(min(len(paths), tasks or len(paths)), "file_ord")
    raw = files.mapInPandas(_read_files, _RAW_SCHEMA)
    name, comment = split_header("header")
    # (file, record) packed: ordered as the input, unique, and free of a counting pass.  Both are
    # 32-bit numbers that are not negative, so no file or record count runs into another's
    seq_id = F.shiftleft((F.col("file_ord") + first_file).cast("long"), RECORD_BITS) + F.col("rec")
    return raw.select(
        seq_id.alias("seq_id"),
        name.alias("name"),
        (comment if keep_comment else F.lit("")).alias("comment"),
        "seq",
        (F.col("qual") if keep_qual else F.lit("")).alias("qual"),
    )


# ------------------------------------------------------------------------- split FASTQ
EDGE = 3  # lines at either end of a split whose record may go on in the next one
BYTES_PER_SPLIT = 512
SPLIT_BROADCAST_LIMIT = 256 << 20
_EDGE_SCHEMA = "_file string, _block long, _n long, _head array<string>, _tail array<string>"
_WHOLE_SCHEMA = "_file string, rec long, header string, seq string, mark string, qual string"


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Stretches of one split, in order; a partition may hold several splits."""
    new = (pdf["_file"] != pdf["_file"].shift()) | (pdf["_block"] != pdf["_block"].shift())
    for _, run in pdf.groupby(new.cumsum(), sort=False):
        yield (run["_file"].iloc[0], int(run["_block"].iloc[0])), run


def _split_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split its number of lines and the lines at both ends; no line is in both lists."""
    now, n, head, tail = None, 0, [], []

    def row():
        return pd.DataFrame([(*now, n, head, tail)], columns=["_file", "_block", "_n", "_head", "_tail"])

    for pdf in batches:
        for key, run in _runs(pdf):
            if key != now:
                if now is not None:
                    yield row()
                now, n, head, tail = key, 0, [], []
            lines = run["value"]
            missing = EDGE - len(head)
            head = head + lines.iloc[:missing].tolist()
            tail = (tail + lines.iloc[missing:].iloc[-EDGE:].tolist())[-EDGE:]
            n += len(lines)
    if now is not None:
        yield row()


def _whole_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records whose four lines lie in one split, from its lines in order and the number of its first line."""
    now, at, rest = None, 0, []
    for pdf in batches:
        for key, run in _runs(pdf):
            if key != now:
                now, at, rest = key, int(run["_from"].iloc[0]), []
            lines = rest + run["value"].tolist()
            skip = -at % 4
            whole = max(0, (len(lines) - skip) // 4)
            stop = skip + 4 * whole
            if whole:
                part = lines[skip:stop]
                columns = {"header": part[::4], "seq": part[1::4], "mark": part[2::4], "qual": part[3::4]}
                first = (at + skip) // 4
                yield pd.DataFrame({"_file": key[0], "rec": range(first, first + whole), **columns})
                at, rest = at + stop, lines[stop:]
            else:
                rest = lines


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTQ files of four lines a record through Spark's splittable text reader.

    Any storage and codec Spark's text reader knows (.gz is one split).  A first pass counts the lines of
    each split, so that every split knows which line of a record it begins with; there is nothing to
    guess from markers, which qualities may hold.  Records that lie in one split are put together
    there; the few that run over a border come from the lines at the ends of the splits.  No
    sequence is shuffled otherwise.  Ids hold the place of the file among the sorted paths and the
    record, as in ``read_records``.  Carriage returns are dropped, and four empty lines are no record.  A
    record with a wrong marker or lines missing, or whose quality is not as long as its sequence
    (a wrapped file, which ``read_records`` reads), fails the job.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.rtrim(F.col("value"), F.lit("\r")).alias("value")
    )
    edges = checkpointed(lines.mapInPandas(_split_edges, _EDGE_SCHEMA))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    offsets = edges.select("_file", "_block", "_from")
    if edges.count() * BYTES_PER_SPLIT <= SPLIT_BROADCAST_LIMIT:
        placed = lines.join(F.broadcast(offsets), ["_file", "_block"])
    else:
        ordered = lines.withColumn("_m", F.monotonically_increasing_id())
        placed = ordered.join(offsets, ["_file", "_block"]).repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_m").drop("_m")
    whole = placed.mapInPandas(_whole_records, _WHOLE_SCHEMA)

    ends = F.concat(
        F.transform("_head", lambda x, i: F.struct((F.col("_from") + i).alias("line"), x.alias("value"))),
        F.transform("_tail", lambda x, i: F.struct((F.col("_from") + F.col("_n") - F.size("_tail") + i).alias("line"), x.alias("value"))),
    )
    rec = F.floor(F.col("_x.line") / 4)
    inside = (rec * 4 >= F.col("_from")) & (rec * 4 + 3 < F.col("_from") + F.col("_n"))
    cut = edges.select("_file", "_from", "_n", F.explode(ends).alias("_x")).filter(~inside)
    field = {c: F.max(F.when(F.col("_x.line") % 4 == i, F.col("_x.value"))).alias(c) for i, c in enumerate(("header", "seq", "mark", "qual"))}
    whole = whole.unionByName(cut.groupBy("_file", rec.alias("rec")).agg(*field.values()))

    text = F.concat_ws("", "header", "seq", "mark", "qual")
    sound = F.col("header").startswith("@") & F.col("mark").startswith("+") & (F.length("seq") == F.length("qual"))
    message = F.concat(F.lit("not a FASTQ record of four lines: "), "_file", F.lit(", line "), (F.col("rec") * 4 + 1).cast("string"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.substring("header", 2, 1 << 30)).otherwise(F.raise_error(message))
    # a file may end with the marker line of an empty sequence, its line of no qualities unsaid
    records = whole.filter(text != "").fillna("", ["qual"]).withColumn("header", checked)
    # one row per file; lost in no join, as every record is of a file with lines
    files = edges.select("_file").distinct().withColumn("_ord", F.row_number().over(Window.orderBy("_file")) - 1)
    if files.count() * BYTES_PER_SPLIT <= SPLIT_BROADCAST_LIMIT:
        files = F.broadcast(files)
    name, comment = split_header("header")
    return records.join(files, "_file").select(
        (F.shiftleft(F.col("_ord").cast("long"), RECORD_BITS) + F.col("rec")).alias("seq_id"),
        name.alias("name"), comment.alias("comment"), F.translate("seq", " ", "").alias("seq"), "qual",
    )


# ---------------------------------------------------------------------------------- sinks
def record_text():
    """FASTA, or FASTQ when a quality is present; bodies on a single line."""
    header = F.when(F.coalesce("comment", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(" ", "name", "comment"))
    fasta = F.concat(F.lit(">"), header, F.lit("\n"), F.col("seq"))
    fastq = F.concat(F.lit("@"), header, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    return F.when(F.coalesce("qual", F.lit("")) == "", fasta).otherwise(fastq)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    if "seq_id" in df.columns:
        df = df.orderBy("seq_id")
    df.select(record_text().alias("value")).write.mode(mode).text(path)
