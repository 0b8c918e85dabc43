"""PAF rows: formatting, parsing, reading and writing.

Inside the library intervals are half-open; the text form ends inclusively and leaves
the match count as ``*`` unless ``standard=True``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alignments import OUTPUT_ORDER


def paf_line(standard: bool = False) -> Column:
    """One PAF row of the alignment columns."""
    last = 0 if standard else 1
    matches = F.col("matches").cast("string") if standard else F.lit("*")
    # half-even at four digits, as C's printf rounds
    ident = F.format_string("%.4f", F.bround(F.col("identity").cast("float").cast("double"), 4))
    return F.concat_ws(
        "\t",
        F.col("qname"),
        F.col("qlen").cast("string"),
        F.col("qstart").cast("string"),
        (F.col("qend") - last).cast("string"),
        F.col("strand"),
        F.col("rname"),
        F.col("rlen").cast("string"),
        F.col("rstart").cast("string"),
        (F.col("rend") - last).cast("string"),
        matches,
        F.col("block_len").cast("string"),
        F.col("mapq").cast("string"),
        F.concat(F.lit("AS:i:"), F.col("score").cast("string")),
        F.concat(F.lit("XS:i:"), F.col("raw_score").cast("string")),
        F.concat(F.lit("XI:f:"), ident),
        F.concat(F.lit("CG:Z:"), F.col("cigar")),
    )


def write_paf(alignments: DataFrame, path: str, standard: bool = False, mode: str = "errorifexists") -> None:
    """Text files in output order (a range-partitioned sort, file by file)."""
    present = [c for c in OUTPUT_ORDER if c in alignments.columns]
    alignments.orderBy(*present).select(paf_line(standard).alias("value")).write.mode(mode).text(path)


def parse_paf(lines: DataFrame, col: str = "value", standard: bool = False, strict: bool = True) -> DataFrame:
    """Alignment columns of PAF text lines, tags decoded.

    A row without twelve columns or with a strand other than +/- fails the job, or is
    dropped with ``strict=False``.
    """
    shift = 0 if standard else 1
    # a line is made and split once, below the explode, not for each check and column
    filled = F.when(F.length(F.trim(F.col(col))) > 0, F.array(F.split(F.col(col), "\t")))
    rows = lines.select(F.explode(filled).alias("_f"))
    good = (F.size("_f") >= 12) & F.get("_f", F.lit(4)).isin("+", "-")
    if strict:
        message = F.concat(F.lit("malformed alignment row: "), F.array_join("_f", "\t"))
        rows = rows.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    else:
        rows = rows.filter(good)

    def field(i: int) -> Column:
        return F.get("_f", F.lit(i))

    def num(i: int) -> Column:
        return field(i).cast("long")

    def tag(name: str) -> Column:
        first = F.get(F.filter("_f", lambda x: x.startswith(f"{name}:")), F.lit(0))
        return F.nullif(F.substr(first, F.lit(len(name) + 2)), F.lit(""))

    return rows.select(
        field(0).alias("qname"),
        num(1).alias("qlen"),
        num(2).alias("qstart"),
        (num(3) + shift).alias("qend"),
        field(4).alias("strand"),
        field(5).alias("rname"),
        num(6).alias("rlen"),
        num(7).alias("rstart"),
        (num(8) + shift).alias("rend"),
        field(9).try_cast("int").alias("matches"),
        num(10).alias("block_len"),
        num(11).cast("int").alias("mapq"),
        tag("AS:i").cast("int").alias("score"),
        tag("XS:i").cast("int").alias("raw_score"),
        tag("XI:f").cast("double").alias("identity"),
        tag("CG:Z").alias("cigar"),
    )


def read_paf(spark: SparkSession, path: str | list[str], standard: bool = False, strict: bool = True) -> DataFrame:
    return parse_paf(spark.read.text(path), standard=standard, strict=strict)
