"""Score-side column expressions: base composition, complexity, weight, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def base_count(seq: Column | str, base: str) -> Column:
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.length(col) - F.length(F.replace(col, F.lit(base), F.lit("")))


def complexity_adjustment(seq: Column | str, rlambda: float) -> Column:
    """``trunc(-(1/lambda) * sum_b c_b * ln(4 c_b / n))``; zero counts are skipped."""
    col = F.col(seq) if isinstance(seq, str) else seq
    n = F.length(col)
    terms = []
    for b in BASES:
        c = base_count(col, b)
        terms.append(F.when(c > 0, c * F.ln(4.0 * c / n)).otherwise(F.lit(0.0)))
    total = terms[0] + terms[1] + terms[2] + terms[3]
    return (-(total) * F.lit(rlambda)).cast("int")


def patched_score(raw: Column, adjustment: Column) -> Column:
    return F.greatest(F.lit(0), raw + adjustment)


def identity(matches: Column, rspan: Column) -> Column:
    return matches.cast("double") / rspan


def chain_weight(rspan: Column | str) -> Column:
    """Leading zeros of the 32-bit span: smaller means longer; 32 for an empty span."""
    col = F.col(rspan) if isinstance(rspan, str) else rspan
    return F.when(col <= 0, F.lit(32)).otherwise(32 - F.length(F.bin(col.cast("long"))))


def rotate_u(q: Column, r: Column) -> Column:
    return 2 * q - r


def rotate_v(q: Column, r: Column) -> Column:
    return 2 * r - q


def unrotate_q(u: Column, v: Column) -> Column:
    return ((2 * u + v) / 3).cast("long")


def unrotate_r(u: Column, v: Column) -> Column:
    return ((2 * v + u) / 3).cast("long")


def canonical_start(strand: Column, start: Column, span: Column, length: Column) -> Column:
    """Forward-strand start of a span given in coordinates of the walked strand."""
    return F.when(strand == "-", length - (start + span)).otherwise(start)


def run_length_cigar(path: Column | str) -> Column:
    """Run-length text of a per-column op string, e.g. ``MMMIMM`` -> ``3M1I2M``."""
    col = F.col(path) if isinstance(path, str) else path
    runs = F.regexp_extract_all(col, F.lit(r"(M+|I+|D+|=+|X+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.length(x).cast("string"), F.substring(x, 1, 1))), "")
