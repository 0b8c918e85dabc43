"""Nucleotide alphabet as column expressions.

Sequences stay STRING columns of upper-case IUPAC letters; everything here is a
built-in expression, so it fuses into whole-stage codegen with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC code masks (A=1, C=2, G=4, T=8) and complements.
IUPAC_MASK = {
    "A": 1, "C": 2, "G": 4, "T": 8,
    "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3,
    "B": 14, "D": 13, "H": 11, "V": 7,
}
IUPAC_LETTERS = "ACGTRYSWKMBDHV"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDB"

# The two bases an ambiguous code stands for when k-mers are
# enumerated.  Three-base codes keep two of their three bases.
AMBIGUOUS_PAIR = {
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "GT", "V": "AC", "D": "AG", "H": "CT",
}

AMBIGUOUS_CLASS = "[RYSWKMBDHV]"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def complement(c: Column | str) -> Column:
    return F.translate(_as_col(c), IUPAC_LETTERS, IUPAC_COMPLEMENT)


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(complement(c))


def iupac_mask(c: Column | str) -> Column:
    """Bit set of the bases a one-letter code can stand for; 0 for other letters."""
    col = F.upper(_as_col(c))
    pos = F.instr(F.lit(IUPAC_LETTERS), col)
    masks = F.array(*[F.lit(IUPAC_MASK[b]) for b in IUPAC_LETTERS])
    return F.when((F.length(col) == 1) & (pos > 0), F.get(masks, pos - 1)).otherwise(F.lit(0))


def iupac_match(q: Column | str, r: Column | str) -> Column:
    """True when the two codes share at least one base."""
    return iupac_mask(q).bitwiseAND(iupac_mask(r)) != 0


def is_ambiguous(c: Column | str) -> Column:
    return _as_col(c).rlike(f"^{AMBIGUOUS_CLASS}$")


def expand_ambiguous(c: Column | str) -> Column:
    """ARRAY<STRING> of the plain bases a code is enumerated as."""
    col = _as_col(c)
    pairs = {k: list(v) for k, v in AMBIGUOUS_PAIR.items()}
    table = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
    return F.coalesce(F.element_at(table, col), F.array(col))


def normalize_reference(c: Column | str) -> Column:
    """Reference letters: upper case, U read as T, anything outside IUPAC read as R.

    N (and any other unknown letter) is kept as the two-base code R, the closest
    canonical code the index stores for it.
    """
    col = F.translate(F.upper(_as_col(c)), "U", "T")
    return F.regexp_replace(col, "[^ACGTRYSWKMBDHV]", "R")


def is_valid_query(c: Column | str) -> Column:
    """False when a byte can never stand for a base (Z, P, gaps, stars, blanks...)."""
    return ~_as_col(c).rlike("[ZzPp\\-*\\s]")


def normalize_query(c: Column | str, ambiguous: str = "A") -> Column:
    """Query letters: upper case ACGT, U read as T.

    ``ambiguous='A'`` reads every other letter as A; ``'reject'`` leaves it, so the
    record fails the ``^[ACGT]*$`` test; ``'break'`` puts N, which no k-mer contains.
    """
    col = F.translate(F.upper(_as_col(c)), "U", "T")
    if ambiguous == "A":
        return F.regexp_replace(col, "[^ACGT]", "A")
    if ambiguous == "break":
        return F.regexp_replace(col, "[^ACGT]", "N")
    if ambiguous == "reject":
        return col
    raise ValueError("ambiguous must be 'A', 'reject' or 'break'")


def text_as_sequence(c: Column | str) -> Column:
    """Read prose as a base sequence, one base for every code point.

    Letters A to Z give their alphabet position modulo four, other printable ASCII characters
    their code modulo four, all others T.
    """
    printable = "".join(map(chr, range(32, 127)))
    bases = "".join("ACGT"[(ord(x.lower()) - ord("a") if x.isalpha() else ord(x)) % 4] for x in printable)
    return F.translate(F.regexp_replace(_as_col(c), "[^ -~]", "T"), printable, bases)


def split_header(h: Column | str) -> tuple[Column, Column]:
    """(name, comment) of a record header; only the ASCII space separates them."""
    trimmed = F.trim(_as_col(h))
    name = F.regexp_extract(trimmed, r"^([^ ]*)", 1)
    comment = F.regexp_extract(trimmed, r"(?s)^[^ ]* (.*)$", 1)
    return name, comment
