"""Mask: soft-mask reads where they align."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.masking import lowercase_intervals, merge_intervals
from ..sources.paf import read_paf


def mask(reads: DataFrame, alns: DataFrame | str, max_gap: int = 0, margin: int = 0) -> DataFrame:
    """``reads(name, seq, ...)`` with aligned stretches in lower case.

    ``alns`` is an alignment table or the path of a PAF file.  Reads without alignments
    pass unchanged; alignments without a read are ignored.  Both sides meet by ``seq_id``
    where they have it, so reads of one name are told apart; PAF text only has names.
    """
    table = read_paf(reads.sparkSession, alns) if isinstance(alns, str) else alns
    if "seq_id" in table.columns and "seq_id" in reads.columns:
        return lowercase_intervals(reads, merge_intervals(table, max_gap, margin, "seq_id"), "seq_id", key="seq_id")
    return lowercase_intervals(reads, merge_intervals(table, max_gap, margin))
