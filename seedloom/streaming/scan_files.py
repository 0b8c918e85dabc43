"""Bounded batches of query files, scanned as they arrive.

A file stream delivers new query tables; each micro-batch is scanned like any other
DataFrame and its PAF rows are written under the batch number, so a batch that is
retried after a failure overwrites itself instead of appearing twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index
from ..plans.scan import scan_with_rejects
from ..sources.paf import write_paf

QUERY_SCHEMA = "seq_id long, name string, seq string"


def query_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of Parquet query tables ``(seq_id, name, seq)`` appearing in ``folder``."""
    reader = spark.readStream.schema(QUERY_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def scan_stream(queries: DataFrame, index: Index, out: str, state: str, **scan_options) -> StreamingQuery:
    """Start scanning what is there and stop when it is done (``availableNow``).

    ``out`` receives one folder of PAF text per batch, and ``out``.rejected one with the ids and names of the
    queries that cannot be read; ``state`` is the stream's own checkpoint folder on shared storage.
    """

    def drain(batch: DataFrame, number: int) -> None:
        found, rejects = scan_with_rejects(batch, index, **scan_options)
        part = f"batch={number:08d}"
        write_paf(found, os.path.join(out, part), mode="overwrite")
        rejects.write.mode("overwrite").csv(os.path.join(f"{out.rstrip('/')}.rejected", part), sep="\t")

    return (
        queries.writeStream.foreachBatch(drain).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
