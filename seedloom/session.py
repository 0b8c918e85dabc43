"""Session helpers: settings the plans rely on, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, memory: str = "16g", app: str = "seedloom") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    It is the cluster's (``spark.checkpoint.dir``); only a session that has none, as in tests, gets
    one of its own.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if not folder:
            folder = tempfile.mkdtemp(prefix="seedloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, as Parquet, which is a fraction of the size: for what is used more than once."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_arrow_batches(spark: SparkSession, limit: int = 64 << 20) -> None:
    """Bound Arrow batches by bytes too: extension rows carry stretches of sequence."""
    now = spark.conf.get(ARROW_BYTES) or ""
    # a value in plain bytes that is small enough, or one the user wrote with a unit, stays
    plain = now.removesuffix("b")
    if not now or (plain.isdigit() and int(plain) > limit):
        spark.conf.set(ARROW_BYTES, str(limit))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; a table that arrives in too few splits is spread over the cores.

    A large table has more splits than cores and is left as it is, without a shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
