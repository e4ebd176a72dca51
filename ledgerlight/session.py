"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ROWS_A_TASK = 100_000
_WRITTEN: list[str] = []  # tables that cut_lineage has written and nobody has removed


def build_session(app: str = "ledgerlight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and no web UI.

    ``master`` stays unset on a cluster, where spark-submit provides it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``DataFrame.checkpoint``: the cluster's shared one when it names one.

    A folder of our own is made only where ``spark.checkpoint.dir`` is unset, and only for
    a local master, whose tasks all see the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, into: SparkSession | None = None) -> DataFrame:
    """The same rows read back from a table written beside the checkpoints, by ``into`` if another session is to read.

    For loops whose result feeds the next round. Besides the lineage it also resets the size
    estimate, which would otherwise grow with every join of every round.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return (into or df.sparkSession).read.schema(df.schema).parquet(path)


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the tables that operators wrote inside the block to cut lineage.

    Results that read them must have been written elsewhere by then. Without it they stay beside the checkpoints, several
    times the size of the input after a long job.
    """
    before = len(_WRITTEN)
    try:
        yield
    finally:
        mine = _WRITTEN[before:]
        del _WRITTEN[before:]
        for path in mine:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The same rows, out of a shuffle, in tasks of about ``ROWS_A_TASK`` of at most ``rows`` rows, one a slot at least.

    For loops over tables that have become small, where hundreds of near-empty tasks a step would take the time and
    adaptive execution may be set not to merge them. A table large enough for the session's partitions keeps them.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly if the input has fewer partitions than there are slots for tasks.

    A small file is one or two pieces of work however many cores are free. A larger input is left as it lies: moving
    it would cost more than it brings.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
