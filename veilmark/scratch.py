"""Tables that outlive lost executors: written to the folder that the cluster shares, and read back."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of this machine only where all tasks run on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = f"file://{tempfile.gettempdir()}/veilmark-{os.getpid()}"
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


#: Tables kept since a with_tables began.
_mine: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def with_tables(spark: SparkSession):
    """Drops the tables that are kept inside, at the end: for work whose results are written before."""
    paths: list[str] = []
    before = _mine.set(paths)
    try:
        yield
    finally:
        _mine.reset(before)
        for path in paths:
            drop(spark, path)


def _noted(path: str) -> str:
    if (paths := _mine.get()) is not None:
        paths.append(path)
    return path


def keep(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (or a folder under it) and read it back: lineage is cut, and no executor's
    loss undoes the work."""
    spark = df.sparkSession
    path = _noted(f"{under or scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A folder for tables that are dropped together."""
    return _noted(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder once tables kept elsewhere hold all that was made of it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows that one task may have without a look at how they lie.
FEW = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by a key of no equal values to all cores if its rows lie in a few tasks, as those of a small file or of one
    large row group do: work in Python takes as long as the largest task.  Rows are counted for it, without their columns."""
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    rows, most = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, key) if most > max(FEW, 1.5 * rows / cores) else df


#: Rows and bytes of text that Python gets at once.
BATCH, BATCH_BYTES = 1000, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds what each of a task's Python workers holds, whatever the size of the table: the session's batches are made
    smaller, never larger."""
    conf = spark.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
