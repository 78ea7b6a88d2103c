"""Session helpers shared by every operator: worker imports and durable lineage cuts."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Only used where one machine runs everything and no shared folder is named (tests, laptops).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of a batch that goes to or comes from a Python worker, where the session leaves Spark's default of 64 MB: a task holds
#: several batches outside its heap.
BATCH, BATCH_BYTES, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20), "67108864b"
#: Stored tables are compressed, so a table of the size that Spark broadcasts by default would be many times as large in the driver.
PACKED, PACKED_TIMES, PLAIN = "spark.sql.sources.fileCompressionFactor", "8.0", "1.0"
#: A generated method above 8,000 bytes of code is never compiled by the JVM and runs many times slower than operators one by one;
#: Spark's default lets it be.
HUGE, HUGE_BYTES, HUGE_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "8000", "65535"
_open: ContextVar[list | None] = ContextVar("open", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, keep their batches small, and size stored tables by what they hold."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    if spark.conf.get(PACKED, PLAIN) == PLAIN:
        spark.conf.set(PACKED, PACKED_TIMES)
    if spark.conf.get(HUGE, HUGE_DEFAULT) == HUGE_DEFAULT:
        spark.conf.set(HUGE, HUGE_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. On a cluster it must be named: a machine's own folder would lose rows."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return LOCAL_CHECKPOINTS
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared checkpoint folder and go on from its files.

    The files are columnar and compressed, so they take less than a checkpoint of rows; and as they are shared, a lost
    executor costs a re-read, not a recomputation. They stay, as checkpoints do, until ``release``, the end of ``scratch``
    or the cluster's own cleaning removes them.
    """
    spark = prepare(df.sparkSession)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    if (tables := _open.get()) is not None:
        tables.append(out)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t._table)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables materialised inside go at the end: for a job whose result is written by then."""
    token = _open.set([])
    try:
        yield
    finally:
        release(*_open.get())
        _open.reset(token)
