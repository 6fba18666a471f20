"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_here = threading.local()


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint directory; a temporary one only in local mode where none is set, as in tests.

    On a cluster a machine's own folder would be seen by that machine alone, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    have = spark._jsc.sc().getCheckpointDir()
    if not found and have.isDefined():
        found = have.get()
    if not found:
        if not spark._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tacet-"))
        found = spark._jsc.sc().getCheckpointDir().get()
    return found


def keep(df: DataFrame) -> DataFrame:
    """df, written and read back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/tacet-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    if getattr(_here, "made", None) is not None:
        _here.made.append((path, out))
    return out


@contextmanager
def scratch() -> Iterator[list[tuple[str, DataFrame]]]:
    """Lists (path, table) of what keep writes in the block, in this thread alone, so that what is not needed later can be released."""
    outer, made = getattr(_here, "made", None), []
    _here.made = made
    try:
        yield made
    finally:
        _here.made = outer
        if outer is not None:
            outer += made


def spread(scan: DataFrame) -> DataFrame:
    """A scan that Spark would read in fewer tasks than there are cores, dealt out to all of them for the work on its rows."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def kept_tables() -> list[str]:
    """Paths of the tables that keep has written and nothing has released, oldest first."""
    return [path for _, path in _written]


def release(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Deletes tables that keep has written, for when the results made from them have been read or written.

    Nothing is deleted that ``reader`` still reads from.
    """
    files = reader.inputFiles() if reader is not None else []
    gone = {p for p in paths if not any(p.rsplit("/", 1)[-1] in f for f in files)}
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [w for w in _written if w[1] not in gone]


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """df with the place of each row in the order, from 1: a range partitioning, then counts per partition, no single task.

    The rows are written once. Rows that the order does not tell apart have places of their own, in no set order.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    local = keep(dealt.withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    rows, before = [], 0
    for pid, n in sorted(local.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per partition
        rows.append((pid, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(rows, "_pid int, _before bigint"))
    return local.join(starts, "_pid").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_pid", "_at", "_before")
