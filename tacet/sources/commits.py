"""Appending to a table once per batch: numbered commits, so that replays and second writers neither double nor renumber rows.

A table at a path has ``rows`` (Parquet, a folder per attempt) and ``log`` (a small JSON file per commit, numbered on). Only
rows of an attempt that the log names belong to the table: what a failed writer left is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.sources.shared import numbered

LOG = "version bigint, batch string, attempt string, first bigint, rows bigint"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def log(spark: SparkSession, path: str) -> DataFrame:
    """(version, batch, attempt, first, rows) of the commits of the table at path."""
    p, fs = _path(spark, f"{path}/log")
    if not fs.exists(p):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{path}/log")


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows, with seq, a running number over all commits; None before the first commit."""
    p, fs = _path(spark, f"{path}/log")
    if not fs.exists(p):
        return None
    done = log(spark, path).where("rows > 0")
    if not done.limit(1).count():
        return None
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(done.select("attempt", "first"), "attempt").withColumn("seq", F.col("first") + F.col("place")).drop("attempt", "first", "place")


def _claim(spark: SparkSession, path: str, version: int, entry: str) -> bool:
    """Writes the log's file of a version, unless there is one: by a rename that does not overwrite."""
    jvm = spark._jvm
    draft, fs = _path(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    target, _ = _path(spark, f"{path}/log/{version:020d}.json")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(entry.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        fs.delete(draft, False)
        return False
    return True


def commit(spark: SparkSession, path: str, batch: str, rows: Callable[[DataFrame | None], DataFrame], order: list[str] | None = None, tries: int = 20) -> bool:
    """Appends rows(what the table has) as one commit named ``batch``; False if that batch has been committed before.

    The rows are numbered on from those of the last commit, in the given order, or else in that of all their columns. If
    another writer commits in between, the rows are made again from the table as it is then. On file systems whose rename
    checks and moves in one step (HDFS does) two writers never get one version; on others let one process write at a time.
    """
    for _ in range(tries):
        done = log(spark, path).select("version", "batch", (F.col("first") + F.col("rows")).alias("next"))
        if done.where(F.col("batch") == batch).limit(1).count():
            return False
        version, first = done.agg(F.coalesce(F.max("version"), F.lit(0)), F.coalesce(F.max("next"), F.lit(0))).first()
        attempt = uuid.uuid4().hex
        new = rows(table(spark, path))
        new = numbered(new, *(order or new.columns), name="place")
        new.write.parquet(f"{path}/rows/attempt={attempt}")
        n = spark.read.parquet(f"{path}/rows/attempt={attempt}").count()
        entry = spark.createDataFrame([(version + 1, batch, attempt, first, n)], LOG).toJSON().first()
        if _claim(spark, path, version + 1, entry):
            return True
    raise RuntimeError(f"{batch} could not be committed to {path}: other writers were faster {tries} times")
