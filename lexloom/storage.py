"""Tables that a job leaves for the next one, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset on a single machine (tests) a
    folder of this process is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return _own[app]


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as a table in the shared folder and read again; removed when the application ends.

    This cuts lineage: what made the rows runs once, and a lost executor costs a re-read.
    """
    path = f"{shared_folder(df.sparkSession)}/lexloom-{name}-{uuid.uuid4().hex}"
    files, p = hadoop_path(df.sparkSession, path)
    files.deleteOnExit(p)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """While it lasts, the session has `key` set to `value`."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """While it lasts, Arrow batches hold `rows` rows at most; for jobs whose rows are large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)
