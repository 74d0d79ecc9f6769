"""Helpers shared by the training-data operators: shared storage, batches, id folds."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset on a single machine (tests) a folder of this process is made.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return _own_dirs[app]


def files_at(uri: str) -> tuple:
    """(file system, path) of a shared folder, for tasks that read or write files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    return re.sub("^file:/(?!/)", "file:///", files.makeQualified(path).toString())  # tasks that open it need the scheme


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and return a reader of it.

    This cuts lineage: a lost executor costs a re-read, not a recomputation of the stages before.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Called where a task's Python code begins: native libraries keep to the one core Spark gave
    the worker, and what an earlier job left in a reused worker is given back."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    encoders = sys.modules.get("lexloom.llm.chunk_encoder")
    if encoders is not None:
        encoders._loaded.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        gc.collect()
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 3000) -> Iterator[None]:
    """While it lasts, Arrow batches hold `rows` rows at most, since a row may be a long text; a
    smaller setting stays. For jobs that run inside an operator."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def head_threshold(table: DataFrame, most: int) -> int:
    """The least power of two that at most `most` rows reach in `n`, from a histogram of `n`."""
    bins = table.groupBy(F.floor(F.log2("n")).cast("int").alias("bin")).agg(F.count("*").alias("rows")).collect()  # 64 rows at most
    kept, at = 0, 64
    for b in sorted(bins, key=lambda r: -r.bin):
        if kept + b.rows > most:
            break
        kept, at = kept + b.rows, b.bin
    return 1 << min(at, 62)


def with_fields(schema: StructType, **fields: str) -> StructType:
    """A copy of `schema` with more fields (name: type); StructType.add changes its own object."""
    out = StructType(list(schema.fields))
    for name, kind in fields.items():
        out.add(name, kind)
    return out
