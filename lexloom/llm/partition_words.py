"""Corpus-wide values of words, handed back to each partition of the texts.

Each partition's distinct words are dealt by a hash of the word, so one task has every partition
that holds a word and works out the word's value once. The values go back as a table in the shared
folder, under part=<number>, that only the partition's own task reads. So pairs of partition and
distinct word move, never word positions or texts, and nothing that grows is broadcast.

Words of a block travel as one text with blanks between, which no word holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.common import files_at, new_path

#: Distinct words that a task holds at most before it passes them on.
HELD = 2_000_000
#: Random factors of a word's bytes by their place, the last one for all places beyond.
_FACTORS = np.random.default_rng(1).integers(1, 1 << 62, 64, np.uint64) | np.uint64(1)


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_view(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, length) of the words."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """A number below `buckets` for each word, from its bytes alone."""
    data, start, length = byte_view(words)
    place = np.minimum(np.arange(len(data)) - np.repeat(start, length), len(_FACTORS) - 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _FACTORS[place])))
    h = total[start + length] - total[start]
    return ((h ^ h >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)


def joined(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Texts of `sizes` words each, blanks between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), words), " ")


def cut(blocks: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The words of all blocks, one after the other."""
    parts = [pc.split_pattern(x, " ").flatten() for x in (blocks.chunks if isinstance(blocks, pa.ChunkedArray) else [blocks])]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that hold `sizes` of `values` each."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def dealt(words: pa.Array, buckets: int, values: np.ndarray | None = None) -> pa.RecordBatch:
    """(part, bucket, words[, n]) of this task's partition for its distinct words [and their values]."""
    from pyspark import TaskContext

    at = bucket(words, buckets)
    order = np.argsort(at, kind="stable")
    size = np.bincount(at, minlength=buckets)
    some = np.flatnonzero(size)
    out = {"part": pa.array(np.full(len(some), TaskContext.get().partitionId()), pa.int64()), "bucket": pa.array(some, pa.int64()), "words": joined(words.take(pa.array(order)), size[some])}
    if values is not None:
        out["n"] = binaries(values[order], size[some])
    return pa.record_batch(out)


def saved(blocks: DataFrame, name: str) -> str:
    """The folder that `blocks`, which have a column part, are stored in by part."""
    folder = new_path(blocks.sparkSession, name)
    blocks.repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(folder)
    return folder


def stored_for(folder: str, part: int) -> bool:
    from pyarrow.fs import FileType

    files, base = files_at(f"{folder}/part={part}")
    return files.get_file_info(base).type != FileType.NotFound


def stored_batches(folder: str, part: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """What is stored for a part, batch by batch; nothing where there is none."""
    from pyarrow import dataset

    if stored_for(folder, part):
        files, base = files_at(f"{folder}/part={part}")
        yield from dataset.dataset(base, filesystem=files, format="parquet").to_batches(columns=columns)


def own_blocks(folder: str, columns: list[str]) -> pa.Table | None:
    """What is stored for this task's partition; None where there is nothing."""
    from pyspark import TaskContext

    found = list(stored_batches(folder, TaskContext.get().partitionId(), columns))
    return pa.Table.from_batches(found) if found else None
