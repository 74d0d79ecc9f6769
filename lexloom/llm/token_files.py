"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their frequency rank in the corpus, so common ones take one byte. Lengths (1 to
4 bytes) stand apart as two bits each in control bytes, four to a byte; decoding looks each control
byte up in a table of lengths and fills a byte matrix through a mask.

A folder holds `ids.bin` (the id of each rank) and a file per range of doc_id. A file is a run of
blocks: a header of four uint64 (documents, tokens, control bytes, data bytes), the doc_ids as
int64, one byte each that is 1 for a null doc_id, the documents' token counts as uint32, all
control bytes, all data bytes. Each document's control bytes start anew.

Scale: texts are encoded once and never shuffled; coded ids are range-partitioned by doc_id. Only
the rank table (the vocabulary's size) and one row per file reach the driver or are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.chunk_encoder import batches, encoder
from lexloom.llm.common import files_at, new_path, small_batches, stored
from lexloom.llm.partition_words import binaries

#: Id appended to each document.
END = 2
#: Tokens of a file, about.
PER_FILE = 16_000_000
#: Files whose starts are summed together.
GROUP = 4096
#: Tokens of a block, about; a document is never cut.
PER_BLOCK = 500_000
#: Bytes of each of the four values of a control byte.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_ids(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of documents that have `counts` uint32 values each, one after the
    other, and the bytes of both that each document takes."""
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    controls = -(-counts // 4)
    code = np.zeros(4 * int(controls.sum()), np.uint8)
    code[np.arange(len(values)) + np.repeat(4 * (np.cumsum(controls) - controls) - (np.cumsum(counts) - counts), counts)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[np.cumsum(counts)]
    return control, data, controls, np.diff(ends, prepend=0)


def decode_ids(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of documents that have `counts` values each, one after the other."""
    slots = -(-counts // 4) * 4
    first = np.cumsum(slots) - slots
    at = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    size = LENGTHS[control].reshape(-1)[at]
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4) < size[:, None]] = data
    return out.view("<u4").ravel()


def write_block(out, ids: list[int | None], counts: list[int], control: list[bytes], data: list[bytes]) -> None:
    control, data = b"".join(control), b"".join(data)
    out.write(np.array([len(ids), sum(counts), len(control), len(data)], "<u8").tobytes())
    out.write(np.array([0 if i is None else i for i in ids], "<i8").tobytes())
    out.write(np.array([i is None for i in ids], np.uint8).tobytes())
    out.write(np.array(counts, "<u4").tobytes())
    out.write(control)
    out.write(data)


def read_blocks(content) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, token counts, ranks) of each block."""
    at = 0

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(content, kind, n, at)
        at += a.nbytes
        return a

    while at < len(content):
        docs, _, n_control, n_data = (int(x) for x in take(4, "<u8"))
        ids, null, counts = take(docs, "<i8"), take(docs, np.uint8), take(docs, "<u4").astype(np.int64)
        ranks = decode_ids(take(n_control, np.uint8), take(n_data, np.uint8), counts)
        yield [None if z else int(i) for i, z in zip(ids, null, strict=True)], counts, ranks


def _values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of binaries, how many of them are in each)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    width = np.dtype(dtype).itemsize
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if raw is not None else np.zeros(0, dtype)), np.diff(offsets) // width


def write(docs: DataFrame, path: str, folder: str, end: int = END, kind: str = "word", per_file: int = PER_FILE) -> DataFrame:
    """Write all documents to `folder`, a new folder that driver and executors share; rows
    (shard, n_docs, n_tokens) of the files. A task that runs again replaces its file whole."""
    spark = docs.sparkSession

    def tokens(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's ids, in two bytes each where they fit, and a last row with the task's counts."""
        enc = encoder(path, kind)
        n = np.zeros(max(end + 1, enc.tokenizer.get_vocab_size(with_added_tokens=True)), np.int64)
        width = "<u2" if len(n) <= 1 << 16 else "<u4"
        key = None
        for f in batches(frames):
            key = f.column("doc_id").type
            found = enc.encode(f.column("text"))
            ids = np.concatenate([x for a in found for x in (a, [end])]).astype(width)
            n += np.bincount(ids, minlength=len(n))
            blobs = binaries(ids, np.array([len(a) + 1 for a in found]))
            yield pa.record_batch({"doc_id": f.column("doc_id"), "ids": blobs, "width": pa.array(np.full(len(found), ids.itemsize), pa.int32()), "counts": pa.nulls(len(found), pa.binary())})
        if key is not None:
            at = np.flatnonzero(n)
            yield pa.record_batch({"doc_id": pa.nulls(1, key), "ids": pa.nulls(1, pa.binary()), "width": pa.array([0], pa.int32()), "counts": pa.array([np.stack((at, n[at])).astype("<i8").tobytes()], pa.binary())})

    schema = docs.select("doc_id").schema.add("ids", "binary").add("width", "integer").add("counts", "binary")
    with small_batches(spark):
        encoded = stored(docs.select("doc_id", "text").mapInArrow(tokens, schema), "token-ids")

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for x in f.column("counts"):
                ids, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.record_batch({"id": pa.array(ids), "n": pa.array(n)})

    counts = encoded.select("counts").filter("counts is not null").mapInArrow(count, "id long, n long")  # the vocabulary at most, of each task
    counted = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counted.sort(key=lambda r: (-r.n, r.id))
    id_of = np.array([r.id for r in counted], "<u4")
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 0, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    files, base = files_at(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/ids.bin") as out:
        out.write(id_of.tobytes())
    ranks = spark.sparkContext.broadcast(rank_of)
    total = sum(r.n for r in counted)

    def code(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for f in batches([whole], "ids"):
                ids, n = _values(f.column("ids"), f"<u{f.column('width')[0].as_py()}")
                control, data, controls, sizes = encode_ids(ranks.value[ids], n)
                yield pa.record_batch({"doc_id": f.column("doc_id"), "n": pa.array(n, pa.int32()), "control": binaries(control, controls), "data": binaries(data, sizes)})

    coded = encoded.filter("counts is null").select("doc_id", "ids", "width").mapInArrow(code, docs.select("doc_id").schema.add("n", "integer").add("control", "binary").add("data", "binary"))
    shards = max(1, -(-total // per_file))
    ordered = coded.repartitionByRange(shards, "doc_id", "n", F.crc32("data")).sortWithinPartitions("doc_id", "n", F.crc32("data"), "data")

    def save(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = files_at(folder)
        name = f"{base}/shard-{task.partitionId():09d}.bin"
        draft = f"{base}/_draft-{task.partitionId():09d}-{task.taskAttemptId()}"
        n_docs = n_tokens = 0
        out, held, size = None, ([], [], [], []), 0
        for f in frames:
            for row in zip(*(f.column(c).to_pylist() for c in ("doc_id", "n", "control", "data")), strict=True):
                out = out or files.open_output_stream(draft)
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                size += row[1]
                n_docs, n_tokens = n_docs + 1, n_tokens + row[1]
                if size >= PER_BLOCK:
                    write_block(out, *held)
                    held, size = ([], [], [], []), 0
        if out is not None:
            if held[0]:
                write_block(out, *held)
            out.close()
            files.move(draft, name)
            yield pa.record_batch({"shard": pa.array([task.partitionId()], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    return stored(ordered.mapInArrow(save, "shard long, n_docs long, n_tokens long"), "token-shards")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids) from the files, ids as bytes of little-endian uint32."""
    id_of = np.frombuffer(bytes(spark.read.format("binaryFile").load(f"{folder}/ids.bin").select("content").first()[0]), "<u4")
    table = spark.sparkContext.broadcast(id_of)

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for shard, content in zip(f.column("shard").to_pylist(), f.column("content"), strict=True):
                before = 0
                for ids, counts, ranks in read_blocks(content.as_buffer()):
                    ends = np.cumsum(counts)
                    yield pa.record_batch({
                        "shard": pa.array(np.full(len(ids), shard), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "local": pa.array(before + ends - counts, pa.int64()),
                        "ids": binaries(table.value[ranks].astype("<u4"), counts)})
                    before += int(ends[-1])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    found = found.select(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"), "content")
    decoded = found.mapInArrow(rows, "shard long, doc_id long, local long, ids binary")
    return decoded.join(starts(shards), "shard").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "ids")


def starts(shards: DataFrame) -> DataFrame:
    """(shard, first): the ids of all files before. Files are summed in groups, then within each,
    so that no task has to order all of them."""
    grouped = shards.withColumn("of", F.floor(F.col("shard") / GROUP))
    groups = grouped.groupBy("of").agg(F.sum("n_tokens").alias("n"))  # a row for each GROUP files
    before = groups.select("of", (F.sum("n").over(W.orderBy("of")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("of").orderBy("shard")) - F.col("n_tokens")
    return grouped.select("shard", "of", own.alias("own")).join(before, "of").select("shard", (F.col("own") + F.col("before")).alias("first"))


def digest(docs: DataFrame, path: str, end: int = END, folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from the files.

    Null texts count as empty: they hold the end id alone. A very long text is one document of one
    block, never cut. Null doc_ids come first; documents that repeat a doc_id stand in the order of
    their length and coded ids, and may go over from one file to the next. Other columns are not
    looked at, whatever their names. An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    shards = write(docs, path, folder, end)
    if shards.isEmpty():
        return shards.select(F.col("shard").alias("doc_id"), F.col("n_docs").alias("start"), "n_tokens", F.col("shard").alias("ids_crc32"))
    back = read(spark, folder, shards)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
