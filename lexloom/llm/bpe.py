"""Byte-pair encoding and decoding through a table of distinct words.

1. Each partition cuts its texts into words with their leading blank and keeps the distinct ones.
2. These are dealt by word, so that one task has every occurrence of a word: it encodes the word
   once for the whole corpus, with the tokenizers library.
3. The ids go back by partition, as a table in the shared folder that only the partition's own task
   reads: it joins them with its word positions. Texts are never shuffled, nothing is broadcast.
4. Decoding joins ids with the id-to-piece table of the vocabulary.

What moves are pairs of partition and distinct word, not word positions: 17 million instead of 144
million for 0.5 GB of Parquet. A word that a partition's table lacks (partitions dealt otherwise on the second
reading) is encoded where it is met, so results don't depend on how the texts are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexloom.llm import partition_words as parts
from lexloom.llm.chunk_encoder import ByteLetters, ChunkEncoder, Table, batches, encoder
from lexloom.llm.common import one_thread, with_fields


def _dtype(encoder: ChunkEncoder) -> str:
    return "<u2" if encoder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def partition_words(docs: DataFrame, path: str, kind: str, buckets: int) -> DataFrame:
    """(part, bucket, words): the distinct words of each partition of `docs`, by bucket."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = encoder(path, kind), pa.array([], pa.string())
        for f in batches(frames):
            words = cutter.cut(pc.fill_null(f.column("text"), ""))[1].flatten()
            held = pa.concat_arrays([held, words.dictionary_encode().dictionary]).unique()
            if len(held) >= parts.HELD:
                yield parts.dealt(held, buckets)
                held = held.slice(0, 0)
        if len(held):
            yield parts.dealt(held, buckets)

    return docs.select("text").mapInArrow(run, "part long, bucket long, words string")


def word_ids(docs: DataFrame, path: str, kind: str = "byte") -> str:
    """A folder of the shared folder with (words, ids, lengths) of each partition.

    Every distinct word of the corpus is encoded once, in the task that its bucket falls to.
    """
    buckets = parts.buckets_of(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        enc = ChunkEncoder(path, kind)
        for f in frames:
            words = parts.cut(f.column("words"))
            sizes = pc.add(pc.count_substring(f.column("words"), " "), 1).to_numpy().astype(np.int64)
            coded = words.dictionary_encode()  # a word comes once from each partition that has it
            numbers = enc.numbers(coded.dictionary)[coded.indices.to_numpy()]
            ids, ends = enc.table.spread(numbers)
            yield pa.record_batch({"part": f.column("part"), "words": f.column("words"), "ids": parts.binaries(ids.astype(_dtype(enc)), np.diff(ends[np.cumsum(sizes) - 1], prepend=0)),
                                   "lengths": parts.binaries(enc.table.length[numbers].astype("<u4"), sizes)})

    dealt = partition_words(docs, path, kind, buckets).repartition(buckets, "bucket")
    return parts.saved(dealt.mapInArrow(run, "part long, words string, ids binary, lengths binary"), "word-ids")


def with_table(enc: ChunkEncoder, folder: str) -> ChunkEncoder:
    """`enc` with the table of this task's partition, if there is one."""
    found = parts.own_blocks(folder, ["words", "ids", "lengths"])
    if found is not None:
        words = parts.cut(found["words"])
        ids, lengths = (np.frombuffer(b"".join(found[c].to_pylist()), kind) for c, kind in (("ids", _dtype(enc)), ("lengths", "<u4")))
        enc.table = Table(words, ids.astype(np.uint32), lengths)
        enc.keep += len(words)
    return enc


def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table of a byte-level vocabulary: all pieces' bytes in id order, and offsets."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    letters = ByteLetters()
    byte = {(chr(b) if b in letters.visible else chr(256 + letters.other.index(b))): b for b in range(256)}
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        piece = tokenizer.id_to_token(i) or ""
        out.append(bytes(map(byte.__getitem__, piece)) if all(c in byte for c in piece) else piece.encode())
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in out])))


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """UTF-8 of the text of `ids`: each id's piece, joined by position."""
    data, offset = table
    start, length = offset[ids], offset[ids + 1] - offset[ids]
    ends = np.cumsum(length)
    at = np.repeat(start - (ends - length), length)
    at += np.arange(len(at))
    raw = data[at].tobytes()
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, path: str, kind: str = "byte") -> DataFrame:
    """(doc_id, ids): ids as bytes of little-endian uint32; null text: no ids."""
    folder = word_ids(docs, path, kind)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        enc = with_table(ChunkEncoder(path, kind), folder)
        for f in batches(frames):
            yield pa.record_batch({"doc_id": f.column("doc_id"), "ids": pa.array([x.tobytes() for x in enc.encode(f.column("text"))], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("ids", "binary"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the texts of byte-level ids."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for f in frames:
            texts = [decode(np.frombuffer(x.as_py(), "<u4").astype(np.int64), table).decode() for x in f.column("ids")]
            yield pa.record_batch([*f.columns, pa.array(texts, pa.string())], names=[*f.schema.names, "text"])

    return encoded.mapInArrow(run, with_fields(encoded.schema, text="string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Null texts count as empty: no tokens, the digests of nothing. Null doc_ids stay null. A very
    long text is worked on alone, whole. Repeated rows come out each; other columns are not looked
    at, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    folder = word_ids(docs, path)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        enc, table = with_table(ChunkEncoder(path, "byte"), folder), pieces(path)
        for f in batches(frames):
            ids = enc.encode(f.column("text"))
            yield pa.record_batch({
                "doc_id": f.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x.astype("<u4", copy=False)).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(decode(x.astype(np.int64), table)).hexdigest() for x in ids]})

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.mapInArrow(run, schema)
