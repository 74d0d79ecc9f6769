"""Packing documents into fixed windows by minimum bin slack.

Each document's ids (with its end id) are cut into full windows, which are sequences of their own,
and a remainder. The remainders' lengths form a histogram of fewer than WINDOW entries. On it a
bitset subset-sum programme finds the multiset of lengths that fills a window closest to capacity,
steps back through its layers for the counts, and the pattern is used as often as the histogram
allows; then again, until nothing is left. Every use of a pattern exhausts a length or a pattern's
counts, so the plan stays a few thousand rows, whatever the number of documents.

A piece finds its place by its rank among the remainders of its length. Ranks are counted in salted
groups, so a length that many copies share isn't one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.chunk_encoder import batches, encoder
from lexloom.llm.common import small_batches, stored, with_fields

#: Tokens of a sequence at most.
WINDOW = 2048
#: Id that ends a document.
END = 1
#: Groups that the remainders of a length are ranked in.
SALTS = 64
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, end: int = END, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and the remainder of each document."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte")
        for f in batches(frames):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(enc.encode(f.column("text"))):
                data = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                rows += [(k, at, min(window, len(data) - at), zlib.crc32(data[at : at + window]), len(data)) for at in range(0, len(data), window)]
            k, *columns = zip(*rows, strict=True)
            yield pa.record_batch([f.column("doc_id").take(pa.array(k)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = docs.select("doc_id").schema
    for x in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(x, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_multiset(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths with their counts whose sum is as near below `capacity` as the counts allow.

    The largest length left is always taken (its windows are the hardest to fill). Layers of
    reachable sums are integers used as bitsets; a count c becomes binary parts 1, 2, 4, ... so a
    layer is one shift. The walk back reads from the layers which parts were used.
    """
    largest = int(np.flatnonzero(counts)[-1])
    room = capacity - largest
    mask = (1 << (room + 1)) - 1
    layers, parts, reach = [], [], 1
    for length in np.flatnonzero(counts)[::-1]:
        length = int(length)
        if length > room:
            continue
        left = min(int(counts[length]) - (length == largest), room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            layers.append(reach)
            parts.append((length, take))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    found = {largest: 1}
    for before, (length, take) in zip(reversed(layers), reversed(parts), strict=True):
        if not before >> total & 1:
            total -= length * take
            found[length] = found.get(length, 0) + take
    return found


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks, first sequence, uses in a sequence, offset in it); sequences."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    given, rows, sequences = np.zeros(capacity + 1, np.int64), [], 0
    while counts.any():
        pattern = best_multiset(counts, capacity)
        times = min(int(counts[length]) // uses for length, uses in pattern.items())
        offset = 0
        for length, uses in sorted(pattern.items(), reverse=True):
            rows.append((length, int(given[length]), times * uses, sequences, uses, offset))
            given[length] += times * uses
            counts[length] -= times * uses
            offset += length * uses
        sequences += times
    return rows, sequences


def ranked(rest: DataFrame) -> DataFrame:
    """`rest` with rank: 0, 1, ... among the rows of its length, counted in SALTS groups a length."""
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # WINDOW * SALTS rows at most
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "ids_crc32", "doc_tokens")) - 1
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, path: str, end: int = END, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are one piece of the end id; null doc_ids stay null. A very long text is
    as many full windows as it fills, and a remainder. Repeated rows are packed each; which of equal
    pieces takes which place is left open. Other columns are not looked at, whatever their names.
    Sequences of the remainders come first, then the full windows. Windows stay `window` long: one
    that ends at a smaller power of two needs no padding, but the fullest multiset wastes less.
    An empty table gives no pieces.
    """
    with small_batches(docs.sparkSession):
        pieces = stored(cut(docs, path, end, window), "pieces")
    rest = pieces.filter(F.col("length") < window)
    sizes = {r.length: r.n for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # under WINDOW rows
    rows, first_full = plan(sizes, window)
    spark = docs.sparkSession
    lookup: dict[int, list] = {}
    for length, *row in rows:
        lookup.setdefault(length, []).append(row)
    table = {length: np.array(v, np.int64) for length, v in lookup.items()}
    shared = spark.sparkContext.broadcast(table)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            sequence, offset = np.zeros(f.num_rows, np.int64), np.zeros(f.num_rows, np.int64)
            length, rank = f.column("length").to_numpy(), f.column("rank").to_numpy()
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                p = shared.value[int(value)]
                row = p[np.searchsorted(p[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 3]
                offset[at] = row[:, 4] + k % row[:, 3] * value
            yield pa.record_batch([*(f.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    columns = pieces.columns
    schema = with_fields(pieces.schema, sequence_id="long", offset="long")
    placed = ranked(rest).select(*columns, "rank").mapInArrow(place, schema)
    full = pieces.filter(F.col("length") == window)
    # numbered by partition: their places within the table are dense after the partitions' sizes are summed
    part = full.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(WINDOW)))
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).drop("n")  # WINDOW rows at most
    own = F.row_number().over(W.partitionBy("part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    numbered = part.withColumn("own", own).join(before, "part").select(
        *columns, (F.lit(first_full) + F.col("own") + F.col("before")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(numbered)
