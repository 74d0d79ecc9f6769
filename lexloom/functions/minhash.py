"""MinHash signatures of shingle windows, and their bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import FNV_PRIME, FNV_SEED, MASK, fnv1a, lists

PRIME = 2**31 - 1
# Multiplier and increment of the 32-bit generator, seeds of both coefficient lists.
_LCG, SEED_A, SEED_B = (1103515245, 12345), 42, 2024


def coefficients(n: int, seed: int) -> list[int]:
    out, state = [], seed
    for _ in range(n):
        state = (state * _LCG[0] + _LCG[1]) % 2**32
        out.append(state % (PRIME - 1) + 1)
    return out


def signature(hashes: Column, n: int = 64) -> Column:
    """The definition in SQL: slot i holds the least (a_i * h + b_i) mod PRIME over the hashes."""
    a, b = (F.array(*(F.lit(v).cast("long") for v in coefficients(n, s))) for s in (SEED_A, SEED_B))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(
        F.array_min(F.transform(hashes, lambda h: (F.get(a, i) * h + F.get(b, i)) % PRIME)), F.lit(PRIME).cast("long")))


class Windows:
    """All windows of `size` hashes with stride `step` of an Arrow column of hash lists."""

    def __init__(self, hashes: pa.Array, size: int, step: int, n: int):
        length = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
        self.count = np.where(length == 0, 0, np.where(length <= size, 1, -(-(length - size) // step) + 1))
        base, before = np.cumsum(length) - length, np.cumsum(self.count) - self.count
        self.start = np.repeat(base, self.count) + step * (np.arange(self.count.sum()) - np.repeat(before, self.count))
        self.end = np.minimum(self.start + size, np.repeat(base + length, self.count))
        self.a, self.b = (np.array(coefficients(n, s), np.uint64)[:, None] for s in (SEED_A, SEED_B))

    def minima(self, at_once: int = 4096) -> Iterator[np.ndarray]:
        """Signatures, a row for each window, some windows at a time."""
        for s in range(0, len(self.start), at_once):
            lo, hi = self.start[s : s + at_once], self.end[s : s + at_once]
            v = (self.a * self.flat[None, lo[0] : hi[-1]] + self.b) % np.uint64(PRIME)
            v = np.concatenate((v, v[:, :1]), 1)  # an end may be that of the array
            yield np.minimum.reduceat(v, np.stack((lo, hi), 1).ravel() - lo[0], axis=1)[:, ::2].T.astype(np.int64)


def window_signatures(hashes: Column, size: int = 20, step: int = 10, n: int = 64) -> Column:
    """Signatures of all windows of a document's hashes, in numpy, many documents at once.

    Same values as `signature`.
    """

    @F.arrow_udf("array<array<bigint>>")
    def run(column: pa.Array) -> pa.Array:
        windows = Windows(column, size, step, n)
        values = pa.array(np.concatenate([np.zeros((0, n), np.int64), *windows.minima()]).ravel())
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(windows.start) + 1) * n, pa.int32()), values)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(windows.count))), pa.int32()), each)

    return run(hashes)


def fnv_numbers(numbers: np.ndarray) -> np.ndarray:
    """FNV-1a of each row of numbers below 2**31, written in decimals with colons between."""
    h = np.full(len(numbers), FNV_SEED, np.uint32)
    for k in range(numbers.shape[1]):
        if k:
            h = (h ^ np.uint32(ord(":"))) * np.uint32(FNV_PRIME)
        x = numbers[:, k].astype(np.uint32)
        for place in range(9, -1, -1):
            ten = np.uint32(10**place)
            step = (h ^ (x // ten % np.uint32(10) + np.uint32(48))) * np.uint32(FNV_PRIME)
            h = np.where((x >= ten) | (place == 0), step, h)
    return h.astype(np.int64)


def band_buckets(sig: Column, bands: int = 16, n: int = 64) -> Column:
    """An array of (band, bucket) for a signature."""
    rows = n // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(
        k.alias("band"), fnv1a(F.array_join(F.transform(F.slice(sig, k * rows + 1, rows), lambda v: v.cast("string")), ":")).alias("bucket")))


def document_buckets(hashes: Column, size: int = 20, step: int = 10, n: int = 64, bands: int = 16) -> Column:
    """The distinct (band, bucket) of all windows of a document's hashes, in numpy.

    Same values as `band_buckets` of each window's `signature`.
    """
    rows = n // bands

    @F.arrow_udf("array<bigint>")
    def run(column: pa.Array) -> pa.Array:
        windows = Windows(column, size, step, n)
        found = [fnv_numbers(m.reshape(-1, rows)).reshape(-1, bands) | (np.arange(bands, dtype=np.int64) << 32) for m in windows.minima()]
        every = np.concatenate([np.zeros((0, bands), np.int64), *found])
        return lists([np.unique(x) for x in np.split(every, np.cumsum(windows.count)[:-1])])

    return F.transform(run(hashes), lambda k: F.struct(F.shiftright(k, 32).alias("band"), k.bitwiseAND(MASK).alias("bucket")))
