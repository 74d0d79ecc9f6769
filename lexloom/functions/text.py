"""Columns for words, sentences, paragraphs, shingles and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, byte order mark included.
WS = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"
WORD = r"[\p{L}\p{N}]+"
COMPOUND = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
# Where sentences end, and what joins the parts of a compound word (COMPOUND above).
_SENTENCE = rf'(?<=[.!?…]){WS}+(?=[А-ЯA-ZЁ0-9"«])|\n+'
FNV_SEED, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up towards positive infinity, as a double."""
    scale = 10**digits
    return F.floor(x * F.lit(float(scale)) + 0.5).cast("double") / F.lit(float(scale)) if digits else F.floor(x + 0.5).cast("double")


def share(part: Column, whole: Column) -> Column:
    """Per cent with one digit; 0 where there is nothing to share."""
    pct = F.floor(part.cast("double") / whole.cast("double") * 1000 + 0.5).cast("double") / 10
    return F.when(whole > 0, pct).otherwise(F.lit(0.0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def spaced(text: Column) -> Column:
    """The words of a text with a blank between, without making an array of them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def compound_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(COMPOUND), 0)


def sentences(text: Column, letters_only: bool = False) -> Column:
    """Sentences with a letter or digit; `letters_only`: those with a letter, as embedders take them."""
    keep = r"\p{L}" if letters_only else r"[\p{L}\p{N}]"
    return F.filter(F.transform(F.split(text, _SENTENCE), trimmed), lambda s: s.rlike(keep))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"\n{WS}*\n"), trimmed), lambda p: F.length(p) > 0)


def solid_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, WS, ""))


def utf16_units(text: Column) -> Column:
    """Code points to UTF-16 code units: one above U+FFFF becomes its surrogate pair."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    plain = F.exists(codes, lambda c: c > 65535)

    def pair(c: Column) -> Column:
        v = c - 65536
        return F.when(c > 65535, F.array(F.lit(55296) + F.floor(v / 1024), F.lit(56320) + v % 1024)).otherwise(F.array(c))

    return F.when(plain, F.flatten(F.transform(codes, pair))).otherwise(codes)


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bit, over UTF-16 code units, as a long; the empty text gives the seed.

    The definition in SQL; `shingle_hashes` gives the same values for many shingles at once.
    """
    def step(h: Column, unit: Column) -> Column:
        return h.bitwiseXOR(unit) * FNV_PRIME % (MASK + 1)

    def char(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        far = code - 65536
        return F.when(code < 65536, step(h, code)).otherwise(step(step(h, F.lit(55296) + F.shiftright(far, 10)), F.lit(56320) + far % 1024))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_SEED).cast("long"), char)


def fnv_slices(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1a of units[start:end] for each pair, all slices in step, longest first."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, length = start[order], length[order]
    h = np.full(len(at), FNV_SEED, np.uint32)  # wraps where FNV takes the remainder
    units = units.astype(np.uint32)
    for k in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, "left"))
        h[:n] = (h[:n] ^ units[at[:n] + k]) * np.uint32(FNV_PRIME)
    out = np.empty(len(h), np.int64)
    out[order] = h
    return out


def fnv_phrases(texts: list[str], size: int) -> list[np.ndarray]:
    """FNV-1a of each phrase of `size` words, by position; words of a text stand between blanks."""
    out = [np.zeros(0, np.int64)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    units = np.frombuffer(" ".join(texts[i] for i in full).encode("utf-16-le"), "<u2")
    ends = np.flatnonzero(np.append(units, 32) == 32) if full else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = np.array([texts[i].count(" ") + 1 for i in full], np.int64)
    last = np.repeat(np.cumsum(count), count)
    first = np.flatnonzero(np.arange(len(ends)) + size <= last)
    hashes = fnv_slices(units, starts[first], ends[first + size - 1])
    cuts = np.cumsum(np.maximum(count - size + 1, 0))
    for i, part in zip(full, np.split(hashes, cuts[:-1]) if full else [], strict=True):
        out[i] = part
    return out


def shingle_hashes(found: Column, size: int = 5) -> Column:
    """FNV-1a of each phrase of `size` words, from the words, in numpy, many documents at once."""
    return phrase_hashes(F.array_join(found, " "), size)


def phrase_hashes(texts: Column, size: int = 5) -> Column:
    """The same from words with a blank between."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        done: list[np.ndarray] = []
        for some in batches([t or "" for t in texts.to_pylist()], 100_000):
            done += fnv_phrases(some, size)
        return lists(done)

    return run(texts)


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list of longs for each array."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def batches(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def starts(gaps: Column, hits: Column) -> Column:
    """Where each match begins, from the lengths of what stands before each and of the matches, in turn;
    both arrays of a row are of one size. Nothing is shuffled."""
    @F.arrow_udf("array<bigint>")
    def run(gaps: pa.Array, hits: pa.Array) -> pa.Array:
        own = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + own)
        offsets = hits.offsets.to_numpy() - hits.offsets[0].as_py()
        before = np.concatenate(([0], ends))[offsets[:-1]]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends - own - np.repeat(before, np.diff(offsets)), pa.int64()))

    return run(gaps, hits)


def hex8(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def shingles(found: Column, size: int = 5) -> Column:
    """Phrases of `size` words, one for each position; none from fewer words."""
    def of(w: Column) -> Column:  # bound once, or the words would be cut anew for each position
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) >= size, windows).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(found), of))


def chunk_count(n: Column, size: int = 20, step: int = 10) -> Column:
    """Windows of `size` with stride `step` until one reaches the end of n entries."""
    more = F.ceil((n - size) / F.lit(float(step))).cast("int") + 1
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(more)
