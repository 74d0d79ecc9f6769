"""Many phrases found in many texts in one pass: an Aho-Corasick automaton in flat arrays.

States are numbered level by level, so the keys (state, character) of all edges are one sorted array
and the state behind an edge is its place in it. A batch of texts goes through the automaton in step,
a character of each at a time; long texts are cut into stretches that overlap by the longest phrase.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import batches

#: Characters of a stretch; bytes of an automaton's arrays at most, since every task gets them.
STRETCH, LARGEST = 4096, 512 << 20


class Automaton:
    """Phrases, as they are; where one repeats an earlier one only the earlier one is found. Empty
    phrases are found nowhere."""

    def __init__(self, phrases: Iterable[str]):
        first: dict[str, int] = {}
        for k, p in enumerate(phrases):
            if p:
                first.setdefault(p, k)
        texts = sorted(first, key=len)
        self.longest = len(texts[-1]) if texts else 0
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.alphabet = np.unique(points)
        self.width = len(self.alphabet) + 1
        chars = np.searchsorted(self.alphabet, points) + 1
        size = np.array([len(t) for t in texts], np.int64)
        start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        state, levels, ends, count = np.zeros(len(texts), np.int64), [], [], 0
        for depth in range(self.longest):
            on = np.flatnonzero(size > depth)
            keys, at = np.unique(state[on] * self.width + chars[start[on] + depth], return_inverse=True)
            state[on] = at + count + 1
            levels.append(keys)
            count += len(keys)
        self.edges = np.concatenate(levels) if levels else np.zeros(0, np.int64)
        if self.edges.nbytes * 4 > LARGEST:
            raise ValueError(f"the phrases are more than an automaton of {LARGEST} bytes holds")
        self.phrase = np.full(count + 1, -1, np.int64)
        self.phrase[state] = [first[t] for t in texts]
        self.length = np.zeros(count + 1, np.int64)
        self.length[state] = size
        # where to go on after a mismatch, and the next shorter state at which a phrase ends
        self.fail, self.shorter = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64)
        done = 0
        for depth, keys in enumerate(levels):
            own = np.arange(done + 1, done + len(keys) + 1)
            done += len(keys)
            if depth:
                self.fail[own] = self.step(self.fail[keys // self.width], keys % self.width)
                below = self.fail[own]
                self.shorter[own] = np.where(self.phrase[below] >= 0, below, self.shorter[below])

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after one more character each (0: of no phrase)."""
        out, left, s = np.zeros(len(state), np.int64), np.flatnonzero(char > 0), state.copy()
        while len(left) and len(self.edges):
            key = s[left] * self.width + char[left]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            out[left[hit]] = at[hit] + 1
            left = left[~hit]
            left = left[s[left] > 0]
            s[left] = self.fail[s[left]]
        return out

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, phrase) of every match, overlapping ones included, by text and end."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), max(0, len(self.alphabet) - 1))
        chars = np.where(self.alphabet[at] == points, at + 1, 0) if len(self.alphabet) else np.zeros(len(points), np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        # stretches: where they start and end, and from where on their matches count
        pieces = np.maximum(1, -(-size // STRETCH))
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        counts_from = begin[owner] + number * STRETCH
        start, end = np.maximum(begin[owner], counts_from - self.longest + 1), np.minimum(begin[owner] + size[owner], counts_from + STRETCH)
        order = np.argsort(start - end, kind="stable")
        start, length, counts_from, owner = start[order], (end - start)[order], counts_from[order], owner[order]
        state, found = np.zeros(len(order), np.int64), []
        for k in range(int(length[0]) if len(length) and self.longest else 0):
            n = int(np.searchsorted(-length, -k, "left"))
            state[:n] = self.step(state[:n], chars[start[:n] + k])
            who = np.flatnonzero((self.phrase[state[:n]] >= 0) | (self.shorter[state[:n]] > 0))
            who = who[start[who] + k >= counts_from[who]]
            s = state[who]
            while len(who):
                ends = self.phrase[s] >= 0
                w = who[ends]
                found.append(np.stack((owner[w], start[w] + k + 1 - self.length[s[ends]] - begin[owner[w]], self.phrase[s[ends]], start[w] + k - begin[owner[w]])))
                s = self.shorter[s]
                who, s = who[s > 0], s[s > 0]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        text, position, phrase, last = np.concatenate(found, 1)
        order = np.lexsort((position, last, text))
        return text[order], position[order], phrase[order]


def _listed(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), pa.array(values, pa.int32()))


def matches(text: Column, phrases: Iterable[str]) -> Column:
    """An array of (phrase: its number, position: in characters) of every place where one of the
    phrases stands in a text, in the order of their ends. Letters have to be the same, case included."""
    automaton = Automaton(phrases)

    @F.arrow_udf("array<struct<phrase:int,position:int>>")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for some in batches([t or "" for t in texts.to_pylist()]):
            owner, position, phrase = automaton.find(some)
            offsets = pa.array(np.searchsorted(owner, np.arange(len(some) + 1)), pa.int32())
            rows = pa.StructArray.from_arrays([pa.array(phrase, pa.int32()), pa.array(position, pa.int32())], ["phrase", "position"])
            parts.append(pa.ListArray.from_arrays(offsets, rows))
        kind = pa.list_(pa.struct([("phrase", pa.int32()), ("position", pa.int32())]))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run(text)


def phrases_in(sentences: Column, phrases: Iterable[str]) -> Column:
    """For each sentence of an array the numbers of the phrases in it, ascending and each once."""
    automaton = Automaton(phrases)

    @F.arrow_udf("array<array<int>>")
    def run(lists: pa.Array) -> pa.Array:
        inner = lists.flatten()
        texts, parts = [t or "" for t in inner.to_pylist()], []
        for some in batches(texts):
            owner, _, phrase = automaton.find(some)
            pairs = np.unique(np.stack((owner, phrase), 1), axis=0)
            parts.append(_listed(pairs[:, 1], pairs[:, 0], len(some)))
        found = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
        size = [len(x) if x.is_valid else 0 for x in lists]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), found)

    return run(sentences)
