"""Encoding through a table of distinct chunks.

Text is cut where the tokenizer's own pre-tokenisation always cuts. Arrow numbers the distinct
chunks of a batch, each new one is encoded once with the tokenizers library, and a gather puts the
ids back by position: one look-up for each distinct chunk of a batch, none for each occurrence.
Texts with white space for which the cut is not certain are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexloom.llm.common import one_thread

#: White space that makes a byte-level cut uncertain (RE2): any but a blank or a newline, or a run.
_UNSURE = "[\\t\\x0B\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]"
#: Chunks that are encoded as one text, a special token between them.
_TOGETHER = 1000
#: Bytes of text of a batch, about; a longer text is a batch of its own. Chunks whose ids are put back at once.
CHARS, SPREAD = 10_000_000, 300_000
_loaded: dict[tuple, ChunkEncoder] = {}


class ByteLetters(dict):
    """For str.translate: what byte-level vocabularies write for a character's UTF-8 bytes."""

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = sorted({*range(256)}.difference(visible))

    def __missing__(self, code: int) -> str:
        self[code] = "".join(chr(b) if b in self.visible else chr(256 + self.other.index(b)) for b in chr(code).encode())
        return self[code]


class Table:
    """Distinct chunks as an Arrow array, and all their ids in one array; a chunk's place is its number."""

    def __init__(self, words: pa.Array | None = None, ids: np.ndarray | None = None, length: np.ndarray | None = None):
        self.words = pa.array([], pa.string()) if words is None else words
        self.ids = np.zeros(0, np.uint32) if ids is None else ids
        self.length = np.zeros(0, np.int32) if length is None else length
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length

    def __len__(self) -> int:
        return len(self.words)

    def add(self, words: pa.Array, ids: list[list[int]]) -> None:
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
        self.__init__(pa.concat_arrays([self.words, words]), np.concatenate((self.ids, flat)), np.concatenate((self.length, length)))

    def find(self, words: pa.Array) -> np.ndarray:
        """The words' numbers; -1: not there."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().copy()

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks one after the other, their ends)."""
        length = self.length[numbers]
        ends = np.cumsum(length, dtype=np.int64)
        at = np.repeat(self.start[numbers] - (ends - length), length)
        at += np.arange(len(at))
        return self.ids[at], ends


class ChunkEncoder:
    """kind "byte": byte-level BPE, where a blank starts a chunk and a newline is one;
    kind "word": white space separates chunks and is dropped.

    The table grows by every new chunk and starts anew where it has passed `keep` chunks, so memory
    stays bounded; what was dropped is encoded again when it is met again.
    """

    def __init__(self, path: str, kind: str, keep: int = 800_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pa.set_cpu_count(1)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind, self.keep = kind, keep
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark_id, self.mark = max(special.items(), default=(None, None))
        self.direct, self.letters = self.tokenizer.model.tokenize, ByteLetters()
        self.table = Table()

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """(whether each text has to be encoded whole, the chunks' keys of the others).

        A key is a word; for kind "byte" it stands for the word after a blank, and a key that
        starts with a newline stands for itself with what follows; a text's first is marked by a
        carriage return.
        """
        if self.kind == "word":  # odd separators stay inside a chunk, which the library cuts itself
            return np.zeros(len(texts), bool), pc.ascii_split_whitespace(texts)
        unsure = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False)
        sure = texts.filter(pa.array(~unsure)) if unsure.any() else texts
        keys = pc.binary_join_element_wise("\r", pc.replace_substring(sure, "\n", " \n"), "")
        return unsure, pc.split_pattern(keys, " ")

    def spelled(self, key: str) -> str:
        """What a key stands for."""
        if self.kind == "word" or key.startswith("\n"):
            return key
        return key[1:] if key.startswith("\r") else " " + key

    def encode_plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """As encode_plain, at less cost a chunk.

        A run of letters is one pre-token for certain, with its leading blank; it goes straight to
        the library's BPE model, and so does a run that a full stop or comma ends. The rest go
        through the whole library.
        """
        out: list[list[int] | None] = []
        direct, letters, byte = self.direct, self.letters, self.kind == "byte"
        ends = {e: [t.id for t in direct(e)] for e in (".", ",")}
        for c in chunks:
            end = ends.get(c[-1:])
            w = c if end is None else c[:-1]
            bare = w[1:] if byte and w[:1] == " " else w
            if bare.isalpha() and (byte or bare.isascii() or max(bare) < "İ"):
                ids = [t.id for t in direct(w.translate(letters) if byte else w.lower().translate(letters))]
                out.append(ids if end is None else ids + end)
            else:
                out.append(None)
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self.encode_together([chunks[i] for i in rest]), strict=True):
            out[i] = v
        return out

    def encode_together(self, chunks: list[str]) -> list[list[int]]:
        """As encode_plain: many chunks in one text, cut at the special token between."""
        if self.mark is None:
            return self.encode_plain(chunks)
        out: list[list[int]] = []
        for s in range(0, len(chunks), _TOGETHER):
            part = chunks[s : s + _TOGETHER]
            ids = self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids
            at = [i for i, x in enumerate(ids) if x == self.mark_id]
            if len(at) != len(part) - 1:  # one of them holds the mark itself
                out += self.encode_plain(part)
            else:
                out += [ids[a:b] for a, b in zip([0, *(i + 1 for i in at)], [*at, len(ids)], strict=True)]
        return out

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The chunks' numbers in the table, after what it lacks is added."""
        if len(self.table) > self.keep:
            self.table = Table()
        found = self.table.find(distinct)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            missing = distinct.take(pa.array(lacking))
            found[lacking] = len(self.table) + np.arange(len(lacking))
            self.table.add(missing, self.encode_chunks([self.spelled(w) for w in missing.to_pylist()]))
        return found

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; null: none."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts, "")
        unsure, lists = self.cut(texts)
        coded = lists.flatten().dictionary_encode()
        numbers = self.numbers(coded.dictionary)[coded.indices.to_numpy()]
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found, at = [], 0
        while at < len(lists):  # ids of some texts at a time, so that index arrays stay small
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SPREAD, "right")) - 1)
            ids, ends = self.table.spread(numbers[cuts[at] : cuts[to]])
            ends = np.concatenate(([0], ends))[cuts[at : to + 1] - cuts[at]].tolist()
            found += [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            at = to
        if not unsure.any():
            return found
        sure = iter(found)  # one at a time: such a text may be very long
        return [np.array(self.encode_plain([texts[i].as_py()])[0], np.uint32) if odd else next(sure) for i, odd in enumerate(unsure.tolist())]


def encoder(path: str, kind: str) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary, kept between tasks."""
    key = (path, kind)
    if key not in _loaded:
        one_thread()  # a worker serves one job after another: old tables go
        _loaded[key] = ChunkEncoder(path, kind)
    return _loaded[key]


def batches(frames: Iterable[pa.RecordBatch], column: str = "text", most: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `most` bytes, a row at least."""
    for f in frames:
        size = np.cumsum(pc.fill_null(pc.binary_length(f.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < f.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield f.slice(at, to - at)
            at = to
