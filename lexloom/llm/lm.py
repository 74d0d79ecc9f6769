"""Language-model scoring with a hidden Markov model.

Words are gathered in classes: each of the most frequent training words is one, all others share
SHAPES classes by their last letters, so that the latent states tell these apart too; the end of a
text is one. Baum-Welch trains STATES latent states: every partition gathers expected counts for
its documents, they are summed by class across partitions, and the driver updates the parameters
(their size depends on STATES and the number of classes alone). Passes go over all training
documents until the likelihood settles. The scaled forward recursion gives the exact likelihood of
a text's classes; a word of a shared class adds its smoothed share of that class, which doesn't
depend on the state.

Counts are exact for every word: they come back to each partition as a table of its own words, so
texts are read twice and never shuffled. Class numbers of all words are stored, two bytes each, and
the passes read those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import partition_words as parts
from lexloom.llm.chunk_encoder import batches
from lexloom.llm.common import fold, head_threshold, one_thread, stored

STATES = 8
#: Words that are classes of their own, at most; classes that all other words share.
CLASSES, SHAPES = 1 << 13, 1 << 11
#: Last bytes of a word that its shared class depends on.
ENDING = 3
#: Passes of Baum-Welch over all training documents at most; they end where a token's mean log10
#: probability gains less than SETTLED. Passes over the sample that these start from.
PASSES, SETTLED, START_PASSES = 4, 0.002, 15
#: Tokens of that sample, as expected; texts in it are whole.
SAMPLE = 300_000
#: Weight of the word frequencies in a state's emissions.
PRIOR = 20.0
#: Tokens worked on at once.
TOKENS = 1_000_000


class HMM:
    """start (K), move (K x K), emit (classes x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, share: np.ndarray, states: int = STATES, seed: int = 11) -> HMM:
        """Random around the classes' shares; states tend to stay."""
        r = np.random.default_rng(seed)
        emit = share[:, None] * r.gamma(2.0, 0.5, (len(share), states))
        move = np.full((states, states), 0.4 / max(1, states - 1)) + np.eye(states) * 0.6
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def by_time(docs: list[np.ndarray]):
        """Longest first; tokens of a time step next to each other, step by step."""
        lengths = np.array([len(d) for d in docs])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")  # documents with over t tokens
        first = np.concatenate(([0], np.cumsum(active)))
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat = np.empty(len(step), np.int64)
        flat[first[step] + np.repeat(np.arange(len(docs)), lengths)] = np.concatenate([docs[i] for i in order])
        return order, active, first, flat

    def log10(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 of each sequence's probability: the logs of the forward recursion's scales."""
        order, active, first, flat = self.by_time(docs)
        scale = np.empty(len(flat))
        a = None
        for t, n in enumerate(active):
            s = first[t]
            a = (self.start if a is None else a[:n] @ self.move) * self.emit[flat[s : s + n]]
            c = a.sum(1)
            a /= c[:, None]
            scale[s : s + n] = c
        logs = np.log10(scale)
        owner = np.arange(len(flat)) - np.repeat(first[:-1], active)
        out = np.empty(len(docs))
        out[order] = np.bincount(owner, logs, len(docs))
        return out

    def expect(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions over the sequences; their log10 probability."""
        _, active, first, flat = self.by_time(docs)
        k = len(self.start)
        move, emit = self.move.astype(np.float32), self.emit.astype(np.float32)
        alpha, scale = np.empty((len(flat), k), np.float32), np.empty((len(flat), 1), np.float32)
        a = None
        for t, n in enumerate(active):
            s = first[t]
            a = (self.start.astype(np.float32) if a is None else a[:n] @ move) * emit[flat[s : s + n]]
            c = a.sum(1, keepdims=True)
            a /= c
            alpha[s : s + n], scale[s : s + n] = a, c
        moves, beta = np.zeros((k, k)), None
        for t in range(len(active) - 1, -1, -1):
            s, n = first[t], active[t]
            now = np.ones((n, k), np.float32)
            if beta is not None:
                m, s1 = active[t + 1], first[t + 1]
                ahead = emit[flat[s1 : s1 + m]] * beta / scale[s1 : s1 + m]
                moves += alpha[s : s + m].T @ ahead
                now[:m] = ahead @ move.T
            beta = now
            alpha[s : s + n] *= now
        emits = np.stack([np.bincount(flat, alpha[:, i], len(self.emit)) for i in range(k)], 1)
        return alpha[: active[0]].sum(0, dtype=float), moves * self.move, emits, float(np.log10(scale, dtype=float).sum())

    @staticmethod
    def update(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> HMM:
        move = move + 1.0
        emit = emit + PRIOR * share[:, None]
        return HMM((start + 1) / (start + 1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def shape(words: pa.Array) -> np.ndarray:
    """The shared class of each word, from its last ENDING bytes: 0 to SHAPES - 1."""
    data, start, length = parts.byte_view(words)
    h = np.minimum(length, ENDING).astype(np.uint32)
    for k in range(1, ENDING + 1):
        at = start + length - k
        h = h * np.uint32(0x9E3779B1) + np.where(length >= k, data[np.maximum(at, 0)] if len(data) else 0, 0).astype(np.uint32)
    return ((h ^ h >> np.uint32(15)) % np.uint32(SHAPES)).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` of all texts, and the words before each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words, n = lists.flatten(), np.diff(offsets)
    if words.null_count or pc.any(pc.equal(pc.binary_length(words), 0)).as_py():  # white space at either end
        full = pc.fill_null(pc.greater(pc.binary_length(words), 0), False)
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)], minlength=len(n))
        words = words.filter(full)
    return words.dictionary_encode(), np.concatenate(([0], np.cumsum(n)))


def word_counts(docs: DataFrame) -> str:
    """A folder with (words, n) of each partition of `docs` (text, train): its distinct words, and how
    often each occurs in all training texts. Part -1 has every training word once."""
    buckets = parts.buckets_of(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        held, n = pa.array([], pa.string()), np.zeros(0, np.int64)
        for f in batches(frames):
            words, before = words_of(f.column("text"))
            train = np.repeat(f.column("train").to_numpy(zero_copy_only=False), np.diff(before))
            found = np.bincount(words.indices.to_numpy()[train], minlength=len(words.dictionary))
            at = pc.fill_null(pc.index_in(words.dictionary, held), -1).to_numpy()
            new = at < 0
            n[at[~new]] += found[~new]
            held, n = pa.concat_arrays([held, words.dictionary.filter(pa.array(new))]), np.concatenate((n, found[new]))
            if len(held) >= parts.HELD:
                yield parts.dealt(held, buckets, n)
                held, n = held.slice(0, 0), n[:0]
        if len(held):
            yield parts.dealt(held, buckets, n)

    def total(blocks: pa.Table) -> pa.Table:
        words = parts.cut(blocks["words"]).dictionary_encode()
        each = np.frombuffer(b"".join(blocks["n"].to_pylist()), np.int64)
        at = words.indices.to_numpy()
        n = np.bincount(at, each, len(words.dictionary)).astype(np.int64)
        sizes = pc.add(pc.count_substring(blocks["words"].combine_chunks(), " "), 1).to_numpy().astype(np.int64)
        seen = np.flatnonzero(n)
        out = [pa.table({"part": blocks["part"], "words": blocks["words"], "n": parts.binaries(n[at], sizes)})]
        if len(seen):
            one = np.array([len(seen)])
            out.append(pa.table({"part": pa.array([-1], pa.int64()), "words": parts.joined(words.dictionary.take(pa.array(seen)), one), "n": parts.binaries(n[seen], one)}))
        return pa.concat_tables(out)

    blocks = docs.select("text", "train").mapInArrow(run, "part long, bucket long, words string, n binary")
    return parts.saved(blocks.groupBy("bucket").applyInArrow(total, "part long, words string, n binary"), "word-counts")


def count_table(docs: DataFrame, folder: str) -> DataFrame:
    """(word, n, shape) of every training word, from the folder of word_counts."""
    spark = docs.sparkSession

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for words, n in zip(f.column("words"), f.column("n"), strict=True):
                w = parts.cut(pa.array([words.as_py()]))
                yield pa.record_batch({"word": w, "n": pa.array(np.frombuffer(n.as_py(), np.int64)), "shape": pa.array(shape(w).astype(np.int32))})

    if not parts.stored_for(folder, -1):
        return spark.createDataFrame([], "word string, n long, shape int")
    return spark.read.schema("words string, n binary").parquet(f"{folder}/part=-1").mapInArrow(run, "word string, n long, shape int")


def counts_from_all(folder: str, words: pa.Array) -> np.ndarray:
    """Counts of words from the table of all training words, block by block."""
    n = np.zeros(len(words), np.int64)
    for block in parts.stored_batches(folder, -1, ["words", "n"]):
        at = pc.index_in(words, parts.cut(block.column("words")))
        hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        n[hit] = np.frombuffer(b"".join(block.column("n").to_pylist()), np.int64)[at.drop_null().to_numpy()]
    return n


class Classes:
    """What gives a word its class and its share of it. own: the frequent words, by rank."""

    def __init__(self, own: list[str], own_n: list[int], shape_n: np.ndarray, shape_kinds: np.ndarray, ends: int, tokens: int, kinds: int):
        self.own, self.ends, self.tokens = own, ends, tokens
        self.whole = tokens + 0.1 * (kinds + 1)
        self.shape_whole = shape_n + 0.1 * (shape_kinds + 1)  # one more kind for words never seen
        share = np.concatenate((np.array(own_n, float) + 0.1, shape_n + 0.1 * (shape_kinds + 1), [ends + 0.1]))
        self.share = share / share.sum()

    @property
    def end(self) -> int:
        return len(self.share) - 1

    def of(self, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, log10 of the share of it) of words with the training counts n."""
        at = pc.fill_null(pc.index_in(words, pa.array(self.own, pa.string())), -1).to_numpy().astype(np.int64)
        kind = shape(words)
        plus = np.where(at >= 0, 0.0, np.log10((n + 0.1) / self.shape_whole[kind]))
        return np.where(at >= 0, at, len(self.own) + kind), plus


def classified(docs: DataFrame, folder: str, classes: Classes) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, base, plus, ids) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        c = shared.value
        found = parts.own_blocks(folder, ["words", "n"])
        known = parts.cut(found["words"]) if found is not None else pa.array([], pa.string())
        counts = np.frombuffer(b"".join(found["n"].to_pylist()), np.int64) if found is not None else np.zeros(0, np.int64)
        for f in batches(frames):
            words, before = words_of(f.column("text"))
            at = pc.fill_null(pc.index_in(words.dictionary, known), -1).to_numpy()
            lost = np.flatnonzero(at < 0)  # none, unless the texts are dealt otherwise on this reading
            n = counts[at] if len(counts) else np.zeros(len(at), np.int64)
            if len(lost):
                n[lost] = counts_from_all(folder, words.dictionary.take(pa.array(lost)))
            kind, plus = c.of(words.dictionary, n)
            base = np.log10((n + 0.1) / c.whole)
            each = words.indices.to_numpy()
            size = np.diff(before)

            def summed(x: np.ndarray) -> np.ndarray:
                return np.bincount(np.repeat(np.arange(len(size)), size), x[each], len(size)).astype(float)  # of nothing it counts whole numbers

            ids = np.full(len(each) + len(size), c.end, "<u2")
            ids[np.arange(len(each)) + np.repeat(np.arange(len(size)), size)] = kind[each]
            yield pa.record_batch({
                "doc_id": f.column("doc_id"), "train": f.column("train"), "n_tokens": pa.array(size + 1), "n_known": pa.array(summed(n > 0).astype(np.int64) + int(c.ends > 0)),
                "base": pa.array(summed(base) + np.log10((c.ends + 0.1) / c.whole)), "plus": pa.array(summed(plus)), "ids": parts.binaries(ids, size + 1)})

    schema = docs.select("doc_id", "train").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("plus", "double"), ("ids", "binary")):
        schema = schema.add(name, kind)
    return stored(docs.select("doc_id", "text", "train").mapInArrow(run, schema), "lm-classes")


def sequences(f: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in f.column("ids")]


def baum_welch(train: DataFrame, model: HMM, share: np.ndarray) -> tuple[HMM, float]:
    """(updated model, log10 probability under `model`) from one pass over all training documents.

    Each partition emits a row for each class that it met, and one each for starts and moves (as
    negative classes); they are summed where they are shuffled, so no task holds many partitions'.
    """
    k = len(model.start)
    shared = train.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(k)]

    def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        total, head, log = np.zeros((len(share), k)), np.zeros((k + 1, k)), 0.0
        for f in batches(frames, "ids", 2 * TOKENS):
            start, move, emit, log10 = shared.value.expect(sequences(f))
            head += np.concatenate((start[None], move))
            total += emit
            log += log10
        met = np.flatnonzero(total.any(1))
        rows = np.concatenate((total[met], head, np.full((1, k), log)))
        yield pa.record_batch([pa.array(np.concatenate((met, -1 - np.arange(k + 2)))), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(k))], names=["class", *names])

    rows = train.select("ids").mapInArrow(gather, "class long, " + ", ".join(f"{c} double" for c in names))
    rows = rows.groupBy("class").agg(*(F.sum(c).alias(c) for c in names)).collect()  # a row for each class at most
    shared.unpersist()
    found = {r[0]: np.array(r[1:], float) for r in rows}
    emits = np.stack([found.get(c, np.zeros(k)) for c in range(len(share))])
    head = np.stack([found[-1 - i] for i in range(k + 1)])
    return HMM.update(head[0], head[1:], emits, share), float(found[-2 - k][0])


def train_model(docs: DataFrame, classes: Classes, passes: int = PASSES) -> tuple[HMM, list[float]]:
    """(model, mean log10 probability of a token before each pass). docs: what classified() returns.

    A sample of whole texts, chosen by a hash of the id, gives the start; the passes that follow go
    over all training documents.
    """
    train = docs.filter("train")
    share = classes.share
    model = HMM.first(share)
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.crc32("ids"), F.lit(29)), F.lit(1_000_000))
    some = train.filter(draw < min(1_000_000, 1 + int(1_000_000 * SAMPLE / classes.tokens)))
    few = some.groupBy(F.crc32("ids").alias("k"), "ids").agg(F.count("*").alias("n")).select("ids").collect()  # repeated texts count once; about SAMPLE tokens
    sample = [np.frombuffer(x, "<u2").astype(np.int64) for x in sorted(bytes(r.ids) for r in few)]
    for _ in range(START_PASSES if sample else 0):
        start, move, emit, _ = model.expect(sample)
        model = HMM.update(start, move, emit, share)
    curve: list[float] = []
    for _ in range(passes):
        model, log = baum_welch(train, model, share)
        curve.append(log / classes.tokens)
        if len(curve) > 1 and curve[-1] - curve[-2] < SETTLED:
            break
    return model, curve


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from documents whose crc32(doc_id) mod `folds` is not 0. Null and empty texts are the
    end alone. Very long texts are scored whole, next to shorter ones. Null doc_ids stay null (their
    fold is that of an empty id). Repeated rows come out each, with equal scores. Other columns are
    not looked at, whatever their names. An empty table gives no rows. Without training documents
    every token is equally unknown.
    """
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) != 0).alias("train"))
    folder = word_counts(docs)
    counts = count_table(docs, folder)
    ends = docs.filter("train").count()
    at = head_threshold(counts, 4 * CLASSES)
    frequent = counts.filter(F.col("n") >= at).collect()  # 4 * CLASSES rows at most
    frequent.sort(key=lambda r: (-r.n, r.word))
    own = frequent[:CLASSES]
    shapes = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # SHAPES rows at most
    shape_n, shape_kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in shapes:
        shape_n[r["shape"]], shape_kinds[r["shape"]] = r.n, r.kinds
    tokens, kinds = int(shape_n.sum()) + ends, int(shape_kinds.sum()) + (ends > 0)
    for r in own:
        shape_n[r["shape"]] -= r.n
        shape_kinds[r["shape"]] -= 1
    classes = Classes([r.word for r in own], [r.n for r in own], shape_n, shape_kinds, ends, tokens, kinds)
    known = classified(docs, folder, classes)
    model = train_model(known, classes)[0] if ends else HMM.first(classes.share)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for f in batches(frames, "ids", 2 * TOKENS):
            total = shared.value.log10(sequences(f)) + f.column("plus").to_numpy()
            yield pa.record_batch([*(f.column(c) for c in ("doc_id", "train", "n_tokens", "n_known", "base")), pa.array(total)], names=["doc_id", "train", "n_tokens", "n_known", "base", "score"])

    schema = known.select("doc_id", "train", "n_tokens", "n_known", "base").schema.add("score", "double")
    return known.select("doc_id", "train", "n_tokens", "n_known", "base", "plus", "ids").mapInArrow(run, schema).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
