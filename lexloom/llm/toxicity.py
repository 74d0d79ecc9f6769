"""Toxicity: a counterfactual-regularised linear classifier over hashed words and word starts.

A document's logit is a bias plus, for each distinct word, the weights of the word and of its
first letters. Besides the log loss, training swaps the identity terms of labelled texts for the
other terms of their list and penalises the squared change of the logit, so that naming a group
alone neither raises nor lowers a score. A text that has the other term already changes by the loss
of a term alone, as its set of words does.

Scale: training ids are chosen from the labels alone (a bounded number of each label, by hash of
the id), and only these few meet the documents; of the rows found, at most ROWS and about BYTES a
label are learned from, each whole. Scoring is one scan, no shuffle; the weights are SLOTS float32.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lexloom.llm.common import fold, one_thread, stored

SLOTS = 1 << 19
#: Labelled documents of each label that the fit uses, at most; rows of them (a doc_id may repeat),
#: and bytes that their slots take.
PER_LABEL, ROWS, BYTES = 5000, 6000, 100_000_000
#: Lists of terms that name groups; the terms of a list can stand for each other.
IDENTITY = (
    ("people", "women", "men", "muslims", "christians", "jews", "immigrants", "gays", "blacks", "whites"),
    ("person", "woman", "man", "muslim", "christian", "jew", "immigrant", "gay", "black", "white"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "schwule"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "homosexuels"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "homosexuales"),
)
_WORD = re.compile(r"[^\W\d_]+")

#: Bias of a model that saw no toxic text.
UNLABELLED = -4.0


def slots(word: str) -> tuple[int, ...]:
    """The weights a word takes part in: its own, and its first 3, 4 and 5 letters if it has more."""
    return tuple(zlib.crc32(x.encode()) % SLOTS for x in [f"={word}"] + [f"{n}{word[:n]}" for n in (3, 4, 5) if len(word) > n])


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Toxicity:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def logit(self, found: set[str]) -> float:
        known, total = self.known, self.bias
        if len(known) > 200_000:
            known.clear()
        for w in sorted(found):  # a fixed order of summing
            s = known.get(w)
            if s is None:
                s = known[w] = float(self.weights[list(slots(w))].sum())
            total += s
        return total

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words(text)), -30, 30))))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}


def fit(rows: list[tuple[np.ndarray, int, list[tuple[int, int]]]], epochs: int = 25, rate: float = 0.06, l2: float = 3e-4, swap: float = 1.0, batch: int = 64, seed: int = 5) -> Toxicity:
    """rows: (slots of a text, with repeats; label; its identity terms as (list, place))."""
    w, b = np.zeros(SLOTS), 0.0
    if not any(label for _, label, _ in rows):  # no toxic text seen: nothing is rejected
        return Toxicity(w.astype(np.float32), UNLABELLED)
    g2, bg2 = np.full(SLOTS, 1e-2), 1e-2  # sums of squares (AdaGrad)
    term = [[np.array(slots(t)) for t in group] for group in IDENTITY]
    y = np.array([r[1] for r in rows], float)
    r = np.random.default_rng(seed)
    share = min(max(y.mean(), 0.02), 0.98)
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # both labels count alike
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for s in range(0, len(order), batch):
            take = order[s : s + batch]
            ids = [rows[i][0] for i in take]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(take)), [len(i) for i in ids])
            z = b + np.bincount(owner, w[flat], len(take))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) * cost[take]
            at, grad = [flat], [d[owner]]
            for i in take:
                has = set(rows[i][2])
                for k, j in rows[i][2]:
                    other = int(r.integers(len(term[k])))
                    if other == j:
                        continue
                    added = (k, other) not in has  # else the swapped set merely loses a term
                    change = 2 * swap * (w[term[k][j]].sum() - (w[term[k][other]].sum() if added else 0.0))
                    at.append(term[k][j])
                    grad.append(np.full(len(term[k][j]), change))
                    if added:
                        at.append(term[k][other])
                        grad.append(np.full(len(term[k][other]), -change))
            at, where = np.unique(np.concatenate(at), return_inverse=True)
            g = np.bincount(where, np.concatenate(grad), len(at)) / len(take) + l2 * w[at]
            g2[at] += g * g
            w[at] = np.maximum(w[at] - rate * g / np.sqrt(g2[at]), 0)
            bg2 += d.mean() ** 2
            b -= rate * d.mean() / np.sqrt(bg2)
    return Toxicity(w.astype(np.float32), b)


def example(text: str | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(slots, identity terms) of a text."""
    found = words(text)
    ids = [s for w in sorted(found) for s in slots(w)]
    terms = [(k, group.index(t)) for k, group in enumerate(IDENTITY) for t in group if t in found]
    return np.array(ids, np.int64), terms


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Toxicity:
    """Fits on at most `per_label` toxic and as many other labelled documents outside the fold.

    Conflicting repeated labels of a document count as toxic; null labels and null ids are left out.
    """
    known = labels.select("doc_id", "toxic").filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit(3))
    picked = None
    for says in (0, 1):
        part = known.filter(F.col("toxic") == says).orderBy(draw, "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for f in frames:
            found = [example(t) for t in f.column("text").to_pylist()]
            yield pa.record_batch([f.column("doc_id"), f.column("toxic"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([[x for p in t for x in p] for _, t in found], pa.list_(pa.int32()))],
                                  names=["doc_id", "toxic", "ids", "terms"])

    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * per_label rows
    met = met.mapInArrow(features, met.select("doc_id").schema.add("toxic", "integer").add("ids", "binary").add("terms", ArrayType(IntegerType())))
    met = stored(met.distinct().withColumn("draw", F.xxhash64("doc_id", F.crc32("ids"), F.lit(5))), "toxicity-examples")
    rows = []
    for says in (0, 1):
        part, last, size = met.filter(F.col("toxic") == says), None, 0
        for r in part.select("draw", F.length("ids").alias("n")).orderBy("draw").limit(ROWS).collect():
            if size >= BYTES:
                break
            last, size = r.draw, size + r.n
        if last is not None:
            rows += part.filter(F.col("draw") <= last).drop("draw").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.ids)))
    return fit([(np.frombuffer(r.ids, "<i4").astype(np.int64), r.toxic, [(r.terms[i], r.terms[i + 1]) for i in range(0, len(r.terms), 2)]) for r in rows])


def score(docs: DataFrame, model: Toxicity, also: list[str] = []) -> DataFrame:
    """doc_id and the `also` columns of docs, with score and predicted."""
    kept = ["doc_id", *also]
    schema = docs.select(kept).schema.add("score", "double").add("predicted", "integer")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for f in frames:
            s = np.array([model.score(t) for t in f.column("text").to_pylist()], float)
            yield pa.record_batch([*(f.column(c) for c in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select("doc_id", "text", *(c for c in also if c != "text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts get the score of a text without words (the bias alone); so does
    every text, not predicted toxic, if no toxic label was learned from. Very long texts are scored
    whole, as the set of their words. Null doc_ids stay null. Repeated rows are scored each, and
    learned from once; labels that contradict each other count as toxic. Other columns of either table are not looked at,
    whatever their names. An empty table gives no rows.
    """
    model = train(docs, labels)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
