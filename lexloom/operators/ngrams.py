"""Perplexity by an n-gram model with Kneser-Ney smoothing, counted and applied as joins.

The model is a table for each order: n-grams with their counts, and contexts with how often and with
how many different words they go on. Below the highest order an n-gram counts for the different words
that stand before it. Each order gives off a discount to the order below, the lowest to all words
alike, one that was never seen included. A model of up to SENT n-grams goes to all tasks as arrays of
numbers, and texts are told row by row; with a larger one probabilities are worked out once for each
distinct n-gram of the asked texts, whatever their number, and go back to the texts by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.storage import stored

ORDER = 3
START, END = "<s>", "</s>"
#: N-grams of the highest order up to which all tasks get the model, some 40 bytes each.
SENT = 2_000_000


@dataclass(frozen=True)
class NgramModel:
    """grams[k]: gram, c of order k + 1; contexts[k]: context, total, types of order k + 2; discounts
    by order; total and types of single words."""

    order: int
    grams: tuple[DataFrame, ...]
    contexts: tuple[DataFrame, ...]
    discounts: tuple[float, ...]
    total: int
    types: int


def windows(words: Column, order: int) -> Column:
    """The n-grams of a text, one for each of its words and one for its end."""
    return T.shingles(F.concat(F.array_repeat(F.lit(START), order - 1), words, F.array(F.lit(END))), order)


def _last(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", -n)


def _context(gram: Column, order: int) -> Column:
    return F.substring_index(gram, " ", order - 1)


def train(texts: DataFrame, order: int = ORDER) -> NgramModel:
    """A model from texts (text); null texts count as empty, repeated rows count each.

    The discount of an order is n1 / (n1 + 2 * n2), of the numbers of n-grams that are counted once
    and twice; 0.5 where there are none.
    """
    if order < 1:
        raise ValueError("order has to be 1 or more")
    each = texts.select(F.explode(windows(T.words(F.coalesce("text", F.lit(""))), order)).alias("gram"))
    grams = [stored(each.groupBy("gram").agg(F.count("*").alias("c")), "ngrams")]
    for k in range(order - 1, 0, -1):
        grams.append(stored(grams[-1].groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c")), "ngrams"))
    grams.reverse()
    contexts = [stored(g.groupBy(_context(F.col("gram"), k).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("types")), "ngram-contexts") for k, g in enumerate(grams[1:], 2)]
    discounts = []
    for g in grams:
        n1, n2 = g.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        discounts.append(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5)
    total, types = grams[0].agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return NgramModel(order, tuple(grams), tuple(contexts), tuple(discounts), total, types)


def probabilities(grams: DataFrame, model: NgramModel) -> DataFrame:
    """gram, p of each of `grams` (gram: of the model's order, distinct)."""
    d, total = model.discounts[0], max(1, model.total)
    word = _last(F.col("gram"), 1)
    found = grams.withColumn("g", word).join(model.grams[0].select(F.col("gram").alias("g"), "c"), "g", "left")
    spread = F.lit((d * model.types / total if model.total else 1.0) / (model.types + 1))
    found = found.select("gram", (F.greatest(F.coalesce("c", F.lit(0)) - F.lit(d), F.lit(0.0)) / F.lit(float(total)) + spread).alias("p"))
    for k in range(2, model.order + 1):
        d = F.lit(model.discounts[k - 1])
        found = found.withColumns({"g": _last(F.col("gram"), k), "context": _context(_last(F.col("gram"), k), k)})
        found = found.join(model.grams[k - 1].select(F.col("gram").alias("g"), "c"), "g", "left").join(model.contexts[k - 2], "context", "left")
        seen = (F.greatest(F.coalesce("c", F.lit(0)) - d, F.lit(0.0)) + d * F.col("types") * F.col("p")) / F.col("total")
        found = found.select("gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen).alias("p"))
    return found


class SentModel:
    """A model as arrays. A word is its number in the model's vocabulary, 0 for all others; an n-gram is
    its words' numbers as digits."""

    def __init__(self, model: NgramModel):
        self.order, self.discounts, self.total, self.types = model.order, model.discounts, model.total, model.types
        grams = [g.select("gram", "c").toArrow() for g in model.grams]
        contexts = [x.select("context", "total", "types").toArrow() for x in model.contexts]
        cut = lambda column: pc.split_pattern(column.combine_chunks().cast(pa.string()), " ")
        self.vocabulary = pc.unique(pa.concat_arrays([pa.array([START, END]), cut(grams[-1]["gram"]).flatten()]))
        self.base = len(self.vocabulary) + 1
        self.start, self.end = (pc.index(self.vocabulary, x).as_py() + 1 for x in (START, END))
        key = lambda column, k: self.keys(self.numbers(cut(column).flatten()).reshape(-1, k), k)
        whole = lambda column: column.to_numpy().astype(np.float64)
        self.grams = [_sorted(key(g["gram"], k), whole(g["c"])) for k, g in enumerate(grams, 1)]
        self.contexts = [_sorted(key(x["context"], k), whole(x["total"]), whole(x["types"])) for k, x in enumerate(contexts, 1)]

    def numbers(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.add(pc.index_in(words, value_set=self.vocabulary), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def keys(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """The keys of rows' last k numbers."""
        out = np.zeros(len(numbers), np.int64)
        for i in range(numbers.shape[1] - k, numbers.shape[1]):
            out = out * self.base + numbers[:, i]
        return out

    def probabilities(self, numbers: np.ndarray) -> np.ndarray:
        """Of each row's last word after those before it; see the function of that name."""
        d, total = self.discounts[0], max(1, self.total)
        spread = (d * self.types / total if self.total else 1.0) / (self.types + 1)
        p = np.maximum(_found(self.grams[0], numbers[:, -1])[0] - d, 0.0) / float(total) + spread
        for k in range(2, self.order + 1):
            d = self.discounts[k - 1]
            at, types = _found(self.contexts[k - 2], self.keys(numbers[:, :-1], k - 1))
            c = _found(self.grams[k - 1], self.keys(numbers, k))[0]
            p = np.where(at > 0, (np.maximum(c - d, 0.0) + d * types * p) / np.maximum(at, 1.0), p)
        return p

    def sums(self, words: Column) -> Column:
        """log_p and n of a row's words and its end."""

        @F.arrow_udf("struct<log_p:double,n:bigint>")
        def run(column: pa.Array) -> pa.Array:
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            each = column.flatten().dictionary_encode()
            code = each.indices.to_numpy(zero_copy_only=False)
            numbers = self.numbers(each.dictionary.cast(pa.string()))[code] if len(code) else np.zeros(0, np.int64)
            log_p, ends = np.zeros(len(length)), np.cumsum(length)
            cuts = np.unique(np.searchsorted(ends + np.arange(1, len(ends) + 1) * self.order, np.arange(0, int(ends[-1]) + len(ends) * self.order + 1, 500_000))) if len(ends) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts, [*cuts[1:], len(length)], strict=True):  # some texts at a time
                if lo == hi:
                    continue
                n = length[lo:hi]
                first = np.cumsum(n + self.order) - n - self.order  # each text's place, with its starts and end
                row = np.full(int((n + self.order).sum()), self.start, np.int64)
                inside = np.repeat(first + self.order - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row[inside] = numbers[ends[lo] - length[lo] : ends[hi - 1]]
                row[first + n + self.order - 1] = self.end
                asked = np.repeat(first, n + 1) + np.arange((n + 1).sum()) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
                p = self.probabilities(row[asked[:, None] + np.arange(self.order)])
                log_p[lo:hi] = np.add.reduceat(np.log(p), np.cumsum(n + 1) - n - 1)
            return pa.StructArray.from_arrays([pa.array(log_p), pa.array(length + 1)], ["log_p", "n"])

        return run(words)


def _sorted(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    return keys[order], *(v[order] for v in values)


def _found(table: tuple[np.ndarray, ...], keys: np.ndarray) -> list[np.ndarray]:
    """The table's values of each key; 0 where it hasn't got it."""
    if not len(table[0]):
        return [np.zeros(len(keys)) for _ in table[1:]]
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return [np.where(table[0][at] == keys, v[at], 0.0) for v in table[1:]]


def sent(model: NgramModel) -> SentModel | None:
    """The model as arrays; null if it is too large to go to all tasks."""
    if model.grams[-1].count() > SENT:
        return None
    small = SentModel(model)
    return small if small.base**model.order < 2**63 else None


def of_row(words: Column, small: SentModel) -> Column:
    """The perplexity of a row's words alone."""
    told = lambda s: F.exp(-s["log_p"] / s["n"])
    return F.when(F.size(words) < 2, 0.0).otherwise(told(small.sums(words)))


def perplexity(docs: DataFrame, model: NgramModel) -> DataFrame:
    """doc_id, perplexity of each document (doc_id, text): of its words and its end, over the whole text.

    0 for texts of fewer than two words, null ones included. Rows that repeat a doc_id have the
    perplexity of their texts together; null ids are one document.
    """
    words = docs.select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    small = sent(model)
    if small is not None:
        sums = words.select("doc_id", F.size("w").alias("size"), small.sums(F.col("w")).alias("s"))
        sums = sums.groupBy("doc_id").agg(F.max("size").alias("size"), F.sum("s.log_p").alias("log_p"), F.sum("s.n").alias("n"))
        return sums.select("doc_id", F.when(F.col("size") < 2, 0.0).otherwise(F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity"))
    each = words.select("doc_id", F.explode(windows(F.col("w"), model.order)).alias("gram"))
    counts = stored(each.groupBy("doc_id", "gram").agg(F.count("*").alias("n")), "document-ngrams")
    known = stored(probabilities(counts.select("gram").distinct(), model), "ngram-probabilities")
    sums = counts.join(known, "gram").groupBy("doc_id").agg(F.sum(F.col("n") * F.ln("p")).alias("log_p"), F.sum("n").alias("n"))
    short = F.max(F.size("w")) < 2
    return words.groupBy("doc_id").agg(short.alias("short")).join(sums.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.when(F.col("short"), 0.0).otherwise(F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity"))
