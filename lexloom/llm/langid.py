"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's
maximum over the window is kept and a softmax layer decides. A document's prediction is the mean
of its windows' probabilities; all windows of the whole text are read.

Scale: one scan of the documents for training rows (a bounded sample per language), one for
prediction; no shuffle of texts. The network is about 20 KB and travels with the closure.
Training draws from all windows of the sampled documents anew for each epoch, each document with the
same weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import fold, one_thread

#: Bytes in a window.
WINDOW = 128
#: Labelled documents a language is fitted on, and their bytes, at most (the last may go over): the
#: first by a hash of id and text, each whole.
PER_LANG, BYTES = 400, 20_000_000
#: Windows of a sampled document that an epoch draws, from all of them.
DRAWN = 6
#: Windows predicted at once.
BLOCK = 1024
#: Steps of training at least, so that few labelled documents are gone through more often.
STEPS = 200
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 12
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes over all of `data`, the last one filled with blanks."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


class ByteCNN:
    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"emb": r.normal(0, 0.5, (256, EMBED)), "out": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "out_b": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset, every byte's share in each filter's sum."""
        return [[(self.p["emb"] @ self.p[f"w{w}"][k]).astype(np.float32) for k in range(w)] for w in WIDTHS]

    def pooled(self, x: np.ndarray, tables, where: bool = False):
        """ReLU of the maxima of all filters over each window; their places too, for training."""
        values, places = [], []
        for w, table in zip(WIDTHS, tables, strict=True):
            n = x.shape[1] - w + 1
            total = table[0][x[:, :n]]
            for k in range(1, w):
                total += table[k][x[:, k : k + n]]
            if where:
                at = total.argmax(1)
                places.append(at)
                top = np.take_along_axis(total, at[:, None, :], 1)[:, 0]
            else:
                top = total.max(1)
            values.append(np.maximum(top + self.p[f"b{w}"], 0))
        return np.concatenate(values, 1), places

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["out_b"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 3e-3, seed: int = 7) -> ByteCNN:
        """Adam on the cross entropy; only the window place that won a filter's maximum learns.

        docs: all windows of each document. An epoch takes DRAWN of each, or all where it has fewer.
        """
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t = 0
        all_x, size = np.concatenate(docs), np.array([len(d) for d in docs])
        first = np.cumsum(size) - size
        each = np.minimum(size, DRAWN)
        label = np.repeat(y, each)
        weight = np.bincount(label, minlength=len(self.langs)).astype(float)
        weight = np.where(weight > 0, len(label) / np.maximum(weight, 1) / len(self.langs), 0)
        for _ in range(max(epochs, -(-STEPS * batch // max(1, len(label))))):
            # one window from each of `each` equal stretches of a document
            k = np.arange(len(label)) - np.repeat(np.cumsum(each) - each, each)
            n, of = np.repeat(size, each), np.repeat(each, each)
            at = np.repeat(first, each) + np.minimum(((k + r.random(len(k))) * n / of).astype(np.int64), n - 1)
            x, y = all_x[at], label
            order = r.permutation(len(x))
            for s in range(0, len(x), batch):
                take = order[s : s + batch]
                xb, yb = x[take], y[take]
                pooled, places = self.pooled(xb, self.tables(), True)
                p = self.softmax(pooled)
                p[np.arange(len(yb)), yb] -= 1
                p *= weight[yb][:, None] / len(yb)
                g = {"out": pooled.T @ p, "out_b": p.sum(0), "emb": np.zeros((256, EMBED))}
                back = (p @ self.p["out"].T) * (pooled > 0)
                for i, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                    d = back[:, i * FILTERS : (i + 1) * FILTERS]
                    g[f"b{w}"], g[f"w{w}"] = d.sum(0), np.zeros((w, EMBED, FILTERS))
                    for k in range(w):
                        won = np.take_along_axis(xb, at + k, 1)  # (rows, filters): the bytes
                        e = self.p["emb"][won]
                        g[f"w{w}"][k] = np.einsum("nfe,nf->ef", e, d)
                        np.add.at(g["emb"], won.ravel(), (d[:, :, None] * self.p[f"w{w}"][k].T[None]).reshape(-1, EMBED))
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability per text; `und`, 0 for null or letterless texts."""
        tables = self.tables()
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        data, owner, size = [], [], 0

        def flush():
            nonlocal data, owner, size
            if not data:
                return
            x = np.concatenate(data)
            p = np.concatenate([self.softmax(self.pooled(x[s : s + BLOCK], tables)[0]) for s in range(0, len(x), BLOCK)])
            rows = np.concatenate(([0], np.cumsum([len(d) for d in data])[:-1]))
            mean = np.add.reduceat(p, rows, 0) / np.array([len(d) for d in data])[:, None]
            for i, q in zip(owner, mean, strict=True):
                k = int(q.argmax())
                langs[i], scores[i] = self.langs[k], float(min(1.0, max(0.0, q[k])))
            data, owner, size = [], [], 0

        for i, text in enumerate(texts):
            if self.langs and text and any(map(str.isalpha, text)):
                data.append(windows(text.encode("utf-8", "replace")))
                owner.append(i)
                size += len(data[-1])
                if size >= 8 * BLOCK:
                    flush()
        flush()
        return langs, scores


def train(docs: DataFrame, usable, per_lang: int = PER_LANG) -> ByteCNN:
    """A network for the languages of the rows for which `usable` holds.

    The sample: at most `per_lang` documents of each language, the first by a hash of id and text,
    so that many rows of one id don't come together. Texts of the sample are learned from whole.
    """
    labelled = docs.filter(usable & F.col("lang").isNotNull() & (F.trim("text") != "")).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return ByteCNN([])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(17), "text"), F.lit(1_000_000))
    keep = F.lit(False)
    for lang in langs:  # some more than wanted, then the first of these
        keep = keep | ((F.col("lang") == lang) & (draw < min(1_000_000, int(1_500_000 * per_lang / counts[lang]) + 10)))
    some = labelled.filter(keep).select("lang", draw.alias("draw"), F.col("text").cast("binary").alias("bytes")).distinct()
    order = W.partitionBy("lang").orderBy("draw", F.crc32("bytes"))  # about 1.5 * per_lang rows a language
    some = some.withColumns({"rank": F.row_number().over(order), "before": F.sum(F.length("bytes")).over(order) - F.length("bytes")})
    rows = some.filter((F.col("rank") <= per_lang) & (F.col("before") < BYTES)).select("lang", "bytes").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.bytes)))  # the same network whatever order rows came in
    return ByteCNN(langs).fit([windows(bytes(r.bytes)) for r in rows], np.array([langs.index(r.lang) for r in rows])) if rows else ByteCNN([])


def identify(docs: DataFrame, model: ByteCNN, also: list[str] = []) -> DataFrame:
    """doc_id and the `also` columns of docs, with lang_pred and score."""
    kept = ["doc_id", *also]
    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for f in frames:
            for s in range(0, f.num_rows, 1000):
                g = f.slice(s, 1000)
                langs, scores = model.predict(g.column("text").to_pylist())
                yield pa.record_batch([*(g.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select("doc_id", "text", *(c for c in also if c != "text")).mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Learns from text and non-null lang where crc32(doc_id) mod 4 is not 2. Null, empty and
    letterless texts are `und` with score 0; so is every text if there is nothing to learn from.
    Of equally likely languages the first by name wins. Very long texts are read whole, window by
    window. Null doc_ids stay null. Repeated rows are predicted each, and learned from once; other
    columns are not looked at, whatever their names. An empty table gives no rows.
    """
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.select("doc_id", "text", "lang"), ~held)
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
