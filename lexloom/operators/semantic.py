"""Paraphrase by nearest sentence vectors: an exact nearest-neighbour join by pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions import text as T
from lexloom.storage import batches_of, stored

#: Vectors of a block, pivots at most, and what distances may be off by rounding.
BLOCK, PIVOTS, SLACK = 2048, 1024, 1e-6
#: Bytes of corpus vectors that a task holds, and asked vectors that meet them in one task, about.
HELD, STRIPE = 1 << 24, 1 << 16


def usable(embedding: Column) -> Column:
    """Not null, not empty, every component finite, not all of them zero."""
    good = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & F.coalesce(good & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of what is left neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


def _usable_rows(lists: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, unit vectors) of the usable vectors of a batch, `most` at once and all of one size."""
    ends, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    values = lists.values.to_numpy(zero_copy_only=False)  # null components as NaN
    length = np.where(valid, np.diff(ends), 0)
    for size in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == size)
        for a in range(0, len(rows), most):
            k = rows[a : a + most]
            x = values[ends[k][:, None] + np.arange(size)].astype(np.float64)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            if good.any():
                yield size, k[good], _unit(x[good])


class Pivots:
    """Unit vectors that cut space into cells, by number of components; cells are numbered through.
    radius: the distance of each cell's farthest vector from its pivot."""

    def __init__(self, vectors: list[tuple]):
        self.of, self.first, n = {}, {}, 0
        for size in sorted({len(v) for v in vectors}):
            self.of[size] = _unit(np.array([v for v in vectors if len(v) == size], np.float64))
            self.first[size] = n
            n += len(self.of[size])
        self.cells, self.radius = n, np.full(n, -np.inf)

    def own(self, size: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, that of its nearest pivot, and the distance to that."""
        dot = x @ self.of[size].T
        best = dot.argmax(1)
        return best + self.first[size], _distance(dot[np.arange(len(x)), best])

    def least(self, size: int, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """What a vector of each cell is away at least, by the cell's ball and its half space; none of an empty one."""
        p, start = self.of[size], self.first[size]
        d, row = _distance(x @ p.T), np.arange(len(x))
        half = (d**2 - d[row, cell - start][:, None] ** 2) / (2 * np.maximum(_distance(p @ p.T)[cell - start], 1e-12))
        out = np.maximum(d - self.radius[start : start + len(p)], half)
        out[row, cell - start] = 0.0
        out[:, np.isinf(self.radius[start : start + len(p)])] = np.inf
        return out

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for size, k, x in _usable_rows(b.column("embedding")):
                cell, far = self.own(size, x)
                yield pa.record_batch([pa.array(ids[k]), pa.array(np.full(len(k), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(far), pa.array([v.tobytes() for v in x], pa.binary())],
                                      names=["id", "size", "cell", "far", "x"])


class Chunk:
    """Vectors of the corpus in the order of cell and id."""

    def __init__(self, blocks: pd.DataFrame):
        size = int(blocks["size"].iloc[0])
        x, ids, cell = np.frombuffer(b"".join(blocks["x"])).reshape(-1, size), np.frombuffer(b"".join(blocks["ids"]), np.int64), np.frombuffer(b"".join(blocks["cells"]), np.int32)
        order = np.lexsort((ids, cell))
        self.size, self.x, self.ids, cell = size, x[order], ids[order], cell[order]
        self.cells, start = np.unique(cell, return_index=True)
        self.ends = np.append(start, len(cell))


class Asked:
    """Asked vectors with the best found so far, and how many they met."""

    def __init__(self, size: int, x: np.ndarray, cell: np.ndarray, similarity: np.ndarray | None = None, nearest: np.ndarray | None = None):
        self.size, self.x, self.cell = size, x, cell
        self.similarity = np.full(len(x), -np.inf) if similarity is None else similarity.copy()
        self.nearest = np.zeros(len(x), np.int64) if nearest is None else nearest.copy()
        self.met = np.zeros(len(x), np.int64)

    def _meet(self, chunk: Chunk, k: int, rows: np.ndarray) -> None:
        """The vectors in `rows` and all of a chunk's cell, in products of BLOCK times BLOCK at most."""
        for a in range(chunk.ends[k], chunk.ends[k + 1], BLOCK):
            c, ids = (v[a : min(a + BLOCK, chunk.ends[k + 1])] for v in (chunk.x, chunk.ids))
            for r in (rows[b : b + BLOCK] for b in range(0, len(rows), BLOCK)):
                s = self.x[r] @ c.T
                at = s.argmax(1)
                s, near = s[np.arange(len(r)), at], ids[at]
                better = (s > self.similarity[r]) | ((s == self.similarity[r]) & (near < self.nearest[r]))
                self.similarity[r[better]], self.nearest[r[better]] = s[better], near[better]
                self.met[r] += len(c)

    def meet_own(self, chunk: Chunk) -> None:
        order = np.argsort(self.cell, kind="stable")
        cells, start = np.unique(self.cell[order], return_index=True)
        at = np.searchsorted(chunk.cells, cells)
        for c, k, rows in zip(cells, at, np.split(order, start[1:]), strict=True):
            if k < len(chunk.cells) and chunk.cells[k] == c:
                self._meet(chunk, k, rows)

    def meet_others(self, chunk: Chunk, least: np.ndarray, first: int, own: bool = False) -> None:
        """All cells of the chunk that can hold something nearer than the best so far; `own` ones too, if told."""
        for k, c in enumerate(chunk.cells):
            visit = least[:, c - first] <= _distance(self.similarity) + SLACK
            rows = np.flatnonzero(visit if own else visit & (self.cell != c))
            if len(rows):
                self._meet(chunk, k, rows)


_PLACED = "id long, size int, cell int, far double, x binary"
_CHUNK = "chunk int, size int, ids binary, cells binary, x binary"
_FOUND = "row long, id long, nearest_id long, similarity double, compared long"
_ASKED_ARROW = pa.schema([(n, pa.int32()) for n in ("chunk", "stripe", "size")] + [(n, pa.binary()) for n in ("rows", "ids", "cells", "x", "nearest", "similarity")])
_ASKED = "chunk int, stripe int, size int, rows binary, ids binary, cells binary, x binary, nearest binary, similarity binary"


def _found(rows: np.ndarray, ids: np.ndarray, a: Asked) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v) for v in (rows, ids, a.nearest, a.similarity, a.met)], names=["row", "id", "nearest_id", "similarity", "compared"])


def _best(found: DataFrame) -> DataFrame:
    best = found.groupBy("row", "id").agg(F.max(F.struct("similarity", (-F.col("nearest_id")).alias("minus"))).alias("best"), F.sum("compared").alias("compared"))
    return best.select("row", "id", (-F.col("best.minus")).alias("nearest_id"), F.col("best.similarity").alias("similarity"), "compared")


def nearest(asked: DataFrame, corpus: DataFrame, key: str = "vec_id", block: int = BLOCK, pivots: int = PIVOTS, held: int = HELD) -> DataFrame:
    """key, nearest_id, similarity (cosine), compared of each asked vector's nearest of the corpus.

    Exact. Vectors of the corpus lie in cells around pivots, which are some of them. An asked vector
    first meets its own cell. The best found there rules out every cell whose ball or whose half space
    is farther away, and only the others are met; `compared` is how many vectors it met, of as many as
    the corpus has distinct ones. Pivots are as many as the root of the corpus, `pivots` at most.

    A corpus of `held` bytes at most goes to all tasks, and asked vectors stay where they are. A larger
    one is cut into chunks of whole cells of about that size (a larger cell into several); asked vectors go,
    `block` together, first to the chunk of their own cell and then to those that aren't ruled out.

    Vectors that are null, empty, zero or hold null or non-finite components match nothing and have no
    row; neither have rows with a null key, and vectors of a length that the corpus doesn't hold. Rows
    that repeat a key have a row each. Ties go to the smaller id; equal vectors of the corpus count once.
    """
    spark = asked.sparkSession
    wide = F.col("embedding").cast("array<double>").alias("embedding")
    theirs = stored(corpus.filter(usable(F.col("embedding")) & F.col(key).isNotNull()).groupBy(wide).agg(F.min(key).cast("long").alias("id")), "nearest-corpus")
    total = theirs.count()
    if not total:
        return spark.createDataFrame([], f"{key} long, nearest_id long, similarity double, compared long")
    share = 1 + 1_000_000 * min(pivots, math.isqrt(total) + 1) // max(1, total)
    # a sample of bounded size, and for each length of vectors one
    some = theirs.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share).select("embedding").unionByName(theirs.groupBy(F.size("embedding")).agg(F.min_by("embedding", "id").alias("embedding")).select("embedding"))
    known = Pivots(list({tuple(r.embedding): None for r in some.collect()}))
    cells = stored(theirs.mapInArrow(known.place, _PLACED), "nearest-cells")
    sizes = cells.groupBy("cell", "size").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each pivot at most
    # cells in their order to chunks: of each cell its first chunk and over how many it is spread
    first, parts, chunk, fill, last = np.zeros(known.cells, np.int64), np.zeros(known.cells, np.int64), -1, 0, None
    for r in sorted(sizes, key=lambda r: r.cell):
        known.radius[r.cell] = r.radius
        need = r.n * r.size * 8
        if r.size != last or fill + need > held:
            chunk, fill, last = chunk + 1, 0, r.size
        first[r.cell], parts[r.cell] = chunk, max(1, -(-need // held))
        chunk, fill = chunk + int(parts[r.cell]) - 1, fill + need
    to_chunk = F.get(F.lit(first.tolist()), F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(F.lit(parts.tolist()), F.col("cell")))

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["cell", "id"])
        pieces = (f[a : a + block] for a in range(0, len(f), block))
        return pd.DataFrame([{"chunk": p["chunk"].iloc[0], "size": p["size"].iloc[0], "ids": p["id"].to_numpy(np.int64).tobytes(), "cells": p["cell"].to_numpy(np.int32).tobytes(), "x": b"".join(p["x"])} for p in pieces])

    chunks = stored(cells.withColumn("chunk", to_chunk.cast("int")).groupBy("chunk").applyInPandas(packed, _CHUNK), "nearest-chunks")
    kind = asked.schema["embedding"].dataType.elementType.typeName()
    plain = asked.filter(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col("embedding") if kind in ("float", "double") else wide)

    if sum(r.n * r.size * 8 for r in sizes) <= held:
        rows = pd.DataFrame([r.asDict() for r in chunks.collect()])  # `held` bytes at most
        everywhere = spark.sparkContext.broadcast([Chunk(part) for _, part in rows.groupby("chunk")])

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, ids = b.column("row").to_numpy(), b.column("id").to_numpy()
                for size, k, x in _usable_rows(b.column("embedding")):
                    if size in known.of:
                        a = Asked(size, x, known.own(size, x)[0])
                        mine = [c for c in everywhere.value if c.size == size]
                        for c in mine:
                            a.meet_own(c)
                        least = known.least(size, x, a.cell)
                        for c in mine:
                            a.meet_others(c, least, known.first[size])
                        yield _found(row[k], ids[k], a)

        return stored(plain.mapInArrow(compared, _FOUND), "nearest-found").select(F.col("id").alias(key), "nearest_id", "similarity", "compared")

    cells_of = [np.flatnonzero((first <= j) & (j < first + parts)) for j in range(chunk + 1)]
    size_of = {int(first[r.cell]) + j: r.size for r in sizes for j in range(int(parts[r.cell]))}
    stripes = max(1, -(-asked.count() // STRIPE))

    def sent(j: int, size: int, row, ids, cell, x, near, similarity) -> list[dict]:
        pieces = (slice(a, a + block) for a in range(0, len(row), block))
        return [{"chunk": j, "stripe": int(row[p][0] % 7919 % stripes), "size": size, "rows": row[p].tobytes(), "ids": ids[p].tobytes(), "cells": cell[p].astype(np.int32).tobytes(), "x": x[p].tobytes(),
                 "nearest": near[p].tobytes(), "similarity": similarity[p].tobytes()} for p in pieces]

    def to_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ids, out = b.column("row").to_numpy(), b.column("id").to_numpy(), []
            for size, k, x in _usable_rows(b.column("embedding"), b.num_rows):
                if size in known.of:
                    cell, _ = known.own(size, x)
                    to = first[cell] + row[k] % np.maximum(1, parts[cell])
                    none = np.zeros(len(k), np.int64)
                    for j in np.unique(to):
                        m = to == j
                        out += sent(int(j), size, row[k][m], ids[k][m], cell[m], x[m], none[m], none[m].astype(np.float64))
            yield pa.RecordBatch.from_pylist(out, schema=_ASKED_ARROW)

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.to_pandas()
            for (size, done), part in f.groupby(["size", "done"], sort=False):
                for p in (part[a : a + BLOCK] for a in range(0, len(part), BLOCK)):
                    x = np.frombuffer(b"".join(p["x"])).reshape(-1, size)
                    row, ids, cell, near, similarity = (p[c].to_numpy() for c in ("row", "id", "cell", "nearest_id", "similarity"))
                    visit = known.least(size, x, cell) <= _distance(similarity)[:, None] + SLACK
                    for j in (j for j in size_of if size_of[j] == size and j != done):
                        m = visit[:, cells_of[j] - known.first[size]].any(1)
                        if m.any():
                            yield pa.RecordBatch.from_pylist(sent(j, size, row[m], ids[m], cell[m], x[m], near[m], similarity[m]), schema=_ASKED_ARROW)

    def asked_of(r) -> tuple[np.ndarray, np.ndarray, Asked]:
        read = lambda b, kind: np.frombuffer(b, kind)
        return read(r.rows, np.int64), read(r.ids, np.int64), (r.size, np.frombuffer(r.x).reshape(-1, r.size), read(r.cells, np.int32), read(r.similarity, np.float64), read(r.nearest, np.int64))

    def own(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out, c = [], Chunk(theirs)
        for r in ours.itertuples():
            row, ids, (size, x, cell, _, _) = asked_of(r)
            a = Asked(size, x, cell)
            a.meet_own(c)
            for s in (slice(i, i + BLOCK) for i in range(0, len(x), BLOCK)):
                part = Asked(size, x[s], cell[s], a.similarity[s], a.nearest[s])
                part.meet_others(c, known.least(size, x[s], cell[s]), known.first[size])
                a.similarity[s], a.nearest[s] = part.similarity, part.nearest
                a.met[s] += part.met
            out.append(_found(row, ids, a).to_pandas().assign(size=size, cell=cell, done=r.chunk, x=[v.tobytes() for v in x]))
        return pd.concat(out) if out else pd.DataFrame(columns=["row", "id", "nearest_id", "similarity", "compared", "size", "cell", "done", "x"])

    def others(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out, c = [], Chunk(theirs)
        for r in ours.itertuples():
            row, ids, told = asked_of(r)
            a = Asked(*told)
            for s in (slice(i, i + BLOCK) for i in range(0, len(row), BLOCK)):
                part = Asked(a.size, a.x[s], a.cell[s], a.similarity[s], a.nearest[s])
                part.meet_others(c, known.least(a.size, part.x, part.cell), known.first[a.size], own=True)
                out.append(_found(row[s], ids[s], part).to_pandas())
        return pd.concat(out) if out else pd.DataFrame(columns=["row", "id", "nearest_id", "similarity", "compared"])

    dealt = chunks.withColumn("stripe", F.explode(F.lit(list(range(stripes))))).select("chunk", "stripe", "size", "ids", "cells", "x")

    def by_chunk(ours: DataFrame, compare, schema: str, name: str) -> DataFrame:
        return stored(ours.groupBy("chunk", "stripe").cogroup(dealt.groupBy("chunk", "stripe")).applyInPandas(compare, schema), name)

    with batches_of(spark, 4 * block):
        near = by_chunk(plain.mapInArrow(to_own, _ASKED), own, f"{_FOUND}, size int, cell int, done int, x binary", "nearest-own")
        rest = by_chunk(near.mapInArrow(to_others, _ASKED), others, _FOUND, "nearest-rest")
    return _best(near.select(*rest.columns).unionByName(rest)).select(F.col("id").alias(key), "nearest_id", "similarity", "compared")


def paraphrase_pct(found: DataFrame, group: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """found: `group` and similarity of each sentence (null: no match)."""
    hit = F.when(F.col("similarity") >= config.paraphrase_threshold, 1).otherwise(0)
    sums = found.groupBy(group).agg(F.count("*").alias("total_sentences"), F.sum(hit).cast("long").alias("matched_sentences"))
    return sums.withColumn("paraphrase_pct", T.share(F.col("matched_sentences"), F.col("total_sentences")))


def paraphrase_sources(found: DataFrame, group: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    return found.filter(F.col("similarity") >= config.paraphrase_threshold).groupBy(group, "nearest_group").agg(F.count("*").alias("matched_sentences"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, vec_id, position, sentence, as embedders take them. vec_id is derived from document and
    position; rows that repeat a doc_id have sentences of the same vec_ids."""
    each = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")), letters_only=True)).alias("position", "sentence"))
    return each.select("doc_id", F.xxhash64("doc_id", "position").alias("vec_id"), "position", "sentence")


def sentence_vectors(docs: DataFrame, embedder) -> DataFrame:
    """`sentences` with their embeddings. embedder: a Column builder, such as `latent.embedder`."""
    return sentences(docs).withColumn("embedding", embedder(F.col("sentence")))
