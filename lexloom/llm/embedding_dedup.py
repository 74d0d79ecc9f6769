"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves, each with its own k-means codebook; the pair of a vector's
nearest centroids is its cell of the product grid. Each vector visits the nearest cells in order
of the sum of both squared distances and meets those that live there; every pair met is verified
in double precision. How many cells are visited is calibrated: on sampled vectors and partners put
at the threshold itself, so many that the target share of the pairs is met from either side.

Traversal: the nearest `visits` cells all have ranks (a, b) in the two sorted lists of centroids
with (a + 1) * (b + 1) <= visits; the sum of the last one is the vector's reach, and it visits every
cell within reach. Distances are taken between whole numbers, so they are exact, and any task can
tell whether a vector visits a cell.

Equal vectors are one class. Rows of the grid that lie near each other form bands of about RESIDENTS
residents; a row with more is split into parts. A vector is sent once to each band it visits. Where
a pair meets from both sides, only one side counts it: so a task adds up links and joins vectors in
place, and puts out one row for each linked vector, not one for each pair. Counting the links of m
near copies still compares each with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexloom.llm.common import one_thread, stored
from lexloom.llm.components import components
from lexloom.llm.partition_words import binaries
from lexloom.llm.vectors import classes, sample, usable

#: Vectors that the codebooks are fitted on, at least and for each centroid; pairs that the visits
#: are calibrated on, about.
FIT, FIT_EACH, PAIRS = 20_000, 30, 400
#: Share of pairs at the threshold that the visits have to meet.
TARGET = 0.99
#: Vectors of a cell, about: the codebooks grow with the root of the table.
PER_CELL = 12
#: Residents of a band or of a part of a row, about.
RESIDENTS = 8000
#: Whole numbers that stand for 1 in distances.
GRAIN = 4096
#: Vectors placed together, and visitors compared together.
STEP, BLOCK = 250, 2000
#: Distances from visitors to centroids that a task holds at once, 64 MB.
DISTANCES = 8_000_000


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    if x.shape[1] == 0:  # the second half of one-dimensional vectors
        return np.zeros((1, 0))
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([squared(x[s : s + BLOCK], c).argmin(1) for s in range(0, len(x), BLOCK)])
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * GRAIN)


class MultiIndex:
    """Two codebooks of whole numbers. The first is in the order of its main direction, so rows of
    the grid with near numbers are near each other."""

    def __init__(self, x: np.ndarray, k: int):
        x = unit(x)
        self.cut = -(-x.shape[1] // 2)
        first, second = (k_means(h, k) for h in (x[:, : self.cut], x[:, self.cut :]))
        main = np.linalg.svd(first - first.mean(0), full_matrices=False)[2][0]
        self.books = [whole(first[np.argsort(first @ main, kind="stable")]), whole(second)]
        self.visits = len(first) * len(second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact squared distances of unit vectors to both codebooks: sums of whole numbers below 2**53
        come out alike in any order."""
        q = whole(x)
        return squared(q[:, : self.cut], self.books[0]), squared(q[:, self.cut :], self.books[1])

    def calibrate(self, x: np.ndarray, cosine: float, target: float = TARGET, seed: int = 9) -> MultiIndex:
        """Sets `visits` from partners at `cosine` to the given vectors, in random directions."""
        if x.shape[1] < 2:
            return self
        x, r = unit(x), np.random.default_rng(seed)
        away = r.normal(size=x.shape)
        away = unit(away - (away * x).sum(1, keepdims=True) * x)
        y = cosine * x + np.sqrt(1 - cosine**2) * away
        ranks = []
        for p, q in ((x, y), (y, x)):
            (a, b), (i, j) = self.distances(p), (d.argmin(1) for d in self.distances(q))
            at = a[np.arange(len(p)), i] + b[np.arange(len(p)), j]
            # cells before the partner's: for each centroid of one half, those of the other that still fit
            b.sort(1)
            ranks.append([sum(np.searchsorted(b[n], at[n] - a[n], "left")) for n in range(len(p))])
        rank = np.sort(np.minimum(*np.array(ranks)))
        self.visits = int(min(self.visits, 1 + rank[min(len(rank) - 1, int(np.ceil(target * len(rank))))]))
        return self

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distance of each vector's last visited cell."""
        a, b = np.sort(a, 1), np.sort(b, 1)
        pairs = [(i, j) for i in range(min(a.shape[1], self.visits)) for j in range(min(b.shape[1], self.visits // (i + 1)))]
        i, j = (np.array(v) for v in zip(*pairs, strict=True))
        n = min(self.visits, len(pairs))
        return np.partition(a[:, i] + b[:, j], n - 1, 1)[:, n - 1]


def bands(residents: np.ndarray, most: int = RESIDENTS) -> tuple[np.ndarray, np.ndarray]:
    """(band of each row of the grid, parts of each band): rows in order until a band is full."""
    band, parts, held = np.zeros(len(residents), np.int64), [], 0
    for row, n in enumerate(residents):
        if parts and (held + n > most):
            held = 0
        if not held:
            parts.append(1)
        band[row] = len(parts) - 1
        held += max(int(n), 1)
        parts[-1] = max(parts[-1], -(-held // most))
    return band, np.array(parts or [1])


def least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the edges i, j connect it with."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        new = new[new]
        if (new == low).all() and (low[i] == low[j]).all():
            return low
        low = new


def linked(distinct: DataFrame, cosine: float, target: float = TARGET) -> DataFrame:
    """(rep, n, low): links of each distinct vector that has any, counting copies, and a vector that
    it is connected with; rows for one rep add up. Vectors meet those of their own length."""
    spark = distinct.sparkSession
    sizes = {r.d: r.n for r in distinct.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = spark.createDataFrame([], "rep long, n long, low long")
    for d, total in sorted(sizes.items()):
        found = found.unionByName(_linked(distinct.filter(F.size("embedding") == d), d, total, cosine, target))
    return found


def _linked(distinct: DataFrame, d: int, total: int, cosine: float, target: float) -> DataFrame:
    spark = distinct.sparkSession
    k = max(1, int(np.sqrt(total / PER_CELL)))
    x = sample(distinct, total, max(FIT, FIT_EACH * k), 1)
    if not len(x):  # too few for the sample by hash: all of them
        x = sample(distinct, 1, 1, 1)
    index = MultiIndex(x, k).calibrate(x[:: max(1, len(x) // PAIRS)], cosine, target)
    kind = "<f4" if isinstance(distinct.schema["embedding"].dataType, ArrayType) and isinstance(distinct.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    shared = spark.sparkContext.broadcast(index)

    def rows(f: pa.RecordBatch) -> np.ndarray:
        return f.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def home(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        n = np.zeros(len(shared.value.books[0]), np.int64)
        for f in frames:
            for s in range(0, f.num_rows, BLOCK):
                n += np.bincount(shared.value.distances(unit(rows(f.slice(s, BLOCK)).astype(np.float64)))[0].argmin(1), minlength=len(n))
        yield pa.record_batch({"row": pa.array(np.flatnonzero(n)), "n": pa.array(n[n > 0])})

    lives = np.zeros(len(index.books[0]), np.int64)
    for r in distinct.select("embedding").mapInArrow(home, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect():  # a row for each centroid at most
        lives[r.row] = r.n
    band, parts = bands(lives)
    grid = spark.sparkContext.broadcast((band, np.flatnonzero(np.diff(band, prepend=-1)), parts))

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        band, starts, parts = grid.value
        for f in frames:
            for s in range(0, f.num_rows, STEP):
                g = f.slice(s, STEP)
                raw, rep, copies = rows(g).astype(kind), g.column("rep").to_numpy(), g.column("copies").to_numpy()
                a, b = shared.value.distances(unit(raw.astype(np.float64)))
                i, j, reach = a.argmin(1), b.argmin(1), shared.value.reach(a, b)
                own = band[i]
                at, to = np.nonzero(np.logical_or.reduceat(a + b.min(1)[:, None] <= reach[:, None], starts, axis=1))
                times = parts[to]
                at, to = np.repeat(at, times), np.repeat(to, times)
                part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.record_batch({
                    "band": pa.array(to.astype(np.int32)), "part": pa.array(part.astype(np.int32)), "lives": pa.array((own[at] == to) & (rep[at] % parts[to] == part)),
                    "rep": pa.array(rep[at]), "copies": pa.array(copies[at]), "i": pa.array(i[at].astype(np.int32)), "j": pa.array(j[at].astype(np.int32)), "reach": pa.array(reach[at]),
                    "x": binaries(raw[at].ravel(), np.full(len(at), d))})

    def meet(f: pa.Table) -> pa.Table:
        one_thread()
        x = unit(np.frombuffer(b"".join(f["x"].to_pylist()), kind).reshape(-1, d).astype(np.float64))
        rep, copies, i, j, reach = (f[c].to_numpy() for c in ("rep", "copies", "i", "j", "reach"))
        here = np.flatnonzero(f["lives"].to_numpy())
        place = np.zeros(len(x), np.int64)
        place[here] = np.arange(len(here))
        own_a, own_b = shared.value.distances(x[here])  # residents are few; visitors go by in blocks
        cell = i[here].astype(np.int64) * len(shared.value.books[1]) + j[here]
        order = np.argsort(cell, kind="stable")
        cells = np.split(here[order], np.flatnonzero(np.diff(cell[order])) + 1) if len(here) else []
        n, low = np.zeros(len(x), np.int64), np.arange(len(x))
        many = max(1, DISTANCES // sum(len(c) for c in shared.value.books))
        for start in range(0, len(x), many):
            a, b = shared.value.distances(x[start : start + many])
            for r in cells:
                visitors = start + np.flatnonzero(a[:, i[r[0]]] + b[:, j[r[0]]] <= reach[start : start + many])
                for s in range(0, len(visitors), BLOCK):
                    v = visitors[s : s + BLOCK]
                    hit = x[v] @ x[r].T >= cosine
                    p, q = np.nonzero(hit)
                    p, q = v[p], r[q]
                    twice = own_a[place[q], i[p]] + own_b[place[q], j[p]] <= reach[q]  # the resident visits the visitor's cell too
                    keep = (rep[p] != rep[q]) & ~(twice & (rep[p] > rep[q]))
                    p, q = p[keep], q[keep]
                    if len(p):
                        n += np.bincount(p, copies[q], len(x)).astype(np.int64) + np.bincount(q, copies[p], len(x)).astype(np.int64)
                        low = least(len(x), np.concatenate((p, np.arange(len(x)))), np.concatenate((q, low)))
        some = np.flatnonzero(n)
        # nodes are numbered by rows: the least rep of each joined set stands for it
        least_rep = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least_rep, low, rep)
        return pa.table({"rep": pa.array(rep[some]), "n": pa.array(n[some]), "low": pa.array(least_rep[low[some]])})

    schema = "band int, part int, lives boolean, rep long, copies long, i int, j int, reach double, x binary"
    placed = distinct.select("rep", "copies", "embedding").mapInArrow(place, schema)
    return placed.groupBy("band", "part").applyInArrow(meet, "rep long, n long, low long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    vec_id, link with nothing: n_links 0, their own component, kept. Equal vectors link with each
    other. Vectors of different lengths don't link; one-dimensional ones link by sign. Rows that
    repeat a vec_id with other vectors are one node: they share links and component. Other columns are not looked at, whatever their names. An empty table
    gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    distinct = stored(classes(vectors), "vector-classes")
    found = stored(linked(distinct, cosine, target), "vector-links")
    others = found.groupBy("rep").agg(F.sum("n").alias("linked"))
    joined = components(found.select(F.col("low").alias("a"), F.col("rep").alias("b"))).select(F.col("id").alias("rep"), "component")
    facts = distinct.join(others, "rep", "left").join(joined, "rep", "left").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    facts = stored(facts, "vector-facts")  # a plain join follows, which Spark splits where a vector is common
    able = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    good = vectors.filter(able).join(facts, "embedding").select("vec_id", "n_links", "component_id")
    rest = vectors.filter(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
