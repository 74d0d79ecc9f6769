"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id. A shard's graph is built in numpy, many
insertions in step, and kept as flat arrays (one neighbour array for each layer; points are
numbered by falling level, so each layer is a prefix). All queries go to all shards, whose best are
merged. Largest inner product becomes nearest distance by one more component, which gives all
vectors of a shard the same length. Equal vectors are one point of the graph. Points that the lowest
layer doesn't reach from the first one get a link from their nearest point that it does reach, and
every search starts from the first one too, so no point is lost to a cut-off part.

Scale: shards hold about SHARD vectors; the queries of a shard are searched in groups of at most
QUERIES, each with the shard's arrays at hand. The best of all shards are picked by a window that
keeps `k` rows of a query before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import one_thread, stored
from lexloom.llm.vectors import matrix, usable

#: Vectors of a shard, about; shards at least.
SHARD, LEAST = 30_000, 6
#: Queries searched together in a shard, about.
QUERIES = 50_000
#: Links of a point above the lowest layer, and on it.
LINKS, LINKS0 = 16, 32
#: Candidates kept while building and while searching.
BUILD, SEARCH = 64, 200
#: Points inserted or queries searched in step; points expanded at once.
STEP, EXPAND = 256, 4


class Graph:
    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    def similar(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.einsum("bd,bkd->bk", q, self.x[ids])

    def beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `width` points (-1: none) of a layer for each query, and their products, best first."""
        links = self.layers[layer]
        n, k = len(q), len(links)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k + 1), bool)
        seen[:, k] = True  # what -1 indexes
        ids = np.full((n, width), -1, np.int64)
        sim = np.full((n, width), -np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        sim[:, : start.shape[1]] = np.where(start >= 0, self.similar(q, start), -np.inf)
        done = np.ones((n, width), bool)
        done[:, : start.shape[1]] = start < 0
        seen[rows, start] = True
        live = np.arange(n)
        while len(live):
            s = np.where(done[live], -np.inf, sim[live])
            e = min(EXPAND, width)
            pick = np.argpartition(-s, e - 1, 1)[:, :e]
            good = np.isfinite(np.take_along_axis(s, pick, 1))
            keep = good.any(1)
            live, pick, good = live[keep], pick[keep], good[keep]
            if not len(live):
                break
            at = live[:, None]
            near = links[ids[at, pick]]
            near[~good] = -1
            done[at, pick] = True
            near = np.sort(near.reshape(len(live), -1), 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[at, near]] = -1
            seen[at, near] = True
            fresh = np.where(near >= 0, self.similar(q[live], near), -np.inf).astype(np.float32)
            ids2, sim2 = np.concatenate((ids[live], near), 1), np.concatenate((sim[live], fresh), 1)
            done2 = np.concatenate((done[live], near < 0), 1)
            top = np.argpartition(-sim2, width - 1, 1)[:, :width]
            ids[live], sim[live], done[live] = (np.take_along_axis(v, top, 1) for v in (ids2, sim2, done2))
        order = np.argsort(-sim, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entry points of layer `to` for each query."""
        start = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            if len(self.layers[layer]):
                start = self.beam(q, start, layer, 4)[0][:, :1]
        return start

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = self.descend(q, 0)  # a start that is point 0 stands for itself once
        return self.beam(q, np.concatenate((start, np.where(start == 0, -1, 0)), 1), 0, width)

    def reached(self) -> np.ndarray:
        """Whether the lowest layer leads from point 0 to each point."""
        links = self.layers[0]
        seen = np.zeros(len(links), bool)
        new = np.zeros(min(1, len(links)), np.int64)
        while len(new):
            seen[new] = True
            near = np.unique(links[new])
            new = near[(near >= 0) & ~seen[near]]
        return seen

    def mend(self) -> Graph:
        """Links to points that nothing leads to: one more column of neighbours a round."""
        while not (seen := self.reached()).all():
            lost = np.flatnonzero(~seen)[: 4 * STEP]
            near = np.concatenate([self.beam(self.x[lost[s : s + STEP]], np.zeros((len(lost[s : s + STEP]), 1), np.int64), 0, 8)[0][:, 0] for s in range(0, len(lost), STEP)])
            _, first = np.unique(near, return_index=True)  # one link a point and round
            column = np.full(len(self.x), -1, np.int64)
            column[near[first]] = lost[first]
            self.layers[0] = np.concatenate((self.layers[0], column[:, None]), 1)
        return self


def diverse(x: np.ndarray, own: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none), those nearer to it than to any chosen before."""
    v = x[ids]
    among = np.einsum("bid,bjd->bij", v, v)
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        clash = (chosen & (among[:, :, c] > sim[:, c : c + 1])).any(1)
        chosen[:, c] = (ids[:, c] >= 0) & (ids[:, c] != own) & ~clash & (chosen.sum(1) < most)
    # fill up with the nearest left out
    rank = np.where(chosen, 0, 1) * 1000 + np.arange(ids.shape[1])
    rank[(ids < 0) | (ids == own[:, None])] = 10**6
    take = np.argsort(rank, 1)[:, :most]
    out = np.take_along_axis(ids, take, 1)
    out[np.take_along_axis(rank, take, 1) >= 10**6] = -1
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def build(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, Graph]:
    """(order, graph): points x[order], augmented to one length, and their layers."""
    n = len(x)
    r = np.random.default_rng(seed)
    level = np.minimum((-np.log(r.random(n)) / np.log(LINKS)).astype(int), 8)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    x = x[order].astype(np.float64)
    norm = (x**2).sum(1)
    x = np.concatenate((x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]), 1).astype(np.float32)
    sizes = [int((level >= layer).sum()) for layer in range(int(level[0]) + 1)] if n else [0]
    graph = Graph(x, [np.full((s, LINKS if layer else LINKS0), -1, np.int64) for layer, s in enumerate(sizes)])
    done = 0
    while done < n:
        new = np.arange(done, min(n, done + min(STEP, max(16, done))))
        for layer in range(int(level[new[0]]), -1, -1):
            here = new[new < sizes[layer]]
            if not len(here):
                continue
            q = x[here]
            among = q @ q.T
            np.fill_diagonal(among, -np.inf)
            k = min(LINKS, len(here))
            mates = np.argsort(-among, 1)[:, :k]
            ids, sim = here[mates], np.take_along_axis(among, mates, 1)
            if done:
                old, s = graph.beam(q, graph.descend(q, layer) if layer < len(sizes) - 1 else np.zeros((len(q), 1), np.int64), layer, BUILD)
                ids, sim = np.concatenate((old, ids), 1), np.concatenate((s, sim), 1)
            ids = np.where(np.isfinite(sim), ids, -1)
            best = np.argsort(-sim, 1, kind="stable")[:, :BUILD]
            ids, sim = np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1)
            links = graph.layers[layer]
            links[here] = diverse(x, here, ids, sim, links.shape[1] // 2 if layer == 0 else links.shape[1]) if layer else np.pad(
                diverse(x, here, ids, sim, LINKS0 // 2), ((0, 0), (0, LINKS0 - LINKS0 // 2)), constant_values=-1)
            back(x, links, here)
        done = int(new[-1]) + 1
    return order, graph.mend() if n else graph


def back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Links from the new points' neighbours back to them, chosen anew where there are too many."""
    source = np.repeat(new, links.shape[1])
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    points, first, count = np.unique(target, return_index=True, return_counts=True)
    widest = int(count.max(initial=0))
    for s in range(0, len(points), 512):
        p, f, c = points[s : s + 512], first[s : s + 512], count[s : s + 512]
        extra = np.full((len(p), widest), -1, np.int64)
        col = np.arange(widest)[None]
        fits = col < c[:, None]
        extra[fits] = source[(f[:, None] + col)[fits]]
        ids = np.concatenate((links[p], extra), 1)
        ids = np.sort(ids, 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sim = np.where(ids >= 0, np.einsum("bd,bkd->bk", x[p], x[ids]), -np.inf)
        best = np.argsort(-sim, 1, kind="stable")[:, :BUILD]
        ids, sim = np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1)
        links[p] = diverse(x, p, ids, sim, links.shape[1])


def index(vectors: DataFrame, shards: int) -> DataFrame:
    """(shard, dim, ids, owners, original, x, sizes, layers): the shards' flat arrays as bytes."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        v, own = matrix(frame["embedding"]), frame["vec_id"].to_numpy()
        distinct, at = np.unique(v, axis=0, return_inverse=True)
        order, graph = build(distinct)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        point = place[at.ravel()]
        rank = np.lexsort((own, point))
        return pd.DataFrame({
            "shard": [frame["shard"].iloc[0]], "dim": [frame["dim"].iloc[0]], "ids": [own[rank].astype("<i8").tobytes()], "points": [point[rank].astype("<i4").tobytes()],
            "original": [distinct[order].astype("<f8").tobytes()], "x": [graph.x.astype("<f4").tobytes()],
            "sizes": [[x for a in graph.layers for x in a.shape]], "layers": [b"".join(a.astype("<i4").tobytes() for a in graph.layers)]})

    dealt = vectors.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), "dim": F.size("embedding")})
    return dealt.groupBy("shard", "dim").applyInPandas(make, "shard int, dim int, ids binary, points binary, original binary, x binary, sizes array<int>, layers binary")


def load(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    d = row["dim"]
    layers, at, flat = [], 0, np.frombuffer(row["layers"], "<i4").astype(np.int64)
    for s, width in np.reshape(row["sizes"], (-1, 2)):
        layers.append(flat[at : at + s * width].reshape(s, width))
        at += s * width
    graph = Graph(np.frombuffer(row["x"], "<f4").reshape(-1, d + 1), layers)
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["points"], "<i4"), np.frombuffer(row["original"], "<f8").reshape(-1, d), graph


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, width: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` largest inner products found for each query.

    Queries are the rows whose vec_id is divisible by `every`; a row isn't its own candidate.
    Vectors null, empty, zero or with null or non-finite components, and null ids, take no part.
    Vectors meet those of their own length. Ties go to the smaller vec_id. Repeated vec_ids:
    equal rows count once; of different rows of one id all are candidates for others and queries,
    whose best are merged. Other columns are not looked at, whatever their names. An empty table,
    or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    good = stored(vectors.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).distinct(), "ann-vectors")
    total = good.count()
    shards = max(LEAST, -(-total // SHARD))
    graphs = stored(index(good, shards), "ann-graphs")
    asked = good.filter(F.col("vec_id") % every == 0)
    groups = max(1, -(-asked.count() // QUERIES))
    left = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(groups)).cast("int").alias("part"),
                         F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def answer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        out = []
        if len(a) and len(b):
            ids, points, original, graph = load(a.iloc[0])
            first = np.searchsorted(points, np.arange(len(original) + 1))
            q, own = matrix(b["embedding"]), b["vec_id"].to_numpy()
            for s in range(0, len(q), STEP):
                x = np.pad(q[s : s + STEP], ((0, 0), (0, 1))).astype(np.float32)
                found, _ = graph.search(x, max(width, k + 1))
                for n, row in enumerate(found):
                    row = row[row >= 0]
                    score = original[row] @ q[s + n]
                    best = np.argsort(-score, kind="stable")[: k + 1]  # k + 1 points hold k candidates besides the query
                    edge = score[best[-1]]
                    best = np.flatnonzero(score >= edge)
                    got, what = [], []
                    for p in best:
                        same = ids[first[row[p]] : first[row[p] + 1]]
                        same = same[same != own[s + n]][:k]  # ascending
                        got.append(same)
                        what.append(np.full(len(same), score[p]))
                    got, what = np.concatenate(got), np.concatenate(what)
                    top = np.lexsort((got, -what))[:k]
                    out.append((own[s + n], got[top], what[top]))
        query, vec, score = zip(*out, strict=True) if out else ((), (), ())
        answers = pd.DataFrame({"query_id": np.repeat(np.array(query, np.int64), [len(v) for v in vec]), "vec_id": np.concatenate(vec) if vec else np.zeros(0, np.int64), "score": np.concatenate(score) if score else np.zeros(0)})
        return answers.drop_duplicates()

    keys = ["shard", "dim", "part"]
    answers = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
