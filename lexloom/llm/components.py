"""Connected components of a graph that no single task or driver could hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import stored


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over each batch: every node's edge to the least node it is joined with there."""
    for f in frames:
        nodes, at = np.unique(np.concatenate((f["a"].to_numpy(), f["b"].to_numpy())), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(at[: len(f)].tolist(), at[len(f) :].tolist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        low = np.array([root(x) for x in range(len(nodes))], np.int64)
        far = np.flatnonzero(low != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[low[far]], "b": nodes[far]})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of `edges` (a, b longs): the least id reachable.

    Alternating large-star and small-star steps after a contraction within partitions; each step
    is stored in the shared folder. A node's edges meet by way of aggregates, never as a list.
    """
    edges = stored(edges.filter("a is not null and b is not null and a <> b").select("a", "b").mapInPandas(_contract, "a long, b long").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        # minima are stored before they are joined: Spark splits a plain join where a node has many edges
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "edges-low")
        # large star: each larger neighbour of a node gets the least of its neighbourhood
        large = stored(both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct(), "edges-large")
        # small star: each node and its smaller neighbours get the least of them
        low = stored(large.groupBy("b").agg(F.min("a").alias("low")), "edges-low")
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("a").alias("b")), F.struct(F.col("low").alias("a"), "b"))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).first()
        if now == state or now[0] == 0:
            break
        state = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
