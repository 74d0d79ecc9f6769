"""Usable vectors of a table with an array column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty, every component finite, not all of them zero."""
    x = embedding
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(good & F.exists(x, lambda v: v != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """(rep, copies, embedding) of each distinct usable vector: least vec_id and number of rows."""
    good = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    return good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "embedding")


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def sample(vectors: DataFrame, total: int, most: int, seed: int) -> np.ndarray:
    """About `most` of the `total` embeddings, chosen by a hash of `rep`, as a matrix."""
    share = min(1_000_000, int(1_000_000 * most / max(1, total)) + 1)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"rep": f["rep"], "x": [np.asarray(v, "<f8").tobytes() for v in f["embedding"]]})

    rows = vectors.filter(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_000)) < share).select("rep", "embedding").mapInPandas(pack, "rep long, x binary").collect()
    return np.array([np.frombuffer(bytes(r.x), "<f8") for r in sorted(rows, key=lambda r: r.rep)])
