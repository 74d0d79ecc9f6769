"""Ball k-means: Lloyd's k-means in whole numbers, with most distances ruled out by balls.

Vectors lie in blocks, each with the cluster of every vector. A cluster is a ball: its centroid and
the radius that holds all members. Twice the radius tells which centroids are neighbours, the only
ones that can win a member. Within a block, members nearer to their centroid than half of the way to
the nearest neighbour are the stable core and aren't compared at all; the others lie in annuli between
half the ways to the neighbours in turn, and those of an annulus are compared exactly with the
neighbours within it only. The result is that of comparing all with all, ties included.

Each round is a job that writes the blocks anew with their clusters, and beside them the blocks' sums,
counts and radii, from which Spark adds up the next centroids. So a lost executor costs a re-read.
The table of the round before is removed when its successor is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import new_path, one_thread, small_batches

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Whole components beyond this could give squared distances beyond a long.
LARGEST = 1 << 27
#: Vectors of a block at most, and of the part of it that is worked on at once.
BLOCK, PART = 65_536, 8_192
NAMES = ["ids", "x", "cluster", "distance", "counts", "sums", "radii", "inertia"]
BLOCKS = "ids array<bigint>, x binary, cluster binary, distance binary, counts binary, sums binary, radii binary, inertia array<string>"


def kept_vectors(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id, embedding of the vectors that take part: `size` components, none null or non-finite,
    none whose squared distances could leave a long."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST / SCALE))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == size) & F.coalesce(good, F.lit(False))).select("vec_id", "embedding")


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as longs."""
    return np.floor(SCALE * x.astype(np.float64)).astype(np.int64)


def _number(x: np.ndarray) -> np.ndarray:
    """The numbers to calculate with: doubles where all sums of squares are exact in them."""
    return x.astype(np.float64) if not x.size or np.abs(x).max() <= 1 << 21 else x


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None, near: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, from the clusters of the round before and the
    centroids that are near them (a ball's neighbours), or from nothing."""
    both = _number(np.concatenate((x, centroids)))
    x, c = both[: len(x)], both[len(x) :]
    if cluster is None:
        best, least = np.zeros(len(x), np.int64), _squared(x, c[0])
        for j in range(1, len(c)):
            d = _squared(x, c[j])
            closer = d < least
            best[closer], least[closer] = j, d[closer]
        return best, least
    best, least = cluster.astype(np.int64), np.empty(len(x), np.int64)
    for i in np.unique(cluster):
        at = np.flatnonzero(cluster == i)
        own = _squared(x[at], c[i])
        least[at] = own
        gaps = sorted((int(((centroids[i] - centroids[j]) ** 2).sum()), j) for j in near[i])
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        for gap, j in gaps:  # annulus by annulus; what is nearer than half the gap is left out from here on
            out = at[np.searchsorted(own, -(-gap // 4)) :]
            if not len(out):
                break
            d = _squared(x[out], c[j])
            closer = (d < least[out]) | (d == least[out]) & (j < best[out])
            best[out[closer]], least[out[closer]] = j, d[closer]
    return best, least


def neighbours(centroids: np.ndarray, radii: list[int], moved: np.ndarray) -> list[list[int]]:
    """For each ball the centroids that can win a member: not farther than twice its radius, which is
    the one before and the way that the centroid has moved, rounded up."""
    near = []
    for i, r in enumerate(radii):
        radius = math.isqrt(r) + 1 + math.isqrt(int(moved[i])) + 1
        near.append([j for j in range(len(centroids)) if j != i and int(((centroids[i] - centroids[j]) ** 2).sum()) <= 4 * radius * radius])
    return near


def _listed(ids: pa.Array) -> pa.Array:
    """All ids as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding to blocks of whole components, as narrow as they fit."""
    one_thread()
    ids, parts, held = [], [], 0

    def block() -> pa.RecordBatch:
        x = np.concatenate(parts)
        kind = next(k for k in ("<i2", "<i4") if np.abs(x).max() <= np.iinfo(k).max)
        none = pa.array([None], pa.binary())
        row = [_listed(pa.concat_arrays(ids)), pa.array([x.astype(kind).tobytes()], pa.binary()), *[none] * 5, pa.array([None], pa.list_(pa.string()))]
        return pa.record_batch(row, names=NAMES)

    for b in batches:
        if not b.num_rows:
            continue
        e = b.column("embedding")
        ids.append(b.column("vec_id").cast(pa.int64()))
        parts.append(whole(e.flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1))
        held += b.num_rows
        if held >= BLOCK:
            yield block()
            ids, parts, held = [], [], 0
    if held:
        yield block()


def matrix(raw: bytes, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * rows * size else "<i4").reshape(rows, size).astype(np.int64)


def _assigned(centroids: np.ndarray, near: list[list[int]], size: int):
    """A round over blocks: clusters, distances, and the blocks' counts, sums and squared radii."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("ids").slice(r, 1)
                rows = len(ids[0])
                raw, before = b.column("x")[r].as_py(), b.column("cluster")[r].as_py()
                x, cluster, distance = matrix(raw, rows, size), np.empty(rows, np.int64), np.empty(rows, np.int64)
                for s in range(0, rows, PART):
                    old = None if before is None else np.frombuffer(before, np.uint8)[s : s + PART]
                    cluster[s : s + PART], distance[s : s + PART] = nearest(x[s : s + PART], centroids, old, near)
                counts, sums, radii, inertia = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64), [0] * k
                for i in range(k):
                    own = cluster == i
                    counts[i], sums[i] = own.sum(), x[own].sum(0)
                    radii[i] = distance[own].max() if counts[i] else 0
                    inertia[i] = int(distance[own].sum(dtype=np.int64 if radii[i] < 1 << 46 else object))
                cells = [raw, cluster.astype(np.uint8).tobytes(), distance.astype("<i8").tobytes(), counts.tobytes(), sums.tobytes(), radii.tobytes()]
                yield pa.record_batch([ids, *(pa.array([c], pa.binary()) for c in cells), pa.array([list(map(str, inertia))])], names=NAMES)

    return run


def _summed(k: int, size: int):
    """A row for each cluster of the blocks of a partition: count, inertia, squared radius, sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, radii, inertia = [0] * k, np.zeros((k, size), object), [0] * k, [0] * k
        for b in batches:
            for c, s, r, more in zip(*(b.column(n).to_pylist() for n in ("counts", "sums", "radii", "inertia")), strict=True):
                c, r, s = np.frombuffer(c, np.int64), np.frombuffer(r, np.int64), np.frombuffer(s, np.int64).reshape(k, size)
                for i in range(k):
                    counts[i], radii[i], inertia[i] = counts[i] + int(c[i]), max(radii[i], int(r[i])), inertia[i] + int(more[i])
                    sums[i] += s[i].astype(object)
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(counts, pa.int64()), pa.array([str(v) for v in inertia]), pa.array(radii, pa.int64()), pa.array([[str(v) for v in row] for row in sums], pa.list_(pa.string()))],
                              names=["cluster", "n", "inertia", "radius", "sums"])

    return run


def _remove(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ball_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid of each vector of
    `vectors` (vec_id, embedding) that takes part; see kept_vectors.

    Centroids start as the vectors with the least SHA-256 of `<seed>:<vec_id>`, all of them where
    there are fewer. Rows that repeat a vec_id are vectors each; of equal digests the vector that is
    less in its components comes first. A null vec_id counts as an empty one in the digest. Of
    equally near centroids the one of the smaller number wins, so of equal centroids all but the
    first stay empty, and where they are. Other columns are not looked at, whatever their names. An
    empty table gives no rows. At most 256 clusters.
    """
    if not 1 <= clusters <= 256:
        raise ValueError("clusters has to be between 1 and 256")
    spark = vectors.sparkSession
    good = kept_vectors(vectors, size)
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = good.orderBy(start, "embedding").limit(clusters).select("embedding").collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], out)
    centroids = whole(np.array([r.embedding for r in first], np.float64))
    k = len(centroids)
    path = new_path(spark, "balls")
    good.mapInArrow(_blocks, BLOCKS).write.option("compression", "zstd").parquet(path)
    near = [[j for j in range(k) if j != i] for i in range(k)]
    for number in range(rounds + 1):
        blocks, after = spark.read.schema(BLOCKS).parquet(path), new_path(spark, "balls")
        with small_batches(spark, 4):  # a row is a whole block
            blocks.mapInArrow(_assigned(centroids, near, size), BLOCKS).write.option("compression", "zstd").parquet(after)
        _remove(spark, path)
        path = after
        done = spark.read.schema(BLOCKS).parquet(path)
        big = "decimal(38,0)"
        parts = done.select("counts", "sums", "radii", "inertia").mapInArrow(_summed(k, size), "cluster int, n long, inertia string, radius long, sums array<string>")
        sums = parts.groupBy("cluster").agg(
            F.sum("n").alias("n"), F.sum(F.col("inertia").cast(big)).cast("string").alias("inertia"), F.max("radius").alias("radius"),
            F.array(*(F.sum(F.col("sums")[i].cast(big)).cast("string") for i in range(size))).alias("sums")).collect()  # a row for each cluster
        if number == rounds:
            break
        old, radii = centroids.copy(), [0] * k
        for r in sums:
            radii[r.cluster] = r.radius
            if r.n:
                centroids[r.cluster] = [int(s) // r.n for s in r.sums]
        near = neighbours(centroids, radii, ((centroids - old) ** 2).sum(1))
    inertia = {r.cluster: int(r.inertia) for r in sums}
    total = sum(inertia.values())
    lists = [c.tolist() for c in centroids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("ids").slice(r, 1).flatten()
                cluster = np.frombuffer(b.column("cluster")[r].as_py(), np.uint8)
                yield pa.record_batch([ids, pa.array(cluster.astype(np.int32)), pa.array(np.frombuffer(b.column("distance")[r].as_py(), "<i8"))], names=["vec_id", "cluster", "distance"])

    # a long that an inertia doesn't fit in is null
    fits = lambda v: F.lit(v if v < 1 << 63 else None).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    each = done.select("ids", "cluster", "distance").mapInArrow(rows, "vec_id long, cluster int, distance long")
    return each.select("vec_id", "cluster", "distance", of([fits(inertia[i]) for i in range(k)]).alias("cluster_inertia"), fits(total).alias("inertia"),
                       of([F.array(*(F.lit(v).cast("long") for v in c)) for c in lists]).alias("centroid"))


def digest(vectors: DataFrame) -> DataFrame:
    """ball_kmeans with centroid_sha256 in place of the centroid: of its components, joined by commas."""
    return ball_kmeans(vectors).withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")
