"""Exact n-gram Jaccard join with skipping by set relations.

Sets are ordered by one global order, corpus-frequent shingles last, then by hash. Sets that link
share a shingle among their first |s| - ceil(t|s|) + 1. These prefixes make index lists, each walked
in order of set size:

* block skipping: from a set on, a list is left at the first set too large for it, or for which its
  position leaves it too few shingles; entries whose own position leaves too few are passed over;
* a list longer than LIST is not paired up: its sets meet the list's leader alone first, and the list
  is done with if that connects them all;
* derived answers: every set is first compared with one highly similar set, its leader. That
  answers, without comparing, all pairs that leaders already connect, and all pairs of sets of a
  leader whose distances to it differ by more than 1 - t (Jaccard distance is a metric). The
  remaining pairs are compared exactly; pairs of long lists are found block against block.

Equal sets are one class from the start. Only order and cost depend on the frequency table, never
the result. What is broadcast has fixed size: HEAVY frequent shingles, a bitmap of ids.
Texts are read three times; sets move only for candidate pairs. Texts are shuffled only where so
many documents are candidates that the bitmap would let most texts through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import head_threshold, one_thread, stored
from lexloom.llm.components import components

#: Frequent shingles in the broadcast order table, at most.
HEAVY = 1 << 16
#: Entries of an index list that are paired directly.
LIST = 256
#: Entries of a block of a longer list.
BLOCK = 1500
#: Shingles counted together when looking for frequent ones.
COUNTED = 1_500_000
#: Bits of the bitmap of candidate ids; it serves for an eighth as many ids at most.
BITS = 1 << 24
_U = np.uint64


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word `size`-grams; fewer words: the whole sequence."""
    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, _U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    x = np.zeros(len(h) - size + 1, _U)
    for k in range(size):
        x = (x + h[k : len(h) - size + 1 + k]) * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(31)
    return np.unique(x)


class Measure:
    """100 * intersection >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.percent * n // 100) + 1

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least intersection that links sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def sizes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def bucket(self, n: Column) -> Column:
        """Sizes that can link are in the same bucket or in neighbouring ones."""
        width = max(math.log(100 / self.percent) * 1.001, 1e-6)
        return F.floor(F.ln(n) / F.lit(width))

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)


def parity(s: np.ndarray) -> bytes:
    """Bits that are set where an odd number of hashes fall; two sets differ in as many elements at least as bits."""
    bits = 64
    while bits < len(s) // 2:
        bits *= 2
    count = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference from two parity bitmaps, the longer one folded."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), 0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most HEAVY frequent shingles, and their counts as far as seen."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        held, n = [], 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"h": h[c > 1].view(np.int64), "n": c[c > 1]})

        for f in frames:
            for t in f["text"]:
                held.append(shingles(t, size))
                n += len(held[-1])
                if n >= COUNTED:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    table = stored(docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "jaccard-frequent")
    rows = table.filter(F.col("n") >= max(3, head_threshold(table, HEAVY))).collect()  # HEAVY rows at most
    h = np.array([r.h for r in rows], np.int64).view(_U)
    order = np.argsort(h)
    return h[order], np.array([r.n for r in rows], np.int64)[order]


def describe(docs: DataFrame, size: int, measure: Measure) -> DataFrame:
    """(doc_id, n, h1, h2, prefix, bits) of every row; null ids have no prefix."""
    heavy = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        h, c = heavy.value
        for whole in frames:
            for s in range(0, whole.num_rows, 1000):
                f = whole.slice(s, 1000)
                rows = []
                for t in f.column("text"):
                    x = shingles(t.as_py(), size)
                    raw = x.tobytes()
                    k = int(measure.prefix(len(x))) if len(x) else 0
                    first = x
                    if len(h) and len(x):
                        at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                        first = x[np.argsort(np.where(h[at] == x, c[at], 0), kind="stable")]
                    rows.append((len(x), xxhash.xxh3_64_intdigest(raw, 1), xxhash.xxh3_64_intdigest(raw, 2), first[:k].view(np.int64), parity(x)))
                n, h1, h2, prefix, bits = zip(*rows, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix)))
                yield pa.record_batch([f.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(np.array(x, _U).view(np.int64)) for x in (h1, h2)), lists, pa.array(bits, pa.binary())],
                                      names=["doc_id", "n", "h1", "h2", "prefix", "bits"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, prefix array<long>, bits binary")


def list_pairs(measure: Measure):
    """Rows (token, id, n, pos) sorted by token, n, id to candidate pairs (a, b, null...) of short
    lists, and to the entries of long ones."""

    def pairs(tok, own, n, pos):
        out = []
        at = np.arange(len(tok) - 1)
        lag = 1
        while len(at):
            at = at[at + lag < len(tok)]
            at = at[tok[at] == tok[at + lag]]
            x, y = at, at + lag
            at = at[measure.sizes(n[x], n[y]) & (n[x] - pos[x] >= measure.need(n[x], n[y]))]  # sorted by size: the rest of the list is skipped
            x, y = at, at + lag
            ok = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= measure.need(n[x], n[y])
            out.append((own[x[ok]], own[y[ok]]))
            lag += 1
        a, b = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        return pd.DataFrame({"a": both[0], "b": both[1], "token": None, "id": None, "n": None, "pos": None}).astype("Int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, hot = None, set()  # the unfinished last list; lists known to be long
        for f in frames:
            if rest is not None and len(rest):
                f = pd.concat((rest, f), ignore_index=True)
            tok = f["token"].to_numpy()
            if not len(tok):
                continue
            last = int(np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])[-1])
            if tok[-1] in hot or len(f) - last > LIST:
                hot.add(tok[-1])  # its entries go out as they come
                last = len(f)
            rest = f.iloc[last:]
            if last:
                yield from split(f.iloc[:last], hot)
            hot &= {tok[-1]}
        if rest is not None and len(rest):
            yield from split(rest, hot)

    def split(f, hot):
        tok = f["token"].to_numpy()
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        length = np.diff(np.r_[start, len(tok)])
        many = np.repeat((length > LIST) | np.isin(tok[start], list(hot)), length)
        if many.any():
            g = f[many]
            yield pd.DataFrame({"a": None, "b": None, "token": g["token"], "id": g["id"], "n": g["n"], "pos": g["pos"]}).astype("Int64")
        few = np.repeat(length > 1, length) & ~many
        if few.any():
            g = f[few]
            yield pairs(*(g[c].to_numpy() for c in ("token", "id", "n", "pos")))

    return run


def near_by_bits(pairs: DataFrame, facts: DataFrame, measure: Measure) -> DataFrame:
    """The pairs that sizes and parity bitmaps don't rule out. facts: (id, n, bits)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            na, nb = f["na"].to_numpy(), f["nb"].to_numpy()
            most = na + nb - 2 * measure.need(na, nb)
            ok = measure.sizes(na, nb) & np.array([differing(x, y) <= m for x, y, m in zip(f["xa"], f["xb"], most, strict=True)], bool)
            yield f.loc[ok, ["a", "b"]]

    a = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    b = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a long, b long")


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits that holds the hash of every id: fixed size, false hits at most."""
    h = ids.select(F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("h"))
    words = h.groupBy(F.expr("cast(h div 64 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits"))
    out = np.zeros(BITS // 64, np.int64)
    for at, bits in words.collect():  # BITS / 64 rows at most
        out[at] = bits
    return out.view(np.uint8)


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, data): the whole sets of the documents whose id is in `ids`, and of few others."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    if ids.count() > BITS // 8:  # a bitmap would let too many through
        return docs.join(ids, "id", "left_semi").mapInArrow(lambda frames: (_sets(f, size) for f in frames), "id long, data binary")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            h = f.column("h").to_numpy()
            yield _sets(f.filter(pa.array((bits.value[h >> 3] >> (h & 7) & 1).astype(bool))), size)

    return docs.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(BITS)).cast("int")).mapInArrow(run, "id long, data binary")


def _sets(f: pa.RecordBatch, size: int) -> pa.RecordBatch:
    return pa.record_batch([f.column("id"), pa.array([shingles(t.as_py(), size).tobytes() for t in f.column("text")], pa.binary())], names=["id", "data"])


def compare(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """(a, b, distance, linked) from the whole sets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for x, y in zip(f["xa"], f["xb"], strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                rows.append((1 - both / union, measure.linked(both, len(x), len(y))))
            distance, linked = zip(*rows, strict=True) if rows else ((), ())
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "distance": distance, "linked": linked})

    a, b = (sets.select(F.col("id").alias(k), F.col("data").alias(f"x{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a long, b long, distance double, linked boolean")


def fitting_blocks(entries: DataFrame, measure: Measure) -> DataFrame:
    """Entries (token, id, n, ...) of long lists with their block, once for each pair of blocks (lo, hi)
    in which they may meet a set that they link with."""
    entries = entries.withColumn("bucket", measure.bucket(F.col("n")))
    sizes = entries.groupBy("token", "bucket").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("blocks"))
    ranked = entries.join(sizes, ["token", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")) + F.shiftleft(F.col("bucket"), 32)).drop("blocks")
    # sets that link are of the same bucket of sizes or of neighbouring ones
    near = ranked.withColumn("near", F.explode(F.array(*(F.col("bucket") + k for k in (-1, 0, 1)))))
    sent = near.join(sizes.withColumnRenamed("bucket", "near"), ["token", "near"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.withColumn("other", F.col("other") + F.shiftleft(F.col("near"), 32))
    return sent.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("bucket", "near", "blocks", "other")


def long_list_pairs(entries: DataFrame, facts: DataFrame, state: DataFrame, measure: Measure) -> DataFrame:
    """Pairs of long lists that are still open, found block against block.

    state: (id, component, leader, distance). Lists whose sets are all connected are left out; of
    the others, each entry goes once to every block of its list that has sets of fitting sizes.
    """
    known = entries.join(state, "id", "left").select(
        "token", "id", "n", "pos", F.coalesce("component", "id").alias("component"), F.coalesce("leader", "id").alias("leader"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    known = stored(known, "jaccard-entries")
    entries = known.join(known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token"), "token", "left_semi")
    sent = fitting_blocks(entries, measure).join(facts.select("id", "bits"), "id")
    slack = 1 - measure.percent / 100 + 1e-9

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["n", "id"]).reset_index(drop=True)
        n, pos, block, own = (f[c].to_numpy() for c in ("n", "pos", "block", "id"))
        group, leader, distance = (f[c].to_numpy() for c in ("component", "leader", "distance"))  # no nulls: these are exact
        within = f["lo"].iloc[0] == f["hi"].iloc[0]
        width = min(len(x) for x in f["bits"])
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, _U).reshape(-1, width // 8), 0) for x in f["bits"]])
        out = []
        for i in range(len(f) - 1):
            j = np.arange(i + 1, len(f))
            j = j[: np.searchsorted(-measure.sizes(n[i], n[j]).astype(int), 0)]
            j = j[(group[j] != group[i]) & (within | (block[j] != block[i]))]
            need = measure.need(n[i], n[j])
            j = j[(np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & ~((leader[j] == leader[i]) & (np.abs(distance[j] - distance[i]) > slack))]
            if len(j):
                far = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
                j = j[far <= n[i] + n[j] - 2 * measure.need(n[i], n[j])]
                out.append(np.stack((np.minimum(own[i], own[j]), np.maximum(own[i], own[j]))))
        both = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": both[0], "b": both[1]})

    return sent.groupBy("token", "lo", "hi").applyInPandas(run, "a long, b long")


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the least doc_id reachable by links, itself included. Null and wordless texts
    have an empty set and link with nothing; rows with a null doc_id take no part and have a null
    component. Rows that repeat a doc_id are one document: they share a component. Texts of fewer
    than `size` words are one shingle, which differs from every longer text's. Very long texts are
    sets like others, whole. Other columns are not looked at, whatever their names. An empty table
    gives no rows.
    """
    measure = Measure(percent)
    docs = docs.select("doc_id", "text")
    table = stored(describe(docs, size, measure), "jaccard-docs")
    some = table.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    classes = stored(classes, "jaccard-copied")  # a plain join follows, which Spark splits where a class is large
    member = stored(some.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "rep").distinct(), "jaccard-classes")
    copies = member.filter("doc_id <> rep").select("doc_id").distinct()
    # a doc_id with several texts stays in as itself: only its copies of other sets are left out
    single = some.join(copies, "doc_id", "left_anti").unionByName(some.join(some.groupBy("doc_id").agg(F.countDistinct("h1", "h2").alias("k")).filter("k > 1").select("doc_id").join(copies, "doc_id", "left_semi"), "doc_id", "left_semi"))
    facts = stored(single.select(F.col("doc_id").alias("id"), "n", "bits").dropDuplicates(), "jaccard-facts")
    postings = single.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "token")).select("token", "id", "n", F.col("pos").cast("long").alias("pos"))
    spread = postings.repartition("token").sortWithinPartitions("token", "n", "id")
    lists = stored(spread.mapInPandas(list_pairs(measure), "a long, b long, token long, id long, n long, pos long"), "jaccard-lists")
    short = lists.filter("a is not null and a <> b").select("a", "b")
    long = lists.filter("token is not null").select("token", "id", "n", "pos")
    lead = long.groupBy("token").agg(F.min("id").alias("a"))
    led = long.join(lead, "token").filter("id <> a").select("a", F.col("id").alias("b"))
    pairs = stored(near_by_bits(short.unionByName(led).distinct(), facts, measure), "jaccard-pairs")
    # every set's leader first
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(long.select("id")).distinct()
    sets = stored(sets_of(docs, wanted, size), "jaccard-sets")
    known = stored(compare(first, sets, measure), "jaccard-first")
    links = known.filter("linked").select("a", "b")
    found = stored(components(links), "jaccard-state")
    state = known.select(F.col("b").alias("id"), F.col("a").alias("leader"), "distance").join(found, "id", "full").groupBy("id").agg(
        F.min("component").alias("component"), F.min_by("leader", "leader").alias("leader"), F.min_by("distance", "leader").alias("distance"))
    state = stored(state, "jaccard-state")
    sa = state.select(F.col("id").alias("a"), F.col("component").alias("ca"), F.col("leader").alias("la"), F.col("distance").alias("da"))
    sb = state.select(F.col("id").alias("b"), F.col("component").alias("cb"), F.col("leader").alias("lb"), F.col("distance").alias("db"))
    rest = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti").join(sa, "a", "left").join(sb, "b", "left").filter(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).filter(
        ~F.coalesce((F.col("la") == F.col("lb")) & (F.abs(F.col("da") - F.col("db")) > 1 - percent / 100 + 1e-9), F.lit(False))).select("a", "b")
    rest = rest.unionByName(long_list_pairs(long, facts, state, measure)).distinct()
    more = stored(compare(rest, sets, measure).filter("linked").select("a", "b"), "jaccard-more")
    # copies of a set hang on its representative
    final = components(links.unionByName(more).unionByName(member.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    return table.select("doc_id", "n").join(final, table["doc_id"] == final["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
