"""Copied passages: shingle tables, candidate gate, exact verification, self-copying, rare shingles.

All joins are equi-joins on hashes that Spark can shuffle or broadcast as sizes turn out; repeated
shingles are reduced to distinct ones with counts before any join. Hashes are unnested with
explode_outer: before a plain explode Spark filters on the array's size, which would compute them twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lexloom.config import EngineConfig
from lexloom.functions import minhash
from lexloom.functions import text as T
from lexloom.storage import stored


#: Distinct hashes up to which all tasks get them, 4 bytes each; bits of the filter that goes in their place beyond.
SENT, FILTER_BITS = 1 << 23, 1 << 26


def hashed(docs: DataFrame, config: EngineConfig = EngineConfig(), *also: str) -> DataFrame:
    """doc_id, hashes: those of all shingles, as an array by position. Documents may come with them."""
    if "hashes" in docs.columns:
        return docs.select("doc_id", *also, "hashes")
    return docs.select("doc_id", *also, T.phrase_hashes(T.spaced(F.coalesce("text", F.lit(""))), config.shingle_size).alias("hashes"))


class Known:
    """Hashes that tasks look for in documents. Up to SENT of them are sent whole; of more, a filter of
    FILTER_BITS bits goes, which lets all of them pass and others too: `exact` says which."""

    def __init__(self, hashes: DataFrame):
        each = hashes.select("hash").distinct()
        n = each.count()
        self.exact = n <= SENT
        self.bits = min(FILTER_BITS, 1 << max(13, (64 * n).bit_length()))
        self.held, self.words = None, np.zeros(self.bits // 64, np.uint64)
        if self.exact:
            self.held = np.sort(each.toPandas()["hash"].to_numpy(np.uint32))
            slots = self.held.astype(np.uint64) & np.uint64(self.bits - 1)
            np.bitwise_or.at(self.words, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
        else:
            slot = F.col("hash").bitwiseAND(self.bits - 1)
            some = each.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("bit"))
            rows = some.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # of fixed size, whatever the corpus
            self.words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash is known, or may be."""
        slots = hashes.astype(np.uint64) & np.uint64(self.bits - 1)
        out = (self.words[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)
        if self.exact and len(self.held):
            at = np.flatnonzero(out)
            mine = hashes[at].astype(np.uint32)
            out[at] = self.held[np.minimum(np.searchsorted(self.held, mine), len(self.held) - 1)] == mine
        return out

    def of(self, hashes: Column) -> Column:
        """The distinct ones of a document's hashes that are known, or may be."""

        @F.arrow_udf("array<bigint>")
        def run(column: pa.Array) -> pa.Array:
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(self.has(flat))
            owner, mine = np.repeat(np.arange(len(length)), length)[at], flat[at]
            order = np.lexsort((mine, owner))
            owner, mine = owner[order], mine[order]
            new = np.ones(len(mine), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (mine[1:] != mine[:-1])
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(length)))))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mine[new], pa.int64()))

        return run(hashes)


def hash_counts(hashes: Column) -> Column:
    """An array of (hash, rows) of a row's distinct hashes and how many positions hold each; many rows at once."""

    @F.arrow_udf("array<struct<hash:bigint,rows:bigint>>")
    def run(column: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.repeat(np.arange(len(length), dtype=np.int64) << 32, length) | column.flatten().to_numpy(zero_copy_only=False)
        key, count = np.unique(key, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(length) + 1, dtype=np.int64) << 32)
        found = pa.StructArray.from_arrays([pa.array(key & T.MASK), pa.array(count, pa.int64())], ["hash", "rows"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return run(hashes)


def shingle_table(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, pos, phrase, hash: a row for each position."""
    words = T.words(F.coalesce("text", F.lit("")))
    cut = docs.select("doc_id", T.shingles(words, config.shingle_size).alias("phrase"), T.shingle_hashes(words, config.shingle_size).alias("hash"))
    both = cut.select("doc_id", F.posexplode_outer(F.arrays_zip("phrase", "hash")).alias("pos", "s")).filter("pos is not null")
    return both.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("s.phrase").alias("phrase"), F.col("s.hash").alias("hash"))


def distinct_hashes(docs: DataFrame, config: EngineConfig = EngineConfig(), *also: str) -> DataFrame:
    """doc_id, hash: made within each document, without a shuffle."""
    return hashed(docs, config, *also).select("doc_id", *also, F.explode_outer(F.array_distinct("hashes")).alias("hash")).filter("hash is not null")


def counted_hashes(docs: DataFrame, config: EngineConfig = EngineConfig(), *also: str) -> DataFrame:
    """doc_id, hash, rows: how many positions of the document hold the hash."""
    each = hashed(docs, config, *also).select("doc_id", *also, F.explode_outer("hashes").alias("hash")).filter("hash is not null")
    return each.groupBy("doc_id", *also, "hash").agg(F.count("*").alias("rows"))


def total_shingles(config: EngineConfig) -> Column:
    """How many positions a text has, from the number of its words alone."""
    n = F.size(T.words(F.coalesce("text", F.lit("")))) - config.shingle_size + 1
    return F.greatest(F.lit(0), n).cast("long")


def positions(docs: DataFrame, config: EngineConfig) -> Column:
    """total_shingles, from the hashes if the documents come with them."""
    return F.size("hashes").cast("long") if "hashes" in docs.columns else total_shingles(config)


def totals(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, total_shingles of each row."""
    return docs.select("doc_id", positions(docs, config).alias("total_shingles"))


def signatures(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, chunk_no, signature of every window of shingles."""
    each = hashed(docs, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a document's windows are far larger than its hashes: some go on at a time
            windows, done = minhash.Windows(b.column("hashes"), config.chunk_shingles, config.chunk_step, config.signature_size), 0
            owner = np.repeat(np.arange(b.num_rows), windows.count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(windows.count) - windows.count, windows.count)
            for m in windows.minima():
                at = slice(done, done + len(m))
                done += len(m)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.int64()))
                yield pa.record_batch([b.column("doc_id").take(pa.array(owner[at])), pa.array(number[at], pa.int64()), values], names=["doc_id", "chunk_no", "signature"])

    return each.mapInArrow(run, each.select("doc_id").schema.add("chunk_no", "long").add("signature", ArrayType(LongType())))


def buckets(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, band, bucket: the distinct buckets of each document's windows."""
    all_of = minhash.document_buckets(F.col("hashes"), config.chunk_shingles, config.chunk_step, config.signature_size, config.bands)
    each = hashed(docs, config).select("doc_id", F.explode_outer(all_of).alias("b")).filter("b is not null")
    return each.select("doc_id", "b.band", "b.bucket")


def candidates(docs: DataFrame, corpus: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, corpus_doc_id that share a bucket. corpus: doc_id, text."""
    theirs = buckets(corpus, config).withColumnRenamed("doc_id", "corpus_doc_id")
    return buckets(docs, config).join(theirs, ["band", "bucket"]).select("doc_id", "corpus_doc_id").distinct()


def scanned(docs: DataFrame, theirs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, total_shingles, held, buckets of every row: its hashes that `theirs` (hash) may have, and the
    LSH buckets of rows that have some. Texts are read and hashed once, and nothing is shuffled."""
    each = hashed(docs, config).withColumn("held", Known(theirs).of(F.col("hashes")))
    some = F.when(F.size("held") > 0, F.col("hashes"))
    if config.candidate_gate == "none":
        buckets = F.array().cast("array<struct<band:bigint,bucket:bigint>>")
    else:
        buckets = minhash.document_buckets(some, config.chunk_shingles, config.chunk_step, config.signature_size, config.bands)
    return stored(each.select("doc_id", F.size("hashes").cast("long").alias("total_shingles"), "held", buckets.alias("buckets")), "copy-scan")


def corpus_hashes(corpus: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """corpus_doc_id, hash, rows."""
    return stored(counted_hashes(corpus, config).withColumnRenamed("doc_id", "corpus_doc_id"), "copy-corpus")


def gated(each: DataFrame, theirs: DataFrame, corpus: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, corpus_doc_id, hash, rows (in the source) that pass the gate; each as `scanned` gives it."""
    found = each.select("doc_id", F.explode("held").alias("hash")).join(theirs, "hash")
    if config.candidate_gate == "none":
        return found
    sources = corpus.select("doc_id", "text").join(found.select(F.col("corpus_doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    known = buckets(sources, config).withColumnRenamed("doc_id", "corpus_doc_id")
    ours = each.select("doc_id", F.explode("buckets").alias("b")).select("doc_id", "b.band", "b.bucket")
    pairs = ours.join(known, ["band", "bucket"]).select("doc_id", "corpus_doc_id").distinct()
    return found.join(pairs, ["doc_id", "corpus_doc_id"], "left_semi")


def shared(docs: DataFrame, corpus: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, corpus_doc_id, hash, rows (in the source) that pass the gate.

    Only hashes that the corpus has leave their documents; signatures are made only of documents and
    sources that share one.
    """
    theirs = corpus_hashes(corpus, config)
    return gated(scanned(docs, theirs, config), theirs, corpus, config)


def copy_pct(docs: DataFrame, corpus: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Every document's positions, distinct matched hashes and their share.

    The share is of positions, so a text that repeats itself stays under 100.
    """
    theirs = corpus_hashes(corpus, config)
    each = scanned(docs, theirs, config)
    return _pct(each, gated(each, theirs, corpus, config))


def copied(docs: DataFrame, corpus: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """copy_pct and copy_sources, from one scan of the documents."""
    theirs = corpus_hashes(corpus, config)
    each = scanned(docs, theirs, config)
    found = stored(gated(each, theirs, corpus, config), "copy-found")
    return _pct(each, found), _sources(found)


def _pct(each: DataFrame, found: DataFrame) -> DataFrame:
    matched = found.groupBy("doc_id").agg(F.countDistinct("hash").alias("matched_shingles"))
    both = each.select("doc_id", "total_shingles").join(matched, "doc_id", "left").withColumn("matched_shingles", F.coalesce("matched_shingles", F.lit(0)))
    return both.withColumn("plagiarism_pct", T.share(F.col("matched_shingles"), F.col("total_shingles")))


def _sources(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "corpus_doc_id").agg(F.sum("rows").alias("matched_shingles"))


def copy_sources(docs: DataFrame, corpus: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, corpus_doc_id, matched_shingles: positions of the source, repeats counted."""
    return _sources(shared(docs, corpus, config))


def top_hashes(docs: DataFrame, config: EngineConfig = EngineConfig(), most: int = 100) -> DataFrame:
    """hash, positions, docs of the hashes with most positions, ties by hash: these are counted without
    their documents, which are looked up again for the hashes that are left."""
    each = hashed(docs, config).select(F.explode_outer("hashes").alias("hash")).filter("hash is not null")
    top = stored(each.groupBy("hash").agg(F.count("*").alias("positions")).orderBy(F.desc("positions"), "hash").limit(most), "top-hashes")
    held = hashed(docs, config).select("doc_id", F.explode_outer(Known(top).of(F.col("hashes"))).alias("hash")).filter("hash is not null")
    return top.join(held.groupBy("hash").agg(F.countDistinct("doc_id").alias("docs")), "hash").select("hash", "positions", "docs")


def self_copy_pct(docs: DataFrame, config: EngineConfig = EngineConfig(), author: str = "source", unique: bool = False) -> DataFrame:
    """Shares of shingles that another document of the same author has.

    A hash counts as matched if at least two documents of the author hold it, which a window over the
    hash tells: texts are hashed once, hashes are shuffled once, no pairs of documents. A row for each row of `docs`: rows that repeat a doc_id are one
    document, so they don't match each other, and have what the document matches in all; null ids match
    nothing. unique: whether no rows are known to share an id, so that hits needn't be told apart again.
    """
    own = distinct_hashes(docs, config, author).filter(F.col(author).isNotNull())
    same = W.partitionBy("hash", author)  # in this order a sort compares numbers, and authors of the same hash only
    hit = own.withColumns({"first": F.min("doc_id").over(same), "last": F.max("doc_id").over(same)}).filter("first < last")
    if config.only_previous:
        hit = hit.filter("first < doc_id")
    matched = hit.groupBy("doc_id").agg((F.count("hash") if unique else F.countDistinct("hash")).alias("matched_shingles"))
    total = F.when(F.col(author).isNotNull(), positions(docs, config)).otherwise(0)
    both = docs.select("doc_id", F.col(author).isNotNull().alias("enabled"), total.alias("total_shingles")).join(matched, "doc_id", "left")
    both = both.withColumn("matched_shingles", F.coalesce("matched_shingles", F.lit(0)))
    return both.withColumn("self_plagiarism_pct", T.share(F.col("matched_shingles"), F.col("total_shingles")))


def self_copy_sources(docs: DataFrame, config: EngineConfig = EngineConfig(), author: str = "source") -> DataFrame:
    """doc_id, other_doc_id, matched_shingles: positions of the other document of the author.

    Only hashes that two documents of an author hold count. Its documents that hold the same of these are
    one class, and hashes that the same classes hold are one passage; classes, which have numbers, are
    paired by passages, each two once, and become documents at the end, where what is paired is the result
    itself. Texts are hashed once, and their hashes shuffled once. Sets of hashes and of holders are told
    by their number and 128 bits.
    """
    def told(*columns: str) -> Column:
        """The set of a group's rows, whatever their order."""
        return F.struct(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(*columns, F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)))

    each = hashed(docs, config, author).filter(F.col(author).isNotNull() & F.col("doc_id").isNotNull())
    each = each.select("doc_id", author, F.explode_outer(hash_counts(F.col("hashes"))).alias("h")).filter("h is not null").select("doc_id", author, "h.hash", "h.rows")
    same = W.partitionBy("hash", author)
    several = each.withColumns({"first": F.min("doc_id").over(same), "last": F.max("doc_id").over(same)}).filter("first < last")
    own = stored(several.groupBy(author, "doc_id", "hash").agg(F.sum("rows").alias("rows")), "self-copy-hashes")
    sets = stored(own.groupBy(author, "doc_id").agg(told("hash", "rows").alias("set"), F.sum("rows").alias("all_rows")), "self-copy-sets")
    first = sets.groupBy(author, "set").agg(F.min("doc_id").alias("class"), F.count("*").alias("members"))
    numbered = stored(first.withColumn("number", F.monotonically_increasing_id()), "self-copy-numbers")
    shared_id = sets.groupBy("doc_id").agg((F.count("*") > 1).alias("authors"))  # an id with several authors
    member = stored(sets.join(numbered, [author, "set"]).join(shared_id, "doc_id").select(author, "doc_id", "class", "number", "members", "all_rows", "authors"), "self-copy-classes")
    classes = member.filter("doc_id = class")
    held = own.join(classes.select(author, "doc_id", "number"), [author, "doc_id"]).select("hash", author, "number", "rows")
    holders = held.groupBy("hash", author).agg(told("number").alias("passage")).filter("passage.n > 1")
    passages = held.join(holders, ["hash", author]).groupBy(author, "passage", "number").agg(F.sum("rows").alias("rows"))
    passages = stored(passages.select(author, "passage.*", "number", "rows"), "self-copy-passages")
    one, other = (passages.select("n", "x1", "x2", F.col("number").alias(name), F.col("rows").alias(f"{name}_rows")) for name in ("one", "other"))
    between = one.join(other, ["x1", "x2", "n"]).filter("one < other").groupBy("one", "other").agg(F.sum("one_rows").alias("one_rows"), F.sum("other_rows").alias("other_rows"))
    within = classes.filter("members > 1").select(F.col("number").alias("one"), F.col("number").alias("other"), F.lit(None).cast("long").alias("one_rows"), F.col("all_rows").alias("other_rows"))
    numbers, once = between.unionByName(within), member.filter("authors").isEmpty()
    if not once:
        numbers = stored(numbers, "self-copy-pairs")
    ways = F.array(F.struct("one", "other", F.col("other_rows").alias("matched_shingles")), F.struct(F.col("other").alias("one"), F.col("one").alias("other"), F.col("one_rows").alias("matched_shingles")))
    ways = numbers.select(F.explode(ways).alias("w")).select("w.*").filter("matched_shingles is not null")
    ours = member.select(F.col("number").alias("one"), "doc_id", "authors")
    theirs = member.select(F.col("number").alias("other"), F.col("doc_id").alias("other_doc_id"), F.col("authors").alias("other_authors"))
    pairs = ways.join(ours, "one").join(theirs, "other").filter("doc_id <> other_doc_id")
    if config.only_previous:
        pairs = pairs.filter("other_doc_id < doc_id")
    columns, both = ["doc_id", "other_doc_id", "matched_shingles"], F.col("authors") & F.col("other_authors")
    if once:
        return pairs.select(*columns)
    again = pairs.filter(both).groupBy("doc_id", "other_doc_id").agg(F.sum("matched_shingles").alias("matched_shingles"))
    return pairs.filter(~both).select(*columns).unionByName(again)


def rare_shingles(docs: DataFrame, corpus: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, sample_no, position, phrase: an even sample of the shingles that no source has.

    Positions are picked row by row, and only their phrases are made. The corpus's hashes go to all tasks,
    and nothing is shuffled; where they are too many (Known), those that documents have are joined back.
    """
    size, k = config.shingle_size, config.external_sample
    theirs = stored(distinct_hashes(corpus, config).select("hash").distinct(), "copy-corpus")
    known = Known(theirs)

    @F.pandas_udf("array<bigint>")
    def pick(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(hashes, held) -> np.ndarray:
            common = known.has(np.asarray(hashes, np.int64)) if known.exact else np.zeros(len(hashes), bool) if held is None else np.isin(hashes, held)
            rare = np.flatnonzero(~common)
            return rare if len(rare) <= k else rare[np.arange(k) * len(rare) // k]

        for hashes, helds in parts:
            yield pd.Series([one(*x) for x in zip(hashes, helds, strict=True)], dtype=object)

    cut = docs.select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("words"))
    if known.exact:
        cut = cut.withColumn("held", F.lit(None).cast("array<bigint>"))
    else:
        held = hashed(docs, config).select("doc_id", F.explode_outer(known.of(F.col("hashes"))).alias("hash")).join(theirs, "hash", "left_semi")
        cut = cut.join(held.groupBy("doc_id").agg(F.collect_set("hash").alias("held")), "doc_id", "left")  # a document's own at most
    picked = cut.select("doc_id", "words", F.posexplode_outer(pick(T.shingle_hashes(F.col("words"), size), "held")).alias("sample_no", "position")).filter("position is not null")
    phrase = F.array_join(F.slice("words", F.col("position").cast("int") + 1, size), " ")
    return picked.select("doc_id", F.col("sample_no").cast("long").alias("sample_no"), "position", phrase.alias("phrase"))


def not_indexed(index: DataFrame, removed: DataFrame) -> DataFrame:
    """An LSH index (corpus_doc_id, band, bucket) without the sources in `removed` (corpus_doc_id)."""
    return index.join(removed.select("corpus_doc_id").distinct(), "corpus_doc_id", "left_anti")


def indexed(index: DataFrame, sources: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The index with the buckets of `sources` (doc_id, text), once each; what it has of them goes."""
    new = buckets(sources, config).select(F.col("doc_id").alias("corpus_doc_id"), "band", "bucket")
    return not_indexed(index, new).unionByName(new)
