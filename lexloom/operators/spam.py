"""Word frequencies: the most used significant words and junk words of each document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions import text as T
from lexloom.functions.phrases import matches
from lexloom.lexicon import RUSSIAN, LexicalProfile
from lexloom.operators.style import among


def most_used(words: Column, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig()) -> Column:
    """An array of (word, cnt) of a row's most used significant words, in the order of `top_words`; many
    rows at once, and nothing is shuffled."""
    stop, most = pa.array(sorted(profile.stop_words), pa.string()), config.spam_top_words

    @F.arrow_udf("array<struct<word:string,cnt:bigint>>")
    def run(column: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = column.flatten().dictionary_encode()
        names, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.utf8_length(names)
        wide = pc.and_(pc.equal(size, 2), pc.match_substring_regex(names, r"[\x{10000}-\x{10FFFF}]"))  # three UTF-16 units or more
        good = pc.and_(pc.or_(pc.greater_equal(size, 3), wide), pc.invert(pc.is_in(names, value_set=stop))).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(good[code]) if len(names) else np.zeros(0, np.int64)
        key = np.repeat(np.arange(len(length)), length)[at] * max(1, len(names)) + code[at]
        key, first, count = np.unique(key, return_index=True, return_counts=True)
        owner = key // max(1, len(names))
        order = np.lexsort((first, -count, owner))
        order = order[np.arange(len(order)) - np.searchsorted(owner, owner) < most]  # owners are in order already
        found = pa.StructArray.from_arrays([names.take(pa.array(key[order] % max(1, len(names)))).cast(pa.string()), pa.array(count[order], pa.int64())], ["word", "cnt"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[order], minlength=len(length))))), pa.int32()), found)

    return run(words)


def top_sum(profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig()) -> Column:
    """How often a row has its most used significant words together."""
    return F.aggregate(most_used(F.col("words"), profile, config), F.lit(0).cast("long"), lambda n, x: n + x["cnt"])


def repeated(docs: DataFrame) -> DataFrame | None:
    """The ids that several rows have, null among them: such rows are one document. Null if there are none."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))
    return None if ids.isEmpty() else ids


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, word, cnt: all words of each document. They are counted row by row, many rows at once;
    only rows that share an id are counted together by shuffling."""
    @F.arrow_udf("array<struct<word:string,cnt:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        column = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), " ")
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = column.flatten().dictionary_encode()
        names, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, count = np.unique(np.repeat(np.arange(len(length)), length) * max(1, len(names)) + code, return_counts=True)
        owner, code = np.divmod(key, max(1, len(names)))
        found = pa.StructArray.from_arrays([names.take(pa.array(code)).cast(pa.string()), pa.array(count, pa.int64())], ["word", "cnt"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(length))))), pa.int32()), found)

    def counted(some: DataFrame) -> DataFrame:
        return some.select("doc_id", T.spaced(F.col("text")).alias("words")).select("doc_id", F.inline(run("words")))

    ids = repeated(docs)
    if ids is None:
        return counted(docs)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    again = counted(docs.join(ids, same, "left_semi")).groupBy("doc_id", "word").agg(F.sum("cnt").alias("cnt"))
    return counted(docs.join(ids, same, "left_anti")).unionByName(again)


def top_words(tokens: DataFrame, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig(), ids: DataFrame | None = None) -> DataFrame:
    """doc_id, rank, word, cnt: by count, then by first occurrence.

    Words are counted row by row; only rows that share an id are counted together by shuffling. ids: what
    `repeated` gives, if it is known.
    """
    ids = repeated(tokens) if ids is None else ids
    each = tokens.select("doc_id", F.posexplode(most_used(F.col("words"), profile, config)).alias("pos", "w")).select("doc_id", (F.col("pos") + 1).cast("long").alias("rank"), "w.word", "w.cnt")
    if ids is None:
        return each
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    each, tokens = each.join(ids, same, "left_anti"), tokens.join(ids, same, "left_semi")
    words = tokens.select("doc_id", F.posexplode_outer("words").alias("pos", "word")).filter(F.col("word").isNotNull() & (T.utf16_length(F.col("word")) >= 3) & ~F.col("word").isin(*profile.stop_words))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("cnt"), F.min("pos").alias("first"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("cnt"), "first"))
    return each.unionByName(counts.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= config.spam_top_words).select("doc_id", "rank", "word", "cnt"))


def phrase_counts(tokens: DataFrame, phrases) -> DataFrame:
    """doc_id, matches, distinct_phrases: junk entries of any number of words, as whole words, in one
    pass over each text. Entries are cut into words as texts are; `columns` counts single words only."""
    entries = [f" {' '.join(p.lower().split())} " for p in phrases]
    found = matches(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), entries)
    each = tokens.select("doc_id", found.alias("m"))
    return each.select("doc_id", F.size("m").cast("long").alias("matches"), F.size(F.array_distinct(F.transform("m", lambda x: x["phrase"]))).cast("long").alias("distinct_phrases"))


def columns(profile: LexicalProfile = RUSSIAN) -> dict[str, Column]:
    """What doesn't need counts by word, as columns over `metrics.tokenized`."""
    return {"total_words": F.size("words").cast("long"), "junk_words": F.size(F.filter("words", lambda w: among(w, profile.junk_words))).cast("long")}


def spam(tokens: DataFrame, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, total_words, spam_pct, junk_words, junk_words_pct; the shares are of all words."""
    ids = repeated(tokens)
    if ids is None:
        both = tokens.select("doc_id", *(c.alias(name) for name, c in columns(profile).items()), top_sum(profile, config).alias("top"))
    else:
        top = top_words(tokens, profile, config, ids).groupBy("doc_id").agg(F.sum("cnt").alias("top"))
        both = tokens.select("doc_id", *(c.alias(name) for name, c in columns(profile).items())).join(top, "doc_id", "left")
    return both.select("doc_id", "total_words", T.share(F.coalesce("top", F.lit(0)), F.col("total_words")).alias("spam_pct"),
                       "junk_words", T.share(F.col("junk_words"), F.col("total_words")).alias("junk_words_pct"))
