"""Counts of characters, words, sentences and pages of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions import text as T


def basic_metrics(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One narrow projection; null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.length(text).cast("long").alias("char_count"), T.solid_length(text).cast("long").alias("char_count_no_spaces"),
        F.size(T.compound_words(text)).cast("long").alias("word_count"), F.size(T.sentences(text)).cast("long").alias("sentence_count"),
        F.size(T.paragraphs(text)).cast("long").alias("paragraph_count"))
    solid, n_words, n_sentences = F.col("char_count_no_spaces"), F.col("word_count"), F.col("sentence_count")
    pages = F.when(solid > 0, F.greatest(F.lit(1), F.ceil(solid / F.lit(float(config.page_norm_chars))))).otherwise(0)
    return base.select(
        "*", pages.cast("long").alias("page_count"),
        F.when(n_sentences > 0, T.rounded(n_words / n_sentences, 2)).otherwise(0.0).alias("avg_sentence_length"),
        T.rounded(n_words / F.lit(float(config.words_per_minute)), 2).alias("reading_time_minutes"))


def tokenized(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text, words, sentences, sentence_words: what the signals share, so that each text and each
    sentence is cut once."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", *also, text.alias("text"), T.words(text).alias("words"), T.sentences(text).alias("sentences"))
    return cut.withColumn("sentence_words", F.transform("sentences", T.words))


def content_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, content_hash, and the least doc_id of the same content."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc_id"))
    return hashed.join(first, "content_hash").select("doc_id", "content_hash", "first_doc_id")


def not_yet_stored(docs: DataFrame, stored_hashes: DataFrame) -> DataFrame:
    """doc_id, content_hash of each content that isn't among the stored ones: its least doc_id."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return first.join(stored_hashes.select("content_hash").distinct(), "content_hash", "left_anti").select("doc_id", "content_hash")


def by_id(table: DataFrame, value, key: str = "doc_id") -> DataFrame:
    """The rows of one key."""
    return table.filter(F.col(key) == value)


def lemmas(docs: DataFrame, analyser=None) -> DataFrame:
    """doc_id, lemmas: an array of (text, lemma, pos) of the letter-only words in lower case.

    analyser: a Column builder from an array of words to an array of (lemma, pos); without one the
    column is null.
    """
    kind = "array<struct<text:string,lemma:string,pos:string>>"
    if analyser is None:
        return docs.select("doc_id", F.lit(None).cast(kind).alias("lemmas"))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), 0)
    both = docs.select("doc_id", words.alias("w")).withColumn("a", analyser(F.col("w")))
    return both.select("doc_id", F.zip_with("w", "a", lambda w, a: F.struct(w.alias("text"), a["lemma"].alias("lemma"), a["pos"].alias("pos"))).cast(kind).alias("lemmas"))
