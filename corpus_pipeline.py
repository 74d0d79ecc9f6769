"""From documents to packed training sequences, in four stages.

Each stage takes documents (doc_id, text, lang, source, n_chars; other columns are dropped, whatever
their names) and works on all of them, whole texts however long. Empty tables go through all stages.
Null doc_ids stay null, and ids are never rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import jaccard, langid, packing, toxicity
from lexloom.llm.common import fold, new_path, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is this uncertain goes; four languages by chance would have 0.25.
LEAST_CERTAIN = 0.3
#: Near-duplicates share this percentage of their distinct word n-grams of this size, at least.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learned: `und` and very uncertain ones go.

    Null, empty and letterless texts are `und`, so they go; so does everything where no labelled
    document can be learned from. Repeated rows are judged each, and alike. Of equally likely
    languages the first by name counts; a score of exactly LEAST_CERTAIN stays.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, fold(F.col("doc_id"), 4) != 2)
    found = langid.identify(docs, model, COLUMNS[1:])
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted toxic.

    Null and empty texts have the score of a text without words, which isn't toxic unless the labels
    say so of most texts; without toxic labels to learn from everything stays. A score of exactly 0.5
    is toxic. Repeated rows are judged each, and alike.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near-duplicates.

    Null, empty and wordless texts link with nothing and stay; so do rows with a null doc_id, which
    take no part. Rows that repeat a doc_id are one document, of which one row stays: the least by
    its columns.
    """
    docs = docs.select(*COLUMNS)
    gone = jaccard.join(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT).filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    if ids.isEmpty():
        return kept
    once = kept.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(ids, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their places in sequences of at most 2048 tokens.

    Null and empty texts are a piece of the end id alone; repeated rows are packed each; which of
    equal pieces takes which place is left open.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("toxicity", clean), ("n-gram Jaccard join", distinct), ("packing", packed)]
#: Trained models and tokenisation can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
