"""Grammar findings: a row for each error, counts by category.

Errors come from a checker: a function from documents to rows (doc_id, rule_id, category, message,
position, length), positions and lengths in UTF-16 units. The default one has four local rules; it
doesn't equal a full grammar checker. `sources.providers.GrammarService` asks an outside one. A checker
may have a column `error`: where it isn't null, the document couldn't be checked, and says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import starts, utf16_length
from lexloom.storage import stored

OTHER = "Other"
RULES = (
    ("DOUBLE_SPACE", "TYPOGRAPHY", "Repeated blank", r"[^\s]  +[^\s]"),
    ("REPEATED_WORD", "GRAMMAR", "Repeated word", r"(?iu)(?<![\p{L}\p{N}])(\p{L}+)\s+\1(?![\p{L}\p{N}])"),
    ("NO_SPACE", "TYPOGRAPHY", "Missing blank after punctuation", r"\p{L}[,;:]\p{L}"),
    ("SPACE_BEFORE", "TYPOGRAPHY", "Blank before punctuation", r"\p{L} +[,;:.!?]"),
)


def local_errors(docs: DataFrame) -> DataFrame:
    """A row for each match of a rule: what stands between the matches and they themselves, in turn,
    give the positions. Nothing is shuffled."""
    text = F.coalesce("text", F.lit(""))

    def entry(rule: tuple[str, str, str, str]) -> Column:
        name, category, message, rx = rule
        units = lambda parts: F.transform(parts, lambda x: utf16_length(x).cast("long"))
        hits = F.regexp_extract_all(text, F.lit(rx), 0)
        return F.struct(F.lit(name).alias("rule_id"), F.lit(category).alias("category"), F.lit(message).alias("message"), units(hits).alias("hits"), units(F.split(text, rx)).alias("gaps"))

    each = docs.select("doc_id", F.explode(F.array(*map(entry, RULES))).alias("r")).select("doc_id", "r.*").filter(F.size("hits") > 0)
    placed = each.withColumn("at", starts(F.slice("gaps", F.lit(1), F.size("hits")), F.col("hits")))
    return placed.select("doc_id", "rule_id", "category", "message", F.explode(F.arrays_zip("at", "hits")).alias("p")).select(
        "doc_id", "rule_id", "category", "message", F.col("p.at").alias("position"), F.col("p.hits").alias("length"))


def errors(docs: DataFrame, checker=local_errors) -> DataFrame:
    """doc_id, rule_id, category, message, position, length; a missing category is OTHER. Documents that
    couldn't be checked have no rows; see `failures`."""
    found = checker(docs)
    if "error" in found.columns:
        found = found.filter("error is null").drop("error")
    return found.withColumn("category", F.coalesce("category", F.lit(OTHER)))


def failures(docs: DataFrame, checker) -> DataFrame | None:
    """doc_id, error of the documents that couldn't be checked; null for checkers that can't fail so."""
    found = checker(docs)
    return found.filter("error is not null").groupBy("doc_id").agg(F.min("error").alias("error")) if "error" in found.columns else None


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "category").agg(F.count("*").alias("errors"))


def local_count(text: Column) -> Column:
    """How many errors the local rules find, without their rows."""
    total = F.lit(0).cast("long")
    for _, _, _, rx in RULES:
        total = total + F.regexp_count(text, F.lit(rx)).cast("long")
    return total


def grammar(docs: DataFrame, checker=local_errors) -> DataFrame:
    """doc_id, grammar_errors, grammar_by_category (a map) and errors (in the text's order) for every
    document; nulls and `error` for those that couldn't be checked, if the checker has that column."""
    checked = checker(docs)
    if "error" in checked.columns:
        checked = stored(checked, "grammar")  # the service is asked once for each document
    found, failed = errors(docs, lambda _: checked), failures(docs, lambda _: checked)
    entry = F.struct("position", "length", "rule_id", "category", "message")
    parts = by_category(found).groupBy("doc_id").agg(
        F.sum("errors").alias("grammar_errors"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "errors")))).alias("grammar_by_category"))
    rows = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("errors"))  # a document's own
    out = docs.select("doc_id").join(parts, "doc_id", "left").join(rows, "doc_id", "left")
    out = out.withColumn("grammar_errors", F.coalesce("grammar_errors", F.lit(0)))
    if failed is None:
        return out
    return out.join(failed, "doc_id", "left").withColumn("grammar_errors", F.when(F.col("error").isNull(), F.col("grammar_errors")))
