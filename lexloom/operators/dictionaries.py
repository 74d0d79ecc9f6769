"""Editable dictionaries: weights, junk words, phrases, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import DEFAULT_WEIGHTS, EngineConfig
from lexloom.lexicon import RUSSIAN, LexicalProfile


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`table` with `changes` by key; a null in a change leaves the old value."""
    columns = [c for c in table.columns if c != key]
    a, b = table.alias("a"), changes.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in changes.columns else F.col(f"a.{c}") for c in columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def of_category(table: DataFrame, category: str) -> DataFrame:
    return table.filter(F.col("category") == category)


def enabled(weights: DataFrame) -> DataFrame:
    return weights.filter("enabled")


def seeded(table: DataFrame, defaults: DataFrame, category: str | None = None) -> DataFrame:
    """The table, with the defaults of each category (or of all) that has no row in it yet."""
    if category is None:
        missing = defaults if table.isEmpty() else defaults.limit(0)
    else:
        missing = defaults.join(table.select(category).distinct(), category, "left_anti")
    return table.unionByName(missing)


def weights_table(spark: SparkSession, config: EngineConfig = EngineConfig()) -> DataFrame:
    return spark.createDataFrame([(k, w, k not in config.detector_off) for k, w in config.weights or DEFAULT_WEIGHTS], "feature string, weight double, enabled boolean")


def phrases_table(spark: SparkSession, profile: LexicalProfile = RUSSIAN) -> DataFrame:
    rows = [(p, "BUREAUCRATIC") for p in profile.bureaucratic_phrases] + [(p, "AI_CLICHE") for p in profile.ai_phrases]
    return spark.createDataFrame(rows, "phrase string, category string")


def config_from(weights: DataFrame, **more) -> EngineConfig:
    """A config from a weights table (a row for each feature)."""
    rows = weights.collect()
    return EngineConfig(weights=tuple((r.feature, r.weight) for r in rows), detector_off=tuple(r.feature for r in rows if not r.enabled), **more)
