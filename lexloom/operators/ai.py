"""AI-likelihood: a registry of feature scorers and their weighted mean.

A scorer makes a Column from tokenized documents; null says that it isn't available, and its weight
then doesn't count. More scorers can be registered by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions import text as T
from lexloom.functions.phrases import phrases_in
from lexloom.lexicon import RUSSIAN, LexicalProfile
from lexloom.operators import ngrams
from lexloom.operators.spam import repeated
from lexloom.operators.style import FEW, among, holds_any

Scorer = Callable[[LexicalProfile, EngineConfig], Column]
SCORERS: dict[str, Scorer] = {}


def scorer(key: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        SCORERS[key] = f
        return f
    return add


def clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _part(predicate) -> Column:
    n = F.size("sentences")
    return F.when(n > 0, clamped(F.size(F.filter("sentences", predicate)).cast("double") / n)).otherwise(0.0)


@scorer("lexicalDiversity")
def lexical_diversity(profile: LexicalProfile, config: EngineConfig) -> Column:
    n = F.size("words")
    return F.when(n > 0, clamped(1 - F.size(F.array_distinct("words")).cast("double") / n)).otherwise(0.0)


@scorer("burstiness")
def burstiness(profile: LexicalProfile, config: EngineConfig) -> Column:
    lengths = F.filter(F.transform("sentence_words", lambda w: F.size(w)), lambda n: n > 0)

    def value(x: Column) -> Column:
        n = F.size(x).cast("double")

        def around(mean: Column) -> Column:  # bound once, or it would be summed up anew for each sentence
            spread = F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)) / n
            return clamped(1 - F.least(F.sqrt(spread) / mean, F.lit(1.0)))

        mean = F.aggregate(x, F.lit(0), lambda a, b: a + b).cast("double") / n
        return F.when(F.size(x) >= 2, F.get(F.transform(F.array(mean), around), F.lit(0))).otherwise(0.0)

    return F.get(F.transform(F.array(lengths), value), F.lit(0))


@scorer("personalPronouns")
def personal_pronouns(profile: LexicalProfile, config: EngineConfig) -> Column:
    n = F.size("words")
    hits = F.size(F.filter("words", lambda w: among(w, profile.pronouns))).cast("double")
    return F.when(n > 0, clamped(1 - F.least(hits / n / F.lit(config.pronoun_share), F.lit(1.0)))).otherwise(0.0)


@scorer("aiCliches")
def ai_cliches(profile: LexicalProfile, config: EngineConfig) -> Column:
    if len(profile.ai_phrases) > FEW:
        hits, n = phrases_in(F.transform("sentences", F.lower), [p.lower() for p in profile.ai_phrases]), F.size("sentences")
        return F.when(n > 0, clamped(F.size(F.filter(hits, lambda k: F.size(k) > 0)).cast("double") / n)).otherwise(0.0)
    return _part(lambda s: holds_any(s, profile.ai_phrases))


@scorer("synonymChains")
def synonym_chains(profile: LexicalProfile, config: EngineConfig) -> Column:
    # three or more words with commas between are there if the middle one and a letter on either side are
    return _part(lambda s: F.contains(s, F.lit(",")) & s.rlike(rf"(?iu){profile.chain_letters},{T.WS}*{profile.chain_letters}+,{T.WS}*{profile.chain_letters}"))


def perplexity_scorer(model: Callable[[Column], Column]) -> Scorer:
    """A scorer from a model's perplexity Column of `text` (null: not available)."""
    def score(profile: LexicalProfile, config: EngineConfig) -> Column:
        return _expected(model(F.col("text")), config)
    return score


def _expected(perplexity: Column, config: EngineConfig) -> Column:
    """1 for a text that the model expects wholly, 0 from perplexity_scale on; null stays null."""
    return F.when(perplexity.isNotNull(), clamped(1 - F.least(perplexity / F.lit(config.perplexity_scale), F.lit(1.0))))


@scorer("perplexity")
def perplexity_column(profile: LexicalProfile, config: EngineConfig) -> Column:
    """From a column `ppl` of the tokenized documents, as `with_perplexity` gives it; null without one."""
    return _expected(F.col("ppl"), config)


def with_perplexity(tokens: DataFrame, docs: DataFrame, model: ngrams.NgramModel) -> DataFrame:
    """`tokens` with ppl, the perplexity of each document; row by row, if the model goes to all tasks and no
    rows share an id."""
    small = ngrams.sent(model)
    if small is not None and repeated(docs) is None:
        return tokens.withColumn("ppl", ngrams.of_row(F.col("words"), small))
    found = ngrams.perplexity(docs, model).select(F.col("doc_id").alias("ppl_id"), F.col("perplexity").alias("ppl"))
    return tokens.join(found, F.col("doc_id").eqNullSafe(F.col("ppl_id")), "left").drop("ppl_id")


def snake(key: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in key)


def with_probability(tokens: DataFrame, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig(), scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """`tokens` with a column for each scorer (three digits), ai_probability, ai_verdict."""
    weights = {k: w for k, w in config.weights if k not in config.detector_off}
    used = [(k, f) for k, f in (scorers or SCORERS).items() if k in weights]
    if "ppl" not in tokens.columns:
        tokens = tokens.withColumn("ppl", F.lit(None).cast("double"))
    scored = tokens.select("*", *(f(profile, config).alias(snake(k)) for k, f in used))
    total = weight = F.lit(0.0)
    for k, _ in used:
        s = F.when(~F.isnan(snake(k)), F.col(snake(k)))
        total = total + F.coalesce(F.lit(weights[k]) * s, F.lit(0.0))
        weight = weight + F.when(s.isNotNull(), F.lit(weights[k])).otherwise(0.0)
    probability = F.when(weight > 0, T.rounded(total / weight, 3)).otherwise(0.0)
    scored = scored.withColumn("ai_probability", probability)
    return scored.drop("ppl").withColumns({snake(k): T.rounded(F.col(snake(k)), 3) for k, _ in used} | {"ai_verdict": F.col("ai_probability") >= config.verdict_threshold})


def ai_probability(tokens: DataFrame, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig(), scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """doc_id, a column for each scorer (three digits), ai_probability, ai_verdict."""
    found = with_probability(tokens, profile, config, scorers)
    return found.drop(*(c for c in tokens.columns if c != "doc_id"))
