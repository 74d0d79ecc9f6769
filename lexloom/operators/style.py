"""Readability, sentence length, passive voice, repetitions, stock phrases and quotations.

All are projections of one row; documents come as `metrics.tokenized` gives them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions import text as T
from lexloom.functions.phrases import phrases_in
from lexloom.lexicon import RUSSIAN, LexicalProfile

#: Phrases up to which each is looked for on its own.
FEW = 32
# What counts as a quotation.
_QUOTES = (r"«([^«»]+)»", r'"([^"]+)"')


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def among(word: Column, values) -> Column:
    """Whether a word is one of the values; Spark looks it up in a hash set."""
    return word.isin(*values) if values else F.lit(False)


def sentence_share(predicate) -> Column:
    """Per cent of the sentences for which the predicate holds."""
    return T.share(F.size(F.filter("sentences", predicate)), F.size("sentences"))


def holds_any(sentence: Column, phrases) -> Column:
    low = F.lower(sentence)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def _lowered() -> Column:
    return F.transform("sentences", F.lower)


def phrase_share(phrases) -> Column:
    """Per cent of the sentences that hold one of the phrases: one look-up each for few phrases, one
    pass of an automaton for many."""
    if len(phrases) <= FEW:
        return sentence_share(lambda s: holds_any(s, phrases))
    return T.share(F.size(F.filter(phrases_in(_lowered(), [p.lower() for p in phrases]), lambda k: F.size(k) > 0)), F.size("sentences"))


def found_alike(pattern: str) -> str:
    """A pattern that is found in the same texts: a class that repeats at the start need be there once only."""
    return re.sub(r"^(\[[^\[\]\\]+\])\+(?=\()", r"\1", pattern)


def readability(profile: LexicalProfile) -> Column:
    vowels = F.split(F.regexp_replace(F.array_join("words", " "), f"[^{profile.vowels} ]+", ""), " ")  # of each word, all replaced at once
    syllables = F.aggregate(vowels, F.lit(0), lambda n, v: n + F.greatest(F.lit(1), F.length(v)))
    n = F.size("words").cast("double")
    score = F.lit(206.835) - F.lit(1.3) * (n / F.size("sentences").cast("double")) - F.lit(60.1) * (syllables.cast("double") / n)
    return F.when((F.size("words") > 0) & (F.size("sentences") > 0), F.floor(score * 10 + 0.5).cast("double") / 10).otherwise(0.0)


def significant(words: Column, profile: LexicalProfile) -> Column:
    """Words of three letters or more that aren't stop words."""
    return F.array_distinct(F.filter(words, lambda w: ((F.length(w) >= 3) | (F.length(w) == 2) & (T.utf16_length(w) >= 3)) & ~among(w, profile.stop_words)))


def adjacent_repetitions(profile: LexicalProfile) -> Column:
    kept = F.transform("sentence_words", lambda w: significant(w, profile))
    hits = lambda k: F.size(F.filter(F.arrays_zip(F.slice(k, 1, F.size(k) - 1).alias("a"), F.slice(k, 2, F.size(k) - 1).alias("b")), lambda p: F.arrays_overlap(p["a"], p["b"])))
    return F.when(F.size("sentences") > 1, F.get(F.transform(F.array(kept), hits), F.lit(0))).otherwise(0)


def matched_phrases(profile: LexicalProfile) -> Column:
    """The first phrase, in the profile's order, of each sentence that has one; each once."""
    phrases = profile.bureaucratic_phrases
    if len(phrases) > FEW:
        hits = F.transform(phrases_in(_lowered(), [p.lower() for p in phrases]), lambda k: F.get(k, F.lit(0)))
        named = F.transform(F.filter(hits, lambda k: k.isNotNull()), lambda k: F.get(strings(phrases), k))
        return F.array_distinct(named)

    def first(s: Column) -> Column:
        return F.get(F.filter(strings(profile.bureaucratic_phrases), lambda p: F.contains(F.lower(s), F.lower(p))), F.lit(0))
    return F.array_distinct(F.filter(F.transform("sentences", first), lambda p: p.isNotNull()))


def cited_pct(text: Column) -> Column:
    """Quoted characters without white space; nested quotations count in both patterns."""
    inside = None
    for rx in _QUOTES:
        n = F.aggregate(F.regexp_extract_all(text, F.lit(rx), 1), F.lit(0), lambda a, q: a + T.solid_length(q))
        inside = n if inside is None else inside + n
    return T.share(inside, T.solid_length(text))


def columns(profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig()) -> dict[str, Column]:
    """What `style` says of a document, as columns over `metrics.tokenized`."""
    return {
        "readability_score": readability(profile),
        "long_sentences_pct": T.share(F.size(F.filter("sentence_words", lambda w: F.size(w) > config.long_sentence_words)), F.size("sentences")),
        "passive_voice_pct": sentence_share(lambda s: s.rlike(f"(?iu){found_alike(profile.passive)}")),
        "word_repetitions": adjacent_repetitions(profile).cast("long"),
        "bureaucracy_pct": phrase_share(profile.bureaucratic_phrases),
        "matched_cliches": matched_phrases(profile), "cited_pct": cited_pct(F.col("text"))}


def style(tokens: DataFrame, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig()) -> DataFrame:
    return tokens.select("doc_id", *(c.alias(name) for name, c in columns(profile, config).items()))
