"""Language shares of a document's paragraphs, weighted by words.

A paragraph's script comes first; among the languages of that script the one whose ranked profile of
trigrams is nearest wins. Profiles are learned from labelled texts by aggregation: words are counted
for the whole table, so trigrams are cut from distinct words only. Any number of languages goes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions import text as T

UNKNOWN = "und"
#: Trigrams of a profile, of a language or of a paragraph; a trigram that isn't ranked is this far away.
RANKED = 300
# Blocks of scripts, and the language of scripts that one language is written in.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F, None), ("Latin", 0x1E00, 0x1EFF, None), ("Greek", 0x0370, 0x03FF, "el"), ("Greek", 0x1F00, 0x1FFF, "el"), ("Cyrillic", 0x0400, 0x052F, None),
    ("Armenian", 0x0530, 0x058F, "hy"), ("Hebrew", 0x0590, 0x05FF, "he"), ("Arabic", 0x0600, 0x077F, None), ("Devanagari", 0x0900, 0x097F, None), ("Bengali", 0x0980, 0x09FF, "bn"),
    ("Tamil", 0x0B80, 0x0BFF, "ta"), ("Thai", 0x0E00, 0x0E7F, "th"), ("Georgian", 0x10A0, 0x10FF, "ka"), ("Kana", 0x3040, 0x30FF, "ja"), ("Han", 0x4E00, 0x9FFF, "zh"), ("Hangul", 0xAC00, 0xD7AF, "ko"))
_NAMES = list(dict.fromkeys(name for name, *_ in SCRIPTS))
_STARTS = np.array(sorted(low for _, low, _, _ in SCRIPTS))
_BLOCKS = sorted((low, high, _NAMES.index(name)) for name, low, high, _ in SCRIPTS)
_BITS = 21

Detector = Callable[[Column], Column]


def trigrams(word: Column) -> Column:
    """The trigrams of a word with a blank on either side: one for each of its characters."""
    def cut(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))

    chars = F.filter(F.split(F.concat(F.lit(" "), word, F.lit(" ")), ""), lambda c: c != "")
    return F.get(F.transform(F.array(chars), cut), F.lit(0))


def learn(labelled: DataFrame, ranked: int = RANKED) -> DataFrame:
    """lang, rank (from 0), trigram: each language's most frequent trigrams, ties in code point order.

    labelled: text, lang; rows without a language are left out, null texts count as empty. Repeated
    rows count each. A language's trigrams meet in one task; their number is bounded by the alphabet.
    """
    words = labelled.filter("lang is not null").select("lang", F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = words.select("lang", "n", F.explode(trigrams(F.col("word"))).alias("trigram")).groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "trigram")) - 1
    return counts.withColumn("rank", rank.cast("long")).filter(F.col("rank") < ranked).select("lang", "rank", "trigram")


class Profiles:
    """Ranked trigrams of all languages as arrays."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        number = {lang: k for k, lang in enumerate(self.langs)}
        codes = np.array([_code(g) for _, _, g in rows], np.int64)
        self.codes, at = np.unique(codes, return_inverse=True)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)  # the last row: a trigram of no profile
        scripts = np.zeros((len(self.langs), len(_NAMES)), np.int64)
        for (lang, rank, gram), k in zip(rows, at, strict=True):
            self.ranks[k, number[lang]] = rank
            s = script_of(np.array([ord(gram[1])]))[0]
            if s >= 0:
                scripts[number[lang], s] += RANKED - rank
        self.scripts = scripts.argmax(1)

    def detect(self, texts: list[str]) -> list[str]:
        """The language of each text, of words in lower case with blanks between."""
        size = np.array([len(t) + 2 for t in texts])
        c, owner = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64), np.repeat(np.arange(len(texts)), size)
        # code points by their number among those that occur, in the same order
        chars = np.flatnonzero(np.bincount(c))
        number = np.zeros(chars[-1] + 1, np.int64)
        number[chars] = np.arange(len(chars))
        c = number[c]
        known = script_of(chars)[c]
        script = np.bincount((owner * len(_NAMES) + known)[known >= 0], minlength=len(texts) * len(_NAMES)).reshape(len(texts), -1)
        kana, han = _NAMES.index("Kana"), _NAMES.index("Han")
        script[:, kana] += np.where(script[:, kana] > 0, script[:, han], 0)  # Chinese characters beside kana are Japanese
        most = np.where(script.max(1) > 0, script.argmax(1), -1)
        gram_owner, rank, code = _ranked(c, owner, chars)
        at = np.searchsorted(self.codes, code)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, max(0, len(self.codes) - 1))] == code), at, len(self.codes)) if len(self.codes) else np.zeros(len(code), np.int64)
        theirs = self.ranks[at]
        far = np.where(theirs < 0, RANKED, np.abs(theirs - rank[:, None]))
        total, worst = np.zeros((len(texts), len(self.langs)), np.int64), np.bincount(gram_owner, minlength=len(texts)) * RANKED
        if len(gram_owner):
            first = np.flatnonzero(np.diff(gram_owner, prepend=-1))  # owners are in order
            total[gram_owner[first]] = np.add.reduceat(far, first, axis=0)
        out = np.full(len(texts), UNKNOWN, object)
        for s in np.unique(most[most >= 0]):
            of, among = np.flatnonzero(most == s), np.flatnonzero(self.scripts == s)
            if len(among):
                best = among[total[np.ix_(of, among)].argmin(1)]
                out[of] = np.where(total[of, best] < worst[of], np.array(self.langs, object)[best], UNKNOWN)
            else:
                out[of] = next((lang for name, _, _, lang in SCRIPTS if name == _NAMES[s]), None) or UNKNOWN
        return out.tolist()


def _code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def script_of(points: np.ndarray) -> np.ndarray:
    """The number of each code point's script; -1 for those of no block."""
    at = np.searchsorted(_STARTS, points, "right") - 1
    high, name = np.array([b[1] for b in _BLOCKS]), np.array([b[2] for b in _BLOCKS])
    return np.where((at >= 0) & (points <= high[at]), name[at], -1)


def _ranked(c: np.ndarray, owner: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, rank, trigram) of the RANKED most frequent trigrams of each text; none goes over a blank.
    c: each character's number among `chars`, code points in ascending order."""
    k, blank = len(chars), np.searchsorted(chars, 32)
    good = np.flatnonzero((owner[:-2] == owner[2:]) & (c[1:-1] != blank))
    gram, text = (c[good] * k + c[good + 1]) * k + c[good + 2], owner[good]
    if (int(owner[-1]) + 1) * k**3 < 1 << 63:  # one number says both
        key, count = np.unique(text * k**3 + gram, return_counts=True)
        text, gram = np.divmod(key, k**3)
    else:
        order = np.lexsort((gram, text))
        gram, text = gram[order], text[order]
        new = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        count = np.diff(np.append(new, len(gram)))
        gram, text = gram[new], text[new]
    # by text, then count, then trigram, in whose order they are: a batch's size cubed fits a long
    n, most = max(1, len(text)), int(count.max(initial=0))
    order = np.sort((text * (most + 1) + most - count) * n + np.arange(len(text))) % n
    text, gram = text[order], gram[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    keep = rank < RANKED
    text, rank, gram = text[keep], rank[keep], gram[keep]
    pair, last = np.divmod(gram, k)
    return text, rank, chars[pair // k] << 2 * _BITS | chars[pair % k] << _BITS | chars[last]


def trigram_detector(profiles: DataFrame | None) -> Detector:
    """A detector from profiles as `learn` gives them: RANKED rows for each language, sent to all tasks.
    It tells languages by script alone where there are none."""
    rows = [] if profiles is None else [(r.lang, r.rank, r.trigram) for r in profiles.select("lang", "rank", "trigram").collect()]
    known = Profiles(rows)

    @F.arrow_udf("string")
    def detect(texts: pa.Array) -> pa.Array:
        out: list[str] = []
        for some in T.batches([t or "" for t in texts.to_pylist()], 8_000_000 // (8 + len(known.langs))):
            out += known.detect(some)
        return pa.array(out, pa.string())

    return lambda words: detect(F.array_join(words, " "))


def breakdown(docs: DataFrame, config: EngineConfig = EngineConfig(), detector: Detector | None = None) -> DataFrame:
    """doc_id, lang, words, pct, first_pos; paragraphs without words are left out, short ones are `und`.
    detector: from a paragraph's words to its language; by script alone if there is none."""
    each = docs.select("doc_id", F.posexplode(T.paragraphs(F.coalesce("text", F.lit("")))).alias("pos", "part"))
    found = each.filter(F.col("part").rlike(T.WORD)).select("doc_id", "pos", ((F.length("part") >= config.language_least_chars) | (T.utf16_length(F.col("part")) >= config.language_least_chars)).alias("long"), T.words(F.col("part")).alias("w"))
    told = (detector or trigram_detector(None))(F.when(F.col("long"), F.col("w")).otherwise(F.array().cast("array<string>")))
    found = found.select("doc_id", "pos", F.size("w").alias("n"), told.alias("lang"))
    sums = found.groupBy("doc_id", "lang").agg(F.sum("n").alias("words"), F.min("pos").cast("long").alias("first_pos"))
    whole = F.sum("words").over(W.partitionBy("doc_id"))  # a row for each language of a document
    return sums.select("doc_id", "lang", "words", T.share(F.col("words"), whole).alias("pct"), "first_pos")


def dominant(docs: DataFrame, config: EngineConfig = EngineConfig(), detector: Detector | None = None) -> DataFrame:
    """doc_id, language (null: none), and language_breakdown as a map."""
    parts = breakdown(docs, config, detector)
    best = parts.groupBy("doc_id").agg(F.max_by("lang", F.struct("pct", -F.col("first_pos"))).alias("best"),
                                       F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "pct")))).alias("language_breakdown"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.nullif(F.col("best"), F.lit(UNKNOWN)).alias("language"), "language_breakdown")


def accuracy(labelled: DataFrame, detector: Detector) -> DataFrame:
    """lang, documents, correct: how often a text's own language is the one told, by language."""
    told = detector(T.words(F.coalesce("text", F.lit(""))))
    return labelled.filter("lang is not null").select("lang", (told == F.col("lang")).alias("same")).groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("same").alias("correct"))
