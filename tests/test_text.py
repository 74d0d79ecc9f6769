"""Text functions against a plain Python model."""

import random
import unicodedata
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexloom.functions import minhash, phrases
from lexloom.functions import text as T
from lexloom.lexicon import LATIN
from lexloom.operators import ai, metrics, spam, style

TEXTS = ["", "One two", "a b c d e f", "Hello, World! It's a well-known fact.\nNew line. 12 34", "Привет мир. Как дела? «Да» — нет…  Ёж", "x😀y z w v u t", "A.\n\n B \n\nC", "no sentence end", "1. 2. 3!", "tab\tand nbsp  end "]


def fnv(s):
    h = 2166136261
    data = s.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def plain_words(s):
    out, now = [], ""
    for c in s.lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def rows(spark, *columns):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("doc_id", *columns).orderBy("doc_id").collect()


def test_words_and_hashes(spark):
    got = rows(spark, T.words(F.col("text")).alias("w"), T.shingles(T.words(F.col("text"))).alias("p"), T.shingle_hashes(T.words(F.col("text"))).alias("h"), F.transform(T.shingles(T.words(F.col("text"))), T.fnv1a).alias("sql"))
    for r, t in zip(got, TEXTS, strict=True):
        w = plain_words(t)
        assert r.w == w
        phrases = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        assert r.p == phrases and list(r.h) == [fnv(p) for p in phrases] == r.sql


def test_fnv_known_values(spark):
    r = spark.range(1).select(T.fnv1a(F.lit("hello")).alias("a"), T.fnv1a(F.lit("")).alias("b"), T.fnv1a(F.lit("x😀y")).alias("c"), T.hex8(F.lit(255)).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (1335831723, 2166136261, fnv("x😀y"), "000000ff")


def test_sentences(spark):
    got = [r.s for r in rows(spark, T.sentences(F.col("text")).alias("s"))]
    assert got[0] == [] and got[3] == ["Hello, World!", "It's a well-known fact.", "New line.", "12 34"]
    assert got[8] == ["1.", "2.", "3!"]
    letters = [r.s for r in rows(spark, T.sentences(F.col("text"), True).alias("s"))]
    assert letters[8] == []
    assert [len(r.p) for r in rows(spark, T.paragraphs(F.col("text")).alias("p"))][6] == 3


def test_minhash(spark):
    assert minhash.coefficients(3, 42) == [1250496030, 1116302267, 1000676756]
    assert minhash.coefficients(3, 2024) == [131874306, 695264425, 153100010]
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, list(range(1000, 1045))), (2, [])], "doc_id long, h array<bigint>")
    got = df.select(minhash.signature(F.col("h")).alias("sql"), minhash.window_signatures(F.col("h")).alias("np"), minhash.document_buckets(F.col("h")).alias("b"),
                    F.array_sort(F.array_distinct(minhash.band_buckets(minhash.signature(F.col("h"))))).alias("b_sql")).collect()
    assert got[0].sql[:4] == [485382719, 780385312, 6969875, 11379851]
    assert got[0].np[0] == got[0].sql and [tuple(x) for x in got[0].b] == [tuple(x) for x in got[0].b_sql]
    assert len(got[1].np) == 4 and got[2].np == [] and got[2].sql[0] == minhash.PRIME


def test_chunks(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 20, 21, 30, 31)], "n int").select(T.chunk_count(F.col("n")).alias("c")).collect()
    assert [r.c for r in got] == [0, 1, 1, 2, 2, 3]


def test_phrase_automaton(monkeypatch):
    """Every match against looking phrase by phrase, with stretches shorter than phrases too."""
    r = random.Random(1)
    for _ in range(150):
        monkeypatch.setattr(phrases, "STRETCH", r.choice([3, 7, 4096]))
        entries = ["".join(r.choice("abc é😀") for _ in range(r.randrange(5))) for _ in range(r.randrange(12))]
        texts = ["".join(r.choice("abc é😀x") for _ in range(r.randrange(40))) for _ in range(r.randrange(8))]
        first = {}
        for k, p in enumerate(entries):
            if p:
                first.setdefault(p, k)
        want = sorted((i, j, k) for i, t in enumerate(texts) for p, k in first.items() for j in range(len(t)) if t.startswith(p, j))
        assert sorted(zip(*(x.tolist() for x in phrases.Automaton(entries).find(texts)), strict=True)) == want
    with pytest.raises(ValueError, match="automaton"):
        monkeypatch.setattr(phrases, "LARGEST", 8)
        phrases.Automaton(["abc"])


def test_many_phrases(spark):
    """100,000 phrases in one pass; a large dictionary gives what single look-ups give."""
    entries = [f"w{k} v{k % 977}" for k in range(100_000)]
    rows = [(0, "x w5 v5 y w99999 v345 w5 v5"), (1, ""), (2, None), (3, "w5 v5"), (4, "nothing")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.phrase, x.position) for x in r.m] for r in d.select("doc_id", phrases.matches(F.col("text"), entries).alias("m")).collect()}
    assert got == {0: [(5, 2), (99_999, 10), (5, 22)], 1: [], 2: [], 3: [(5, 0)], 4: []}
    counted = {r.doc_id: (r.matches, r.distinct_phrases) for r in spam.phrase_counts(metrics.tokenized(d), ["W5 V5", "w5", "nothing ", "v5 y"]).collect()}
    assert counted == {0: (5, 3), 1: (0, 0), 2: (0, 0), 3: (2, 2), 4: (1, 1)}
    texts = spark.createDataFrame([(0, "For the cat. Mit der Zeit, de la mer. None here."), (1, None), (2, "To the end! A for the b, de la c")], "doc_id long, text string")
    many = replace(LATIN, bureaucratic_phrases=LATIN.bureaucratic_phrases + tuple(f"zq{k}" for k in range(100)), ai_phrases=LATIN.ai_phrases + tuple(f"zq{k}" for k in range(100)))
    keep = ["doc_id", "bureaucracy_pct", "matched_cliches"]
    tokens = metrics.tokenized(texts)
    assert style.style(tokens, many).select(*keep).collect() == style.style(tokens, LATIN).select(*keep).collect()
    assert ai.ai_probability(tokens, many).select("ai_cliches").collect() == ai.ai_probability(tokens, LATIN).select("ai_cliches").collect()
