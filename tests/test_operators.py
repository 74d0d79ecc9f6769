"""Operators on small hand-made rows."""

import collections
import datetime as dt
import io
import json
import math
import re
import zipfile
import zlib
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom import queries
from lexloom.config import EngineConfig
from lexloom.functions import minhash
from lexloom.lexicon import LATIN, RUSSIAN
from lexloom.operators import ai, copying, dictionaries, grammar, language, latent, metadata, metrics, ngrams, semantic, spam, style, tampering
from lexloom.plans import report, stages
from lexloom.plans.report import Engine, originality_report
from lexloom.sources import files, pdf, providers, tables
from lexloom.streaming import jobs

BASE = "one two three four five six seven eight nine ten eleven twelve"


def docs(spark, *texts, source="s"):
    return spark.createDataFrame([(i, t, source if i != 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_metrics_edges(spark):
    got = {r.doc_id: r for r in metrics.basic_metrics(docs(spark, None, "", "it's well-known. Yes", " \n ")).collect()}
    assert got[0].char_count == got[1].page_count == got[3].word_count == 0
    assert (got[2].word_count, got[2].sentence_count, got[2].page_count, got[2].avg_sentence_length) == (3, 2, 1, 1.5)


def test_copy_quirks(spark):
    d = docs(spark, BASE, f"{BASE} {BASE}", "short text", BASE, None)
    corpus = spark.createDataFrame([(7, f"{BASE} {BASE}")], "doc_id long, text string")
    for gate in ("lsh", "none"):
        c = EngineConfig(candidate_gate=gate)
        got = {r.doc_id: r for r in copying.copy_pct(d, corpus, c).collect()}
        assert got[0].plagiarism_pct == 100.0 and got[2].plagiarism_pct == 0.0 == got[4].plagiarism_pct
        assert got[1].total_shingles == 20 and got[1].matched_shingles == 12 and got[1].plagiarism_pct == 60.0
        assert {(r.doc_id, r.matched_shingles) for r in copying.copy_sources(d, corpus, c).collect()} >= {(0, 16)}
    own = {r.doc_id: r for r in copying.self_copy_pct(d).collect()}
    assert own[0].self_plagiarism_pct == 100.0 and not own[3].enabled and own[3].total_shingles == 0
    past = {r.doc_id: r.self_plagiarism_pct for r in copying.self_copy_pct(d, EngineConfig(only_previous=True)).collect()}
    assert past[0] == 0.0 and past[1] > 0
    with pytest.raises(ValueError):
        EngineConfig(candidate_gate="x")


def test_rare_sample(spark):
    long = " ".join(f"w{i}" for i in range(30))
    got = copying.rare_shingles(docs(spark, long, "a b c d e f"), docs(spark, "nothing here at all now then")).collect()
    assert sorted(r.position for r in got if r.doc_id == 0) == [i * 26 // 5 for i in range(5)]
    assert sorted((r.sample_no, r.position) for r in got if r.doc_id == 1) == [(0, 0), (1, 1)]


def test_russian_profile(spark):
    t = metrics.tokenized(docs(spark, "Данный вопрос решается. Вопрос важный, нужный, сложный. Я думаю, короче, так.", None))
    r = style.style(t, RUSSIAN).orderBy("doc_id").first()
    assert r.bureaucracy_pct == 33.3 and r.matched_cliches == ["данный вопрос"] and r.passive_voice_pct == 33.3 and r.word_repetitions == 1
    a = ai.ai_probability(t, RUSSIAN).orderBy("doc_id").collect()
    assert a[0].synonym_chains == 0.667 and a[0].perplexity is None and a[1].ai_probability == 0.0
    s = spam.spam(t, RUSSIAN).orderBy("doc_id").collect()
    assert s[0].junk_words == 1 and s[1].total_words == 0
    assert len(set(RUSSIAN.stop_words)) == 162 and len(RUSSIAN.pronouns) == 32


def test_scorer_registry(spark):
    t = metrics.tokenized(docs(spark, "a b c"))
    r = ai.ai_probability(t, RUSSIAN, EngineConfig(weights=(("mine", 2.0), ("perplexity", 1.0))), {"mine": lambda p, c: F.lit(0.9), "perplexity": ai.perplexity_scorer(lambda x: F.lit(75.0))}).first()
    assert r.ai_probability == 0.767 and r.ai_verdict


def test_perplexity_null(spark):
    """A model that has no value for a text leaves the other features' weights alone."""
    weights = EngineConfig(weights=(("mine", 2.0), ("perplexity", 1.0)))
    r = ai.ai_probability(metrics.tokenized(docs(spark, "a b c")), RUSSIAN, weights, {"mine": lambda p, c: F.lit(0.9), "perplexity": ai.perplexity_scorer(lambda x: F.lit(None).cast("double"))}).first()
    assert r.perplexity is None and r.ai_probability == 0.9


def brute_perplexity(trained, asked, order):
    """Interpolated Kneser-Ney, one n-gram at a time."""
    def padded(t):
        return ["<s>"] * (order - 1) + (t or "").split() + ["</s>"]

    counts = [collections.Counter() for _ in range(order)]
    for t in trained:
        w = padded(t)
        counts[-1].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for k in range(order - 2, -1, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    of = [collections.Counter(c.values()) for c in counts]
    d = [n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5 for n in of]

    def p(g):
        k = len(g) - 1
        if k == 0:
            total = sum(counts[0].values())
            return max(counts[0][g] - d[0], 0) / max(1, total) + (d[0] * len(counts[0]) / total if total else 1) / (len(counts[0]) + 1)
        after = [c for h, c in counts[k].items() if h[:-1] == g[:-1]]
        return (max(counts[k][g] - d[k], 0) + d[k] * len(after) * p(g[1:])) / sum(after) if after else p(g[1:])

    w = padded(asked)
    if len((asked or "").split()) < 2:
        return 0.0
    logs = [math.log(p(tuple(w[i : i + order]))) for i in range(len(w) - order + 1)]
    return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_perplexity(spark, order):
    trained = ["a b c a b d", "a b c", "c c c c", None, "", "b"]
    asked = ["a b c", "d a z z", "a", "", None, "c c c a b d x", "a b " * 300]
    model = ngrams.train(docs(spark, *trained), order)
    got = {r.doc_id: r.perplexity for r in ngrams.perplexity(docs(spark, *asked), model).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(brute_perplexity(trained, t, order), rel=1e-9), t
    if order == 3:
        same = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
        assert {r.doc_id: round(r.perplexity, 9) for r in ngrams.perplexity(same, model).collect()} == dict.fromkeys((None, 1), round(got[0], 9))
        none = ngrams.train(docs(spark, "x").limit(0), order)
        assert ngrams.perplexity(docs(spark, "a b"), none).first().perplexity == pytest.approx(1.0)
        t = ai.with_perplexity(metrics.tokenized(docs(spark, "a b c", "a")), docs(spark, "a b c", "a"), model)
        r = {r.doc_id: r.perplexity for r in ai.ai_probability(t, RUSSIAN).collect()}
        assert r[1] == 1.0 and 0 < r[0] < 1


def brute_nearest(asked, corpus):
    out = {}
    for i, q in asked:
        best = None
        for j, c in corpus:
            if q is None or c is None or len(q) != len(c) or not len(q):
                continue
            a, b = np.array([np.nan if v is None else v for v in q], float), np.array([np.nan if v is None else v for v in c], float)
            if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
                continue
            s = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
            if best is None or (-s, j) < best:
                best = (-s, j)
        if best:
            out[i] = (best[1], -best[0])
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_nearest_by_pivots(spark, block):
    r = np.random.default_rng(block)
    centers = r.normal(size=(9, 12))
    rows = lambda n, at: [(at + i, (centers[r.integers(9)] + 0.1 * r.normal(size=12)).tolist()) for i in range(n)]
    corpus = rows(400, 10_000) + [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [float("nan"), 1.0, 1.0]), (7, [0.0] * 12), (8, [None] * 12), (9, [float("inf")] * 12)]
    corpus += [(50_000 + i, corpus[0][1]) for i in range(50)]
    asked = rows(100, 0) + [(900, [1.0, 2.0, 3.0]), (901, [1.0, 2.0]), (902, None), (903, [0.0] * 12), (904, [float("nan")] * 12), (905, [None, 1.0, 1.0]), (906, corpus[0][1]), (907, [-1.0] * 12)]
    kind = "vec_id long, embedding array<double>"
    got = semantic.nearest(spark.createDataFrame(asked, kind), spark.createDataFrame([*corpus, (None, [1.0] * 12)], kind), block=block).collect()
    want = brute_nearest(asked, corpus)
    assert {x.vec_id: (x.nearest_id, round(x.similarity, 9)) for x in got} == want and len(got) == len(want)
    met = [x.compared for x in got if x.vec_id < 100]
    assert max(met) <= 400 and sum(met) < 0.5 * 400 * len(met)  # cells that can't win aren't met
    assert semantic.nearest(spark.createDataFrame(asked, kind), spark.createDataFrame([], kind)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1e200, 1e-200])], kind)
    assert sorted((x.vec_id, x.nearest_id) for x in semantic.nearest(twice, spark.createDataFrame([(5, [1e-170, 0.0]), (6, [0.0, 3.0])], kind)).collect()) == [(1, 5), (1, 6), (2, 5)]


def test_nearest_plain_vectors(spark):
    """Vectors without any structure: nothing is ruled out, all the same rows."""
    r = np.random.default_rng(3)
    make = lambda n, at: [(at + i, r.normal(size=8).tolist()) for i in range(n)]
    asked, corpus = make(60, 0), make(150, 1000)
    kind = "vec_id long, embedding array<double>"
    got = semantic.nearest(spark.createDataFrame(asked, kind), spark.createDataFrame(corpus, kind), block=16).collect()
    assert {x.vec_id: (x.nearest_id, round(x.similarity, 9)) for x in got} == brute_nearest(asked, corpus)


@pytest.mark.parametrize("held", [700, 9000])
def test_nearest_in_chunks(spark, monkeypatch, held):
    """A corpus that no task holds at once: whole cells, and parts of one cell, go to several chunks."""
    monkeypatch.setattr(semantic, "STRIPE", 40)
    r = np.random.default_rng(held)
    centers = r.normal(size=(6, 8))
    make = lambda n, at: [(at + i, (centers[r.integers(6)] + 0.2 * r.normal(size=8)).tolist()) for i in range(n)]
    corpus = make(300, 1000) + [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [3.0, 2.0, 1.0]), (4, None), (5, [float("nan")] * 8), (6, [0.0] * 8)]
    asked = make(150, 0) + [(900, [1.0, 2.0, 3.0]), (901, [1.0, 2.0]), (902, None), (903, [0.0] * 8), (904, corpus[7][1])]
    kind = "vec_id long, embedding array<double>"
    a, c = spark.createDataFrame(asked, kind), spark.createDataFrame(corpus, kind)
    want = brute_nearest(asked, corpus)
    for pivots in (3, 1024):
        got = semantic.nearest(a, c, block=16, pivots=pivots, held=held).collect()
        assert {x.vec_id: (x.nearest_id, round(x.similarity, 9)) for x in got} == want and len(got) == len(want)
        whole = {x.vec_id: x.compared for x in semantic.nearest(a, c, block=16, pivots=pivots).collect()}
        assert all(0 < x.compared <= 303 for x in got) and all(0 < n <= 303 for n in whole.values())


def test_sentences_without_stored_vectors(spark, monkeypatch):
    """Vectors of the documents' sentences aren't written; sentences without a match are there."""
    kept, stored = [], report.stored
    monkeypatch.setattr(report, "stored", lambda df, name: kept.append(df.columns) or stored(df, name))
    d, c = docs(spark, "Red apples fall. Blue birds sing.", "", "... !"), docs(spark, "Red apples fall. Green trees grow.")
    embed = lambda s: F.when(s.contains("sing"), F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.length(s).cast("double"), F.lit(1.0)))
    got = sorted((r.doc_id, r.similarity is not None and round(r.similarity, 9), r.nearest_group) for r in report.Engine(embedder=embed).sentences(d, c).collect())
    assert got == [(0, False, None), (0, 1.0, 0)]
    assert sum("embedding" in columns for columns in kept) == 1


def dense_latent(sentences, size, slots):
    """Weighted counts, their exact singular vectors, and a function to vectors of sentences."""
    def counts(texts):
        x = np.zeros((len(texts), slots))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                x[i, zlib.crc32(w.encode()) % slots] += 1
        return x

    x = counts(sentences)
    x = x[x.sum(1) > 0]
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) ** 2
    _, values, right = np.linalg.svd(x * weights, full_matrices=False)
    k = min(size, int((values > 1e-4 * values[0]).sum()))
    return lambda texts: counts(texts) * weights @ right[:k].T / values[:k] * np.sqrt(len(x))


def cosines(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(n > 0, n, 1)
    return x @ x.T


def test_latent_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    topics = [[f"w{t}x{k}" for k in range(12)] for t in range(5)]
    texts = [" ".join(r.choice(topics[i % 5], 8)) for i in range(200)] + [None, "", "...", "unseen words only in here"]
    s = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, sentence string").repartition(3)
    for size, exact in ((70, True), (5, False)):
        model = latent.learn(s, size, 256)
        embed = latent.embedder(model, spark)
        got = np.array([x.e for x in s.select("i", embed(F.col("sentence")).alias("e")).orderBy("i").collect()])
        want = dense_latent(texts, size, 256)(texts)
        assert np.abs(cosines(got) - cosines(want))[:200, :200].max() < (1e-3 if exact else 0.05)
        assert not got[200:203].any()
    latent.save(model, spark, str(tmp_path / "m"))
    again = latent.load(spark, str(tmp_path / "m"))
    assert (again.vectors == model.vectors).all() and (again.weights == model.weights).all()
    none = latent.learn(s.limit(0), 4, 16)
    assert not np.array(s.select(latent.embedder(none, spark)(F.col("sentence")).alias("e")).first().e).any()


def test_paraphrase_of_the_report(spark):
    """originality_full's paraphrase against comparing all sentences with all."""
    d, c = queries.documents(spark, "/root/testdata/sf0.001"), queries.corpus(spark, "/root/testdata/sf0.001")
    embed = Engine.learned(d, c)
    own, other = ([(x.doc_id, x.embedding) for x in semantic.sentence_vectors(f, embed).collect()] for f in (d, c))
    unit = lambda rows: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))(np.array([v for _, v in rows], float))
    best = (unit(own) @ unit(other).T).max(1)
    total, hit = collections.Counter(i for i, _ in own), collections.Counter(i for (i, _), s in zip(own, best, strict=True) if s >= 0.75)
    got = {r.doc_id: r for r in queries.originality_full(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 200 and all(got[i].paraphrase_pct == 0 for i in got if i not in total)
    same = [abs(got[i].paraphrase_pct - 100 * hit[i] / n) <= 0.0501 for i, n in total.items()]
    assert np.mean(same) > 0.98  # sums in another order may move a cosine over the threshold
    assert len({r.paraphrase_pct for r in got.values()}) > 3
    plain = {r.doc_id: r for r in queries.originality_report(spark, "/root/testdata/sf0.001").collect()}
    assert all(got[i].plagiarism_pct == plain[i].plagiarism_pct and got[i].originality_pct <= plain[i].originality_pct for i in got)


def test_self_copies_of_repeated_ids(spark):
    """Rows in are rows out, whatever the ids; a document doesn't copy itself."""
    rows = [(1, BASE, "a"), (1, BASE, "a"), (None, BASE, "a"), (2, "one two three four five", "a"), (3, BASE, None), (4, "x", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.enabled, r.total_shingles, r.matched_shingles) for r in copying.self_copy_pct(d).collect())
    assert got == [("1", True, 8, 1), ("1", True, 8, 1), ("2", True, 1, 1), ("3", False, 0, 0), ("4", True, 0, 0), ("None", True, 8, 0)]


def test_sections_without_own_sources(spark, monkeypatch):
    """The same sections without the list of the author's documents; the query doesn't make that list."""
    d = spark.createDataFrame([(1, BASE, "a"), (2, BASE + " more", "a"), (3, "x", None)], "doc_id long, text string, source string")
    engine = Engine()
    full, short = ({r.doc_id: r.section.asDict(True) for r in engine.sections(d, docs(spark, BASE), False, listed)["plagiarism"].collect()} for listed in (True, False))
    assert full[1]["self_plagiarism"].pop("sources") and full[2]["self_plagiarism"].pop("sources") and full[3]["self_plagiarism"].pop("sources") is None
    assert all(x["self_plagiarism"].pop("sources") is None for x in short.values()) and full == short
    monkeypatch.setattr(copying, "self_copy_sources", None)
    assert queries.QUERIES["result_sections"](spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("previous", [False, True])
def test_self_copy_pairs(spark, monkeypatch, previous):
    """Pairs against brute force; documents that share the same passages are paired as one class."""
    r = np.random.default_rng(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(8 + k)) for k in range(4)]
    rows = []
    for i in range(70):
        parts = [passages[k] for k in range(4) if r.random() < 0.3] + [" ".join(f"u{i}x{j}" for j in range(6))]
        rows.append((i, " ".join(parts + parts[:1] * int(r.integers(2))), [None, "a", "b"][r.integers(3)]))
    rows += [(100 + i, passages[0] + f" y{i}", "hot") for i in range(40)] + [(3, passages[0], "a"), (3, passages[1], "b"), (4, passages[0], "a"), (4, passages[1], "b"), (None, passages[0], "a"), (200, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    config = EngineConfig(only_previous=previous)
    holds, want = collections.defaultdict(collections.Counter), collections.Counter()
    for x in copying.hashed(d, config, "source").collect():
        if x.doc_id is not None and x.source is not None:
            holds[x.source, x.doc_id].update(x.hashes)
    for (s, i), h in holds.items():
        for (t, j), g in holds.items():
            if s == t and i != j and h.keys() & g.keys() and (j < i or not previous):
                want[i, j] += sum(g[x] for x in h.keys() & g.keys())
    kept, stored = {}, copying.stored
    monkeypatch.setattr(copying, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    got = [((x.doc_id, x.other_doc_id), x.matched_shingles) for x in copying.self_copy_sources(d, config).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert kept["self-copy-passages"].filter("source = 'hot'").count() == 0  # one class


def test_quotes(spark):
    r = docs(spark, 'ab "cd" «e "f" g»', "").select(style.cited_pct(F.col("text")).alias("c")).collect()
    assert r[0].c == 80.0 or r[0].c > 50
    assert r[1].c == 0.0


def test_nearest_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    c = spark.createDataFrame([(4, [2.0, 0.0]), (2, [1.0, 0.0]), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.nearest_id, r.similarity) for r in semantic.nearest(v, c, block=2).collect()] == [(1, 2, 1.0)]


def test_homoglyphs_and_zero_width(spark):
    d = docs(spark, "😀 привeт мир", "pаper text", "clean text", "a​b﻿", None)
    got = {(r.doc_id, r.position, r.char, r.looks_like) for r in tampering.homoglyphs(d).collect()}
    assert got == {(0, 7, "e", "ё"), (1, 1, "а", "a")}
    assert {(r.doc_id, r.position, r.label) for r in tampering.zero_width(d).collect()} == {(3, 1, "U+200B"), (3, 3, "U+FEFF")}


def test_language(spark):
    labelled = spark.createDataFrame([("en", "the cat and the dog of it was there with them"), ("en", None), ("de", "der Hund und die Katze ist nicht im Haus"), ("uk", "це дуже гарний день і він ще не пішов"), (None, "zzz zzz")], "lang string, text string")
    profiles = language.learn(labelled)
    assert {(r.lang, r.trigram) for r in profiles.filter("rank = 0").collect()} == {("en", "the"), ("de", " de"), ("uk", "ий ")} or profiles.filter("rank = 0").count() == 3
    told = language.trigram_detector(profiles)
    d = docs(spark, "the cat and the dog of it\n\nder Hund und die Katze ist", "xx", "", None, "він дуже гарний, цей день", "Καλημέρα σε όλους σας εδώ", "これは日本語の文章です、とても長い文章です", "qqqqqq qqqqqqq qqqqqqqqqqq", "12345 678910 11121314 1516")
    got = {r.doc_id: r for r in language.dominant(d, detector=told).collect()}
    assert got[0].language == "en" and set(got[0].language_breakdown) == {"en", "de"} and got[1].language is None and got[2].language_breakdown is None
    assert [got[i].language for i in range(4, 9)] == ["uk", "el", "ja", None, None]
    alone = {r.doc_id: r.language for r in language.dominant(d).collect()}  # without profiles scripts tell
    assert [alone[i] for i in (0, 4, 5, 6)] == [None, None, "el", "ja"]
    assert language.learn(labelled.limit(0)).count() == 0
    assert [tuple(r) for r in language.accuracy(labelled.filter("text is not null"), told).orderBy("lang").collect()] == [("de", 1, 1), ("en", 1, 1), ("uk", 1, 1)]


def test_trigram_ranks():
    """The array form against counting one by one."""
    texts = ["the cat the", "a", "", "x" * 700 + " é ü", "b a b a " * 200]
    rows = [("en", k, g) for k, g in enumerate([" th", "the", "he ", "cat"])] + [("de", k, g) for k, g in enumerate([" b ", " a ", " th"])]
    known = language.Profiles(rows)
    for t, told in zip(texts, known.detect(texts), strict=True):
        padded = f" {t} "
        counts = collections.Counter(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
        ranked = sorted(counts, key=lambda g: (-counts[g], g))[: language.RANKED]
        far = {lang: sum(abs(k - dict((g, r) for la, r, g in rows if la == lang)[g]) if g in [x for la, _, x in rows if la == lang] else language.RANKED for k, g in enumerate(ranked)) for lang in ("de", "en")}
        best = min(far, key=lambda x: (far[x], x))
        assert told == (best if far[best] < language.RANKED * len(ranked) else "und")


def test_trigrams_of_many_texts(monkeypatch):
    """Texts together are told as each alone, of few characters and of very many; scripts are looked up
    once for each character that occurs, not for each place."""
    rows = [("en", k, g) for k, g in enumerate([" th", "the", "he ", "cat"])] + [("uk", k, g) for k, g in enumerate([" ві", "він", "ін "])]
    known, asked, plain = language.Profiles(rows), [], language.script_of
    few = ["the cat the", "він", "", "a", "ab він", "中文 カナ", "漢字", "12", "qq xx"] * 40
    many = [*few, "".join(map(chr, range(0x4E00, 0x9FFF))) + " " + "".join(map(chr, range(0x10000, 0x1FFFF)))]
    monkeypatch.setattr(language, "script_of", lambda points: asked.append(len(points)) or plain(points))
    for texts in (few, many):
        asked.clear()
        told = known.detect(texts)
        assert sum(asked) <= len(set(" ".join(texts)))
        assert told == [known.detect([t])[0] for t in texts]
    assert told[:9] == ["en", "uk", "und", "und", "uk", "ja", "zh", "und", "und"]


def test_language_held_out(spark):
    """Profiles from three documents in four tell the language of the fourth."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("part"))
    told = language.trigram_detector(language.learn(d.filter("part <> 2")))
    rows = language.accuracy(d.filter("part = 2 and length(text) >= 40"), told).collect()
    assert sum(r.correct for r in rows) >= 0.95 * sum(r.documents for r in rows)


def test_grammar(spark):
    got = {r.doc_id: r for r in grammar.grammar(docs(spark, "the the cat ,dog", "fine", None, "\U0001F600 so so so so,x")).collect()}
    assert got[0].grammar_errors == 2 and got[0].grammar_by_category == {"GRAMMAR": 1, "TYPOGRAPHY": 1} and got[1].grammar_errors == 0
    assert [(e.rule_id, e.position, e.length) for e in got[0].errors] == [("REPEATED_WORD", 0, 7), ("SPACE_BEFORE", 10, 3)]
    assert [(e.rule_id, e.position, e.length) for e in got[3].errors] == [("REPEATED_WORD", 3, 5), ("REPEATED_WORD", 9, 5), ("NO_SPACE", 13, 3)]


def test_grammar_service(spark):
    def post(url, form):
        if "bad" in form["text"]:
            return 500, {}
        return 200, {"matches": [{"message": "m", "offset": 3, "length": 2, "rule": {"id": "R", "category": None}}] if form["text"] == "x" else []}

    service = providers.GrammarService("http://g", post)
    d = spark.createDataFrame([(2**60 + 1, "x"), (None, "y")], "doc_id long, text string")
    assert [tuple(r) for r in grammar.errors(d, service).collect()] == [(2**60 + 1, "R", "Other", "m", 3, 2)]
    assert {r.doc_id: r.grammar_errors for r in grammar.grammar(docs(spark, "x", "z"), service).collect()} == {0: 1, 1: 0}
    both = docs(spark, "bad", "x")
    assert [tuple(r) for r in grammar.failures(both, service).collect()] == [(0, "grammar service: status 500")] and grammar.errors(both, service).count() == 1
    got = {r.doc_id: (r.grammar_errors, r.error) for r in grammar.grammar(both, service).collect()}
    assert got == {0: (None, "grammar service: status 500"), 1: (1, None)}


def test_language_service(spark):
    def post(path, payload):
        if path == "perplexity":
            return (503, {}) if payload["text"] == "off" else (200, {"perplexity": 30.0})
        if path == "lemmatize":
            return 200, {"tokens": [{"lemma": w.rstrip("s"), "pos": "N"} for w in payload["text"].split()]}
        raise OSError

    service = providers.LanguageService(post)
    got = docs(spark, "on", "off").select(service.perplexity(F.col("text")).alias("p")).collect()
    assert [r.p for r in got] == [30.0, None]
    assert [(x.text, x.lemma, x.pos) for x in metrics.lemmas(docs(spark, "Cats 12 dog"), service.lemmas).first().lemmas] == [("cats", "cat", "N"), ("dog", "dog", "N")]
    assert metrics.lemmas(docs(spark, "x")).first().lemmas is None
    with pytest.raises(Exception, match="unavailable"):
        docs(spark, "on").select(service.embedding(F.col("text"))).collect()


def test_metadata(spark):
    d = spark.createDataFrame([("D:20240102030405+03'00'",), ("D:20240102",), ("x",), (None,)], "raw string")
    got = [r.t for r in d.select(metadata.pdf_date(F.col("raw")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), None, None]
    more = spark.createDataFrame([("D:2024010203040",), ("D:20241340256199Z",), ("D:2024010",)], "raw string")
    assert [r.t for r in more.select(metadata.pdf_date(F.col("raw")).alias("t")).collect()] == [dt.datetime(2024, 1, 2, 3, 4), dt.datetime(2025, 2, 10, 2, 2, 39), None]
    x = spark.createDataFrame([("<a><dc:b x='1'> t &amp; u </dc:b></a>",), ("<dc:bc>no</dc:bc><dc:b></dc:b>",), ("<dc:b><i/></dc:b><dc:b>2</dc:b>",), ("",), (None,)], "x string")
    assert [r.t for r in x.select(metadata.xml_tag(F.col("x"), "dc:b").alias("t")).collect()] == ["t &amp; u", "", "2", None, None]


def docx(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:p><w:r><w:rPr><w:vanish/><w:sz w:val="8"/></w:rPr><w:t>Hidden words</w:t></w:r></w:p><w:p><w:t>Next</w:t></w:p></w:document>'
    core = "<c><dc:creator>Someone</dc:creator><dcterms:created>2024-01-01T00:00:00Z</dcterms:created></c>"
    (tmp_path / "a.docx").write_bytes(docx(word__document_xml=body, docProps__core_xml=core))
    (tmp_path / "b.txt").write_text("﻿Plain text")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "d.bin").write_bytes(b"ab\0cd")
    read = files.read_files(spark, str(tmp_path))
    kept, gone = files.within_limits(read, EngineConfig(max_file_mb=0))
    assert kept.count() == 0 and gone.count() == 4
    pdf = F.udf(lambda c: None if c is None else ("", 2), "text string, pages int")
    ocr = F.udf(lambda c: ["one", "two"], "array<string>")
    got = {r.path[-5:]: r for r in files.extract(read, pdf=pdf, ocr=ocr).collect()}
    assert got["a.docx"[-5:]].text == "Hidden words\n\nNext" and got["b.txt"].text.startswith("﻿") and got["c.pdf"].text == "one\n\ntwo" and got["d.bin"].error == "UNSUPPORTED_TYPE"
    flags = tampering.docx_findings(files.extract(read).select(F.col("path").alias("doc_id"), "xml")).collect()
    assert {(r.kind, r.least_points) for r in flags} == {("vanish", None), ("size", 4.0)}
    assert [r.author for r in files.file_metadata(files.extract(read), F.current_timestamp()).collect() if r.author] == ["Someone"]
    declared = read.withColumn("declared", F.lit("text/plain"))
    (tmp_path / "e").write_text("no name")
    (tmp_path / "f").write_bytes(b"GIF89a no nul")
    declared = files.read_files(spark, str(tmp_path)).withColumn("declared", F.lit("text/plain"))
    assert {r.path[-2:]: r.mime for r in files.extract(declared).collect() if r.path[-2] == "/"} == {"/e": "text/plain", "/f": None}


def test_pdf_information(spark):
    body = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 9 0 R >> endobj\n3 0 obj << /Title (x) /Author (A \\(b\\) \\101) /Producer <FEFF0041> /CreationDate (D:20240101000000Z) /ModDate (D:20240301000000) >> endobj\ntrailer << /Root 1 0 R /Info 3 0 R >>"
    assert pdf.read(body) == ("", 0, None, ("A (b) A", "A", None, "D:20240101000000Z", "D:20240301000000"))
    assert pdf.read(b"%PDF-1.4 x")[2:] == ("PDF_BROKEN", (None,) * 5) and pdf.read(None) == (None, None, None, (None,) * 5)
    rows = spark.createDataFrame([("a.pdf", bytearray(body))], "path string, content binary")
    got = files.file_metadata(files.extract(rows), F.lit("2024-03-01 00:01:00").cast("timestamp")).first()
    assert (got.author, got.producer, got.suspicious, got.suspicion_note) == ("A (b) A", "A", True, "touched_now")


def stream(body, keys=b""):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (keys, len(body), body)


def made_pdf(content, fonts=b"/F << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more=b"", keys=b""):
    """A file of one page without a cross-reference table, so it has to be rebuilt."""
    return b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << %s >> /XObject << /X 5 0 R >> >> >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents [4 0 R] >> endobj\n4 0 obj %s endobj\n%s\ntrailer << /Root 1 0 R %s >>" % (fonts, stream(content), more, keys)


def test_pdf_content():
    text = lambda *a, **k: pdf.read(made_pdf(*a, **k))[0]
    assert text(b"BT /F 10 Tf 1 0 0 1 10 700 Tm [(Hel) -20 (lo) -600 (there)] TJ 0 -12 Td (next) Tj 0 -30 Td (par) Tj ET") == "Hello there\nnext\n\npar"
    assert text(b"BT /F 10 Tf 12 TL 0 700 Td (a) Tj (b) ' 1 2 (c) \" T* (d) Tj ET") == "a\nb\nc\nd"
    assert text(b"q 2 0 0 2 0 0 cm BT /F 5 Tf (in) Tj ET Q % not (this)\nBI /W 1 ID \x00(x) Tj EI BT /F 10 Tf 0 -50 Td <6f7> Tj ET") == "in\n\nop"
    form = b"5 0 obj " + stream(b"BT /F 10 Tf 0 600 Td (form) Tj ET /X Do", b"/Type /XObject /Subtype /Form") + b" endobj"
    assert text(b"BT /F 10 Tf 0 700 Td (page) Tj ET /X Do", more=form).startswith("page\n\nform")
    named = b"/F << /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [500 500] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni0416 /fi] >> >>"
    assert text(b"BT /F 10 Tf (ABC\\344) Tj ET", named) == "éЖfiä"
    cmap = b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange 2 beginbfrange <41> <43> <0061> <8001> <8002> [<00660066> <D83DDE00>] endbfrange"
    wide = b"/F << /Type /Font /Subtype /Type0 /DescendantFonts [<< /W [65 [1000 400] 70 72 300] >>] /ToUnicode 6 0 R >>"
    assert text(b"BT /F 10 Tf <4180018002 43> Tj ET", wide, b"6 0 obj " + stream(cmap) + b" endobj") == "aff😀c"
    assert text(b"BT /F 10 Tf (a) Tj (broken) BT Tj Td /None Tf ET") == "a"  # operators without operands, an unknown font
    assert pdf.read(made_pdf(b"", keys=b"/Encrypt << >>"))[2] == "PDF_ENCRYPTED"
    looped = made_pdf(b"BT ET").replace(b"/Kids [3 0 R]", b"/Kids [2 0 R 3 0 R 3 0 R]")
    assert pdf.read(looped)[:3] == ("", 1, None)
    deep = made_pdf(b"[" * 5000)
    assert pdf.read(deep)[2] == "PDF_BROKEN"


def test_pdf_filters():
    body = bytes(range(40)) * 3
    rows = [body[i : i + 8] for i in range(0, len(body), 8)]
    for kind in range(5):
        out, above = bytearray(), bytes(8)
        for r in rows:
            left, corner = b"\0\0" + r[:-2], b"\0\0" + above[:-2]
            def paeth(a, b, c):
                return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            guess = [(0, a, b, (a + b) // 2, paeth(a, b, c))[kind] for a, b, c in zip(left, above, corner, strict=True)]
            out += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(r, guess, strict=True))
            above = r
        assert pdf._undone("FlateDecode", zlib.compress(bytes(out)), {"Predictor": 15, "Colors": 2, "Columns": 4}) == body
    tiff = b"".join(bytes((x - y) & 255 for x, y in zip(r, b"\0\0" + r[:-2], strict=True)) for r in rows)
    assert pdf._undone("FlateDecode", zlib.compress(tiff), {"Predictor": 2, "Colors": 2, "Columns": 4}) == body
    assert pdf._undone("ASCIIHexDecode", b"41 42 4>", {}) == b"AB@" and pdf._undone("ASCII85Decode", b"<~87cURDZ~>", {}) == b"Hello"
    with pytest.raises(pdf.PdfError):
        pdf._undone("JPXDecode", b"", {})


def test_pdf_round_trip(spark):
    texts = ["", None, "one", "a (b) \\ c\n\nnext\nlast", "π é 北京 😀\tx\n" + "z" * 50, "\n".join(f"line {i}" for i in range(120)), "x\r\ny"]
    rows = [(f"{i}-{c}.pdf", t, c) for i, t in enumerate(texts) for c in (False, True)]
    d = spark.createDataFrame(rows, "path string, text string, c boolean").select("path", pdf.to_pdf(F.col("text"), {"author": F.lit("Ä b"), "modified": F.lit(None).cast("string")}, F.col("c")).alias("content"))
    broken = spark.createDataFrame([("x.pdf", bytearray(b"%PDF-1.4 nothing"))], "path string, content binary")
    got = {r.path: r for r in files.extract(d.unionByName(broken)).collect()}
    assert got["x.pdf"].text is None and got["x.pdf"].error == "PDF_BROKEN"
    for path, t, _ in rows:
        lines = (t or "").split("\n")
        want = "\n\n".join("\n".join(lines[a : a + 50]) for a in range(0, len(lines), 50))
        assert (got[path].text, got[path].error, got[path].pages) == (want, None, -(-len(lines) // 50)) and got[path].info.author == "Ä b"
    whole = pdf.write(texts[3], {"author": "x"}, True)
    for cut in (whole[:-40], whole[:-40] + b"xx" * 30 + whole[-40:]):  # no table, a table that is elsewhere
        assert pdf.read(cut)[0] == texts[3]


def test_replace_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "doc_id long, v string")
    assert files.read_table(spark, folder) is None
    files.replace_rows(rows((1, "a"), (1, "b"), (2, "c"), (None, "n")), folder)
    for _ in range(2):
        files.replace_rows(rows((1, "d")), folder, keys=rows((1, ""), (3, "")))
    read = lambda: sorted((str(r.doc_id), r.v) for r in files.read_table(spark, folder).collect())
    assert read() == [("1", "d"), ("2", "c"), ("None", "n")]
    files.replace_rows(rows().limit(0), folder, keys=rows((2, "")))
    files.replace_rows(rows((None, "m")), folder)
    assert read() == [("1", "d"), ("None", "m")]
    files.replace_rows(rows().limit(0), folder, keys=rows((1, ""), (None, "")))
    assert read() == []
    files.replace_rows(rows((7, "x")), folder)
    assert read() == [("7", "x")]


def test_keyed_table(spark, tmp_path, monkeypatch):
    """Buckets split as they grow; a run that breaks off changes nothing; writers don't undo each other."""
    t = tables.KeyedTable(spark, str(tmp_path / "t"), rows=20)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "doc_id long, v string")
    have = {}
    for ids, v in ((range(100), "a"), (range(50, 150), "b"), ([3], "c"), ([10**9] * 60, "hot"), (range(0, 150, 7), "d")):
        t.replace(rows(ids, v))
        have |= {i: [v] * list(ids).count(i) for i in ids}
        now = t.snapshot()
        assert sorted((r.doc_id, r.v) for r in t.read().collect()) == sorted((i, x) for i, vs in have.items() for x in vs)
        assert sum(b.rows for b in now.buckets) == sum(map(len, have.values())) and len({(b.bits, b.value) for b in now.buckets}) == len(now.buckets)
        assert sum(2.0**-b.bits for b in now.buckets) == 1.0  # every key has one bucket
    assert len(now.buckets) > 4 and sorted(r.v for r in t.read(0).collect()) == ["a"] * 100
    before = t.versions()
    with monkeypatch.context() as m:
        m.setattr(tables.KeyedTable, "_commit", lambda self, after: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.replace(rows(range(150), "lost"))
    assert t.versions() == before and t.read().filter("v = 'lost'").isEmpty()
    reader = t.read()  # of the snapshot of now
    stale = t.snapshot()
    t.replace(rows([5], "new"))
    with monkeypatch.context() as m:
        m.setattr(tables.KeyedTable, "snapshot", lambda self, version=None: stale)
        with pytest.raises(tables.ConflictError):
            t.replace(rows([5], "late"))
    assert [r.v for r in t.read().filter("doc_id = 5").collect()] == ["new"] and reader.filter("doc_id = 5 and v = 'new'").isEmpty()
    gone = t.vacuum()
    assert len(gone) >= 3 and t.versions() == before[-1:] + [before[-1] + 1] or t.versions() == [before[-1] + 1]
    assert t.read().count() == sum(map(len, have.values()))
    calls = spark.sparkContext.accumulator(0)

    def asked(i):
        calls.add(1)
        return str(i)

    t.replace(rows(range(10), "x").withColumn("v", F.udf(asked)("doc_id")))
    assert calls.value == 10  # rows are worked out once


def test_keyed_table_places(spark, tmp_path):
    """Rows find their buckets, of several depths, where they are: joined to them, all would meet in one task."""
    t = tables.KeyedTable(spark, str(tmp_path / "t"))
    buckets = [(1, 0), (2, 1), (3, 3), (3, 7)]
    placed = t._placed(spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id")), buckets)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    hashed = {r.doc_id: r.h for r in spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id")).select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = {i: next((b, v) for b, v in buckets if h % (1 << b) == v) for i, h in hashed.items()}
    assert {r.doc_id: (r.bits, r.value) for r in placed.collect()} == want and len(set(want.values())) == 4


def test_word_counts(spark):
    """Rows are counted where they are, rows that share an id (null too) together; texts without words give none."""
    rows = [(1, "a b a É"), (2, ""), (3, None), (4, "x y"), (4, "Y z"), (None, "q"), (None, "q r"), (5, " .,! "), (6, "_a1-b_")]
    got = [(r.doc_id, r.word, r.cnt) for r in spam.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = collections.Counter((i, w) for i, t in rows for w in re.findall("[^\\W_]+", (t or "").lower()))
    assert sorted(got, key=str) == sorted(((*k, n) for k, n in want.items()), key=str)
    plan = spam.word_counts(spark.createDataFrame(rows[:4], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert spam.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_add_corpus(spark, tmp_path):
    folder = str(tmp_path / "c")
    sources = spark.createDataFrame([(1, "T", "u", BASE), (2, "T", "u", BASE), (3, "V", None, "one two three four five")], "doc_id long, title string, source_url string, text string")
    for _ in range(2):
        files.add_corpus(sources, folder, embedder=lambda s: F.array(F.length(s).cast("float")))
    assert [(r.doc_id, r.embedding) for r in files.read_table(spark, f"{folder}/sentences").orderBy("doc_id").collect()] == [(1, [float(len(BASE))]), (3, [23.0])]
    assert sorted(r.doc_id for r in files.read_table(spark, f"{folder}/documents").collect()) == [1, 3]
    assert files.read_table(spark, f"{folder}/shingles").count() == 9 and {r.corpus_doc_id for r in files.read_table(spark, f"{folder}/lsh", "corpus_doc_id").collect()} == {1, 3}


def test_providers(spark):
    sample = spark.createDataFrame([(1, "a b"), (1, "c d")], "doc_id long, phrase string")
    off = providers.external_search(sample, None).first()
    assert not off.enabled and off.queried_phrases == 0 and off.results == []

    def fetch(url, params):
        if params["exactTerms"] == "c d":
            raise OSError
        return {"items": [{"link": "u", "title": "t"}]}

    on = providers.external_search(sample, providers.JsonSearch("http://x", fetch), EngineConfig(external_search=True)).first()
    assert on.queried_phrases == 2 and [r.phrase for r in on.results] == ["a b"] and on.results[0].matches[0].url == "u"
    none = providers.external_search(sample, providers.NoSearch(), EngineConfig(external_search=True), docs(spark, "x", "y")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.queried_phrases, len(r.results)) for r in none] == [(0, 0, 0), (1, 2, 2)]  # asked without matches
    xml = "<doc><url> u </url><title>a <b>t</b> &amp; c</title></doc><doc><title>no url</title></doc><doc><url>v</url><passage><i>p</i></passage></doc>"
    assert providers.XmlSearch("http://x", lambda u, p: xml).search("q") == [{"url": "u", "title": "a t &amp; c", "snippet": ""}, {"url": "v", "title": "v", "snippet": "p"}]


def test_dictionaries(spark):
    w = dictionaries.weights_table(spark)
    changed = dictionaries.upsert(w, spark.createDataFrame([("burstiness", 0.5, None)], "feature string, weight double, enabled boolean"), "feature")
    assert dict((r.feature, (r.weight, r.enabled)) for r in changed.collect())["burstiness"] == (0.5, True)
    assert dictionaries.config_from(changed).weights


def test_report_and_engine(spark):
    d, corpus = docs(spark, BASE, "short", None), spark.createDataFrame([(9, BASE, "T")], "doc_id long, text string, title string")
    got = {r.doc_id: r for r in originality_report(d, corpus).collect()}
    assert got[0].originality_pct == 0.0 and got[1].originality_pct == 100.0 == got[2].originality_pct
    frames = Engine(replace(EngineConfig(), paraphrase_threshold=0.9)).analyze(d, corpus, with_paraphrase=True)
    assert {r.doc_id: r.paraphrase_pct for r in frames.results.collect()}[0] == 100.0
    assert frames.copy_sources.first().title == "T" and frames.details.count() == 3 and frames.documents.count() == 3


def test_stages(spark, tmp_path):
    d, corpus = docs(spark, BASE, "short"), spark.createDataFrame([(9, BASE)], "doc_id long, text string")
    length = lambda s: F.array(F.length(s).cast("float"), F.lit(1.0))
    engine = Engine(provider=providers.NoSearch(), embedder=length)
    done = engine.run(d, corpus, str(tmp_path / "ok")).collect()
    assert {(r.doc_id, r.status, r.retry_count, r.failed_stage) for r in done} == {(0, "DONE", 0, None), (1, "DONE", 0, None)}
    assert all(files.read_table(spark, f"{tmp_path}/ok/{s}").count() == 2 for s in jobs.STAGES)

    def refuse(_):
        raise providers.ServiceError("status 500")

    broken, folder = Engine(checker=refuse), str(tmp_path / "bad")
    parts = {name: (lambda _, name=name: engine.sections(d, corpus)[name]) for name in ("plagiarism", "style")} | {"grammar": lambda _: broken.sections(d, corpus)["grammar"]}
    for retries, status in ((0, "PROCESSING"), (2, "FAILED")):
        got = stages.run(d, parts, folder, retries).first()
        assert (got.status, got.retry_count, got.failed_stage, got.failure_reason) == (status, retries + 1, "grammar", "status 500")
    assert files.read_table(spark, f"{folder}/plagiarism").count() == 2 and files.read_table(spark, f"{folder}/style") is None


def test_one_document_fails(spark, tmp_path):
    """A service that raises for some texts fails these alone, and is asked once for each."""
    calls = spark.sparkContext.accumulator(0)

    def post(url, form):
        calls.add(1)
        if "bad" in form["text"]:
            raise OSError("no answer")
        return 200, {"matches": []}

    d, corpus = docs(spark, BASE, "bad text", "fine"), spark.createDataFrame([(9, BASE)], "doc_id long, text string")
    engine, folder = Engine(checker=providers.GrammarService("http://g", post), embedder=lambda s: F.array(F.length(s).cast("float"))), str(tmp_path / "r")
    done = {r.doc_id: (r.status, r.retry_count, r.failed_stage, r.failure_reason) for r in engine.run(d, corpus, folder, 1).collect()}
    assert done == {0: ("DONE", 1, None, None), 1: ("PROCESSING", 2, "grammar", "no answer"), 2: ("DONE", 1, None, None)}
    ids = lambda name: sorted(r.doc_id for r in files.read_table(spark, f"{folder}/{name}").filter("section is not null").collect())
    assert ids("plagiarism") == ids("paraphrase") == [0, 1, 2] and ids("grammar") == ids("style") == ids("externalSearch") == [0, 2]


def test_responses(spark):
    d, corpus = docs(spark, BASE, "pаper text"), spark.createDataFrame([(9, BASE, "T")], "doc_id long, text string, title string")
    frames = Engine().analyze(d, corpus, with_paraphrase=True)
    first = json.loads(report.response(frames.documents, frames.results).orderBy("doc_id").first().response)
    assert first["word_count"] == 12 and first["result"]["plagiarism_pct"] == 100.0
    both = [json.loads(r.response) for r in report.details_response(frames.details, frames.tampering_flags).orderBy("doc_id").collect()]
    assert set(both[0]["details"]) == set(jobs.STAGES) and both[0]["details"]["plagiarism"]["sources"][0]["title"] == "T" and both[0]["details"]["paraphrase"]["matched_sentences"] == 1
    assert both[1]["tampering_flags"][0]["position"] == 1 and both[1]["metadata"] is None


def test_queue(spark, tmp_path):
    queue, out = str(tmp_path / "q"), str(tmp_path / "dead")
    jobs.publish(spark.createDataFrame([(1,), (7,)], "job_id long"), queue)
    q = jobs.queued(spark, queue).writeStream.format("memory").queryName("queue").start()
    q.processAllAvailable()
    q.stop()
    taken = spark.table("queue")
    assert taken.count() == 2 and [r.job_id for r in jobs.known_jobs(taken, docs(spark, "a", "b")).collect()] == [1]
    EVENT_FRAME(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    states = jobs.stream_job_states(spark.readStream.schema(EVENT_FRAME(spark).schema).parquet(str(tmp_path / "in")))
    q = jobs.dead_letter_sink(states, out, str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.job_id, r.failed_stage) for r in spark.read.parquet(out).collect()] == [(1, "style")]


EVENTS = [(1, 1, 10, "error", "grammar"), (1, 2, 11, "error", "grammar"), (1, 3, 12, "error", "style"), (1, 4, 13, "done", None), (2, 1, 14, "error", "spam"), (2, 2, 15, "done", None), (2, 3, 16, "error", "spam"), (3, 1, 17, "other", None)]


def EVENT_FRAME(spark):
    return spark.createDataFrame(EVENTS, "job_id long, ts long, event_id long, kind string, stage string")


def test_jobs_batch_and_stream(spark, tmp_path):
    e = EVENT_FRAME(spark)
    want = {1: ("FAILED", 3, "style"), 2: ("DONE", 1, None), 3: ("PROCESSING", 0, None)}
    assert {r.job_id: (r.status, r.retry_count, r.failed_stage) for r in jobs.job_states(e).collect()} == want
    assert [r.job_id for r in jobs.dead_letters(jobs.job_states(e)).collect()] == [1]
    assert jobs.status_until_terminal(e).filter("job_id = 2").count() == 2
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_job_states(stream).writeStream.format("memory").queryName("states").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {r.job_id: (r.status, r.retry_count, r.failed_stage) for r in spark.table("states").collect()} == want


def feed(spark, folder, rows):
    """Appends events (job_id, second, event_id, kind) to a folder that a stream reads."""
    at = F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")
    spark.createDataFrame(rows, "job_id long, s long, event_id long, kind string").select("job_id", at, "event_id", "kind").coalesce(1).write.mode("append").parquet(folder)


def test_status_stream(spark, tmp_path):
    """Batch by batch, restarted each time: events up to the first terminal one, whenever they come."""
    folder, rows = str(tmp_path / "in"), []
    batches = [[(1, 1, 1, "other"), (2, 1, 2, "error"), (2, 2, 3, "done"), (2, 3, 4, "other")], [(1, 5, 5, "done"), (1, 6, 6, "other"), (3, 7, 7, "other")], [(1, 8, 8, "other"), (2, 9, 9, "done"), (3, 10, 10, "failed")]]
    for b in batches:
        feed(spark, folder, b)
        rows += b
        stream = jobs.status_stream(spark.readStream.schema("job_id long, ts timestamp, event_id long, kind string").parquet(folder))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    e = spark.createDataFrame(rows, "job_id long, ts long, event_id long, kind string")
    want = sorted(r.event_id for r in jobs.status_until_terminal(e).collect())
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want == [1, 2, 3, 5, 7, 10]


def test_deliveries(spark, tmp_path):
    """Redelivery after a delay and after silence, dead letters, jobs never published; with restarts."""
    folder, base = str(tmp_path / "in"), 1_700_000_000
    batches = [[(1, 0, 1, "published"), (2, 0, 2, "published"), (3, 0, 3, "published"), (9, 0, 4, "error")], [(1, 10, 5, "error"), (3, 12, 6, "done"), (3, 13, 7, "error")],
               [(8, 200, 8, "published")], [(1, 210, 9, "error"), (8, 215, 10, "done")], [(7, 700, 11, "published"), (1, 710, 12, "error"), (1, 711, 13, "error")], [(6, 800, 14, "published")]]
    for b in batches:
        feed(spark, folder, b)
        stream = jobs.deliveries(spark.readStream.schema("job_id long, ts timestamp, event_id long, kind string").parquet(folder))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.job_id, r.ms // 1000 - base, r.attempt, r.what) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, 1, "delivered"), (1, 70, 2, "delivered"), (1, 270, 3, "delivered"), (1, 710, 3, "dead"), (2, 0, 1, "delivered"), (2, 600, 2, "delivered"),
                   (3, 0, 1, "delivered"), (3, 12, 1, "done"), (6, 800, 1, "delivered"), (7, 700, 1, "delivered"), (8, 200, 1, "delivered"), (8, 215, 1, "done")]


def test_analyze_stream(spark, tmp_path):
    source = tmp_path / "docs"
    schema = "doc_id long, text string"
    run = lambda: jobs.analyze_stream(spark.readStream.schema(schema).parquet(str(source)), lambda b: {"metrics": metrics.basic_metrics(b)}, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    for rows in ([(1, "one"), (2, "one")], [(3, "one"), (4, "two")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = run()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out/metrics")).count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashes_leave_documents_once(spark, monkeypatch):
    line = "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"{line} eight nine", "a"), (2, f"zero {line}", "a"), (3, "nothing of all that is in here", "b"), (3, line, "b"), (None, line, "a"), (4, None, "a")], "doc_id long, text string, source string")
    corpus = spark.createDataFrame([(7, line), (8, "some more words that nobody has")], "doc_id long, text string")
    same = lambda df: sorted(map(repr, df.collect()))
    config = replace(EngineConfig(), candidate_gate="none")
    assert plan_of(copying.self_copy_pct(docs, config)).count("ArrowEvalPython") == 1
    assert "Exchange" not in plan_of(copying.rare_shingles(docs, corpus, config))
    assert {(r.doc_id, r.matched_shingles) for r in copying.copy_pct(docs, corpus, config).collect()} == {(1, 3), (2, 3), (3, 3), (None, 0), (4, 0)}
    top = copying.top_hashes(docs, config, 3).collect()
    assert sorted((r.positions, r.docs) for r in top) == [(4, 3)] * 3
    want = [same(f(docs, corpus, config)) for f in (copying.rare_shingles, copying.copy_pct, copying.copy_sources)]
    monkeypatch.setattr(copying, "SENT", 0)  # a filter in place of the hashes, so full that others pass
    monkeypatch.setattr(copying, "FILTER_BITS", 64)
    for f, rows in zip((copying.copy_pct, copying.copy_sources), want[1:], strict=True):
        assert same(f(docs, corpus, config)) == rows
    single = docs.filter("doc_id in (1, 2)")
    rare = same(copying.rare_shingles(single, corpus, config))
    monkeypatch.undo()
    assert rare == same(copying.rare_shingles(single, corpus, config))


def test_signatures_go_on_in_parts(spark):
    docs = spark.createDataFrame([("x", " ".join(map(str, range(60)))), ("y", None), ("z", "a b c d e f")], "doc_id string, text string")
    found = copying.signatures(docs)
    assert "MapInArrow" in plan_of(found)
    each = copying.hashed(docs).select("doc_id", F.posexplode(minhash.window_signatures(F.col("hashes"))))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, each.collect()))


def test_top_words_without_shuffle(spark):
    stop = sorted(LATIN.stop_words)[0]
    docs = spark.createDataFrame([(1, f"bb red 𐐨𐐨 blue red {stop} {stop} 𐐨 {stop}"), (2, ""), (3, None)], "doc_id long, text string")
    tokens = metrics.tokenized(docs)
    assert "Exchange" not in plan_of(spam.top_words(tokens, LATIN)) and "Exchange" not in plan_of(spam.spam(tokens, LATIN))
    assert [tuple(r) for r in spam.top_words(tokens, LATIN).orderBy("rank").collect()] == [(1, 1, "red", 2), (1, 2, "𐐨𐐨", 1), (1, 3, "blue", 1)]
    again = metrics.tokenized(docs.unionByName(spark.createDataFrame([(1, "blue blue"), (None, "green green"), (None, "green")], docs.schema)))
    assert sorted(((r.doc_id or 0, r["rank"], r.word, r.cnt) for r in spam.top_words(again, LATIN).collect())) == [(0, 1, "green", 3), (1, 1, "blue", 3), (1, 2, "red", 2), (1, 3, "𐐨𐐨", 1)]
    assert sorted((r.doc_id or 0, r.spam_pct) for r in spam.spam(again.filter("doc_id > 1"), LATIN).collect()) == [(2, 0.0), (3, 0.0)]


def test_files_in_small_batches(spark):
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    found = queries.in_batches(spark.range(2000, numPartitions=1).select(size("id").alias("n")))
    assert found.agg(F.max("n"), F.count("*")).first() == (queries.FILES_AT_ONCE, 2000)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_perplexity_by_rows(spark, monkeypatch, order):
    texts = spark.createDataFrame([("a b c a b d",), ("b c",), (None,), ("a b c",)], "text string")
    asked = spark.createDataFrame([(1, "a b c x y a b"), (2, "a"), (3, None), (4, "x y z"), (None, "b c"), (None, "a")], "doc_id long, text string")
    model = ngrams.train(texts, order)
    found = ngrams.perplexity(asked, model)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    rows = {r.doc_id: r.perplexity for r in found.collect()}
    single = asked.filter("doc_id is not null")
    tokens = ai.with_perplexity(metrics.tokenized(single), single, model)
    assert "Exchange" not in plan_of(tokens)
    assert {r.doc_id: r.ppl for r in tokens.collect()} == pytest.approx({k: v for k, v in rows.items() if k is not None})
    monkeypatch.setattr(ngrams, "SENT", 0)
    assert {r.doc_id: r.perplexity for r in ngrams.perplexity(asked, model).collect()} == pytest.approx(rows)


def test_report_hashes_once(spark):
    texts = spark.createDataFrame([(1, BASE, "a"), (2, f"{BASE} more", "a"), (3, None, "a"), (4, "𐐨𐐨 here. A, b, c. 𐐨𐐨 there", None)], "doc_id long, text string, source string")
    cut = copying.hashed(texts, EngineConfig(), "source")
    assert cut.columns == ["doc_id", "source", "hashes"]
    assert sorted(map(repr, copying.self_copy_pct(cut).collect())) == sorted(map(repr, copying.self_copy_pct(texts).collect()))
    assert sorted(map(repr, copying.copy_pct(cut, texts).collect())) == sorted(map(repr, copying.copy_pct(texts, texts).collect()))
    tokens = metrics.tokenized(texts).filter("doc_id = 4")
    row = tokens.first()
    assert len(row.sentence_words) == len(row.sentences) and sum(map(list, row.sentence_words), []) == list(row.words)
    assert ai.ai_probability(tokens, LATIN).first().synonym_chains > 0


def test_latent_repeats_once(spark, monkeypatch):
    """Repeated sentences are multiplied once and count as often as they come."""
    texts = ["red green blue", "red green", "dog cat bird", "dog cat", "red dog"] * 7 + ["red green blue"] * 20
    kept, stored = {}, latent.stored
    monkeypatch.setattr(latent, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    model = latent.learn(spark.createDataFrame([(t,) for t in texts], "sentence string").repartition(3), 4, 64)
    assert kept["latent-sentences"].count() == 5
    got = np.array([x.e for x in spark.createDataFrame(enumerate(texts[:5]), "i long, s string").select("i", latent.embedder(model, spark)(F.col("s")).alias("e")).orderBy("i").collect()])
    assert np.abs(cosines(got) - cosines(dense_latent(texts, 4, 64)(texts[:5]))).max() < 1e-3


def test_sentences_are_cut_once(spark, monkeypatch):
    """The paraphrase of the report cuts documents and corpus once, and learns from what it stored."""
    calls, cut = [], semantic.sentences
    monkeypatch.setattr(semantic, "sentences", lambda d: calls.append(1) or cut(d))
    d = docs(spark, "One two three. Four five six.", "Seven eight.")
    assert Engine().paraphrase(d, d).count() == 2 and len(calls) == 2


def test_signals_of_a_row_in_proportion(spark):
    """The mean is worked out once a text, not once a sentence; patterns say what their longer forms did."""
    plan = spark.range(1).select(F.array(F.array(F.lit("a"))).alias("sentence_words")).select(ai.burstiness(LATIN, EngineConfig()).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 2
    texts = ["The created word", "ated", "xated", "a,b,c", "a, b,c d", "one,two three, four", ",b,c", "aa,,b,c", "été, à,ß", "A,B , C", "x wird y", "Übered", ""]
    for rx, short in ((f"(?iu){LATIN.passive}", f"(?iu){style.found_alike(LATIN.passive)}"), (r"(?iu)(?:[a-zà-ÿ]+,[\t\n\x0B\f\r\p{Z}\x{FEFF}]*){2,}[a-zà-ÿ]+", None)):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(rx).alias("a"), (F.col("t").rlike(short) if short else F.lit(None)).alias("b"),
                                                                             F.array("t").alias("sentences")).select("*", ai.synonym_chains(LATIN, EngineConfig()).alias("c")).collect()
        assert short != rx and all((r.b if short else r.c == 1.0) == r.a for r in rows) and {r.a for r in rows} == {True, False}


def test_self_copies_hash_once(spark, monkeypatch):
    """Texts are hashed once, hashes counted in their documents, and two classes meet once for both ways."""
    calls, hashed, kept, stored = [], copying.hashed, {}, copying.stored
    monkeypatch.setattr(copying, "stored", lambda df, name: kept.setdefault(name, (stored(df, name), df))[0])
    monkeypatch.setattr(copying, "hashed", lambda *a: calls.append(1) or hashed(*a))
    d = spark.createDataFrame([(1, f"{BASE} {BASE}", "a"), (2, BASE, "a"), (3, f"x {BASE}", "a"), (3, None, "a"), (4, BASE, "b")], "doc_id long, text string, source string")
    got = {(r.doc_id, r.other_doc_id): r.matched_shingles for r in copying.self_copy_sources(d).collect()}
    assert got == {(1, 2): 8, (1, 3): 8, (2, 1): 16, (2, 3): 8, (3, 1): 16, (3, 2): 8}
    assert len(calls) == 1 and kept["self-copy-passages"][0].count() == 2  # documents 2 and 3 are one class, beside that of 1
    assert len(re.findall("LogicalRDD|LocalRelation", kept["self-copy-hashes"][1]._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_report_joins_stored_parts(spark, monkeypatch):
    """No text is read, and no Python run, by the query that joins the parts; batches for Python are small."""
    sizes, stored = {}, report.stored
    monkeypatch.setattr(report, "stored", lambda df, name: sizes.setdefault(name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) and stored(df, name))
    d = docs(spark, BASE, f"{BASE} more", None)
    plan = originality_report(d, docs(spark, BASE), LATIN)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "LogicalRDD" not in plan
    assert sizes["report-signals"] == sizes["report-hashes"] == str(report.AT_ONCE)
    one = [(1, BASE, "a"), (1, f"{BASE} x", "a"), (2, BASE, "a")]
    for rows, unique in ((one, False), (one[1:], True)):
        d = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = [sorted(map(repr, copying.self_copy_pct(d, unique=u).collect())) for u in (False, unique)]
        assert got[0] == got[1]


@pytest.mark.parametrize("ids", [(1, 2, 3, 4, 5), (1, 1, 3, 4, None)])
def test_sections_together(spark, ids):
    """Sections from what is stored once are those that each work out their own; texts are in no plan of a signal."""
    texts = [BASE + " the end. A created thing, of the, b.", f"{BASE}  more , x", None, "", "one one. Two the the words words words."]
    d = spark.createDataFrame([(i, t, "a") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, source string")
    engine = Engine(profile=LATIN)
    apart, together = (engine.sections(d, docs(spark, BASE), False, True, t) for t in (False, True))
    assert list(apart) == list(together)
    for name in apart:
        assert sorted(map(repr, apart[name].collect())) == sorted(map(repr, together[name].collect())), name
        if name in ("style", "aiDetector"):
            assert "sentences" not in together[name]._jdf.queryExecution().optimizedPlan().toString().replace("long_sentences", "")
