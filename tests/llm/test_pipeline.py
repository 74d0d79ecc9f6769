"""Each stage of the pipeline against a plain version on its own input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from lexloom.llm import jaccard, langid, toxicity


@pytest.fixture()
def folder(spark, tmp_path):
    en, de = "the cat sat on the mat and the dog ran to me ", "der hund und die katze sind im garten mit dir "
    rows = [(i, (en if i % 2 else de) * 3 + f"number{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i} l{i}" + (" zzbad qqworse" if i % 10 == 3 else ""), "en" if i % 2 else "de", "s", 1) for i in range(100)]
    rows += [(200, rows[1][1], "en", "s", 1), (201, None, "en", "s", 1), (202, "99 ??", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 3)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = C.language(spark, docs, folder)
    assert kept.columns == docs.columns
    said = {r.doc_id for r in langid.languages(docs).collect() if r.lang_pred != "und" and r.score >= C.LEAST_CERTAIN}
    assert {r.doc_id for r in kept.collect()} == said and not {201, 202} & said and len(said) == 101
    clean = C.clean(spark, docs, folder)
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and bad == {i for i in range(100) if i % 10 == 3}
    one = C.distinct(spark, docs, folder)
    low = {r.component_id for r in jaccard.join(docs).collect()}
    assert {r.doc_id for r in one.collect()} == low and 200 not in low and one.columns == docs.columns


def test_run(spark, folder):
    got = C.run(spark, folder)
    assert {r.doc_id for r in got.collect()} == {i for i in range(100) if i % 10 != 3} and "sequence_id" in got.columns


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stage_edges(spark, folder):
    """Null and large ids, nulls in every column, a very long text, repeated rows, clashing columns."""
    en = "the cat sat on the mat and the dog ran to me "
    long = " ".join(f"{w}{i}" for i in range(8000) for w in ("the", "cat"))
    rows = [(2**60 + 1, en + "one here", "en", "s", 1), (2**60 + 2, en + "der zwei", None, None, None), (None, en + "two now", "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0),
            (7, long, "en", "s", 1), (8, long, "en", "s", 1), (9, en * 3 + "x", "en", "s", 1), (9, en * 3 + "x", "en", "s", 1), (9, en * 3 + "y", "en", "s", 2), (10, "zzbad qqworse " * 9, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], f"{KIND}, score string, component_id int, rank int").coalesce(1)
    learned = spark.read.parquet(f"{folder}/documents.parquet")
    names = lambda d: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in d.collect()))
    both = docs.unionByName(learned.filter("doc_id < 200").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    kept = C.language(spark, both, folder)
    assert kept.columns == C.COLUMNS
    assert {i for n, i, _ in names(kept) if not n} >= {2**60 + 1, 2**60 + 2, 7, 8, 9} and not {5, 6} & {i for _, i, _ in names(kept)} and any(n for n, _, _ in names(kept))
    clean = C.clean(spark, both.withColumn("doc_id", F.when(F.col("doc_id").between(1000, 2000), F.col("doc_id") - 1000).otherwise(F.col("doc_id"))), folder)
    assert clean.columns == C.COLUMNS and not any("zzbad" in t for _, _, t in names(clean)) and {2**60 + 1, 2**60 + 2, 5, 6, 7, 8} <= {i for n, i, _ in names(clean) if not n}
    one = names(C.distinct(spark, docs, folder))
    assert [i for n, i, _ in one if not n] == [5, 6, 7, 9, 10, 2**60 + 1, 2**60 + 2] and [t for n, _, t in one if n] == [rows[2][1]]
    packed = C.packed(spark, docs, folder).collect()
    assert {str(r.doc_id) for r in packed} == {str(r[0]) for r in rows} and sum(r.length for r in packed if r.doc_id == 9) == sum(r.doc_tokens for r in packed if r.doc_id == 9 and r.start == 0)


def test_packed_is_the_packing_of_all(spark, folder):
    """Every id of every document in one piece, against the library; nothing overlaps."""
    from tokenizers import Tokenizer

    from lexloom.llm.common import tokenizer_path

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    want = {r.doc_id: [*encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    places = {}
    for r in C.packed(spark, docs, folder).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        for k in range(r.length):
            assert places.setdefault((r.sequence_id, r.offset + k), (r.doc_id, r.start + k)) == (r.doc_id, r.start + k)
    assert len(set(places.values())) == len(places) == sum(map(len, want.values()))


def least_of_near(texts, size=5, percent=80):
    """The least id of each group that links of at least `percent` by word `size`-grams connect, all pairs compared."""
    grams = {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for i, w in texts.items()}
    low = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and 100 * len(grams[a] & grams[b]) >= percent * len(grams[a] | grams[b])]
    for _ in texts:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return set(low.values()), [(a, b, len(grams[a] & grams[b]) / len(grams[a] | grams[b])) for a, b in links]


def test_distinct_near_copies(spark):
    """Added paragraphs and single changed words around the least similarity, one copy of a copy."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**6)}"
    texts = {i: [word() for _ in range(200 + i)] for i in range(20)}
    for i, more in enumerate((8, 16, 24, 30, 36, 42, 48, 49, 50, 51, 60, 90)):
        texts[100 + i] = texts[i] + [word() for _ in range(more)]
    for i in range(12, 18):
        texts[100 + i] = list(texts[i])
        for k in range(i - 11):
            texts[100 + i][15 + 30 * k] = word()
    texts[200] = texts[103] + [word() for _ in range(40)]
    kept, links = least_of_near(texts)
    assert sum(0.8 <= s < 0.9 for _, _, s in links) >= 8 and 200 not in kept and 111 in kept
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.distinct(spark, docs, "").collect()} == kept
