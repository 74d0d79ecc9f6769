"""Training-data operators on small rows: brute force, round trips and edge cases."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, bpe, embedding_dedup, jaccard, langid, lm, packing, queries, token_files, toxicity, url_filter
from lexloom.llm.chunk_encoder import ChunkEncoder
from lexloom.llm.common import tokenizer_path
from lexloom.llm.components import components

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "a", "a  b", " lead", "trail ", "x\ty", "A B\n\nc", "é ünï ΑΣ 北京", "it's 12,3 <|endoftext|> end", "\r\n x", "word " * 3000, "y" * 5000, "a", "a",
       "\nfoo bar\nbaz", "a b c\x1cd", "a\u3000b", "don't. stop,now x, y. .", "  a", "tail\n", "end ."]
#: Ids that a double can't hold; every operator that hands on doc_id has to keep them beside a null.
LARGE = [2**60 + 1, 2**60 + 2, -(2**60) - 1, None]


def large(spark, texts=("one two three", "four five six", "seven eight nine", "ten")):
    rows = [(i, t, "en") for i, t in zip(LARGE, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word int" if extra else "doc_id long, text string, lang string, n int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def tokens(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_chunk_encoder(path, kind):
    e = ChunkEncoder(path, kind, keep=3)
    texts = [t or "" for t in ODD] + ["Straße, naïve. résumé! Ünder İstanbul ǅ ﬁne"]
    for _ in range(2):
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert got.tolist() == tokens(path, t), t


def test_op1(spark):
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, ODD), BYTE).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        ids = tokens(BYTE, t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty(spark), BYTE).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(frame(spark, ODD), BYTE), BYTE).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(ODD)}


def test_ids_stay_exact(spark):
    """Ids that a double can't hold, a null among them, through every operator that hands on doc_id."""
    d = large(spark)
    labels = spark.createDataFrame([(LARGE[0], 1), (LARGE[1], 0), (None, 1)], "doc_id long, toxic int")
    for name, got in {
        "op1": bpe.round_trip(d, BYTE), "op2": jaccard.join(d), "op3": lm.score(d), "op4": token_files.digest(d, WORD), "op5": langid.languages(d),
        "op9": packing.pack(d, BYTE), "op10": toxicity.toxicity(d, labels)}.items():
        assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, LARGE)), name
    also = langid.identify(d.withColumn("n", F.col("doc_id")), langid.ByteCNN(["en"]), ["n"]).collect()
    assert all(r.n == r.doc_id for r in also)


def test_clashing_columns(spark):
    """Columns of the table with the names that operators use themselves change nothing."""
    texts = ["one two three four", "one two three four", None, "", "five six " * 50]
    plain = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    more = plain
    for c in ("ids", "n", "id", "word", "words", "part", "bucket", "train", "score", "n_tokens", "start", "length", "prefix", "bits", "h1", "h", "component", "predicted", "toxic", "lang_pred", "base"):
        more = more.withColumn(c, F.lit("x"))
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, toxic int").withColumns({"text": F.lit("y"), "score": F.lit(1)})
    for run in (lambda d: bpe.round_trip(d, BYTE), jaccard.join, lm.score, lambda d: token_files.digest(d, WORD), langid.languages, lambda d: packing.pack(d, BYTE), lambda d: toxicity.toxicity(d, labels)):
        a, b = (sorted(map(str, run(d).collect())) for d in (plain, more))
        assert a == b
    urls = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert url_filter.filter_urls(urls.withColumns({c: F.lit("x") for c in ("gram", "n", "rule", "ruled", "copies", "score", "rest")})).collect() == url_filter.filter_urls(urls).collect()


def test_op1_words_that_a_partition_lacks(spark, monkeypatch):
    """Texts dealt otherwise on the second reading come out alike."""
    folder = bpe.word_ids(frame(spark, ["other words only"]).coalesce(1), BYTE)
    monkeypatch.setattr(bpe, "word_ids", lambda *_: folder)
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode_documents(frame(spark, ODD), BYTE).collect()}
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in got.items()} == {i: tokens(BYTE, t) for i, t in enumerate(ODD)}


def test_buckets_of_words():
    import pyarrow as pa

    from lexloom.llm import partition_words as parts

    words = pa.array(["", "a", "b", "ab", "ba", "x" * 200, "ü", ""])
    got = parts.bucket(words, 1000)
    assert got[0] == got[7] and len(set(got.tolist())) >= 6 and all(parts.bucket(words[i : i + 1], 1000)[0] == got[i] for i in range(8))
    assert parts.cut(parts.joined(words, np.array([3, 5]))).to_pylist() == words.to_pylist()


def brute_jaccard(texts, size=3, percent=90):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    low = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    low[i] = min(low[i], low[j])
    return [len(s) for s in sets], low


def near_texts(seed=1):
    r = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = [None, "", "a", "A", "a b", "A  b", "a b c"]
    for _ in range(4):
        base = list(r.choice(vocab, 60))
        for _ in range(9):
            w = list(base)
            for _ in range(int(r.integers(0, 3))):
                w[int(r.integers(60))] = str(r.choice(vocab))
            out += [" ".join(w)]
    return out + out[-3:]


@pytest.mark.parametrize("limits", [(256, 1500), (2, 3)])
def test_op2(spark, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "LIST", limits[0])
    monkeypatch.setattr(jaccard, "BLOCK", limits[1])
    texts = near_texts()
    got = sorted(jaccard.join(frame(spark, texts)).collect())
    sizes, low = brute_jaccard(texts)
    assert [r.n_shingles for r in got] == sizes and [r.component_id for r in got] == low


@pytest.mark.parametrize("percent", [90, 80, 100])
def test_blocks_of_fitting_sizes(spark, monkeypatch, percent):
    """An entry of a long list goes to blocks of sizes that it may link with, and not to all of them."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    measure, sizes = jaccard.Measure(percent), [1 + int(1.13**k) for k in range(80)] + [300] * 20
    entries = spark.createDataFrame([(7, i, n) for i, n in enumerate(sizes)], "token long, id long, n long")
    met, sent = set(), jaccard.fitting_blocks(entries, measure).collect()
    groups = {}
    for r in sent:
        groups.setdefault((r.token, r.lo, r.hi), []).append(r)
    for (_, lo, hi), rows in groups.items():
        met |= {(x.id, y.id) for x in rows for y in rows if x.id < y.id and (lo == hi or x.block != y.block)}
    want = {(i, j) for j in range(100) for i in range(j) if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])}
    assert want <= met and len(sent) < 100 * 20 / 2  # 20 blocks, if every entry went to each


@pytest.mark.parametrize("cut", [3, 7, 50])
def test_index_lists_over_batches(monkeypatch, cut):
    """Lists that go over from batch to batch stay whole, long ones come out entry by entry."""
    import pandas as pd

    monkeypatch.setattr(jaccard, "LIST", 4)
    r = np.random.default_rng(cut)
    lengths = [1, 2, 9, 12, 3, 4, 5, 1, 20, 2, 8]
    rows = [(t, int(i), 100, 0) for t, n in enumerate(lengths) for i in np.sort(r.choice(1000, n, replace=False))]
    f = pd.DataFrame(rows, columns=["token", "id", "n", "pos"])
    out = pd.concat(list(jaccard.list_pairs(jaccard.Measure(90))(f.iloc[s : s + cut] for s in range(0, len(f), cut))))
    short = {(int(a), int(b)) for a, b in out[out["a"].notna()][["a", "b"]].itertuples(index=False)}
    by = f.groupby("token")["id"].apply(list)
    assert short == {(x, y) for ids in by if len(ids) <= 4 for k, x in enumerate(ids) for y in ids[k + 1 :]}
    long = out[out["token"].notna()]
    assert long.groupby("token")["id"].apply(lambda v: sorted(map(int, v))).to_dict() == {t: ids for t, ids in by.items() if len(ids) > 4}


@pytest.mark.parametrize("limits", [(256, 1500), (2, 3)])
def test_op2_large_ids(spark, monkeypatch, limits):
    """Neighbouring ids that a double can't tell apart, in long lists, beside a null."""
    monkeypatch.setattr(jaccard, "LIST", limits[0])
    monkeypatch.setattr(jaccard, "BLOCK", limits[1])
    texts = near_texts(7)
    rows = [(2**60 + i, t) for i, t in enumerate(texts)] + [(None, texts[8])]
    got = sorted((r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    assert [r.doc_id - 2**60 for r in got] == list(range(len(texts)))
    assert [r.component_id - 2**60 for r in got] == brute_jaccard(texts)[1]


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_op2_many_candidates(spark, monkeypatch, bits):
    """With more candidates than the bitmap serves for, sets come by a join."""
    monkeypatch.setattr(jaccard, "BITS", bits)
    texts = near_texts(3) + ["long " + " ".join(f"v{i % 700}" for i in range(30000))] * 2
    got = sorted(jaccard.join(frame(spark, texts)).collect())
    assert [r.component_id for r in got] == brute_jaccard(texts)[1]


def test_op2_edges(spark):
    assert jaccard.join(empty(spark)).count() == 0
    d = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.join(d).collect()) == [(0, 1, 0), (3, 0, 3), (5, 1, 5), (5, 1, 5)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = dict((r.id, r.component) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_op3(spark):
    r = np.random.default_rng(0)
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    texts = [" ".join(r.choice(a if i % 2 else b, 30)) for i in range(80)] + [None, "", "Never seen words", "A1 a1"]
    got = sorted(lm.score(frame(spark, texts)).collect())
    words = [(t or "").encode().lower().split() for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = collections.Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + 1
    for row, ws, h in zip(got, words, held, strict=True):
        base = sum(np.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [c[w] for w in ws] + [ends])
        assert row.held_out == h and row.n_tokens == len(ws) + 1 and row.train_tokens == n and row.n_known == 1 + sum(c[w] > 0 for w in ws)
        assert abs(row.base_score - base) < 1e-6 and row.score < 0
    out = [x for x, h in zip(got, held, strict=True) if h and x.n_tokens > 20]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)  # the states tell both kinds of text apart
    assert lm.score(empty(spark)).count() == 0


def test_op3_edges(spark):
    """A very long text, repeated rows, words met in one partition alone."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [long, long.upper(), " a  b ", "a b", "a b", "\x0b\x1c x\u00a0y"]
    d = spark.createDataFrame([(i if i < 4 else 4, t) for i, t in enumerate([*texts, "a b"])], "doc_id long, text string").repartition(5)
    got = sorted(lm.score(d).collect())
    assert [r.n_tokens for r in got] == [60_001, 60_001, 3, 3, 3, 3, 3] and abs(got[0].score - got[1].score) < 1e-6 and len({round(r.score, 9) for r in got if r.doc_id == 4}) == 2
    only = spark.createDataFrame([(i, "a b") for i in range(30) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in lm.score(only).collect())  # nothing to learn from


def test_op3_counts_from_all(spark, monkeypatch):
    """Partitions whose own table is missing look their words up in the table of all."""
    from lexloom.llm import partition_words as parts

    d = frame(spark, [f"a b c{i}" for i in range(20)])
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 9)) for r in lm.score(d).collect())
    original = parts.saved
    monkeypatch.setattr(parts, "saved", lambda blocks, name: original(blocks.filter("part = -1"), name))
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 9)) for r in lm.score(d).collect()) == want


def test_baum_welch(spark):
    """Expected counts against all paths; the sum across partitions against one pass in memory."""
    r = np.random.default_rng(4)
    share = np.array([0.4, 0.3, 0.2, 0.1])
    m = lm.HMM.first(share, 2)
    docs = [r.integers(0, 4, n).astype("<u2") for n in (1, 3, 5, 2, 4, 6, 1)]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for d in docs:
        paths = list(np.ndindex(*[2] * len(d)))
        p = np.array([m.start[q[0]] * m.emit[d[0], q[0]] * np.prod([m.move[q[k - 1], q[k]] * m.emit[d[k], q[k]] for k in range(1, len(d))]) for q in paths])
        for q, w in zip(paths, p / p.sum(), strict=True):
            start[q[0]] += w
            for k, x in enumerate(d):
                emit[x, q[k]] += w
                if k:
                    move[q[k - 1], q[k]] += w
    for got, want in zip(m.expect([d.astype(np.int64) for d in docs]), (start, move, emit), strict=False):
        assert np.allclose(got, want, atol=1e-4)
    table = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "ids binary").repartition(3)
    new, log = lm.baum_welch(table, m, share)
    want = lm.HMM.update(start, move, emit, share)
    assert np.allclose(new.start, want.start, atol=1e-4) and np.allclose(new.move, want.move, atol=1e-4) and np.allclose(new.emit, want.emit, atol=1e-4)
    assert abs(log - m.log10([d.astype(np.int64) for d in docs]).sum()) < 1e-4


def test_hmm_forward_is_exact():
    r = np.random.default_rng(3)
    m = lm.HMM.first(np.array([0.5, 0.3, 0.2]), 3)
    docs = [r.integers(0, 3, n) for n in (1, 4, 2, 4)]
    for d, got in zip(docs, m.log10(docs), strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(d)):
            p = m.start[path[0]] * m.emit[d[0], path[0]]
            for k in range(1, len(d)):
                p *= m.move[path[k - 1], path[k]] * m.emit[d[k], path[k]]
            total += p
        assert abs(np.log10(total) - got) < 1e-9
    start, move, emit, log = m.expect(docs)
    assert abs(log - m.log10(docs).sum()) < 1e-4
    assert abs(emit.sum() - sum(map(len, docs))) < 1e-3 and abs(start.sum() - len(docs)) < 1e-4 and abs(move.sum() - sum(len(d) - 1 for d in docs)) < 1e-3


def test_op4(spark):
    got = sorted(token_files.digest(frame(spark, ODD), WORD).collect())
    at = 0
    for row, t in zip(got, ODD, strict=True):
        ids = [*tokens(WORD, t), 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.digest(empty(spark), WORD).count() == 0


def test_variable_length_coding():
    v = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], np.uint32)
    values, counts = np.concatenate((v, v[:3], v[2:7])), np.array([8, 3, 0, 5])
    control, data, controls, sizes = token_files.encode_ids(values, counts)
    assert token_files.decode_ids(control, data, counts).tolist() == values.tolist() and controls.tolist() == [2, 1, 0, 2] and sizes.tolist() == [18, 4, 0, 15]


def test_op5(spark):
    en, de = "the cat sat on the mat and the dog ran ", "der hund und die katze sind im garten "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de") for i in range(120)] + [(500, None, "en"), (501, "", "en"), (502, "123 !?", "de"), (503, en * 3000, None)]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "en"
    held = [i for i in range(120) if got[i].held_out]
    assert held and all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 for i in held)
    assert langid.languages(empty(spark)).count() == 0
    assert langid.languages(frame(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).first().lang_pred == "und"


def test_op5_network():
    """The tables' forward pass against one filter at a time, byte by byte; windows of a text averaged."""
    m = langid.ByteCNN(["a", "b"], seed=1)
    for w in langid.WIDTHS:
        m.p[f"b{w}"] = np.linspace(-1, 1, langid.FILTERS)
    texts = ["Some text, über alles. " * 9, "x", "y" * 127 + "ü"]

    def probability(window):
        pooled = []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                best = max(sum(m.p["emb"][window[i + k]] @ m.p[f"w{w}"][k][:, f] for k in range(w)) for i in range(len(window) - w + 1))
                pooled.append(max(0.0, best + m.p[f"b{w}"][f]))
        z = np.exp(np.array(pooled) @ m.p["out"] + m.p["out_b"])
        return z / z.sum()

    langs, scores = m.predict(texts)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        data = t.encode()
        data += b" " * (-len(data) % langid.WINDOW)
        mean = np.mean([probability(data[i : i + langid.WINDOW]) for i in range(0, len(data), langid.WINDOW)], 0)
        assert lang == "ab"[int(mean.argmax())] and abs(score - mean.max()) < 1e-5
    even = langid.ByteCNN(["b", "c"])
    even.p["out"][:] = 0
    assert even.predict(["text"]) == (["b"], [0.5])  # equally likely: the first by name


FIXTURES = "/root/testdata/sf0.01"
with_fixtures = pytest.mark.skipif(not __import__("os").path.exists(FIXTURES), reason="no fixture tables")


@with_fixtures
def test_op5_held_out(spark):
    docs = spark.read.parquet(f"{FIXTURES}/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


@with_fixtures
def test_op10_held_out(spark):
    folder = FIXTURES.replace("0.01", "0.1")  # with enough toxic documents held out
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert toxic and sum(r.predicted for r in toxic) / len(toxic) > 0.9 and sum(r.predicted for r in clean) / len(clean) < 0.02


@with_fixtures
def test_op7_against_sql(spark, tmp_path):
    """The whole result against SQL, with rows that repeat, a very long url and nulls."""
    duckdb = pytest.importorskip("duckdb")
    pages = spark.read.parquet(f"{FIXTURES}/pages.parquet").select("page_id", "url")
    more = [(1, "http://x.net/" + "ab/" * 3000), (1, "http://x.net/other"), (1, "http://x.net/other"), (None, "http://A.Example.net/en/x?q#f"), (9001, None), (9002, "no scheme"), (9003, "http://é.org/fr/ü")]
    pages.unionByName(spark.createDataFrame(more, "page_id long, url string")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op7_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "score").collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT page_id, host, path, rule, verdict, score FROM ({queries.OP7_SQL})").fetchall(), key=str)


def vectors(seed=0, n=400, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x[50:60] = x[10:20] + 0.02 * r.normal(size=(10, d)).astype(np.float32)
    x[60:64] = x[0]
    return x


def vector_rows(x):
    bad = [(900, None), (901, [0.0] * x.shape[1]), (902, [float("nan")] * x.shape[1]), (903, [None, 1.0]), (920, [])]
    return [(i, v.tolist()) for i, v in enumerate(x)] + bad


def test_op6(spark):
    x = vectors()
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(vector_rows(x), "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    y, hits = x.astype(np.float64), 0
    for q, rows in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:20]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(abs(s[v] - z) < 1e-9 for _, v, z in rows)
        hits += len({v for _, v, _ in rows} & set(want.tolist()))
    assert hits / (20 * len(got)) >= 0.95
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_op6_edges(spark):
    """Empty, without queries, lengths of their own, null and repeated ids, ids that a double can't hold, extra columns."""
    kind = "vec_id long, embedding array<double>, score string, rank int, shard int"
    assert ann.nearest(spark.createDataFrame([], kind)).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, [1.0], "", 1, 1)], kind)).count() == 0
    big = 20 * 2**56
    rows = [(big, [1.0, 0.0]), (big + 1, [0.5, 1.0]), (big + 2, [0.5, 1.0]), (big + 2, [0.5, 1.0]), (big + 3, [2.0, 0.0]), (big + 3, [-1.0, 0.0]), (None, [9.0, 9.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 0.0, 0.0])]
    got = ann.nearest(spark.createDataFrame([(i, v, "", 1, 1) for i, v in rows], kind).coalesce(1)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (40, 1, 41, 1.0), (big, 1, big + 3, 2.0), (big, 2, big + 1, 0.5), (big, 3, big + 2, 0.5), (big, 4, big + 3, -1.0)]


def test_graph_reaches_all():
    """Far groups of near vectors: every point is reached, and a search never finds fewer than there are."""
    r = np.random.default_rng(2)
    x = np.concatenate([c + 1e-4 * r.normal(size=(60, 8)) for c in 10 * np.eye(8)])
    _, graph = ann.build(x)
    assert graph.reached().all()
    graph.layers[0][graph.layers[0] >= 300] = -1  # cut a part off
    assert not graph.reached().all() and graph.mend().reached().all()
    assert (graph.search(graph.x[:50], 480)[0] >= 0).all()


def test_graph_recall_of_a_full_shard():
    """Random unit vectors, the hardest case, as many as a shard holds."""
    r = np.random.default_rng(3)
    x = r.normal(size=(ann.SHARD, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, graph = ann.build(x)
    ask = r.choice(len(x), 200, replace=False)
    found = graph.search(np.pad(x[ask], ((0, 0), (0, 1))).astype(np.float32), ann.SEARCH)[0][:, :21]
    best = np.argsort(-(x[ask] @ x.T), 1)[:, :21]
    hits = sum(len(set(order[f]) & set(b)) for f, b in zip(found, best, strict=True))
    assert hits / best.size >= 0.9


def test_op7(spark):
    urls = [None, "no scheme", "http://X.NET/a", "http://net", "https://a.example.net/en/1", "http://example.com/de/x?q", "http://b.example.com/fr/1#t", "http://c.org/fr/2", "http://knet/z", "http://X.NET/a"]
    got = sorted(url_filter.filter_urls(spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, gram int")).collect())
    assert [r.rule for r in got] == [None, None, "net/", None, "example.net/en/", "example.com/de/", None, "org/fr/", None, "net/"]
    assert [(r.host, r.path) for r in got[:4]] == [("", ""), ("", ""), ("x.net", "/a"), ("net", "")]
    assert {r.verdict for r in got} <= {"allow", "block"} and got[4].verdict == "allow" and got[2].verdict == "block"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_op7_each_window_counts(spark, monkeypatch):
    """Scores against a plain version, with few windows in the broadcast table: none may share a difference."""
    monkeypatch.setattr(url_filter, "SLOTS", 8)
    hosts, draw = ("x.net", "a.example.net", "example.com", "c.org", "b.example.com", "else.where"), np.random.default_rng(7)
    urls = [None, "", *(f"https://{hosts[i % 6]}/{('en', 'de', 'fr')[i % 3]}/" + "".join(draw.choice(list("abcdefgh"), 6)) for i in range(120))]
    rows = [(i, u) for i, u in enumerate(urls)] + [(5, urls[5])] * 2
    got = sorted(url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert len(got) == len(rows)
    verdict_of_rule = dict(url_filter.RULES)
    says = {r.page_id: verdict_of_rule.get(r.rule) for r in got}
    windows = lambda u: [("\2" * 4 + (u or "") + "\3")[i : i + 5] for i in range(len(u or "") + 1)]
    seen = {"allow": {}, "block": {}}
    for i, u in rows:
        for g in windows(u) if says[i] and hashlib.md5((u or "").encode()).hexdigest()[0] not in url_filter.HELD_OUT else ():
            for k in range(5):
                follow = seen[says[i]].setdefault(g[4 - k : 4], {})
                follow[g[4]] = follow.get(g[4], 0) + 1

    def chance(kind, g):
        p = 1 / 256
        for k in range(5):
            follow = seen[kind].get(g[4 - k : 4])
            if follow:
                p = (follow.get(g[4], 0) + len(follow) * p) / (sum(follow.values()) + len(follow))
        return p

    for r in got:
        want = np.mean([np.log(chance("allow", g) / chance("block", g)) for g in windows(urls[r.page_id])])
        assert abs(r.score - want) < 1e-9
    assert len({g for u in urls for g in windows(u)}) > 300


def test_op8(spark):
    x = vectors(4)
    rows = vector_rows(x)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.9
    assert [got[i].n_links for i in range(len(x))] == (link.sum(1) - 1).tolist()
    assert got[60].component_id == 0 and not got[60].kept and got[0].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 920))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_links(rows, cosine=0.9):
    """{vec_id: (n_links, component)} of vectors of one length, all pairs compared."""
    y = np.array([v for _, v in rows], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= cosine
    low = np.array([i for i, _ in rows])
    for _ in rows:
        low = np.where(link, low[None], np.iinfo(np.int64).max).min(1)
    return [(int(a), int(b)) for a, b in zip(link.sum(1) - 1, low, strict=True)]


@pytest.mark.parametrize("residents", [8000, 40])
def test_op8_groups(spark, monkeypatch, residents):
    """Chains of links, a group of near copies over many parts, ids that a double can't hold, extra columns."""
    monkeypatch.setattr(embedding_dedup, "RESIDENTS", residents)
    monkeypatch.setattr(embedding_dedup.bands, "__defaults__", (residents,))
    r = np.random.default_rng(6)
    base = r.normal(size=16)
    x = np.concatenate((base + 0.12 * r.normal(size=(150, 16)), r.normal(size=(150, 16)), np.repeat(base[None], 30, 0)))
    turn = np.linspace(0, 3, 12)
    x[160:172] = 0
    x[160:172, 0], x[160:172, 1] = np.cos(turn), np.sin(turn)  # each links with its neighbours only
    rows = [(2**60 + i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    frame = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rep string, n long, low long")
    got = sorted(embedding_dedup.near_duplicates(frame).collect())
    assert [(g.n_links, g.component_id) for g in got] == brute_links(rows)


def test_op8_edges(spark):
    """One-dimensional vectors, lengths of their own, null and repeated ids, doubles."""
    rows = [(1, [2.0]), (2, [0.5]), (3, [-1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0]), (5, [0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (6, None)]
    got = [(g.vec_id, g.n_links, g.component_id, g.kept) for g in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 0, 6, True), (None, 0, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op9(spark):
    got = sorted(packing.pack(frame(spark, ODD), BYTE).collect())
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    for i, t in enumerate(ODD):
        ids = np.array([*tokens(BYTE, t), 1], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        assert own == [(s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert packing.pack(empty(spark), BYTE).count() == 0


def test_plan_fills_windows():
    r = np.random.default_rng(0)
    histogram = dict(collections.Counter(r.integers(1, 2048, 5000).tolist()))
    rows, sequences = packing.plan(histogram)
    used = np.zeros(sequences, np.int64)
    for length, _, n, first, uses, offset in rows:
        assert n % uses == 0
        used[first : first + n // uses] += uses * length
    assert used.max() <= 2048 and used.sum() / (2048 * sequences) > 0.99
    counts = np.zeros(101, np.int64)
    counts[[70, 20, 7]] = [1, 1, 4]
    assert packing.best_multiset(counts, 100) == {70: 1, 7: 4}


def test_op10(spark):
    r = np.random.default_rng(1)
    vocab = [f"{a}{b}" for a in "bcdfg" for b in ("ana", "omi", "ulo", "eri")]
    rows, labels = [], []
    for i in range(400):
        w = list(r.choice(vocab, 25))
        if i % 5 == 1:
            w[3:5] = ["zzbad", "qqworse"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if i % 5 == 1 else 0))
    rows += [(900, None), (901, "")]
    got = {x.doc_id: x for x in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")).collect()}
    assert all(got[i].predicted == y for i, y in labels if got[i].held_out) and got[900].score == got[901].score
    assert toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).count() == 402


def test_op10_plain_sum(spark):
    """Scores against a plain sum over the distinct words; repeated rows, a very long text, contradicting labels."""
    rows = [(i, f"{'awful' if i % 3 == 0 else 'fine'} word{i % 11} text") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, 1), (1, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + [(5, rows[5][1]), (200, "Awful " + " ".join(f"w{i}x" for i in range(30_000))), (201, "")], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    weights = {}

    def plain(text):
        total = model.bias
        for w in sorted({x for x in __import__("re").findall(r"[^\W\d_]+", text.lower())}):
            for key in [f"={w}", *(f"{n}{w[:n]}" for n in (3, 4, 5) if len(w) > n)]:
                weights[key] = float(model.weights[zlib.crc32(key.encode()) % toxicity.SLOTS])
                total += weights[key]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    got = toxicity.score(docs, model, ["text"]).collect()
    assert len(got) == 93 and all(abs(r.score - plain(r.text)) < 1e-5 and r.predicted == int(r.score >= 0.5) for r in got)
    assert model.logit({"women", "men"}) == model.logit({"men", "women"})


def test_swapping_a_term_that_is_there(monkeypatch):
    """Where the other term is there already, the change is that of losing one."""
    rows = [("women and men here", i % 2) for i in range(40)]
    seen = toxicity.example(rows[0][0])[1]
    assert seen == [(0, 1), (0, 2)]
    model = toxicity.fit([(toxicity.example(t)[0], y, toxicity.example(t)[1]) for t, y in rows], epochs=3)
    assert np.isfinite(model.weights).all() and (model.weights >= 0).all()


def test_identity_terms_count_alike():
    rows = []
    for i in range(300):
        toxic = i % 2
        term = "women" if toxic and i % 3 else "people"  # toxic texts name one group more often
        rows.append((f"{term} {'awful' if toxic else 'garden'} w{i % 7}", toxic))
    with_swaps = toxicity.fit([(*(e := toxicity.example(t))[:1], y, e[1]) for t, y in rows])
    without = toxicity.fit([(toxicity.example(t)[0], y, []) for t, y in rows])
    gap = lambda m: abs(m.logit({"women"}) - m.logit({"people"}))
    assert gap(with_swaps) < 0.5 * gap(without)


def test_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {"pipeline", *(f"op{i}" for i in range(1, 11))}


def test_op10_without_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], "doc_id long, text string")
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    for rows in ([], [(1, None)], [(i, 1) for i in held], [(1, 0), (3, 0)]):
        got = toxicity.toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(got) == 3 and all(r.predicted == 0 and r.score < 0.5 for r in got)
