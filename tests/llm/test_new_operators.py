"""Exact duplicates, prefix tries and ball k-means on small rows, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ball_kmeans, embedding_dedup, exact_dedup, prefix_trie, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_prefix_trie", "op13_ball_kmeans"])
def test_sql(spark, name):
    """The registered query against its SQL."""
    duck = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    rows = want.fetchall()
    assert rows and sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("held", [50, 8_000_000])
def test_op8_sql(spark, tmp_path, monkeypatch, held):
    """op8 on a table with planted near copies, against comparing all with all in SQL; with visitors
    going by in small blocks too."""
    monkeypatch.setattr(embedding_dedup, "DISTANCES", held)
    r = np.random.default_rng(8)
    base = r.normal(size=(150, 16))
    x = np.concatenate((base, base[:60] + 0.1 * r.normal(size=(60, 16)), base[:20], 3 * base[:20] + 0.2 * r.normal(size=(20, 16)))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op8_embedding_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    want = duck.sql(queries.oracle_sql()["op8_embedding_dedup"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(x[1] for x in want) > 100


# --- exact duplicates


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, also string, row int")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


def test_exact_duplicates(spark):
    long = "é" * 700_000  # 1.4 MB, beyond the largest digit
    texts = [None, "", " ", "a", "a", "A", "a ", "b" * 64, "b" * 64, "b" * 65, "b" * 65 + "c", "b" * 1088, "b" * 1088, "b" * 1089, "é", "é", "\x00", "\x00\x00",
             "c" * 3000 + "x", "c" * 3000 + "y", "c" * 3000 + "x", long, long, long + "a", long + "b", "x" + long, "same"] + ["same"] * 40
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = exact_dedup.digest(documents(spark, rows)).collect()
    groups = brute_groups(rows)
    assert len(got) == len(rows)
    of = dict(rows)
    for r in got:
        same = groups[of[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256((of[r.doc_id] or "").encode()).hexdigest()


def test_exact_duplicates_rows(spark):
    """Repeated rows, repeated ids with other texts, null ids, ids beyond doubles."""
    big = 2**60 + 1
    rows = [(1, "one"), (1, "one"), (1, "one"), (1, "two"), (None, "two"), (None, "none"), (None, "none"), (big, "z"), (big + 1, "z"), (None, None), (5, "one")]
    got = exact_dedup.exact_duplicates(documents(spark, rows), {"text": F.col("text")}).collect()
    assert len(got) == len(rows)
    kept = sorted(((r.text, r.doc_id, r.group_size) for r in got if r.kept), key=str)
    assert kept == sorted([("one", 5, 4), ("two", 1, 2), ("none", None, 2), ("z", big + 1, 2), (None, None, 1)], key=str)
    again = exact_dedup.exact_duplicates(documents(spark, [(7, "x")] * 9 + [(6, "x")])).collect()
    assert sum(r.kept for r in again) == 1 and all(r.keep_id == 7 and r.group_size == 10 for r in again)
    left = exact_dedup.deduplicated(documents(spark, rows))
    assert left.columns == ["doc_id", "text", "also", "row"] and left.count() == 5
    nothing = exact_dedup.digest(documents(spark, []))
    assert nothing.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and nothing.count() == 0


# --- prefix tries


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq string")


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(t[2], t[3]) for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(np.fmod(c, 20)), [])
        whole = tuple(base[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append((c, len(whole)))
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    done = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(p[-1][1].translate({c: 32 for c in range(9, 14)}).split(" ")) - p[-1][1].translate({c: 32 for c in range(9, 14)}).split(" ").count("") if p else 0
        leaves = sum(done[q][0] for q in children[p]) or 1
        done[p] = leaves, (len(nodes[p]) - 1) * words + sum(done[q][1] for q in children[p])
    low = {p: min(c for c, _ in v) for p, v in nodes.items()}
    return sorted((low[p], len(p), low[p[:-1]] if p else None, len(v), len(children[p]), *done[p], hashlib.sha256(",".join(str(c) for c, n in sorted(v) if n == len(p)).encode()).hexdigest()) for p, v in nodes.items())


def same_trie(spark, rows, load):
    got = sorted(tuple(r) for r in prefix_trie.shared_prefixes(conversations(spark, rows), load).collect())
    key = lambda r: tuple(-(2**62) if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute_trie(rows), key=key)


@pytest.mark.parametrize("load", [3, 40, 10_000])
def test_trie(spark, load):
    """Common starts, equal conversations, prefixes of others; splits at every size of task."""
    r = random.Random(load)
    rows = []
    for c in range(150):
        kind = r.random()
        turns = ["hi there", "how are you"] if kind < 0.4 else [f"q{r.randrange(3)}"]
        turns += [f"w {r.randrange(2)}" for _ in range(r.randrange(6))] if kind < 0.8 else ["same one"] * 9
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(turns)]
    r.shuffle(rows)
    same_trie(spark, rows, load)


def test_trie_edges(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, "first"), (0, 1, "user", None), (0, 2, "", ""), (3, 0, "u", "ser"), (3, 1, "us", "er"), (23, 0, None, "no base  \t here\n"), (40, 0, "a", "x"),
            (2**60 + 1, 0, "user", "word " * 30_000), (2**60 + 1, 1, "user", "b"), (-7, 0, "user", "minus"), (-7, 1, "user", "two words"), (5, 0, "user", "a　b"), (60, 0, "user", "a"), (61, 0, "user", "")]
    same_trie(spark, rows, 10_000)
    same_trie(spark, rows, 1)
    long = [(c, t, "user", f"turn {t}") for c in (0, 20, 40) for t in range(300 + c)]
    same_trie(spark, long, 100)
    same_trie(spark, [(20 * c, 0, "user", "the same") for c in range(2000)], 50)
    twice = [(20, 0, "user", "b"), (20, 0, "user", "a"), (40, 0, "user", "a"), (40, 0, "user", "b"), (20, 0, "user", "a"), (40, 0, "user", "a")]
    assert prefix_trie.shared_prefixes(conversations(spark, twice)).count() == 4  # rows that repeat a turn, in one order
    assert prefix_trie.shared_prefixes(conversations(spark, [])).count() == 0
    assert prefix_trie.shared_prefixes(conversations(spark, [(None, 1, "a", "b")])).count() == 0


def test_trie_ties(spark):
    """Rows that repeat a turn number, null ones too, are in the order of role and text."""
    r = random.Random(12)
    rows = [(c, r.choice([None, 0, 1]), r.choice([None, "a", "user"]), r.choice([None, "b", "a b", "é", "\U0001f600 x"])) for c in range(60) for _ in range(5)]
    same_trie(spark, rows, 10_000)
    same_trie(spark, rows, 20)


def test_streamed_ends(spark):
    """The ends of very many equal conversations are digested piece by piece."""
    n = 10_000
    found = spark.range(n).select(F.col("id").alias("conv_id"), F.lit("s" * prefix_trie.UNIT).alias("seq"))
    (row,) = prefix_trie.distinct_sequences(found).collect()
    assert (row.rep, row.n, row.ends_sha256) == (0, n, hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest())


# --- ball k-means


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, x, 1, 2) for i, x in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance int").repartition(3)


def brute_kmeans(rows, k=8, rounds=10, seed=3):
    x = [[int(np.floor(1024 * float(v))) for v in e] for _, e in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    centroids = [x[i] for i in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for r in range(rounds + 1):
        best = [min((far(v, c), j) for j, c in enumerate(centroids)) for v in x]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for v, b in zip(x, best, strict=True) if b[1] == j]
                if own:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = defaultdict(int)
    for d, j in best:
        of[j] += d
    return sorted(((rows[i][0], j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, (d, j) in enumerate(best)), key=str)


def same_clusters(spark, rows, kind="float", more=()):
    got = ball_kmeans.digest(vectors(spark, [*rows, *more], kind)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_kmeans(rows)


def test_ball_kmeans(spark):
    r = np.random.default_rng(5)
    centers = r.normal(size=(12, 64))
    rows = [(i, np.float32(centers[r.integers(12)] + 0.3 * r.normal(size=64)).tolist()) for i in range(300)]
    bad = [(900, None), (901, [1.0] * 63), (902, []), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [1.0] * 63 + [float("inf")]), (906, [3e38] * 64), (907, [1.0] * 65)]
    same_clusters(spark, rows, more=bad)


def test_ball_kmeans_ties(spark):
    """Equal vectors, equal centroids, points half way between, zero vectors, null and repeated ids."""
    grid = [(i, [float(i % 3), float(i % 2)] + [0.0] * 62) for i in range(60)] + [(1000 + i, [0.5] * 64) for i in range(30)]
    same_clusters(spark, grid)
    same_clusters(spark, [*grid, (None, [0.25] * 64), (5, [9.0] * 64), (5, [9.0] * 64), (2**60 + 1, [-1.0] * 64)])
    same_clusters(spark, [(i, [1.0 / 3] * 64) for i in range(20)])
    same_clusters(spark, [(1, [0.1] * 64), (2, [0.2] * 64)])
    big = np.random.default_rng(6)
    same_clusters(spark, [(i, (big.normal(size=64) * 20_000).tolist()) for i in range(60)], "double")
    assert ball_kmeans.digest(vectors(spark, [])).count() == 0


def test_balls_rule_out():
    """Pruned and plain comparison agree, also with coarse neighbours and ties."""
    r = np.random.default_rng(7)
    for _ in range(30):
        x, c = r.integers(-4, 5, (200, 6)), r.integers(-4, 5, (8, 6))
        near = [[j for j in range(8) if j != i] for i in range(8)]
        want = ball_kmeans.nearest(x, c, None, near)
        moved = c + r.integers(-1, 2, c.shape)
        radii = [int(want[1][want[0] == i].max()) if (want[0] == i).any() else 0 for i in range(8)]
        got = ball_kmeans.nearest(x, moved, want[0].astype(np.uint8), ball_kmeans.neighbours(moved, radii, ((moved - c) ** 2).sum(1)))
        plain = ball_kmeans.nearest(x, moved, None, near)
        assert (got[0] == plain[0]).all() and (got[1] == plain[1]).all()
