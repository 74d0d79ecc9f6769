"""The operators' queries for __spark_entry__.py, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.token_files import digest

    return digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.exact_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.prefix_trie import shared_prefixes

    return shared_prefixes(table(spark, sf_dir, "conversations"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm.ball_kmeans import digest

    return digest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pipeline, op1_bpe, op2_ngram_jaccard, op3_lm_score, op4_token_files, op5_langid, op6_ann, op7_url_filter, op8_embedding_dedup, op9_packing, op10_toxicity,
                                   op11_exact_dedup, op12_prefix_trie, op13_ball_kmeans)}


#: Links are found by joining on shingles; components by walking links from each document.
OP2_SQL = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM cut)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sized p ON p.doc_id = a.doc_id JOIN sized q ON q.doc_id = b.doc_id
    WHERE 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT c.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
    CAST(least(c.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = c.doc_id), c.doc_id)) AS BIGINT) AS component_id
FROM cut c LEFT JOIN sized s USING (doc_id)
"""


#: Both models as tables of (k, text, followers), orders joined one after the other.
OP7_SQL = r"""
WITH cut AS (
    SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substring(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM cut),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parted),
said AS (
    SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled, substring(md5(url), 1, 1) IN ('0', '1', '2') AS held FROM ruled),
urls AS (SELECT url, ruled, held, count(*) AS copies FROM said GROUP BY url, ruled, held),
windows AS (
    SELECT url, ruled, held, copies, substring(concat(repeat(chr(2), 4), url, chr(3)), i, 5) AS gram
    FROM (SELECT *, unnest(range(1, length(url) + 2)) AS i FROM urls)),
grams AS (
    SELECT gram, sum(CASE WHEN ruled = 'allow' AND NOT held THEN copies ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' AND NOT held THEN copies ELSE 0 END) AS b FROM windows GROUP BY gram),
follow AS (
    SELECT k, right(gram, k + 1) AS g, sum(a) AS a, sum(b) AS b FROM (SELECT *, unnest(range(0, 5)) AS k FROM grams) GROUP BY ALL),
seen AS (
    SELECT k, g, a, b, sum(a) OVER same AS na, sum(b) OVER same AS nb, sum(CAST(a > 0 AS INT)) OVER same AS ta, sum(CAST(b > 0 AS INT)) OVER same AS tb
    FROM follow WINDOW same AS (PARTITION BY k, left(g, k))),
p0 AS (SELECT gram, CASE WHEN na > 0 THEN (s.a + ta * (1 / 256)) / (na + ta) ELSE 1 / 256 END AS pa, CASE WHEN nb > 0 THEN (s.b + tb * (1 / 256)) / (nb + tb) ELSE 1 / 256 END AS pb FROM grams JOIN seen s ON k = 0 AND g = right(gram, 1)),
p1 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb FROM p0 JOIN seen ON k = 1 AND g = right(gram, 2)),
p2 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb FROM p1 JOIN seen ON k = 2 AND g = right(gram, 3)),
p3 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb FROM p2 JOIN seen ON k = 3 AND g = right(gram, 4)),
p4 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb FROM p3 JOIN seen ON k = 4 AND g = right(gram, 5)),
scored AS (SELECT url, any_value(ruled) AS ruled, any_value(held) AS held, any_value(copies) AS copies, avg(ln(pa / pb)) AS score FROM windows JOIN p4 USING (gram) GROUP BY url),
bins AS (
    SELECT held, CAST(floor(score * 50) AS BIGINT) AS bin, sum(CASE WHEN ruled = 'allow' THEN copies ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' THEN copies ELSE 0 END) AS b
    FROM (SELECT ruled, copies, score, held FROM scored WHERE ruled IS NOT NULL AND held UNION ALL SELECT ruled, copies, score, false FROM scored WHERE ruled IS NOT NULL) GROUP BY ALL),
errors AS (
    SELECT held, bin, coalesce(sum(a) OVER below, 0) / sum(a) OVER every + (sum(b) OVER every - coalesce(sum(b) OVER below, 0)) / sum(b) OVER every AS error, sum(a) OVER every AS all_a, sum(b) OVER every AS all_b
    FROM bins WINDOW below AS (PARTITION BY held ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), every AS (PARTITION BY held)),
cuts AS (SELECT bin / 50 AS cut FROM errors WHERE all_a > 0 AND all_b > 0 ORDER BY held DESC, error, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(s.ruled, CASE WHEN score >= coalesce((SELECT cut FROM cuts), 0) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM said s JOIN scored USING (url)
"""


#: All vectors against all; links are walked from each vector.
OP8_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, e, len(e) AS size, sqrt(list_dot_product(e, e)) AS norm FROM good),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.size = b.size AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, least(x, min(y)) AS component FROM reach GROUP BY x), number AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, coalesce(number.n, 0) AS n_links, coalesce(low.component, v.vec_id) AS component_id, coalesce(low.component, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN low ON low.x = v.vec_id LEFT JOIN number ON number.x = v.vec_id
"""


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


#: Prefixes as lists of the turns' digests; what lies below a node by unnesting the prefixes of each node.
OP12_SQL = r"""
WITH turns AS (
    SELECT conv_id, list(struct_pack(d := sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), w := len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) ORDER BY turn NULLS FIRST) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
    -- crc32 of the decimal digits, bit by bit
    SELECT conv_id, t, (4294967295 - list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h FROM turns),
whole AS (
    SELECT a.conv_id, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t
    FROM hashed a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefix AS (
    SELECT conv_id, len(t) AS n, d AS depth, list_transform(t[1:d], lambda x: x.d) AS p, CASE WHEN d = 0 THEN 0 ELSE t[d].w END AS w
    FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM whole)),
node AS (
    SELECT p, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(w) AS w,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM prefix GROUP BY p),
child AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
under AS (
    SELECT p[1:d] AS p, sum((n_convs - 1) * w) AS saved, count(*) FILTER (children = 0) AS leaves
    FROM (SELECT node.*, coalesce(child.n, 0) AS children, unnest(range(0, depth + 1)) AS d FROM node LEFT JOIN child USING (p)) GROUP BY ALL)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN under ON under.p = node.p LEFT JOIN child ON child.p = node.p LEFT JOIN node up ON node.depth > 0 AND up.p = node.p[1:node.depth - 1]
"""


def _op13_sql(rounds: int = 10) -> str:
    """Each round compares every vector with every centroid."""
    parts = ["""vector AS MATERIALIZED (
    SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", """c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), x) - 1 AS cluster, x FROM vector QUALIFY cluster < 8)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
    SELECT no, any_value(v.x) AS x, min({{'distance': d, 'cluster': cluster}}) AS best
    FROM (SELECT no, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM vector v, c{r} c) v GROUP BY no)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
    SELECT cluster, list(CAST(floor(sums / n) - CASE WHEN floor(sums / n) * n > sums THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS x
    FROM (SELECT best.cluster AS cluster, i, sum(x[i]) AS sums, count(*) AS n FROM (SELECT best, x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY ALL) GROUP BY cluster)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (cluster))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.distance AS BIGINT) AS distance, CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN vector USING (no) JOIN c{rounds} c ON c.cluster = best.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op7_url_filter": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op11_exact_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_ball_kmeans": _op13_sql()}
