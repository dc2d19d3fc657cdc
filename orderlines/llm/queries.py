"""The registered queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize
from orderlines.llm.conversation_trie import prefix_trie
from orderlines.llm.hadamard_clusters import cluster_vectors
from orderlines.llm.length_packing import pack
from orderlines.llm.line_dedup import dedup_lines
from orderlines.llm.lm_scoring import score_texts
from orderlines.llm.quality_classifier import HELD_OUT, learn, score_quality, text_features
from orderlines.llm.quality_rules import quality_rules
from orderlines.llm.secret_scan import scan_secrets
from orderlines.llm.shingle_join import shingle_components
from orderlines.llm.simhash import near_duplicates
from orderlines.llm.source_mix import mix_sources, words_in
from orderlines.llm.texts import held_out_remainder, read
from orderlines.llm.token_counts import prefix_token_counts
from orderlines.llm.topk_search import top_k

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark, sf_dir):
    return prefix_token_counts(read(spark, sf_dir, "documents"), store=False)


@query
def op2_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_deleted", "n_words_deleted",
        words_in(F.col("text")).alias("n_words_left"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


@query
def op3_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents")).drop("repeat_spans")


@query
def op4_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = materialize(text_features(docs), "features")
    model = learn(rows, read(spark, sf_dir, "labels"))
    scored = score_quality(rows, model)
    return scored.withColumn("held_out", held_out_remainder() == HELD_OUT)


@query
def op5_simhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op6_length_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", words_in(F.col("text")).alias("n_words")), "lengths")
    return pack(sized, "n_words").drop("n_words")


@query
def op7_topk_search(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE_SQL["op7_topk_search"] = """
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS weights
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.weights, c.weights) AS BIGINT) AS score, q.row_no
  FROM usable q JOIN usable c ON q.row_no <> c.row_no
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op8_source_mix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "sizes")
    mixed = mix_sources(sized)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "copies", "shards",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


@query
def op9_secret_scan(spark, sf_dir):
    return scan_secrets(read(spark, sf_dir, "documents"))


@query
def op10_lm_scoring(spark, sf_dir):
    return score_texts(read(spark, sf_dir, "documents"))


@query
def op11_hadamard_clusters(spark, sf_dir):
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


ORACLE_SQL["op11_hadamard_clusters"] = """
WITH RECURSIVE kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), drawn AS (
  SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h LIMIT 8
), rounds AS (
  SELECT 0 AS round, list(v ORDER BY h) AS centroids FROM drawn
  UNION ALL
  SELECT round + 1, list(coalesce(moved, old) ORDER BY number)
  FROM (
    SELECT r.round, n.number, r.centroids[n.number] AS old, m.moved
    FROM rounds r, (SELECT unnest(range(1, 9)) AS number) n LEFT JOIN (
      SELECT number, list(CAST(floor_mean AS BIGINT) ORDER BY place) AS moved
      FROM (
        SELECT number, place, (total - ((total % n) + n) % n) // n AS floor_mean
        FROM (
          SELECT number, place, sum(v[place]) AS total, count(*) AS n
          FROM (
            SELECT v, list_position(far, list_min(far)) AS number
            FROM (
              SELECT v, list_transform(centroids, lambda c: list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS far
              FROM kept, rounds
            )
          ), (SELECT unnest(range(1, 65)) AS place)
          GROUP BY number, place
        )
      )
      GROUP BY number
    ) m ON m.number = n.number
    WHERE r.round < 10 AND n.number <= len(r.centroids)
  )
  GROUP BY round
), final AS (
  SELECT centroids FROM rounds WHERE round = 10
), measured AS (
  SELECT vec_id, centroids, list_transform(centroids, lambda c: list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS far
  FROM kept, final
), labelled AS (
  SELECT vec_id, list_position(far, list_min(far)) AS number, CAST(list_min(far) AS BIGINT) AS distance, centroids FROM measured
)
SELECT vec_id, CAST(number - 1 AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(centroids[number], ',')) AS centroid_sha256
FROM labelled
"""


@query
def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLE_SQL["op12_conversation_trie"] = """
WITH RECURSIVE bits AS (
  SELECT CAST(b AS BIGINT) AS byte, CAST(b AS BIGINT) AS c, 0 AS step FROM range(256) t(b)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY byte) AS entries FROM bits WHERE step = 8
), told AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM told
), sizes AS (
  SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
    lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1]))) % 9 AS h
  FROM sizes, crc_table
), rebuilt AS (
  SELECT c.conv_id, o.pos, o.digest, o.bytes FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(s.n, 0)), o.digest, o.bytes
  FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN sizes s ON s.conv_id = c.base
), reached AS (
  SELECT conv_id, pos AS depth, bytes, list(digest) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM convs
), nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs, min(conv_id) AS conv_id
  FROM reached GROUP BY path
), above AS (
  SELECT path, depth, bytes, n_convs, conv_id, CASE WHEN depth > 0 THEN path[:depth - 1] END AS parent FROM nodes
), children AS (
  SELECT parent, count(*) AS n FROM above WHERE parent IS NOT NULL GROUP BY parent
), lines AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, unnest(range(0, n.depth + 1)) AS upto FROM above n LEFT JOIN children c ON c.parent = n.path
), subtrees AS (
  SELECT path[:upto] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM lines GROUP BY path[:upto]
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, path FROM reached QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM above n JOIN subtrees s ON s.path = n.path LEFT JOIN nodes p ON p.path = n.parent
LEFT JOIN children c ON c.parent = n.path LEFT JOIN ends e ON e.path = n.path
"""


@query
def op13_shingle_join(spark, sf_dir):
    return shingle_components(read(spark, sf_dir, "documents")).drop("set_id")


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
