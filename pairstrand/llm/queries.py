"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstrand.llm import ann, clusters, exact_dedup, fingerprints, hard_negatives, near_dedup, packing, quality, substring_dedup, tokens, warc
from pairstrand.llm.common import table
from pairstrand.llm.settings import END_ID, SEPARATOR_ID, VOCABULARY, VOCABULARY_SIZE, quality_forest

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their 5-word shingles."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    return tokens.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids with an end id each, packed into sequences."""
    return packing.pack(tokens.token_lengths(table(spark, sf_dir, "documents"), VOCABULARY, extra=1))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as flat files and found again by their separators; doc_no gives each its id back."""
    files, names = tokens.write_flat_files(table(spark, sf_dir, "documents"), VOCABULARY, SEPARATOR_ID, SEPARATOR_ID + 1)
    found = tokens.scan_separators(files, SEPARATOR_ID, SEPARATOR_ID + 1)
    return found.join(names.hint("merge"), "doc_no").select("doc_id", "doc_no", "start", "n_tokens")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are found again in token files: places, lengths, checksums."""
    files = tokens.write_token_files(table(spark, sf_dir, "documents"), VOCABULARY, END_ID, VOCABULARY_SIZE, library=True)
    return tokens.read_token_files(files, VOCABULARY_SIZE)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by trees that were grown without the held-out fold's labels."""
    docs = table(spark, sf_dir, "documents")
    forest = quality_forest(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).select(
        "doc_id",
        F.coalesce(quality.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of deduplicated archives of all pages."""
    headers = warc.write_responses(table(spark, sf_dir, "pages"))
    return warc.read_archives(warc.resolve_revisits(headers))


#: SHA-1 in base32: the digest's 40 hex digits are read five (20 bits) at a time as four signs.
OP9_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), coded AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, 1 + 5 * k::INT, 5))::BIGINT) >> (15 - 5 * j)::INT) & 31)::INT, 1)), '')), '') AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM coded
WINDOW same AS (PARTITION BY payload_digest, payload_bytes)
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated strings of 400 bytes."""
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest negatives in the windows of each anchor's positives; anchors are vectors whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0, label)


OP11_SQL = """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM whole a JOIN whole b ON a.id <> b.id
  WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= 10
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by the nearest of 16 centroids after three rounds."""
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    """SQL of the assignment to the centroids c{n}, and of the centroids c{n + 1}."""
    return f"""
, a{n} AS (
  SELECT row, v, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT row, whole.v, c, list_sum(list_transform(range(1, 65), lambda i: (whole.v[i] - m.v[i]) * (whole.v[i] - m.v[i])))::BIGINT AS d FROM whole, c{n} m)
  GROUP BY row, v
), c{n + 1} AS (
  SELECT c, coalesce(moved.v, old.v) AS v FROM c{n} old LEFT JOIN (
    SELECT c, list(m ORDER BY i) AS v FROM (
      SELECT c, i, (sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS m
      FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY c, i) GROUP BY c
  ) moved USING (c)
)"""


OP12_SQL = f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS c, v FROM whole WHERE vec_id IS NOT NULL
  QUALIFY c < 16
){_round(0)}{_round(1)}{_round(2)}{_round(3)}
SELECT vec_id, a3.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN whole USING (row) JOIN c3 ON c3.c = a3.c
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return fingerprints.successive(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_ann": op2_ann,
        "op3_near_dedup": op3_near_dedup,
        "op4_bpe": op4_bpe,
        "op5_packing": op5_packing,
        "op6_token_counts": op6_token_counts,
        "op7_token_files": op7_token_files,
        "op8_quality": op8_quality,
        "op9_warc": op9_warc,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_clusters": op12_clusters,
        "op13_fingerprints": op13_fingerprints,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op9_warc": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_clusters": OP12_SQL,
    }
