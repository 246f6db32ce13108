"""Registered queries: suffix deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, reach_sql, table
from .secret_forest import find_secrets
from .suffix_dedup import remove_repeats
from .vector_dedup import near_vectors


# Bytes as two hexadecimal digits each.
OP1_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d) q),
  m AS (SELECT g, min(doc_id) AS o FROM s GROUP BY g),
  r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM s JOIN m USING (g) WHERE o < doc_id),
  t AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
  u AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM t GROUP BY 1, 2),
  v AS (SELECT u.*, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM u),
  k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
    FROM v JOIN d USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
  FROM d LEFT JOIN k USING (doc_id)"""


@query("op1_suffix_dedup", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    done = remove_repeats(table(spark, sf, "documents"), length=50)
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


# Sound vectors only; the query's index may miss links, so that this holds where its recall is 1.
OP9_SQL = f"""WITH RECURSIVE d AS (SELECT vec_id AS id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings),
  links AS (SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.id < y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95), {reach_sql("links", "d")},
  n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
  SELECT r.id AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(other) AS component_id, r.id = min(other) AS kept FROM reach r LEFT JOIN n ON n.id = r.id GROUP BY r.id"""


@query("op9_vector_dedup", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"), cosine=0.95)


@query("op10_secret_forest")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(table(spark, sf, "documents"))
