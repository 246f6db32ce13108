"""Registered queries: hard negatives, ranked lexical search, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table
from .hard_negatives import mine_hard_negatives
from .lexical_search import search_items
from .pieces import decode_pieces, encode_pieces

OP11_SQL = """WITH d AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM d a JOIN d b ON a.id % 100 = 0 AND a.id <> b.id),
  p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
  SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
    s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP12_SQL = f"""WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
  i AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) q GROUP BY ALL),
  size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
  tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
  w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t, n_docs),
  impact AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS part FROM tf JOIN size USING (doc_id) JOIN w USING (t), total),
  scored AS (SELECT item_id, doc_id, CAST(sum(qtf * part) AS BIGINT) AS score FROM i JOIN impact USING (t) GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20"""


@query("op12_lexical_search", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return search_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


@query("op13_piece_codec")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = "piece_bpe_32k.model"
    ids = encode_pieces(table(spark, sf, "documents"), vocabulary)
    texts = decode_pieces(ids, vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return texts.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
