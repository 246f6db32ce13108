"""Registered queries: n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, reach_sql, table
from .jaccard_join import jaccard_components
from .language_crf import fit_languages, predict_languages
from .personal_data import find_personal_data
from .string_tiling import tile_benchmark


OP6_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i+3]) END) AS g FROM d),
  n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
  p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
  links AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), {reach_sql("links", "d")}
  SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN n ON n.id = r.id GROUP BY r.id"""


@query("op6_jaccard_join", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"), words=4, percent=85)


@query("op4_personal_data")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = find_personal_data(table(spark, sf, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def held_out(id_col: str = "doc_id"):
    """True for the rows that are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


@query("op2_language_crf")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, ~F.coalesce(held_out(), F.lit(False)))
    found = predict_languages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


@query("op3_string_tiling")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return tile_benchmark(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
