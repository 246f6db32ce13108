"""From raw documents to a mixture: language, near duplicates, benchmark passages, personal data, source weights.

Each stage works on all that the one before it kept; ``run`` writes its rows as Parquet into the shared folder and reads them
again, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiocert.llm.base import table, word_count
from ratiocert.llm.jaccard_join import jaccard_components
from ratiocert.llm.language_crf import UNDETERMINED, fit_languages, predict_languages
from ratiocert.llm.mixing import mix_sources
from ratiocert.llm.personal_data import redact
from ratiocert.llm.queries_b import held_out
from ratiocert.llm.string_tiling import tile_benchmark
from ratiocert.operators.lookup import checked_broadcast
from ratiocert.session import cut_lineage

LEAST_LANGUAGE_SHARE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: letters, and one language with at least 40 % of the words.

    Null texts and texts without letters go; rows that share an id go if one of them has no language.
    """
    model = fit_languages(docs, ~F.coalesce(held_out(), F.lit(False)))
    found = predict_languages(docs, model).where(
        (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LEAST_LANGUAGE_SHARE)
    )
    return _without(docs, found.select("doc_id").distinct())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays: that with the smallest id.

    Of rows that share an id one stays. Texts without words link with nothing, rows without an id stay.
    """
    found = cut_lineage(jaccard_components(docs, words=5, percent=80).select("doc_id", "component_id"))
    kept = _without(docs, found.where("component_id <> doc_id").select("doc_id").distinct())
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = cut_lineage(twice)
    if not twice.limit(1).count():
        return kept
    doubled = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return _without(kept, twice).unionByName(doubled)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose tiles cover less than 80 % of every benchmark item."""
    return tile_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=True)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in the text replaced; n_chars is that of the new text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each row."""
    return mix_sources(docs, word_count("text"))


STAGES = [
    ("language", keep_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("mixing", mix),
]

# None of the first four stages can be put into SQL; tests compare them with brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ``ids``; these are broadcast if a count shows that they are few."""
    return docs.join(checked_broadcast(ids), "doc_id", "left_anti").select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
