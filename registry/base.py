"""Registration and the stand-in views the queries share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiocert.operators.ordering import row_after
from ratiocert.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its operator key, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to process, over all cores however few row groups it has."""
    return spread(table(spark, sf, name))


# --- scored responses: one per lineitem row --------------------------------------------------

_GENERATOR = "-l_extendedprice/CAST(1000 AS DOUBLE)"
_MODEL = (
    f"({_GENERATOR})*(CAST(1 AS DOUBLE)-CAST(5 AS DOUBLE)*l_discount"
    "-(CASE WHEN l_returnflag='R' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))"
)
_SCORE_COLUMNS = [
    "l_orderkey",
    "l_linenumber",
    "CASE WHEN l_returnflag='R' THEN 'other' ELSE 'target' END AS dataset",
    "CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS ood",
    "CAST(l_quantity AS INT) AS n_token_response",
    f"{_GENERATOR} AS ll2_generator",
    f"{_MODEL} AS ll2_model",
]
V_SCORES = "v_scores AS (SELECT " + ", ".join(_SCORE_COLUMNS) + " FROM lineitem)"
# The same with the ratio columns added.
V_SCORED = (
    V_SCORES + ", v_scored AS (SELECT *, ll2_model-ll2_generator AS log2_ratio, "
    "(ll2_model-ll2_generator)/n_token_response AS log2_ratio_norm FROM v_scores)"
)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*_SCORE_COLUMNS)


# --- draws: the lines of an order as ordered attempts of one request ---------------------------

_DRAW_MODEL = f"({_GENERATOR})*(CAST(1 AS DOUBLE)-CAST(5 AS DOUBLE)*l_discount)"
_DRAW_COLUMNS = [
    "l_orderkey AS request_id",
    "row_number() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS attempt",
    "CAST(l_quantity AS INT) AS n_token",
    f"{_GENERATOR} AS ll2_generator",
    f"{_DRAW_MODEL} AS ll2_model",
]
V_DRAWS = "v_draws AS (SELECT " + ", ".join(_DRAW_COLUMNS) + " FROM lineitem)"
GATE_K, GATE_T = 0.4, 3
# Decisions in SQL: the first accepted attempt decides, at most GATE_T attempts count.
V_GATE = (
    V_DRAWS
    + f""", tried AS (SELECT *, ll2_model-ll2_generator AS r,
  ll2_generator + {math.log2(GATE_T)!r} + CAST({GATE_K} AS DOUBLE)*n_token AS bound,
  (ll2_model-ll2_generator) <= CAST({GATE_K} AS DOUBLE)*n_token AS ok FROM v_draws WHERE attempt <= {GATE_T}),
firsts AS (SELECT request_id, min(CASE WHEN ok THEN attempt END) AS first_ok, max(attempt) AS last_seen FROM tried GROUP BY request_id),
kept AS (SELECT t.*, f.first_ok FROM tried t JOIN firsts f ON t.request_id=f.request_id
  WHERE t.attempt <= coalesce(f.first_ok, f.last_seen)),
gate AS (SELECT request_id, bool_and(first_ok IS NULL) AS abstained, count(*) AS num_samples,
  max_by(ll2_model, attempt) AS log_prob_f, max_by(ll2_generator, attempt) AS log_prob_g,
  max_by(r, attempt) AS last_ratio, max_by(bound, attempt) AS last_bound FROM kept GROUP BY request_id)"""
)


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """The window deals the rows out by request, so they are not spread over the cores before."""
    return table(spark, sf, "lineitem").selectExpr(*_DRAW_COLUMNS)


# --- prompt/response pairs: a user turn and the assistant turn right after it -------------------

V_PAIRS = """v_pairs AS (SELECT conv_id, turn, text AS prompt, response FROM (
  SELECT conv_id, turn, role, text,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response
  FROM conversations) q WHERE role='user' AND nr='assistant')"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns are numbered without gaps, so the next turn is found by an equi-join on (conv_id, turn)."""
    turns = table(spark, sf, "conversations")
    next_to = row_after(turns, "conv_id", "turn", {"role": "nr", "text": "response"})
    return next_to.where("role = 'user' AND nr = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("prompt"), "response"
    )


# --- gate outcome and judge decision ------------------------------------------------------------

V_JUDGE = """v_judge AS (SELECT d.doc_id, (d.n_chars % 3 = 0) AS abstained,
  CASE WHEN l.toxic=1 THEN 'OUT' WHEN l.quality=0 THEN 'INVALID' ELSE 'IN' END AS decision
  FROM documents d JOIN labels l ON d.doc_id=l.doc_id)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents").select("doc_id", "n_chars")
        .join(table(spark, sf, "labels"), "doc_id")
        .selectExpr(
            "doc_id", "(n_chars % 3 = 0) AS abstained",
            "CASE WHEN toxic=1 THEN 'OUT' WHEN quality=0 THEN 'INVALID' ELSE 'IN' END AS decision",
        )
    )


# --- benchmark: answers from four logits, likelihood side from part ------------------------------

V_BENCH = """v_bench AS (SELECT vec_id AS idx, CAST(vec_id % 7 AS BIGINT) AS subject, CAST(label % 4 AS BIGINT) AS correct_answer_id,
  CAST(list_position(c, list_max(c)) - 1 AS BIGINT) AS answer_id FROM
  (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings) e),
bench AS (SELECT *, CAST(answer_id = correct_answer_id AS BIGINT) AS correct FROM v_bench)"""
_BENCH_LL = [
    "p_partkey AS idx",
    "p_size AS n_token_response",
    "-p_retailprice/CAST(100 AS DOUBLE) AS ll2_generator",
    "(-p_retailprice/CAST(100 AS DOUBLE))*CAST(0.5 AS DOUBLE) AS ll2_model",
]
V_BENCH_LL = "v_bench_ll AS (SELECT " + ", ".join(_BENCH_LL) + " FROM part)"


def bench(spark: SparkSession, sf: str) -> DataFrame:
    from ratiocert.functions.logits import argmax, gather

    logits = F.transform("embedding", lambda x: x.cast("double"))
    answers = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"),
        (F.col("vec_id") % 7).alias("subject"),
        (F.col("label") % 4).cast("long").alias("correct_answer_id"),
        argmax(gather(logits, [0, 1, 2, 3])).cast("long").alias("answer_id"),
    )
    return answers.withColumn("correct", (F.col("answer_id") == F.col("correct_answer_id")).cast("long"))


def bench_ll(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*_BENCH_LL)


# --- logits and token scores from embeddings -----------------------------------------------------

V_LOGITS = """v_logits AS (SELECT vec_id, vec_id % 50 AS seq, vec_id // 50 AS pos, label AS token,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)"""
V_TOKENS = """v_tokens AS (SELECT vec_id, label, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) AS ll_f,
  list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))*CAST(1.5 AS DOUBLE)) AS ll_g FROM embeddings)"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 50).alias("seq"),
        F.floor(F.col("vec_id") / 50).alias("pos"),
        F.col("label").alias("token"),
        F.transform("embedding", lambda x: x.cast("double")).alias("l"),
    )


def token_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Token log-likelihoods (natural log) under both models."""
    return table(spark, sf, "embeddings").select(
        "vec_id", "label",
        F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("ll_f"),
        F.transform("embedding", lambda x: -F.abs(x.cast("double")) * F.lit(1.5)).alias("ll_g"),
    )


# --- multiple-choice items from part -------------------------------------------------------------

_ITEMS = [
    "p_partkey AS idx",
    "p_name AS question",
    "replace(p_brand, '#', '_') AS subject",
    "CAST(p_partkey % 4 AS INT) AS answer",
]
V_ITEMS = (
    "v_items AS (SELECT " + ", ".join(_ITEMS)
    + ", [p_brand, p_type, concat('size ', CAST(p_size AS VARCHAR)), p_name] AS choices FROM part)"
)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        *_ITEMS, "array(p_brand, p_type, concat('size ', CAST(p_size AS STRING)), p_name) AS choices"
    )


# --- word tokens of the pairs ---------------------------------------------------------------------

SQL_WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}]+'), lambda x: x <> '')"
V_PAIR_TOKENS = (
    V_PAIRS + ", v_pair_tokens AS (SELECT conv_id, turn, prompt, response, "
    + SQL_WORDS.format("prompt") + " AS pt, " + SQL_WORDS.format("response") + " AS rt FROM v_pairs)"
)


def pair_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from ratiocert.functions.sequences import words

    return pairs(spark, sf).select(
        "conv_id", "turn", "prompt", "response",
        words(F.col("prompt")).alias("pt"), words(F.col("response")).alias("rt"),
    )


def joined(column: str):
    return F.array_join(column, " ")
