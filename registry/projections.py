"""Score columns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ratiocert.functions import scores as S
from ratiocert.functions import sequences as Q
from ratiocert.functions.codec import decimal_to_hex, hex_to_decimal
from ratiocert.operators.merges import with_config
from ratiocert.plans.certificates import scored

from .base import (SQL_WORDS, V_PAIR_TOKENS, V_SCORED, V_SCORES, V_TOKENS, joined, pair_tokens, query, scores,
                   table, token_scores)

LN2, LN10 = repr(math.log(2)), repr(math.log(10))


@query("prj_seq_loglik", f"WITH {V_TOKENS} SELECT vec_id, round(list_sum(ll_f),6) AS ll_model, round(list_sum(ll_g),6) AS ll_generator FROM v_tokens")
def prj_seq_loglik(spark, sf):
    t = token_scores(spark, sf)
    return t.select("vec_id", F.round(S.total(F.col("ll_f")), 6).alias("ll_model"), F.round(S.total(F.col("ll_g")), 6).alias("ll_generator"))


@query("prj_log_base", f"""SELECT l_orderkey, l_linenumber, l_partkey, round((-l_extendedprice/1000)/{LN2},6) AS ll2, round((-l_extendedprice/1000)/{LN10},6) AS ll10 FROM lineitem""")
def prj_log_base(spark, sf):
    ll = -F.col("l_extendedprice") / 1000
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(S.to_log2(ll), 6).alias("ll2"), F.round(S.to_log10(ll), 6).alias("ll10"))


@query("prj_response_len", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, CAST(len(pt)+len(rt)+1 AS BIGINT)-CAST(len(pt) AS BIGINT) AS with_eos,
  CAST(len(pt)+len(rt)+1 AS BIGINT)-CAST(len(pt) AS BIGINT)-1 AS without_eos FROM v_pair_tokens""")
def prj_response_len(spark, sf):
    t = pair_tokens(spark, sf)
    n, p = (F.size("pt") + F.size("rt") + 1).cast("long"), F.size("pt").cast("long")
    return t.select("conv_id", "turn", S.positive(S.response_length(n, p)).alias("with_eos"),
                    S.response_length(n, p, count_eos=False).alias("without_eos"))


@query("prj_log_ratio", f"WITH {V_SCORED} SELECT l_orderkey, l_linenumber, n_token_response, log2_ratio, log2_ratio_norm FROM v_scored")
def prj_log_ratio(spark, sf):
    return scored(scores(spark, sf)).select("l_orderkey", "l_linenumber", "n_token_response", "log2_ratio", "log2_ratio_norm")


@query("prj_norm_loglik", f"""WITH {V_SCORES} SELECT l_orderkey, l_linenumber, ll2_model/n_token_response AS ll2_model_norm,
  ll2_generator/n_token_response AS ll2_generator_norm,
  round(ll2_model/{S.LOG2_10!r}/n_token_response,6) AS ll10_model_norm FROM v_scores""")
def prj_norm_loglik(spark, sf):
    n = F.col("n_token_response")
    return scores(spark, sf).select(
        "l_orderkey", "l_linenumber", S.per_token(F.col("ll2_model"), n).alias("ll2_model_norm"),
        S.per_token(F.col("ll2_generator"), n).alias("ll2_generator_norm"),
        F.round(S.per_token(F.col("ll2_model") / F.lit(S.LOG2_10), n), 6).alias("ll10_model_norm"))


@query("prj_entropy_sum", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))),6) AS entropy FROM embeddings""")
def prj_entropy_sum(spark, sf):
    entropies = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.total(entropies), 6).alias("entropy"))


@query("prj_prompt_len", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, CAST(len(pt) AS BIGINT) AS from_data, CAST(12 AS BIGINT) AS constant FROM v_pair_tokens""")
def prj_prompt_len(spark, sf):
    n = F.size("pt")
    return pair_tokens(spark, sf).select("conv_id", "turn", S.prompt_length("dataset", n).alias("from_data"), S.prompt_length("12", n).alias("constant"))


@query("prj_char_len", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_char_response FROM documents")
def prj_char_len(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n_char_response"))


@query("prj_config_flatten", f"""WITH {V_SCORES} SELECT l_orderkey, l_linenumber, ll2_model, 'y|x' AS "model.target_distribution",
  'y' AS "generator.target_distribution", 0.5 AS "model.temperature", 'dataset' AS "inference.prompt_length" FROM v_scores""".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"))
def prj_config_flatten(spark, sf):
    config = spark.range(1).select(
        F.struct(F.lit("y|x").alias("target_distribution"), F.lit(0.5).alias("temperature")).alias("model"),
        F.struct(F.lit("y").alias("target_distribution")).alias("generator"),
        F.struct(F.lit("dataset").alias("prompt_length")).alias("inference"))
    return with_config(scores(spark, sf).select("l_orderkey", "l_linenumber", "ll2_model"), config)


@query("prj_distribution_label", """SELECT o_orderkey, concat('F(', f, ')||G(', g, ')') AS distributions,
  concat('F(', f, ')||G(', g, ')') IN ('F(y|x)||G(y|x)', 'F(x+y)||G(x+y)', 'F(y|x)||G(y)') AS known FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 'y|x' WHEN o_orderstatus='O' THEN 'x+y' ELSE 'y' END AS f,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'y' WHEN o_orderpriority LIKE '2%' THEN 'x+y' ELSE 'y|x' END AS g FROM orders) q""")
def prj_distribution_label(spark, sf):
    f = F.when(F.col("o_orderstatus") == "F", "y|x").when(F.col("o_orderstatus") == "O", "x+y").otherwise("y")
    g = F.when(F.col("o_orderpriority").startswith("1"), "y").when(F.col("o_orderpriority").startswith("2"), "x+y").otherwise("y|x")
    label = S.distributions_label(f, g)
    return table(spark, sf, "orders").select("o_orderkey", label.alias("distributions"), S.known_distributions(label).alias("known"))


@query("prj_ood_flag", "SELECT doc_id, CASE WHEN lang IN ('en') THEN 0 ELSE 1 END AS ood, CASE WHEN lang IN ('en') THEN 'Target Domain' ELSE 'Other' END AS label FROM documents")
def prj_ood_flag(spark, sf):
    ood = S.ood_flag(F.col("lang"), ["en"])
    return table(spark, sf, "documents").select("doc_id", ood.alias("ood"), S.domain_label(ood).alias("label"))


@query("prj_dataset_name", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pubmedqa' WHEN 1 THEN concat('squad_', p_brand)
  WHEN 2 THEN concat('mmlu_', p_brand, '_', CAST(p_size AS VARCHAR)) WHEN 3 THEN concat('task_data_int_', p_type)
  WHEN 4 THEN p_name ELSE concat('DatasetFromFile_', p_brand, '_test') END AS name FROM part""")
def prj_dataset_name(spark, sf):
    kinds = F.array(*map(F.lit, ["pubmedqa", "squad", "mmlu", "task_data", "sentences", "from_file"]))
    config = F.struct(
        F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("name"), F.col("p_brand").alias("categories"),
        F.col("p_size").alias("n_shot"), F.lit("int").alias("modality"), F.col("p_type").alias("task"),
        F.col("p_name").alias("topic"), F.col("p_brand").alias("directory"))
    return table(spark, sf, "part").withColumn("config", config).select("p_partkey", S.dataset_name(F.col("config")).alias("name"))


@query("prj_split_xy", f"""WITH {V_PAIR_TOKENS}, s AS (SELECT conv_id, turn, list_concat(pt, rt) AS t, len(pt) AS n FROM v_pair_tokens)
  SELECT conv_id, turn, array_to_string(t[1:n], ' ') AS x, array_to_string(t[n+1:len(t)], ' ') AS y FROM s""")
def prj_split_xy(spark, sf):
    t, n = F.concat("pt", "rt"), F.size("pt")
    return pair_tokens(spark, sf).select("conv_id", "turn", joined(Q.head(t, n)).alias("x"), joined(Q.tail_from(t, n)).alias("y"))


@query("prj_scope", f"""WITH {V_PAIR_TOKENS}, s AS (SELECT conv_id, turn, list_concat(['<s>'], pt, rt) AS t, len(pt)+1 AS n FROM v_pair_tokens)
  SELECT conv_id, turn, array_to_string(t[n+1:len(t)], ' ') AS given_x,
  array_to_string(list_concat(['<s>'], t[n+1:len(t)]), ' ') AS y_input, array_to_string(t[2:len(t)], ' ') AS xy FROM s""")
def prj_scope(spark, sf):
    bos = F.lit(Q.BOS)
    t, n = F.concat(F.array(bos), "pt", "rt"), F.size("pt") + 1
    return pair_tokens(spark, sf).select(
        "conv_id", "turn", joined(Q.scored_tokens(t, n, "y|x")).alias("given_x"),
        joined(Q.scope(t, n, "y", bos)).alias("y_input"), joined(Q.scored_tokens(t, n, "x+y")).alias("xy"))


@query("prj_text_prompt_len", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, CAST(len({SQL_WORDS.format("substring(concat(prompt, chr(10), response), 1, length(prompt))")}) AS BIGINT) AS n FROM v_pair_tokens""")
def prj_text_prompt_len(spark, sf):
    text = F.concat("prompt", F.lit("\n"), "response")
    n = Q.other_prompt_length(text, F.length("prompt"), Q.words)
    return pair_tokens(spark, sf).select("conv_id", "turn", n.cast("long").alias("n"))


# The first 24 digits of a text's digest as an identifier of 96 bits.
@query("prj_id_codec", """WITH d AS (SELECT doc_id, substring(md5(text), 1, 24) AS h FROM documents),
  n AS (SELECT doc_id, h, CAST(CAST(concat('0x', h[1:12]) AS BIGINT) AS HUGEINT) * 281474976710656 + CAST(concat('0x', h[13:24]) AS BIGINT) AS n FROM d)
  SELECT doc_id, CAST(n AS VARCHAR) AS id_decimal, coalesce(nullif(ltrim(h, '0'), ''), '0') AS id_hex FROM n""")
def prj_id_codec(spark, sf):
    number = hex_to_decimal(F.substring(F.md5("text"), 1, 24))
    return table(spark, sf, "documents").select("doc_id", number.alias("id_decimal")).select("doc_id", "id_decimal", decimal_to_hex(F.col("id_decimal")).alias("id_hex"))
