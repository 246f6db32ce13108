"""ROUGE and BLEU of prompts against responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiocert.operators import overlap as O

from .base import V_PAIRS, pairs, query
from .certificates import rounded

SQL_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
SQL_SIDES = f"{V_PAIRS}, v AS (SELECT conv_id, turn, {SQL_TOKENS.format('prompt')} AS a, {SQL_TOKENS.format('response')} AS b FROM v_pairs)"


def sql_overlap(n: int) -> str:
    gram = lambda c: f"unnest(list_transform(range(1, len({c}) + 2 - {n}), lambda i: array_to_string({c}[i:i+{n - 1}], ' ')))"
    return f"""ga{n} AS (SELECT conv_id, turn, {gram('a')} AS g FROM v), gb{n} AS (SELECT conv_id, turn, {gram('b')} AS g FROM v),
  ca{n} AS (SELECT conv_id, turn, g, count(*) AS c FROM ga{n} GROUP BY ALL), cb{n} AS (SELECT conv_id, turn, g, count(*) AS c FROM gb{n} GROUP BY ALL),
  m{n} AS (SELECT ca{n}.conv_id, ca{n}.turn, CAST(sum(least(ca{n}.c, cb{n}.c)) AS BIGINT) AS o FROM ca{n} JOIN cb{n} USING (conv_id, turn, g) GROUP BY 1, 2),
  o{n} AS (SELECT v.conv_id, v.turn, coalesce(m{n}.o, 0) AS overlap, CAST(greatest(len(a)-{n - 1}, 0) AS BIGINT) AS na, CAST(greatest(len(b)-{n - 1}, 0) AS BIGINT) AS nb FROM v LEFT JOIN m{n} USING (conv_id, turn))"""


SQL_F1 = "CASE WHEN overlap > 0 THEN 2*(overlap/CAST(na AS DOUBLE))*(overlap/CAST(nb AS DOUBLE))/((overlap/CAST(na AS DOUBLE))+(overlap/CAST(nb AS DOUBLE))) ELSE 0.0 END"


def _sides(spark, sf):
    return pairs(spark, sf).select(
        "conv_id", "turn", O.overlap_tokens(F.col("prompt")).alias("a"), O.overlap_tokens(F.col("response")).alias("b"))


# The longest common subsequence row by row: a row holds, per place of one side, the longest so far.
SQL_LCS = """CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_reduce(list_prepend(list_transform(a, lambda x: 0), list_transform(b, lambda y: list_transform(a, lambda x: CASE WHEN x = y THEN 1 ELSE 0 END))),
  lambda acc, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k], coalesce(acc[k-1], 0) + m[k])))))[-1] END"""
SQL_L = f"ol AS (SELECT conv_id, turn, CAST({SQL_LCS} AS BIGINT) AS overlap, CAST(len(a) AS INT) AS na, CAST(len(b) AS INT) AS nb FROM v)"


@query("agg_rouge", f"WITH {SQL_SIDES}, {sql_overlap(1)}, {sql_overlap(2)}, {SQL_L} SELECT 'rouge1' AS metric, round(avg({SQL_F1}),6) AS value FROM o1 UNION ALL SELECT 'rouge2', round(avg({SQL_F1}),6) FROM o2 UNION ALL SELECT 'rougeL', round(avg({SQL_F1}),6) FROM ol")
def agg_rouge(spark, sf):
    return rounded(O.rouge(_sides(spark, sf), ["conv_id", "turn"], "a", "b"))


@query("agg_rouge_l", f"WITH {SQL_SIDES}, {SQL_L} SELECT conv_id, turn, overlap, na AS n_response, nb AS n_target, {SQL_F1} AS f1 FROM ol")
def agg_rouge_l(spark, sf):
    return O.rouge_l(_sides(spark, sf), ["conv_id", "turn"], "a", "b")


@query("agg_ngram_overlap", f"WITH {SQL_SIDES}, {sql_overlap(2)} SELECT conv_id, turn, overlap, na AS n_response, nb AS n_target FROM o2")
def agg_ngram_overlap(spark, sf):
    return O.ngram_overlap(_sides(spark, sf), ["conv_id", "turn"], "a", "b", 2)


@query("agg_bleu", f"WITH {SQL_SIDES}, {sql_overlap(1)}, {sql_overlap(2)}, {sql_overlap(3)}, {sql_overlap(4)}, t AS (" + " UNION ALL ".join(
    f"SELECT sum(overlap) AS h, sum(na) AS n FROM o{n}" for n in range(1, 5)) + """), s AS (SELECT CAST(sum(len(a)) AS DOUBLE) AS c, CAST(sum(len(b)) AS DOUBLE) AS r FROM v)
  SELECT round(CASE WHEN min(h) > 0 THEN exp(avg(ln(CASE WHEN h > 0 THEN h/CAST(n AS DOUBLE) ELSE 1 END)))*any_value(CASE WHEN c >= r THEN 1.0 ELSE exp(1.0 - r/c) END) END, 6) AS bleu FROM t CROSS JOIN s""")
def agg_bleu(spark, sf):
    return rounded(O.bleu(_sides(spark, sf), ["conv_id", "turn"], "a", "b"))
