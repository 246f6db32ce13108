"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiocert.functions import logits as G
from ratiocert.functions import sequences as Q
from ratiocert.operators import aggregates as A
from ratiocert.operators.quantiles import exact_quantiles, wide_quantiles
from ratiocert.operators.thresholds import confusion, rates
from ratiocert.plans import certificates as C

from .base import (V_BENCH, V_JUDGE, V_LOGITS, V_PAIR_TOKENS, V_PAIRS, V_SCORED, V_SCORES, bench, judged, logits,
                   pair_tokens, pairs, query, scores, table)
from .certificates import SQL_K10, SQL_RATES, rounded, sql_cr


@query("agg_group_count", "SELECT lang, source, count(*) AS counts FROM documents GROUP BY lang, source")
def agg_group_count(spark, sf):
    return A.counts(table(spark, sf, "documents"), ["lang", "source"])


@query("agg_quantile", "SELECT CAST(q AS DOUBLE) AS q, round(v, 9) AS quantile FROM ("
       + " UNION ALL ".join(f"SELECT {q} AS q, quantile_cont(o_totalprice, {q}) AS v FROM orders" for q in (0.0, 0.1, 0.5, 0.9, 0.99)) + ") t")
def agg_quantile(spark, sf):
    return rounded(exact_quantiles(table(spark, sf, "orders"), "o_totalprice", [0.0, 0.1, 0.5, 0.9, 0.99]), 9)


@query("agg_quantile_ranked", "SELECT event_type, CAST(q AS DOUBLE) AS q, round(v, 9) AS quantile FROM ("
       + " UNION ALL ".join(f"SELECT event_type, {q} AS q, quantile_cont(value, {q}) AS v FROM events GROUP BY event_type" for q in (0.05, 0.5, 0.95)) + ") t")
def agg_quantile_ranked(spark, sf):
    """The same operator on its path for groups too large for one task."""
    return rounded(exact_quantiles(table(spark, sf, "events"), "value", [0.05, 0.5, 0.95], ["event_type"], small_rows=0), 9)


@query("agg_group_percentiles", f"""WITH {V_SCORED} SELECT dataset, round(quantile_cont(log2_ratio_norm,0.1),9) AS p10, round(quantile_cont(log2_ratio_norm,0.5),9) AS median,
  round(quantile_cont(log2_ratio_norm,0.9),9) AS p90, printf('%.0f / %.0f / %.0f', quantile_cont(log2_ratio_norm,0.1), quantile_cont(log2_ratio_norm,0.5), quantile_cont(log2_ratio_norm,0.9)) AS combined FROM v_scored GROUP BY dataset""")
def agg_group_percentiles(spark, sf):
    long = exact_quantiles(C.scored(scores(spark, sf)), "log2_ratio_norm", [0.1, 0.5, 0.9], ["dataset"])
    wide = wide_quantiles(long, ["dataset"], {0.1: "p10", 0.5: "median", 0.9: "p90"})
    return rounded(wide.withColumn("combined", F.format_string("%.0f / %.0f / %.0f", "p10", "median", "p90")), 9)


@query("agg_subset_max", f"""WITH {V_SCORES} SELECT ood, max(ll2_generator) AS max_ll2_generator, max(ll2_model) AS max_ll2_model,
  max(ll2_generator/n_token_response) AS max_ll2_generator_norm FROM v_scores GROUP BY ood""")
def agg_subset_max(spark, sf):
    rows = scores(spark, sf).withColumn("ll2_generator_norm", F.col("ll2_generator") / F.col("n_token_response"))
    return A.subset_maxima(rows, "ood", ["ll2_generator", "ll2_model", "ll2_generator_norm"])


CONF_SQL = f"""WITH {V_SCORED}, c AS (SELECT count(*) FILTER (ood=0 AND NOT log2_ratio_norm>2) AS tn, count(*) FILTER (ood=0 AND log2_ratio_norm>2) AS fp,
  count(*) FILTER (ood=1 AND NOT log2_ratio_norm>2) AS fn, count(*) FILTER (ood=1 AND log2_ratio_norm>2) AS tp FROM v_scored)"""


def _confusion(spark, sf):
    return C.scored(scores(spark, sf)).agg(*confusion(F.col("log2_ratio_norm") > 2.0, F.col("ood")))


@query("agg_confusion", CONF_SQL + " SELECT tn, fp, fn, tp FROM c")
def agg_confusion(spark, sf):
    return _confusion(spark, sf)


@query("agg_rates", CONF_SQL + f' SELECT round("FRR",9) AS "FRR", round("TRR",9) AS "TRR", round("FAR",9) AS "FAR", round("J",9) AS "J" FROM (SELECT {SQL_RATES} FROM c) q')
def agg_rates(spark, sf):
    return rounded(_confusion(spark, sf).select(*rates()), 9)


@query("agg_accuracy", f"WITH {V_BENCH} SELECT subject, round(avg(correct),9) AS accuracy, count(*) AS n FROM bench GROUP BY ROLLUP (subject)")
def agg_accuracy(spark, sf):
    return rounded(A.accuracy(bench(spark, sf), "subject", "correct"), 9)


@query("agg_length_stats", "SELECT min(n_chars) AS min_length, round(avg(n_chars),6) AS mean_length, max(n_chars) AS max_length FROM documents")
def agg_length_stats(spark, sf):
    return rounded(A.length_stats(table(spark, sf, "documents"), "n_chars"))


@query("agg_judge_share", f"WITH {V_JUDGE} SELECT " + ", ".join(
    f"round(avg(CASE WHEN decision='{d}' THEN 1.0 ELSE 0.0 END),9) AS \"prop_judge_{d}\"" for d in A.DECISIONS) + " FROM v_judge")
def agg_judge_share(spark, sf):
    return rounded(judged(spark, sf).agg(*A.decision_share_columns()), 9)


@query("agg_abstain_decision", f"""WITH {V_JUDGE}, cells AS (SELECT a AS abstained, d AS decision FROM (VALUES (true), (false)) x(a) CROSS JOIN (VALUES ('IN'), ('OUT'), ('INVALID')) y(d)),
  n AS (SELECT abstained, decision, count(*) AS n FROM v_judge GROUP BY 1, 2)
  SELECT cells.abstained, cells.decision, round(coalesce(n.n, 0)/CAST((SELECT count(*) FROM v_judge) AS DOUBLE), 9) AS share FROM cells LEFT JOIN n ON n.abstained=cells.abstained AND n.decision=cells.decision""")
def agg_abstain_decision(spark, sf):
    return rounded(A.abstain_by_decision(judged(spark, sf)), 9)


# Predictions: the prompt's words against the response's words.
SQL_ERR = """(len(list_filter(range(1, least(len(pt), len(rt))+1), lambda i: pt[i] <> rt[i])) + abs(len(pt)-len(rt)))"""


@query("agg_token_mismatch", f"WITH {V_PAIR_TOKENS} SELECT conv_id, turn, CAST({SQL_ERR} AS BIGINT) AS n_incorrect FROM v_pair_tokens")
def agg_token_mismatch(spark, sf):
    return pair_tokens(spark, sf).select("conv_id", "turn", Q.mismatches(F.col("pt"), F.col("rt")).alias("n_incorrect"))


@query("agg_error_hist", f"""WITH {V_PAIR_TOKENS}, e AS (SELECT CAST({SQL_ERR} AS BIGINT) AS n_incorrect FROM v_pair_tokens)
  SELECT n_incorrect, count(*) AS n, round((SELECT avg(CASE WHEN n_incorrect=0 THEN 1.0 ELSE 0.0 END) FROM e),9) AS share_correct FROM e GROUP BY n_incorrect""")
def agg_error_hist(spark, sf):
    return rounded(A.error_histogram(agg_token_mismatch(spark, sf), "n_incorrect"), 9)


@query("agg_exact_match", f"""WITH {V_PAIRS} SELECT round(avg(CASE WHEN right(concat(prompt, t), length(t)) = t THEN 1.0 ELSE 0.0 END),9) AS accuracy FROM
  (SELECT prompt, CASE WHEN turn % 4 = 0 THEN substring(prompt, length(prompt)//2 + 1) ELSE response END AS t, CASE WHEN turn % 4 = 0 THEN '' ELSE 'x' END AS z FROM v_pairs) q""".replace("concat(prompt, t)", "concat(prompt, z)"))
def agg_exact_match(spark, sf):
    p = pairs(spark, sf)
    target = F.when(F.col("turn") % 4 == 0, F.expr("substring(prompt, length(prompt) div 2 + 1)")).otherwise(F.col("response"))
    response = F.concat("prompt", F.when(F.col("turn") % 4 == 0, "").otherwise("x"))
    return p.agg(F.round(A.exact_match(response, target), 9).alias("accuracy"))


SQL_LL = "(l[token+1] - list_max(l) - ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))))"


@query("agg_perplexity", f"""WITH {V_LOGITS} SELECT round(exp(-avg({SQL_LL})),6) AS perplexity, round(exp(-avg({SQL_LL}) FILTER (token % 3 <> 0)),6) AS perplexity_labels FROM v_logits""")
def agg_perplexity(spark, sf):
    """Over all tokens, and over those with a label (here: every third token has none)."""
    ll, label = G.token_loglik(F.col("l"), F.col("token")), F.when(F.col("token") % 3 == 0, -100).otherwise(F.col("token"))
    return logits(spark, sf).agg(
        F.round(A.perplexity(ll), 6).alias("perplexity"), F.round(A.perplexity(ll, label, "labels"), 6).alias("perplexity_labels"))


def _hist_sql(source: str, value: str, bins: int) -> str:
    return f""", h AS (SELECT dataset, {value} AS v FROM {source}), lim AS (SELECT min(v) AS lo, max(v) AS hi FROM h),
  b AS (SELECT dataset, CAST(least(floor((v-lo)/((hi-lo)/{bins}.0)), {bins - 1}) AS INT) AS bin, count(*) AS n, any_value((hi-lo)/{bins}.0) AS w FROM h CROSS JOIN lim GROUP BY 1, 2),
  t AS (SELECT dataset, count(*) AS total FROM h GROUP BY 1) SELECT b.dataset, bin, n, round(n/(total*w),6) AS density FROM b JOIN t ON b.dataset=t.dataset"""


@query("agg_histogram", f"WITH {V_SCORED}" + _hist_sql("v_scored", "log2_ratio_norm", 50))
def agg_histogram(spark, sf):
    return rounded(A.histogram(C.scored(scores(spark, sf)), "log2_ratio_norm", "dataset", 50))


@query("agg_histogram_constriction", f"WITH {V_SCORED}, {SQL_K10}, c AS (SELECT dataset, {sql_cr()} AS cr FROM v_scored CROSS JOIN k10 WHERE ood=1)" + _hist_sql("c", "cr", 40))
def agg_histogram_constriction(spark, sf):
    return rounded(C.constriction_histogram(scores(spark, sf), 0.1))


@query("agg_ecdf", """SELECT o_orderpriority AS dataset, o_totalprice AS value, count(*) AS n, round(max(cd),9) AS cdf FROM
  (SELECT o_orderpriority, o_totalprice, cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS cd FROM orders) q GROUP BY 1, 2""")
def agg_ecdf(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_totalprice").alias("value"))
    return rounded(A.ecdf(rows, "value", "dataset"), cdf=9, value=9)


@query("agg_tail_share", f"""WITH {V_SCORED} SELECT dataset, round(avg(CASE WHEN log2_ratio_norm < 0.5 THEN 1.0 ELSE 0.0 END),9) AS below,
  round(avg(CASE WHEN log2_ratio_norm > 2.5 THEN 1.0 ELSE 0.0 END),9) AS above FROM v_scored GROUP BY dataset""")
def agg_tail_share(spark, sf):
    return rounded(A.tail_shares(C.scored(scores(spark, sf)), "log2_ratio_norm", 0.5, 2.5, ["dataset"]), 9)


@query("agg_melt", """WITH m AS (SELECT o_orderkey, o_totalprice AS total, o_totalprice/2 AS half FROM orders)
  SELECT o_orderkey, 'total' AS "Metric", total AS "Value" FROM m WHERE o_totalprice >= 1000 UNION ALL SELECT o_orderkey, 'half', half FROM m WHERE half >= 1000""".replace("o_totalprice >= 1000", "total >= 1000"))
def agg_melt(spark, sf):
    wide = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), (F.col("o_totalprice") / 2).alias("half"))
    return A.melted(wide, ["o_orderkey"], ["total", "half"]).where(F.col("Value") >= 1000)
