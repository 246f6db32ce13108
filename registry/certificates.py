"""Certificates, thresholds, curves and the gate."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ratiocert.functions import scores as S
from ratiocert.operators.ordering import sequence_grid
from ratiocert.plans import certificates as C
from ratiocert.plans import corpus as P
from ratiocert.plans import curves as V
from ratiocert.plans import gate as G
from ratiocert.plans.thresholds import k_from_eps, k_from_eps_quantile, k_from_frr
from ratiocert.session import cut_lineage
from ratiocert.streaming import gate_stream as ST

from .base import (GATE_K, GATE_T, V_BENCH, V_BENCH_LL, V_GATE, V_JUDGE, V_SCORED, V_SCORES, V_TOKENS, bench, bench_ll,
                   draws, judged, query, scores, table, token_scores, wide_table)

L10 = repr(S.LOG2_10)
L2 = repr(S.LOG10_2)
FRRS = ", ".join(f"(CAST({f} AS DOUBLE), CAST({1.0 - f!r} AS DOUBLE))" for f in C.FRR_TABLE)
# quantile_cont takes constants only: one branch per false-rejection rate.
SQL_KS = "ks AS (" + " UNION ALL ".join(
    f"SELECT CAST({f} AS DOUBLE) AS \"FRR\", quantile_cont(log2_ratio_norm, {1.0 - f!r}) AS k FROM v_scored WHERE ood=0"
    for f in C.FRR_TABLE) + ")"
SQL_K10 = "k10 AS (SELECT quantile_cont(log2_ratio_norm, 0.9) AS k FROM v_scored WHERE ood=0)"


def sql_cr(k: str = "k", g: str = "ll2_generator", n: str = "n_token_response", m: str = "ll2_model") -> str:
    return f"({m} - ({g} + {k}*{n}))/{L10}"


def sql_grid(name: str, low: float, high: float, points: int, column: str = "log10_eps") -> str:
    step = (high - low) / (points - 1)
    return f"{name} AS (SELECT CAST(i AS INT) AS grid_id, CAST({low} AS DOUBLE) + CAST(i AS DOUBLE)*CAST({step!r} AS DOUBLE) AS {column} FROM range({points}) t(i))"


def sql_eps_k(name: str, grid: str, low: float, high: float, rows: str = "v_scored WHERE ood=1") -> str:
    return (f"{name} AS (SELECT grid_id, log10_eps, least(greatest(k0, CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE)) AS k FROM ("
            f"SELECT grid_id, any_value(log10_eps) AS log10_eps, min((log10_eps/{L2} - 0.0 - ll2_generator)/n_token_response) AS k0 "
            f"FROM {grid} CROSS JOIN (SELECT * FROM {rows}) r GROUP BY grid_id) q)")


SQL_RATES = """CASE WHEN fp+tn>0 THEN CAST(fp AS DOUBLE)/(fp+tn) ELSE 0 END AS "FRR", CASE WHEN tp+fn>0 THEN CAST(tp AS DOUBLE)/(tp+fn) ELSE 0 END AS "TRR",
 CASE WHEN tp+fn>0 THEN CAST(fn AS DOUBLE)/(tp+fn) ELSE 0 END AS "FAR",
 CASE WHEN tp+fn>0 THEN CAST(tp AS DOUBLE)/(tp+fn) ELSE 0 END - CASE WHEN fp+tn>0 THEN CAST(fp AS DOUBLE)/(fp+tn) ELSE 0 END AS "J\""""


def sql_confusion(name: str, grid: str) -> str:
    return (f"{name} AS (SELECT grid_id, count(*) FILTER (ood=0 AND NOT log2_ratio_norm>k) AS tn, count(*) FILTER (ood=0 AND log2_ratio_norm>k) AS fp, "
            f"count(*) FILTER (ood=1 AND NOT log2_ratio_norm>k) AS fn, count(*) FILTER (ood=1 AND log2_ratio_norm>k) AS tp "
            f"FROM v_scored CROSS JOIN {grid} GROUP BY grid_id)")


def rounded(df, digits: int = 6, **named):
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, named.get(n, digits)) for n in doubles})


@query("crt_upper_bound", f"WITH {V_SCORES} SELECT l_orderkey, l_linenumber, ll2_generator + 1.0 + CAST(2.5 AS DOUBLE)*n_token_response AS bound FROM v_scores")
def crt_upper_bound(spark, sf):
    bound = S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), 2, F.lit(2.5))
    return scores(spark, sf).select("l_orderkey", "l_linenumber", bound.alias("bound"))


@query("crt_accept", f"WITH {V_SCORED} SELECT l_orderkey, l_linenumber, n_token_response, log2_ratio <= CAST(0.4 AS DOUBLE)*n_token_response AS accepted FROM v_scored")
def crt_accept(spark, sf):
    ratio = S.log_ratio(F.col("ll2_model"), F.col("ll2_generator"))
    return scores(spark, sf).select("l_orderkey", "l_linenumber", "n_token_response",
                                    S.accepts(ratio, F.col("n_token_response"), F.lit(0.4)).alias("accepted"))


# Lists end in 0 under both models for even labels, and under one of them for labels that 3 divides.
SQL_ENDED = "CASE WHEN {c} THEN list_concat({l}[1:63], [CAST(0 AS DOUBLE)]) ELSE {l} END"


@query("crt_token_count", f"""WITH {V_TOKENS}, e AS (SELECT vec_id, {SQL_ENDED.format(c="label % 2 = 0 OR label % 3 = 0", l="ll_f")} AS f, {SQL_ENDED.format(c="label % 2 = 0", l="ll_g")} AS g FROM v_tokens)
  SELECT vec_id, CAST(len(f) - CASE WHEN f[len(f)] = 0 AND g[len(g)] = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_token, round(list_sum(f), 9) AS ll FROM e""")
def crt_token_count(spark, sf):
    t = token_scores(spark, sf)
    ended = lambda c, when: F.when(when, F.concat(F.slice(c, 1, 63), F.array(F.lit(0.0)))).otherwise(F.col(c))
    even = F.col("label") % 2 == 0
    lists = t.select("vec_id", ended("ll_f", even | (F.col("label") % 3 == 0)).alias("f"), ended("ll_g", even).alias("g"))
    return lists.select("vec_id", S.certified_tokens(F.col("f"), F.col("g")).alias("n_token"), F.round(S.total(F.col("f")), 9).alias("ll"))


@query("crt_rejection_sampling", f"""WITH {V_GATE} SELECT request_id, abstained, num_samples, CAST({GATE_T} AS INT) AS max_samples, log_prob_f, log_prob_g, last_ratio, last_bound FROM gate""")
def crt_rejection_sampling(spark, sf):
    out = G.run_gate(draws(spark, sf), GATE_K, GATE_T)
    return out.select("request_id", "abstained", "num_samples", "max_samples", "log_prob_f", "log_prob_g",
                      F.element_at("log_ratios", -1).alias("last_ratio"), F.element_at("log_upper_bounds", -1).alias("last_bound"))


@query("crt_draw_history", f"""WITH {V_GATE} SELECT request_id, CAST(attempt AS INT) AS attempt, r AS log_ratio, bound AS log_upper_bound, r/n_token AS log_ratio_normalized FROM kept""")
def crt_draw_history(spark, sf):
    out = G.run_gate(draws(spark, sf), GATE_K, GATE_T)
    zipped = F.arrays_zip("log_ratios", "log_upper_bounds", "log_ratios_normalized")
    return out.select("request_id", F.posexplode(zipped).alias("pos", "h")).select(
        "request_id", (F.col("pos") + 1).alias("attempt"), F.col("h.log_ratios").alias("log_ratio"),
        F.col("h.log_upper_bounds").alias("log_upper_bound"), F.col("h.log_ratios_normalized").alias("log_ratio_normalized"))


@query("crt_k_from_frr", f"""WITH {V_SCORED}, {SQL_KS} SELECT "FRR", round(k, 9) AS k FROM ks""")
def crt_k_from_frr(spark, sf):
    return rounded(k_from_frr(C.scored(scores(spark, sf)), C.FRR_TABLE), 9)


@query("crt_k_from_eps", f"""WITH {V_SCORED}, {sql_grid("grid", -50.0, 50.0, 501)}, {sql_eps_k("ks", "grid", -100.0, 100.0)}
  SELECT round(log10_eps, 6) AS log10_eps, round(k, 6) AS k FROM ks""")
def crt_k_from_eps(spark, sf):
    rows = scores(spark, sf).where("ood = 1")
    ks = k_from_eps(rows, sequence_grid(spark, 501, -50.0, 50.0, "log10_eps"), -100.0, 100.0)
    return rounded(ks.select("log10_eps", "k"))


def sql_eps_k_quantile(name: str, grid: str, q: float, low: float, high: float, steps: int = 45) -> str:
    """The same by bisection, one step a subquery: the quantile of the bounds rises with k."""
    parts = [f"{name}_0 AS (SELECT grid_id, log10_eps, CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi FROM {grid})",
             f"{name}_r AS (SELECT ll2_generator AS g, n_token_response AS n FROM v_scored WHERE ood=1)"]
    for i in range(steps):
        parts.append(f"{name}_{i + 1} AS (SELECT grid_id, log10_eps, CASE WHEN v < log10_eps/{L2} THEN m ELSE lo END AS lo, CASE WHEN v < log10_eps/{L2} THEN hi ELSE m END AS hi FROM ("
                     f"SELECT grid_id, log10_eps, lo, hi, (lo+hi)/2 AS m, quantile_cont(g + (lo+hi)/2*n, {q}) AS v FROM {name}_{i} CROSS JOIN {name}_r GROUP BY ALL) q)")
    return ", ".join(parts) + f", {name} AS (SELECT grid_id, log10_eps, (lo+hi)/2 AS k FROM {name}_{steps})"


@query("crt_k_from_eps_quantile", f"""WITH {V_SCORED}, {sql_grid("grid", -20.0, 0.0, 5)}, {sql_eps_k_quantile("ks", "grid", 0.95, -10.0, 100.0)}
  SELECT round(log10_eps,6) AS log10_eps, round(k,5) AS k FROM ks""")
def crt_k_from_eps_quantile(spark, sf):
    rows = scores(spark, sf).where("ood = 1")
    ks = k_from_eps_quantile(rows, sequence_grid(spark, 5, -20.0, 0.0, "log10_eps"), 0.95, -10.0, 100.0)
    return ks.select(F.round("log10_eps", 6).alias("log10_eps"), F.round("k", 5).alias("k"))


@query("crt_constriction", f"""WITH {V_SCORES}, c AS (SELECT l_orderkey, l_linenumber, ll2_model - (ll2_generator + CAST(1 AS DOUBLE)*n_token_response) AS cr FROM v_scores)
  SELECT l_orderkey, l_linenumber, cr AS log2_cr, round(cr/{L10},6) AS log10_cr, round(cr/{math.log2(math.e)!r},6) AS ln_cr, round(pow(2.0, cr)/pow(10.0, floor(cr/{L10})),6) AS p_cr, CAST(floor(cr/{L10}) AS BIGINT) AS p_cr_exponent FROM c""")
def crt_constriction(spark, sf):
    bound = S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), 1, F.lit(1.0))
    cr = lambda base: S.constriction(F.col("ll2_model"), bound, base)
    exponent = F.floor(cr("log10"))
    mantissa = cr("probability") / F.pow(F.lit(10.0), exponent.cast("double"))
    return scores(spark, sf).select(
        "l_orderkey", "l_linenumber", cr("log2").alias("log2_cr"), F.round(cr("log10"), 6).alias("log10_cr"),
        F.round(cr("ln"), 6).alias("ln_cr"), F.round(mantissa, 6).alias("p_cr"), exponent.cast("long").alias("p_cr_exponent"))


SQL_PCTS = ", ".join(f"round(quantile_cont(cr, {q}), 6) AS {n}" for q, n in C.PERCENTILES.items())
EPS_TABLE_SQL = f"""WITH {V_SCORED}, {{grid}}, {sql_eps_k("ks", "grid", -100.0, 100.0)},
  crossed AS (SELECT grid_id, {sql_cr()} AS cr FROM ks CROSS JOIN (SELECT * FROM v_scored WHERE ood=1) r),
  pct AS (SELECT grid_id, {SQL_PCTS} FROM crossed GROUP BY grid_id)
  SELECT CAST(1 AS INT) AS "T", round(log10_eps,6) AS log10_eps, round(k,6) AS k_min, round(k,6) AS k_mid, round(k,6) AS k_max,
  log10_cr_10, log10_cr_median, log10_cr_90 FROM ks JOIN pct USING (grid_id)"""


@query("crt_eps_table", EPS_TABLE_SQL.format(grid=sql_grid("grid", -50.0, 50.0, 501)))
def crt_eps_table(spark, sf):
    return rounded(C.eps_table(scores(spark, sf).where("ood = 1")))


@query("crt_eps_table_q95", f"""WITH {V_SCORED}, {sql_grid("grid", -20.0, 0.0, 5)}, {sql_eps_k_quantile("ks", "grid", 0.95, -10.0, 100.0)},
  crossed AS (SELECT grid_id, {sql_cr()} AS cr FROM ks CROSS JOIN (SELECT * FROM v_scored WHERE ood=1) r),
  pct AS (SELECT grid_id, """ + SQL_PCTS.replace(", 6)", ", 4)") + """ FROM crossed GROUP BY grid_id)
  SELECT round(log10_eps,6) AS log10_eps, round(k,5) AS k_mid, log10_cr_10, log10_cr_median, log10_cr_90 FROM ks JOIN pct USING (grid_id)""")
def crt_eps_table_q95(spark, sf):
    """For data that isn't clean: the 95 % quantile of the bounds meets epsilon."""
    out = C.eps_table(scores(spark, sf).where("ood = 1"), points=5, low=-20.0, high=0.0, bracket=(-10.0, 100.0), upper_quantile=0.95)
    return rounded(out.select("log10_eps", "k_mid", *C.PERCENTILES.values()), 4, log10_eps=6, k_mid=5)


@query("crt_constriction_by_frr", f"""WITH {V_SCORED}, {SQL_KS}, crossed AS (SELECT "FRR", k, {sql_cr()} AS cr FROM ks CROSS JOIN (SELECT * FROM v_scored WHERE ood=1) r)
  SELECT "FRR", round(any_value(k), 9) AS k, {SQL_PCTS},
  printf('%.0f / %.0f / %.0f', quantile_cont(cr, 0.1), quantile_cont(cr, 0.5), quantile_cont(cr, 0.9)) AS combined FROM crossed GROUP BY "FRR\"""")
def crt_constriction_by_frr(spark, sf):
    return rounded(C.constriction_by_frr(scores(spark, sf)), k=9)


@query("crt_constriction_quantiles", f"""WITH {V_SCORED}, {SQL_K10}, c AS (SELECT {sql_cr()} AS cr FROM v_scored CROSS JOIN k10 WHERE ood=1)
  """ + " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(cr, {q}),6) AS quantile FROM c" for q in C.QUANTILES))
def crt_constriction_quantiles(spark, sf):
    return rounded(C.constriction_quantiles(scores(spark, sf), 0.1))


@query("crt_atomic", f"""WITH {V_SCORED}, {SQL_K10}, b AS (SELECT l_orderkey, l_linenumber, dataset, n_token_response, ll2_model, ll2_generator + k*n_token_response AS bound FROM v_scored CROSS JOIN k10)
  SELECT l_orderkey, l_linenumber, dataset, n_token_response, round(bound/{L10},6) AS log10_upper_bound_m,
  round(log10(CASE WHEN pow(2.0, bound) > 1e-300 AND pow(2.0, bound) < 10000.0 THEN pow(2.0, bound) ELSE 2e-300 END),6) AS log10_p, round(ll2_model/{L10},6) AS log10_upper_bound_f FROM b""")
def crt_atomic(spark, sf):
    out = C.atomic_certificates(scores(spark, sf), 0.1)
    return rounded(out.select("l_orderkey", "l_linenumber", "dataset", "n_token_response", "log10_upper_bound_m",
                              F.log10("upper_bound_m").alias("log10_p"), "log10_upper_bound_f"))


DETECTION_SQL = f"""WITH {V_SCORED}, lo AS (SELECT min(log2_ratio_norm) AS m FROM v_scored),
  grid AS (SELECT CAST(i AS INT) AS grid_id, m + CAST(i AS DOUBLE)*((10.0-m)/99.0) AS k FROM lo CROSS JOIN range(100) t(i)),
  {sql_confusion("counts", "grid")}, med AS (SELECT grid_id, quantile_cont({sql_cr()}, 0.5) AS cr FROM grid CROSS JOIN (SELECT * FROM v_scored WHERE ood=1) r GROUP BY grid_id),
  curve AS (SELECT grid_id, k, {SQL_RATES}, cr FROM grid JOIN counts USING (grid_id) JOIN med USING (grid_id))"""


@query("crv_detection", DETECTION_SQL + """ SELECT grid_id, round(k,6) AS k, round("FRR",9) AS "FRR", round("TRR",9) AS "TRR", round("J",9) AS "J", round(cr,6) AS log10_constriction_ratio FROM curve""")
def crv_detection(spark, sf):
    return rounded(V.detection_curve(scores(spark, sf)), FRR=9, TRR=9, J=9)


@query("srt_topk_j", DETECTION_SQL + """ SELECT round(k,6) AS k, round("FRR",9) AS "FRR", round("TRR",9) AS "TRR", round("J",9) AS "J" FROM curve ORDER BY "J" DESC, curve.k LIMIT 1""")
def srt_topk_j(spark, sf):
    return rounded(V.best_threshold(V.detection_curve(scores(spark, sf))).select("k", "FRR", "TRR", "J"), 9, k=6)


EPS_CURVE_SQL = f"""WITH {V_SCORED}, {sql_grid("grid", -20.0, 0.0, 100)}, {sql_eps_k("ks", "grid", -10.0, 100.0)}, {sql_confusion("counts", "ks")},
  curve AS (SELECT round(log10_eps,6) AS e_log, k, {SQL_RATES} FROM ks JOIN counts USING (grid_id))"""


@query("crv_eps_frr", EPS_CURVE_SQL + """ SELECT e_log, round(k,6) AS k, round("FRR",9) AS "FRR", round("TRR",9) AS "TRR", round("FAR",9) AS "FAR", round("J",9) AS "J" FROM curve""")
def crv_eps_frr(spark, sf):
    return rounded(V.eps_curve(scores(spark, sf)), 9, e_log=6, k=6)


BENCH_SQL = f"""WITH {V_SCORED}, {V_BENCH}, {V_BENCH_LL}, {sql_grid("grid", -50.0, 50.0, 501)}, {sql_eps_k("ks", "grid", -100.0, 100.0)},
  jb AS (SELECT b.idx, b.subject, b.correct, (l.ll2_model-l.ll2_generator)/l.n_token_response AS rn FROM bench b JOIN v_bench_ll l ON b.idx=l.idx)"""


def _bench_ks(spark, sf):
    rows = scores(spark, sf).where("ood = 1")
    return k_from_eps(rows, sequence_grid(spark, 501, -50.0, 50.0, "log10_eps"), -100.0, 100.0).select("log10_eps", "k")


@query("crv_certified_benchmark", BENCH_SQL + """ SELECT round(log10_eps,6) AS log10_eps, round(k,6) AS k, round(avg(CASE WHEN rn>k THEN 1.0 ELSE 0.0 END),9) AS "FRR",
  round(avg(CASE WHEN correct=1 AND NOT rn>k THEN 1.0 ELSE 0.0 END),9) AS accuracy FROM ks CROSS JOIN jb GROUP BY log10_eps, k""")
def crv_certified_benchmark(spark, sf):
    rows = bench(spark, sf).join(bench_ll(spark, sf), "idx")
    return rounded(V.certified_benchmark(rows, _bench_ks(spark, sf)), 9, log10_eps=6, k=6)


@query("crv_certified_benchmark_category", BENCH_SQL + """, acc AS (SELECT log10_eps, subject, avg(CASE WHEN correct=1 AND NOT rn>k THEN 1.0 ELSE 0.0 END) AS a FROM ks CROSS JOIN jb GROUP BY log10_eps, subject)
  SELECT round(log10_eps,6) AS log10_eps, """ + ", ".join(f"round(max(a) FILTER (subject={i}),9) AS \"bench_{i}\"" for i in range(7)) + " FROM acc GROUP BY log10_eps")
def crv_certified_benchmark_category(spark, sf):
    rows = bench(spark, sf).join(bench_ll(spark, sf), "idx")
    ks = _bench_ks(spark, sf)
    overall = V.certified_benchmark(rows, ks)
    per = V.certified_benchmark(rows, ks, by_category=True)
    wide = V.wide_benchmark(overall, per, "bench", list(range(7)))
    return rounded(wide.drop("k", "FRR", "bench"), 9, log10_eps=6)


@query("crv_benchmark_table", BENCH_SQL + f""", crossed AS (SELECT grid_id, {sql_cr()} AS cr FROM ks CROSS JOIN (SELECT * FROM v_scored WHERE ood=1) r),
  pct AS (SELECT grid_id, {SQL_PCTS} FROM crossed GROUP BY grid_id),
  acc AS (SELECT grid_id, avg(CASE WHEN rn>k THEN 1.0 ELSE 0.0 END) AS frr, avg(CASE WHEN correct=1 AND NOT rn>k THEN 1.0 ELSE 0.0 END) AS a FROM ks CROSS JOIN jb GROUP BY grid_id),
  per AS (SELECT grid_id, subject, avg(CASE WHEN correct=1 AND NOT rn>k THEN 1.0 ELSE 0.0 END) AS a FROM ks CROSS JOIN jb GROUP BY grid_id, subject),
  wide AS (SELECT grid_id, """ + ", ".join(f"round(max(a) FILTER (subject={i}),9) AS \"bench_{i}\"" for i in range(7)) + """ FROM per GROUP BY grid_id)
  SELECT round(log10_eps,6) AS log10_eps, round(k,6) AS k, log10_cr_10, log10_cr_median, log10_cr_90, round(frr,9) AS "FRR", round(a,9) AS bench, """
  + ", ".join(f'"bench_{i}"' for i in range(7)) + " FROM ks JOIN pct USING (grid_id) JOIN acc USING (grid_id) JOIN wide USING (grid_id)")
def crv_benchmark_table(spark, sf):
    """Epsilon, threshold, constriction percentiles, rejection rate and accuracy, overall and per category, in one table."""
    table_ks = C.eps_table(scores(spark, sf).where("ood = 1")).select("log10_eps", F.col("k_mid").alias("k"), *C.PERCENTILES.values())
    rows = bench(spark, sf).join(bench_ll(spark, sf), "idx")
    out = V.benchmark_table(rows, table_ks, "bench", list(range(7)))
    return rounded(out, 9, log10_eps=6, k=6, **{c: 6 for c in C.PERCENTILES.values()})


@query("jdg_decide", """WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
  w AS (SELECT *, (0.2 + 1.0*a - 0.5*b + 0.1*c) AS x, (-0.1 + 0.3*a + 0.9*b - 0.2*c) AS y, (0.0 - 0.4*a + 0.2*b + 1.1*c) AS z FROM s)
  SELECT vec_id, CASE WHEN a>=b AND a>=c THEN 'IN' WHEN b>=c THEN 'OUT' ELSE 'INVALID' END AS by_max,
  CASE WHEN x>=y AND x>=z THEN 'IN' WHEN y>=z THEN 'OUT' ELSE 'INVALID' END AS by_layer FROM w""")
def jdg_decide(spark, sf):
    three = {n: F.element_at("embedding", i + 1).cast("double") for i, n in enumerate(["IN", "OUT", "INVALID"])}
    layer = G.judge_decision(three, "regression", [[1.0, -0.5, 0.1], [0.3, 0.9, -0.2], [-0.4, 0.2, 1.1]], [0.2, -0.1, 0.0])
    return table(spark, sf, "embeddings").select("vec_id", G.judge_decision(three).alias("by_max"), layer.alias("by_layer"))


@query("agg_abstention", f"""WITH {V_GATE} SELECT round(avg(CASE WHEN abstained THEN 1.0 ELSE 0.0 END),9) AS mean_abstained, round(avg(num_samples),9) AS mean_num_samples,
  round(avg(num_samples) FILTER (NOT abstained),9) AS mean_num_samples_not_abstained FROM gate""")
def agg_abstention(spark, sf):
    return rounded(G.gate_report(G.run_gate(draws(spark, sf), GATE_K, GATE_T)), 9)


@query("gate_batch_report", f"""WITH {V_GATE}, {V_JUDGE}, g AS (SELECT gate.*, j.decision FROM gate JOIN v_judge j ON request_id = j.doc_id)
  SELECT round(avg(CASE WHEN abstained THEN 1.0 ELSE 0.0 END),9) AS mean_abstained, round(avg(num_samples),9) AS mean_num_samples,
  round(avg(num_samples) FILTER (NOT abstained),9) AS mean_num_samples_not_abstained,
  """ + ", ".join(f"round(avg(CASE WHEN decision='{d}' THEN 1.0 ELSE 0.0 END),9) AS \"prop_judge_{d}\"" for d in ("IN", "OUT", "INVALID")) + ", "
  + ", ".join(f"round(avg(CASE WHEN {'' if a == 'True' else 'NOT '}abstained AND decision='{d}' THEN 1.0 ELSE 0.0 END),9) AS \"conf_matrix_abstained={a}-decision={d}\""
              for a in ("True", "False") for d in ("IN", "OUT", "INVALID")) + " FROM g")
def gate_batch_report(spark, sf):
    decisions = G.run_gate(draws(spark, sf), GATE_K, GATE_T)
    both = decisions.join(judged(spark, sf).select(F.col("doc_id").alias("request_id"), "decision"), "request_id")
    return rounded(G.gate_report(both, judged=True), 9)


@query("stm_gate", f"""WITH {V_SCORED} SELECT dataset, count(*) AS n, CAST(sum(CASE WHEN log2_ratio <= CAST(2 AS DOUBLE)*n_token_response THEN 0 ELSE 1 END) AS BIGINT) AS n_abstained,
  round(avg(CASE WHEN log2_ratio <= CAST(2 AS DOUBLE)*n_token_response THEN 0.0 ELSE 1.0 END),9) AS share_abstained FROM v_scored GROUP BY dataset""")
def stm_gate(spark, sf):
    from .base import _SCORE_COLUMNS

    stored = table(spark, sf, "lineitem")
    # The table may be one file or a folder of files; a stream reads a folder.
    parts = stored.inputFiles()
    alone = len(parts) == 1 and parts[0].rstrip("/").endswith("/lineitem.parquet")
    arriving = ST.scored_stream(spark, sf if alone else f"{sf}/lineitem.parquet", stored.schema, "lineitem.parquet" if alone else None)
    arriving = arriving.selectExpr(*_SCORE_COLUMNS)
    decided = ST.gate_stream(arriving.withColumnRenamed("n_token_response", "n_token"), 2.0)
    return rounded(ST.drain(ST.abstention_by(decided), "stm_gate_totals"), 9)


def certified_corpus(spark, sf):
    """Documents to constriction table: fit, score, choose k by false-rejection rate, summarise."""
    fit = P.fit_models(wide_table(spark, sf, "documents"))
    scored_docs = cut_lineage(P.corpus_scores(fit))
    return C.constriction_by_frr(scored_docs, distributions=None)
