"""Filters, samples, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiocert.functions import sequences as Q
from ratiocert.operators import filters as L
from ratiocert.operators import merges as M
from ratiocert.operators.quality import scoring_record_rules, violations

from .base import (V_BENCH, V_BENCH_LL, V_ITEMS, V_JUDGE, V_PAIR_TOKENS, V_PAIRS, V_SCORED, V_SCORES, bench, bench_ll, items,
                   joined, judged, pair_tokens, pairs, query, scores, table)
from .certificates import sql_eps_k, sql_grid
from ratiocert.operators.ordering import sequence_grid
from ratiocert.operators.thresholds import rejected_counts
from ratiocert.plans import certificates as C
from ratiocert.plans.thresholds import k_from_eps



def _sql_list(names):
    return ", ".join(f"'{n}'" for n in names)


# Parts stand in for articles (every other one under a medical title, the rest under their own type) and for questions of
# all subjects in turn.
SQL_PARTS = f"""t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN list_extract([{_sql_list(L.MEDICAL_TITLES)}], p_partkey % {len(L.MEDICAL_TITLES)} + 1) ELSE p_type END AS title,
  list_extract([{_sql_list(L.SUBJECTS)}], p_partkey % {len(L.SUBJECTS)} + 1) AS subject FROM part)"""


def _categorised(spark, sf):
    def turn(names):
        return F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))

    title = F.when(F.col("p_partkey") % 2 == 0, turn(L.MEDICAL_TITLES)).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", title.alias("title"), turn(L.SUBJECTS).alias("subject"))


@query("flt_category", f"WITH {SQL_PARTS} " + " UNION ALL ".join(
    f"SELECT p_partkey, {c} AS category, '{side}' AS side FROM t WHERE {c} {op} ({_sql_list(members)})"
    for c, members in (("title", L.MEDICAL_TITLES), ("subject", L.MEDICAL_SUBJECTS)) for side, op in (("in", "IN"), ("out", "NOT IN"))))
def flt_category(spark, sf):
    t = _categorised(spark, sf)
    parts = [
        L.in_category(t.select("p_partkey", F.col(c).alias("category")), "category", mode, members).withColumn("side", F.lit(side))
        for c, members in (("title", L.MEDICAL_TITLES), ("subject", L.MEDICAL_SUBJECTS))
        for side, mode in (("in", "medical_qa"), ("out", "not_medical_qa"))
    ]
    return M.stacked(parts)


@query("flt_min_response", f"WITH {V_SCORES} SELECT l_orderkey, l_linenumber, n_token_response FROM v_scores WHERE n_token_response > 10")
def flt_min_response(spark, sf):
    kept = L.longer_than(scores(spark, sf).select("l_orderkey", "l_linenumber", "n_token_response"), "n_token_response", 10)
    return L.required(kept, "no response is longer than 10 tokens")


@query("flt_len_range", f"WITH {V_SCORES} SELECT l_orderkey, l_linenumber, n_token_response FROM v_scores WHERE n_token_response >= 10 AND n_token_response <= 40")
def flt_len_range(spark, sf):
    return L.length_between(scores(spark, sf).select("l_orderkey", "l_linenumber", "n_token_response"), "n_token_response", 10, 40)


@query("flt_drop_top_n", f"""WITH s AS (SELECT o_orderkey, -o_totalprice AS ll2_generator FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY ll2_generator DESC, o_orderkey) AS rn FROM s)
  SELECT o_orderkey, ll2_generator FROM r WHERE rn > 100""")
def flt_drop_top_n(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("ll2_generator"))
    return L.drop_top(rows, 100, "ll2_generator", ["o_orderkey"])


SQL_PREFIX = "substring({a}, 1, least(length({a}), length({b}))) = substring({b}, 1, least(length({a}), length({b})))"
# Stored prompts: longer than the question, and overwritten for every third turn pair.
SQL_STORED = "CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('Other: ', prompt) ELSE concat('Question: ', prompt, ' tail') END"


def _stored():
    return F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("Other: "), "prompt")).otherwise(
        F.concat(F.lit("Question: "), "prompt", F.lit(" tail")))


@query("flt_prompt_prefix", f"""WITH {V_PAIRS}, s AS (SELECT conv_id, turn, concat('Question: ', prompt) AS expected, {SQL_STORED} AS stored FROM v_pairs)
  SELECT conv_id, turn, stored FROM s WHERE {SQL_PREFIX.format(a="expected", b="stored")}""")
def flt_prompt_prefix(spark, sf):
    p = pairs(spark, sf).withColumn("stored", _stored())
    return L.matching_prompt(p, F.concat(F.lit("Question: "), "prompt"), F.col("stored")).select("conv_id", "turn", "stored")


@query("flt_judge_keep", f"WITH {V_JUDGE} SELECT doc_id, abstained, decision FROM v_judge WHERE decision='OUT'")
def flt_judge_keep(spark, sf):
    return L.judged(judged(spark, sf), "decision", "OUT")


@query("flt_strip_special", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, array_to_string(list_filter(list_concat(['<s>'], rt, ['</s>']), lambda x: x NOT IN ('<s>', '</s>')), ' ') AS kept FROM v_pair_tokens""")
def flt_strip_special(spark, sf):
    specials = F.array(F.lit(Q.BOS), F.lit(Q.EOS))
    tokens = F.concat(F.array(F.lit(Q.BOS)), "rt", F.array(F.lit(Q.EOS)))
    return pair_tokens(spark, sf).select("conv_id", "turn", joined(Q.strip_special(tokens, specials)).alias("kept"))


@query("smp_shuffle_split", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('23633|', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS position FROM orders)
  SELECT o_orderkey, position, CASE WHEN position < 1000 THEN 'train' ELSE 'val' END AS split FROM k""")
def smp_shuffle_split(spark, sf):
    return L.shuffled_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, 23633)


@query("smp_shuffle_positions", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('23633|', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS position FROM orders)
  SELECT o_orderkey, position, CASE WHEN position < 1000 THEN 'train' ELSE 'val' END AS split FROM k""")
def smp_shuffle_positions(spark, sf):
    return L.shuffled_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, 23633)


@query("smp_split_two_sources", """WITH k AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5(concat('23633|', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS position FROM orders)
  SELECT id, CASE WHEN position < 1000 THEN 'train' ELSE 'val' END AS split FROM k UNION ALL SELECT c_custkey, 'test' FROM customer""")
def smp_split_two_sources(spark, sf):
    """Training and validation rows of one source, test rows of another."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return L.seeded_split(orders, "id", 1000, 23633, test=table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))).select("id", "split")


@query("smp_first_n", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 256")
def smp_first_n(spark, sf):
    return L.first_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], 256)


@query("smp_random_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('7|', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 50")
def smp_random_n(spark, sf):
    return L.random_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50, 7)


@query("dq_scoring_record", f"""WITH {V_ITEMS}, r AS (SELECT *, string_split(question, ' ') AS ids, CAST(p.p_size AS BIGINT) AS sz FROM v_items JOIN part p ON p.p_partkey = idx)
  SELECT 'missing_field' AS rule, count(*) FILTER (question IS NULL OR subject IS NULL OR choices IS NULL) AS violations FROM r
  UNION ALL SELECT 'unequal_lengths', count(*) FILTER (len(ids) <> len(ids) - CASE WHEN sz > 40 THEN 1 ELSE 0 END) FROM r
  UNION ALL SELECT 'wrong_length', count(*) FILTER (len(ids) <> 2) FROM r
  UNION ALL SELECT 'few_choices', count(*) FILTER (len(choices[1:sz]) < 2) FROM r
  UNION ALL SELECT 'null_choice', count(*) FILTER (len(list_filter(choices[1:sz], lambda x: x IS NULL)) > 0) FROM r
  UNION ALL SELECT 'answer_out_of_range', count(*) FILTER (answer < 0 OR answer >= len(choices[1:sz])) FROM r""")
def dq_scoring_record(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").alias("sz"))
    ids = F.split("question", " ")
    records = items(spark, sf).join(sizes, "idx").select(
        "question", "subject", F.slice("choices", F.lit(1), F.col("sz")).alias("choices"), ids.alias("input_ids"), ids.alias("labels"),
        F.slice(ids, F.lit(1), F.size(ids) - F.when(F.col("sz") > 40, 1).otherwise(0)).alias("attention_mask"),
        F.lit(2).alias("length"), F.col("answer").alias("correct_answer_id"))
    return violations(records, scoring_record_rules())


@query("join_generated", f"""WITH {V_PAIRS}, base AS (SELECT conv_id, turn, concat('Question: ', prompt) AS q FROM v_pairs),
  gen AS (SELECT conv_id, turn, {SQL_STORED} AS stored, concat('gen: ', response) AS generated_text, CASE WHEN turn % 4 = 0 THEN 'IN' ELSE 'OUT' END AS decision FROM v_pairs)
  SELECT b.conv_id, b.turn, g.generated_text AS answer FROM base b JOIN gen g ON b.conv_id=g.conv_id AND b.turn=g.turn
  WHERE {SQL_PREFIX.format(a="q", b="stored")} AND decision='IN'""")
def join_generated(spark, sf):
    p = pairs(spark, sf).withColumn("idx", F.struct("conv_id", "turn"))
    base = p.select("idx", F.col("prompt").alias("question"), F.col("response").alias("answer"))
    decision = F.when(F.col("turn") % 4 == 0, "IN").otherwise("OUT")
    generated = p.select("idx", _stored().alias("prompt_text"), F.concat(F.lit("gen: "), "response").alias("generated_text"), decision.alias("decision"))
    return M.with_generated(base, generated, "idx", keep_decision="IN").select("idx.conv_id", "idx.turn", "answer")


@query("join_response_len", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, prompt, CAST(len(rt)+1 AS BIGINT) AS n_token_response FROM v_pair_tokens""")
def join_response_len(spark, sf):
    key = F.struct("conv_id", "turn").alias("id")
    lengths = pair_tokens(spark, sf).select(key, (F.size("rt") + 1).cast("long").alias("n_token_response"))
    base = pairs(spark, sf).select(key, "prompt")
    return M.with_response_length(base, lengths, "id").select("id.conv_id", "id.turn", "prompt", "n_token_response")


@query("join_benchmark_scores", f"WITH {V_BENCH}, {V_BENCH_LL} SELECT b.idx, b.subject, b.correct, l.n_token_response, l.ll2_model, l.ll2_generator FROM bench b JOIN v_bench_ll l ON b.idx=l.idx")
def join_benchmark_scores(spark, sf):
    return M.benchmark_with_scores(bench(spark, sf), bench_ll(spark, sf)).select("idx", "subject", "correct", "n_token_response", "ll2_model", "ll2_generator")


@query("join_eps_k", f"""WITH {V_SCORED}, {sql_grid("grid", -20.0, 2.0, 23)}, {sql_eps_k("ks", "grid", -100.0, 100.0)}
  SELECT o_orderkey, round(ks.log10_eps,6) AS log10_eps, round(k,6) AS k FROM orders JOIN ks ON o_orderkey % 23 = ks.grid_id""")
def join_eps_k(spark, sf):
    ks = k_from_eps(scores(spark, sf).where("ood = 1"), sequence_grid(spark, 23, -20.0, 2.0, "log10_eps"), -100.0, 100.0)
    asked = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 23).cast("int").alias("grid_id"))
    found = M.with_threshold(asked, ks)
    return found.select("o_orderkey", F.round("log10_eps", 6).alias("log10_eps"), F.round("k", 6).alias("k"))


@query("cross_threshold", f"""WITH {V_SCORED}, grid AS (SELECT CAST(i AS DOUBLE)/2 AS k FROM range(8) t(i))
  SELECT k, dataset, count(*) FILTER (log2_ratio_norm > k) AS rejected, count(*) AS n FROM v_scored CROSS JOIN grid GROUP BY k, dataset""")
def cross_threshold(spark, sf):
    grid = spark.range(0, 8, 1, 1).select((F.col("id").cast("double") / 2).alias("k"))
    return rejected_counts(C.scored(scores(spark, sf)), grid, "k", "log2_ratio_norm", ["dataset"])


@query("cross_param_grid", """WITH t AS (SELECT DISTINCT r_regionkey AS "T" FROM region), e AS (SELECT DISTINCT n_nationkey AS e FROM nation)
  SELECT CAST("T" AS INT) AS "T", CAST(e AS INT) AS e FROM t CROSS JOIN e""")
def cross_param_grid(spark, sf):
    t = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("T")).distinct()
    e = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("e")).distinct()
    return M.parameter_grid(t, e)


@query("set_difference", """SELECT DISTINCT lang, source FROM documents WHERE (lang, source) NOT IN (SELECT lang, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1 AND lang IS NOT NULL AND source IS NOT NULL)""")
def set_difference(spark, sf):
    """Pairs of language and source without a toxic document."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    toxic = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("lang", "source").distinct()
    return M.not_in(docs.select("lang", "source").distinct(), toxic, ["lang", "source"])


@query("set_difference_subjects", f"WITH {SQL_PARTS} SELECT DISTINCT subject FROM t WHERE subject NOT IN ({_sql_list(L.MEDICAL_SUBJECTS)})")
def set_difference_subjects(spark, sf):
    medical = spark.createDataFrame([(x,) for x in L.MEDICAL_SUBJECTS], "subject string")
    return M.not_in(_categorised(spark, sf).select("subject").distinct(), F.broadcast(medical), ["subject"])


@query("set_distinct_pairs", "SELECT DISTINCT lang, source FROM documents")
def set_distinct_pairs(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("set_dedup_texts", "SELECT min(doc_id) AS doc_id, n_chars, count(*) AS copies FROM documents GROUP BY text, n_chars")
def set_dedup_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    return M.without_copies(docs, "doc_id", ["digest", "n_chars"]).drop("digest")


@query("set_union_runs", """WITH u AS (SELECT 0 AS part, doc_id AS id, n_chars AS n FROM documents UNION ALL SELECT 1, page_id, length(html) FROM pages)
  SELECT CAST(part AS INT) AS part, id, CAST(n AS BIGINT) AS n FROM u""")
def set_union_runs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"))
    return M.shuffled_collection([docs, pages], "id", 11)


@query("set_union_shuffled", """WITH u AS (SELECT 0 AS part, doc_id AS id FROM documents UNION ALL SELECT 1, page_id FROM pages)
  SELECT CAST(part AS INT) AS part, id FROM u ORDER BY md5(concat('11|', CAST(part AS VARCHAR), '|', CAST(id AS VARCHAR))), part, id LIMIT 200""")
def set_union_shuffled(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"))
    return M.shuffled_collection([docs, pages], "id", 11, 200).select("part", "id")
