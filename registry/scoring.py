"""Token scores, tokenisation, n-gram models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiocert.functions import logits as G
from ratiocert.functions import sequences as Q
from ratiocert.operators import aggregates as A
from ratiocert.operators import ngrams as N
from ratiocert.operators import subwords as W
from ratiocert.plans import corpus as P

from .base import SQL_WORDS, V_BENCH, V_LOGITS, V_TOKENS, bench, logits, query, table, token_scores, wide_table
from .certificates import certified_corpus, rounded

LSE = "(list_max({l}) + ln(list_sum(list_transform({l}, lambda x: exp(x - list_max({l}))))))"


@query("scr_temperature", f"WITH {V_LOGITS} SELECT vec_id, round(list_sum(list_transform(l, lambda x: x/2.0)),6) AS total, round(list_max(l)/2.0,9) AS top FROM v_logits")
def scr_temperature(spark, sf):
    cooled = G.temperature(F.col("l"), 2.0)
    total = F.aggregate(cooled, F.lit(0.0), lambda a, x: a + x)
    return logits(spark, sf).select("vec_id", F.round(total, 6).alias("total"), F.round(F.array_max(cooled), 9).alias("top"))


TOP = "list_sort(l, 'DESC')[1:10]"


@query("scr_topk_mask", f"""WITH {V_LOGITS} SELECT vec_id, CASE WHEN l[token+1] >= list_min({TOP}) THEN round(l[token+1] - {LSE.format(l=TOP)}, 6) ELSE -999.0 END AS ll, round(list_min({TOP}),9) AS threshold FROM v_logits""".replace("-999.0", "CAST(-999 AS DOUBLE)"))
def scr_topk_mask(spark, sf):
    ll = G.token_loglik(F.col("l"), F.col("token"), 10)
    shown = F.when(ll == F.lit(float("-inf")), F.lit(-999.0)).otherwise(F.round(ll, 6))
    return logits(spark, sf).select("vec_id", shown.alias("ll"), F.round(F.array_min(G.top_k_values(F.col("l"), 10)), 9).alias("threshold"))


@query("scr_token_loglik", f"WITH {V_LOGITS} SELECT seq, pos, round(l[token+1] - {LSE.format(l='l')},6) AS ll FROM v_logits")
def scr_token_loglik(spark, sf):
    return logits(spark, sf).select("seq", "pos", F.round(G.token_loglik(F.col("l"), F.col("token")), 6).alias("ll"))


@query("scr_mask", f"WITH {V_LOGITS} SELECT seq, pos, CASE WHEN token IN (0, 9) THEN 0.0 ELSE round(l[token+1] - {LSE.format(l='l')},6) END AS ll FROM v_logits")
def scr_mask(spark, sf):
    ll = G.masked(G.token_loglik(F.col("l"), F.col("token")), F.col("token"), pad=0, eos=9)
    return logits(spark, sf).select("seq", "pos", F.round(ll, 6).alias("ll"))


@query("scr_entropy", f"""WITH {V_LOGITS}, p AS (SELECT seq, pos, list_transform(l, lambda x: x - {LSE.format(l='l').replace('lambda x: exp(x', 'lambda y: exp(y')}) AS lp FROM v_logits)
  SELECT seq, pos, round(-list_sum(list_transform(lp, lambda x: x*exp(x))),6) AS entropy FROM p""")
def scr_entropy(spark, sf):
    return logits(spark, sf).select("seq", "pos", F.round(G.entropy(F.col("l")), 6).alias("entropy"))


@query("scr_ll_consistency", f"""WITH {V_TOKENS}, a AS (SELECT vec_id, list_sum(ll_f) AS ll FROM v_tokens), b AS (SELECT vec_id, list_sum(list_transform(ll_g, lambda x: x/1.5)) AS ll FROM v_tokens)
  SELECT count(*) AS n, CAST(sum(CASE WHEN abs(a.ll-b.ll) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_different, round(max(abs(a.ll-b.ll)),6) AS largest FROM a JOIN b ON a.vec_id=b.vec_id""")
def scr_ll_consistency(spark, sf):
    t = token_scores(spark, sf)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    recorded = t.select("vec_id", total(F.col("ll_f")).alias("ll"))
    again = t.select("vec_id", total(F.transform("ll_g", lambda x: x / 1.5)).alias("ll"))
    return A.consistency(recorded, again, "vec_id", "ll").withColumn("largest", F.round("largest", 6))


@query("scr_choice_argmax", f"WITH {V_BENCH} SELECT idx, subject, answer_id, correct_answer_id, correct FROM bench")
def scr_choice_argmax(spark, sf):
    return bench(spark, sf).select("idx", "subject", "answer_id", "correct_answer_id", "correct")


@query("tok_words", f"WITH d AS (SELECT doc_id, {SQL_WORDS.format('text')} AS t FROM documents), w AS (SELECT unnest(t) AS tok FROM d) SELECT tok, count(*) AS n FROM w GROUP BY tok")
def tok_words(spark, sf):
    words = wide_table(spark, sf, "documents").select(F.explode(Q.words(F.col("text"))).alias("tok"))
    return words.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@query("tok_words_and_marks", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)') AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n, t[1] AS first, t[len(t)] AS last FROM w""")
def tok_words_and_marks(spark, sf):
    t = Q.words_and_marks(F.col("text"))
    return wide_table(spark, sf, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"))


def _pieces():
    """Words and runs of marks of the lower-cased text, digits among them."""
    return Q.words_and_marks(F.lower("text"))


def _symbols(spark, sf):
    return W.as_symbols(W.word_counts(wide_table(spark, sf, "documents"), _pieces()))


@query("tok_bpe_pairs", rf"""WITH d AS (SELECT regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+)') AS t FROM documents), w AS (SELECT unnest(t) AS word FROM d), f AS (SELECT word, count(*) AS freq FROM w GROUP BY word),
  p AS (SELECT freq, word, unnest(range(1, length(word))) AS i FROM f) SELECT substring(word, i, 1) AS "left", substring(word, i+1, 1) AS "right", CAST(sum(freq) AS BIGINT) AS freq FROM p GROUP BY 1, 2""")
def tok_bpe_pairs(spark, sf):
    return W.pair_counts(_symbols(spark, sf))


@query("tok_bpe_train")
def tok_bpe_train(spark, sf):
    return W.learn_merges(wide_table(spark, sf, "documents"), _pieces(), vocabulary=400)


# --- n-gram models ---------------------------------------------------------------------------------

SQL_CORPUS = f"""keep AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
  texts AS (SELECT doc_id, lang, {SQL_WORDS.format('text')} AS words, (instr('0123456789abcdef', substring(md5(concat('23633|', text)), 1, 1)) - 1) % 2 AS half
    FROM documents WHERE doc_id IN (SELECT doc_id FROM keep)),
  train AS (SELECT * FROM texts WHERE half = 0),
  occ AS (SELECT lang, unnest(words) AS tok, generate_subscripts(words, 1) AS i, len(words) AS n FROM train),
  raw AS (SELECT tok, count(*) AS n, count(*) FILTER (lang='en') AS n_in, count(*) FILTER (i < n) AS n_context FROM occ GROUP BY tok),
  uni0 AS (SELECT CASE WHEN n >= 3 THEN tok ELSE '<unk>' END AS tok, n, n_in, n_context FROM raw UNION ALL SELECT '<unk>', 0, 0, 0),
  uni1 AS (SELECT tok, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_in) AS BIGINT) AS n_in, CAST(sum(n_context) AS BIGINT) AS n_context FROM uni0 GROUP BY tok),
  sums AS (SELECT CAST(sum(n) AS BIGINT) AS sn, CAST(sum(n_in) AS BIGINT) AS si, count(*) AS v FROM uni1),
  uni AS (SELECT tok, n, n_context, (n_in + 0.5)/(si + 0.5*v) AS pg, (n + 0.5)/(sn + 0.5*v) AS pf FROM uni1 CROSS JOIN sums)"""
SQL_BI = """known AS (SELECT tok FROM uni WHERE tok <> '<unk>'),
  tw AS (SELECT t.doc_id, t.i, coalesce(k.tok, '<unk>') AS tok FROM (SELECT doc_id, unnest(words) AS tok, generate_subscripts(words, 1) AS i FROM train) t LEFT JOIN known k ON k.tok = t.tok),
  bi AS (SELECT a.tok AS prev, b.tok AS tok, count(*) AS c FROM tw a JOIN tw b ON a.doc_id = b.doc_id AND b.i = a.i + 1 GROUP BY 1, 2)"""


@query("lm_fit_unigram", f"WITH {SQL_CORPUS} SELECT tok, n, n_context, round(ln(pg),6) AS ln_g, round(ln(pf),6) AS ln_f FROM uni")
def lm_fit_unigram(spark, sf):
    texts = P.prepared(wide_table(spark, sf, "documents")).where("half = 0")
    uni = N.unigram_table(N.pair_table(texts, "words", F.col("lang") == "en"))
    return uni.select("tok", "n", "n_context", F.round(F.log("p_generator"), 6).alias("ln_g"), F.round(F.log("p_model"), 6).alias("ln_f"))


@query("lm_fit_bigram", f"WITH {SQL_CORPUS}, {SQL_BI} SELECT prev, tok, c FROM bi")
def lm_fit_bigram(spark, sf):
    return P.fit_models(wide_table(spark, sf, "documents")).bigrams.select("prev", "tok", "c")


def _score_sql(scope: str, digits: int = 4) -> str:
    if scope == "y|x":
        seq, first, context = "words", 9, "CASE WHEN i > 1 THEN w[i-1] ELSE '<s>' END"
    elif scope == "y":
        seq, first, context = "words", 9, "CASE WHEN i > 9 THEN w[i-1] ELSE '<s>' END"
    else:
        seq, first, context = "words", 1, "CASE WHEN i > 1 THEN w[i-1] ELSE '<s>' END"
    return f"""WITH {SQL_CORPUS}, {SQL_BI},
  held AS (SELECT doc_id, lang, {seq} AS w, unnest(range({first}, len(words)+1)) AS i FROM texts WHERE half = 1 AND len(words) >= 18),
  pos AS (SELECT doc_id, lang, w[i] AS tok, {context} AS prev FROM held),
  mapped AS (SELECT p.doc_id, p.lang, coalesce(k.tok, '<unk>') AS tok, CASE WHEN p.prev = '<s>' THEN '<s>' ELSE coalesce(k2.tok, '<unk>') END AS prev
    FROM pos p LEFT JOIN known k ON k.tok = p.tok LEFT JOIN known k2 ON k2.tok = p.prev),
  s AS (SELECT m.doc_id, m.lang, ln(u.pg) AS lg, ln(CASE WHEN coalesce(c.n_context, 0) > 0 THEN 0.6*coalesce(b.c, 0)/CAST(c.n_context AS DOUBLE) + CAST({1.0 - 0.6!r} AS DOUBLE)*u.pf ELSE u.pf END) AS lf
    FROM mapped m JOIN uni u ON u.tok = m.tok LEFT JOIN uni c ON c.tok = m.prev LEFT JOIN bi b ON b.prev = m.prev AND b.tok = m.tok)
  SELECT doc_id AS sample_id, lang AS dataset, '{"F(%s)||G(%s)" % (scope, "x+y" if scope == "x+y" else "y")}' AS distributions,
    round(sum(lf)/{0.6931471805599453!r},{digits}) AS ll2_model, round(sum(lg)/{0.6931471805599453!r},{digits}) AS ll2_generator, count(*) AS n_token_response,
    CAST(CASE WHEN lang='en' THEN 0 ELSE 1 END AS INT) AS ood FROM s GROUP BY doc_id, lang"""


def _scored(spark, sf, scope):
    fit = P.fit_models(wide_table(spark, sf, "documents"))
    return rounded(P.corpus_scores(fit, scope=scope), 4)


@query("lm_score_corpus", _score_sql("y|x"))
def lm_score_corpus(spark, sf):
    return _scored(spark, sf, "y|x")


@query("lm_score_corpus_y", _score_sql("y"))
def lm_score_corpus_y(spark, sf):
    return _scored(spark, sf, "y")


@query("lm_score_corpus_xy", _score_sql("x+y"))
def lm_score_corpus_xy(spark, sf):
    return _scored(spark, sf, "x+y")


@query("certified_corpus", _score_sql("y|x", 10).replace("WITH keep", "WITH x AS (WITH keep", 1) + f"""), raw AS (SELECT *, (ll2_model-ll2_generator)/n_token_response AS rn FROM x),
  ks AS (""" + " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS \"FRR\", quantile_cont(rn, {1.0 - f!r}) AS k FROM raw WHERE ood=0" for f in (0.0, 0.01, 0.05, 0.1, 0.2, 0.25, 0.5)) + """),
  c AS (SELECT "FRR", k, (ll2_model - (ll2_generator + k*n_token_response))/3.321928094887362 AS cr FROM ks CROSS JOIN raw WHERE ood=1)
  SELECT "FRR", round(any_value(k),4) AS k, round(quantile_cont(cr,0.1),3) AS log10_cr_10, round(quantile_cont(cr,0.5),3) AS log10_cr_median, round(quantile_cont(cr,0.9),3) AS log10_cr_90 FROM c GROUP BY "FRR\"""")
def certified_corpus_table(spark, sf):
    return rounded(certified_corpus(spark, sf).drop("combined"), 3, k=4)
