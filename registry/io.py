"""Sources and sinks: every query writes rows of the driver tables, reads them back and summarises."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiocert.functions import sequences as Q
from ratiocert.plans import certificates as C
from ratiocert.plans import gate as G
from ratiocert.session import cut_lineage, scratch_path
from ratiocert.sources import cache, readers, writers

from .base import (GATE_K, GATE_T, SQL_WORDS, V_GATE, V_ITEMS, V_PAIRS, V_SCORED, V_SCORES, draws, items, pairs, query, scores, table, wide_table)
from .certificates import EPS_TABLE_SQL, SQL_KS, SQL_PCTS, rounded, sql_cr, sql_grid
from .tasks import SQL_BASE, SQL_TASK, _sequences


def _runs(spark, sf, label):
    path = scratch_path(spark, label)
    writers.write_scores(scores(spark, sf).withColumn("run_id", F.concat(F.lit("run"), (F.col("l_linenumber") % 4).cast("string"))), path)
    return path


SQL_RUNS = f"WITH {V_SCORES}, s AS (SELECT *, concat('run', CAST(l_linenumber % 4 AS VARCHAR)) AS run_id FROM v_scores)"


@query("src_scores", SQL_RUNS + " SELECT run_id, dataset, l_orderkey, l_linenumber, n_token_response, ood, ll2_model, ll2_generator FROM s")
def src_scores(spark, sf):
    runs = readers.score_runs(spark, _runs(spark, sf, "src-scores"))
    return runs.select("run_id", "dataset", "l_orderkey", "l_linenumber", "n_token_response", "ood", "ll2_model", "ll2_generator")


@query("snk_scores", SQL_RUNS + " SELECT l_orderkey, l_linenumber, ll2_model, run_id FROM s")
def snk_scores(spark, sf):
    """Each run is read from its own folder; all of them together are the table again."""
    path = _runs(spark, sf, "snk-scores")
    found, unread = readers.readable_runs(spark, [f"{path}/run_id=run{i}" for i in range(4)])
    lost = unread.limit(5).collect()
    if lost:
        raise OSError(f"unread files: {lost}")
    return found.withColumn("run_id", F.regexp_extract("folder", "run_id=([^/]*)$", 1)).select(
        "l_orderkey", "l_linenumber", "ll2_model", "run_id")


def _documents_of(rows, path, field, *columns):
    """JSON documents {field: [rows]}: one per conversation and 1000 turns, so none grows without bound."""
    packed = rows.groupBy("conv_id", F.floor(F.col("turn") / 1000).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(*columns).alias("r")))), lambda s: s["r"]).alias(field))
    packed.select(F.to_json(F.struct(F.create_map(F.lit("k"), F.lit("4")).alias("config"), field)).alias("value")).write.text(path)


@query("src_results_json", f"""WITH {V_PAIRS} SELECT CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, turn % 4 = 0 AS abstained, CAST(turn AS BIGINT) AS num_samples,
  prompt AS prompt_text, response AS generated_text, CASE WHEN turn % 4 = 0 THEN 'OUT' ELSE 'IN' END AS decision FROM v_pairs""")
def src_results_json(spark, sf):
    rows = pairs(spark, sf).select(
        "conv_id", "turn", (F.col("turn") % 4 == 0).alias("abstained"), F.col("turn").alias("num_samples"), F.col("prompt").alias("prompt_text"),
        F.col("response").alias("generated_text"), F.when(F.col("turn") % 4 == 0, "OUT").otherwise("IN").alias("decision"))
    path = scratch_path(spark, "results")
    _documents_of(rows, path, "results", "abstained", "num_samples", "prompt_text", "generated_text", "decision")
    return readers.gate_results(spark, path, multi_line=False).select("idx", "abstained", "num_samples", "prompt_text", "generated_text", "decision")


@query("src_prompt_response", f"WITH {V_PAIRS} SELECT CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, prompt, response FROM v_pairs")
def src_prompt_response(spark, sf):
    path = scratch_path(spark, "prompts")
    _documents_of(pairs(spark, sf), path, "data", "prompt", "response")
    return readers.prompt_responses(spark, path, multi_line=False)


@query("src_qa_declared", f"WITH {V_PAIRS} SELECT conv_id * 1000 + turn AS id, prompt AS question, CAST(len(string_split(response, '. ')) AS INT) AS n_contexts, response AS answer, concat('t', CAST(turn AS VARCHAR)) AS subject FROM v_pairs")
def src_qa_declared(spark, sf):
    path = scratch_path(spark, "qa")
    pairs(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("prompt").alias("question"), F.split("response", r"\. ").alias("contexts"),
        F.array("response").alias("answers"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("title")).write.json(path)
    corpus = readers.qa_corpus(spark, path, renames={"title": "subject"})
    return corpus.select("id", "question", F.size("contexts").alias("n_contexts"), F.element_at("answers", 1).alias("answer"), "subject")


SQL_DECISION = "CASE WHEN toxic = 1 THEN 'no' WHEN quality = 0 THEN 'maybe' ELSE 'yes' END"


@query("src_qa_corpus", f"""WITH {V_PAIRS}, {V_ITEMS}
  SELECT 'extract' AS shape, concat('c', CAST(conv_id * 1000 + turn AS VARCHAR)) AS id, concat('t', CAST(turn AS VARCHAR)) AS subject, prompt AS question, CAST(1 AS INT) AS n_contexts, prompt AS last_context,
    CAST(2 AS INT) AS n_answers, response AS answer, CAST(0 AS INT) AS n_choices, CAST(NULL AS VARCHAR) AS decision FROM v_pairs
  UNION ALL SELECT 'judged', CAST(d.doc_id AS VARCHAR), NULL, concat('Is this ', source, '?'), CAST(len(string_split(text, chr(10))) AS INT), string_split(text, chr(10))[-1], 1, lang, 0, {SQL_DECISION} FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'choices', NULL, subject, question, 0, NULL, 1, choices[answer + 1], 4, NULL FROM v_items""")
def src_qa_corpus(spark, sf):
    """Three corpora of differing schema, read as one."""
    path = scratch_path(spark, "qa-shapes")
    pairs(spark, sf).select(
        F.concat(F.lit("c"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).alias("id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("title"),
        F.col("prompt").alias("context"), F.col("prompt").alias("question"), F.struct(F.array("response", F.lit("other")).alias("text")).alias("answers"),
    ).write.json(f"{path}/extract")
    judged_docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    judged_docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Is this "), "source", F.lit("?")).alias("question"), F.struct(F.split("text", "\n", -1).alias("contexts")).alias("context"),
        F.col("lang").alias("long_answer"), F.when(F.col("toxic") == 1, "no").when(F.col("quality") == 0, "maybe").otherwise("yes").alias("final_decision"),
    ).write.json(f"{path}/judged")
    items(spark, sf).select(F.col("subject").alias("task"), "question", "choices", "answer").write.json(f"{path}/choices")
    corpus = readers.qa_documents(spark, [f"{path}/{s}" for s in readers.QA_SHAPES])
    return corpus.select(
        "shape", "id", "subject", "question", F.size("contexts").alias("n_contexts"), F.try_element_at("contexts", F.lit(-1)).alias("last_context"),
        F.size("answers").alias("n_answers"), F.element_at("answers", 1).alias("answer"), F.size("choices").alias("n_choices"), "decision")


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


@query("src_text_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT substring(regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', ''), 1, 60) AS line FROM l ORDER BY doc_id, i LIMIT 2000""")
def src_text_lines(spark, sf):
    path = scratch_path(spark, "lines")
    _lines(spark, sf).orderBy("doc_id", "i").select("line").write.text(path)
    return readers.text_lines(spark, path, 60, 2000)


@query("src_whole_text", "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM documents GROUP BY lang")
def src_whole_text(spark, sf):
    path = scratch_path(spark, "whole")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    files = readers.whole_texts(spark, path)
    text = F.col("text")
    return files.groupBy("lang").agg(
        F.sum(F.length(text)).alias("chars"), F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("n_lines"))


@query("src_category_list", "SELECT p_type AS category, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT p_type FROM part) t")
def src_category_list(spark, sf):
    folder = scratch_path(spark, "categories")
    table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").write.text(f"{folder}/categories.txt")
    return readers.category_list(spark, f"{folder}/run")


@query("src_tsv", f"SELECT \"T\", log10_eps, k_mid AS k, log10_cr_10, log10_cr_median, log10_cr_90 FROM ({EPS_TABLE_SQL.format(grid=sql_grid('grid', -50.0, 50.0, 11))}) t")
def src_tsv(spark, sf):
    """Written under the older column names, read under the present ones."""
    path = scratch_path(spark, "eps")
    t = C.eps_table(scores(spark, sf).where("ood = 1"), points=11)
    writers.write_tsv(t.withColumnsRenamed({"log10_cr_10": "cr_10", "log10_cr_median": "cr_median", "log10_cr_90": "cr_90"}), path)
    return rounded(readers.eps_table(spark, path).select("T", "log10_eps", "k", "log10_cr_10", "log10_cr_median", "log10_cr_90"))


@query("snk_tsv", f"WITH {V_SCORED} SELECT l_orderkey, l_linenumber, dataset, ood, n_token_response, ll2_generator, ll2_model, log2_ratio, log2_ratio_norm FROM v_scored")
def snk_tsv(spark, sf):
    path = scratch_path(spark, "frame")
    rows = C.scored(scores(spark, sf))
    writers.write_tsv(rows, path)
    return spark.read.schema(rows.schema).csv(path, sep="\t", header=True)


@query("snk_csv", f"""WITH {V_SCORED}, {SQL_KS}, crossed AS (SELECT "FRR", k, {sql_cr()} AS cr FROM ks CROSS JOIN (SELECT * FROM v_scored WHERE ood=1) r)
  SELECT "FRR", round(any_value(k),9) AS k, printf('%.0f / %.0f / %.0f', quantile_cont(cr, 0.1), quantile_cont(cr, 0.5), quantile_cont(cr, 0.9)) AS combined FROM crossed GROUP BY "FRR\"""")
def snk_csv(spark, sf):
    path = scratch_path(spark, "constriction")
    writers.write_csv(C.constriction_by_frr(scores(spark, sf)), ["FRR", "k", "combined"], path)
    return rounded(spark.read.schema("FRR double, k double, combined string").csv(path, header=True), k=9)


@query("snk_results_json", f"""WITH {V_GATE} SELECT request_id, abstained, num_samples, last_ratio, last_bound, log_prob_f, log_prob_g, round((SELECT avg(CASE WHEN abstained THEN 1.0 ELSE 0.0 END) FROM gate),9) AS mean_abstained,
  '{GATE_K}' AS k FROM gate""")
def snk_results_json(spark, sf):
    path = scratch_path(spark, "gate")
    decisions = cut_lineage(G.run_gate(draws(spark, sf), GATE_K, GATE_T))  # written and reported on
    writers.write_results(decisions, G.gate_report(decisions), {"k": GATE_K, "T": GATE_T}, path)
    metrics = spark.read.schema("mean_abstained double").json(f"{path}/metrics").select(F.round("mean_abstained", 9).alias("mean_abstained"))
    config = spark.read.schema("name string, value string").json(f"{path}/config").where("name = 'k'").select(F.col("value").alias("k"))
    back = spark.read.schema(decisions.schema).json(f"{path}/results")
    return back.select(
        "request_id", "abstained", "num_samples", F.element_at("log_ratios", -1).alias("last_ratio"), F.element_at("log_upper_bounds", -1).alias("last_bound"),
        "log_prob_f", "log_prob_g").crossJoin(F.broadcast(metrics)).crossJoin(F.broadcast(config))


def _split(spark, sf):
    s = _sequences(spark, sf, "sort")
    return s.withColumn("split", F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "val").otherwise("test"))


SQL_SPLIT = SQL_BASE + f", s AS (SELECT id, array_to_string(items, ' ') AS input, array_to_string({SQL_TASK['sort']}, ' ') AS answer, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM items)"


@query("snk_splits", SQL_SPLIT + " SELECT split, input, answer FROM s UNION ALL SELECT 'all', concat(input, ' ', answer), NULL FROM s")
def snk_splits(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(_split(spark, sf), path, "id")
    parts = spark.read.schema("input string, answer string, split string").json(f"{path}/splits").select("split", "input", "answer")
    lines = spark.read.text(f"{path}/all_text").select(F.lit("all").alias("split"), F.col("value").alias("input"), F.lit(None).cast("string").alias("answer"))
    return parts.unionByName(lines)


@query("snk_manifest", """SELECT CAST(n AS VARCHAR) AS part, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, md5(string_agg(concat(text, chr(10)), '' ORDER BY doc_id)) AS md5
  FROM (SELECT doc_id, doc_id % 4 AS n, text FROM documents) d GROUP BY n""")
def snk_manifest(spark, sf):
    """One file a part, its texts in id order: the digests are those of the files' bytes."""
    path = scratch_path(spark, "manifest")
    docs = table(spark, sf, "documents").select("text", "doc_id", (F.col("doc_id") % 4).alias("n"))
    docs.repartitionById(4, F.pmod("n", F.lit(4)).cast("int")).sortWithinPartitions("n", "doc_id").select("text", "n").write.partitionBy("n").text(path)
    found = writers.manifest(spark, path)
    return found.select(F.regexp_extract("path", "n=([0-9]+)/", 1).alias("part"), "bytes", "md5")


@query("cache_processed", f"SELECT doc_id, CAST(len({SQL_WORDS.format('text')}) AS BIGINT) AS n_words FROM documents")
def cache_processed(spark, sf):
    settings = {"source": sf, "rule": "words"}
    make = lambda: wide_table(spark, sf, "documents").select("doc_id", Q.words(F.col("text")).alias("words"))
    root = scratch_path(spark, "cache")
    cache.cached(spark, root, "documents", settings, make)
    again = cache.cached(spark, root, "documents", settings, make)
    return again.select("doc_id", F.size("words").cast("long").alias("n_words"))
