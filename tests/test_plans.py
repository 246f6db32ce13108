"""Physical plans: what must not leave the JVM, and what must be pushed down."""

import os

import re

import pytest
from pyspark.sql import functions as F

from ratiocert.operators.merges import worked_examples
from registry import QUERIES
from registry.base import items

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(spark, key):
    return QUERIES[key](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", ["prj_log_ratio", "crt_rejection_sampling", "crt_k_from_eps", "scr_token_loglik", "scr_entropy", "tsk_sort",
                                 "tok_words", "agg_ngram_overlap", "fmt_few_shot", "seq_view", "tsk_score"])
def test_stays_in_the_jvm(spark, key):
    text = plan(spark, key)
    assert "Python" not in text and "ArrowEval" not in text


def test_ranks_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "crt_rejection_sampling")
    examples = worked_examples(items(spark, SF), 5)
    assert "WindowGroupLimit" in examples._jdf.queryExecution().toString()


def test_reads_only_needed_columns(spark):
    text = plan(spark, "crt_upper_bound")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double>" in text


def test_scores_need_no_shuffle(spark):
    assert "Exchange" not in plan(spark, "prj_log_ratio")
    assert "Exchange" not in plan(spark, "crt_accept")


def test_pairs_join_on_both_keys(spark):
    assert "conv_id" in plan(spark, "fmt_prefix_qa") and "Window" not in plan(spark, "fmt_prefix_qa")


def test_text_is_read_once_and_never_shuffled(spark, monkeypatch):
    """Everything after the one pass over the texts works on stored words, ids and digests."""
    from ratiocert.operators import ngrams
    from ratiocert.plans import corpus

    plans = []
    for module in (corpus, ngrams):
        kept = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, kept=kept: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"w{i % 3} " * 30, "en") for i in range(12)], "doc_id long, text string, lang string")
        fit = corpus.fit_models(docs, min_count=1)
        plans.append(corpus.corpus_scores(fit)._jdf.queryExecution().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "text" in plans[0] and "Exchange" not in plans[0]
    assert not any(re.search(r"\btext#", p) for p in plans[1:])


def test_overlaps_of_all_sizes_take_one_scan(spark, tmp_path):
    from ratiocert.operators import overlap

    spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, [], ["a"])], "id int, a array<string>, b array<string>").write.parquet(str(tmp_path / "p"))
    pairs = spark.read.parquet(str(tmp_path / "p"))
    plan = overlap.bleu(pairs, ["id"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan") == 1
    assert [tuple(r) for r in overlap.ngram_overlap(pairs, ["id"], "a", "b", 2).orderBy("id").collect()] == [(1, 0, 1, 0), (2, 0, 0, 0)]


def test_packing_moves_tokens_once(spark):
    from ratiocert.operators.packing import partial_blocks

    docs = spark.range(50).select("id", F.transform(F.sequence(F.lit(0), F.col("id")), lambda x: x.cast("string")).alias("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks, total = partial_blocks(docs, "id", "t", 16, 8)
        text = blocks._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert total == 50 * 51 // 2 and text.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in text


def test_split_and_samples_neither_sort_nor_shuffle(spark):
    from ratiocert.operators import filters as L

    rows = spark.range(5000).withColumnRenamed("id", "i")
    for df in (L.seeded_split(rows, "i", 700, 5), L.random_rows(rows, "i", 30, 5), L.first_rows(rows, ["i"], 40), L.drop_top(rows.withColumn("v", F.rand(3)), 50, "v", ["i"])):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("Sort", "Exchange", "Limit", "Window"))


def test_thresholds_meet_on_numbers(spark):
    for key in ("crv_eps_frr", "crv_certified_benchmark", "cross_threshold"):
        text = plan(spark, key)
        assert "Join" in text and not re.search(r"HashJoin \[(knownfloatingpointnormalized|k#)", text)
