"""Gate, judge and stream."""

import os

import pytest
from pyspark.sql import functions as F

from ratiocert.functions import scores as S
from ratiocert.plans import gate as G
from ratiocert.streaming import gate_stream as ST

DRAWS = {"A": [(15, 5), (6, 4)], "B": [(20, 4), (9, 4), (8, 4), (1, 4)], "C": [(9, 1), (9, 1), (9, 1)]}


@pytest.fixture(scope="module")
def draws(spark):
    rows = [(ord(k), i + 1, float(r) - 30.0, -30.0, n) for k, v in DRAWS.items() for i, (r, n) in enumerate(v)]
    return spark.createDataFrame(rows, "request_id long, attempt int, ll2_model double, ll2_generator double, n_token int")


def test_decisions(draws):
    got = {chr(r["request_id"]): r for r in G.run_gate(draws, 2.0, 3).collect()}
    assert [(got[x]["abstained"], got[x]["num_samples"]) for x in "ABC"] == [(False, 2), (False, 3), (True, 3)]
    assert got["B"]["log_ratios"] == [20.0, 9.0, 8.0] and got["B"]["log_prob_f"] == -22.0
    assert got["B"]["log_ratios_normalized"] == [5.0, 2.25, 2.0]
    report = G.gate_report(G.run_gate(draws, 2.0, 3)).first()
    assert report["mean_abstained"] == pytest.approx(1 / 3)
    assert report["mean_num_samples"] == pytest.approx(8 / 3)
    assert report["mean_num_samples_not_abstained"] == 2.5


def test_all_abstain(draws):
    report = G.gate_report(G.run_gate(draws, -100.0, 1)).first()
    assert report["mean_abstained"] == 1.0 and report["mean_num_samples_not_abstained"] is None


def test_token_count(spark):
    df = spark.createDataFrame([([-1.0, 0.0], [-2.0, 0.0]), ([-1.0, 0.0], [-2.0, -1.0]), ([-1.0], [-2.0])], "f array<double>, g array<double>")
    assert [r[0] for r in df.select(S.certified_tokens(F.col("f"), F.col("g"))).collect()] == [1, 2, 1]


def test_judge(spark):
    df = spark.createDataFrame([(0.1, 0.7, 0.2), (0.5, 0.5, 0.1)], "a double, b double, c double")
    three = {"IN": F.col("a"), "OUT": F.col("b"), "INVALID": F.col("c")}
    assert [r[0] for r in df.select(G.judge_decision(three)).collect()] == ["OUT", "IN"]
    flip = G.judge_decision(three, "regression", [[0, 0, 0], [0, 0, 0], [0, 0, 1]], [0, 0.15, 0])
    assert [r[0] for r in df.select(flip).collect()] == ["INVALID", "OUT"]


def test_report_with_judge(spark, draws):
    decisions = G.run_gate(draws, 2.0, 3).withColumn("decision", F.when(F.col("abstained"), "OUT").otherwise("IN"))
    r = G.gate_report(decisions, judged=True).first()
    assert r["conf_matrix_abstained=True-decision=OUT"] == pytest.approx(1 / 3)
    assert r["conf_matrix_abstained=False-decision=INVALID"] == 0.0
    assert r["prop_judge_IN"] == pytest.approx(2 / 3)


def test_stream_equals_batch(spark, draws, tmp_path):
    rows = draws.withColumn("dataset", F.when(F.col("request_id") == ord("A"), "a").otherwise("b"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ST.scored_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
    totals = {r["dataset"]: (r["n"], r["n_abstained"]) for r in ST.drain(ST.abstention_by(ST.gate_stream(stream, 2.0)), "gate_test").collect()}
    ok = G.judged_draw(2.0, 1)[2]
    batch = rows.select("dataset", ok).groupBy("dataset").agg(F.count("*"), F.sum((~F.col("accepted")).cast("long")))
    assert totals == {r[0]: (r[1], r[2]) for r in batch.collect()}


def test_stream_reads_a_table_in_parts(spark, tmp_path):
    """The registered query gives the same totals for a table in one file and in a folder of parts."""
    from registry.certificates import stm_gate

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables not present")
    spark.read.parquet(f"{sf}/lineitem.parquet").repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = [sorted(map(tuple, stm_gate(spark, d).collect())) for d in (sf, str(tmp_path))]
    assert rows[0] == rows[1] and len(rows[0]) == 2
