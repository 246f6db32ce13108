"""Hand-computed score frames."""

import math

import pytest
from pyspark.sql import functions as F

from ratiocert.functions import scores as S
from ratiocert.operators.filters import drop_top, shuffled_split
from ratiocert.operators.ordering import sequence_grid
from ratiocert.operators.thresholds import confusion, curve_confusion, rates, rejected_counts
from ratiocert.plans import certificates as C
from ratiocert.plans import curves as V
from ratiocert.plans.thresholds import k_from_eps, k_from_frr

ROWS = [(1, 0, -10.0, -20.0, 10), (2, 0, -12.0, -18.0, 4), (3, 0, -30.0, -35.0, 10), (4, 0, -8.0, -16.0, 4),
        (5, 1, -20.0, -60.0, 10), (6, 1, -16.0, -24.0, 8)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "sample_id long, ood int, ll2_model double, ll2_generator double, n_token_response int")


def test_ratios(frame):
    got = [r["log2_ratio_norm"] for r in C.scored(frame).orderBy("sample_id").collect()]
    assert got == [1.0, 1.5, 0.5, 2.0, 4.0, 1.0]


def test_k_from_frr_and_rates(frame):
    k = k_from_frr(C.scored(frame), [0.25]).first()["k"]
    assert k == 1.625
    r = C.scored(frame).agg(*confusion(F.col("log2_ratio_norm") > k, F.col("ood"))).select(*rates()).first()
    assert (r["FRR"], r["TRR"], r["FAR"], r["J"]) == (0.25, 0.5, 0.5, 0.25)


def test_bounds_and_constriction(frame):
    bound = S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), 2, F.lit(1.0))
    got = [r[0] for r in frame.where("ood = 1").orderBy("sample_id").select(bound).collect()]
    assert got == [-49.0, -15.0]
    one = S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), 1, F.lit(1.0))
    cr = [r[0] for r in frame.where("ood = 1").orderBy("sample_id").select(S.constriction(F.col("ll2_model"), one)).collect()]
    assert cr == pytest.approx([9.030900, 0.0], abs=1e-6)


def test_k_from_eps(spark, frame):
    grid = spark.createDataFrame([(0, -3.0)], "grid_id int, log10_eps double")
    k = k_from_eps(frame.where("ood = 1"), grid, -100, 100).first()
    assert k["k"] == pytest.approx(1.754277, abs=1e-6) and not k["clipped"]


def test_closed_form_equals_bisection(spark, frame):
    rows = [(g, n) for _, ood, _, g, n in ROWS if ood == 1]
    grid = sequence_grid(spark, 41, -20.0, 20.0, "log10_eps")
    for r in k_from_eps(frame.where("ood = 1"), grid, -10, 100).collect():
        lo, hi, e = -10.0, 100.0, r["log10_eps"] / math.log10(2)
        for _ in range(100):
            mid = (lo + hi) / 2
            if max(g + mid * n for g, n in rows) > e:
                hi = mid
            else:
                lo = mid
        assert r["k"] == pytest.approx((lo + hi) / 2, abs=1e-5)


def test_one_pass_curve_equals_crossing(spark, frame):
    grid = spark.createDataFrame([(i, float(k)) for i, k in enumerate([0.5, 1.0, 1.5, 2.0, 4.0, 4.0, 9.0, -1.0])], "grid_id int, k double")
    rows = C.scored(frame)
    fast = {r["grid_id"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in curve_confusion(rows, grid, "k", "log2_ratio_norm", "ood").collect()}
    crossed = rows.crossJoin(grid).groupBy("grid_id").agg(*confusion(F.col("log2_ratio_norm") > F.col("k"), F.col("ood")))
    assert fast == {r["grid_id"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in crossed.collect()} and len(fast) == 8
    counts = {(r["ood"], r["grid_id"]): (r["rejected"], r["n"]) for r in rejected_counts(rows, grid, "k", "log2_ratio_norm", ["ood"]).collect()}
    assert counts[0, 1] == (fast[1][1], fast[1][0] + fast[1][1]) and len(counts) == 16


def test_frr_falls_with_k(frame):
    curve = V.detection_curve(frame, points=20, k_max=5.0).orderBy("k").collect()
    frrs = [r["FRR"] for r in curve]
    assert frrs == sorted(frrs, reverse=True)
    assert V.best_threshold(V.detection_curve(frame, points=20, k_max=5.0)).first()["J"] == max(r["J"] for r in curve)


def test_accepted_stays_below_bound(frame):
    k = F.lit(1.5)
    ok = S.accepts(S.log_ratio(F.col("ll2_model"), F.col("ll2_generator")), F.col("n_token_response"), k)
    bound = S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), 3, k)
    assert frame.where(ok & (F.col("ll2_model") > bound)).count() == 0


def test_drop_top(frame):
    kept = {r[0] for r in drop_top(frame, 2, "ll2_generator", ["sample_id"]).select("sample_id").collect()}
    assert kept == {1, 3, 5, 6}
    kept = {r[0] for r in drop_top(frame, 1, "ll2_generator", ["sample_id"], scope="ood").select("sample_id").collect()}
    assert kept == {1, 2, 3, 4, 5}
    assert drop_top(frame, 10, "ll2_generator", ["sample_id"]).count() == 0


def test_split_sizes(spark):
    parts = shuffled_split(spark.range(1000).withColumnRenamed("id", "i"), "i", 300, 7).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 300, "val": 700}


def test_bounded_probability(spark):
    df = spark.createDataFrame([(-2000.0,), (3.0,), (20.0,)], "b double")
    assert [r[0] for r in df.select(S.bounded_probability(F.col("b"))).collect()] == [2e-300, 8.0, 2e-300]


def test_constriction_table_by_hand(frame):
    out = {r["FRR"]: r for r in C.constriction_by_frr(frame, [0.25]).collect()}[0.25]
    assert out["k"] == 1.625
    crs = sorted(((-20.0) - (-60.0 + 16.25), (-16.0) - (-24.0 + 13.0)))
    crs = [c / math.log2(10) for c in crs]
    assert out["log10_cr_median"] == pytest.approx(sum(crs) / 2)
    assert out["log10_cr_10"] == pytest.approx(crs[0] + 0.1 * (crs[1] - crs[0]))


def test_edge_cases_have_results(spark):
    from ratiocert.functions import scores as S
    from ratiocert.functions import tasks as T
    from ratiocert.operators import aggregates as A

    one = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 2.0)], "g string, v double")
    bins = {(r["g"], r["bin"], r["n"], r["density"]) for r in A.histogram(one, "v", "g", 4).collect()}
    assert bins == {("a", 2, 2, 4.0), ("b", 2, 1, 4.0)}
    lengths = spark.createDataFrame([(6.0, 3), (6.0, 0)], "v double, n int")
    assert [r[0] for r in lengths.select(S.per_token(F.col("v"), F.col("n"))).collect()] == [2.0, None]
    row = spark.range(1).select(
        T.solve(F.array(F.lit("1"), F.lit("zzz")), "add", T.population(2, 0, "int")).alias("add"),
        T.population(0, 3).alias("letters"), T.population(2, 0).alias("numbers"),
        T.letter_word(F.lit(475_254)).alias("five"), T.letter_word(F.lit(475_253)).alias("four"),
    ).first()
    assert row["add"] == ["2", None] and row["letters"] == ["a", "b", "c"] and row["numbers"] == ["1", "2"]
    assert (row["four"], row["five"]) == ("zzzz", "aaaaa")
