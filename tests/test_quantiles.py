"""All quantile paths against numpy, with ties, hot values and hot groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiocert.operators.ordering import row_positions, sequence_grid
from ratiocert.operators import lines as L
from ratiocert.operators.quantiles import exact_quantiles, ranked_quantiles
from ratiocert.plans.certificates import constriction_grid
from ratiocert.plans.thresholds import k_from_eps_quantile, quantile_root

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    groups = np.where(rng.random(20000) < 0.9, "hot", rng.choice(["a", "b", "c"], 20000))
    values = np.where(rng.random(20000) < 0.35, 1.25, np.round(rng.normal(0, 3, 20000), 3))
    pdf = list(zip(groups.tolist(), values.tolist()))
    return spark.createDataFrame(pdf, "g string, v double").repartition(7), groups, values


@pytest.mark.parametrize("small,sketch", [(10**9, 10000), (0, 10000), (0, 50)])
def test_groups(skewed, small, sketch):
    df, groups, values = skewed
    got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "v", QS, ["g"], small, sketch).collect()}
    assert len(got) == 4 * len(QS)
    for g in set(groups):
        for q in QS:
            assert got[g, q] == pytest.approx(np.quantile(values[groups == g], q), abs=1e-9)


@pytest.mark.parametrize("small", [10**9, 0])
def test_global(skewed, small):
    df, _, values = skewed
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "v", QS, small_rows=small).collect()}
    for q in QS:
        assert got[q] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_all_paths_agree_to_the_last_digit(skewed):
    df, _, _ = skewed
    df = df.withColumn("v", F.col("v") / 7)
    ways = [exact_quantiles(df, "v", QS, ["g"]), exact_quantiles(df, "v", QS, ["g"], small_rows=0), ranked_quantiles(df, "v", QS, ["g"])]
    first, *others = [{(r["g"], r["q"]): r["quantile"] for r in w.collect()} for w in ways]
    assert all(w == first for w in others)


def test_ranked_path(skewed):
    df, groups, values = skewed
    got = {(r["g"], r["q"]): r["quantile"] for r in ranked_quantiles(df, "v", [0.1, 0.5], ["g"]).collect()}
    assert got["hot", 0.1] == pytest.approx(np.quantile(values[groups == "hot"], 0.1))
    assert got["b", 0.5] == pytest.approx(np.quantile(values[groups == "b"], 0.5))


@pytest.mark.parametrize("small,cells,bins_above", [(10**9, 1 << 16, None), (0, 1 << 16, 0), (0, 64, 500), (10**9, 3, 0), (0, 1, 10**9)])
def test_grid(spark, small, cells, bins_above):
    rng = np.random.default_rng(11)
    n = 5000
    length = rng.integers(1, 9, n)
    # a third of all rows is one and the same row
    g = -np.round(rng.gamma(2, 10, n), 2)
    f = np.round(g + length * rng.normal(1, 1, n), 3)
    same = rng.random(n) < 0.34
    length[same], g[same], f[same] = 4, -20.0, -14.0
    df = spark.createDataFrame(list(zip(f.tolist(), g.tolist(), length.tolist())), "ll2_model double, ll2_generator double, n_token_response int")
    grid = sequence_grid(spark, 9, -2.0, 4.0, "k")
    got = {(r["grid_id"], r["q"]): r["quantile"] for r in constriction_grid(
        df, grid, ["grid_id"], [0.0, 0.1, 0.5, 0.9, 1.0], small_rows=small, max_cells=cells, bins_above=bins_above).collect()}
    for i, k in enumerate(np.linspace(-2, 4, 9)):
        cr = (f - (g + k * length)) / math.log2(10)
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert got[i, q] == pytest.approx(np.quantile(cr, q), abs=1e-8)


@pytest.mark.parametrize("lengths", [50, 20_000, 100_000])
def test_candidates_do_not_grow_with_the_number_of_lengths(spark, lengths):
    n, points, q = 150_000, 101, 0.9
    length = F.least(1 + F.floor(F.rand(1) * lengths), F.lit(lengths)).cast("int")
    rows = spark.range(n).select(length.alias("n"), (-200 * F.rand(2) * F.rand(3)).alias("r")).select("n", (F.col("r") * F.col("n")).alias("b"))
    rows = L.cut_lineage(rows)
    assert rows.select("n").distinct().count() > 0.7 * min(lengths, n / 2)
    counted = L.counted_cells(rows, "b", F.col("n"))
    assert len(counted.summary) <= 1.1 * L.MAX_CELLS
    grid = L.numbered(sequence_grid(spark, points, -5.0, 120.0, "k"), ["grid_id"], F.col("k"), F.lit(0.0))
    ranks = [(math.floor(q * (n - 1)), math.floor(q * (n - 1)) + 1)]
    exact = F.col("b") + F.col("k") * F.col("n")
    lines, kept, _ = L.candidates(counted, grid, exact, ranks)
    assert lines.count() == points and kept.count() < 2 * n
    pdf = rows.toPandas()
    got = {(r["__g"], r["side"]): r["value"] for r in L.order_statistics(counted, grid, exact, ranks).collect()}
    for r in grid.where("__g % 25 = 0").collect():
        want = np.sort(pdf["b"] + r["k"] * pdf["n"])
        for side, rank in enumerate(ranks[0]):
            assert got[r["__g"], side] == want[rank]


@pytest.mark.parametrize("q,n", [(0.9, 3000), (0.95, 37), (0.5, 2), (1.0, 50), (0.0, 50), (0.75, 5), (0.3, 1)])
def test_quantile_inversion(spark, q, n):
    rng = np.random.default_rng(3)
    length = rng.integers(1, 30, n)
    g = -rng.gamma(3, 20, n)
    g[: n // 5], length[: n // 5] = g[0], length[0]
    df = spark.createDataFrame(list(zip(g.tolist(), length.tolist())), "ll2_generator double, n_token_response int")
    grid = sequence_grid(spark, 5, -20.0, 0.0, "log10_eps")
    rows = k_from_eps_quantile(df, grid, q, -1000, 1000).collect()
    assert len(rows) == 5
    for r in rows:
        bound = np.quantile(g + r["k"] * length, q)
        assert bound == pytest.approx(r["log10_eps"] / math.log10(2), abs=1e-9)
    clipped = k_from_eps_quantile(df, grid, q, 0.5, 0.6).collect()
    assert {r["grid_id"]: r["k"] for r in clipped} == {r["grid_id"]: min(max(r["k"], 0.5), 0.6) for r in rows}


def test_quantile_root_with_lines_that_overtake():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, c = rng.integers(1, 1000, 40).astype(float), np.sort(rng.random(40))
        at = int(rng.integers(1, 39))
        share = float(rng.random())
        k = quantile_root(c[at - 1], c[at], share, (n[at:], c[at:]), (n[:at], c[:at]))
        value = (1 - share) * (n[at:] * (k - c[at:])).max() + share * (n[:at] * (k - c[:at])).min()
        assert c[at - 1] <= k <= c[at] and abs(value) < 1e-9


def test_positions(spark):
    df = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5003).alias("x"))
    rows = row_positions(df, ["x"]).collect()
    order = sorted(r["x"] for r in rows)
    assert sorted((r["idx"], r["x"]) for r in rows) == list(enumerate(order))
