"""Choosing the threshold k: from a false-rejection rate, or from a target bound."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import eps_log2, log2_draws
from ..operators.lines import counted_cells, numbered, order_statistics, rows_between
from ..operators.quantiles import exact_quantiles
from ..session import cut_lineage


def k_from_frr(scores: DataFrame, frrs: Sequence[float], ratio: str = "log2_ratio_norm") -> DataFrame:
    """(FRR, k): the (1 - FRR) quantile of the per-token ratio over in-domain rows."""
    qs = sorted({1.0 - f for f in frrs})
    wanted = scores.sparkSession.createDataFrame([(float(f), 1.0 - f) for f in frrs], "FRR double, q double")
    found = exact_quantiles(scores.where(F.col("ood") == 0), ratio, qs)
    return F.broadcast(wanted).join(found, "q").select("FRR", F.col("quantile").alias("k"))


def k_from_eps(rows: DataFrame, grid: DataFrame, low: float, high: float, keys: Sequence[str] = ("grid_id",),
               generator: str = "ll2_generator", n: str = "n_token_response", draws: str | int = 1) -> DataFrame:
    """Adds ``k`` and ``clipped`` to a grid with ``log10_eps``: the largest bound over the rows equals epsilon.

    With positive lengths the largest of g + log2 T + k N reaches e at min((e - log2 T - g) / N).
    For each length only the largest g matters, so one aggregate leaves a row per length.
    """
    tops = rows.groupBy(F.col(n).alias("__n")).agg(F.max(generator).alias("__g"))
    t = F.col(draws) if isinstance(draws, str) else draws
    solution = (eps_log2(F.col("log10_eps")) - log2_draws(t) - F.col("__g")) / F.col("__n")
    best = (
        tops.crossJoin(F.broadcast(grid)).groupBy(*keys).agg(F.min(solution).alias("__k"))
    )
    clipped = F.least(F.greatest(F.col("__k"), F.lit(float(low))), F.lit(float(high)))
    return grid.join(F.broadcast(best), list(keys)).select(
        *grid.columns, clipped.alias("k"), (F.col("__k") != clipped).alias("clipped")
    )


def k_from_eps_quantile(rows: DataFrame, grid: DataFrame, q: float, low: float, high: float, draws: int = 1,
                        generator: str = "ll2_generator", n: str = "n_token_response") -> DataFrame:
    """The same where the ``q`` quantile of the bounds, not the largest, equals epsilon; all points together, in closed form.

    A row's bound g + log2 T + k N rises with k and passes e at its own k, (e - log2 T - g) / N. At the solution, the
    rows below e are known by number, so the solution lies between two neighbouring order statistics of these crossings.
    Between them no row passes e: the quantile is (1 - f) times the largest bound of the rows below plus f times the smallest
    one of the rows above. A row can be that largest or smallest one only if it crosses near the two; how near depends on its
    length alone. So a fixed number of passes gives the two crossings, then the rows near them (the nearest of each
    length), and each point's few rows give its k.
    """
    rows = cut_lineage(rows.select(F.col(generator).alias("g"), F.col(n).alias("n")).where("g IS NOT NULL AND n > 0").withColumn("slope", -F.col("g") / F.col("n")))
    own = eps_log2(F.col("log10_eps")) - log2_draws(draws)
    crossing = (own - F.col("g")) / F.col("n")
    counted = counted_cells(rows, "slope", 1 / F.col("n"))
    place = q * (counted.n_rows - 1)
    share, below = place - math.floor(place), math.floor(place) + 1
    last = counted.n_rows - below  # the smallest crossing of a row below, in ascending order
    points = numbered(grid.select("grid_id", "log10_eps"), ["grid_id"], own, F.lit(0.0))
    found = order_statistics(counted, points, crossing, [(max(last - 1, 0), last)])
    ends = cut_lineage(found.groupBy("__g").agg(F.min("value").alias("a"), F.max("value").alias("b")))
    longest, shortest = rows.agg(F.max("n"), F.min("n")).first()
    reach = (F.col("b") - F.col("a")) * F.lit(longest / shortest)
    windows = points.join(F.broadcast(ends), "__g").withColumns({"lo": F.col("a") - reach, "hi": F.col("b") + reach})
    near = rows_between(counted, cut_lineage(windows), crossing)
    spare = (F.col("b") - F.col("a")) * F.lit(float(longest)) / F.col("n")
    above = F.col("__v") < F.col("b")
    kept = near.where(F.when(above, F.col("__v") >= F.col("a") - spare).otherwise(F.col("__v") <= F.col("b") + spare))
    nearest = kept.groupBy("__g", "a", "b", above.alias("above"), F.col("n").cast("double").alias("n")).agg(F.max("__v").alias("most"), F.min("__v").alias("least"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        up = group["above"].to_numpy(bool)
        lines_below = group.loc[~up, "n"].to_numpy(), group.loc[~up, "least"].to_numpy()
        lines_above = group.loc[up, "n"].to_numpy(), group.loc[up, "most"].to_numpy()
        a, b = float(group["a"].iloc[0]), float(group["b"].iloc[0])
        return pd.DataFrame({"__g": group["__g"].iloc[:1], "__k": [quantile_root(a, b, share, lines_below, lines_above)]})

    solved = nearest.groupBy("__g").applyInPandas(solve, "__g int, __k double")
    ks = points.select("__g", "grid_id").join(F.broadcast(solved), "__g").select(
        "grid_id", F.least(F.greatest(F.col("__k"), F.lit(float(low))), F.lit(float(high))).alias("k")
    )
    return grid.join(F.broadcast(ks), "grid_id")


def quantile_root(a: float, b: float, share: float, below: tuple[np.ndarray, np.ndarray], above: tuple[np.ndarray, np.ndarray]) -> float:
    """Where (1 - share) * max n (k - c) over the lines below + share * min n (k - c) over those above is 0, for k in [a, b].

    Both parts are piecewise linear and rise. The lines that are extreme at k give the root of their own; where the same lines
    are extreme there, it is the root, else the side of k is known.
    """
    (n_b, c_b), (n_a, c_a) = below, above
    if share == 0 or not len(n_a) or a == b:
        return b
    low, high, k = a, b, b
    while True:
        x, y = n_b * (k - c_b), n_a * (k - c_a)
        i, j = int(x.argmax()), int(y.argmin())
        value = (1 - share) * x[i] + share * y[j]
        if value == 0:
            return k
        low, high = (low, k) if value > 0 else (k, high)
        one, two = (1 - share) * n_b[i], share * n_a[j]
        root = (one * c_b[i] + two * c_a[j]) / (one + two)
        x, y = n_b * (root - c_b), n_a * (root - c_a)
        if x[i] >= x.max() and y[j] <= y.min():
            return float(root)
        middle = (low + high) / 2
        if not low < middle < high:
            return float(middle)
        k = middle
