"""Detection curves over thresholds and over epsilons, and benchmark accuracy under the certificate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import sequence_grid
from ..operators.quantiles import wide_quantiles
from ..operators.thresholds import bucketed_sums, curve_confusion, rates
from ..session import cut_lineage
from .certificates import constriction_grid, scored
from .thresholds import k_from_eps


def detection_curve(rows: DataFrame, points: int = 100, k_max: float = 10.0, k_min: float | None = None) -> DataFrame:
    """(k, FRR, TRR, J, log10_constriction_ratio) for evenly spaced k from the smallest per-token ratio."""
    rows = cut_lineage(scored(rows).select("ll2_model", "ll2_generator", "n_token_response", "log2_ratio_norm", "ood"))
    start = k_min if k_min is not None else rows.agg(F.min("log2_ratio_norm")).first()[0]
    grid = sequence_grid(rows.sparkSession, points, float(start), k_max, "k")
    grid = cut_lineage(grid)  # the same doubles for every use below
    counts = curve_confusion(rows, grid, "k", "log2_ratio_norm", "ood")
    median = wide_quantiles(
        constriction_grid(rows.where(F.col("ood") == 1), grid, ["grid_id"], [0.5]), ["grid_id"],
        {0.5: "log10_constriction_ratio"},
    )
    measured = counts.select("grid_id", "k", *rates())  # as few rows as the grid, as is the median
    return measured.join(F.broadcast(median), "grid_id").select("grid_id", "k", "FRR", "TRR", "J", "log10_constriction_ratio")


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the highest J, the smallest k among equals."""
    return curve.orderBy(F.desc("J"), "k").limit(1)


def eps_curve(rows: DataFrame, points: int = 100, low: float = -20.0, high: float = 0.0,
              bracket: tuple[float, float] = (-10.0, 100.0)) -> DataFrame:
    """(e_log, k, FRR, TRR, FAR, J): detection rates at the threshold that certifies each epsilon."""
    rows = cut_lineage(scored(rows).select("ll2_generator", "n_token_response", "log2_ratio_norm", "ood"))
    grid = sequence_grid(rows.sparkSession, points, low, high, "log10_eps")
    ks = k_from_eps(rows.where(F.col("ood") == 1), grid, *bracket)
    counts = curve_confusion(rows, ks, "k", "log2_ratio_norm", "ood")
    return counts.select(F.col("log10_eps").alias("e_log"), "k", *rates())


def certified_benchmark(joined: DataFrame, ks: DataFrame, by_category: bool = False) -> DataFrame:
    """Rejection rate and certified accuracy (accepted and correct) at each k of a k/epsilon table.

    ``joined``: ll2_model, ll2_generator, n_token_response, correct, subject. ``ks``: log10_eps, k and
    whatever percentiles go with it. One pass counts rows between thresholds.
    """
    measures = {"n": F.lit(1).cast("long"), "ok": F.col("correct").cast("long")}
    by = ["subject"] if by_category else []
    rows = scored(joined).select(*by, "correct", "log2_ratio_norm")
    sums = bucketed_sums(rows, ks, "k", "log2_ratio_norm", measures, by)
    out = sums.select(
        *by, *ks.columns,
        (1 - F.col("n_accepted") / F.col("n_all")).alias("FRR"),
        (F.col("ok_accepted") / F.col("n_all")).alias("accuracy"),
    )
    return out.drop("FRR") if by_category else out


def benchmark_table(joined: DataFrame, ks: DataFrame, name: str, categories: list) -> DataFrame:
    """One row per epsilon: k, whatever percentiles ``ks`` has, FRR, accuracy under the certificate, and a column per category."""
    ks, joined = cut_lineage(ks), cut_lineage(joined)
    overall = certified_benchmark(joined, ks)
    per_category = certified_benchmark(joined, ks.select("log10_eps", "k"), by_category=True)
    return wide_benchmark(overall, per_category, name, categories)


def wide_benchmark(overall: DataFrame, per_category: DataFrame, name: str, categories: list) -> DataFrame:
    """One row per epsilon with a column per category."""
    pivoted = per_category.groupBy("log10_eps").pivot("subject", categories).agg(F.first("accuracy"))
    renamed = pivoted.select("log10_eps", *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in categories])
    return overall.withColumnRenamed("accuracy", name).join(renamed, "log10_eps")
