"""Certificate tables: constriction ratios by threshold, atomic certificates, the k/epsilon table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.aggregates import histogram
from ..operators.lines import counted_cells, grid_quantiles
from ..operators.ordering import sequence_grid
from ..operators.quantiles import exact_quantiles, wide_quantiles
from ..session import cut_lineage
from .thresholds import k_from_eps, k_from_eps_quantile, k_from_frr

# Fixed values of the published tables.
FRR_TABLE = [0.0, 0.01, 0.05, 0.1, 0.2, 0.25, 0.5]
QUANTILES = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
PERCENTILES = {0.1: "log10_cr_10", 0.5: "log10_cr_median", 0.9: "log10_cr_90"}


def scored(rows: DataFrame) -> DataFrame:
    """Adds the ratio columns all certificates start from."""
    ratio = S.log_ratio(F.col("ll2_model"), F.col("ll2_generator"))
    return rows.withColumn("log2_ratio", ratio).withColumn(
        "log2_ratio_norm", S.per_token(F.col("log2_ratio"), F.col("n_token_response"))
    )


def based(rows: DataFrame) -> DataFrame:
    """The three columns that constriction ratios need, and the ratio before any threshold, stored: several passes read them."""
    base = S.log_ratio(F.col("ll2_model"), F.col("ll2_generator")) / F.lit(S.LOG2_10)
    return cut_lineage(rows.select("ll2_model", "ll2_generator", "n_token_response", base.alias("__base")))


def constriction_grid(rows: DataFrame, grid: DataFrame, keys: Sequence[str], qs: Sequence[float],
                      draws: int = 1, **kwargs) -> DataFrame:
    """(keys, q, quantile) of the log10 constriction ratio at every ``k`` of the grid, exactly."""
    exact = S.constriction(
        F.col("ll2_model"),
        S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), draws, F.col("k")),
    )
    scale, offset = -F.col("k") / F.lit(S.LOG2_10), -S.log2_draws(draws) / F.lit(S.LOG2_10)
    rows = rows if "__base" in rows.columns else based(rows)
    return grid_quantiles(rows, "__base", grid, keys, scale, offset, F.col("n_token_response"), exact, qs, **kwargs)


def constriction_by_frr(rows: DataFrame, frrs: Sequence[float] = FRR_TABLE, only_ood: bool = True,
                        distributions: str | None = "F(y|x)||G(y)") -> DataFrame:
    """(FRR, k, log10_cr_10, log10_cr_median, log10_cr_90, combined)."""
    rows = scored(rows)
    if distributions is not None and "distributions" in rows.columns:
        rows = rows.where(F.col("distributions") == distributions)
    # Scores may come from sums whose last digits depend on the run; every pass below must see the same ones.
    rows = cut_lineage(rows.select("ll2_model", "ll2_generator", "n_token_response", "log2_ratio_norm", "ood"))
    ks = cut_lineage(k_from_frr(rows, frrs))
    chosen = rows.where(F.col("ood") == 1) if only_ood else rows
    long = constriction_grid(chosen, ks, ["FRR"], list(PERCENTILES))
    wide = wide_quantiles(long, ["FRR"], PERCENTILES)
    text = F.format_string("%.0f / %.0f / %.0f", *[F.col(c) for c in PERCENTILES.values()])
    return wide.join(F.broadcast(ks), "FRR").select("FRR", "k", *PERCENTILES.values(), text.alias("combined"))


def constriction_rows(rows: DataFrame, frr: float, only_ood: bool = True) -> DataFrame:
    """Every row with its log10 constriction ratio at the threshold of one false-rejection rate."""
    rows = scored(rows)
    chosen = rows.where(F.col("ood") == 1) if only_ood else rows
    bound = S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), 1, F.col("k"))
    return (
        chosen.crossJoin(F.broadcast(k_from_frr(rows, [frr])))
        .withColumn("log10_constriction_ratio", S.constriction(F.col("ll2_model"), bound))
    )


def constriction_quantiles(rows: DataFrame, frr: float, qs: Sequence[float] = QUANTILES) -> DataFrame:
    return exact_quantiles(constriction_rows(rows, frr), "log10_constriction_ratio", qs)


def constriction_histogram(rows: DataFrame, frr: float, bins: int = 40) -> DataFrame:
    return histogram(constriction_rows(rows, frr), "log10_constriction_ratio", "dataset", bins)


def atomic_certificates(rows: DataFrame, frr: float) -> DataFrame:
    """Every row with its own bound at the threshold of one false-rejection rate."""
    rows = scored(rows)
    bound = S.upper_bound(F.col("ll2_generator"), F.col("n_token_response"), 1, F.col("k"))
    return (
        rows.crossJoin(F.broadcast(k_from_frr(rows, [frr])))
        .withColumn("log2_upper_bound_m", bound)
        .withColumn("log10_upper_bound_m", F.col("log2_upper_bound_m") / F.lit(S.LOG2_10))
        .withColumn("upper_bound_m", S.bounded_probability(F.col("log2_upper_bound_m")))
        .withColumn("log10_upper_bound_f", F.col("ll2_model") / F.lit(S.LOG2_10))
    )


def eps_table(rows: DataFrame, draws: Sequence[int] = (1,), points: int = 501, low: float = -50.0, high: float = 50.0,
              bracket: tuple[float, float] = (-100.0, 100.0), upper_quantile: float = 1.0, **kwargs) -> DataFrame:
    """The k/epsilon table over out-of-domain rows: k and constriction percentiles for each (T, epsilon).

    Below 1, ``upper_quantile`` leaves the largest bounds out: that quantile of them, not their maximum, meets epsilon.
    Rows are stored and counted into cells once for all T.
    """
    spark = rows.sparkSession
    rows = based(rows)
    kwargs.setdefault("counted", counted_cells(rows, "__base", F.col("n_token_response")))
    parts = []
    for t in draws:
        grid = sequence_grid(spark, points, low, high, "log10_eps")
        if upper_quantile < 1:
            ks = k_from_eps_quantile(rows, grid, upper_quantile, *bracket, draws=t)
        else:
            ks = k_from_eps(rows, grid, *bracket, draws=t)
        ks = cut_lineage(ks)
        long = constriction_grid(rows, ks.select("grid_id", "k"), ["grid_id"], list(PERCENTILES), t, **kwargs)
        wide = wide_quantiles(long, ["grid_id"], PERCENTILES)
        parts.append(
            ks.join(F.broadcast(wide), "grid_id").select(
                F.lit(t).alias("T"), "log10_eps", F.col("k").alias("k_min"), F.col("k").alias("k_mid"),
                F.col("k").alias("k_max"), *PERCENTILES.values(),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
