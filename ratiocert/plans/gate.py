"""Accept-or-abstain sampling over stored draws, and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import aggregates as A


def judged_draw(k: float, draws: int) -> list[Column]:
    """Per-draw columns shared by the batch gate and the stream gate."""
    ratio = S.log_ratio(F.col("ll2_model"), F.col("ll2_generator"))
    bound = S.upper_bound(F.col("ll2_generator"), F.col("n_token"), draws, F.lit(float(k)))
    return [
        ratio.alias("log_ratio"),
        bound.alias("log_upper_bound"),
        S.accepts(ratio, F.col("n_token"), F.lit(float(k))).alias("accepted"),
    ]


def run_gate(draws: DataFrame, k: float, max_draws: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """One decision per request: draws are taken in order until one is accepted, at most ``max_draws``.

    Draws beyond the maximum are filtered before the only shuffle, so a request's list is bounded
    by ``max_draws`` however many draws are stored. A request with fewer draws abstains after its last.
    """
    per_draw = draws.where(F.col("attempt") <= max_draws).select("*", *judged_draw(k, max_draws))
    tried = F.struct("attempt", "accepted", "log_ratio", "log_upper_bound", "n_token", "ll2_model", "ll2_generator", *carry)
    grouped = per_draw.groupBy("request_id").agg(
        F.sort_array(F.collect_list(tried)).alias("all"),
        F.min(F.when(F.col("accepted"), F.col("attempt"))).alias("first_ok"),
    )
    kept = F.filter("all", lambda t: F.col("first_ok").isNull() | (t["attempt"] <= F.col("first_ok")))
    out = grouped.withColumn("tries", kept).withColumn("last", F.element_at("tries", -1))
    field = lambda name: F.transform("tries", lambda t: t[name])
    return out.select(
        "request_id",
        F.col("first_ok").isNull().alias("abstained"),
        F.size("tries").cast("long").alias("num_samples"),
        F.lit(max_draws).alias("max_samples"),
        F.col("last.ll2_model").alias("log_prob_f"),
        F.col("last.ll2_generator").alias("log_prob_g"),
        field("log_ratio").alias("log_ratios"),
        field("log_upper_bound").alias("log_upper_bounds"),
        F.transform("tries", lambda t: F.pow(F.lit(2.0), t["log_upper_bound"])).alias("upper_bounds"),
        field("n_token").alias("n_tokens"),
        F.transform(
            "tries", lambda t: F.when(t["n_token"] > 0, t["log_ratio"] / t["n_token"])
        ).alias("log_ratios_normalized"),
        *[F.col(f"last.{c}").alias(c) for c in carry],
    )


def gate_report(decisions: DataFrame, judged: bool = False) -> DataFrame:
    """One row of metrics over all decisions, from one pass."""
    columns = A.abstention_columns()
    if judged:
        cells = A.abstain_decision_cells()
        columns += A.decision_share_columns()
        columns += [c.alias(f"conf_matrix_abstained={a}-decision={d}") for (a, d), c in cells.items()]
    return decisions.agg(*columns)


def judge_decision(scores: dict[str, Column], strategy: str = "max", weights: list[list[float]] | None = None,
                   bias: list[float] | None = None) -> Column:
    """IN, OUT or INVALID from three scores: the largest, or the largest output of a linear layer."""
    names = A.DECISIONS
    values = [scores[n] for n in names]
    if strategy == "regression":
        values = [
            sum((F.lit(float(w)) * v for w, v in zip(row, values[0:3])), F.lit(float(b)))
            for row, b in zip(weights, bias)
        ]
    elif strategy not in ("max", "max_likelihood", "max_prob_first_token"):
        raise ValueError(f"unknown strategy {strategy!r}")
    packed = F.array(*values)
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(packed, F.array_max(packed)).cast("int"))
