"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lookup import checked_broadcast
from .ordering import running_start

DECISIONS = ["IN", "OUT", "INVALID"]


def counts(df: DataFrame, keys: Sequence[str], name: str = "counts") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def accuracy(df: DataFrame, subject: str, correct: str) -> DataFrame:
    """Per subject and overall (subject NULL) in one pass."""
    return df.rollup(subject).agg(F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.min(column).cast("long").alias("min_length"),
        F.avg(column).alias("mean_length"),
        F.max(column).cast("long").alias("max_length"),
    )


def abstention_columns() -> list[Column]:
    """Means over gate decisions; the last is NULL when every request abstained."""
    return [
        F.avg(F.col("abstained").cast("double")).alias("mean_abstained"),
        F.avg("num_samples").alias("mean_num_samples"),
        F.avg(F.when(~F.col("abstained"), F.col("num_samples"))).alias("mean_num_samples_not_abstained"),
    ]


def share(condition: Column) -> Column:
    return F.count_if(condition) / F.count(F.lit(1))


def decision_share_columns(decision: str = "decision") -> list[Column]:
    """The share of every decision, 0 where it does not occur."""
    return [share(F.col(decision) == d).alias(f"prop_judge_{d}") for d in DECISIONS]


def abstain_decision_cells(decision: str = "decision") -> dict[tuple[bool, str], Column]:
    """The 2 x 3 cells as shares of all rows."""
    return {(a, d): share((F.col("abstained") == a) & (F.col(decision) == d)) for a in (True, False) for d in DECISIONS}


def abstain_by_decision(df: DataFrame, decision: str = "decision") -> DataFrame:
    """The cells as (abstained, decision, share) rows, from one pass."""
    cells = [
        F.struct(F.lit(a).alias("abstained"), F.lit(d).alias("decision"), c.alias("share"))
        for (a, d), c in abstain_decision_cells(decision).items()
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def error_histogram(df: DataFrame, errors: str) -> DataFrame:
    """Rows per number of errors, and the share without any on every row."""
    total = df.agg(F.avg((F.col(errors) == 0).cast("double")).alias("share_correct"))
    return df.groupBy(errors).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))


def exact_match(response: Column, target: Column) -> Column:
    """Whether the response ends with the target."""
    return F.avg((F.substring(response, F.greatest(F.length(response) - F.length(target) + 1, F.lit(1)), F.length(response)) == target).cast("double"))


def task_scores(df: DataFrame, text: str, check: str = "check") -> DataFrame:
    """Means over scored task sequences; missing values count as 0, a missing integer flag as true."""
    def mean(field: str) -> Column:
        return F.avg(F.coalesce(F.col(f"{check}.{field}").cast("double"), F.lit(0.0)))

    integer = F.coalesce(F.col(f"{check}.int_population"), F.lit(True))
    correct = F.coalesce(F.col(f"{check}.task_correct").cast("double"), F.lit(0.0))
    fields = ("int_population", "task_correct", "instruct_sequence_valid", "lengths_match", "num_token_match")
    return df.agg(
        *[mean(f).alias(f) for f in fields],
        (F.count_distinct(text) / F.count(F.lit(1))).alias("unique_sequences"),
        F.avg(F.when(integer, correct)).alias("task_correct_int_population"),
    )


def histogram(df: DataFrame, value: str, group: str, bins: int) -> DataFrame:
    """Density per group over bins shared by all groups; the maximum falls into the last bin."""
    rows = df.where(F.col(value).isNotNull())
    limits = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # A column of one value gets a range of width 1 around it.
    half = F.when(F.col("hi") > F.col("lo"), F.lit(0.0)).otherwise(F.lit(0.5))
    limits = limits.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    spot = F.least(F.floor((F.col(value) - F.col("lo")) / width).cast("int"), F.lit(bins - 1))
    binned = rows.crossJoin(F.broadcast(limits)).groupBy(group, spot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first(width).alias("width"))
    total = F.sum("n").over(Window.partitionBy(group))  # over at most ``bins`` rows a group
    return binned.select(group, "bin", "n", (F.col("n") / (total * F.col("width"))).alias("density"))


def ecdf(df: DataFrame, value: str, group: str) -> DataFrame:
    """Share of the group's rows at or below each distinct value.

    Values are counted first and accumulated over a range partitioning: no group meets in one task.
    """
    steps = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")))
    totals = steps.groupBy(group).agg(F.sum("n").alias("total"))
    summed = running_start(steps, [value], "n", [group], name="before")
    return summed.join(checked_broadcast(totals), group).select(
        group, value, "n", ((F.col("before") + F.col("n")) / F.col("total")).alias("cdf")
    )


def tail_shares(df: DataFrame, value: str, low: float, high: float, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(
        F.avg((F.col(value) < low).cast("double")).alias("below"),
        F.avg((F.col(value) > high).cast("double")).alias("above"),
    )


def perplexity(ll: Column, label: Column | None = None, mask: str = "none", ignored: int = -100) -> Column:
    """exp of the mean negative natural-log likelihood; with ``mask="labels"`` only of tokens whose label isn't ``ignored``."""
    if mask == "none":
        return F.exp(-F.avg(ll))
    if mask == "labels":
        return F.exp(-F.avg(F.when(label != ignored, ll)))
    raise ValueError(f"unknown mask {mask!r}")


def consistency(recorded: DataFrame, again: DataFrame, row_id: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """How many rows were scored twice, how many of them differ, and the largest difference."""
    gap = F.abs(F.col("__a") - F.col("__b"))
    both = recorded.select(row_id, F.col(value).alias("__a")).join(again.select(row_id, F.col(value).alias("__b")), row_id)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap > tolerance).alias("n_different"), F.max(gap).alias("largest"))


def melted(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "Metric", "Value")


def subset_maxima(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(flag).agg(*[F.max(c).alias(f"max_{c}") for c in columns])
