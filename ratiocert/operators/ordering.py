"""Positions and running sums over a whole table, without a window that puts it into one task.

Rows are range-partitioned by the order once and stored; partition totals are few
(one row per partition and group) and give every partition its starting value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .selection import nth_key, up_to

PART = "__part"


def ranged(df: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """``df`` range-partitioned by group and order and stored, with its partition number."""
    placed = df.repartitionByRange(*[F.col(c) for c in (*group, *order)])
    return cut_lineage(placed.withColumn(PART, F.spark_partition_id()))


def part_offsets(parts: DataFrame, amount: str, group: Sequence[str] = ()) -> DataFrame:
    """Total and start of each (group, partition): as many rows as partitions hold groups."""
    totals = parts.groupBy(*group, PART).agg(F.sum(amount).alias("part_total"))
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("part_start", F.coalesce(F.sum("part_total").over(before), F.lit(0)))


def running_start(df: DataFrame, order: Sequence[str], amount: str, group: Sequence[str] = (),
                  name: str = "start") -> DataFrame:
    """Adds the sum of ``amount`` over all earlier rows of the group.

    ``order`` should be unique within a group; equal keys fall into one partition and get
    an arbitrary order among themselves.
    """
    parts = ranged(df, order, group)
    offsets = part_offsets(parts, amount, group).drop("part_total")
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.join(offsets, [*group, PART])
        .withColumn(name, F.col("part_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop(PART, "part_start")
    )


def row_positions(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Adds the 0-based position of each row in the order."""
    counted = df.withColumn("__one", F.lit(1).cast("long"))
    return running_start(counted, order, "__one", name=name).drop("__one")


def first_in_order(df: DataFrame, order: dict[str, Column] | Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order, which must be total; ``order`` names columns or gives expressions.

    The n-th key is found by counting; the rows are a filter of ``df``, in no particular order, for any ``n``.
    """
    exprs = order if isinstance(order, dict) else {c: F.col(c) for c in order}
    if n <= 0:
        return df.where(F.lit(False))
    edge = nth_key(df, exprs, n)
    return df if edge is None else df.where(up_to(exprs, edge))


def values_at_ranks(counts: DataFrame, value: str, count: str, targets: DataFrame,
                    group: Sequence[str] = ()) -> DataFrame:
    """The value at each wanted 0-based rank, from (group, value, count) rows.

    ``targets`` has the group columns, ``target`` and ``rank``. Only the partitions that hold
    a wanted rank are sorted; a group may span any number of partitions.
    """
    parts = ranged(counts.select(*group, F.col(value).alias("__v"), F.col(count).alias("__n")), ["__v"], group)
    offsets = part_offsets(parts, "__n", group)
    within = (F.col("rank") >= F.col("part_start")) & (F.col("rank") < F.col("part_start") + F.col("part_total"))
    joined = offsets.join(targets, list(group)) if group else offsets.crossJoin(targets)
    hits = joined.where(within).select(*group, PART, "part_start", "target", "rank")
    needed = hits.select(*group, PART, "part_start").distinct()
    upto = Window.partitionBy(*group, PART).orderBy("__v")
    local = (
        parts.join(needed, [*group, PART])
        .withColumn("__end", F.col("part_start") + F.sum("__n").over(upto))
        .withColumn("__begin", F.col("__end") - F.col("__n"))
        .drop("part_start")
    )
    found = local.join(hits, [*group, PART]).where(
        (F.col("rank") >= F.col("__begin")) & (F.col("rank") < F.col("__end"))
    )
    return found.select(*group, "target", F.col("__v").alias("value"))


def row_after(df: DataFrame, key: str, turn: str, columns: dict[str, str]) -> DataFrame:
    """Columns of the row whose turn follows directly; an equi-join on both keys, so long keys spread out."""
    following = df.select(
        F.col(key), (F.col(turn) - 1).alias(turn), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return df.join(following, [key, turn])


def sequence_grid(spark, n: int, low: float | Column, high: float | Column, name: str) -> DataFrame:
    """``n`` evenly spaced values as a small table with a 0-based id."""
    low_c = low if isinstance(low, Column) else F.lit(float(low))
    step = (high - low) / (n - 1) if not isinstance(low, Column) else (F.lit(float(high)) - low) / F.lit(float(n - 1))
    step_c = step if isinstance(step, Column) else F.lit(float(step))
    return spark.range(0, n, 1, 1).select(
        F.col("id").cast("int").alias("grid_id"), (low_c + F.col("id").cast("double") * step_c).alias(name)
    )
