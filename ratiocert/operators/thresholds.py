"""Counting rows on either side of many thresholds in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def confusion(reject: Column, ood: Column) -> list[Column]:
    """True/false negatives/positives of rejection against the out-of-domain flag."""
    cells = {"tn": (~reject) & (ood == 0), "fp": reject & (ood == 0), "fn": (~reject) & (ood == 1), "tp": reject & (ood == 1)}
    return [F.count_if(condition).alias(name) for name, condition in cells.items()]


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def rates() -> list[Column]:
    """FRR, TRR, FAR and Youden's J from the four counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    frr, trr, far = ratio_or_zero(fp, fp + tn), ratio_or_zero(tp, tp + fn), ratio_or_zero(fn, fn + tp)
    return [frr.alias("FRR"), trr.alias("TRR"), far.alias("FAR"), (trr - frr).alias("J")]


# Thresholds are read to the driver; a grid is chosen by the caller and does not grow with the data.
MAX_THRESHOLDS = 100_000


def bucketed_sums(rows: DataFrame, grid: DataFrame, k: str, value: str, measures: dict[str, Column],
                  by: Sequence[str] = ()) -> DataFrame:
    """The grid's rows (times the groups), each measure summed over rows with ``value <= k`` and over all rows.

    Every row is put between its two neighbouring thresholds by binary search, counted once, and the counts are accumulated over
    the thresholds. Thresholds meet their sums on the number of their bucket, never on a float. More than ``MAX_THRESHOLDS``
    different ones are an error. The negated value is bucketed because buckets include their left edge, as acceptance does.
    """
    grid = cut_lineage(grid)  # the same doubles for every use below
    ks = sorted(row[0] for row in grid.select(k).distinct().limit(MAX_THRESHOLDS + 1).collect())
    if len(ks) > MAX_THRESHOLDS:
        raise ValueError(f"more than {MAX_THRESHOLDS} thresholds")
    splits = [float("-inf"), *[-x for x in reversed(ks)], float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="__x", outputCol="__b")

    def placed(df: DataFrame, column: str) -> DataFrame:
        return bucket.transform(df.withColumn("__x", -F.col(column))).withColumn("__bucket", F.col("__b").cast("int")).drop("__x", "__b")

    sums = placed(rows, value).groupBy(*by, "__bucket").agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    # Few rows: thresholds x groups. Every (group, bucket) gets a row so that running sums have no gaps.
    steps = rows.sparkSession.range(0, len(ks) + 1, 1, 1).select(F.col("id").cast("int").alias("__bucket"))
    frame = sums.select(*by).distinct().crossJoin(F.broadcast(steps)) if by else steps
    filled = frame.join(sums, [*by, "__bucket"], "left")
    above = Window.partitionBy(*by).orderBy(F.col("__bucket").desc())
    everything = Window.partitionBy(*by)
    columns = []
    for n in measures:
        value_or_0 = F.coalesce(F.col(n), F.lit(0))
        columns += [
            F.sum(value_or_0).over(above).alias(f"{n}_accepted"),
            F.sum(value_or_0).over(everything).alias(f"{n}_all"),
        ]
    found = filled.select(*by, "__bucket", *columns)
    return found.join(F.broadcast(placed(grid, k)), "__bucket").drop("__bucket")


def curve_confusion(rows: DataFrame, grid: DataFrame, k: str, value: str, ood: str) -> DataFrame:
    """The grid's rows with tn, fp, fn, tp at each threshold, from one pass."""
    measures = {
        "id": F.when(F.col(ood) == 0, 1).otherwise(0).cast("long"),
        "od": F.when(F.col(ood) == 1, 1).otherwise(0).cast("long"),
    }
    sums = bucketed_sums(rows, grid, k, value, measures)
    return sums.select(
        *grid.columns,
        F.col("id_accepted").alias("tn"),
        (F.col("id_all") - F.col("id_accepted")).alias("fp"),
        F.col("od_accepted").alias("fn"),
        (F.col("od_all") - F.col("od_accepted")).alias("tp"),
    )


def rejected_counts(rows: DataFrame, grid: DataFrame, k: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The grid's rows (times the groups) with how many rows are ``rejected`` above the threshold, of ``n``; null values are not."""
    one = F.lit(1).cast("long")
    known = rows.where(F.col(value).isNotNull())
    sums = bucketed_sums(known, grid, k, value, {"rows": one}, by)
    return sums.select(*by, *grid.columns, (F.col("rows_all") - F.col("rows_accepted")).alias("rejected"), F.col("rows_all").alias("n"))
