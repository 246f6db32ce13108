"""Exact quantiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import values_at_ranks

# Up to this many rows the built-in aggregate's map of distinct values is known to fit in memory.
SMALL_ROWS = 1_000_000
# Rank error of the sketches is 1 / SKETCH of the group.
SKETCH = 10_000
# Up to this many groups a table of group brackets is broadcast.
SMALL_GROUPS = 10_000


def _fractions(qs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(q)) for q in qs])


def interpolated(found: DataFrame, keys: Sequence[str], only: Column | None = None) -> DataFrame:
    """Two neighbouring order statistics per quantile to one number, in the steps of the built-in aggregate, so that both agree to the last digit."""
    low = F.max(F.when(F.col("target.side") == 0, F.col("value")))
    high = F.max(F.when(F.col("target.side") == 1, F.col("value")))
    frac = F.max("target.frac")
    out = found.groupBy(*keys, F.col("target.q").alias("q")).agg(
        F.when(low == high, low).otherwise((1 - frac) * low + frac * high).alias("quantile"), (F.lit(True) if only is None else only).alias("__keep")
    )
    return out.where("__keep").drop("__keep")


def _rank_targets(totals: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Rows (keys, target, rank) for the two order statistics around each quantile."""
    spread = totals.withColumn("q", F.explode(_fractions(qs)))
    place = F.col("q") * (F.col("total") - 1)
    low = F.floor(place)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), low.alias("rank")),
        F.struct(F.lit(1).alias("side"), F.least(low + 1, F.col("total") - 1).alias("rank")),
    )
    return spread.withColumn("s", F.explode(sides)).select(
        *keys,
        F.struct("q", F.col("s.side").alias("side"), (place - low).alias("frac")).alias("target"),
        F.col("s.rank").alias("rank"),
    )


def exact_quantiles(df: DataFrame, value: Column | str, qs: Sequence[float], group: Sequence[str] = (),
                    small_rows: int = SMALL_ROWS, sketch: int = SKETCH) -> DataFrame:
    """(group, q, quantile) rows. NULL values are left out.

    Small inputs (checked by a count) use the built-in aggregate. For larger ones a sketch of
    bounded size brackets each quantile, one pass counts the rows below the brackets, and only
    the few rows inside are ranked. The result is exact: should a bracket miss, all values are ranked.
    """
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(*group, column.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    if rows.count() <= small_rows:
        packed = rows.groupBy(*group).agg(F.percentile("__v", _fractions(qs)).alias("__p"))
        pairs = F.arrays_zip(_fractions(qs).alias("q"), F.col("__p").alias("quantile"))
        return packed.where(F.col("__p").isNotNull()).select(*group, F.inline(pairs).alias("q", "quantile"))
    found, n_groups = _bracketed_quantiles(rows, qs, group, sketch)
    if found.count() == n_groups * len(qs):
        return found
    return ranked_quantiles(rows, "__v", qs, group)


def ranked_quantiles(rows: DataFrame, value: str, qs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """The same by ranking all distinct values over a range partitioning; no task holds a whole group."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    return interpolated(values_at_ranks(counts, value, "__n", _rank_targets(totals, group, qs), group), group)


def _bracketed_quantiles(rows: DataFrame, qs: Sequence[float], group: Sequence[str], sketch: int) -> tuple[DataFrame, int]:
    """Quantiles whose bracket held, stored, and the number of groups."""
    margin = 2.0 / sketch
    lows, highs = [q - margin for q in qs], [q + margin for q in qs]
    probes = _fractions([min(max(p, 0.0), 1.0) for p in (*lows, *highs)])
    n = len(qs)
    low = [F.min("__v") if p <= 0 else None for p in lows]
    high = [F.max("__v") if p >= 1 else None for p in highs]
    sketched = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", probes, F.lit(sketch)).alias("__p"),
    )
    brackets = cut_lineage(sketched.select(
        *group, "total",
        *[(F.col("__min") if low[j] is not None else F.col("__p")[j]).alias(f"__lo{j}") for j in range(n)],
        *[(F.col("__max") if high[j] is not None else F.col("__p")[n + j]).alias(f"__hi{j}") for j in range(n)],
    ))
    n_groups = brackets.count()
    small = F.broadcast(brackets) if n_groups <= SMALL_GROUPS else brackets
    met = rows.join(small, list(group)) if group else rows.crossJoin(small)
    below = met.groupBy(*group).agg(
        F.max("total").alias("total"),
        *[F.count_if(F.col("__v") < F.col(f"__lo{j}")).alias(f"__b{j}") for j in range(n)],
    )
    inside = F.filter(
        F.array(*[F.when(F.col("__v").between(F.col(f"__lo{j}"), F.col(f"__hi{j}")), F.lit(j)) for j in range(n)]),
        lambda x: x.isNotNull(),
    )
    candidates = met.select(*group, "__v", F.explode(inside).alias("__j"))
    counts = candidates.groupBy(*group, "__j", "__v").agg(F.count(F.lit(1)).alias("__n"))
    base = F.element_at(F.array(*[F.col(f"__b{j}") for j in range(n)]), (F.col("__j") + 1))
    targets = below.select(
        *group, "total", F.posexplode(_fractions(qs)).alias("__j", "q"), *[f"__b{j}" for j in range(n)]
    ).withColumn("__base", base)
    place = F.col("q") * (F.col("total") - 1)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")),
        F.struct(F.lit(1).alias("side"), F.least(F.floor(place) + 1, F.col("total") - 1).alias("rank")),
    )
    wanted = targets.withColumn("s", F.explode(sides)).select(
        *group, "__j", F.struct("q", F.col("s.side").alias("side"), (place - F.floor(place)).alias("frac")).alias("target"),
        (F.col("s.rank") - F.col("__base")).alias("rank"),
    )
    both = F.count_distinct("target.side") == 2
    hits = values_at_ranks(counts, "__v", "__n", wanted, [*group, "__j"])
    return cut_lineage(interpolated(hits, group, both)), n_groups


def wide_quantiles(long: DataFrame, keys: Sequence[str], names: dict[float, str]) -> DataFrame:
    """One column per quantile."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == F.lit(float(q)), F.col("quantile"))).alias(n) for q, n in names.items()]
    )
