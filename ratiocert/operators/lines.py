"""Exact quantiles of ``base + scale * factor + offset`` over all rows, for every point of a grid.

A row is a line in ``scale``; a grid point asks for order statistics of all lines at one place. Crossing rows with the grid would
evaluate rows x points values. Instead, whatever the number of different factors:

1. *Cells.* Rows are counted once into a bounded number of boxes of (factor, base), of about equal content: strips of the factor,
   and in each strip ranges of the base, both from mergeable sketches. A cell knows its count and its exact bounds.
2. *Search.* At each grid point the cells' bounds tell which cells lie below, above, or may hold the wanted rank.
3. *Histogram.* Where the rows of these cells are many, they are evaluated and counted in bins of the range that is left, which
   narrows that range; repeated until few rows are left in all. No row leaves its task for this.
4. *Ranks.* The rows left are ranked, equal values as one with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordering import values_at_ranks
from .quantiles import SMALL_ROWS, interpolated

# Cells: bounds what is read to the driver and sent to the tasks (some 3 MB).
MAX_CELLS = 1 << 16
MAX_RANGES = 4096  # of one strip
BINS = 64
MAX_PASSES = 12
# Points of a grid: they are broadcast, with as many lines a point as there are quantiles.
MAX_POINTS = 100_000
# (cell, line) pairs that are broadcast; more are joined by a shuffle.
SENT_HITS = 1 << 22


@dataclass(frozen=True)
class Cells:
    """Rows with ``__base``, ``__factor``, ``__cell`` and a weight ``__w``, and the summary of every cell."""

    boxed: DataFrame
    summary: pd.DataFrame
    n_rows: int


def _probes(n: int) -> Column:
    return F.array(*[F.lit(i / n) for i in range(1, n)])


def _edges(rows: DataFrame, max_cells: int, n_rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lower edges of the strips but the first, and of each strip's ranges but the first."""
    most = max(min(max_cells, n_rows), 1)
    n = min(math.isqrt(most), 1024)
    strips = np.zeros(0)
    if n > 1:
        strips = np.unique(rows.agg(F.percentile_approx("__factor", _probes(n), F.lit(10 * n))).first()[0])
    n = min(most // (len(strips) + 1), MAX_RANGES, 2 * math.isqrt(n_rows))
    if n < 2:
        return strips, [np.zeros(0)] * (len(strips) + 1)
    strip = _searched_column(strips, F.col("__factor"))
    found = rows.groupBy(strip.alias("s")).agg(F.percentile_approx("__base", _probes(n), F.lit(max(2 * n, 1000))).alias("e")).collect()
    ranges = {r["s"]: np.unique(r["e"]) for r in found}
    return strips, [ranges.get(s, np.zeros(0)) for s in range(len(strips) + 1)]


def _searched_column(edges: np.ndarray, value: Column) -> Column:
    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(), side="right").astype(np.int32))

    return place(value)


def _cell_column(strips: np.ndarray, ranges: list[np.ndarray], factor: Column, base: Column) -> Column:
    first = np.cumsum([0, *[len(r) + 1 for r in ranges]])

    @F.pandas_udf("int")
    def place(f: pd.Series, b: pd.Series) -> pd.Series:
        strip, b = np.searchsorted(strips, f.to_numpy(), side="right"), b.to_numpy()
        out = np.empty(len(b), np.int32)
        for s in np.unique(strip):
            at = strip == s
            out[at] = first[s] + np.searchsorted(ranges[s], b[at], side="right")
        return pd.Series(out)

    return place(factor, base)


def counted_cells(rows: DataFrame, base: str, factor: Column, max_cells: int = MAX_CELLS) -> Cells:
    """Rows in at most about ``max_cells`` cells; rows without base or factor are left out. ``rows`` should be stored."""
    placed = rows.withColumns({"__base": F.col(base).cast("double"), "__factor": factor.cast("double")}).where(
        "__base IS NOT NULL AND __factor IS NOT NULL"
    )
    n_rows = placed.count()
    if n_rows == 0:
        raise ValueError("no rows to take quantiles of")
    strips, ranges = _edges(placed, max_cells, n_rows)
    boxed = cut_lineage(placed.withColumn("__cell", _cell_column(strips, ranges, F.col("__factor"), F.col("__base"))))
    summary = boxed.groupBy("__cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("__base").alias("lo"), F.max("__base").alias("hi"),
        F.min("__factor").alias("f_lo"), F.max("__factor").alias("f_hi"),
    ).toPandas()
    return Cells(_with_weights(boxed, summary, n_rows), summary, n_rows)


def _with_weights(boxed: DataFrame, cells: pd.DataFrame, n_rows: int, share: int = 1000) -> DataFrame:
    """Adds ``__w``; equal rows of crowded cells, of which there are at most ``share``, become one row."""
    crowded = cells[(cells["n"] * share >= n_rows) & (cells["n"] > share)]["__cell"].tolist()
    if not crowded:
        return boxed.withColumn("__w", F.lit(1).cast("long"))
    hot = F.col("__cell").isin(crowded)
    merged = boxed.where(hot).groupBy(*boxed.columns).agg(F.count(F.lit(1)).alias("__w"))
    return cut_lineage(merged.unionByName(boxed.where(~hot).withColumn("__w", F.lit(1).cast("long"))))


def _bounds(cells: pd.DataFrame, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cells' values at one grid point, with room for rounding."""
    one, two = a * cells["f_lo"].to_numpy() + b, a * cells["f_hi"].to_numpy() + b
    lo, hi = cells["lo"].to_numpy(), cells["hi"].to_numpy()
    size = np.maximum.reduce([np.abs(lo), np.abs(hi), np.abs(one), np.abs(two), np.ones(len(lo))])
    return lo + np.minimum(one, two) - 1e-9 * size, hi + np.maximum(one, two) + 1e-9 * size


_SPOT = "__line int, __g int, __j int, below long, inside long, lo double, hi double, cells array<int>"


def _over_grid(grid: DataFrame, each) -> DataFrame:
    """``each(g, a, b)`` gives rows of ``_SPOT`` for a grid point; points are spread over tasks."""
    names = [f.name for f in T._parse_datatype_string(_SPOT).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for r in batch.to_dict("records") for row in each(r)]
            yield pd.DataFrame(rows, columns=names)

    spread = grid.repartition(min(max(grid.sparkSession.sparkContext.defaultParallelism, 1), 256))
    return spread.mapInPandas(run, _SPOT)


def _spots(grid: DataFrame, cells: pd.DataFrame, places: list[tuple[int, int]]) -> DataFrame:
    """Per grid point and pair of ranks: rows surely below, the range of the wanted values, and the cells that can hold them.

    The order statistic of a rank lies between the lower and the upper cell bounds at that rank, so cells that end
    below the former are below, and cells that begin above the latter are above.
    """
    counts = cells["n"].to_numpy("int64")
    ids = cells["__cell"].to_numpy("int32")

    def each(r: dict):
        low, high = _bounds(cells, r["__a"], r["__b"])
        by_low, by_high = np.argsort(low), np.argsort(high)
        upto_low, upto_high = np.cumsum(counts[by_low]), np.cumsum(counts[by_high])
        for j, (first, last) in enumerate(places):
            bottom = low[by_low[np.searchsorted(upto_low, first, side="right")]]
            top = high[by_high[np.searchsorted(upto_high, last, side="right")]]
            inside = (high >= bottom) & (low <= top)
            yield (r["__g"] * len(places) + j, r["__g"], j, int(counts[high < bottom].sum()), int(counts[inside].sum()),
                   float(bottom), float(top), ids[inside])

    return _over_grid(grid, each)


def _evaluated(boxed: DataFrame, lines: DataFrame, hits: DataFrame, grid: DataFrame, exact: Column) -> DataFrame:
    """(__line, __g, __j, lo, hi, __v, __w and the rows' columns) of every row in a cell that a line has marked.

    Lines and grid are as few as grid points; the marks are broadcast after counting them.
    """
    marked = boxed.join(hits, "__cell").withColumn("__line", F.explode("lines")).drop("lines")
    params = lines.select("__line", "__g", "__j", "lo", "hi").join(F.broadcast(grid), "__g")
    return marked.join(F.broadcast(params), "__line").withColumn("__v", exact)


def _hits(spots: DataFrame) -> DataFrame:
    """(__cell, lines): which lines have marked a cell."""
    marks = spots.select("__line", F.explode("cells").alias("__cell"))
    hits = cut_lineage(marks.groupBy("__cell").agg(F.collect_list("__line").alias("lines")))
    n = hits.agg(F.sum(F.size("lines"))).first()[0] or 0
    return F.broadcast(hits) if n <= SENT_HITS else hits


def _narrowed(lines: DataFrame, evaluated: DataFrame, ranks: DataFrame) -> DataFrame:
    """Lines with the range of the bins that hold the wanted ranks, and the rows below and inside."""
    width = F.col("hi") - F.col("lo")
    place = F.floor((F.col("__v") - F.col("lo")) / width * BINS)
    bin_ = F.when(F.col("__v") < F.col("lo"), -1).when(width <= 0, 0).otherwise(F.least(place, F.lit(BINS - 1))).cast("int")
    counted = evaluated.where(F.col("__v") <= F.col("hi")).groupBy("__line", bin_.alias("bin")).agg(
        F.sum("__w").alias("n"), F.min("__v").alias("v_lo"), F.max("__v").alias("v_hi")
    )
    upto = Window.partitionBy("__line").orderBy("bin")  # at most BINS + 1 rows a line
    placed = counted.join(F.broadcast(lines.select("__line", "__g", "__j", "below", "base_below")), "__line").join(F.broadcast(ranks), "__j")
    placed = placed.withColumn("end", F.col("base_below") + F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
    kept = placed.where("bin >= 0 AND begin <= last AND end > first")
    return kept.groupBy("__line", "__g", "__j").agg(
        F.min("begin").alias("below"), F.sum("n").alias("inside"), F.min("v_lo").alias("lo"), F.max("v_hi").alias("hi"),
        F.first("base_below").alias("base_below"),
    )


def candidates(counted: Cells, grid: DataFrame, exact: Column, ranks: list[tuple[int, int]], bins_above: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(lines, rows, n): the range of each line, the n evaluated rows in the ranges, which hold the wanted ranks.

    ``grid`` has ``__g``, ``__a`` and ``__b`` besides its own columns. Histograms narrow the ranges while more than ``bins_above``
    rows, by default as many as there are in all, would be left.
    """
    spark = grid.sparkSession
    spots = cut_lineage(_spots(grid.select("__g", "__a", "__b"), counted.summary, ranks))
    wanted = spark.createDataFrame([(j, a, b) for j, (a, b) in enumerate(ranks)], "__j int, first long, last long")
    hits = _hits(spots)
    lines = cut_lineage(spots.drop("cells").withColumn("base_below", F.col("below")))
    most = counted.n_rows if bins_above is None else bins_above
    left = None
    for _ in range(MAX_PASSES):
        n = lines.agg(F.sum(F.when(F.col("lo") < F.col("hi"), F.col("inside")))).first()[0] or 0
        if n <= most or n == left:
            break
        left = n
        lines = cut_lineage(_narrowed(lines, _evaluated(counted.boxed, lines, hits, grid, exact), wanted))
    rows = _evaluated(counted.boxed, lines, hits, grid, exact)
    if left is None:  # a histogram has counted the rows below its range; without one, those of the marked cells are counted here
        under = rows.where("__v < lo").groupBy("__line").agg(F.sum("__w").alias("under"))
        lines = cut_lineage(lines.join(F.broadcast(under), "__line", "left").withColumn("below", F.col("below") + F.coalesce("under", F.lit(0))))
    return lines, rows.where(F.col("__v").between(F.col("lo"), F.col("hi"))), int(n)


def order_statistics(counted: Cells, grid: DataFrame, exact: Column, ranks: list[tuple[int, int]], small_rows: int = SMALL_ROWS,
                     bins_above: int | None = None) -> DataFrame:
    """(__g, __j, side, value): the values at both ranks of each pair, for every grid point."""
    lines, rows, n = candidates(counted, grid, exact, ranks, bins_above)
    inside = rows.groupBy("__line", "__v").agg(F.sum("__w").alias("__n"))
    sides = F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), F.lit(rank).alias("rank"))
        for j, pair in enumerate(ranks) for side, rank in enumerate(pair)
    ])
    targets = lines.withColumn("s", F.explode(F.filter(sides, lambda s: s["j"] == F.col("__j")))).select(
        "__line", F.struct("__g", "__j", "s.side").alias("target"), (F.col("s.rank") - F.col("below")).alias("rank")
    )
    if n <= small_rows:
        # No line can hold more rows than that: a plain window ranks each.
        upto = Window.partitionBy("__line").orderBy("__v")
        found = inside.withColumn("__end", F.sum("__n").over(upto)).join(F.broadcast(targets), "__line").where(
            (F.col("rank") < F.col("__end")) & (F.col("rank") >= F.col("__end") - F.col("__n"))
        ).select("target", F.col("__v").alias("value"))
    else:
        found = values_at_ranks(inside, "__v", "__n", targets, ["__line"])
    return found.select("target.__g", "target.__j", "target.side", "value")


def numbered(grid: DataFrame, keys: Sequence[str], scale: Column, offset: Column) -> DataFrame:
    """The grid stored with ``__g``, ``__a`` and ``__b``; it is small, and more than ``MAX_POINTS`` points are an error."""
    grid = cut_lineage(grid)
    if grid.count() > MAX_POINTS:
        raise ValueError(f"a grid of more than {MAX_POINTS} points")
    place = Window.orderBy(*keys)
    return cut_lineage(grid.withColumns({"__a": scale.cast("double"), "__b": offset.cast("double")}).withColumn(
        "__g", (F.row_number().over(place) - 1).cast("int")
    ))


def grid_quantiles(rows: DataFrame, base: str, grid: DataFrame, keys: Sequence[str], scale: Column, offset: Column,
                   factor: Column, exact: Column, qs: Sequence[float], max_cells: int = MAX_CELLS, small_rows: int = SMALL_ROWS,
                   counted: Cells | None = None, bins_above: int | None = None) -> DataFrame:
    """(keys, q, quantile): exact quantiles of ``base + scale * factor + offset`` over all rows, for every grid point.

    ``scale`` and ``offset`` are columns of the grid, ``factor`` is one of the rows. ``exact`` gives the same value up to
    rounding, and is what the quantiles are taken of. ``counted`` passes the cells on between calls over the same rows.
    """
    counted = counted or counted_cells(rows, base, factor, max_cells)
    placed = [q * (counted.n_rows - 1) for q in qs]
    ranks = [(math.floor(p), min(math.floor(p) + 1, counted.n_rows - 1)) for p in placed]
    points = numbered(grid, keys, scale, offset)
    found = order_statistics(counted, points, exact, ranks, small_rows, bins_above)
    parts = grid.sparkSession.createDataFrame([(j, float(q), p - math.floor(p)) for j, (q, p) in enumerate(zip(qs, placed, strict=True))], "__j int, q double, frac double")
    named = found.join(F.broadcast(parts), "__j").join(F.broadcast(points.select("__g", *keys)), "__g")
    return interpolated(named.select(*keys, F.struct("q", "side", "frac").alias("target"), "value"), keys)


def rows_between(counted: Cells, points: DataFrame, exact: Column) -> DataFrame:
    """(__g, lo, hi, __v, __w and the rows' columns): rows whose value at a grid point lies in its range ``lo`` to ``hi``.

    ``points`` has ``__g``, ``__a``, ``__b``, ``lo`` and ``hi``; only rows of cells that reach into the range are evaluated.
    """
    ids, counts = counted.summary["__cell"].to_numpy("int32"), counted.summary["n"].to_numpy("int64")
    cells = counted.summary

    def each(r: dict):
        low, high = _bounds(cells, r["__a"], r["__b"])
        inside = (high >= r["lo"]) & (low <= r["hi"])
        yield r["__g"], r["__g"], 0, 0, int(counts[inside].sum()), r["lo"], r["hi"], ids[inside]

    spots = cut_lineage(_over_grid(points.select("__g", "__a", "__b", "lo", "hi"), each))
    found = _evaluated(counted.boxed, spots, _hits(spots), points.drop("lo", "hi"), exact)
    return found.where(F.col("__v").between(F.col("lo"), F.col("hi")))
