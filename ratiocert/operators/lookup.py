"""Looking up rows of a keyed table when a few keys make up much of the probing side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .selection import nth_key

# A key with at least 1/HOT_SHARE of the weight is hot; there can be no more than HOT_SHARE of them.
HOT_SHARE = 1000


MOST_BROADCAST = 100_000  # short rows


def few(stored: DataFrame) -> bool:
    """Whether a stored table's rows are few enough to be broadcast."""
    return stored.count() <= MOST_BROADCAST


def checked_broadcast(df: DataFrame, max_rows: int = MOST_BROADCAST) -> DataFrame:
    """``df`` stored, and marked for broadcast only if its rows are few; a plain join side beyond that."""
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def hot_rows(table: DataFrame, weight: str, share: int = HOT_SHARE) -> DataFrame:
    """Table rows whose weight is at least 1/share of the total: at most ``share`` rows."""
    total = table.agg(F.sum(weight).alias("__total"))
    return table.crossJoin(F.broadcast(total)).where(F.col(weight) * share >= F.col("__total")).drop("__total")


# A stored table of up to this many short rows is broadcast whole.
SMALL_TABLE = 200_000


def frequent_rows(table: DataFrame, weight: str, most: int = SMALL_TABLE) -> tuple[DataFrame, DataFrame | None]:
    """The rows of greatest weight, ``most`` at most, and the others: none (``None``) where the table holds no more.

    ``table`` should be stored. Rows of the ``most``-th weight are among the others, as there may be any number of them.
    """
    edge = nth_key(table, {"__w": -F.col(weight)}, most)
    if edge is None:
        return table, None
    return table.where(-F.col(weight) < F.lit(edge[0])), table.where(-F.col(weight) >= F.lit(edge[0]))


def spread_left_join(probe: DataFrame, table: DataFrame, key: str, values: Sequence[str], weight: str,
                     spread: Column, share: int = HOT_SHARE, small_rows: int = SMALL_TABLE) -> DataFrame:
    """Left join on a string key in one pass over the probe; ``table`` should be stored.

    A table that is small, which is counted first, is broadcast. Beyond that, hot keys, whose number is bounded by their definition, are answered from a broadcast. Their
    rows then go through the shuffle under a key of their own (``spread``), so that no
    partition receives a hot key.
    """
    if table.count() <= small_rows:
        return probe.join(F.broadcast(table.select(key, *values)), key, "left").select(*probe.columns, *values)
    hot = hot_rows(table, weight, share).select(
        F.col(key).alias("__hk"), F.struct(*values).alias("__hot")
    )
    cold = table.select(F.col(key).alias("__ck"), F.struct(*values).alias("__cold"))
    first = probe.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left").withColumn(
        "__jk",
        F.when(F.col("__hk").isNotNull(), F.concat(F.lit("\u0000"), spread.cast("string"))).otherwise(F.col(key)),
    )
    both = first.join(cold, F.col("__jk") == F.col("__ck"), "left")
    found = F.coalesce("__hot", "__cold")
    return both.select(*probe.columns, *[found[v].alias(v) for v in values])
