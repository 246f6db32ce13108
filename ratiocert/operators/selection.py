"""The n-th row of an order without sorting: histograms of ever smaller ranges of the key.

Each pass counts the rows in the bins of a range and keeps the bin that holds the wanted rank, until few values are left. Bins are
counted map-side and only they reach the driver, so any n takes the same few passes, no task sees more than its own rows, and
nothing is shuffled but counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
# Values read to the driver once so few rows are left.
FEW = 2000


def _number_at(rows: DataFrame, value: str, rank: int):
    """The value of this rank (from 0) of a numeric column, and how many rows lie below it."""
    before, left = 0, rows
    whole = isinstance(rows.schema[value].dataType, T.IntegralType)
    n, lo, hi = left.agg(F.count("*"), F.min(value), F.max(value)).first()
    if not whole and (math.isinf(lo) or math.isinf(hi)):
        under, over = left.agg(F.count_if(F.col(value) == F.lit(-math.inf)), F.count_if(F.col(value) == F.lit(math.inf))).first()
        if rank < under or rank >= n - over:
            return (lo, 0) if rank < under else (hi, n - over)
        before, rows = under, rows.where(F.abs(value) < F.lit(math.inf))
        left = rows
        n, lo, hi = left.agg(F.count("*"), F.min(value), F.max(value)).first()
    while lo != hi:
        if n <= FEW:
            # Equal values count as one row with their number.
            for v, c in sorted(left.groupBy(value).count().collect()):
                if rank - before < c:
                    return v, before
                before += c
        half = not whole and math.isinf(hi - lo)
        place = F.col(value).cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)") if whole else F.col(value) / 2 - lo / 2 if half else F.col(value) - lo
        span = float(hi / 2 - lo / 2 if half else hi - lo)
        # Rounding never changes the order, so bins follow each other even where their borders are rounded.
        bin_ = F.least(F.floor(place.cast("double") / span * BINS), F.lit(BINS - 1))
        for _, c, low, high in sorted(left.groupBy(bin_.alias("b")).agg(F.count("*"), F.min(value), F.max(value)).collect()):
            if rank - before < c:
                n, lo, hi = c, low, high
                break
            before += c
        left = rows.where(F.col(value).between(lo, hi))
    return lo, before


def _text_at(rows: DataFrame, value: str, rank: int):
    """The same for a string column: the prefix that holds the rank grows by one character a pass."""
    before, left = 0, rows
    while True:
        n, lo, hi = left.agg(F.count("*"), F.min(value), F.max(value)).first()
        if lo == hi:
            return lo, before
        if n <= FEW:
            for v, c in sorted(left.groupBy(value).count().collect(), key=lambda r: r[0].encode()):
                if rank - before < c:
                    return v, before
                before += c
        shared = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
        here = F.substring(value, shared + 1, 1)
        for letter, c in sorted(left.groupBy(here.alias("b")).count().collect(), key=lambda r: r[0].encode()):
            if rank - before < c:
                left = left.where(here == letter)
                break
            before += c


def nth_key(df: DataFrame, order: dict[str, Column], n: int) -> list | None:
    """The key of the n-th row (from 1) in ascending order of the keys; None if there are no more than ``n`` rows.

    Keys are whole numbers, doubles or strings; a later key is looked at only among rows that agree on the earlier ones. Null and
    NaN keys are an error.
    """
    keys = df.select(*[c.alias(k) for k, c in order.items()])
    missing = F.lit(False)
    for k, kind in keys.dtypes:
        missing = missing | (F.col(k).isNull() | F.isnan(k) if kind in ("double", "float") else F.col(k).isNull())
    total, nulls = keys.agg(F.count("*"), F.count_if(missing)).first()
    if nulls:
        raise ValueError(f"{nulls} rows without a key")
    if total <= n:
        return None
    found, rank = [], n - 1
    for k in order:
        text = isinstance(keys.schema[k].dataType, T.StringType)
        value, before = (_text_at if text else _number_at)(keys, k, rank)
        found.append(value)
        rank -= before
        keys = keys.where(F.col(k) == F.lit(value))
    return found


def up_to(order: dict[str, Column], edge: list) -> Column:
    """Whether a row's key is not above the edge."""
    keep = F.lit(True)
    for c, value in reversed(list(zip(order.values(), edge, strict=True))):
        keep = (c < F.lit(value)) | ((c == F.lit(value)) & keep)
    return keep


def seeded_order(key: Column, row_id: Column) -> dict[str, Column]:
    """The order of a hex digest, then the id: the digest's first 60 bits as a number decide nearly always, in few passes."""
    return {"__bits": F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), "__key": key, "__id": row_id}
