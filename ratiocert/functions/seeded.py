"""Reproducible randomness: a keyed digest per row instead of a generator state.

A digest of (seed, id) does not depend on partitioning, retries or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *ids: Column) -> Column:
    """32 hex digits that order rows at random for the given seed."""
    parts: list[Column] = [F.lit(str(seed))]
    for item in ids:
        parts += [F.lit("|"), item.cast("string")]
    return F.md5(F.concat(*parts))


def seeded_int(seed: int | str, bound: Column, *ids: Column) -> Column:
    """A whole number in ``[0, bound)`` from the first 32 bits of the key."""
    return F.conv(F.substring(seeded_key(seed, *ids), 1, 8), 16, 10).cast("long") % bound
