"""Searching all rows for a stated set of queries: bounded slices of the queries, and the best rows of each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """Per group the k rows of highest score seen so far; equal scores by ascending id."""

    def __init__(self, groups: int, k: int):
        self.score = np.full((groups, k), _LOW)
        self.id = np.full((groups, k), _HIGH)

    def may_enter(self, groups: slice | np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of ``score`` (groups x rows) would be among the best of their group."""
        worst, worst_id = self.score[groups, -1][:, None], self.id[groups, -1][:, None]
        return (score > worst) | ((score == worst) & (ids < worst_id))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        k = self.score.shape[1]
        touched = np.unique(group)
        group = np.concatenate([np.repeat(touched, k), group])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        # The complement of a score falls as the score rises, and unlike its negative always fits.
        order = np.lexsort((ids, ~score, group))
        group = group[order]
        first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        keep = place < k
        self.score[group[keep], place[keep]] = score[order][keep]
        self.id[group[keep], place[keep]] = ids[order][keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, id) of all rows held."""
        group, place = np.nonzero(self.score != _LOW)
        return group, self.score[group, place], self.id[group, place]


def best_rows(found: DataFrame, keys: Sequence[str], score: str, row_id: str, k: int, parts: int = 64) -> DataFrame:
    """``found`` reduced to the k best rows of each key, with their ``rank`` from 1.

    Each key's rows are reduced in ``parts`` groups first, so that no task sorts what all tasks have found for one key.
    """
    order = (F.col(score).desc(), F.col(row_id))
    some = Window.partitionBy(*keys, "__part").orderBy(*order)
    every = Window.partitionBy(*keys).orderBy(*order)
    dealt = found.withColumn("__part", F.pmod(F.xxhash64(row_id), F.lit(parts)))
    fewer = dealt.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank", "__part")
    return fewer.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)


def sliced(rows: DataFrame, key: str, weight: str, most: int) -> tuple[DataFrame, int]:
    """``rows`` stored with a ``slice``, and the number of slices, each of a total weight of at most ``most``.

    Weights are counted per slice and their number doubled until that holds, so that a slice may be sent to all tasks. A
    row that is heavier alone is the only one exempt.
    """
    stored = cut_lineage(rows)
    total, largest = stored.agg(F.sum(weight), F.max(weight)).first()
    n = max(1, -(-(total or 0) // most))
    while True:
        dealt = stored.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(n)))
        held = dealt.groupBy("slice").agg(F.sum(weight).alias("w"), F.count("*").alias("c"))
        if (held.where("c > 1").agg(F.max("w")).first()[0] or 0) <= max(most, 2 * (largest or 0)):
            return dealt, n
        n *= 2
