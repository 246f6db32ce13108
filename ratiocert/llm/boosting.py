"""Gradient-boosted trees for a 0/1 label, small enough to send along with a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shelf

GRAIN = 2.0**-20  # of derivatives, which are added up as whole numbers
GRID = 2.0**-8  # of leaves and so of raw scores
MOST_STEP = 4.0  # of a leaf before the rate
ROWS_A_TASK = 50_000


@dataclass
class BoostedTrees:
    """Depth-``d`` trees as arrays over heap positions; a leaf's value is at position 2^d - 1 and on."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float
    slope: float = 1.0  # calibration of the sum: sigmoid(slope * sum + shift)
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.raw(x))

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def cut_points(quantiles: np.ndarray) -> np.ndarray:
    return np.unique(np.round(quantiles, 6))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Per value how many cuts of its feature are below it."""
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1).astype(np.uint8)


def level_sums(trees: BoostedTrees, feature: np.ndarray, border: np.ndarray, level: int, bins: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """First and second derivatives of the loss after ``trees``, summed in whole GRAINs by (node of the level, feature, bin)
    of the tree that grows; so the sums are the same in any order and however the rows are dealt out."""
    p = 1 / (1 + np.exp(-trees.raw(bins)))
    at, rows, n_features = np.zeros(len(bins), np.int64), np.arange(len(bins)), bins.shape[1]
    for _ in range(level):
        at = 2 * at + 1 + (bins[rows, feature[at]] > border[at])
    slot = ((at - (2**level - 1))[:, None] * n_features + np.arange(n_features)) * width + bins
    size = 2**level * n_features * width
    return np.stack([
        np.bincount(slot.ravel(), np.repeat(np.rint(d / GRAIN), n_features), size).astype(np.int64) for d in (y - p, np.maximum(p * (1 - p), 1e-6))
    ])


def grow(sums: Callable[[BoostedTrees, np.ndarray, np.ndarray, int], np.ndarray], cuts: list[np.ndarray], share: float, rounds: int,
         depth: int, rate: float, penalty: float) -> BoostedTrees:
    """Newton boosting of the logistic loss on ``sums`` (as :func:`level_sums`) of all rows, of which ``share`` have label 1; ties
    go to the first feature and the lowest cut. Leaves are whole GRIDs, so that raw scores are exact."""
    inner, n_features = 2**depth - 1, len(cuts)
    width = max(map(len, cuts)) + 1
    possible = np.arange(width - 1) < np.array([len(c) for c in cuts])[:, None]
    share = np.clip(share, 1e-3, 1 - 1e-3)
    trees = BoostedTrees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), _on_grid(np.log(share / (1 - share))))
    for _ in range(rounds):
        feature, border, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(depth):
            g, h = sums(trees, feature, border, level).reshape(2, 2**level, n_features, width) * GRAIN
            gs, hs = g[:, 0].sum(1), h[:, 0].sum(1)
            left_g, left_h = (np.cumsum(d, 2)[:, :, :-1] for d in (g, h))
            one, two = (gs[:, None, None], hs[:, None, None])
            gain = left_g**2 / (left_h + penalty) + (one - left_g) ** 2 / (two - left_h + penalty) - one**2 / (two + penalty)
            gain = np.where(possible, gain, -np.inf)
            for node in range(2**level):
                place, left = 2**level - 1 + node, (gs[node], hs[node])
                if gain[node].size and gain[node].max() > 1e-9:
                    f, k = np.unravel_index(np.argmax(gain[node]), gain[node].shape)
                    feature[place], border[place], left = f, k, (left_g[node, f, k], left_h[node, f, k])
                if level == depth - 1:
                    for side, (a, b) in enumerate((left, (gs[node] - left[0], hs[node] - left[1]))):
                        value[2 * node + side] = _on_grid(rate * np.clip(a / (b + penalty), -MOST_STEP, MOST_STEP))
        if not value.any():  # nor would it be in later rounds
            break
        trees = BoostedTrees(*(np.vstack([old, new]) for old, new in ((trees.feature, feature), (trees.cut, border), (trees.value, value))), trees.base)
    trees.cut = np.array([[cuts[f][int(k)] if np.isfinite(k) else np.inf for f, k in zip(*t, strict=True)] for t in zip(trees.feature, trees.cut, strict=True)]).reshape(-1, inner)
    return trees


def _on_grid(x: float) -> float:
    return float(np.rint(x / GRID) * GRID)


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32,
                penalty: float = 1.0) -> BoostedTrees:
    """Trees over quantile cuts of the rows at hand."""
    cuts = [cut_points(np.quantile(x[:, f], _shares(bins))) for f in range(x.shape[1])]
    coded, width = binned(x, cuts), max(map(len, cuts)) + 1
    return grow(lambda *t: level_sums(*t, coded, y, width), cuts, y.mean(), rounds, depth, rate, penalty)


def _shares(bins: int) -> list[float]:
    return np.linspace(0, 1, bins + 1)[1:-1].tolist()


def fit_boosted_rows(rows: DataFrame, n_features: int, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32,
                     penalty: float = 1.0) -> BoostedTrees:
    """The trees of :func:`fit_boosted` from all rows of a table (x array<double>, y double) that stays where it is.

    The cuts are exact quantiles of all rows. Each level of each tree is one pass that adds up derivatives; only these sums,
    2^level x features x bins, come to the driver.
    """
    shelf = Shelf()
    seen = rows.agg(F.count("*"), F.avg("y"), *[F.percentile(F.get("x", F.lit(f)), _shares(bins)) for f in range(n_features)]).first()
    cuts = [cut_points(np.array(q)) for q in seen[2:]]
    width = max(map(len, cuts)) + 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = binned(listed(batch.column("x"), n_features), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in coded], pa.binary()), batch.column("y")], names=["bins", "y"])

    coded = shelf.keep(rows.select("x", "y").mapInArrow(code, "bins binary, y double").repartition(-(-seen[0] // ROWS_A_TASK)))

    def sums(trees: BoostedTrees, feature: np.ndarray, border: np.ndarray, level: int) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2**level * n_features * width), np.int64)
            for batch in batches:
                own = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, n_features)
                total += level_sums(trees, feature, border, level, own, batch.column("y").to_numpy(), width)
            slot = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (slot, *total[:, slot])], names=["slot", "g", "h"])

        # The sums are few, so that one part is enough for them.
        parts = coded.mapInArrow(add, "slot bigint, g bigint, h bigint").repartition(1)
        found = parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        total = np.zeros((2, 2**level * n_features * width), np.int64)
        total[:, found["slot"].to_numpy()] = found["g"].to_numpy(), found["h"].to_numpy()
        return total

    trees = grow(sums, cuts, seen[1], rounds, depth, rate, penalty)
    shelf.drop(coded)
    return trees


def listed(x: pa.ListArray, n_features: int) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, n_features)


def calibrate(model: BoostedTrees, x: np.ndarray, y: np.ndarray, steps: int = 50) -> BoostedTrees:
    """Platt scaling on rows that were not fitted."""
    return calibrate_scores(model, model.raw(x), y, np.ones(len(y)), steps)


def calibrate_scores(model: BoostedTrees, s: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> BoostedTrees:
    """Platt scaling on raw scores with labels that occur ``n`` times each, by Newton steps with smoothed targets."""
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        w, r = n * np.maximum(p * (1 - p), 1e-9), n * (t - p)
        h = np.array([[np.sum(w * s * s) + 1e-6, np.sum(w * s)], [np.sum(w * s), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, [np.sum(r * s), np.sum(r)])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The lowest score at which rows not fitted (``n`` of each, or one) reach the precision; above 1 where none does."""
    n = np.ones(len(y)) if n is None else n
    order = np.argsort(-p, kind="stable")
    reached = np.cumsum((n * y)[order]) / np.cumsum(n[order])
    last_of_tie = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero((reached >= precision) & last_of_tie)
    return float(p[order][good[-1]]) if len(good) else 2.0
