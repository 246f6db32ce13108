"""Token scores from arrays of logits, without leaving the JVM and without materialising probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def temperature(logits: Column, t: float) -> Column:
    if t == 0:
        raise ZeroDivisionError("temperature must be positive")
    return logits if t == 1.0 else F.transform(logits, lambda x: x / F.lit(float(t)))


def top_k_positions(logits: Column, k: int) -> Column:
    """1-based positions of the k largest logits; equal logits rank by position."""
    entries = F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), (i + 1).alias("pos")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: e["pos"])


def top_k_values(logits: Column, k: int) -> Column:
    """The logits that stay in the distribution. ``k <= 0`` keeps all of them."""
    if k <= 0:
        return logits
    return F.slice(F.reverse(F.array_sort(logits)), 1, k)


def log_normaliser(logits: Column) -> Column:
    """log sum exp, stabilised by the largest logit."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(logits))))


def token_loglik(logits: Column, token: Column, k: int = 0) -> Column:
    """Natural log-likelihood of the 0-based token; minus infinity where top-k removed it."""
    score = F.element_at(logits, (token + 1).cast("int")) - log_normaliser(top_k_values(logits, k))
    if k <= 0:
        return score
    kept = F.array_contains(top_k_positions(logits, k), (token + 1).cast("int"))
    return F.when(kept, score).otherwise(F.lit(float("-inf")))


def entropy(logits: Column, k: int = 0) -> Column:
    """-sum p log p over the kept logits, with 0 log 0 = 0."""
    kept = top_k_values(logits, k)
    norm = log_normaliser(kept)
    mean = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x * F.exp(x - F.array_max(kept)))
    mass = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(kept)))
    return norm - mean / mass


def masked(value: Column, token: Column, pad: int, eos: int) -> Column:
    """0 at padding and end tokens."""
    return F.when((token == pad) | (token == eos), F.lit(0.0)).otherwise(value)


def argmax(values: Column) -> Column:
    """0-based position of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def gather(values: Column, ids: list[int]) -> Column:
    """The entries at the given 0-based ids, such as the logits of the answer markers."""
    return F.array(*[F.element_at(values, i + 1) for i in ids])
