"""Arithmetic on sequence log-likelihoods. Logs are base 2 unless a name says otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2)
LN10 = math.log(10)
LOG2_10 = math.log2(10)
LOG10_2 = math.log10(2)

# Distribution pairs for which a bound is defined (fixed values).
DISTRIBUTION_PAIRS = ["F(y|x)||G(y|x)", "F(x+y)||G(x+y)", "F(y|x)||G(y)"]


def total(values: Column) -> Column:
    """Sum of an array of token values (log-likelihoods or entropies)."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def to_log2(natural: Column) -> Column:
    return natural / F.lit(LN2)


def to_log10(natural: Column) -> Column:
    return natural / F.lit(LN10)


def response_length(sequence_length: Column, n_prompt: Column, count_eos: bool = True) -> Column:
    """Response tokens; analysis counts the end token, the gate does not."""
    length = sequence_length - n_prompt
    return length if count_eos else length - F.lit(1)


def positive(length: Column) -> Column:
    """The length, failing the job where it is not positive."""
    return F.when(length > 0, length).otherwise(
        F.raise_error(F.lit("a response must have at least one token")).cast("long")
    )


def log_ratio(ll2_model: Column, ll2_generator: Column) -> Column:
    return ll2_model - ll2_generator


def per_token(value: Column, n: Column) -> Column:
    """NULL for a response without tokens."""
    return F.when(n > 0, value / n)


def log2_draws(draws: Column | int) -> Column:
    return F.log2(draws.cast("double")) if isinstance(draws, Column) else F.lit(math.log2(draws))


def upper_bound(ll2_generator: Column, n: Column, draws: Column | int, k: Column) -> Column:
    """Certified log2 bound on the probability of the response within ``draws`` attempts."""
    return ll2_generator + log2_draws(draws) + k * n


def accepts(ratio: Column, n: Column, k: Column) -> Column:
    """The gate's test: inclusive, and without the number of draws."""
    return ratio <= k * n


def rejects(ratio_per_token: Column, k: Column) -> Column:
    """The same boundary in the analysis: strictly above the threshold."""
    return ratio_per_token > k


def constriction(ll2_model: Column, bound: Column, base: str = "log10") -> Column:
    """How far the bound lies below the model's own likelihood, in the wanted base."""
    ratio = ll2_model - bound
    if base == "log2":
        return ratio
    if base == "log10":
        return ratio / F.lit(LOG2_10)
    if base == "ln":
        return ratio / F.lit(math.log2(math.e))
    if base == "probability":
        return F.pow(F.lit(2.0), ratio)
    raise ValueError(f"unknown base {base!r}")


def eps_log2(log10_eps: Column) -> Column:
    return log10_eps / F.lit(LOG10_2)


def bounded_probability(bound: Column) -> Column:
    """2**bound where it lies in (1e-300, 10000), and 2e-300 where it does not (fixed values)."""
    p = F.pow(F.lit(2.0), bound)
    return F.when((p > F.lit(1e-300)) & (p < F.lit(10000.0)), p).otherwise(F.lit(2e-300))


def certified_tokens(ll_model: Column, ll_generator: Column) -> Column:
    """Token count of a draw, leaving out a final end token that is masked under both models."""
    masked = (F.element_at(ll_model, -1) == 0.0) & (F.element_at(ll_generator, -1) == 0.0)
    return F.size(ll_model).cast("long") - F.coalesce(masked, F.lit(False)).cast("long")


def prompt_length(mode: str, from_data: Column) -> Column:
    """``mode`` is ``"dataset"`` for the stored length, or a whole number for a constant."""
    return from_data.cast("long") if mode == "dataset" else F.lit(int(mode)).cast("long")


def distributions_label(model: Column, generator: Column) -> Column:
    return F.format_string("F(%s)||G(%s)", model, generator)


def known_distributions(label: Column) -> Column:
    return label.isin(DISTRIBUTION_PAIRS)


def ood_flag(dataset: Column, in_domain: Sequence[str]) -> Column:
    return (~dataset.isin(list(in_domain))).cast("int")


def domain_label(ood: Column, target: str = "Target Domain", other: str = "Other") -> Column:
    return F.when(ood == 0, F.lit(target)).when(ood == 1, F.lit(other))


def dataset_name(config: Column) -> Column:
    """Identifier of a data set from its settings struct (name, categories, n_shot, modality, task, topic, directory)."""
    name = config["name"]
    return (
        F.when(name == "squad", F.concat_ws("_", name, config["categories"]))
        .when(name == "mmlu", F.concat_ws("_", name, config["categories"], config["n_shot"].cast("string")))
        .when(name == "task_data", F.concat_ws("_", name, config["modality"], config["task"]))
        .when(name == "sentences", config["topic"])
        .when(name == "from_file", F.concat_ws("_", F.lit("DatasetFromFile"), config["directory"], F.lit("test")))
        .otherwise(name)
    )
