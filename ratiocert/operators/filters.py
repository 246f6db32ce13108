"""Row filters, seeded samples and order-based cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import same_start
from ..functions.seeded import seeded_key
from .ordering import first_in_order, row_positions
from .selection import nth_key, seeded_order, up_to

# The titles and subjects that count as medical.
MEDICAL_TITLES = [
    "Antibiotics", "Symbiosis", "Gene", "Brain", "Immunology", "Biodiversity", "Digestion",
    "Pharmaceutical_industry", "Mammal", "Nutrition", "Tuberculosis", "On_the_Origin_of_Species",
    "Asthma", "Pain", "Bacteria", "Infection", "Black_Death", "Pharmacy", "Immune_system", "Chloroplast",
]
MEDICAL_SUBJECTS = [
    "anatomy", "clinical_knowledge", "college_medicine", "college_biology", "college_chemistry",
    "high_school_biology", "high_school_chemistry", "high_school_psychology", "human_aging",
    "human_sexuality", "medical_genetics", "nutrition", "professional_medicine", "virology",
]
SUBJECTS = [
    "abstract_algebra", "anatomy", "astronomy", "business_ethics", "clinical_knowledge", "college_biology",
    "college_chemistry", "college_computer_science", "college_mathematics", "college_medicine",
    "college_physics", "computer_security", "conceptual_physics", "econometrics", "electrical_engineering",
    "elementary_mathematics", "formal_logic", "global_facts", "high_school_biology", "high_school_chemistry",
    "high_school_computer_science", "high_school_european_history", "high_school_geography",
    "high_school_government_and_politics", "high_school_macroeconomics", "high_school_mathematics",
    "high_school_microeconomics", "high_school_physics", "high_school_psychology", "high_school_statistics",
    "high_school_us_history", "high_school_world_history", "human_aging", "human_sexuality",
    "international_law", "jurisprudence", "logical_fallacies", "machine_learning", "management", "marketing",
    "medical_genetics", "miscellaneous", "moral_disputes", "moral_scenarios", "nutrition", "philosophy",
    "prehistory", "professional_accounting", "professional_law", "professional_medicine",
    "professional_psychology", "public_relations", "security_studies", "sociology", "us_foreign_policy",
    "virology", "world_religions",
]


def in_category(df: DataFrame, column: str, mode: str, members: Sequence[str]) -> DataFrame:
    """``mode``: ``all``, ``medical_qa`` (members only) or ``not_medical_qa``."""
    if mode == "all":
        return df
    inside = F.col(column).isin(list(members))
    if mode == "medical_qa":
        return df.where(inside)
    if mode == "not_medical_qa":
        return df.where(~inside)
    raise ValueError(f"unknown category mode {mode!r}")


def longer_than(df: DataFrame, column: str, minimum: int) -> DataFrame:
    """Strictly longer responses; 0 keeps everything."""
    return df.where(F.col(column) > minimum) if minimum > 0 else df


def required(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error where it has no row."""
    if not df.limit(1).count():
        raise ValueError(message)
    return df


def length_between(df: DataFrame, column: str, low: int | None, high: int | None) -> DataFrame:
    """Both ends included, either may be open."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df


def drop_top(df: DataFrame, n: int, value: str, tie: Sequence[str], scope: str = "all") -> DataFrame:
    """All rows but the ``n`` with the highest value (of the whole table, or of the out-of-domain rows).

    Of equal values, rows that come first by ``tie`` go first. The n-th key is found by counting; the rest is a filter.
    """
    if n <= 0:
        return df
    ranked = df if scope == "all" else df.where(F.col("ood") == 1)
    order = {"__value": -F.col(value), **{c: F.col(c) for c in tie}}
    edge = nth_key(ranked, order, n)
    later = F.lit(False) if edge is None else ~up_to(order, edge)
    return df.where(later if scope == "all" else (F.col("ood") == 0) | later)


def matching_prompt(df: DataFrame, expected: Column, stored: Column) -> DataFrame:
    return df.where(same_start(expected, stored))


def judged(df: DataFrame, decision: str, keep: str | None) -> DataFrame:
    if keep is None or keep.lower() in ("none", "all"):
        return df
    return df.where(F.col(decision) == keep)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order; all rows where ``n <= 0``."""
    return first_in_order(df, order, n) if n > 0 else df


def random_rows(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed."""
    return first_in_order(df, seeded_order(seeded_key(seed, F.col(row_id)), F.col(row_id)), n)


def seeded_split(df: DataFrame, row_id: str, n_train: int, seed: int, test: DataFrame | None = None) -> DataFrame:
    """Adds ``split``: the first ``n_train`` rows in the seeded order are ``train``, the rest ``val``.

    Only the key of the last training row is looked up, so no row moves. Rows of ``test``, from a source of their own, follow as ``test``.
    """
    order = seeded_order(seeded_key(seed, F.col(row_id)), F.col(row_id))
    edge = nth_key(df, order, n_train) if n_train > 0 else None
    train = F.lit(n_train > 0) if edge is None else up_to(order, edge)
    split = df.withColumn("split", F.when(train, "train").otherwise("val"))
    return split if test is None else split.unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def shuffled_split(df: DataFrame, row_id: str, n_train: int, seed: int, test: DataFrame | None = None) -> DataFrame:
    """As :func:`seeded_split`, and each row's ``position`` in the seeded order, for which the rows are ordered."""
    keyed = df.withColumn("__key", seeded_key(seed, F.col(row_id)))
    placed = row_positions(keyed, ["__key", row_id], "position").drop("__key")
    split = placed.withColumn("split", F.when(F.col("position") < n_train, "train").otherwise("val"))
    return split if test is None else split.unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
