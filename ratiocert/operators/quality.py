"""Rules a scoring record must obey, reported as counts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoring_record_rules() -> dict[str, Column]:
    """Rule name to the condition that breaks it."""
    n = F.size("input_ids")
    return {
        "missing_field": F.col("question").isNull() | F.col("subject").isNull() | F.col("choices").isNull(),
        "unequal_lengths": (n != F.size("attention_mask")) | (n != F.size("labels")),
        "wrong_length": n != F.col("length"),
        "few_choices": F.size("choices") < 2,
        "null_choice": F.exists("choices", lambda c: c.isNull()),
        "answer_out_of_range": (F.col("correct_answer_id") < 0) | (F.col("correct_answer_id") >= F.size("choices")),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) with a row for every rule, from one pass."""
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def valid_only(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = F.lit(False)
    for condition in rules.values():
        broken = broken | F.coalesce(condition, F.lit(False))
    return df.where(~broken)
