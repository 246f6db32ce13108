"""Scoring rows by the rule of their data set, all in one plan.

A scorer adds a struct of checks to a table. Rows of several data sets are scored together: each scorer sees the text of its own
rows and null elsewhere, so the table is read once however many data sets it holds, and the checks come back as one map column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tasks as T
from .tasks import scored_sequences


@dataclass(frozen=True)
class Scorer:
    """``checks(rows, response, target)`` adds a struct column ``check``; ``missing`` is what a check counts as where it is null."""

    checks: Callable[[DataFrame, str, str], DataFrame]
    missing: dict[str, float]


SCORERS: dict[str, Scorer] = {}


def register_scorer(dataset: str, checks: Callable[[DataFrame, str, str], DataFrame], missing: dict[str, float] | None = None) -> None:
    """Makes ``checks`` the rule for rows of this data set."""
    SCORERS[dataset] = Scorer(checks, missing or {})


def task_checks(n_int: int, n_char: int, modality: str = "mixed") -> Callable[[DataFrame, str, str], DataFrame]:
    """The checks of a completed task sequence; there is no target, as the sequence holds its own task."""
    return lambda rows, response, target: scored_sequences(rows, response, n_int, n_char, modality)


def answer_checks(rows: DataFrame, response: str, target: str) -> DataFrame:
    """A response that ends with its target, that has as many words, and the share of words that agree in place."""
    given, wanted = F.split(F.trim(response), r"\s+"), F.split(F.trim(target), r"\s+")
    end = F.substring(response, F.greatest(F.length(response) - F.length(target) + 1, F.lit(1)), F.length(response))
    return rows.withColumn("check", F.struct(
        (end == F.col(target)).alias("ends_with_target"), (F.size(given) == F.size(wanted)).alias("lengths_match"),
        T.agreement(wanted, given).alias("word_match"),
    ))


def scored_items(rows: DataFrame, dataset: str, response: str, target: str, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """Adds ``scores``: check name to number, by the scorer of the row's data set; a data set without one fails the job."""
    scorers = SCORERS if scorers is None else scorers
    # Under names of their own, so that no column of the rows clashes with a scorer's.
    inner = {c: f"__in{i}" for i, c in enumerate(rows.columns)}
    name_of, out = F.col(inner[dataset]), rows.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    scores: Column = F.lit(None).cast("map<string,double>")
    for i, (name, scorer) in enumerate(sorted(scorers.items())):
        own = name_of == name
        mine = out.withColumns({"__response": F.when(own, F.col(inner[response])), "__target": F.when(own, F.col(inner[target]))})
        out = scorer.checks(mine, "__response", "__target").withColumnRenamed("check", f"__check{i}").drop("__response", "__target")
        fields = [f.name for f in out.schema[f"__check{i}"].dataType.fields]
        named = [x for f in fields for x in (F.lit(f), F.col(f"__check{i}.{f}").cast("double"))]
        scores = F.when(own, F.create_map(*named)).otherwise(scores)
    unknown = F.raise_error(F.concat(F.lit("no scorer for data set "), F.coalesce(name_of, F.lit("NULL")))).cast("map<string,double>")
    known = F.coalesce(name_of.isin(sorted(scorers)), F.lit(False))
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], F.when(known, scores).otherwise(unknown).alias("scores"))


def aggregate_scores(scored: DataFrame, dataset: str, scorers: dict[str, Scorer] | None = None) -> DataFrame:
    """(dataset, check, n, mean) over scored rows; a null check counts as its scorer's ``missing`` value, 0 where none is set."""
    scorers = SCORERS if scorers is None else scorers
    filled = F.col("value")
    other = F.lit(0.0)
    for name, scorer in scorers.items():
        for check, value in scorer.missing.items():
            other = F.when((F.col(dataset) == name) & (F.col("check") == check), F.lit(float(value))).otherwise(other)
    # An inner explode would have the optimiser filter for non-empty maps below all checks, which repeats each check's expressions there.
    long = scored.select(dataset, F.explode_outer("scores").alias("check", "value")).where(F.col("check").isNotNull())
    return long.groupBy(dataset, "check").agg(F.count("*").alias("n"), F.avg(F.coalesce(filled, other)).alias("mean"))
