"""Joins that replace positional merging; every side carries an explicit index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.prompts import same_start
from ..functions.seeded import seeded_key
from .lookup import checked_broadcast
from .ordering import first_in_order
from .selection import seeded_order


def with_generated(base: DataFrame, generated: DataFrame, idx: str, prefix: str | None = None,
                   keep_decision: str | None = None, strict: bool = False) -> DataFrame:
    """Answers replaced by generated ones where prompt and decision fit.

    ``base``: idx, question, answer. ``generated``: idx, prompt_text, generated_text, decision.
    The inner join cuts the base to the generated side; ``strict`` demands equal counts instead.
    """
    if strict and base.count() != generated.count():
        raise ValueError("generated results and base rows differ in number")
    question = F.concat(F.lit("Question: "), F.col("question"))
    if prefix is not None:
        question = F.concat(F.lit(prefix + "\n\n"), question)
    elif strict:
        question = F.concat(question, F.lit("\n"))
    joined = base.join(generated, idx)
    keep = same_start(question, F.col("prompt_text"))
    if keep_decision is not None and keep_decision.lower() not in ("none", "all"):
        keep = keep & (F.col("decision") == keep_decision)
    return joined.where(keep).withColumn("answer", F.col("generated_text")).drop("generated_text")


def with_response_length(base: DataFrame, lengths: DataFrame, row_id: str) -> DataFrame:
    return base.join(lengths, row_id)


def benchmark_with_scores(bench: DataFrame, scores: DataFrame, idx: str = "idx") -> DataFrame:
    """Benchmark rows with their likelihood row; questions without one are cut."""
    return bench.join(scores, idx)


def parameter_grid(*parts: DataFrame) -> DataFrame:
    """Cartesian product of small parameter lists."""
    grid = parts[0]
    for part in parts[1:]:
        grid = grid.crossJoin(F.broadcast(part))
    return grid


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def shuffled_collection(parts: Sequence[DataFrame], row_id: str, seed: int, n: int | None = None) -> DataFrame:
    """All parts stacked, in seeded order, cut to ``n`` rows; asking for more rows than there are is an error."""
    stack = stacked([p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    key = seeded_key(seed, F.col("part"), F.col(row_id))
    if n is None:
        return stack.orderBy(key, "part", row_id)
    order = seeded_order(key, F.col("part")) | {"__row": F.col(row_id)}
    available = stack.count()
    if n > available:
        raise ValueError(f"{n} rows requested, {available} available")
    return first_in_order(stack, order, n)


def without_copies(df: DataFrame, row_id: str, by: Sequence[str]) -> DataFrame:
    """One row per value of ``by``, with the smallest id and the number of ``copies``."""
    return df.groupBy(*by).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies"))


def with_threshold(rows: DataFrame, ks: DataFrame, grid_id: str = "grid_id") -> DataFrame:
    """Rows with the threshold of their grid point, joined on the point's number and never on a float."""
    return rows.join(checked_broadcast(ks), grid_id)


def not_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def flattened_config(config: DataFrame) -> DataFrame:
    """Struct fields to dotted top-level columns."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for field in schema.fields:
            here = (*path, field.name)
            out += leaves(field.dataType, here) if isinstance(field.dataType, T.StructType) else [here]
        return out

    return config.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(config.schema, ())]
    )


def with_config(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Every row with the run configuration, which must have exactly one row."""
    flat = flattened_config(config)
    if flat.limit(2).count() != 1:
        raise ValueError("a run has exactly one configuration")
    return rows.crossJoin(F.broadcast(flat))


def worked_examples(examples: DataFrame, shots: int, idx: str = "idx") -> DataFrame:
    """(subject, __shots): the texts of each subject's first examples, in order.

    The rank filter works before the shuffle too, so a subject that makes up much of the examples
    is never collected whole.
    """
    solved = P.multiple_choice(F.col("question"), F.col("choices"), F.col("answer"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(idx))
    first = examples.select("subject", idx, solved.alias("text")).withColumn("rn", rank).where(F.col("rn") <= shots)
    return first.groupBy("subject").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(idx, "text"))), lambda s: s["text"]).alias("__shots")
    )


def few_shot_prompts(items: DataFrame, examples: DataFrame, shots: int, idx: str = "idx") -> DataFrame:
    """Adds ``prompt``: the item after its subject's first ``shots`` worked examples.

    Both sides: idx, question, subject, choices, answer. The few examples per subject reach the items by
    broadcast where their number allows.
    """
    item = P.multiple_choice(F.col("question"), F.col("choices"))
    if shots == 0:
        return items.withColumn("prompt", P.few_shot(F.col("subject"), F.array().cast("array<string>"), item))
    joined = items.join(checked_broadcast(worked_examples(examples, shots, idx)), "subject")
    return joined.withColumn("prompt", P.few_shot(F.col("subject"), F.col("__shots"), item)).drop("__shots")
