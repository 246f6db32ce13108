"""The synthetic task corpus: sequences, solutions, deduplication and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tasks as T
from ..functions.seeded import seeded_int
from ..operators.ordering import first_in_order, row_positions
from ..session import scratch_path


def settings_path(modality: str, task: str, max_length: int, n_int: int, n_char: int, constant: bool) -> str:
    """Folder name of a corpus with these settings (fixed format)."""
    return f"MOD_{modality}_TASK_{task}_LEN_{max_length}_INT_{n_int}_CHAR_{n_char}_CSL_{constant}"


def sequence_length(max_length: int, constant: bool, seed: int, row_id: Column) -> Column:
    if constant:
        return F.lit(max_length)
    return (F.lit(1) + seeded_int(f"{seed}-length", F.lit(max_length), row_id)).cast("int")


def with_population(rows: DataFrame, n_int: int, n_char: int, modality: str, name: str) -> DataFrame:
    """Every row with the item array, which is built once."""
    pool = rows.sparkSession.range(0, 1, 1, 1).select(T.population(n_int, n_char, modality).alias(name))
    return rows.crossJoin(F.broadcast(pool))


def sequences(ids: DataFrame, row_id: str, task: str, max_length: int, n_int: int, n_char: int, seed: int,
              modality: str = "mixed", constant: bool = False) -> DataFrame:
    """Adds ``input`` and ``answer`` texts for every id; each row draws its own items, without a shuffle."""
    pool, rid = F.col("__pool"), F.col(row_id)
    drawn = T.drawn_items(pool, sequence_length(max_length, constant, seed, rid), seed, rid)
    items = with_population(ids, n_int, n_char, modality, "__pool").select(row_id, "__pool", drawn.alias("items"))
    return items.select(
        row_id,
        F.array_join("items", " ").alias("input"),
        F.array_join(T.solve(F.col("items"), task, pool), " ").alias("answer"),
    )


def distinct_sequences(made: DataFrame, row_id: str) -> DataFrame:
    """One row per (input, answer), with the smallest id."""
    return made.groupBy("input", "answer").agg(F.min(row_id).alias(row_id))


def unique_sequences(spark, generate, wanted: int, row_id: str = "id", first: int = 0, patience: int = 3) -> DataFrame:
    """``wanted`` unique (input, answer) pairs, each with its smallest id: ids are added until enough are distinct.

    ``generate(first, count)`` gives the sequences of ids ``first`` to ``first + count - 1``. A round makes new ids only, removes
    what earlier rounds have, and adds the rest to a stored table; digests stand for the texts in the comparison. As ids rise
    from round to round, what is stored has the smallest id already. Where ``patience`` rounds in a row bring nothing new, the
    settings do not have that many sequences, which is an error. Of a last round that brings too many, the smallest ids are kept.
    """
    path = scratch_path(spark, "unique")
    have, size, idle = 0, wanted, 0
    known: DataFrame | None = None
    while have < wanted:
        digest = F.sha2(F.concat_ws("\u0000", "input", "answer"), 256)
        made = distinct_sequences(generate(first, size), row_id).withColumn("digest", digest)
        new = made if known is None else made.join(known.select("digest"), "digest", "left_anti")
        new.select(row_id, "input", "answer", "digest").write.mode("append").parquet(path)
        known = spark.read.parquet(path)
        first += size
        more = known.count() - have
        have += more
        idle = 0 if more else idle + 1
        if idle == patience:
            raise ValueError(f"only {have} of {wanted} unique sequences found")
        # As many more as the share of new ones in this round lets expect, but no more than twice as many ids as so far.
        size = min(max(-(-(wanted - have) * size // max(more, 1)), 1), 2 * first + 1)
    return first_in_order(known, [row_id], wanted).drop("digest")


def split_sequences(pairs: DataFrame, row_id: str, n_train: int, n_val: int) -> DataFrame:
    """Adds position and split by id order: train, then val, then test."""
    placed = row_positions(pairs, [row_id], "position")
    return placed.withColumn(
        "split",
        F.when(F.col("position") < n_train, "train").when(F.col("position") < n_train + n_val, "val").otherwise("test"),
    )


def scored_sequences(rows: DataFrame, text: str, n_int: int, n_char: int, modality: str = "mixed") -> DataFrame:
    """Adds ``check``: all checks of each completed sequence; NULL fields where it has no valid form.

    The parts are taken in steps, each used by the next, so that no step is evaluated twice.
    """
    columns = rows.columns
    parts = F.split(text, " ")
    groups = T.instruction_groups(F.col(text))
    pooled = with_population(with_population(rows, n_int, n_char, modality, "__pool"), n_int, n_char, "int", "__ints")
    split = pooled.select("*", parts.alias("__parts"), groups.alias("__groups"))
    letters = F.split(F.element_at("__groups", 1), r"\s")
    placed = split.select(
        *columns, "__pool", "__ints", "__parts",
        ((F.element_at("__parts", 1) == "Q") & (F.size("__groups") == 1)
         & F.when(F.size("__groups") == 1, F.size(F.array_distinct(letters)) == 4).otherwise(F.lit(False))).alias("__valid"),
        F.array_position(F.transform("__parts", lambda p: p.isin(T.INSTRUCTION_LETTERS)), F.lit(True)).cast("int").alias("__at"),
    )
    at, size = F.col("__at"), F.size("__parts")
    cut = placed.select(
        *columns, "__pool", "__ints", "__valid",
        F.when(F.col("__valid"), F.element_at("__parts", at)).alias("__task"),
        F.when(F.col("__valid"), F.slice("__parts", F.lit(2), F.greatest(at - 2, F.lit(0)))).alias("__given"),
        F.when(F.col("__valid"), F.slice("__parts", at + 4, F.greatest(size - at - 3, F.lit(0)))).alias("__done"),
    )
    want = F.lit(None).cast("array<string>")
    for name, letter in T.TASK_LETTER.items():
        want = F.when(F.col("__task") == letter, T.solve(F.col("__given"), name, F.col("__pool"))).otherwise(want)
    solved = cut.withColumn("__want", want).withColumn("__lengths", F.size("__given") == F.size("__done"))
    valid = F.col("__valid")
    check = F.struct(
        valid.alias("starts_with_q"),
        valid.alias("instruct_sequence_valid"),
        F.when(valid, F.col("__lengths")).alias("lengths_match"),
        (valid & F.col("__lengths") & (F.col("__done") == F.col("__want"))).alias("task_correct"),
        F.when(valid, F.size(F.array_except("__given", "__ints")) == 0).alias("int_population"),
        F.when(valid, T.agreement(F.col("__want"), F.col("__done"))).alias("num_token_match"),
    )
    return solved.select(*columns, check.alias("check"))
