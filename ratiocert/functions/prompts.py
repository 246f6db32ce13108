"""Prompt texts. The layouts are fixed values: results depend on every newline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seeded import seeded_int
from .sequences import first_longest

MARKERS = ["A", "B", "C", "D"]
YES_NO_MAYBE = ["yes", "no", "maybe"]


def context_question(question: Column, contexts: Column, prefix: Column | None = None) -> Column:
    body = F.concat(F.lit("Question: "), question, F.lit("\n\nContext: "), contexts)
    if prefix is None:
        return body
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit("\n\n"), body)).otherwise(body)


def joined_contexts(contexts: Column) -> Column:
    return F.concat(F.array_join(contexts, "\n"), F.lit("\n"))


def with_answer(prompt: Column, answer: Column) -> Column:
    return F.concat(prompt, F.lit("\n\nAnswer: "), answer)


def plain_question(question: Column) -> Column:
    return F.when(
        question.endswith("?"), F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer: "))
    ).otherwise(F.concat(question, F.lit(" ")))


def multiple_choice(question: Column, choices: Column, answer_id: Column | None = None) -> Column:
    lines = [question]
    for i, marker in enumerate(MARKERS):
        lines += [F.lit(f"\n{marker}. "), F.element_at(choices, i + 1)]
    lines.append(F.lit("\nAnswer:"))
    if answer_id is not None:
        lines += [F.lit(" "), F.element_at(F.array(*map(F.lit, MARKERS)), (answer_id + 1).cast("int"))]
    return F.concat(*lines)


def yes_no_question(question: Column, contexts: Column, instruction: str | None = None) -> Column:
    start = f"Instruction: {instruction}" if instruction is not None else ""
    return F.concat(F.lit(start + "\n\n"), context_question(question, joined_contexts(contexts)), F.lit("\n\nAnswer:"))


def yes_no_id(decision: Column) -> Column:
    """yes, no, maybe as 0, 1, 2; NULL for anything else."""
    pairs = [F.lit(x) for i, name in enumerate(YES_NO_MAYBE) for x in (name, i)]
    return F.create_map(*pairs)[decision]


def few_shot(subject: Column, examples: Column, item: Column) -> Column:
    """Header, worked examples (an array, possibly empty) and the item; both separators always stay."""
    header = F.concat(
        F.lit("The following are multiple choice questions (with answers) about "),
        F.replace(subject, F.lit("_"), F.lit(" ")),
        F.lit("."),
    )
    return F.concat(header, F.lit("\n\n"), F.array_join(examples, "\n\n"), F.lit("\n\n"), item)


def chosen_answer(choices: Column, correct_id: Column, mode: str, seed: int = 0, row_id: Column | None = None) -> Column:
    if mode == "correct":
        return F.element_at(choices, (correct_id + 1).cast("int"))
    if mode == "random":
        return F.element_at(choices, (seeded_int(seed, F.size(choices), row_id) + 1).cast("int"))
    if mode == "longest":
        return first_longest(choices)
    raise ValueError(f"unknown answer mode {mode!r}")


def same_start(expected: Column, stored: Column) -> Column:
    """Whether two texts agree on their common length."""
    n = F.least(F.length(expected), F.length(stored))
    return F.substring(expected, F.lit(1), n) == F.substring(stored, F.lit(1), n)


def template_options(template: Column, separator: str = "------") -> Column:
    """The option block of a judge template as a map from decision key to its text."""
    block = F.element_at(F.split(template, "\n" + separator, 2), 1)
    pairs = F.transform(
        F.filter(F.split(block, "\n"), lambda line: line.contains("::: ")),
        lambda line: F.struct(
            F.trim(F.element_at(F.split(line, "::: "), 1)).alias("key"),
            F.trim(F.element_at(F.split(line, "::: "), 2)).alias("value"),
        ),
    )
    return F.map_from_entries(pairs)


def template_body(template: Column, separator: str = "------") -> Column:
    return F.element_at(F.split(template, separator), 2)


def fill_template(template: Column, sentence: Column, topic: Column) -> Column:
    """The body with its option placeholders, sentence and topic put in; the decision slot stays open."""
    options = template_options(template)
    text = template_body(template)
    for name in ("DECISION.IN", "DECISION.OUT", "DECISION.INVALID"):
        text = F.replace(text, F.lit("{{" + name + "}}"), options[name])
    text = F.replace(text, F.lit("{{sentence}}"), sentence)
    return F.replace(text, F.lit("{{topic}}"), topic)
