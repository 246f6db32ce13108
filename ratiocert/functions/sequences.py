"""Operations on token arrays: scopes, views, budgets, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seeded import seeded_int

IGNORE_LABEL = -100
BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def words(text: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def words_and_marks(text: Column) -> Column:
    """Runs of letters and digits, and runs of other visible characters, in order."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"), F.lit(1))


def head(tokens: Column, n: Column) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def tail_from(tokens: Column, n: Column) -> Column:
    """All tokens after the first ``n``."""
    return F.slice(tokens, (n + 1).cast("int"), F.greatest(F.size(tokens), F.lit(1)))


def scope(tokens: Column, n_prompt: Column, which: str, bos: Column) -> Column:
    """The scored positions with the context they need in front.

    ``y|x`` keeps the prompt, ``y`` replaces it by the start token, ``x+y`` is the whole
    sequence. The first element is never scored itself except under ``y|x``, where
    scoring starts after the prompt.
    """
    if which in ("y|x", "x+y"):
        return tokens
    if which == "y":
        return F.concat(F.array(bos), tail_from(tokens, n_prompt))
    raise ValueError(f"unknown scope {which!r}")


def scored_tokens(tokens: Column, n_prompt: Column, which: str) -> Column:
    """The tokens whose likelihood counts. ``tokens`` starts with the start token."""
    if which in ("y|x", "y"):
        return tail_from(tokens, n_prompt)
    if which == "x+y":
        return tail_from(tokens, F.lit(1))
    raise ValueError(f"unknown scope {which!r}")


def truncate_prompt(prompt: Column, answer: Column, limit: int) -> Column:
    """Cut the prompt so that prompt, answer, start and end tokens fit; never below zero tokens."""
    return head(prompt, F.lit(limit) - F.size(answer) - F.lit(2))


def ensure_end(tokens: Column, eos: Column) -> Column:
    return F.when(F.element_at(tokens, -1) == eos, tokens).otherwise(F.concat(tokens, F.array(eos)))


def drop_end(tokens: Column, eos: Column) -> Column:
    return F.when(F.element_at(tokens, -1) == eos, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)


def labels(token_ids: Column, n_prompt: Column) -> Column:
    """Training labels: prompt positions are ignored."""
    return F.transform(token_ids, lambda t, i: F.when(i < n_prompt, F.lit(IGNORE_LABEL).cast("long")).otherwise(t))


def view(tokens: Column, n_prompt: Column, mode: str, bos: Column, seed: int = 0, row_id: Column | None = None,
         first: int = 0, spare: int = 0) -> Column:
    """``full``, ``partial-response`` (start token + response) or ``partial-random`` (start token + a random tail).

    The random cut lies in ``[first, size - spare)``.
    """
    if mode == "full":
        return tokens
    if mode == "partial-response":
        cut = n_prompt
    elif mode == "partial-random":
        span = F.greatest(F.size(tokens) - F.lit(spare) - F.lit(first), F.lit(1))
        cut = F.lit(first) + seeded_int(seed, span, row_id)
    else:
        raise ValueError(f"unknown view {mode!r}")
    return F.concat(F.array(bos), tail_from(tokens, cut))


def strip_special(tokens: Column, specials: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.array_contains(specials, t))


def mismatches(predicted: Column, target: Column) -> Column:
    """Unequal positions on the common length plus the difference in length."""
    common = F.least(F.size(predicted), F.size(target))
    wrong = F.aggregate(
        F.zip_with(head(predicted, common), head(target, common), lambda a, b: (a != b).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    return wrong + F.abs(F.size(predicted) - F.size(target)).cast("long")


def first_longest(options: Column) -> Column:
    """The first option of the greatest length."""
    start = F.element_at(options, 1)
    return F.aggregate(
        options, start, lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)
    )


def other_prompt_length(text: Column, prompt_chars: Column, tokenise) -> Column:
    """Prompt tokens under a second tokenisation, found by the character count of the prompt."""
    return F.size(tokenise(F.substring(text, F.lit(1), prompt_chars)))
