"""From raw text to scores under both models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.sequences import head, tail_from, words
from ..operators import ngrams as N
from ..session import cut_lineage


@dataclass(frozen=True)
class Fit:
    """Tables of a fitted model pair and the held-out samples they may score."""

    unigrams: DataFrame
    bigrams: DataFrame
    held_out: DataFrame


def prepared(docs: DataFrame, seed: int = 23633) -> DataFrame:
    """Distinct documents with their words and their half of the data.

    The text is read and cut into words once; what later steps need is stored.
    """
    text = F.col("text")
    read = cut_lineage(docs.select(
        "doc_id", "lang", words(text).alias("words"), N.half_of(text, seed), F.sha2(text, 256).alias("digest")
    ))
    return N.distinct_by_digest(read, "doc_id", "digest")


def fit_models(docs: DataFrame, domain: str = "en", min_count: int = 3, alpha: float = 0.5, prompt_words: int = 8,
               min_words: int = 10) -> Fit:
    """Fits G on in-domain and F on all text of one half; the other half is left for scoring.

    The training text is read once, into pair counts. They and the two model tables, which several
    later joins read, are stored in the shared folder.
    """
    texts = prepared(docs)
    raw = cut_lineage(N.pair_table(texts.where(F.col("half") == 0), "words", F.col("lang") == domain))
    unigrams = cut_lineage(N.unigram_table(raw, min_count, alpha))
    pairs = cut_lineage(N.bigram_table(raw, unigrams))
    samples = (
        texts.where((F.col("half") == 1) & (F.size("words") >= prompt_words + min_words))
        .select(
            F.col("doc_id").alias("sample_id"), F.col("lang").alias("dataset"),
            head(F.col("words"), F.lit(prompt_words)).alias("prompt"),
            tail_from(F.col("words"), F.lit(prompt_words)).alias("response"),
        )
    )
    return Fit(unigrams, pairs, samples)


def corpus_scores(fit: Fit, domain: str = "en", scope: str = "y|x", lam: float = 0.6) -> DataFrame:
    """The canonical score table of the held-out samples."""
    raw = N.score_sequences(
        fit.held_out, "sample_id", "prompt", "response", fit.unigrams, fit.bigrams, lam, scope, ("dataset",))
    return raw.select(
        "sample_id",
        "dataset",
        F.lit(f"F({scope})||G({'x+y' if scope == 'x+y' else 'y'})").alias("distributions"),
        S.to_log2(F.col("ll_model")).alias("ll2_model"),
        S.to_log2(F.col("ll_generator")).alias("ll2_generator"),
        F.col("n_token").alias("n_token_response"),
        S.ood_flag(F.col("dataset"), [domain]).alias("ood"),
    )
