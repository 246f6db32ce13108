"""Count-based sequence models: a domain unigram G and a general interpolated bigram F."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import seeded_key
from ..functions.sequences import BOS, UNK
from ..session import cut_lineage
from .lookup import SMALL_TABLE, checked_broadcast, frequent_rows, spread_left_join


# Up to this many ids of surplus copies are broadcast, so that no text moves to leave them out.
SURPLUS_IDS = 2_000_000


def distinct_by_digest(rows: DataFrame, doc_id: str, digest: str) -> DataFrame:
    """One row per digest, the one with the smallest id; ``rows`` should be stored.

    Only the ids of surplus copies are looked for: digests and ids are all that is shuffled, and the surplus is
    taken out by a broadcast where a count allows it; as ids they are short, so many more than rows of text may be.
    """
    ids = rows.select(doc_id, digest)
    copied = ids.groupBy(digest).agg(F.min(doc_id).alias("__keep"), F.max(doc_id).alias("__last")).where("__keep < __last")
    surplus = ids.join(copied, digest).where(F.col(doc_id) != F.col("__keep")).select(doc_id)
    return rows.join(checked_broadcast(surplus, SURPLUS_IDS), doc_id, "left_anti").drop(digest)


def half_of(text: Column, seed: int) -> Column:
    """0 or 1 by the digest of the whole text, so that equal texts fall on the same side."""
    first = F.substring(seeded_key(seed, text), 1, 1)
    return (F.conv(first, 16, 10).cast("int") % 2).alias("half")


def pair_table(train: DataFrame, tokens: str, in_domain: Column) -> DataFrame:
    """(prev, tok, c, c_in): how often each token follows each other, in all and in in-domain text.

    The only pass over the training text; both models are derived from this much smaller table.
    The first token of a text follows the start token.
    """
    pairs = train.select(F.explode(bigrams(F.col(tokens), F.lit(BOS))).alias("p"), in_domain.alias("__in"))
    return pairs.groupBy("p.prev", "p.tok").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("__in")).alias("c_in"))


def unigram_table(pairs: DataFrame, min_count: int = 3, alpha: float = 0.5) -> DataFrame:
    """(tok, n, p_generator, p_model, n_context): one row per vocabulary token and one for unknowns.

    ``n`` counts the token in all training text; ``p_generator`` is fitted on in-domain text only,
    ``p_model`` on all of it; ``n_context`` counts how often the token is followed by another.
    Both models share the vocabulary, without which their ratio would mean nothing.
    """
    zero = F.lit(0).cast("long")
    sides = pairs.select("tok", F.col("c").alias("n"), F.col("c_in").alias("n_in"), zero.alias("n_context")).unionByName(
        pairs.where(F.col("prev") != BOS).select(
            F.col("prev").alias("tok"), zero.alias("n"), zero.alias("n_in"), F.col("c").alias("n_context")))
    sums = lambda df, key: df.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "n_in", "n_context")])
    per_token = sums(sides, "tok")
    known = F.when(F.col("n") >= min_count, F.col("tok")).otherwise(F.lit(UNK))
    # The unknown token belongs to the vocabulary even where training has none.
    empty = pairs.sparkSession.createDataFrame([(UNK, 0, 0, 0)], "tok string, n long, n_in long, n_context long")
    table = sums(per_token.withColumn("tok", known).unionByName(empty), "tok")
    total = table.agg(F.sum("n").alias("__n"), F.sum("n_in").alias("__in"), F.count(F.lit(1)).alias("__v"))
    smooth = lambda c, of: (c + F.lit(alpha)) / (of + F.lit(alpha) * F.col("__v"))
    return table.crossJoin(F.broadcast(total)).select(
        "tok", "n", "n_context",
        smooth(F.col("n_in"), F.col("__in")).alias("p_generator"),
        smooth(F.col("n"), F.col("__n")).alias("p_model"),
    )


def bigrams(tokens: Column, first: Column) -> Column:
    """Array of (prev, tok) structs; the first token follows ``first``."""
    before = F.concat(F.array(first), F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))
    return F.zip_with(before, tokens, lambda p, t: F.struct(p.alias("prev"), t.alias("tok")))


def known_pairs(pairs: DataFrame, vocab: DataFrame, count: str) -> DataFrame:
    """(prev, tok, count) with tokens outside the vocabulary replaced by the unknown token, summed again."""
    words = vocab.select("tok", "n")
    spread = F.xxhash64("prev", "tok")
    mapped = spread_left_join(pairs, words, "tok", ["n"], "n", spread).withColumn(
        "__tok", F.when(F.col("n").isNotNull(), F.col("tok")).otherwise(F.lit(UNK))
    ).drop("n", "tok")
    mapped = spread_left_join(
        mapped, words.withColumnRenamed("tok", "prev"), "prev", ["n"], "n", F.xxhash64("prev", "__tok")
    )
    prev = F.when(F.col("n").isNotNull() | (F.col("prev") == BOS), F.col("prev")).otherwise(F.lit(UNK))
    return mapped.groupBy(prev.alias("prev"), F.col("__tok").alias("tok")).agg(F.sum(count).alias(count))


def bigram_table(pairs: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(prev, tok, c): pair counts in the shared vocabulary, without text beginnings.

    The vocabulary is applied to counted pairs, so the lookups see each distinct pair once.
    """
    return known_pairs(pairs.where(F.col("prev") != BOS).select("prev", "tok", "c"), unigrams, "c")


def score_sequences(samples: DataFrame, sample_id: str, prompt: str, response: str, unigrams: DataFrame,
                    pairs: DataFrame, lam: float = 0.6, scope: str = "y|x", carry: tuple[str, ...] = (),
                    frequent_pairs: int = SMALL_TABLE) -> DataFrame:
    """(sample_id, carry, ll_model, ll_generator, n_token): natural-log scores of every sample.

    Under ``y|x`` the first response token is conditioned on the last prompt token, under ``y`` on
    the start token, and ``x+y`` scores prompt and response together. The generator is a unigram.

    Each distinct (prev, tok) pair is scored once. Occurrences of frequent pairs are answered from a broadcast and summed where
    their sample lies; only those of other pairs, none of them hot, meet their scores by a shuffle.
    """
    if scope == "y|x":
        last = F.coalesce(F.try_element_at(F.col(prompt), F.lit(-1)), F.lit(BOS))
        grams = bigrams(F.col(response), last)
    elif scope == "y":
        grams = bigrams(F.col(response), F.lit(BOS))
    elif scope == "x+y":
        grams = bigrams(F.concat(prompt, response), F.lit(BOS))
    else:
        raise ValueError(f"unknown scope {scope!r}")
    weights = samples.select(F.explode(grams).alias("p")).groupBy("p.prev", "p.tok").agg(F.count(F.lit(1)).alias("samples"))
    scored = cut_lineage(
        pair_scores(weights, unigrams, pairs, lam).select(pair_key("prev", "tok").alias("pair"), "samples", "ln_model", "ln_generator"))
    used = samples.select(sample_id, *carry, F.explode(grams).alias("p")).select(
        sample_id, *carry, pair_key("p.prev", "p.tok").alias("pair"))
    frequent, rare = frequent_rows(scored, "samples", frequent_pairs)
    met = used.join(F.broadcast(frequent), "pair")
    if rare is not None:
        far = used.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair")
        met = met.unionByName(far)
    return met.groupBy(sample_id, *carry).agg(
        F.sum("ln_model").alias("ll_model"), F.sum("ln_generator").alias("ll_generator"), F.count(F.lit(1)).alias("n_token"))


def pair_key(prev: str, tok: str) -> Column:
    """Both tokens as one join key; the separator cannot occur in a token."""
    return F.concat(F.col(prev), F.lit("\u0001"), F.col(tok))


def pair_scores(pairs_used: DataFrame, unigrams: DataFrame, pairs: DataFrame, lam: float) -> DataFrame:
    """(prev, tok, samples, ln_model, ln_generator) of each distinct pair of raw tokens.

    Many rare pairs become the same pair of unknowns, so this lookup too answers hot pairs apart.
    """
    unknown = unigrams.where(F.col("tok") == UNK).select(
        F.struct("p_generator", "p_model", "n_context").alias("__unk")
    )
    words = unigrams.where(F.col("tok") != UNK)
    tokened = spread_left_join(
        pairs_used, words, "tok", ["n", "p_generator", "p_model"], "n", F.xxhash64("prev", "tok")
    ).withColumnRenamed("n", "__tn")
    contexts = words.select(F.col("tok").alias("prev"), "n", "n_context")
    full = spread_left_join(tokened, contexts, "prev", ["n", "n_context"], "n", F.xxhash64("prev", "tok"))
    full = full.crossJoin(F.broadcast(unknown)).select(
        "prev",
        "tok",
        "samples",
        F.when(F.col("__tn").isNull(), F.lit(UNK)).otherwise(F.col("tok")).alias("__kt"),
        F.when(F.col("n").isNull() & (F.col("prev") != BOS), F.lit(UNK)).otherwise(F.col("prev")).alias("__kp"),
        F.coalesce("p_generator", "__unk.p_generator").alias("__pg"),
        F.coalesce("p_model", "__unk.p_model").alias("__pf"),
        F.when(F.col("prev") == BOS, F.lit(0)).otherwise(F.coalesce("n_context", "__unk.n_context")).alias("__cu"),
    )
    full = full.withColumn("__pair", pair_key("__kp", "__kt"))
    counts = pairs.select(pair_key("prev", "tok").alias("__pair"), F.col("c").alias("__c"))
    joined = spread_left_join(full, counts, "__pair", ["__c"], "__c", F.xxhash64("prev", "tok"))
    mixed = F.when(
        F.col("__cu") > 0,
        F.lit(lam) * F.coalesce("__c", F.lit(0)) / F.col("__cu") + F.lit(1.0 - lam) * F.col("__pf"),
    ).otherwise(F.col("__pf"))
    return joined.select("prev", "tok", "samples", F.log(mixed).alias("ln_model"), F.log("__pg").alias("ln_generator"))
