"""n-gram overlap of response and target texts: ROUGE and BLEU."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlap_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def ngram_counts(pairs: DataFrame, keys: list[str], response: str, target: str, ns: list[int]) -> DataFrame:
    """(keys, n, overlap, n_response, n_target): clipped common n-grams and the sizes of both sides, for every n at once.

    The pairs are read once, and one aggregate is keyed by (pair, n, n-gram), so that long texts spread over many keys. A
    row without a gram stands for each (pair, n), so that pairs without any are there too.
    """
    def side(column: str, flag: int, n: int) -> Column:
        return F.transform(ngrams(F.col(column), n), lambda g: F.struct(F.lit(n).alias("n"), F.lit(flag).alias("side"), g.alias("gram")))

    none = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(-1).alias("side"), F.lit(None).cast("string").alias("gram")) for n in ns])
    grams = F.concat(none, *[side(c, flag, n) for n in ns for flag, c in enumerate((response, target))])
    per_gram = pairs.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(
        F.count_if(F.col("g.side") == 0).alias("a"), F.count_if(F.col("g.side") == 1).alias("b")
    )
    return per_gram.groupBy(*keys, "n").agg(
        F.sum(F.least("a", "b")).alias("overlap"), F.sum("a").alias("n_response"), F.sum("b").alias("n_target")
    )


def ngram_overlap(pairs: DataFrame, keys: list[str], response: str, target: str, n: int) -> DataFrame:
    """(keys, overlap, n_response, n_target) for one n."""
    return ngram_counts(pairs, keys, response, target, [n]).drop("n")


def f_measure(overlap: Column, n_response: Column, n_target: Column) -> Column:
    precision = F.when(n_response > 0, overlap / n_response).otherwise(F.lit(0.0))
    recall = F.when(n_target > 0, overlap / n_target).otherwise(F.lit(0.0))
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


@F.pandas_udf(T.LongType())
def common_subsequence(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays (bit-parallel rows)."""

    def one(a, b) -> int:
        places: dict[str, int] = {}
        for i, word in enumerate(a):
            places[word] = places.get(word, 0) | (1 << i)
        mask = (1 << len(a)) - 1
        row = mask
        for word in b:
            hit = row & places.get(word, 0)
            row = ((row + hit) | (row - hit)) & mask
        return len(a) - row.bit_count()

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int64")


def rouge_l(pairs: DataFrame, keys: list[str], response: str, target: str) -> DataFrame:
    common = pairs.select(
        *keys,
        common_subsequence(F.col(response), F.col(target)).alias("overlap"),
        F.size(response).alias("n_response"),
        F.size(target).alias("n_target"),
    )
    return common.withColumn("f1", f_measure(F.col("overlap"), F.col("n_response"), F.col("n_target")))


def rouge(pairs: DataFrame, keys: list[str], response: str, target: str) -> DataFrame:
    """Mean F1 of ROUGE-1, ROUGE-2 and ROUGE-L as (metric, value) rows."""
    f1 = f_measure(F.col("overlap"), F.col("n_response"), F.col("n_target"))
    by_n = ngram_counts(pairs, keys, response, target, [1, 2]).groupBy("n").agg(F.avg(f1).alias("value"))
    whole = rouge_l(pairs, keys, response, target).agg(F.lit("rougeL").alias("metric"), F.avg("f1").alias("value"))
    return by_n.select(F.concat(F.lit("rouge"), F.col("n").cast("string")).alias("metric"), "value").unionByName(whole)


def bleu(pairs: DataFrame, keys: list[str], response: str, target: str, max_n: int = 4) -> DataFrame:
    """Corpus BLEU with clipped counts and brevity penalty; NULL where some order has no match."""
    table = ngram_counts(pairs, keys, response, target, list(range(1, max_n + 1))).groupBy("n").agg(
        F.sum("overlap").alias("hit"), F.sum("n_response").alias("of"), F.sum("n_target").alias("wanted")
    )
    logs = table.agg(
        F.min(F.coalesce("hit", F.lit(0))).alias("least"),
        F.avg(F.when(F.col("hit") > 0, F.log(F.col("hit") / F.col("of")))).alias("mean_log"),
        F.max(F.when(F.col("n") == 1, F.col("of"))).cast("double").alias("c"),
        F.max(F.when(F.col("n") == 1, F.col("wanted"))).cast("double").alias("r"),
    )
    penalty = F.when(F.col("c") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1.0 - F.col("r") / F.col("c")))
    return logs.select(
        F.when(F.col("least") > 0, F.exp("mean_log") * penalty).alias("bleu")
    )
