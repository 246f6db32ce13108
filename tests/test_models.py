"""n-gram models, subwords, overlap and skewed lookups against brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from ratiocert.functions.sequences import BOS, UNK, words
from ratiocert.operators import ngrams as N
from ratiocert.operators import overlap as O
from ratiocert.operators import subwords as W
from ratiocert.operators.lookup import spread_left_join


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocab = [f"w{chr(97 + i)}" for i in range(20)]
    weights = [100] + [1] * 19
    return [(i, rng.random() < 0.5, rng.choices(vocab, weights, k=rng.randrange(1, 30))) for i in range(60)]


@pytest.mark.parametrize("small", [10**6, 0])
def test_models_and_scores(spark, texts, monkeypatch, small):
    join = N.spread_left_join
    monkeypatch.setattr(N, "spread_left_join", lambda *a: join(*a, small_rows=small))
    df = spark.createDataFrame(texts, "id int, inside boolean, t array<string>")
    raw = N.pair_table(df, "t", F.col("inside")).cache()
    uni_df = N.unigram_table(raw, min_count=5)
    uni = {r["tok"]: r for r in uni_df.collect()}
    assert sum(r["p_generator"] for r in uni.values()) == pytest.approx(1)
    assert sum(r["p_model"] for r in uni.values()) == pytest.approx(1)
    n = collections.Counter(w for _, _, t in texts for w in t)
    known = {w for w, c in n.items() if c >= 5}
    assert set(uni) == known | {UNK}
    m = lambda w: w if w in known or w == BOS else UNK
    n_in = collections.Counter(m(w) for _, inside, t in texts if inside for w in t)
    n_all = collections.Counter(m(w) for _, _, t in texts for w in t)
    pairs = collections.Counter((m(a), m(b)) for _, _, t in texts for a, b in zip(t, t[1:]))
    after = collections.Counter()
    for (a, _), c in pairs.items():
        after[a] += c
    bi_df = N.bigram_table(raw, uni_df)
    assert {(r["prev"], r["tok"]): r["c"] for r in bi_df.collect()} == dict(pairs)
    v, alpha, lam = len(uni), 0.5, 0.6
    pg = lambda w: (n_in[w] + alpha) / (sum(n_in.values()) + alpha * v)
    pf = lambda w: (n_all[w] + alpha) / (sum(n_all.values()) + alpha * v)

    def cond(u, w):
        return lam * pairs[u, w] / after[u] + (1 - lam) * pf(w) if after[u] > 0 else pf(w)

    for u in list(known)[:5]:
        assert sum(cond(u, w) for w in uni) == pytest.approx(1)
    samples = [(1, ["wa", "zz"], ["wb", "wa", "qq", "wa"]), (2, [], ["wc"])]
    sdf = spark.createDataFrame(samples, "sample_id int, p array<string>, r array<string>")
    for scope in ("y|x", "y", "x+y") if small else ("y|x",):
        got = {r["sample_id"]: r for r in N.score_sequences(sdf, "sample_id", "p", "r", uni_df, bi_df, lam, scope).collect()}
        for sid, p, r in samples:
            toks = p + r if scope == "x+y" else r
            first = p[-1] if scope == "y|x" and p else BOS
            prev = [m(first)] + [m(x) for x in toks[:-1]]
            f = sum(math.log(cond(a, m(b))) for a, b in zip(prev, toks))
            g = sum(math.log(pg(m(b))) for b in toks)
            assert got[sid]["ll_model"] == pytest.approx(f) and got[sid]["ll_generator"] == pytest.approx(g)
            assert got[sid]["n_token"] == len(toks)


def test_hot_lookup(spark):
    probe = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    table = spark.createDataFrame([("hot", 5000, 1.0)] + [(f"k{i}", 2, float(i)) for i in range(40)], "key string, n long, v double")
    for share, small in ((1000, 0), (10, 0), (1000, 10**6)):
        out = spread_left_join(probe, table, "key", ["v"], "n", F.col("id"), share, small)
        want = probe.join(table.select("key", "v"), "key", "left")
        assert out.count() == 3000
        assert out.exceptAll(want.select(*out.columns)).count() == 0


def brute_merges(texts, rounds):
    freq = collections.Counter(w for t in texts for w in t.lower().split())
    split = {w: list(w) for w in freq}
    out = []
    for _ in range(rounds):
        pairs = collections.Counter()
        for w, s in split.items():
            for p in zip(s, s[1:]):
                pairs[p] += freq[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append((*best, pairs[best]))
        for w, s in split.items():
            i, new = 0, []
            while i < len(s):
                if tuple(s[i:i + 2]) == best:
                    new.append(s[i] + s[i + 1])
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            split[w] = new
    return out


def test_merges(spark):
    texts = ["aaaa aaa banana bandana", "low lower lowest newer wider", "aa aaaaa ban"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = W.learn_merges(df, words(F.col("text")), rounds=6).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["freq"]) for r in got] == brute_merges(texts, 6)


@pytest.mark.parametrize("most_islands,most_pairs", [(100_000, 4096), (12, 4096), (100_000, 3), (1, 1)])
def test_merges_in_rounds_keep_their_order(spark, most_islands, most_pairs):
    rng = random.Random(most_islands + most_pairs)
    texts = [" ".join("".join(rng.choice("aaabcé") for _ in range(rng.randrange(1, 12))) for _ in range(12)) for _ in range(12)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    n = 12 if most_islands * most_pairs == 1 else 45
    got = W.learn_merges(df, words(F.col("text")), rounds=n, most_islands=most_islands, most_pairs=most_pairs).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["freq"]) for r in got] == brute_merges(texts, n)


def test_merges_wait_for_pairs_that_were_not_read(spark):
    """Of 45 equally frequent pairs a round reads four; a merge from these alone would go on to what the others make rarer."""
    texts = [" ".join(a + b for a in "abcdefghij" for b in "abcdefghij" if a < b) + " aba aba"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = W.learn_merges(df, words(F.col("text")), rounds=5, most_pairs=3).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["freq"]) for r in got] == brute_merges(texts, 5)


def test_merges_end_where_no_pair_is_left(spark):
    df = spark.createDataFrame([("ab ab c",), (None,)], "text string")
    assert W.learn_merges(df, words(F.col("text")), rounds=9).count() == 1
    assert W.learn_merges(df.limit(0), words(F.col("text")), vocabulary=9).count() == 0


def test_merges_of_the_query_go_on_and_see_digits_and_marks(spark, monkeypatch):
    from registry import scoring

    df = spark.createDataFrame([("2024 !!! Abcdefghij 2024",), ("2024 !!! abcdefghij",)], "text string")
    monkeypatch.setattr(scoring, "wide_table", lambda *_: df)
    got = {(r["left"], r["right"]) for r in scoring.tok_bpe_train(spark, "").collect()}
    assert len(got) == 3 + 2 + 9 and ("!", "!") in got and {a + b for a, b in got} >= {"2024", "!!!", "abcdefghij"}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_and_bleu(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(0, 90))], [rng.choice("abcd") for _ in range(rng.randrange(0, 70))]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = {r["id"]: r["overlap"] for r in O.rouge_l(df, ["id"], "a", "b").collect()}
    assert got == {i: lcs(a, b) for i, a, b in rows}

    def clipped(a, b, n):
        ca, cb = (collections.Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (a, b))
        return sum(min(c, cb[g]) for g, c in ca.items()), sum(ca.values())

    logs = []
    for n in range(1, 5):
        hits = [clipped(a, b, n) for _, a, b in rows]
        logs.append(math.log(sum(h for h, _ in hits) / sum(t for _, t in hits)))
    c, r = sum(len(a) for _, a, _ in rows), sum(len(b) for _, _, b in rows)
    want = math.exp(sum(logs) / 4) * (1 if c >= r else math.exp(1 - r / c))
    assert O.bleu(df, ["id"], "a", "b").first()["bleu"] == pytest.approx(want)
    none = spark.createDataFrame([(1, ["a", "b"], ["c"])], "id int, a array<string>, b array<string>")
    assert O.bleu(none, ["id"], "a", "b").first()["bleu"] is None
