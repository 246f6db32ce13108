"""Token arrays, logits, prompts, packing, tasks."""

import random

import pytest
from pyspark.sql import functions as F

from ratiocert.functions import logits as G
from ratiocert.functions import prompts as P
from ratiocert.functions import sequences as Q
from ratiocert.functions import tasks as T
from ratiocert.operators.packing import packed_blocks
from ratiocert.plans import tasks as K


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(*items):
    return F.array(*[F.lit(i) for i in items])


def test_logits(spark):
    x = arr(0.0, 1.0, 2.0)
    assert one(spark, G.token_loglik(x, F.lit(2))) == pytest.approx(-0.407606, abs=1e-6)
    assert one(spark, G.entropy(x)) == pytest.approx(0.832396, abs=1e-6)
    assert one(spark, G.token_loglik(x, F.lit(2), 2)) == pytest.approx(-0.313262, abs=1e-6)
    assert one(spark, G.token_loglik(x, F.lit(0), 2)) == float("-inf")
    assert one(spark, G.token_loglik(G.temperature(x, 2.0), F.lit(2))) == pytest.approx(-0.680270, abs=1e-6)
    assert one(spark, G.entropy(x, 1)) == pytest.approx(0.0)
    with pytest.raises(ZeroDivisionError):
        G.temperature(x, 0)


def test_sequences(spark):
    t = arr("<s>", "5", "3", "A", "3", "5", "</s>")
    n = F.lit(4)
    assert one(spark, Q.scored_tokens(t, n, "y|x")) == ["3", "5", "</s>"]
    assert one(spark, Q.scope(t, n, "y", F.lit("<s>"))) == ["<s>", "3", "5", "</s>"]
    assert one(spark, Q.scored_tokens(t, n, "x+y")) == ["5", "3", "A", "3", "5", "</s>"]
    assert one(spark, Q.truncate_prompt(t, arr("a", "b"), 6)) == ["<s>", "5"]
    assert one(spark, Q.truncate_prompt(t, arr("a", "b"), 2)) == []
    assert one(spark, Q.drop_end(t, F.lit("</s>")))[-1] == "5"
    assert one(spark, Q.ensure_end(t, F.lit("</s>")))[-2:] == ["5", "</s>"]
    assert one(spark, Q.labels(arr(7, 8, 9).cast("array<long>"), F.lit(2))) == [-100, -100, 9]
    assert one(spark, Q.mismatches(arr("a", "b", "c"), arr("a", "x"))) == 2
    assert one(spark, Q.first_longest(arr("aa", "bbb", "ccc"))) == "bbb"
    assert one(spark, Q.view(t, n, "partial-response", F.lit("<s>"))) == ["<s>", "3", "5", "</s>"]


def test_prompts(spark):
    choices = arr("w", "x", "y", "z")
    text = one(spark, P.multiple_choice(F.lit("Q?"), choices, F.lit(2)))
    assert text == "Q?\nA. w\nB. x\nC. y\nD. z\nAnswer: C"
    zero = one(spark, P.few_shot(F.lit("high_school"), F.array().cast("array<string>"), F.lit("item")))
    assert zero == "The following are multiple choice questions (with answers) about high school.\n\n\n\nitem"
    assert one(spark, P.plain_question(F.lit("Why?"))) == "Question: Why?\n\nAnswer: "
    assert one(spark, P.plain_question(F.lit("So"))) == "So "
    assert one(spark, P.same_start(F.lit("abcdef"), F.lit("abc")))
    assert one(spark, P.yes_no_id(F.lit("maybe"))) == 2


def test_packing(spark):
    docs = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6, 7]), (3, [])], "id int, t array<int>")
    assert [r["tokens"] for r in packed_blocks(docs, "id", "t", 3).orderBy("block").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert [r["tokens"] for r in packed_blocks(docs, "id", "t", 3, bos=0).orderBy("block").collect()] == [[0, 1, 2], [0, 3, 4], [0, 5, 6]]
    assert [r["tokens"] for r in packed_blocks(docs, "id", "t", 10).collect()] == [[1, 2, 3, 4, 5, 6, 7]]


def test_packing_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(99) for _ in range(rng.choice([0, 1, 3, 40, 500]))]) for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, t array<int>").repartition(5)
    flat = [x for _, t in rows for x in t]
    want = [flat[i:i + 16] for i in range(0, len(flat) // 16 * 16, 16)]
    assert [r["tokens"] for r in packed_blocks(docs, "id", "t", 16).orderBy("block").collect()] == want


def solved(spark, items, task):
    pool = T.population(12, 0, "int")
    return " ".join(one(spark, T.solve(arr(*items.split()), task, pool)))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_packing_of_long_and_empty_documents(spark, parts):
    rng = random.Random(parts)
    docs = [(i, [rng.randrange(99) for _ in range(rng.choice([0, 1, 5, 400]))]) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, t array<int>").repartition(7)
    flat = [x for _, t in docs for x in t]
    want = [flat[i:i + 16] for i in range(0, len(flat) // 16 * 16, 16)]
    assert [r["tokens"] for r in packed_blocks(df, "id", "t", 16, parts=parts).orderBy("block").collect()] == want
    named = df.withColumn("id", F.format_string("doc-%04d", "id"))
    assert [r["tokens"] for r in packed_blocks(named, "id", "t", 16, parts=parts).orderBy("block").collect()] == want
    assert packed_blocks(df.limit(0), "id", "t", 16, parts=parts).count() == 0


def test_tasks(spark):
    assert solved(spark, "10 2 9", "sort") == "10 2 9"
    assert solved(spark, "10 2 9", "reverse-sort") == "9 2 10"
    assert solved(spark, "10 2 12", "add") == "11 3 1"
    assert solved(spark, "10 2 9", "even-odd") == "2 10 9"


def test_letters(spark):
    words = one(spark, T.population(1, 26 + 26 * 26 + 2, "char"))
    assert words[:2] == ["a", "b"] and words[25:28] == ["z", "aa", "ab"] and words[-3:] == ["zz", "aaa", "aab"]


def test_add_cycles(spark):
    pool = T.population(5, 0, "int")
    items = arr("3", "1", "5")
    for _ in range(5):
        items = arr(*one(spark, T.solve(items, "add", pool)))
    assert one(spark, items) == ["3", "1", "5"]


def test_task_scores(spark):
    rows = spark.createDataFrame([
        (1, "Q 3 1 2 S A E R 1 2 3"), (2, "Q 3 1 2 S A E R 1 3 2"), (3, "3 1 2 S A E R 1 2 3"),
        (4, "Q 3 1 2 S A E R 1 2"), (5, "Q a 1 S A E R 1 a"), (6, "Q 3 S A S R 3"),
    ], "id int, text string")
    got = {r["id"]: r["check"] for r in K.scored_sequences(rows, "text", 12, 3).collect()}
    assert got[1]["task_correct"] and got[1]["num_token_match"] == 1.0
    assert got[2]["lengths_match"] and not got[2]["task_correct"] and got[2]["num_token_match"] == pytest.approx(1 / 3)
    assert (got[3]["starts_with_q"], got[3]["task_correct"], got[3]["lengths_match"]) == (False, False, None)
    assert got[4]["lengths_match"] is False and got[4]["num_token_match"] == 1.0
    assert got[5]["int_population"] is False and got[5]["task_correct"]
    assert got[6]["instruct_sequence_valid"] is False


def test_unique_sequences(spark):
    make = lambda first, count: K.sequences(spark.range(first, first + count), "id", "sort", 2, 4, 0, 5, "int")
    pairs = K.unique_sequences(spark, make, 12)
    assert pairs.count() == 12 and pairs.select("input").distinct().count() == 12
    with pytest.raises(ValueError):
        K.unique_sequences(spark, make, 500)


def test_template(spark):
    template = "DECISION.IN::: yes\nDECISION.OUT::: no\nDECISION.INVALID::: none\n------\n{{topic}}: {{sentence}} {{DECISION.IN}}/{{DECISION.OUT}}/{{DECISION.INVALID}} {{DECISION}}"
    assert one(spark, P.fill_template(F.lit(template), F.lit("s"), F.lit("t"))) == "\nt: s yes/no/none {{DECISION}}"
