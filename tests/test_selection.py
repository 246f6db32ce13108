"""Selection by counting, the identifier codec, topping up and scorers against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from ratiocert.functions.codec import decimal_to_hex, hex_to_decimal
from ratiocert.operators import selection as Z
from ratiocert.operators.ordering import first_in_order
from ratiocert.plans import scorers as S
from ratiocert.plans import tasks as K


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    values = [rng.choice([rng.randrange(-2**63, 2**63), rng.randrange(50), 2**62 + rng.randrange(9)]) for _ in range(6000)]
    doubles = [rng.choice([rng.gauss(0, 1), 1e300 * rng.random(), 3.5, float("inf"), float("-inf"), -1.7e308, 1.7e308, 5e-324]) for _ in range(6000)]
    texts = [rng.choice(["", "a", "common/prefix/" + "%x" % rng.randrange(1000), "é%d" % rng.randrange(9), "same", "\U0001f600", "\uffff"]) for _ in range(6000)]
    return list(zip(values, doubles, texts, range(6000), strict=True))


@pytest.mark.parametrize("few", [2000, 5])
@pytest.mark.parametrize("order", [["v", "i"], ["d", "i"], ["t", "i"], ["t", "v", "i"]])
def test_nth_key(spark, rows, order, few, monkeypatch):
    monkeypatch.setattr(Z, "FEW", few)
    df = spark.createDataFrame(rows, "v long, d double, t string, i long").repartition(3)
    at = {"v": 0, "d": 1, "t": 2, "i": 3}
    key = lambda r: [r[at[c]].encode() if c == "t" else r[at[c]] for c in order]
    sorted_rows = sorted(rows, key=key)
    for n in (1, 2, 700, 3000, 5999):
        assert Z.nth_key(df, {c: F.col(c) for c in order}, n) == [sorted_rows[n - 1][at[c]] for c in order]
        if few == 2000 and n == 700:
            assert {r["i"] for r in first_in_order(df, order, n).collect()} == {r[3] for r in sorted_rows[:n]}
    assert Z.nth_key(df, {c: F.col(c) for c in order}, 6000) is None


def test_keys_must_be_there(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, float("nan"))], "i int, d double")
    for c in ("i", "d"):
        with pytest.raises(ValueError, match="without a key"):
            Z.nth_key(df, {c: F.col(c)}, 1)
    assert first_in_order(df, ["i"], 0).count() == 0


def test_id_codec(spark):
    rng = random.Random(1)
    texts = ["0", "00", "f", "5733be284776f41900661182", "0x1F", "0" * 20 + "a", "f" * 60] + ["%x" % rng.getrandbits(rng.randrange(1, 200)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts] + [("xyz",), ("",), (None,), ("-1",)], "h string")
    got = df.select("h", hex_to_decimal(F.col("h")).alias("d")).select("h", "d", decimal_to_hex(F.col("d")).alias("b")).collect()
    want = [(t, str(int(t, 16)), hex(int(t, 16))[2:]) for t in texts] + [("xyz", None, None), ("", None, None), (None, None, None), ("-1", None, None)]
    assert [tuple(r) for r in got] == want
    assert spark.range(1).select(decimal_to_hex(F.lit("12a"))).first()[0] is None


def test_sequences_are_topped_up(spark):
    made = []

    def generate(first, count):
        made.append((first, count))
        return K.sequences(spark.range(first, first + count), "id", "sort", 2, 6, 0, 3, modality="int")

    got = sorted((r["id"], r["input"], r["answer"]) for r in K.unique_sequences(spark, generate, 30, first=5).collect())
    assert len(got) == 30 and len(made) > 1
    assert all(a + n == b for (a, n), (b, _) in zip(made, made[1:])), "a round makes new ids only"
    first = {}
    for r in sorted(generate(5, sum(n for _, n in made)).collect()):
        first.setdefault((r["input"], r["answer"]), r["id"])
    assert got == sorted((i, *p) for p, i in first.items())[:30]
    with pytest.raises(ValueError, match="only 36 of 37"):
        K.unique_sequences(spark, generate, 37)


def test_each_data_set_has_its_own_scorer(spark):
    rules = {"task_data": S.Scorer(S.task_checks(12, 0, "int"), {"int_population": 1.0}), "qa": S.Scorer(S.answer_checks, {"word_match": 0.5})}
    df = spark.createDataFrame([
        ("task_data", "Q 3 1 2 S A E R 1 2 3", None, 1), ("task_data", "3 1 2 S A E R 1 2 3", None, 2), ("qa", "so it is yes", "is yes", 3), ("qa", "no", "", 4),
    ], "name string, said string, want string, check int")
    rows = {r["check"]: r["scores"] for r in S.scored_items(df, "name", "said", "want", rules).collect()}
    assert rows[1]["task_correct"] == 1.0 and rows[2]["task_correct"] == 0.0 and rows[2]["int_population"] is None
    assert rows[3] == {"ends_with_target": 1.0, "lengths_match": 0.0, "word_match": 0.0}
    means = {(r["name"], r["check"]): (r["n"], r["mean"]) for r in S.aggregate_scores(S.scored_items(df, "name", "said", "want", rules), "name", rules).collect()}
    assert means["task_data", "task_correct"] == (2, 0.5) and means["task_data", "int_population"] == (2, 1.0)
    with pytest.raises(Exception, match="no scorer for data set other"):
        S.scored_items(spark.createDataFrame([("other", "a", "b")], "name string, said string, want string"), "name", "said", "want", rules).collect()
    S.register_scorer("mine", S.answer_checks)
    assert S.SCORERS.pop("mine").checks is S.answer_checks
