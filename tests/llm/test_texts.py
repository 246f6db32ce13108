"""Token counts, personal data, language and tiling against plain versions, and their edge cases."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratiocert.llm import language_crf as crf
from ratiocert.llm import personal_data as pii
from ratiocert.llm import string_tiling as gst
from ratiocert.llm.token_counts import split_safely, token_counts
from ratiocert.llm.tokens import Words

from .conftest import LONG

VOCABULARY = "byte_bpe_50k.json"


def encoder():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(VOCABULARY))


def test_tokens_of_pieces_are_those_of_the_text(make):
    r = random.Random(3)
    parts = ["a", " ", "  ", "\n", "'s", "é", "<|endoftext|>", "12", ".", "日本", "\t", "word", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + [LONG]
    model = encoder()
    got = {x["doc_id"]: x for x in token_counts(make(list(enumerate(texts))), VOCABULARY, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t, add_special_tokens=False))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 20)
        assert "".join(split_safely(t)) == t


def test_token_edges(odd, nothing):
    got = token_counts(odd, VOCABULARY)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    found = {(x["doc_id"], x["n_bytes"]) for x in got.collect()}
    assert {(5, 0), (3, 0), (4, 4), (7, 2), (8, len(LONG))} <= found and got.count() == 9
    assert token_counts(nothing, VOCABULARY).count() == 0


def plain_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]


def test_strict_spans_are_those_of_the_patterns():
    r = random.Random(1)
    texts = ["".join(r.choice("09.@+-() a%1é_") for _ in range(r.randint(1, 60))) for _ in range(20000)]
    texts += ["a@b.c@d.e@x", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1", "x@y@z.com", "00001.2.3.4", "4111 1111 1111 1111", "9" * 5000, "1." * 3000]
    for x in texts:
        strict = pii.strict_spans(x)
        assert [(k, *s) for k in pii.KINDS for s in strict[k]] == plain_spans(x), x


def test_personal_data_edges_and_redaction(make, odd, nothing, spark):
    docs = make([(1, "mail me: a.b@c.example.com or 10.1.2.3, +1 (318) 555-2368"), (2, "nothing here"), (3, None), (1, "10.0.0.1")])
    got = sorted(pii.find_personal_data(docs).collect(), key=lambda x: (x["doc_id"], -x["n_email"]))
    assert [(x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) for x in got] == [(1, 1, 0, 1), (0, 1, 0, 0), (0,) * 4, (0,) * 4]
    assert got[0]["redacted"] == "mail me: [EMAIL] or [IP], [PHONE]" and got[3]["redacted"] is None
    assert got[2]["redacted"] == "nothing here" and got[2]["spans"] == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and "10.0.0.1" not in {x["text"] for x in clean.collect()}
    assert pii.find_personal_data(odd).count() == 9 and pii.redact(odd).count() == 9
    assert pii.find_personal_data(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_more_proposals_than_the_sample_still_train(make):
    """Each row has more proposals than the sample has room for on average; both parts and both labels must stay in it."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 12)))
    number = lambda: r.choice(["", "+"]) + "-".join(str(r.randint(10, 9999)) for _ in range(4))
    texts = [" ".join(f"{word()} {number()} {word()}" for _ in range(12)) for _ in range(300)]
    scorer = pii.fit_scorer(make(list(enumerate(texts))), "doc_id", "text", sample=300)
    assert scorer.trees is not None and scorer.threshold["phone"] <= 1


def test_trees_learn_from_the_proposals_of_every_row(make, spark):
    """The same trees and thresholds from some rows and from these among 130,000 others, which propose nothing."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 12)))
    number = lambda: r.choice(["", "+"]) + "-".join(str(r.randint(10, 9999)) for _ in range(4))
    few = make([(i, " ".join(f"{word()} {number()}" for _ in range(5))) for i in range(200)])
    many = few.select("doc_id", "text").unionByName(spark.range(1000, 131_000).selectExpr("id AS doc_id", "concat('row ', id) AS text"))
    one, two = (pii.fit_scorer(docs, "doc_id", "text") for docs in (few, many))
    assert one.trees is not None and one.threshold == two.threshold and (one.trees.slope, one.trees.shift) == (two.trees.slope, two.trees.shift)
    assert all((getattr(one.trees, a) == getattr(two.trees, a)).all() for a in ("feature", "cut", "value"))


def test_trees_of_a_table_are_those_of_its_rows(spark):
    from ratiocert.llm.boosting import fit_boosted, fit_boosted_rows, threshold_for

    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, (500, 3)).astype(float)
    y = ((x[:, 0] > 20) ^ (x[:, 1] > 30) ^ (rng.random(500) < 0.1)).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    one, two = fit_boosted(x, y, rounds=4), fit_boosted_rows(rows, 3, rounds=4)
    assert one.base == two.base and all((getattr(one, a) == getattr(two, a)).all() for a in ("feature", "cut", "value"))
    assert ((one.raw(x) > 0) == y).mean() > 0.8
    p, y, n = np.array([0.9, 0.9, 0.5, 0.1]), np.array([1.0, 0.0, 1.0, 0.0]), np.array([7, 1, 2, 5])
    assert threshold_for(p, y, 0.85, n) == threshold_for(np.repeat(p, n), np.repeat(y, n), 0.85) == 0.5


def test_spelled_addresses_and_national_phones_are_added(make):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(400):
        strict = [f"mail {word()}.{word()}@{word()}.com for {word()}", f"call +{digits(3)}-{digits(3)}-{digits(4)} now {word()}", f"call +1 ({digits(3)}) {digits(3)}-{digits(4)} or {word()}"]
        other = [f"on 20{r.randint(10, 24)}-{r.randint(10, 12)}-{r.randint(10, 28)} at {word()}", f"value {r.randint(0, 99)}.{digits(7)} of {word()}", f"at {r.randint(1, 9)} (at) {r.randint(1, 9)}.{digits(2)} each"]
        texts.append(" ".join([word(), r.choice(strict), word(), r.choice(other), word()]))
    wanted = ["call 318-555-2368 now", "mail jane.doe (at) example (dot) com for it", "on 2024-11-23 at noon", "value 3.1415926 of pi", "at 7 (at) 2.50 each"]
    rows = pii.find_personal_data(make([*enumerate(texts), *enumerate(wanted, 1000)])).where("doc_id >= 1000").orderBy("doc_id").collect()
    assert [x["redacted"] for x in rows] == ["call [PHONE] now", "mail [EMAIL] for it", *wanted[2:]] and all(x["base"] == "" for x in rows)


def test_masked_spans_hold_the_same_words():
    text = "a.b@c.example.com, +1 (318) 555-2368 or 10.0.0.1 and d@e.org"
    plain, spans = pii.masked(text, pii.strict_spans(text))
    assert "+" not in plain and [plain[a:b] for a, b in spans["phone"]] == ["1 (318) 555-2368"] and [plain[a:b] for a, b in spans["ip"]] == ["10.0.0.1"]
    assert [re.sub(r"[ (\[]*at[)\] ]*| @ ", "@", plain[a:b]).replace("(dot)", ".").replace("[dot]", ".").replace(" ", "") for a, b in spans["email"]] == ["a.b@c.example.com", "d@e.org"]


def test_boosted_trees_learn_and_calibrate():
    from ratiocert.llm.boosting import calibrate, fit_boosted, threshold_for

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = calibrate(fit_boosted(x[:2000], y[:2000]), x[2000:], y[2000:])
    p = m.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    cut = threshold_for(p, y[2000:], 0.98)
    assert y[2000:][p >= cut].mean() >= 0.98
    assert threshold_for(np.zeros(4), np.zeros(4), 0.9) > 1


def small_model():
    words = {"en": "the of and with this that from have".split(), "de": "der die und nicht mit ein auf ist".split()}
    r = random.Random(2)
    texts, langs = [], []
    for _ in range(300):
        lang = r.choice(["en", "de"])
        texts.append(" ".join(r.choice(words[lang]) for _ in range(40)))
        langs.append(lang)
    return crf.fit_chain(texts, langs)


def test_forward_backward_is_exact_over_blocks():
    rng = np.random.default_rng(4)
    model = crf.ChainModel(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = [0, 1, 5, 64, 65, 200, 0, 129]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission = rng.normal(size=(first[-1], 3)) * 3
    got = crf.posteriors(model, emission, first)
    step, begin = np.exp(model.step), np.exp(model.begin) / np.exp(model.begin).sum()
    for a, b in zip(first[:-1], first[1:]):
        e = np.exp(emission[a:b])
        alpha, beta = [begin], [np.ones(3)]
        for x in e:
            v = (alpha[-1] @ step) * x
            alpha.append(v / v.sum())
        for x in e[:0:-1]:
            v = step @ (x * beta[-1])
            beta.append(v / v.sum())
        for t in range(b - a):
            p = alpha[t + 1] * beta[b - a - 1 - t]
            assert np.allclose(p / p.sum(), got[a + t])


def test_code_switched_text_gets_both_labels(make, spark):
    model = small_model()
    switched = "the of and with this that from have " * 5 + "der die und nicht mit ein auf ist " * 8
    got = {x["doc_id"]: x for x in crf.predict_languages(make([(1, switched), (2, "der die und nicht"), (3, "123 ."), (4, None)]), model).collect()}
    assert got[1]["n_switches"] == 1 and got[1]["lang_pred"] == "de" and 0.55 < got[1]["score"] < 0.68
    assert got[2]["lang_pred"] == "de" and got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[4]["score"] == 0


def test_words_at_the_end_of_a_text_do_not_see_the_next_text():
    model = small_model()
    texts = [b"the of ein", b"der die und", b"", "this é".encode()]
    together = model.scores(crf.WordFeatures(texts))
    assert np.array_equal(together, np.concatenate([model.scores(crf.WordFeatures([t])) for t in texts]))


def test_language_of_a_batch_is_found_in_little_memory(make, monkeypatch):
    """A batch of 2 MB takes less than 60 MB at any time, and rows get what they get alone."""
    docs, model = make([(1, "the of")]), small_model()
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f))
    crf.predict_languages(docs, model)
    texts = [("the of and with this der die und nicht " * 26)[k:] for k in range(40) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    tracemalloc.start()
    got = next(taken[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    alone = next(taken[0](iter([batch.slice(77, 1)])))
    assert alone.column("score")[0].as_py() == pytest.approx(got.column("score")[77].as_py(), abs=1e-12)


def test_few_labels_fill_the_sample(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'some words' AS text", "IF(id % 50 = 0, 'en', NULL) AS lang")
    monkeypatch.setattr(crf, "fit_chain", lambda texts, langs: len(texts))
    assert crf.fit_languages(docs, F.lit(True), sample=50) == 50


def test_language_edges(odd, nothing):
    model = small_model()
    got = crf.predict_languages(odd, model)
    assert got.count() == 9 and {x["lang_pred"] for x in got.where("doc_id IN (3, 4, 5, 6)").collect()} == {"und"}
    assert crf.predict_languages(nothing, model).count() == 0
    assert crf.fit_languages(nothing, F.lit(True)) is None
    assert {x["lang_pred"] for x in crf.predict_languages(odd, None).collect()} == {"und"}


def plain_tiling(item, text, least):
    """Greedy string tiling word by word."""
    taken_i, taken_t, covered = [False] * len(item), [False] * len(text), 0
    for size in range(min(len(item), len(text)), least - 1, -1):
        for i in range(len(item) - size + 1):
            for t in range(len(text) - size + 1):
                if item[i:i + size] == text[t:t + size] and not any(taken_i[i:i + size]) and not any(taken_t[t:t + size]):
                    taken_i[i:i + size] = [True] * size
                    taken_t[t:t + size] = [True] * size
                    covered += size
    return covered


def test_tiling_is_greedy():
    r = random.Random(5)
    for _ in range(200):
        item = [r.choice("abcd") for _ in range(r.randint(1, 25))]
        text = [r.choice("abcd") for _ in range(r.randint(1, 60))]
        words = Words([" ".join(item).encode(), " ".join(text).encode()])
        a, b = words.hash[:len(item)], words.hash[len(item):]
        share, _ = gst.coverage_of(a, b, 3)
        assert round(share * len(item)) == plain_tiling(item, text, min(3, len(item)))


def test_reordered_passage_is_caught(make, spark, odd, nothing):
    parts = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"]
    bench = spark.createDataFrame([(1, " ".join(parts), 5), (2, "short one", 5), (3, None, 5), (4, "", 5)], "item_id long, text string, doc_id int")
    docs = make([(1, f"x y z {parts[2]} q {parts[0]} r s {parts[1]} t"), (2, f"only {parts[0]} here"), (3, "a SHORT One b"), (4, None), (5, "")])
    for slice_words in (1_000_000, 3):
        got = {x["doc_id"]: x for x in gst.tile_benchmark(docs, bench, slice_words=slice_words).collect()}
        assert (got[1]["contaminated"], got[1]["item_id"], got[1]["coverage"], got[1]["n_tiles"]) == (True, 1, 1.0, 3)
        assert not got[2]["contaminated"] and abs(got[2]["coverage"] - 1 / 3) < 1e-9
        assert got[3]["contaminated"] and got[3]["item_id"] == 2
        assert got[4]["item_id"] is None and not got[5]["contaminated"]
        kept = gst.tile_benchmark(docs, bench, slice_words=slice_words, keep=True)
        assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {2, 4, 5}
    assert gst.tile_benchmark(odd, bench).count() == 9
    assert gst.tile_benchmark(nothing, bench).count() == 0
    assert gst.tile_benchmark(odd, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("text", ["", "a", "A b\x0bC\x1cd é"])
def test_words_fold_ascii_case_only(text):
    want = re.findall(r"[^\x20\x09-\x0d]+", text)
    words = Words([text.encode()])
    assert len(words.hash) == len(want)
    assert np.array_equal(words.hash, Words([text.lower().encode()]).hash)


def test_digest_format():
    assert hashlib.sha256(pii._listed([("phone", 5, 9), ("email", 7, 8), ("email", 1, 3)]).encode()).hexdigest() == hashlib.sha256(
        b"email:1:3,email:7:8,phone:5:9").hexdigest()
