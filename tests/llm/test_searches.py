"""Hard negatives, lexical search and piece encoding against plain versions and the library."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiocert.llm.blocks import Best, best_rows, sliced
from ratiocert.llm.hard_negatives import mine_hard_negatives, packed_products
from ratiocert.llm.lexical_search import search_items, term_counts, tile_scores
from ratiocert.llm.pieces import decode_pieces, encode_pieces
from ratiocert.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODEL = "piece_bpe_32k.model"


@pytest.mark.parametrize("reach", [1, 40, 300, 5000, 1 << 24])
def test_packed_products_are_exact(reach):
    rng = np.random.default_rng(reach)
    a, b = rng.integers(-reach, reach + 1, (7, 64)), rng.integers(-reach, reach // 2 + 1, (1003, 64))
    assert (packed_products(a, b) == a @ b.T).all()


def test_packed_products_of_extremes():
    for x, y in ((0, 0), (-5, -5), (127, 127), (-128, 127)):
        a, b = np.full((2, 64), x), np.full((5, 64), y)
        assert (packed_products(a, b) == a @ b.T).all()


def test_best_keeps_ties_by_id():
    rng = np.random.default_rng(2)
    best, seen = Best(3, 4), []
    for _ in range(30):
        g, s, i = rng.integers(0, 3, 20), rng.integers(-2, 2, 20), rng.integers(0, 10**6, 20)
        best.add(g, s, i)
        seen += list(zip(g.tolist(), s.tolist(), i.tolist(), strict=True))
    want = [r for g in range(3) for r in sorted((x for x in seen if x[0] == g), key=lambda x: (-x[1], x[2]))[:4]]
    assert list(zip(*(x.tolist() for x in best.rows()), strict=True)) == want


def test_best_rows_and_slices(spark):
    rows = spark.range(0, 2000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("s"))
    got = [(x["g"], x["rank"], x["id"]) for x in best_rows(rows, ["g"], "s", "id", 3).orderBy("g", "rank").collect()]
    want = [(g, r + 1, i) for g in range(3) for r, i in enumerate(sorted((i for i in range(2000) if i % 3 == g), key=lambda i: (-(i % 7), i))[:3])]
    assert got == want
    dealt, n = sliced(rows.withColumn("w", F.lit(5).cast("long")), "id", "w", 1000)
    held = [x["w"] for x in dealt.groupBy("slice").agg(F.sum("w").alias("w")).collect()]
    assert max(held) <= 1000 and sum(held) == 10000 and n >= 10


# Hard negatives.

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, score int"


def plain_negatives(rows, anchor=lambda i: i % 10 == 0):
    rows = {i: (lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows}
    out = set()
    for a, (label, v) in rows.items():
        if not anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, (lab, w) in rows.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            near = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out |= {(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(near)}
    return out


def negatives_of(df, **more):
    rows = mine_hard_negatives(df, F.col("id") % 10 == 0, **more).collect()
    got = {tuple(x[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for x in rows}
    assert len(got) == len(rows)
    return got


def test_hard_negatives_match_plain(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25, 0.9]) for _ in range(8)], rng.randrange(3)) for i in range(400)]
    rows += [(i, rows[3][1], i % 3) for i in range(400, 700)]  # a very common vector: ties by id
    rows += [(i, [0.3] * 5, i % 2) for i in range(700, 720)]  # of another size
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], VECTORS).repartition(5)
    want = plain_negatives(rows)
    assert want and negatives_of(df) == want
    assert negatives_of(df, slice_numbers=64) == want


def test_hard_negatives_of_odd_rows(spark):
    good = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (10, [-1.0, 0.0], 1)]
    odd = [(None, [1.0, 0.5], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [1.0, 0.5], None),
           (8, [], 1), (9, [1e30, 0.0], 2), (2, [0.9, 0.5], 2), (2, [1.0, 0.5], 7)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in good + odd], VECTORS)
    want = plain_negatives(good)
    assert want and negatives_of(df) == want
    assert negatives_of(df.limit(0)) == set()
    assert negatives_of(df.where("vec_id = 0")) == set()


# Lexical search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, t in ((i, plain_terms(x)) for i, x in docs) if t]
    df = Counter(t for _, c, _ in held for t in c)
    total = sum(n for _, _, n in held)
    weight = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * x + 1))) for t, x in df.items()}
    out = set()
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 75 + 25 * n * len(held) // total
            scores.append((-sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c), i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[1] is not None and x[0] < 0)[:k])}
    return out


def found_by(docs, items, **more):
    rows = search_items(docs, items, **more).collect()
    got = {tuple(x[c] for c in ("item_id", "rank", "doc_id", "score")) for x in rows}
    assert len(got) == len(rows)
    return got


def test_terms_of_long_text():
    text = "Ab-é9 " * 400_000 + "x" * 3_000_000 + "_Z"
    assert term_counts(text.encode()) == {b"ab": 400_000, "é9".encode(): 400_000, b"x" * 3_000_000: 1, b"z": 1}


def test_tile_scores_stay_exact():
    rng = np.random.default_rng(1)
    item, term = np.divmod(rng.permutation(5 * 400)[:900], 400)
    doc, doc_term = np.divmod(rng.permutation(9 * 400)[:1500], 400)
    for top in (1000, 1 << 40, 1 << 52):
        weight, impact = rng.integers(0, top, 900), rng.integers(0, 1_000_000 if top < 1 << 41 else 500, 1500)
        want = np.zeros((5, 9), object)
        for i, t, w in zip(item.tolist(), term.tolist(), weight.tolist(), strict=True):
            for d, u, x in zip(doc.tolist(), doc_term.tolist(), impact.tolist(), strict=True):
                if t == u:
                    want[i, d] += w * x
        if want.max() < 1 << 63:
            assert (tile_scores(5, item, term, weight, 9, doc, doc_term, impact, width=37) == want).all()


def test_search_matches_plain(spark, make, odd):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["É", "Ab", "aB", "日本", "x_y", "a-b"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 400)]  # ties
    docs += [(400, None), (401, ""), (402, "..."), (None, "w1 w2")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(40, None), (41, "nowhere"), (42, "w1 w1 W1")]
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    want = plain_search(docs, items, 7)
    assert found_by(make(docs).repartition(4), table, k=7) == want
    assert found_by(make(docs).repartition(4), table, k=7, slice_terms=20) == want
    named = spark.createDataFrame([("a", "12 WORD1X", 1), ("a", "345", 2), (None, "12", 3)], "item_id string, text string, rank int")
    assert found_by(odd, named) == plain_search([(x["doc_id"], x["text"]) for x in odd.collect()], [("a", "12 word1x 345")], 20)


def test_search_in_empty_tables(spark, make, nothing):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert found_by(nothing, items) == set()
    assert found_by(make([(1, "word")]), items.limit(0)) == set()
    assert found_by(make([(1, None)]), items) == set()


# Pieces.


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    return sentencepiece.SentencePieceProcessor(model_file=tokenizers.path(MODEL))


def test_pieces_match_the_library(library):
    import public_tokenizers

    from ratiocert.llm.pieces import Pieces

    own = Pieces(public_tokenizers.path(MODEL))
    pieces, chars = sorted(own.id), sorted(own.chars)
    rng = random.Random(5)
    kinds = [
        lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))),
        lambda: "".join(rng.choice("abcdeinorst  \n.,-=*/#") for _ in range(rng.randint(1, 30))),
        lambda: " " * rng.randint(0, 40) + rng.choice(["", "a", "the", "\t\n", "x  y", "<s>", "<0x41>"]),
        lambda: "".join(rng.choice(chars) for _ in range(rng.randint(1, 12))),
        lambda: "".join(chr(rng.choice([rng.randint(0, 300), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x1FFFF), 32, 0x2581])) for _ in range(9)),
    ]
    for n in range(20_000):
        text = kinds[n % len(kinds)]()
        ids = library.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids), text
    for _ in range(10_000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(0, 3), 259, 29871]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_pieces_of_odd_rows(spark, make, odd, nothing, library):
    long = [(1, "ab" * 200_000), (2, "日本語" * 30_000), (3, " " * 50_000), (4, "\n" * 1000 + "\U0001f600\0")]
    for df in (odd, make(long), nothing):
        texts = {x["doc_id"]: x["text"] or "" for x in df.collect()}
        rows = decode_pieces(encode_pieces(df, MODEL), MODEL).collect()
        assert len(rows) == df.count()
        for x in rows:
            assert x["ids"] == library.encode(texts[x["doc_id"]]) and x["text"] == texts[x["doc_id"]]


def test_ids_without_a_text(spark):
    df = spark.createDataFrame([(1, None), (2, [5, None]), (3, [-1]), (4, [32000]), (5, [])], "doc_id int, ids array<int>")
    assert {x["doc_id"]: x["text"] for x in decode_pieces(df, MODEL).collect()} == {1: None, 2: None, 3: None, 4: None, 5: ""}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_piece_query(spark, library):
    import hashlib

    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = {}
    for x in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(x["text"] or "")
        want[x["doc_id"]] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in QUERIES["op13_piece_codec"](spark, SF).collect()}
    assert got == want
