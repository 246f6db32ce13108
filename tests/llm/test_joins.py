"""Jaccard join, suffix deduplication, vector search and components against brute force, and their edge cases."""

import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from ratiocert.llm import jaccard_join, suffix_dedup, vector_dedup
from ratiocert.llm.components import components
from ratiocert.operators import lookup

from .conftest import LONG


def union_find(n, pairs):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(200, 200), (301, 300)]
    pairs += [(r.randint(400, 480), r.randint(400, 480)) for _ in range(60)]
    r.shuffle(pairs)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_jaccard(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union_find(sets, links).items()}


def copies(r, n_groups, size, edits):
    out, i = [], 0
    common = " ".join(r.choice(VOCABULARY) for _ in range(30))
    for g in range(n_groups):
        base = [r.choice(VOCABULARY) for _ in range(r.randint(1, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            out.append((i, " ".join(w + (common.split() if r.random() < 0.5 else []))))
            i += 1
    r.shuffle(out)
    return out


VOCABULARY = [f"w{i}" for i in range(60)]


@pytest.mark.parametrize("n,percent,edits", [(4, 85, 2), (5, 80, 4), (1, 60, 8)])
def test_jaccard_components_are_exact(make, monkeypatch, n, percent, edits):
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", 300)  # several blocks a home
    texts = copies(random.Random(n), 25, 8, edits)
    got = jaccard_join.jaccard_components(make(texts), words=n, percent=percent)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == plain_jaccard(texts, n, percent)


def near_copies(r, n):
    """One large group of near copies, and as many texts that share a passage but are no copies."""
    base = [r.choice(VOCABULARY) + str(k) for k in range(90)]
    passage = " ".join(f"p{k}" for k in range(45))
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(90)] = f"edit{r.randrange(10**6)}"
        out.append((2 * i, " ".join(w)))
        out.append((2 * i + 1, passage + " " + " ".join(f"{r.choice(VOCABULARY)}x{r.randrange(10**6)}" for _ in range(60))))
    return out


@pytest.mark.parametrize("blocks", [1 << 18, 4000])
def test_large_groups_of_near_copies(make, monkeypatch, blocks):
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", blocks)
    texts = near_copies(random.Random(blocks), 250)
    got = jaccard_join.jaccard_components(make(texts), words=4, percent=85)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == plain_jaccard(texts, 4, 85)


@pytest.mark.parametrize("small", [0, 5, 64])
def test_open_lists_are_settled_exactly(make, monkeypatch, small):
    """Without any round of homes after the first, searched lists and counted pairs must find the rest alone."""
    monkeypatch.setattr(jaccard_join, "MOST_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", small)
    monkeypatch.setattr(jaccard_join, "DEPTH", 3)
    texts = copies(random.Random(8), 25, 8, 4)
    got = jaccard_join.jaccard_components(make(texts), words=3, percent=70)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == plain_jaccard(texts, 3, 70)


def test_slices_of_texts_and_lists_give_the_same(make, monkeypatch):
    """all texts, postings and open lists were shuffled at once, which took over four times the input's disk where many are near copies."""
    r = random.Random(4)
    texts = copies(r, 12, 5, 3) + [(1000, None), (1001, "")]
    rows = plain_jaccard(texts, 3, 70)
    made = []
    keep_all = jaccard_join.Shelf.keep_all

    def counted(self, parts):
        parts = list(parts)
        made.append([p.count() for p in parts])
        return keep_all(self, parts)

    monkeypatch.setattr(jaccard_join.Shelf, "keep_all", counted)
    monkeypatch.setattr(lookup, "MOST_BROADCAST", 0)  # the bitmap and shuffled joins
    for name in ("SLICE_ROWS", "SLICE_GRAMS", "SLICE_PAIRS"):
        monkeypatch.setattr(jaccard_join, name, 1)
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 5)  # some open lists are searched, pairs of others counted
    monkeypatch.setattr(jaccard_join, "MOST_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "DEPTH", 3)
    got = jaccard_join.jaccard_components(make(texts), words=3, percent=70)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == rows
    assert len(made[0]) == jaccard_join.MOST_SLICES and max(made[0]) < sum(made[0]) / 2


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(6)
    ruled_out = 0
    for size in (1, 2, 7, 8, 9, 60, 900, 6000):
        for share in (0.0, 0.5, 0.8, 0.84, 0.86, 0.9, 0.97, 1.0):
            x = np.unique(r.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, size).astype(np.uint64))
            own = r.integers(0, 2**63, int(size * r.uniform(0, 1.2)) + 1).astype(np.uint64)
            y = np.unique(np.concatenate([x[:int(len(x) * share)], own[:int((1 - share) * size * r.uniform(0, 1.3))]]))
            if not len(y):
                continue
            both = len(np.intersect1d(x, y))
            for percent in (1, 60, 85, 100):
                links = 100 * both >= percent * (len(x) + len(y) - both)
                can = jaccard_join.can_link((len(x), len(y)), (jaccard_join.sketch(x), jaccard_join.sketch(y)), percent)
                assert can or not links
                ruled_out += not can
    crowded = np.arange(4000, dtype=np.uint64) * np.uint64(1 << 20)  # all in one place, which counts to 255
    assert jaccard_join.can_link((4000, 3900), (jaccard_join.sketch(crowded), jaccard_join.sketch(crowded[:3900])), 85)
    assert ruled_out > 60


def test_sets_that_share_enough_lists_both_keep_the_smallest(spark):
    r = random.Random(8)
    rows, lists = [], [(t, r.randint(2, 200), r.randint(1, 3)) for t in range(60)]
    for node in range(30):
        depth = r.randint(1, 16)
        rows += [(t, node, 20, node, depth, c, w) for t, c, w in lists if r.random() < 0.4]
    kept = jaccard_join._with_kept(spark.createDataFrame(rows, "token long, node long, n long, component long, depth int, c long, w long")).collect()
    mine = defaultdict(dict)
    for x in kept:
        mine[x["node"]][x["token"]] = x
    met = 0
    for a in mine:
        for b in mine:
            shared = [(x["c"], -t, t) for t, x in mine[a].items() if t in mine[b]]
            depth = max(next(iter(mine[k].values()))["depth"] for k in (a, b))
            if a < b and sum(mine[a][t]["w"] for *_, t in shared) >= depth:
                met += 1
                least = min(shared)[2]
                assert mine[a][least]["kept"] and mine[b][least]["kept"]
    assert met > 50 and not all(x["kept"] for x in kept)


def test_blocks_of_a_group_are_dealt_to_many_tasks(spark):
    members = spark.createDataFrame([(1, 2, 3, 2, "a b c d")], "home long, node long, n long, component long, text string")
    edges = jaccard_join._searched(members.withColumn("text", members["text"].cast("binary")), "home", 4, 85)
    text = edges._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    last = text[text.index("FlatMapGroupsInPandas"):]
    assert re.search(r"Exchange hashpartitioning\(home#\d+L?, i#\d+, j#\d+", last)


def test_divide_skip_finds_all_links():
    r = np.random.default_rng(3)
    for percent in (50, 85, 100):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64)) for _ in range(80)]
        got = jaccard_join.linked(np.array([len(s) for s in sets]), sets, percent)
        links = [(a, b) for a in range(80) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        assert union_find(range(80), got) == union_find(range(80), links)


def test_every_way_to_count_long_lists_finds_all_links(monkeypatch):
    """By products in tiles, by setting lists aside, and by merging all; pairs that agree in a side don't count."""
    r = np.random.default_rng(4)
    for percent, far in ((30, 2), (60, 0), (85, 5)):
        base = r.choice(90, (4, 45))
        sets = [np.unique(np.append(base[i % 4][r.random(45) < 0.9], r.integers(90, 2000, 3))).astype(np.uint64) for i in range(90)]
        sides = [r.integers(0, 30, 90), r.integers(0, 3, 90)]
        differ = lambda a, b: all(s[a] != s[b] for s in sides)
        links = [(a, b) for a in range(90) for b in range(a) if differ(a, b) and 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        monkeypatch.setattr(jaccard_join, "TILE", 90 * 7)
        monkeypatch.setattr(jaccard_join, "LONG_LIST", far)
        for dense in (2048, 0):
            for share in (1, 12, 1000):
                monkeypatch.setattr(jaccard_join, "DENSE_SHARE", share)
                got = jaccard_join.linked(np.array([len(s) for s in sets]), sets, percent, sides, dense)
                assert all(differ(a, b) for a, b in got) and union_find(range(90), got) == union_find(range(90), links)
        assert links


def test_sets_of_many_texts_are_made_in_little_memory():
    texts = [" ".join(f"w{k}x{i}" for i in range(130)).encode() for k in range(2000)]
    tracemalloc.start()
    n = sum(len(s) for s in jaccard_join._sets(texts, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * 127 and peak < 20e6


def test_only_sets_that_may_link_are_searched():
    """A passage in common does not make a link; such sets used to meet each other all the same."""
    passage = np.arange(40, dtype=np.uint64)
    sets = [np.append(passage, np.arange(1000 * i, 1000 * i + 60, dtype=np.uint64)) for i in range(1, 50)]
    owner, first = jaccard_join._shared_grams(np.full(49, 100), sets, 85, [np.arange(49)])
    assert not len(owner) and not len(first)
    sets += [sets[7].copy(), sets[8].copy()]
    component = np.append(np.arange(50), 8)  # the last is known to belong to its copy
    owner, first = jaccard_join._shared_grams(np.full(51, 100), sets, 85, [component])
    assert set(owner.tolist()) == {7, 49} and len(first) == 100 and jaccard_join.linked(np.full(51, 100), sets, 85, [component]) == [(7, 49)]


def test_jaccard_edges(odd, nothing):
    got = jaccard_join.jaccard_components(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in got.collect())
    n = rows[-1][1]
    assert rows == [(0, 5, None), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 7), (8, n, 8), (8, n, 8), (9, n, 8)]
    assert jaccard_join.jaccard_components(nothing).count() == 0


def plain_removal(texts, length):
    seen, out = {}, {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p:p + length], i) < i:
                mark[p:p + length] = b"\x01" * length
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(mark))]
        out[i] = (len(b), sum(mark), spans, bytes(x for x, m in zip(b, mark) if not m))
    return out


def check_removal(docs, texts, length):
    got = suffix_dedup.remove_repeats(docs, length=length)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], [tuple(s) for s in x["spans"]], bytes(x["kept"])) for x in got.collect()} == plain_removal(texts, length)


@pytest.mark.parametrize("length", [50, 12])
@pytest.mark.parametrize("many", [1 << 15, 1])
def test_removed_bytes_are_exact(make, monkeypatch, length, many):
    monkeypatch.setattr(suffix_dedup, "MANY_STRETCHES", many)
    r = random.Random(7)
    passages = ["".join(r.choice("abcd é") for _ in range(r.randint(10, 150))) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcd é") for _ in range(r.randint(0, 90))) for _ in range(5)]
        texts.append((i * 3 % 61, "".join(parts)))
    texts += [(100, "x" * 400), (101, "x" * 130), (102, "ab" * 200), (103, "ab" * 80), (104, None), (105, ""), (106, "x" * length)]
    check_removal(make(texts), texts, length)


def test_suffix_order_with_ties():
    r = np.random.default_rng(1)
    for trial in range(200):
        n = r.integers(1, 300)
        buffer = r.integers(97, 97 + r.integers(1, 4), n + 60).astype(np.uint8)
        if trial % 3 == 0:
            buffer = np.tile(buffer[:7 + trial % 11], 60)[:n + 60].copy()
        length, group = int(r.integers(1, 60)), r.integers(0, 3, n)
        place = r.permutation(n)
        order, new = suffix_dedup.suffix_classes(buffer, place, group, length)
        keys = [(group[i], bytes(buffer[place[i]:place[i] + length])) for i in order]
        assert keys == sorted(keys)
        assert new.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:])]


def test_suffix_edges(odd, nothing):
    got = suffix_dedup.remove_repeats(odd).collect()
    by = defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x["n_removed"])
    assert by[8] == [0, 0] and by[9] == [len(LONG)] and by[5] == by[3] == [0] and by[None] == [0]
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_texts_that_share_an_id_are_judged_alone(make):
    t, u = "".join(random.Random(1).choices("abcdefgh ", k=151)), "".join(random.Random(2).choices("ijklmnop ", k=302))
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix_dedup.remove_repeats(make([(1, t), (5, t), (5, u), (6, u)])).collect())
    assert got == [(1, 151, 0), (5, 151, 151), (5, 302, 0), (6, 302, 302)]
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix_dedup.remove_repeats(make([(5, t), (5, u), (7, "x" + t), (7, u[:100])])).collect())
    assert got == [(5, 151, 0), (5, 302, 0), (7, 100, 100), (7, 152, 151)]


def test_vectors_are_linked_exactly(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 24))
    x = [b + 0.12 * s * r.normal(size=24) for b in base for s in (0, 0, 1, 1.5, 2)]
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    a = np.array([v for _, v, _ in rows])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    close = a @ a.T >= 0.95
    np.fill_diagonal(close, False)
    want = union_find(range(len(a)), np.argwhere(close).tolist())
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] + [1.0] * 23, 1), (904, [], 1),
           (905, [float("inf")] + [1.0] * 23, 1), (906, [1.0, 0.0], 1), (907, [1.0, 0.0], 1), (None, [1.0] * 24, 1)]
    schema = "vec_id long, embedding array<float>, node int"
    got = {z["vec_id"]: z for z in vector_dedup.near_vectors(spark.createDataFrame(rows + odd, schema)).collect()}
    found = sum(got[i]["n_links"] for i in range(len(a)))
    assert found >= 0.9 * close.sum() and all(got[i]["n_links"] <= close[i].sum() for i in range(len(a)))
    if found == close.sum():
        assert {i: got[i]["component_id"] for i in range(len(a))} == want
    for i in range(900, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[907]["n_links"], got[907]["component_id"], got[907]["kept"]) == (1, 906, False)
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_ties_at_the_limit_and_shared_ids_of_vectors(spark):
    # 0.96 and 0.28 are the sides of a right triangle of 1; 24/25 is a cosine at which a link is one.
    rows = [(1, [1.0, 0.0], 1), (2, [0.96, 0.28], 1), (3, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (4, [0.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    got = sorted((z["vec_id"], z["n_links"], z["component_id"]) for z in vector_dedup.near_vectors(df, cosine=0.96).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3), (4, 0, 4)] or got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3), (4, 0, 4)]
