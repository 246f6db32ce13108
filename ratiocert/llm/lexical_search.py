"""Ranked lexical search: items' term weights times documents' impacts, as dense blocked matrix products of exact integers.

Of each document only the occurrences of items' terms and its length are kept. For scoring, a tile of documents and a tile of
items meet over tiles of terms: the items' weights (items x terms) times the documents' impacts (terms x documents) is one
matrix product in float64. Terms are compacted to those that the items of the tile hold and the documents of the tile too. Weights
and impacts are integers, and a term tile is only as wide as keeps every partial sum below 2^53, so products are exact;
tiles add up in 64-bit integers.

Items are a stated query set: they are dealt out in slices of bounded vocabulary, one pass over the documents each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .base import bounded
from .blocks import Best, best_rows, sliced

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # of UTF-8: the ASCII digits and letters, and all characters beyond ASCII
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
WINDOW = 1 << 20  # bytes of a text whose terms are held at a time
SLICE_TERMS = 1 << 18  # distinct (item, term) of the items sent at a time
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 2048, 1024
EXACT = 1 << 53


def windows(text: bytes) -> Iterator[bytes]:
    """``text`` in lower case (A-Z only), cut between terms."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + WINDOW) if at + WINDOW < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower()
        at = end


def term_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for part in windows(text or b""):
        counts.update(TERM.findall(part))
    return counts


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, qtf): how often each item holds each of its terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text"), strict=True):
                terms = term_counts(text.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(terms), batch.column("item").type), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64())],
                    names=["item", "term", "qtf"],
                )

    narrow = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    kind = narrow.schema["item"].dataType.simpleString()
    counted = narrow.mapInArrow(count, f"item {kind}, term binary, qtf bigint")
    return counted.groupBy("item", "term").agg(F.sum("qtf").alias("qtf"))


class _Slice:
    """Items in tiles; terms by number. ``weights`` is set once the documents are counted."""

    def __init__(self, table: pa.Table):
        terms = table.column("term").to_pylist()
        self.number = {t: i for i, t in enumerate(sorted(set(terms)))}
        self.items = sorted(set(table.column("item").to_pylist()))
        place = {x: i for i, x in enumerate(self.items)}
        item = np.array([place[x] for x in table.column("item").to_pylist()], np.int64)
        order = np.argsort(item, kind="stable")
        self.item = item[order]
        self.term = np.array([self.number[t] for t in terms], np.int64)[order]
        self.qtf = table.column("qtf").to_numpy()[order]

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.weights = self.qtf * w[self.term]

    def tiles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first item, item of each entry, its term, its weight) of each tile of items."""
        for first in range(0, len(self.items), TILE_ITEMS):
            a, b = np.searchsorted(self.item, (first, first + TILE_ITEMS))
            yield first, self.item[a:b] - first, self.term[a:b], self.weights[a:b]


def _postings(docs: DataFrame, sent) -> DataFrame:
    """(id, n, terms, tfs): number of terms of each document and those that the slice's items hold."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        for batch in batches:
            sizes, offsets, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                n, held = 0, Counter()
                for part in windows(text.as_py() or b""):
                    words = TERM.findall(part)
                    n += len(words)
                    held.update(map(number.get, words))
                held.pop(None, None)
                terms.extend(held)
                tfs.extend(held.values())
                sizes.append(n)
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))],
                names=["id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(count, "id bigint, n bigint, terms array<int>, tfs array<bigint>").where("n > 0")


def tile_scores(items: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int, doc: np.ndarray, doc_term: np.ndarray,
                impact: np.ndarray, width: int = TILE_TERMS) -> np.ndarray:
    """Scores (items x docs) of sparse weights (item, term) and sparse impacts (doc, term), by dense products of term tiles."""
    out = np.zeros((items, docs), np.int64)
    both = np.intersect1d(term, doc_term)
    if not len(both):
        return out
    column, spot = (np.searchsorted(both, x) for x in (term, doc_term))
    held = both[np.minimum(column, len(both) - 1)] == term
    item, weight, column = item[held], weight[held], column[held]
    held = both[np.minimum(spot, len(both) - 1)] == doc_term
    doc, impact, spot = doc[held], impact[held], spot[held]
    by_column, by_spot = np.argsort(column, kind="stable"), np.argsort(spot, kind="stable")
    item, weight, column = item[by_column], weight[by_column], column[by_column]
    doc, impact, spot = doc[by_spot], impact[by_spot], spot[by_spot]
    highest = int(impact.max())
    first = 0
    while first < len(both):
        last = min(first + width, len(both))
        while True:
            a, b = np.searchsorted(column, (first, last))
            bound = int(np.bincount(item[a:b], weight[a:b].astype(np.float64)).max() * (1 + 1e-9)) + 1
            if bound * highest < EXACT or last == first + 1:
                break
            last = first + (last - first) // 2
        c, d = np.searchsorted(spot, (first, last))
        kind = np.float64 if bound * highest < EXACT else np.int64  # a single term beyond: products of 64-bit integers
        left, right = np.zeros((items, last - first), kind), np.zeros((last - first, docs), kind)
        left[item[a:b], column[a:b] - first] = weight[a:b]
        right[spot[c:d] - first, doc[c:d]] = impact[c:d]
        out += (left @ right).astype(np.int64)
        first = last
    return out


def _search(postings: DataFrame, sent, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        best = Best(len(held.items), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(lo, TILE_DOCS)
                ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
                doc = np.repeat(np.arange(len(ids)), part.column("terms").value_lengths().to_numpy())
                term = part.column("terms").flatten().to_numpy().astype(np.int64)
                tf = part.column("tfs").flatten().to_numpy()
                m = 75 + 25 * n * n_docs // n_terms
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                for first, item, item_term, weight in held.tiles():
                    n_items = min(TILE_ITEMS, len(held.items) - first)
                    score = tile_scores(n_items, item, item_term, weight, len(ids), doc, term, impact)
                    enters = (score > 0) & best.may_enter(slice(first, first + n_items), score, ids)
                    a, d = np.nonzero(enters)
                    best.add(first + a, score[a, d], ids[d])
        group, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(ids), pa.array(score)], names=["place", "id", "score"])

    scored = postings.where("id IS NOT NULL AND size(terms) > 0")
    return best_rows(scored.mapInArrow(search, "place bigint, id bigint, score bigint"), ["place"], "score", "id", k)


def search_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", k: int = 20, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(item, rank, id, score): each item's k documents of highest score above 0, equal scores by ascending id.

    Terms are runs of ASCII digits and letters and of characters beyond ASCII, A-Z as a-z. The score of a document adds up, over
    the item's terms and their repeats, w * (10^9 tf div (1000 tf + 12 m)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and
    m = 75 + (25 n N) div L: N documents with a term, L terms of all, n terms of this one, df documents with the term.

    Null and empty texts have no terms and are no documents; a document with a null id counts, but is not ranked. Rows that share
    an id are documents of their own. Items that are null, without terms or found nowhere give no rows; rows that share
    an item id are one item, with the terms of all. Other columns are not kept, so that none can clash. An empty table on either
    side gives an empty result.
    """
    spark = docs.sparkSession
    bounded(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    terms = cut_lineage(_item_terms(items, item_col, item_text))
    wide = terms.groupBy("item").agg(F.count("*").alias("w"))
    dealt, n = sliced(wide, "item", "w", slice_terms)
    kind = f"`{item_col}` {terms.schema['item'].dataType.simpleString()}, rank int, `{id_col}` bigint, score bigint"
    path = scratch_path(spark, "ranked")
    spark.createDataFrame([], kind).write.parquet(path)
    for s in range(n):
        table = terms.join(dealt.where(F.col("slice") == s).select("item"), "item", "left_semi").toArrow()
        if not table.num_rows:
            continue
        held = _Slice(table)
        sent = spark.sparkContext.broadcast(held)
        postings = cut_lineage(_postings(narrow, sent))
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(held.number), np.int64)
        for term, count in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = count
        held.weigh(n_docs, df)
        weighed = spark.sparkContext.broadcast(held)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(held.items)], f"place bigint, item {terms.schema['item'].dataType.simpleString()}")
        found = _search(postings, weighed, n_docs, n_terms, k).join(F.broadcast(names), "place")
        found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score").write.mode("append").parquet(path)
        sent.destroy()
        weighed.destroy()
    return spark.read.schema(kind).parquet(path)
