"""Benchmark decontamination by greedy string tiling.

Texts and test items that share a seed (a run of ``seed_words`` words) are compared by greedy string tiling: again and again the
longest common runs that overlap no earlier one are marked, found by running Karp-Rabin, until none of ``tile_words`` words is
left. As tiles may lie in any order, a passage whose sentences were moved around is still covered. A text is
contaminated when its tiles cover at least ``coverage`` of an item's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import SMALL_BATCH, bounded, word_count
from .tokens import Words, chunked, mixed

SEED_WORDS = 5
TILE_WORDS = 3
COVERAGE = 0.8
SLICE_WORDS = 1_000_000  # so many words of test items are sent to every executor at once (8 MB)
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93  # fixed odd multiplier of the running hash


def _runs(free: np.ndarray, size: int) -> np.ndarray:
    """First places of all windows of ``size`` words without a marked one."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[:-size])


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hashes of all windows of ``size`` words, by doubling."""
    done, value, length = np.zeros(len(words) + 1, _U)[: max(len(words) - size + 1, 0)], words, 1
    offset, rest = 0, size
    factor = _BASE
    while rest:
        if rest & 1:
            done = done * _U(factor) + value[offset:offset + len(done)]
            offset += length
        rest >>= 1
        if rest:
            value = value[:len(value) - length] * _U(factor) + value[length:]
            factor = factor * factor & (2**64 - 1)
            length *= 2
    return mixed(done)


def _longest_common(item: np.ndarray, text: np.ndarray, least: int) -> int:
    """The longest common run, by bisection over window sizes; 0 if below ``least``."""
    lo, hi = least - 1, min(len(item), len(text))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if np.isin(_window_hashes(item, mid), _window_hashes(text, mid)).any():
            lo = mid
        else:
            hi = mid - 1
    return lo if lo >= least else 0


def tiles(item: np.ndarray, text: np.ndarray, least: int = TILE_WORDS, top: int | None = None) -> list[tuple[int, int, int]]:
    """(place in item, place in text, words) of the tiles, longest first; ties go to the first place in the item, then in the
    text. ``top`` is a bound on the longest common run, if known."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    size = min(len(item), len(text)) if top is None else top
    while size >= least:
        a, b = _runs(free_i, size), _runs(free_t, size)
        if not len(a) or not len(b):
            size -= 1
            continue
        ha, hb = _window_hashes(item, size)[a], _window_hashes(text, size)[b]
        common = np.flatnonzero(np.isin(ha, hb))
        for k in common.tolist():
            i = int(a[k])
            if not free_i[i:i + size].all():
                continue
            for t in b[hb == ha[k]].tolist():
                if free_t[t:t + size].all() and np.array_equal(item[i:i + size], text[t:t + size]):
                    free_i[i:i + size] = False
                    free_t[t:t + size] = False
                    out.append((i, t, size))
                    break
        size -= 1
    return out


def coverage_of(item: np.ndarray, text: np.ndarray, least: int = TILE_WORDS) -> tuple[float, int]:
    """Share of the item's words that tiles cover, and the number of tiles.

    Words of the text outside any common run of ``least`` words can be in no tile, so only the others are tiled.
    """
    least = min(least, max(len(item), 1))
    size = len(item)
    if not size or len(text) < least:
        return 0.0, 0
    inside = np.zeros(len(text), bool)
    hit = np.flatnonzero(np.isin(_window_hashes(text, least), _window_hashes(item, least)))
    for j in range(least):
        inside[hit + j] = True
    if not inside.any():
        return 0.0, 0
    # one break word (0 is no word's hash here) stands for each stretch left out
    starts = inside & ~np.concatenate([[False], inside[:-1]])
    kept = np.flatnonzero(inside)
    text = np.insert(text[kept], np.flatnonzero(starts[kept])[1:], _U(0))
    top = _longest_common(item, text, least)
    if not top:
        return 0.0, 0
    found = tiles(item, text, least, top)
    return sum(n for _, _, n in found) / size, len(found)


class _Slice:
    """Some test items with their seeds, ready to be sent to the executors."""

    def __init__(self, ids: list[int], texts: list[str | None], seed_words: int):
        words = Words([(t or "").encode("utf-8", "replace") for t in texts])
        self.ids = ids
        self.items = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(len(x), seed_words) for x in self.items if len(x)}):
            pairs = [(np.unique(_window_hashes(x, size)), k) for k, x in enumerate(self.items) if min(len(x), seed_words) == size]
            seed = np.concatenate([h for h, _ in pairs])
            owner = np.concatenate([np.full(len(h), k) for h, k in pairs])
            order = np.lexsort((owner, seed))
            seed, owner = seed[order], owner[order]
            maybe = np.zeros(1 << 20, bool)
            maybe[(seed >> _U(44)).astype(np.int64)] = True
            self.seeds[size] = (seed, owner, maybe)

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(text, item) pairs that share a seed."""
        out: set[tuple[int, int]] = set()
        for size, (seed, owner, maybe) in self.seeds.items():
            h = _window_hashes(words.hash, size)
            spot = np.flatnonzero(maybe[(h >> _U(44)).astype(np.int64)])
            lo, hi = np.searchsorted(seed, h[spot]), np.searchsorted(seed, h[spot], side="right")
            spot, lo, hi = spot[hi > lo], lo[hi > lo], hi[hi > lo]
            text = np.searchsorted(words.first, spot, side="right") - 1
            whole = spot + size <= words.first[text + 1]
            for t, a, b in zip(text[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True):
                out.update((t, k) for k in owner[a:b].tolist())
        return out


def _slices(benchmark: DataFrame, item_col: str, text_col: str, seed_words: int, slice_words: int) -> Iterator[_Slice]:
    """The test items in slices of bounded size; an item longer than a slice is one of its own."""
    counted = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"), word_count(text_col).alias("n"))
    ids, texts, held = [], [], 0
    for row in counted.where("n > 0").orderBy("id", "text").toLocalIterator():
        if ids and held + row["n"] > slice_words:
            yield _Slice(ids, texts, seed_words)
            ids, texts, held = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        held += row["n"]
    if ids:
        yield _Slice(ids, texts, seed_words)


def tile_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS,
                   tile_words: int = TILE_WORDS, coverage: float = COVERAGE, slice_words: int = SLICE_WORDS,
                   keep: bool = False) -> DataFrame:
    """(id, contaminated, n_items, item_id, coverage, n_tiles) of every whole text; or, with ``keep``, the rows of ``docs``
    that are not contaminated, with all their columns.

    ``n_items`` items reach ``coverage``; ``item_id`` is the one covered most (ties: smallest id), null if none shares a
    seed. The test set is sent to the executors in slices of at most ``slice_words`` words, one at a time: a larger one takes one
    pass over the texts per slice, with the rows stored in between. Items of fewer words than a seed have their whole text as seed.

    Null and empty texts share nothing; items without words are left out; an empty test set leaves all texts clean.
    Repeated rows are judged each. Without ``keep``, columns other than the id are not kept, so that none can clash.
    """
    bounded(docs.sparkSession, SMALL_BATCH)
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    begin = narrow.select("id", "text", F.lit(0).cast("long").alias("n"), F.lit(None).cast(item_kind).alias("item"), F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("tiles"))
    now = docs if keep else begin
    slices = _slices(benchmark, item_col, item_text_col, seed_words, slice_words)
    part = next(slices, None)
    while part is not None:
        after = next(slices, None)  # the one slice that waits in the driver
        sent = docs.sparkSession.sparkContext.broadcast(part)
        if keep:
            now = _clean(now, sent, text_col, tile_words, coverage)
        else:
            now = _judge(now, sent, tile_words, coverage, kind, item_kind, last=after is None)
        if after is not None:
            now = cut_lineage(now)
            sent.destroy()
        part = after
    if keep:
        return now
    return now.select(
        F.col("id").alias(id_col), (F.col("n") > 0).alias("contaminated"), F.col("n").alias("n_items"), F.col("item").alias("item_id"),
        F.col("share").alias("coverage"), F.col("tiles").alias("n_tiles"),
    )


def _verdicts(part: _Slice, texts: list[bytes | None], tile_words: int, coverage: float) -> Iterator[tuple]:
    """(items that reach the coverage, the item covered most, its share, its tiles) of each text."""
    for _, some in chunked(texts):
        words = Words(some)
        found: dict[int, list[tuple]] = {}
        for t, k in sorted(part.candidates(words)):
            share, n = coverage_of(part.items[k], words.hash[words.first[t]:words.first[t + 1]], tile_words)
            found.setdefault(t, []).append((-share, part.ids[k], n))
        for t in range(len(some)):
            mine = sorted(found.get(t, []))
            reached = sum(-s >= coverage for s, _, _ in mine)
            yield (reached, mine[0][1], -mine[0][0], mine[0][2]) if mine else (0, None, 0.0, 0)


def _clean(docs: DataFrame, sent, text_col: str, tile_words: int, coverage: float) -> DataFrame:
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([r[0] == 0 for r in _verdicts(sent.value, texts, tile_words, coverage)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def _judge(rows: DataFrame, sent, tile_words: int, coverage: float, kind: str, item_kind: str, last: bool) -> DataFrame:
    """The verdicts so far with those of one slice; the text goes on unless the slice is the last."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, item, share, tiles = (batch.column(c).to_pylist() for c in ("n", "item", "share", "tiles"))
            for row, (reached, best, most, count) in enumerate(_verdicts(sent.value, batch.column("text").to_pylist(), tile_words, coverage)):
                n[row] += reached
                if best is not None and (item[row] is None or (-most, best) < (-share[row], item[row])):
                    item[row], share[row], tiles[row] = best, most, count
            held = [
                batch.column("id"), *([] if last else [batch.column("text")]), pa.array(n, pa.int64()),
                pa.array(item, batch.column("item").type), pa.array(share, pa.float64()), pa.array(tiles, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(held, names=["id", *([] if last else ["text"]), "n", "item", "share", "tiles"])

    text = "" if last else "text binary, "
    return rows.mapInArrow(judge, f"id {kind}, {text}n bigint, item {item_kind}, share double, tiles bigint")
