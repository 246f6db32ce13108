"""Learning byte-pair merges from a corpus, many merges to a pass.

A symbol is one character of a word's spelling: characters stand for themselves, merged symbols get code points of their own from
the private-use planes. A merge is then a plain replacement in a string.

Merges are sequential by definition: each changes the counts that decide the next. But no merge makes a frequent pair out of rare
ones: a new pair occurs where an old pair of neighbours did, so it is at most as frequent. All pairs above a frequency
therefore live in the *islands* of a word, its runs of neighbours that form such pairs, and so do all pairs above that frequency
that any merges will make of them. One pass gathers the islands, equal ones with a count. On these few the merges above the
frequency are found one by one, exactly as on the whole corpus, and the next pass applies them all.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Different islands read to the driver in one round, and most frequent pairs that may form them.
MOST_ISLANDS = 100_000
MOST_PAIRS = 4096
# Islands that a task holds before it passes their counts on.
HELD_ISLANDS = 100_000
# Code points of merged symbols: the two private-use planes.
FIRST_CODE, LAST_CODE = 0xF0000, 0x10FFFD


def word_counts(corpus: DataFrame, tokens: Column) -> DataFrame:
    """(word, freq) over all texts; everything after works on distinct words."""
    return corpus.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def as_symbols(words: DataFrame) -> DataFrame:
    """Adds ``symbols``: the word's spelling, one character a symbol."""
    return words.withColumn("symbols", F.col("word"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, freq) over neighbouring symbols of all words."""
    # An empty separator splits a string into its characters.
    listed = words.where(F.length("symbols") > 1).select(F.split("symbols", "").alias("s"), "freq")
    pairs = F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")),
    )
    return (
        listed.select(F.explode(pairs).alias("p"), "freq")
        .groupBy("p.left", "p.right")
        .agg(F.sum("freq").alias("freq"))
    )


def islands(words: DataFrame, pairs: set[str]) -> DataFrame:
    """(island, freq): the runs of symbols whose neighbours are all among ``pairs``, over all words."""
    sent = words.sparkSession.sparkContext.broadcast(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["island", "freq"])
            held.clear()
            return batch

        for batch in batches:
            for word, freq in zip(batch.column("symbols").to_pylist(), batch.column("freq").to_pylist(), strict=True):
                first = 0
                for i in range(1, len(word) + 1):
                    if word[i - 1:i + 1] not in wanted:
                        if i - first > 1:
                            held[word[first:i]] += freq
                        first = i
            if len(held) >= HELD_ISLANDS:
                yield out()
        yield out()

    found = words.select("symbols", "freq").mapInArrow(cut, "island string, freq bigint")
    return found.groupBy("island").agg(F.sum("freq").alias("freq"))


class _Merger:
    """Merges one by one on a few spellings with counts; an index leads from a pair to the spellings that hold it."""

    def __init__(self, spellings: list[tuple[str, int]], spelled: dict[str, bytes], free: Iterator[str]):
        self.words = [list(s) for s, _ in spellings]
        self.freq = [n for _, n in spellings]
        self.spelled, self.free = spelled, free
        self.count: Counter[tuple[str, str]] = Counter()
        self.holders: dict[tuple[str, str], set[int]] = defaultdict(set)
        for at in range(len(self.words)):
            self._pairs(at, 1)
        self.heap = [self._key(p) for p in self.count]
        heapify(self.heap)

    def _key(self, pair: tuple[str, str]):
        return -self.count[pair], self.spelled[pair[0]], self.spelled[pair[1]], pair

    def _pairs(self, at: int, sign: int) -> set[tuple[str, str]]:
        word, n = self.words[at], sign * self.freq[at]
        found = set(zip(word, word[1:]))
        for pair in zip(word, word[1:]):
            self.count[pair] += n
        if sign > 0:
            for pair in found:
                self.holders[pair].add(at)
        return found

    def best(self):
        """(left, right, freq) of the most frequent pair, ties to the smaller spelling; None if none is left."""
        while self.heap:
            negative, _, _, pair = self.heap[0]
            if -negative == self.count[pair] and negative:
                return (*pair, -negative)
            heappop(self.heap)
            if 0 < self.count[pair] < -negative:
                heappush(self.heap, self._key(pair))
        return None

    def merge(self, left: str, right: str) -> str:
        symbol = next(self.free)
        self.spelled[symbol] = self.spelled[left] + self.spelled[right]
        changed: set[tuple[str, str]] = set()
        for at in self.holders.pop((left, right)):
            word = self.words[at]
            if len(word) < 2:
                continue
            self._pairs(at, -1)
            done, i = [], 0
            while i < len(word):
                both = i + 1 < len(word) and word[i] == left and word[i + 1] == right
                done.append(symbol if both else word[i])
                i += 1 + both
            self.words[at] = done
            changed |= self._pairs(at, 1)
        for pair in changed:
            if symbol in pair:
                heappush(self.heap, self._key(pair))
        return symbol


def _applied(words: DataFrame, merges: list[tuple[str, str, str]]) -> DataFrame:
    """All merges in their order, each from left to right; words of one symbol are done."""
    steps = F.array(*[F.struct(F.lit(left + right).alias("old"), F.lit(symbol).alias("new")) for left, right, symbol in merges])
    symbols = F.aggregate(steps, F.col("symbols"), lambda s, step: F.replace(s, step["old"], step["new"]))
    return words.select(symbols.alias("symbols"), "freq").where(F.length("symbols") > 1)


def _first_of_equals(pairs: DataFrame, freq: int, spelled: dict[str, bytes]) -> tuple[str, str]:
    """The pair of this frequency with the smallest spelling; names of symbols are looked up in Spark."""
    names = pairs.sparkSession.createDataFrame([(s, t.decode()) for s, t in spelled.items()], "symbol string, name string")
    left, right = names.toDF("left", "left_name"), names.toDF("right", "right_name")
    equal = pairs.where(F.col("freq") == freq).join(left, "left").join(right, "right")
    first = equal.agg(F.min(F.struct("left_name", "right_name", "left", "right")).alias("p")).first()["p"]
    return first["left"], first["right"]


def learn_merges(corpus: DataFrame, tokens: Column, vocabulary: int | None = None, rounds: int | None = None, special: int = 4,
                 most_islands: int = MOST_ISLANDS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(rank, left, right, freq) of the merges up to a vocabulary size or number of merges.

    The most frequent pair merges first, of equal ones the one of smaller spelling (as UTF-8 bytes, left before right). The driver
    receives the alphabet, ``most_pairs`` pairs and at most ``most_islands`` different islands a round; where there are more, the round
    takes fewer pairs. Where more pairs are equally frequent than may form islands, the round makes one merge.
    """
    spark = corpus.sparkSession
    words = cut_lineage(word_counts(corpus, tokens).select(F.col("word").alias("symbols"), "freq"))
    letters = [r[0] for r in words.select(F.explode(F.split("symbols", "")).alias("c")).distinct().collect()]
    spelled = {c: c.encode() for c in letters if c}
    wanted = rounds if rounds is not None else max(vocabulary - special - len(spelled), 0)
    taken = set(spelled)
    free = (c for c in map(chr, range(FIRST_CODE, LAST_CODE + 1)) if c not in taken and ord(c) & 0xFFFE != 0xFFFE)
    learned: list[tuple[int, str, str, int]] = []
    width = least = min(64, most_pairs)  # with more, pairs that were not read would count as absent
    while len(learned) < wanted:
        pairs = cut_lineage(pair_counts(words))
        top = pairs.orderBy(F.col("freq").desc()).limit(most_pairs + 1).collect()
        if not top:
            break
        limit, found, smaller = width, None, False
        while True:
            # Pairs strictly more frequent than the first one left out; no derived pair above that can be missed.
            floor = top[limit]["freq"] if limit < len(top) else 0
            above = [r for r in top if r["freq"] > floor]
            if above:
                found = cut_lineage(islands(words, {r["left"] + r["right"] for r in above}))
                n = found.count()
                if n <= most_islands:
                    break
                limit, found, smaller = len(above) // 2, None, True
            elif smaller or limit >= most_pairs:
                break
            else:
                limit = min(limit * 2, most_pairs)
        width = max(min(limit, most_pairs), 1)
        merges: list[tuple[str, str, str]] = []
        if found is None:
            left, right = _first_of_equals(pairs, top[0]["freq"], spelled)
            symbol = next(free)
            spelled[symbol] = spelled[left] + spelled[right]
            learned.append((len(learned), spelled[left].decode(), spelled[right].decode(), top[0]["freq"]))
            merges.append((left, right, symbol))
            width = max(width, least)
        else:
            few = _Merger([(r["island"], r["freq"]) for r in found.collect()], spelled, free)
            while len(learned) < wanted and (best := few.best()) and best[2] > floor:
                left, right, freq = best
                learned.append((len(learned), spelled[left].decode(), spelled[right].decode(), freq))
                merges.append((left, right, few.merge(left, right)))
            if n * 4 <= most_islands:
                width = min(width * 2, most_pairs)
        if len(learned) < wanted:
            words = cut_lineage(_applied(words, merges))
    return spark.createDataFrame(learned, "rank int, left string, right string, freq long")
