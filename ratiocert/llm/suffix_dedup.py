"""Removal of repeated byte strings by deep-shallow suffix sorting.

Every place where a string of ``length`` bytes starts is a suffix of interest. It is dealt out by the smallest fingerprint
of the k-byte strings inside it, so that equal strings meet, and neighbouring places with the same smallest fingerprint
travel as one stretch of text.

0. Of equal texts only the one with the smallest id is looked at; the others are repeats from end to end.
1. Fingerprints that only one document has can't repeat: counted in buckets of packed numbers, only the others come back.
2. Stretches around the others are gathered; equal ones are combined (smallest id) before and after the shuffle.
3. The suffixes of the stretches of one fingerprint are sorted: multikey quicksort over the first bytes, and blind tries
   for those whose common prefix is longer (:func:`suffix_classes`). Neighbours in the order that agree on ``length`` bytes get
   the smallest id among them as their owner. Fingerprints with very many different stretches are grouped suffix by suffix instead.
4. Where the owner is another document with a smaller id, the bytes go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import checked_broadcast
from ..session import cut_lineage
from .base import bounded
from .tokens import byte_values, chunked, mixed, powers

SHALLOW_BYTES = 16
STRETCH_STARTS = 64  # a longer stretch (of one repeated pattern) is cut
BUCKET_BYTES = 1 << 24  # text per bucket of fingerprints
MANY_STRETCHES = 1 << 15
_U = np.uint64
_NONE = np.iinfo(np.int64).max


def _gram_size(length: int) -> int:
    return max(1, min(16, length // 3))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span:width - span + len(x) - width + 1]) if width > span else out


class _Starts:
    """Places of some texts where a string of ``length`` bytes starts: text number, place in the joined bytes, fingerprint."""

    def __init__(self, texts: list[bytes], length: int):
        k = _gram_size(length)
        self.joined = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        count = np.maximum(sizes - length + 1, 0)
        if not count.sum():
            self.text = self.place = np.zeros(0, np.int64)
            self.mark = np.zeros(0, _U)
            return
        forward, back = powers(len(self.joined) + 1)
        total = np.zeros(len(self.joined) + 1, _U)
        np.cumsum(byte_values(False)[self.joined] * forward[:-1], dtype=_U, out=total[1:])
        grams = mixed((total[k:] - total[:-k]) * back[:len(total) - k])
        least = _window_min(grams, length - k + 1)
        ok = np.zeros(len(self.joined) + 1, np.int8)
        np.add.at(ok, self.begin[:-1][count > 0], 1)
        np.add.at(ok, (self.begin[:-1] + count)[count > 0], -1)
        self.place = np.flatnonzero(np.cumsum(ok))
        self.text = np.repeat(np.arange(len(texts)), count)
        self.mark = least[self.place]

    def runs(self) -> np.ndarray:
        """First index of each run of neighbouring places of one text with one fingerprint."""
        if not len(self.place):
            return np.zeros(0, np.int64)
        new = (self.mark[1:] != self.mark[:-1]) | (self.text[1:] != self.text[:-1])
        return np.concatenate([[0], np.flatnonzero(new) + 1])


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _shared_marks(narrow: DataFrame, length: int, buckets: int) -> DataFrame:
    """(id, marks): each document's fingerprints that another document has too, as packed sorted numbers."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            pairs = []
            for first, some in chunked(batch.column("text").to_pylist()):
                starts = _Starts(some, length)
                at = starts.runs()
                pairs.append((starts.mark[at], ids[first + starts.text[at]]))
            if not pairs:
                continue
            mark, owner = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((owner, mark))
            mark, owner = mark[order], owner[order]
            once = np.concatenate([[True], (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])]) if len(mark) else np.zeros(0, bool)
            mark, owner = mark[once], owner[once]
            head = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.zeros(0, np.int64)
            many = np.diff(np.append(head, len(mark))) > 1
            # Those found in two documents of this batch are settled: they go on as they are, and to the bucket as one entry.
            settled = np.repeat(many, np.diff(np.append(head, len(mark))))
            rows = []
            one_mark, one_owner, one_open = mark[head], owner[head], ~many
            place = (one_mark % _U(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[order], np.arange(buckets + 1)) if buckets <= len(place) else None
            groups = (
                ((b, order[cut[b]:cut[b + 1]]) for b in range(buckets)) if cut is not None
                else ((int(place[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(g))
            )
            for b, g in groups:
                if len(g):
                    rows.append((b, _packed(one_mark[g]), _packed(one_owner[g]), _packed(one_open[g])))
            if settled.any():
                rows.append((int(mark[0] % _U(buckets)), _packed(mark[settled]), _packed(owner[settled]), None))
            if rows:
                b, m, o, f = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int64()), pa.array(m, pa.binary()), pa.array(o, pa.binary()), pa.array(f, pa.binary())],
                    names=["bucket", "marks", "owners", "open"],
                )

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        marks, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        waiting = group[group["open"].notna()]
        for m, o in group.loc[group["open"].isna(), ["marks", "owners"]].itertuples(index=False):
            marks.append(np.frombuffer(m, _U))
            owners.append(np.frombuffer(o, np.int64))
        if len(waiting):
            mark = np.concatenate([np.frombuffer(x, _U) for x in waiting["marks"]])
            owner = np.concatenate([np.frombuffer(x, np.int64) for x in waiting["owners"]])
            alone = np.concatenate([np.frombuffer(x, bool) for x in waiting["open"]])
            order = np.argsort(mark, kind="stable")
            mark, owner, alone = mark[order], owner[order], alone[order]
            head = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            size = np.diff(np.append(head, len(mark)))
            differ = np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)
            met = np.logical_or.reduceat(~alone, head)  # some batch had it in two documents
            back = np.repeat(differ | met, size) & alone
            marks.append(mark[back])
            owners.append(owner[back])
        mark, owner = np.concatenate(marks), np.concatenate(owners)
        place = (mixed(owner.view(_U)) % _U(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        parts = [g for g in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(g)]
        return pd.DataFrame({
            "part": np.array([place[g[0]] for g in parts], np.int64),
            "marks": [_packed(mark[g]) for g in parts], "owners": [_packed(owner[g]) for g in parts],
        })

    def by_document(group: pd.DataFrame) -> pd.DataFrame:
        mark = np.concatenate([np.frombuffer(x, _U) for x in group["marks"]])
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in group["owners"]])
        order = np.lexsort((mark, owner))
        mark, owner = mark[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        return pd.DataFrame({"id": owner[head], "marks": [_packed(x) for x in np.split(mark, head[1:])]})

    counted = narrow.mapInArrow(emit, "bucket bigint, marks binary, owners binary, open binary")
    found = counted.groupBy("bucket").applyInPandas(settle, "part bigint, marks binary, owners binary")
    return found.groupBy("part").applyInPandas(by_document, "id bigint, marks binary")


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """(mark, content, id, h1, place, n): the stretches of (id, h1, text, marks) rows; n places of interest from ``place`` on."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h1"))
            texts, wanted = batch.column("text").to_pylist(), batch.column("marks")
            for first, some in chunked(texts):
                starts = _Starts(some, length)
                head = starts.runs()
                if not len(head):
                    continue
                size = np.diff(np.append(head, len(starts.place)))
                mark, text = starts.mark[head], starts.text[head]
                keep = np.zeros(len(head), bool)
                edge = np.searchsorted(text, np.arange(len(some) + 1))
                for t in range(len(some)):
                    a, b = edge[t], edge[t + 1]
                    if a < b:
                        known = np.frombuffer(wanted[first + t].as_buffer(), _U)
                        spot = np.minimum(np.searchsorted(known, mark[a:b]), len(known) - 1)
                        keep[a:b] = known[spot] == mark[a:b]
                head, size, mark, text = head[keep], size[keep], mark[keep], text[keep]
                pieces = -(-size // STRETCH_STARTS)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head, mark, text = np.repeat(head, pieces) + nth * STRETCH_STARTS, np.repeat(mark, pieces), np.repeat(text, pieces)
                size = np.minimum(np.repeat(size, pieces) - nth * STRETCH_STARTS, STRETCH_STARTS)
                place = starts.place[head] if len(head) else head
                width = size + length - 1
                offsets = np.concatenate([[0], np.cumsum(width)])
                index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - place, width)
                content = pa.Array.from_buffers(
                    pa.binary(), len(head), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(starts.joined[index])]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark.view(np.int64)), content, pa.array(ids[first + text].astype(np.int64)),
                     pa.array(keys[first + text].astype(np.int64)), pa.array(place - starts.begin[text]), pa.array(size)],
                    names=["mark", "content", "id", "h1", "place", "n"],
                )

    return docs.mapInArrow(emit, "mark bigint, content binary, id bigint, h1 bigint, place bigint, n bigint")


def _words_at(buffer: np.ndarray, place: np.ndarray, first: int, size: int) -> np.ndarray:
    """``size`` (at most 8) bytes from ``place + first`` on as one number that sorts as the bytes do."""
    out = np.zeros(len(place), _U)
    for j in range(first, first + size):
        out = out << _U(8) | buffer[place + j].astype(_U)
    return out


def suffix_classes(buffer: np.ndarray, place: np.ndarray, group: np.ndarray, length: int,
                   shallow: int = SHALLOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order within each group, and for each place of that order whether a new string of ``length`` bytes begins.

    Shallow: multikey quicksort, eight bytes a step, on the suffixes not told apart yet. Deep: one blind trie per group of
    suffixes that agree on ``shallow`` bytes, all tries a level at a time. A level compares the members with the first of
    their group, which finds where each branches off; the branches in order are the groups of the next level.
    """
    order = np.argsort(group, kind="stable")
    tie = np.concatenate([[0], np.cumsum(np.diff(group[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
    depth = 0
    while depth < min(shallow, length):
        step = min(8, min(shallow, length) - depth)
        open_ = _in_ties(tie)
        if not len(open_):
            break
        key = _words_at(buffer, place[order[open_]], depth, step)
        local = np.lexsort((key, tie[open_]))
        order[open_] = order[open_][local]
        key, old = key[local], tie[open_]
        new = np.zeros(len(tie), bool)
        new[1:] = tie[1:] != tie[:-1]
        change = np.concatenate([[False], (key[1:] != key[:-1]) & (old[1:] == old[:-1])])
        new[open_[change]] = True
        tie = np.cumsum(new)
        depth += step
    if depth < length:
        same = np.zeros(len(tie), bool)  # groups found to hold one string only
        while True:
            open_ = _in_ties(tie)
            open_ = open_[~same[open_]]
            if not len(open_):
                break
            t = tie[open_]
            lead = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            pivot = np.repeat(place[order[open_[lead]]], np.diff(np.append(lead, len(t))))
            mine = place[order[open_]]
            branch, above = np.full(len(t), length, np.int64), np.zeros(len(t), np.int64)
            left = np.arange(len(t))
            for j in range(depth, length):
                a, b = buffer[mine[left] + j], buffer[pivot[left] + j]
                off = a != b
                branch[left[off]] = j
                above[left[off]] = np.where(a[off] > b[off], 1, -1)
                left = left[~off]
                if not len(left):
                    break
            letter = np.where(branch < length, buffer[np.minimum(mine + branch, len(buffer) - 1)], 0).astype(np.int64)
            # below the pivot: early branches first; then the pivot's equals; above it: late branches first
            side = above * (2 * length - branch)
            local = np.lexsort((letter, np.where(above < 0, -(2 * length - branch), np.where(above > 0, branch * -1 + 4 * length, 0)), t))
            order[open_] = order[open_][local]
            s, l, o = side[local], letter[local], t
            new = np.zeros(len(tie), bool)
            new[1:] = tie[1:] != tie[:-1]
            change = np.concatenate([[False], ((s[1:] != s[:-1]) | (l[1:] != l[:-1])) & (o[1:] == o[:-1])])
            new[open_[change]] = True
            tie = np.cumsum(new)
            same[open_] = (branch == length)[local]
    return order, np.concatenate([[True], tie[1:] != tie[:-1]]) if len(tie) else np.zeros(0, bool)


def _in_ties(tie: np.ndarray) -> np.ndarray:
    """Indices of members of groups of two or more."""
    if len(tie) < 2:
        return np.zeros(0, np.int64)
    equal = tie[1:] == tie[:-1]
    return np.flatnonzero(np.concatenate([equal, [False]]) | np.concatenate([[False], equal]))


def _owners(buckets: DataFrame, length: int) -> DataFrame:
    """(mark, digest, ranges): for each different stretch, runs of its places with the smallest id that has their string."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        mark, ids = group["mark"].to_numpy(), group["id"].to_numpy()
        size = group["content"].str.len().to_numpy() - length + 1
        buffer = np.frombuffer(b"".join(group["content"]), np.uint8)
        begin = np.concatenate([[0], np.cumsum(size + length - 1)])[:-1]
        _, group_no, several = np.unique(mark, return_inverse=True, return_counts=True)
        several = several[group_no] > 1
        owner = np.repeat(ids, size)
        stretch = np.repeat(np.arange(len(ids)), size)
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(begin, size) + np.arange(at[-1]) - np.repeat(at[:-1], size)
        # A stretch alone with its fingerprint can still repeat within itself; its owner is its own smallest id all the same.
        work = np.flatnonzero(several[stretch])
        order, new = suffix_classes(buffer, place[work], group_no[stretch[work]], length)
        if len(order):
            head = np.flatnonzero(new)
            least = np.minimum.reduceat(owner[work][order], head)
            owner[work[order]] = np.repeat(least, np.diff(np.append(head, len(order))))
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])]))
        return pd.DataFrame({
            "mark": mark[stretch[edge]], "digest": group["digest"].to_numpy()[stretch[edge]],
            "first": edge - at[stretch[edge]], "n": np.diff(np.append(edge, len(owner))), "owner": owner[edge],
        })

    return buckets.groupBy("bucket").applyInPandas(settle, "mark bigint, digest bigint, first bigint, n bigint, owner bigint")


def _owners_of_many(stretches: DataFrame, length: int) -> DataFrame:
    """As ``_owners``, suffix by suffix: for fingerprints with more stretches than one task should sort."""
    starts = stretches.withColumn("first", F.explode(F.sequence(F.lit(0), F.length("content") - length))).withColumn(
        "string", F.substring(F.col("content"), F.col("first") + 1, F.lit(length))
    )
    least = starts.groupBy("mark", "string").agg(F.min("id").alias("owner"))
    return starts.select("mark", "string", "digest", F.col("first").cast("long").alias("first")).join(least, ["mark", "string"]).select(
        "mark", "digest", "first", F.lit(1).cast("long").alias("n"), "owner"
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, h1, runs): for each document with something to remove, the runs (first, end) of places at which a string starts
    that also starts in a document with a smaller id. Rows that share an id are told apart by ``h1``, the digest of their text."""
    bounded(docs.sparkSession)
    narrow = _keyed(docs, id_col, text_col)
    long_enough = narrow.where((F.octet_length("text") >= length) & F.col("id").isNotNull())
    keys = cut_lineage(long_enough.select("id", F.octet_length("text").alias("size"), "h1", F.xxhash64("text", F.lit(1)).alias("h2")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    first = keys.groupBy("h1", "h2", "size").agg(F.min("id").alias("keep"), F.max("id").alias("last")).where("keep < last")
    copies = cut_lineage(keys.join(first, ["h1", "h2", "size"]).where("id <> keep").select("id", "h1", "size").distinct())
    different_texts = long_enough.join(checked_broadcast(copies.select("id", "h1")), ["id", "h1"], "left_anti")
    buckets = max(8, -(-total // BUCKET_BYTES))
    shared = cut_lineage(_shared_marks(different_texts.select("id", "text"), length, buckets))
    rows = different_texts.join(shared, "id")
    digest = F.xxhash64("content", F.lit(1))
    found = cut_lineage(_stretches(rows, length).withColumn("digest", digest))
    different = cut_lineage(found.groupBy("mark", "digest").agg(F.min("id").alias("id"), F.first("content").alias("content")))
    many = different.groupBy("mark").count().where(F.col("count") > MANY_STRETCHES).select("mark")
    many = cut_lineage(many)
    few = different
    of_many = None
    if many.limit(1).count():
        few = different.join(many, "mark", "left_anti")
        of_many = _owners_of_many(different.join(many, "mark", "left_semi"), length)
    n_buckets = max(8, -(-total // BUCKET_BYTES) * 2)
    owners = _owners(few.withColumn("bucket", F.pmod("mark", F.lit(n_buckets))), length)
    owners = cut_lineage(owners if of_many is None else owners.unionByName(of_many))
    hits = found.select("mark", "digest", "id", "h1", "place").join(owners, ["mark", "digest"]).where("owner < id").select(
        "id", "h1", F.struct((F.col("place") + F.col("first")).alias("first"), (F.col("place") + F.col("first") + F.col("n")).alias("end")).alias("run")
    )
    whole = copies.select("id", "h1", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("size") - length + 1).cast("long").alias("end"))).alias("runs"))
    return hits.groupBy("id", "h1").agg(F.collect_list("run").alias("runs")).unionByName(whole)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.withColumn("h1", F.xxhash64("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): each text as UTF-8 bytes without those covered by a string of ``length`` bytes
    that also starts in a document with a smaller id.

    ``spans`` are the maximal removed runs (start, end), ``kept`` the other bytes joined. Strings are judged on the input,
    overlapping ones count, none crosses documents. Null texts count as empty. Rows with a null id lose nothing and
    take nothing from others; rows that share an id lose nothing to each other. Other columns are not kept, so that none
    can clash. An empty table gives an empty result.
    """
    spans = cut_lineage(repeated_spans(docs, id_col, text_col, length))
    narrow = _keyed(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, where, sizes = [], [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                text = text.as_py() or b""
                sizes.append(len(text))
                if not runs.is_valid:
                    kept.append(text)
                    removed.append(0)
                    where.append([])
                    continue
                first = runs.values.field("first").to_numpy()
                end = np.minimum(runs.values.field("end").to_numpy() + length - 1, len(text))
                order = np.argsort(first, kind="stable")
                first, end = first[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], first[1:] > end[:-1]])
                a, b = first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(int((b - a).sum()))
                where.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(where, kind), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    done = narrow.join(spans, ["id", "h1"], "left").select("id", "text", "runs").mapInArrow(
        cut, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return done.withColumnRenamed("id", id_col)
