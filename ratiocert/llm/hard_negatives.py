"""Hard negatives of anchors by exact integer inner products, several candidates in each multiplication.

Components are integers. Shifted to be non-negative, the components of several candidates in one dimension become separated
fields of one wide integer; an anchor's component is multiplied with it once, and the sum over all dimensions holds the candidates'
inner products side by side, as no field overflows. The wide integers have up to 53 bits, which doubles hold exactly, so that
the multiplications are one matrix product. Unpacked fields minus the shifts' share are the scores.

Anchors are a stated query set: bounded slices of them are sent to all tasks, which pass over all candidates twice, once for the
positives and once for the negatives within their reach. Only a task's best rows leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .base import bounded
from .blocks import Best, best_rows, sliced

WIDE = 53  # bits of the wide integers
SLICE_NUMBERS = 1 << 20  # components of the anchors sent at a time
TILE_ANCHORS, TILE_ROWS = 256, 4096
MOST = 1 << 27  # components beyond would not surely leave scores within 64 bits


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of integer vectors."""
    low_a, low_r = int(anchors.min(initial=0)), int(rows.min(initial=0))
    a, r = anchors - low_a, rows - low_r
    dims = anchors.shape[1]
    bits = (int(a.max(initial=0)) * int(r.max(initial=0)) * dims).bit_length() or 1
    fields = WIDE // bits
    if not fields:  # one field would not fit: 64-bit products, whose sums fit by the bound on components
        return anchors @ rows.T
    groups = -(-len(rows) // fields)
    wide = np.zeros((dims, groups), np.int64)
    for f in range(fields):
        part = r[f * groups:(f + 1) * groups].T
        wide[:, :part.shape[1]] |= part << (bits * f)
    product = (a.astype(np.float64) @ wide.astype(np.float64)).astype(np.int64)
    out = np.empty((len(anchors), len(rows)), np.int64)
    for f in range(fields):
        held = out[:, f * groups:(f + 1) * groups]
        held[:] = (product[:, :held.shape[1]] >> (bits * f)) & ((1 << bits) - 1)
    return out + (low_r * a.sum(1) + dims * low_a * low_r)[:, None] + low_a * r.sum(1)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(scale * x); of rows that share an id the least remains."""
    v = F.col(vector_col)
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(MOST))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.when(F.coalesce(sound, F.lit(False)) & (F.size(v) > 0), F.transform(scaled, lambda x: F.floor(x).cast("int"))).alias("v"),
    )
    rows = cut_lineage(rows.where("v IS NOT NULL"))
    twice = cut_lineage(rows.groupBy("id").count().where("count > 1").select("id"))
    if not twice.limit(1).count():
        return rows
    least = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return cut_lineage(rows.join(twice, "id", "left_anti").unionByName(least))


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, components) of each size of vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


class _Anchors:
    def __init__(self, table: pa.Table):
        self.id = table.column("id").to_numpy()
        self.label = table.column("label").to_numpy()
        self.by_size = {x.shape[1]: (at, x) for at, x in _matrices(table.column("v"))}

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, ids, labels, scores): tile after tile of scores, with the anchors and the rows they belong to."""
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        for rows, x in _matrices(batch.column("v")):
            at, anchors = self.by_size.get(x.shape[1], (None, None))
            for i in range(0, 0 if at is None else len(at), TILE_ANCHORS):
                for j in range(0, len(rows), TILE_ROWS):
                    some, r = at[i:i + TILE_ANCHORS], rows[j:j + TILE_ROWS]
                    yield some, ids[r], labels[r], packed_products(anchors[i:i + TILE_ANCHORS], x[j:j + TILE_ROWS])


def _positives(rows: DataFrame, sent, k: int) -> DataFrame:
    """(anchor, id, score, rank) of the first k other rows of each anchor's label."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors.id), k)
        for batch in batches:
            for at, ids, labels, score in anchors.tiles(batch):
                wanted = (labels == anchors.label[at][:, None]) & (ids != anchors.id[at][:, None])
                a, r = np.nonzero(wanted & best.may_enter(at, score, ids))
                best.add(at[a], score[a, r], ids[r])
        group, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(ids), pa.array(score)], names=["anchor", "id", "score"])

    found = rows.mapInArrow(search, "anchor bigint, id bigint, score bigint")
    return best_rows(found, ["anchor"], "score", "id", k)


def _negatives(rows: DataFrame, sent, k: int, low: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the slice."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, positive, reach = sent.value  # positive: anchors x places of ids and scores, with -1 for no reach
        places = positive.shape[1]
        least = reach // 100 * low - (-(reach % 100) * low // 100)  # low percent, rounded up
        best = Best(positive.size, k)
        for batch in batches:
            for at, ids, labels, score in anchors.tiles(batch):
                other = labels != anchors.label[at][:, None]
                for p in range(places):
                    slot = at * places + p
                    within = other & (score <= reach[at, p][:, None]) & (score >= least[at, p][:, None])
                    a, r = np.nonzero(within & best.may_enter(slot, score, ids))
                    best.add(slot[a], score[a, r], ids[r])
        slot, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.id[slot // places]), pa.array(positive.ravel()[slot]), pa.array(reach.ravel()[slot]), pa.array(ids), pa.array(score)],
            names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
        )

    kind = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    best = best_rows(rows.mapInArrow(search, kind), ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", k)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine_hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                        positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256,
                        slice_numbers: int = SLICE_NUMBERS) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label: the first ``negatives`` rows of other labels
    whose score is at least ``low`` percent of the positive's and not above it.

    Scores are integer inner products of floor(scale * x); higher ones come first, equal ones by ascending id. ``anchor`` is a
    condition on the columns ``id`` and ``label``. All rows are candidates.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; neither do those
    with a scaled component of 2^27 or more, whose scores might not fit 64 bits. Vectors of different sizes do not meet. Of
    rows that share an id the one of the least label and vector takes part. Anchors without positives, and positives without
    negatives in reach (all with a negative score among them), give no rows; nor does an empty table. Other columns are not kept,
    so that none can clash.
    """
    spark = vectors.sparkSession
    bounded(spark)
    rows = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    queries, n = sliced(rows.where(anchor).withColumn("w", F.size("v").cast("long")), "id", "w", slice_numbers)
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for s in range(n):
        table = queries.where(F.col("slice") == s).select("id", "label", "v").toArrow()
        if not table.num_rows:
            continue
        anchors = _Anchors(table)
        sent = spark.sparkContext.broadcast(anchors)
        found = _positives(rows, sent, positives).toArrow()
        at, place = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
        ids, reach = (np.full((len(anchors.id), positives), -1) for _ in range(2))
        ids[at, place], reach[at, place] = found.column("id").to_numpy(), found.column("score").to_numpy()
        least = spark.sparkContext.broadcast((anchors, ids, reach))
        _negatives(rows, least, negatives, low).write.mode("append").parquet(path)
        sent.destroy()
        least.destroy()
    return spark.read.schema(RESULT).parquet(path)
