"""Cutting the concatenation of all token sequences into equal blocks."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MOST_PARTS = 20_000  # ranges of ids; their totals are broadcast


def _place(df: DataFrame, row_id: str) -> Column:
    """A number that never falls as the id rises. Equal numbers for different ids are no harm."""
    if isinstance(df.schema[row_id].dataType, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.col(row_id).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(row_id).cast("double")


def _with_parts(df: DataFrame, row_id: str, parts: int) -> DataFrame:
    """Adds ``part``: ranges of ids in order, each with about as many rows."""
    placed = df.withColumn("__place", _place(df, row_id))
    edges: list[float] = []
    if parts > 1:
        probes = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        edges = sorted(set(placed.agg(F.percentile_approx("__place", probes, F.lit(max(10 * parts, 1000)))).first()[0] or []))
    if not edges:
        return placed.withColumn("part", F.lit(0)).drop("__place")
    split = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="__place", outputCol="__part").transform(placed)
    return split.withColumn("part", F.col("__part").cast("int")).drop("__place", "__part")


def partial_blocks(docs: DataFrame, doc_id: str, tokens: str, size: int, parts: int) -> tuple[DataFrame, int]:
    """(block, at, whole, t) and the number of all tokens: the tokens that a part of the documents gives to a block.

    Documents move once, to their part. There each one is cut at the block borders, and pieces of one block meet without
    moving again. ``whole`` says that no other part has tokens of the block.
    """
    sized = _with_parts(docs.select(F.col(doc_id), F.col(tokens).alias("__t")), doc_id, parts).withColumn("__n", F.size("__t").cast("long")).where("__n > 0")
    totals = sized.groupBy("part").agg(F.sum("__n").alias("__of"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_PARTS rows
    offsets = cut_lineage(totals.withColumn("__from", F.coalesce(F.sum("__of").over(before), F.lit(0))))
    total = offsets.agg(F.coalesce(F.sum("__of"), F.lit(0))).first()[0]
    inside = Window.partitionBy("part").orderBy(doc_id).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(F.broadcast(offsets), "part")
    placed = placed.withColumn("at", F.col("__from") + F.col("__in"))
    block = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("__n") - 1) / size)))
    pieces = placed.withColumn("block", block)
    begin = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * size - F.col("at"), F.col("__n"))
    whole = (F.col("block") * size >= F.col("__from")) & ((F.col("block") + 1) * size <= F.col("__from") + F.col("__of"))
    cut = pieces.select(
        "part", "block", "at", whole.alias("whole"), F.slice("__t", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece")
    )
    return cut.groupBy("part", "block", "whole").agg(F.min("at").alias("at"), _joined("at", "piece").alias("t")).drop("part"), total


def _joined(at: str, piece: str) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at, piece))), lambda s: s[piece]))


def packed_blocks(docs: DataFrame, doc_id: str, tokens: str, context: int, bos: str | int | None = None,
                  eos: str | int | None = None, parts: int | None = None) -> DataFrame:
    """(block, tokens) rows in id order; the incomplete last block is dropped unless it is the only one.

    Every part of the documents (four a shuffle partition by default) has at most two blocks in common with others; only these
    move on, and every block collects at most ``context`` tokens.
    """
    size = context - int(bos is not None) - int(eos is not None)
    if size <= 0:
        raise ValueError("no room for tokens in a block")
    if parts is None:
        parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial, total = partial_blocks(docs, doc_id, tokens, size, min(parts, MOST_PARTS))
    stored = cut_lineage(partial)
    shared = stored.where("NOT whole").groupBy("block").agg(_joined("at", "t").alias("t"))
    blocks = stored.where("whole").select("block", "t").unionByName(shared)
    if total >= size:
        blocks = blocks.where(F.col("block") < total // size)
    out = F.col("t")
    if bos is not None:
        out = F.concat(F.array(F.lit(bos)), out)
    if eos is not None:
        out = F.concat(out, F.array(F.lit(eos)))
    return blocks.select("block", out.alias("tokens"))
