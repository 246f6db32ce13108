"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import checked_broadcast
from ..operators.ordering import row_positions
from ..session import cut_lineage
from .base import unit_number

BLOCK = 64


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (is_null, source, source_size): ``share`` of all sizes by weight, at most ``most`` times a
    source's size, the excess reshared by weight until no target is above.

    Weights repeat over the sources in code point order, null last. The resharing ends with one level for all sources
    not at their limit; each round adds up over the table and brings two numbers to the driver.
    """
    placed = row_positions(sources, ["is_null", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = cut_lineage(placed.withColumn("weight", weight).drop("place"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, at_limit = 0.0, -1
    while True:
        full = F.col("source_size") * float(most) <= F.col("weight") * F.lit(level)
        held, free, n = weighed.agg(
            F.sum(F.when(full, F.col("source_size") * float(most)).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum(full.cast("long")),
        ).first()
        if not free or n == at_limit:
            break
        level, at_limit = (share * total - held) / free, n
    limit = F.col("source_size") * float(most)
    target = F.least(limit, F.col("weight") * F.lit(level)) if free else limit
    return weighed.withColumn("target", target.cast("double")).drop("weight")


def _round_block(entries: Column) -> Column:
    """Pivotal rounding of one block: (out: place and copy of all entries but one, left: that one's place and mass).

    Two fractional entries exchange mass at the rate of their sizes, so that the words taken stay the same and one of the
    two becomes 0 or 1; the direction is drawn so that neither's expected share changes. The other goes on to the next.
    """
    numbered = F.transform(entries, lambda e, i: F.struct(
        i.alias("i"), e["p"].alias("p"), e["s"].alias("s"), e["u"].alias("u")
    ))
    nothing = F.array().cast("array<struct<i:int,x:int>>")
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), nothing.alias("out"))

    def state(i: Column, p: Column, s: Column, out: Column) -> Column:
        return F.struct(i.alias("i"), p.alias("p"), s.alias("s"), out.alias("out"))

    def settled(acc: Column, i: Column, x: int) -> Column:
        return F.concat(acc["out"], F.array(F.struct(i.alias("i"), F.lit(x).alias("x"))))

    def step(acc: Column, e: Column) -> Column:
        rate = e["s"] / F.when(acc["i"] < 0, F.lit(1.0)).otherwise(acc["s"])
        back = F.when(acc["i"] < 0, F.lit(1.0)).otherwise(acc["s"]) / e["s"]
        room_up, supply = 1.0 - acc["p"], e["p"] * rate
        room_down, demand = acc["p"], (1.0 - e["p"]) * rate
        up, down = F.least(room_up, supply), F.least(room_down, demand)
        rises = e["u"] * (up + down) < down
        return (
            F.when(acc["i"] < 0, state(e["i"], e["p"], e["s"], acc["out"]))
            .when(rises & (room_up <= supply), state(e["i"], e["p"] - up * back, e["s"], settled(acc, acc["i"], 1)))
            .when(rises, state(acc["i"], acc["p"] + up, acc["s"], settled(acc, e["i"], 0)))
            .when(room_down <= demand, state(e["i"], e["p"] + down * back, e["s"], settled(acc, acc["i"], 0)))
            .otherwise(state(acc["i"], acc["p"] - down, acc["s"], settled(acc, e["i"], 1)))
        )

    return F.aggregate(numbered, start, step)


def pivotal_rounding(units: DataFrame, key: Sequence[str], group: Sequence[str], seed: int, block: int = BLOCK) -> DataFrame:
    """0/1 copies for units with a fractional share: (key and group columns, ``x``).

    ``units`` has the key and group columns, ``p`` (0 to 1), ``s`` (size above 0) and ``n`` (units of its group).
    Within a group the sum of s * p is kept but for one unit's size. Blocks of about ``block`` units are rounded side by
    side; what each leaves over goes to the next level, of 1/block the size, until one unit of the group is left, which
    its own share decides. No task gathers more than a block, whatever the size of a group.
    """
    carried = [*key, *group]
    level, number = units.select(*carried, "p", "s", "n"), 0
    most = level.agg(F.max("n")).first()[0] or 0
    done: list[DataFrame] = []
    while True:
        level = level.withColumn("n", F.ceil(F.col("n") / block))
        most = -(-most // block)
        place = F.pmod(F.xxhash64(F.lit(f"{seed} block {number}"), *carried), F.greatest("n", F.lit(1)))
        drawn = unit_number(F.lit(f"{seed} draw {number}"), *carried)
        order = F.xxhash64(F.lit(f"{seed} order"), *carried)
        entry = F.struct(order.alias("o"), F.struct(*carried).alias("k"), F.col("p"), F.col("s"), drawn.alias("u"))
        blocks = level.withColumn("__b", place).groupBy(*group, "__b").agg(
            F.array_sort(F.collect_list(entry)).alias("e"), F.first("n").alias("n")
        )
        rounded = cut_lineage(blocks.select("e", "n", _round_block(F.col("e")).alias("r")))
        out = rounded.select(F.explode(F.transform("r.out", lambda o: F.struct(
            F.element_at("e", o["i"] + 1)["k"].alias("k"), o["x"].alias("x")
        ))).alias("o")).select("o.k.*", F.col("o.x").alias("x"))
        done.append(out)
        left = rounded.select(F.element_at("e", F.col("r.i") + 1)["k"].alias("k"), F.col("r.p").alias("p"),
                              F.col("r.s").alias("s"), "n").select("k.*", "p", "s", "n")
        number += 1
        if most <= 1:
            done.append(left.select(*carried, (unit_number(F.lit(f"{seed} last"), *carried) < F.col("p")).cast("int").alias("x")))
            break
        level = left
    result = done[0]
    for df in done[1:]:
        result = result.unionByName(df)
    return result


def mix_sources(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
                weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17,
                block: int = BLOCK) -> DataFrame:
    """(id, source, size, source_size, target, taken): how much of each row a mixture takes, whole copies each.

    Sources weigh ``weights``, repeated in code point order (null last), and share ``share`` times all sizes; a target
    stops at ``most`` times its source's size (see :func:`source_targets`). A row is taken floor(target / source size)
    times, and once more where pivotal rounding of the fraction gives it; so a source's words come within one row's size
    of its target and no row exceeds ceil(most) times its size. All draws are digests of the id.

    Rows that agree in id, source and size are one unit: they get the same number of copies each. Rows of size 0 are
    taken with 0 words; null ids and sources count as values. Other columns are not kept, so that none can clash.
    An empty table gives an empty result.
    """
    units = cut_lineage(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"))
        .groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
        .withColumns({"is_null": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    )
    mass = F.col("size") * F.col("rows")
    per_source = units.groupBy("is_null", "source").agg(
        F.sum(mass).alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n")
    )
    targets = checked_broadcast(source_targets(per_source, weights, share, most))
    rated = cut_lineage(units.join(targets, ["is_null", "source"]).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ).withColumn("whole", F.floor("rate").cast("long")))
    carried = ["id", "source", "is_null", "size", "rows", "source_size", "target", "whole"]
    open_units = rated.where("size > 0 AND rate > whole").withColumns({"p": F.col("rate") - F.col("whole"), "s": mass.cast("double")})
    fixed = rated.where("NOT (size > 0 AND rate > whole)").select(*carried, F.lit(0).alias("x"))
    key = [c for c in carried if c not in ("source", "is_null")]
    rounded = pivotal_rounding(open_units, key, ["is_null", "source"], seed, block).select(*carried, "x")
    every = rounded.unionByName(fixed)
    return every.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        F.col("id").alias(id_col), F.when(~F.col("is_null"), F.col("source")).alias(source_col), "size", "source_size",
        "target", (F.col("size") * (F.col("whole") + F.col("x"))).alias("taken"),
    )
