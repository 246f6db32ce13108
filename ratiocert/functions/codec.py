"""Identifiers as hexadecimal digits or as decimal digits, of any length.

Numbers beyond 64 bits are arrays of limbs, the lowest first. A group of digits of one base is appended by multiplying every limb and
carrying on; limbs and groups are small enough that each product fits a long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_GROUP, DECIMAL_GROUP = 7, 9  # digits; 28 bits, and 10^9, which is below 2^30
HEX_BASE, DECIMAL_BASE = 16**HEX_GROUP, 10**DECIMAL_GROUP


def _groups(digits: Column, size: int) -> Column:
    """The digits in groups of ``size``, from the left, after filling up with zeros there."""
    n = F.greatest(F.ceil(F.length(digits) / size), F.lit(1)).cast("int")
    full = F.lpad(digits, n * size, "0")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(full, i * size + 1, F.lit(size)))


def _limbs(groups: Column, value_of, factor: int, base: int) -> Column:
    """The number that the groups spell in digits of ``factor``, as limbs of ``base``."""
    def append(limbs: Column, group: Column) -> Column:
        def step(state: Column, limb: Column) -> Column:
            total = limb * F.lit(factor) + state["carry"]
            low = F.pmod(total, F.lit(base))
            # A whole number below 2^33: the double quotient is off by less than rounding takes away.
            return F.struct(F.round((total - low) / F.lit(base)).cast("long").alias("carry"), F.concat(state["out"], F.array(low)).alias("out"))

        start = F.struct(value_of(group).alias("carry"), F.array().cast("array<bigint>").alias("out"))
        done = F.aggregate(limbs, start, step)
        # What is carried out of the highest limb is below 2^33, so two more limbs hold it.
        return F.concat(done["out"], F.array(F.pmod(done["carry"], F.lit(base)), F.floor(done["carry"] / F.lit(base)).cast("long")))

    return F.aggregate(groups, F.array().cast("array<bigint>"), append)


def _spelled(limbs: Column, spell, width: int) -> Column:
    """The limbs' digits from the highest on, without leading zeros."""
    digits = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(spell(x), F.lit(width), F.lit("0"))), "")
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def hex_to_decimal(text: Column) -> Column:
    """Decimal digits of a hexadecimal number, ``0x`` before it or not; NULL where it is none."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    value = lambda g: F.conv(g, 16, 10).cast("long")
    limbs = _limbs(_groups(digits, HEX_GROUP), value, HEX_BASE, DECIMAL_BASE)
    return F.when(digits.rlike("^[0-9a-fA-F]+$"), _spelled(limbs, lambda x: x.cast("string"), DECIMAL_GROUP))


def decimal_to_hex(text: Column) -> Column:
    """Lower-case hexadecimal digits of a decimal number, without leading zeros; NULL where it is none."""
    limbs = _limbs(_groups(text, DECIMAL_GROUP), lambda g: g.cast("long"), DECIMAL_BASE, HEX_BASE)
    return F.when(text.rlike("^[0-9]+$"), _spelled(limbs, lambda x: F.lower(F.hex(x)), HEX_GROUP))
