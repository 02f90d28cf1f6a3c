"""Exact byte arithmetic and its display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"

# Unit names in ascending order, each 1024 times the one before.
UNITS = ["B", "KB", "MB", "GB", "TB"]


def wide_sum(size: Column) -> Column:
    """Sum of 64-bit sizes that cannot overflow 64 bits."""
    return F.sum(size.cast(WIDE))


def wasted(size: Column, copies: Column) -> Column:
    """Bytes taken by all copies but one."""
    return (size.cast("decimal(19,0)") * (copies - 1).cast("decimal(18,0)")).cast(WIDE)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0 when there is nothing to share."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.when(whole > 0, ratio), F.lit(0.0))


def format_bytes(size: Column) -> Column:
    """Human-readable size: two decimals, B to TB, and plain ``0 B`` for nothing.

    Decimals are rounded half to even on whole numbers, because ``format_string`` rounds
    ties up.
    """
    value = size.try_cast("bigint")

    def in_unit(power: int) -> Column:
        bits, base = 10 * power, 1024**power
        hundredths = value.bitwiseAND(F.lit(base - 1)) * 100
        quotient = F.shiftright(hundredths, bits)
        rest = hundredths.bitwiseAND(F.lit(base - 1)) * 2
        odd = quotient.bitwiseAND(F.lit(1)) == 1
        up = F.when((rest > base) | ((rest == base) & odd), 1).otherwise(0)
        cents = F.shiftright(value, bits) * 100 + quotient + up
        return F.concat(
            ((cents - cents % 100) / 100).cast("bigint").cast("string"),
            F.lit("."),
            F.lpad((cents % 100).cast("string"), 2, "0"),
            F.lit(" " + UNITS[power]),
        )

    plain = F.concat(size.cast(WIDE).cast("string"), F.lit(".00 B"))
    text = F.when(size == 0, F.lit("0 B")).when(size < 1024, plain)
    for power in range(1, 4):
        text = text.when(value < 1024 ** (power + 1), in_unit(power))
    text = text.when(value.isNotNull(), in_unit(4))
    # Sums beyond 64 bits: the unit is TB and the share of a cent is far below a double's grain.
    return text.when(
        size.isNotNull(), F.format_string("%.2f TB", size.cast("double") / float(1024**4))
    )
