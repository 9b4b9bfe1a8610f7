from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 0) -> Column:
    """To the nearest number with so many digits, as doubles are: 1.015 is a
    little less than it reads. The even one on a tie."""
    if digits == 0:
        return F.bround(value, 0)
    scale = 10.0**digits
    low, high = F.floor(value * scale), F.ceil(value * scale)
    below, above = value - low / scale, high / scale - value
    lower = (below < above) | ((below == above) & (low % 2 == 0))
    # Beyond 2**53 there are no fractions; nor has NaN or infinity one.
    small = F.abs(value) * scale < 2.0**53
    return F.when(small, F.when(lower, low).otherwise(high) / scale).otherwise(value)


def divide(numerator: Column, denominator: Column) -> Column:
    """IEEE division: x/0 is infinite and 0/0 is NaN instead of an error."""
    by_zero = (
        F.when(numerator > 0, F.lit(float("inf")))
        .when(numerator < 0, F.lit(float("-inf")))
        .when(numerator == 0, F.lit(float("nan")))
    )
    return F.when(denominator == 0, by_zero).otherwise(F.try_divide(numerator, denominator))


def percent_text(share: Column) -> Column:
    """Whole percents, half-even; an unknown share counts as zero."""
    known = F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0))
    return (
        F.when(known == float("inf"), "Inf%")
        .when(known == float("-inf"), "-Inf%")
        .otherwise(F.concat(F.bround(100 * known, 0).cast("bigint").cast("string"), F.lit("%")))
    )
