"""Three-valued conditionals: an unknown condition gives an unknown result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).when(~condition, no)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def floor_at_zero(value: Column) -> Column:
    """Negative becomes 0; NULL stays NULL (`greatest` would turn it into 0)."""
    return if_else(value < 0, F.lit(0.0), value)


def days_range(days_left: Column) -> Column:
    # Bucket labels of the report.
    return (
        F.when(days_left <= 0, "unshippable")
        .when(days_left <= 30, "1-30")
        .when(days_left <= 60, "31-60")
        .when(days_left > 60, ">60")
    )
