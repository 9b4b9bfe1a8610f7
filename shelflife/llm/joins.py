"""Joins with tables whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that have one of so many equal shares of all rows, or more, are looked up by broadcast.
SHARES = 1 << 12


def join_uneven(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Inner join of `rows` with `table`, unique on `keys`, whose column `weight` is the number of rows of each key.

    The weights sum to `total` at most, so no more than SHARES keys have total / SHARES rows or more: those
    are broadcast and their rows stay where they are. All other keys are small and are joined by a shuffle."""
    hot = table.where(F.col(weight) * SHARES >= total)
    cold = table.where(F.col(weight) * SHARES < total)
    on = list(keys)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))
