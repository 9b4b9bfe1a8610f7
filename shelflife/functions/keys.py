from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_dashes(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def composite_key(*parts: Column) -> Column:
    """Join parts with `_`; a missing part becomes the text `NA`, so a key is
    never NULL and plain equi-joins match missing parts with each other."""
    return F.concat_ws("_", *[F.coalesce(p, F.lit("NA")) for p in parts])
