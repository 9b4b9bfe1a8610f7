"""Small inline sources."""

from __future__ import annotations

import time
from datetime import date

from shelflife.sources.readers import Sources
from shelflife.sources.schemas import SCHEMAS

AS_OF = date(2022, 8, 24)
AS_OF_SERIAL = 44797
MONTHS = ["202207", "202208", "202209", "202210", "202211", "202212", "202301"]


def lot(sku, number, days, qty, location="10", price=2.0, description="item", order_days=None, expires=30):
    """One lot; `order_days` moves the shippable date away from days left."""
    shift = days if order_days is None else order_days
    ship = None if shift is None else float(AS_OF_SERIAL + shift)
    expiry = None if ship is None else ship + expires
    return (location, sku, description, number, None, ship, expiry, days, qty, price)


def order(sku, cases, days=0, location="10"):
    return (location, sku, None if days is None else float(AS_OF_SERIAL + days), cases)


def forecast(sku, cases, location="10", site="10"):
    """The same cases in each of the seven months."""
    return [(location, sku, site, month, cases, cases) for month in MONTHS]


def make_sources(spark, **rows) -> Sources:
    """Sources from lists of tuples; sources left out are empty."""
    if "forecast" not in rows:
        rows["forecast"] = forecast("none", 0.0)
    return Sources(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def shuffle_files(spark) -> set[str]:
    """Names of the shuffle files on this session's disk."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}


def kept_since(spark, before: set[str], wait: float = 20.0) -> set[str]:
    """Shuffle files that have come and stay; Spark removes freed ones in the background."""
    until = time.time() + wait
    while (kept := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return kept
