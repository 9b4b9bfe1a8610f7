"""Inventory lots: normalisation, aggregation and the lot sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflife.functions import composite_key, or_zero, round_half_even, serial_to_date, strip_dashes
from shelflife.params import ReportParams

# Sequence of the lots of one item-location; NULL sorts last in every column.
LOT_ORDER = (
    "calculated_shippable_date",
    "days_left_on_ssl",
    "location",
    "sku",
    "description",
    "lot_number",
    "expiration_date",
    "unit_cost",
)
# Duplicated dimension keys repeat a lot; these columns order the repeats.
REPEAT_ORDER = ("planner_number", "planner_name", "mbx")
# All of these columns but the first, which decides nearly always, as one column each, in whose order the rows are in theirs.
PACKED_LOT, PACKED_REPEAT = "packed_lot", "packed_repeat"
PACKED = {PACKED_LOT: LOT_ORDER[1:], PACKED_REPEAT: REPEAT_ORDER}

LOT_GRAIN = (
    "location",
    "sku",
    "description",
    "days_to_past_ssl",
    "lot_number",
    "expiration_date",
    "calculated_shippable_date",
    "last_purchase_price",
)


def normalize_lots(lots: DataFrame, params: ReportParams) -> DataFrame:
    sku = strip_dashes(F.col("sku"))
    return lots.select(
        *params.snapshot_keys,
        composite_key(F.col("location"), sku).alias("ref"),
        "location",
        sku.alias("sku"),
        "description",
        "lot_number",
        serial_to_date(F.col("mfg_date")).alias("mfg_date"),
        serial_to_date(F.col("calculated_shippable_date")).alias("calculated_shippable_date"),
        serial_to_date(F.col("expiration_date")).alias("expiration_date"),
        F.col("calculated_days_left_to_ship").alias("days_to_past_ssl"),
        or_zero(F.col("inventory_qty_cases")).alias("inventory_qty_cases"),
        round_half_even(F.col("last_purchase_price"), 2).alias("last_purchase_price"),
    )


def supply_by_lot(normalized: DataFrame, params: ReportParams) -> DataFrame:
    """Quantity per lot. `ref` follows from location and sku, so it is added
    after the aggregation instead of being hashed and shuffled with it."""
    return (
        normalized.groupBy(*params.snapshot_keys, *LOT_GRAIN)
        .agg(F.sum("inventory_qty_cases").alias("sum_of_inventory_qty"))
        .withColumn("ref", composite_key(F.col("location"), F.col("sku")))
    )


def as_ledger(supply: DataFrame) -> DataFrame:
    """Report names for the lot columns, and the quantity floored at zero next
    to the published one."""
    return supply.withColumnsRenamed(
        {
            "days_to_past_ssl": "days_left_on_ssl",
            "last_purchase_price": "unit_cost",
            "sum_of_inventory_qty": "sum_of_inventory_qty_w_neg",
        }
    )


def packed(lots: DataFrame, name: str) -> DataFrame:
    """Add the columns of `PACKED` as one column that sorts as they do, NULL last in each of them. Rows are copied in every
    join, sort and window; a column with all text in it is copied at once."""
    fields = [field for c in PACKED[name] for field in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    return lots.withColumn(name, F.struct(*fields))


def opened(lots: DataFrame) -> DataFrame:
    """Lots with the columns that were packed. The steps before don't carry them, as columns that are replaced drop out of the plan."""
    for name, columns in PACKED.items():
        if name in lots.columns:
            lots = lots.withColumns({c: F.col(name)[c] for c in columns}).drop(name)
    return lots
