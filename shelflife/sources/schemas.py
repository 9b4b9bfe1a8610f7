"""Declared schema of each source, after header cleaning and before
normalisation. Date columns hold spreadsheet serials (days, as a number)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


INVENTORY_LOTS = _schema(
    location="string",
    sku="string",
    description="string",
    lot_number="string",
    mfg_date="double",
    calculated_shippable_date="double",
    expiration_date="double",
    calculated_days_left_to_ship="int",
    inventory_qty_cases="double",
    last_purchase_price="double",
)
CUSTOMER_ORDERS = _schema(
    location="string",
    product_label_sku="string",
    sales_order_requested_ship_date="double",
    oo_cases="double",
)
PLANNER_DIRECTORY = _schema(address_number="string", alpha_name="string")
ITEM_PLANNER = _schema(b_p="string", item_number="string", planner="string")
ITEM_TYPE = _schema(ship_ref="string", type="string")
MFG_LOCATIONS = _schema(location="string", product_manufacturing_location="string", item="string")
FORECAST = _schema(
    location_no="string",
    product_label_sku_code="string",
    product_manufacturing_location_code="string",
    forecast_month_year_code="string",
    adjusted_forecast_cases="double",
    adjusted_forecast_pounds_lbs="double",
)

SCHEMAS = {
    "inventory_lots": INVENTORY_LOTS,
    "customer_orders": CUSTOMER_ORDERS,
    "planner_directory": PLANNER_DIRECTORY,
    "item_planner": ITEM_PLANNER,
    "item_type": ITEM_TYPE,
    "mfg_locations": MFG_LOCATIONS,
    "forecast": FORECAST,
}

# Data rows that precede the header in each export. The planner
# directory has its header in the first row.
HEADER_ROW = {
    "inventory_lots": 2,
    "customer_orders": 2,
    "planner_directory": 0,
    "item_planner": 3,
    "item_type": 7,
    "mfg_locations": 2,
    "forecast": 2,
}
