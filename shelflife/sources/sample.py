"""The seven sources derived from the shared test tables (see FIXTURES.md)."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflife.functions.dates import SERIAL_ORIGIN
from shelflife.params import SNAPSHOT
from shelflife.sources.readers import Sources
from shelflife.sources.schemas import SCHEMAS
from shelflife.sources.shared import stored

AS_OF = date(1998, 6, 15)
FIRST_MONTH = 199805
SNAPSHOT_DATES = tuple(AS_OF + timedelta(weeks=i) for i in range(3))

# Column headers of the exports, in declared column order.
EXPORT_HEADERS = {
    "inventory_lots": (
        "Location",
        "SKU",
        "Description",
        "Lot Number",
        "Mfg Date",
        "Calculated Shippable Date",
        "Expiration Date",
        "Calculated Days Left to Ship",
        "Inventory Qty (Cases)",
        "Last Purchase Price",
    ),
    "customer_orders": ("Location", "Product Label SKU", "Sales Order Requested Ship Date", "OO Cases"),
    "planner_directory": ("Address Number", "Alpha Name"),
    "item_planner": ("B/P", "Item Number", "Planner"),
    "item_type": ("Ship Ref", "Type"),
    "mfg_locations": ("Location", "Product Manufacturing Location", "Item"),
    "forecast": (
        "Location No",
        "Product Label SKU Code",
        "Product Manufacturing Location Code",
        "Forecast Month Year Code",
        "Adjusted Forecast Cases",
        "Adjusted Forecast Pounds (lbs.)",
    ),
}


# Schemas of the tables used here; declared, so that reading starts no job.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem")
    suppliers = read_table(spark, sf_dir, "supplier")
    nations = read_table(spark, sf_dir, "nation")
    parts = read_table(spark, sf_dir, "part")
    return (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("loc", F.col("n_regionkey").cast("string"))
    )


#: The columns of the base rows that the sources are made of.
USED = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "loc", "p_name", "p_type", "p_size", "p_retailprice",
)


def sample_sources(spark: SparkSession, sf_dir: str, snapshots: bool = False, joined_once: bool = False) -> Sources:
    """Sources for one day, or, with `snapshots`, for three weekly snapshots
    that each hold the base rows of every third order. With `joined_once` the base rows and the item-locations in them
    are stored in the shared folder; a report reads its sources many times, and each time would join the tables again."""
    rows = base_rows(spark, sf_dir)
    if joined_once:
        rows = stored(rows.select(*USED), "sample-rows")
    keys: tuple[str, ...] = ()
    day: Column = F.lit(AS_OF)
    if snapshots:
        keys = (SNAPSHOT,)
        weeks = (F.col("l_orderkey") % len(SNAPSHOT_DATES)).cast("int")
        rows = rows.withColumn(SNAPSHOT, F.date_add(F.lit(AS_OF), weeks * 7))
        day = F.col(SNAPSHOT)
    serial = F.datediff(day, F.lit(SERIAL_ORIGIN).cast("date"))
    offset = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 150 - 30).cast("int")
    part, qty = F.col("l_partkey"), F.col("l_quantity")
    sku = part.cast("string")
    items = rows
    if joined_once:
        items = stored(rows.select(*keys, "loc", "l_partkey", "p_size", "p_type").distinct(), "sample-items")
    returned = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")

    lots = rows.select(
        *keys,
        F.col("loc").alias("location"),
        sku.alias("sku"),
        F.col("p_name").alias("description"),
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("lot_number"),
        (serial + offset - 180).cast("double").alias("mfg_date"),
        (serial + offset).cast("double").alias("calculated_shippable_date"),
        (serial + offset + F.col("p_size")).cast("double").alias("expiration_date"),
        offset.alias("calculated_days_left_to_ship"),
        F.when(qty == 50, None).when(returned, -qty).otherwise(qty).alias("inventory_qty_cases"),
        F.col("p_retailprice").alias("last_purchase_price"),
    )
    orders = rows.where(F.col("l_linestatus") == "O").select(
        *keys,
        F.col("loc").alias("location"),
        sku.alias("product_label_sku"),
        (serial + (F.col("l_orderkey") % 60).cast("int") - 10).cast("double").alias("sales_order_requested_ship_date"),
        qty.alias("oo_cases"),
    )
    directory = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("address_number"), F.col("s_name").alias("alpha_name")
    )
    if snapshots:
        dates = F.array(*[F.lit(d) for d in SNAPSHOT_DATES])
        directory = directory.select(F.explode(dates).alias(SNAPSHOT), "*")
    # Large items have no planner, small ones an unassigned or unlisted one.
    size = F.col("p_size")
    unlisted = F.concat(F.lit("-"), size.cast("string"))
    planner = F.when(size > 10, (size % 10).cast("string")).when(size > 5, unlisted)
    item_planner = (
        items.where(size <= 45)
        .select(
            *keys,
            F.col("loc").alias("b_p"),
            sku.alias("item_number"),
            planner.alias("planner"),
        )
        .distinct()
    )
    item_type = (
        items.where(size >= 4)
        .select(*keys, F.concat_ws("-", F.col("loc"), sku).alias("ship_ref"), F.col("p_type").alias("type"))
        .distinct()
    )
    mfg_site = F.when(part % 3 == 0, F.col("loc")).otherwise((part % 5).cast("string"))
    mfg_locations = (
        items.where(size <= 47)
        .select(
            *keys,
            F.col("loc").alias("location"),
            mfg_site.alias("product_manufacturing_location"),
            sku.alias("item"),
        )
        .distinct()
    )
    forecast = (
        rows.groupBy(
            *keys,
            F.col("loc").alias("location_no"),
            sku.alias("product_label_sku_code"),
            mfg_site.alias("product_manufacturing_location_code"),
            (F.lit(FIRST_MONTH) + F.col("l_orderkey") % 8).cast("string").alias("forecast_month_year_code"),
        )
        .agg(F.sum(F.when(qty == 13, 0.0).otherwise(qty) * 3).alias("adjusted_forecast_cases"))
        .withColumn("adjusted_forecast_pounds_lbs", F.col("adjusted_forecast_cases") * 10)
    )
    return Sources(lots, orders, directory, item_planner, item_type, forecast, mfg_locations)


def with_second_sites(sources: Sources) -> Sources:
    """A second manufacturing site for every fourth item, with a forecast of its own."""

    def second(table: DataFrame, item: str, site: str) -> DataFrame:
        number = F.col(item).cast("bigint")
        return table.where(number % 4 == 0).withColumn(site, ((number + 1) % 5).cast("string"))

    site = "product_manufacturing_location"
    more = second(sources.forecast, "product_label_sku_code", f"{site}_code")
    more = more.withColumn("adjusted_forecast_cases", F.col("adjusted_forecast_cases") * 2)
    return replace(
        sources,
        mfg_locations=sources.mfg_locations.unionByName(second(sources.mfg_locations, "item", site)).distinct(),
        forecast=sources.forecast.unionByName(more),
    )


def with_third_sites(sources: Sources) -> Sources:
    """Second sites, and a third one without a row of its own in the site report for every eighth item."""
    two = with_second_sites(sources)
    number = F.col("product_label_sku_code").cast("bigint")
    third = sources.forecast.where(number % 8 == 0)
    third = third.withColumn("product_manufacturing_location_code", ((number + 2) % 5).cast("string"))
    return replace(two, forecast=two.forecast.unionByName(third))


def with_repeated_dimensions(sources: Sources) -> Sources:
    """A second planner for every seventh item, a second type for every sixth, every fourth type twice the same,
    and a second name for every third planner."""
    item, ship = F.col("item_number").cast("bigint"), F.substring_index("ship_ref", "-", -1).cast("bigint")
    number = F.col("address_number").cast("bigint")
    planners, types, names = sources.item_planner, sources.item_type, sources.planner_directory
    return replace(
        sources,
        item_planner=planners.unionByName(planners.where(item % 7 == 0).withColumn("planner", F.lit("3"))),
        item_type=types.unionByName(types.where(ship % 6 == 0).withColumn("type", F.lit("SPARE"))).unionByName(types.where(ship % 4 == 0)),
        planner_directory=names.unionByName(
            names.where(number % 3 == 0).withColumn("alpha_name", F.concat("alpha_name", F.lit(" II")))
        ),
    )


def with_odd_keys(sources: Sources) -> Sources:
    """Dashed items (in the planner and type sources only every second one has its dash), lots without a location, fractional
    cases, prices with three decimals, and items whose orders are all negative."""

    def dashed(item: str, every: int) -> Column:
        number = F.col(item).cast("bigint")
        return F.when(number % every == 0, F.concat(F.substring(item, 1, 1), F.lit("-"), F.col(item))).otherwise(F.col(item))

    def placed(column: str, item: str) -> Column:
        return F.when(F.col(item).cast("bigint") % 4 != 3, F.col(column))

    lots, orders, cells = sources.inventory_lots, sources.customer_orders, sources.forecast
    line = F.substring_index("lot_number", "-", -1).cast("int")
    more = F.when(line == 5, 0.125).otherwise(line / 1000)
    sign = F.when(F.col("product_label_sku").cast("bigint") % 9 == 0, -1.0).otherwise(1.0)
    ship = F.substring_index("ship_ref", "-", -1).cast("bigint")
    tail = F.substring_index("ship_ref", "-", -1)
    place = F.when(ship % 4 != 3, F.substring_index("ship_ref", "-", 1)).otherwise("NA")
    return replace(
        sources,
        inventory_lots=lots.withColumns(
            {
                "location": placed("location", "sku"), "sku": dashed("sku", 5), "inventory_qty_cases": F.col("inventory_qty_cases") + line / 4,
                "last_purchase_price": F.col("last_purchase_price") + more,
            }
        ),
        customer_orders=orders.withColumns(
            {
                "location": placed("location", "product_label_sku"), "product_label_sku": dashed("product_label_sku", 5),
                "oo_cases": F.col("oo_cases") * sign + 0.5,
            }
        ),
        item_planner=sources.item_planner.withColumns({"b_p": placed("b_p", "item_number"), "item_number": dashed("item_number", 10)}),
        item_type=sources.item_type.withColumn(
            "ship_ref", F.concat(place, F.lit("-"), F.when(ship % 10 == 0, F.concat(F.substring(tail, 1, 1), F.lit("-"), tail)).otherwise(tail))
        ),
        forecast=cells.withColumns(
            {"location_no": placed("location_no", "product_label_sku_code"), "product_label_sku_code": dashed("product_label_sku_code", 5)}
        ),
    )


def with_unknown_days(sources: Sources) -> Sources:
    """Lots without days left, without a shippable date, and without both."""
    order = F.substring_index("lot_number", "-", 1).cast("bigint")
    lots = sources.inventory_lots
    return replace(
        sources,
        inventory_lots=lots.withColumns(
            {
                "calculated_days_left_to_ship": F.when(order % 5 != 1, F.col("calculated_days_left_to_ship")),
                "calculated_shippable_date": F.when(order % 3 != 1, F.col("calculated_shippable_date")),
            }
        ),
    )


def as_export(table: DataFrame, name: str) -> DataFrame:
    """A source as its export would hold it: text cells under export headers,
    `NA` for a missing value."""
    cells = [F.coalesce(F.col(f.name).cast("string"), F.lit("NA")) for f in SCHEMAS[name].fields]
    return table.select(*cells).toDF(*EXPORT_HEADERS[name])
