"""The reports: lots of every item-location with what is left of each after
open orders and forecast demand."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflife.functions import composite_key, days_range, strip_dashes
from shelflife.operators import demand, dims, ledger, projection, supply, transfer
from shelflife.operators.hot_refs import Layout, Part, over_parts, rows_per_key, split_hot_refs
from shelflife.params import ReportParams
from shelflife.sources.readers import Sources
from shelflife.sources.shared import stored

# Report columns in order, with their display headers.
BASE_HEADERS = {
    "ref": "ref",
    "location": "Location",
    "sku": "Sku",
    "description": "Description",
    "planner_number": "Planner#",
    "planner_name": "Planner Name",
    "lot_number": "Lot#",
    "days_left_on_ssl": "Days left on SSL",
    "days_left_on_expired": "Days left on expired",
    "expiration_date": "Expiration Date",
    "calculated_shippable_date": "Calculated Shippable Date",
    "mbx": "MBX",
    "unit_cost": "Unit Cost",
    "days_range": "Days Range",
    "sum_of_inventory_qty_w_neg": "Sum of Inventory Qty (Cases)",
    "inventory_in_cost": "Inventory in $",
    "diff_factor": "Diff Factor",
    "total_custord_within_15_days": "Total CustOrd (within 15 days)",
    "inv_after_custord": "Inv after CustOrd",
    "ending_inv_after_custord": "Ending Inv After CustOrd",
    "ending_inv_after_custord_in_cost": "Ending Inv After CustOrd in $",
    "fcst_daily_avg_after_15_days": "Fcst daily avg. (after 15 days)",
    "consumption_factor": "Consumption Factor",
    "inv_after_custord_and_fcst": "Inv after Custord & Fcst",
    "ending_inv_after_custord_and_fcst": "Ending Inv after Custord & Fcst",
    "ending_inv_after_custord_and_fcst_in_cost": "Ending Inv after Custord & Fcst in $",
}
TRANSFER_HEADERS = BASE_HEADERS | {
    "mfg_loc": "Mfg Loc",
    "xfer_to_other_loc": "Xfer to other Loc?",
    "percent_of_overall_demand": "% of overall demand",
}
# Display headers in the order of the lot sequence within an item-location.
REPORT_ORDER = (
    "Calculated Shippable Date",
    "Days left on SSL",
    "Location",
    "Sku",
    "Description",
    "Lot#",
    "Expiration Date",
    "Unit Cost",
    "Planner#",
    "Planner Name",
    "MBX",
)


def aggregated_lots(sources: Sources, params: ReportParams) -> DataFrame:
    return supply.as_ledger(supply.supply_by_lot(supply.normalize_lots(sources.inventory_lots, params), params))


def site_forecast(sources: Sources, params: ReportParams) -> DataFrame | None:
    """The forecast per item-location and site, as a table in the shared folder: rates, site columns and the
    count of sites read it, so the forecast itself is read once. None without sites."""
    if params.horizon_rule != "transfer":
        return None
    return stored(demand.forecast_pivot_mfg(sources.forecast, params), "forecast-by-site")


def lot_parts(
    sources: Sources, params: ReportParams, described: bool = True, pivot_mfg: DataFrame | None = None
) -> list[Part]:
    """Aggregated and (by default) described lots, with the item-locations
    that are too large for one task in a part of their own."""
    counted = supply.normalize_lots(sources.inventory_lots, params).select(*params.ref_keys)
    repeats, later = [], []
    if described and params.on_duplicate == "expand":
        directory = dims.planner_directory_dim(sources.planner_directory, params)
        planners = dims.planner_rows(dims.item_planner_dim(sources.item_planner, params), directory, params)
        repeats = [planners, dims.item_type_dim(sources.item_type, params)]
    if described and params.horizon_rule == "transfer":
        # A rate for each of k sites, and k * k flags for each of the site rows.
        if pivot_mfg is None:
            pivot_mfg = demand.forecast_pivot_mfg(sources.forecast, params)
        later = [(pivot_mfg, 3), (dims.mfg_dim(sources.mfg_locations, params), 1)]
    return split_hot_refs(
        aggregated_lots(sources, params),
        rows_per_key(counted, repeats, params.ref_keys, later),
        params.ref_keys,
        ledger.lot_order_columns,
        params.lots_per_task,
        (lambda lots, *how: describe_lots(lots, sources, params, *how)) if described else None,
    )


def describe_lots(
    lots: DataFrame, sources: Sources, params: ReportParams, hot: DataFrame | None = None, large: bool = False, repeated: bool = False
) -> DataFrame:
    """Planner, item type, days to expiry and the days-left bucket. When the lots are those of the keys in `hot`
    (`large`) or of the others, so are the dimensions; the few of hot keys are small enough for AQE to broadcast
    instead of joining on hot keys. If `repeated`, a lot comes once for equal dimension rows, with their number in `times`."""
    planners = dims.item_planner_dim(sources.item_planner, params)
    types = dims.item_type_dim(sources.item_type, params)
    directory = dims.planner_directory_dim(sources.planner_directory, params)
    if hot is not None:
        side = "left_semi" if large else "left_anti"
        planners = planners.join(hot, list(params.ref_keys), side)
        types = types.join(hot, list(params.ref_keys), side)
    named = dims.named_planners(planners, directory, params)
    if not large:
        lots = supply.packed(lots, supply.PACKED_LOT)
    if not repeated:
        return _packed_dims(dims.join_item_type(dims.join_planner(lots, named, params), types, params), params)
    # Of keys that aren't hot, equal rows may meet in one task.
    by = () if large else params.ref_keys
    planners = dims.counted_planners(planners, directory, params) if large else dims.counted(named, by)
    lots = dims.join_planner(lots, planners, params).withColumnRenamed("times", "_planners")
    lots = dims.join_item_type(lots, dims.counted(types, by), params)
    times = F.coalesce("_planners", F.lit(1)) * F.coalesce("times", F.lit(1))
    lots = lots.withColumn("times", times).drop("_planners")
    # Days follow from a row; blocks are stored without them, and `opened_lots` adds them.
    return lots if large else _packed_dims(lots, params)


def _packed_dims(lots: DataFrame, params: ReportParams) -> DataFrame:
    return supply.packed(add_days(lots, params), supply.PACKED_REPEAT)


def opened_lots(lots: DataFrame, params: ReportParams) -> DataFrame:
    """Packed columns opened, and all columns that follow from one row worked out again, so that no step before carries them."""
    lots = add_days(supply.opened(lots), params)
    return projection.projection_value(ledger.ending_inventory(ledger.value_lots(lots)))


def add_days(lots: DataFrame, params: ReportParams) -> DataFrame:
    return lots.withColumns(
        {
            "days_left_on_expired": F.datediff("expiration_date", params.as_of_column),
            "days_range": days_range(F.col("days_left_on_ssl")),
        }
    )


def open_orders(sources: Sources, params: ReportParams) -> DataFrame:
    return demand.orders_by_ref(demand.orders_within_horizon(sources.customer_orders, params), params)


def allocated_lots(lots: DataFrame, sources: Sources, params: ReportParams, layout: Layout) -> DataFrame:
    """Lots in sequence with open orders taken off, first-expiring first."""
    lots = ledger.join_open_orders(lots, open_orders(sources, params), layout)
    lots = ledger.sequence_lots(ledger.value_lots(lots), layout)
    lots = ledger.add_diff_factor(lots)
    return ledger.ending_inventory(ledger.allocate_orders(lots))


def net_forecast(sources: Sources, params: ReportParams, pivot_mfg: DataFrame | None = None) -> DataFrame:
    pivot = demand.forecast_pivot_mfg(sources.forecast, params) if pivot_mfg is None else pivot_mfg
    return demand.daily_forecast_transfer(
        demand.forecast_net_of_orders(pivot, open_orders(sources, params), params), params
    )


def daily_rates(sources: Sources, params: ReportParams, pivot_mfg: DataFrame | None = None) -> DataFrame:
    if params.horizon_rule == "transfer":
        return net_forecast(sources, params, pivot_mfg)
    return demand.daily_forecast(demand.forecast_pivot(sources.forecast, params), params)


def projected_lots(lots: DataFrame, sources: Sources, params: ReportParams, layout: Layout) -> DataFrame:
    """Allocation and projection."""
    return opened_lots(_projected(lots, sources, params, layout), params)


def _projected(
    lots: DataFrame, sources: Sources, params: ReportParams, layout: Layout, pivot_mfg: DataFrame | None = None
) -> DataFrame:
    """`projected_lots` before packed columns are opened. A rate per item-location cannot repeat lots,
    so it is joined first and the whole ledger is sorted once. With a rate per
    manufacturing site a lot repeats, but only after the allocation."""
    daily = daily_rates(sources, params, pivot_mfg)
    if params.horizon_rule == "transfer":
        lots = allocated_lots(lots, sources, params, layout)
        lots = projection.join_daily_forecast(lots, daily, layout)
        order = ["lot_seq", projection.RATE]
    else:
        lots = projection.join_daily_forecast(lots, daily, layout)
        lots = allocated_lots(lots, sources, params, layout)
        order = ledger.lot_order_columns(lots)
    lots = projection.consumption_factor(lots, params)
    return projection.project_inventory(lots, params, layout, order)


def full_ledger(sources: Sources, params: ReportParams) -> DataFrame:
    """Every step up to the projection, with internal column names."""
    return over_parts(
        lot_parts(sources, params), lambda lots, layout: projected_lots(lots, sources, params, layout)
    )


def report(sources: Sources, params: ReportParams) -> DataFrame:
    """The base or weekly report (26 columns), or with the transfer rules and
    the manufacturing-location source the transfer report (29 columns)."""
    if params.horizon_rule != "transfer":
        return _display(full_ledger(sources, params), BASE_HEADERS, params)
    pivot = site_forecast(sources, params)
    lots = supply.normalize_lots(sources.inventory_lots, params)
    sites = transfer.site_columns(lots, dims.mfg_dim(sources.mfg_locations, params), pivot, params)

    def with_sites(lots: DataFrame, layout: Layout) -> DataFrame:
        lots = _projected(lots, sources, params, layout, pivot)
        if supply.PACKED_LOT in lots.columns:
            lots = lots.withColumn("sku", F.col(supply.PACKED_LOT)["sku"])
        return opened_lots(transfer.join_site_columns(lots, sites, layout), params)

    return _display(over_parts(lot_parts(sources, params, pivot_mfg=pivot), with_sites), TRANSFER_HEADERS, params)


def inspect_ref(sources: Sources, params: ReportParams, ref: str) -> DataFrame:
    """Look one item-location up in the ledger. The sources are filtered on the
    locations that its key may begin with, which reaches their scans."""
    places = [ref[:i] for i, c in enumerate(ref) if c == "_"]

    def at(column: str) -> Column:
        return F.col(column).isin(places) | (F.col(column).isNull() if "NA" in places else F.lit(False))

    narrowed = replace(
        sources,
        inventory_lots=sources.inventory_lots.where(at("location")),
        customer_orders=sources.customer_orders.where(at("location")),
        item_planner=sources.item_planner.where(at("b_p")),
        # The forecast stays whole: its months fix the horizon.
    )
    return full_ledger(narrowed, params).where(F.col("ref") == ref)


def inspect_refs(sources: Sources, params: ReportParams, refs: DataFrame) -> DataFrame:
    """Look the item-locations in the column `ref` of `refs` up in the ledger; repeated, unknown and null ones do no harm.

    The sources are filtered before any step of the ledger on the key and the location that it begins with, which at run time
    prunes folders of sources stored by location. Both are one join: a location alone may have any share of a source's rows.
    """
    # Every key has a separator; to Spark this is also a filter that makes pruning at run time worth while.
    refs = refs.select(F.col("ref").alias("_ref")).where(F.instr("_ref", "_") > 0).distinct()
    parts = F.split("_ref", "_", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    placed = refs.select("_ref", F.explode(prefixes).alias("_place"))

    def narrowed(source: DataFrame, location: str, sku: Column) -> DataFrame:
        here = F.coalesce(source[location], F.lit("NA")) == F.col("_place")
        return source.join(placed, here & (composite_key(F.col(location), sku) == F.col("_ref")), "left_semi")

    few = replace(
        sources,
        inventory_lots=narrowed(sources.inventory_lots, "location", strip_dashes(F.col("sku"))),
        customer_orders=narrowed(sources.customer_orders, "location", strip_dashes(F.col("product_label_sku"))),
        # Planners keep the dashes of their item numbers in the key.
        item_planner=narrowed(sources.item_planner, "b_p", F.col("item_number")),
        # The forecast stays whole: its months fix the horizon.
    )
    return full_ledger(few, params)


def _display(lots: DataFrame, headers: dict[str, str], params: ReportParams) -> DataFrame:
    shown = lots.withColumn("ref", F.translate("ref", "_", "-"))
    return shown.select(
        *params.snapshot_keys, *[F.col(c).alias(title) for c, title in headers.items()]
    )


def report_order(params: ReportParams) -> list[str | Column]:
    """The lot sequence, by the key of the item-location and not by its display name."""
    return [*params.snapshot_keys, composite_key(F.col("Location"), F.col("Sku")), *REPORT_ORDER]
