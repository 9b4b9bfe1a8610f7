"""One query per operator, over the sources derived from the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflife.functions import composite_key, if_else, serial_to_date, strip_dashes
from shelflife.operators import demand, dims, ledger, projection, supply, transfer
from shelflife.operators.hot_refs import Layout, over_parts
from shelflife.operators.repeats import repeat_rows
from shelflife.params import HORIZON_RULES, ReportParams, SnapshotRules
from shelflife.plans import reports
from shelflife.sources.readers import Sources, read_export, read_typed, write_export, write_report
from shelflife.sources.runs import read_snapshots, write_snapshots
from shelflife.sources.sample import (
    AS_OF, SNAPSHOT_DATES, as_export, base_rows, read_table, sample_sources, with_odd_keys, with_repeated_dimensions, with_second_sites,
    with_third_sites, with_unknown_days,
)
from shelflife.sources.schemas import SCHEMAS
from shelflife.sources.shared import shared_folder
from shelflife.sources.staging import clean_names, promote_header, type_convert


Query = Callable[[SparkSession, str], DataFrame]

BASE = ReportParams.base(AS_OF)
#: Puts the larger item-locations of the test tables into blocks.
HOT = ReportParams.base(AS_OF, lots_per_task=40)
WEEKLY = ReportParams.weekly(AS_OF)
TRANSFER = ReportParams.transfer(AS_OF)
# The rules changed from week to week; so do those of the three snapshots.
WEEKS = (
    SnapshotRules(SNAPSHOT_DATES[0], "prev_shippable", "half_even"),
    SnapshotRules(SNAPSHOT_DATES[1], "same_ref", "ceiling"),
    SnapshotRules(SNAPSHOT_DATES[2], "self_shippable", "half_even"),
)
BACKFILL = ReportParams.weekly(snapshots=WEEKS)
BACKFILL_TRANSFER = ReportParams.transfer(snapshots=WEEKS)
BACKFILL_DEFAULTS = ReportParams.transfer(snapshots=tuple(SnapshotRules(day) for day in SNAPSHOT_DATES))
#: All snapshots by rules that two of them don't keep.
BACKFILL_ALIKE = ReportParams.weekly(snapshots=tuple(SnapshotRules(day, WEEKS[0].consumption_rule, WEEKS[0].rate_rounding) for day in SNAPSHOT_DATES))
BACKFILL_AGAIN = ReportParams.weekly(snapshots=WEEKS[1:])
INSPECTED_REF = "1_7"
#: An item-location with so many cases on order is looked up by inspect_refs.
MANY_CASES = 80

LOT = ("ref", "lot_number", "calculated_shippable_date", "days_left_on_ssl", "lot_seq")


def _source(name: str) -> Query:
    """The source written as exports and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/export-{name}-{uuid.uuid4().hex}"
        write_export(as_export(getattr(sample_sources(spark, sf_dir), name), name), name, path)
        return read_export(spark, name, path)

    return run


def _typed_source(name: str) -> Query:
    """The source written as Parquet, with a column that isn't declared, and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/typed-{name}-{uuid.uuid4().hex}"
        getattr(sample_sources(spark, sf_dir), name).withColumn("more", F.lit(1)).write.parquet(path)
        return read_typed(spark, name, path)

    return run


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    header_row = 3
    preamble = spark.createDataFrame(
        [(0, "Exception report", None, None), (1, None, None, None), (2, "All sites", None, None)]
        + [(header_row, "B/P", "Item Number", "Planner")],
        "pos bigint, c0 string, c1 string, c2 string",
    )
    rows = orders.select(
        (F.col("o_orderkey") + header_row + 1).alias("pos"),
        (F.col("o_orderkey") % 5).cast("string").alias("c0"),
        F.col("o_custkey").cast("string").alias("c1"),
        (F.col("o_custkey") % 10).cast("string").alias("c2"),
    )
    return promote_header(preamble.unionByName(rows), "pos", header_row)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_names(as_export(sample_sources(spark, sf_dir).customer_orders, "customer_orders"))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, qty = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    text = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_key"),
        F.concat(line.cast("string"), F.lit(".0")).alias("line_number"),
        F.when(line == 1, "NA")
        .when(line == 2, "")
        .when(line == 3, F.concat(F.lit("  "), qty, F.lit(" ")))
        .when(line == 4, "unknown")
        .otherwise(qty)
        .alias("quantity"),
        F.when(F.col("l_returnflag") == "N", "NA").otherwise(F.col("l_returnflag")).alias("flag"),
    )
    declared = T.StructType(
        [
            T.StructField("order_key", T.StringType()),
            T.StructField("line_number", T.IntegerType()),
            T.StructField("quantity", T.DoubleType()),
            T.StructField("flag", T.StringType()),
        ]
    )
    return type_convert(text, declared)


def serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serials with a time-of-day fraction."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date"))
    rows = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (days + F.col("l_linenumber") / 8.0).alias("serial")
    )
    return rows.withColumn("serial_date", serial_to_date(F.col("serial")))


def ref_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_rows(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("n_regionkey") != 0, F.col("loc")).alias("location"),
        F.concat_ws("-", F.col("l_partkey"), F.col("l_returnflag")).alias("raw_sku"),
    )
    sku = strip_dashes(F.col("raw_sku"))
    return rows.withColumn("sku", sku).withColumn("ref", composite_key(F.col("location"), sku))


def ifelse_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.when(line != 5, F.col("l_quantity") > 25).alias("a"),
        F.when(line != 6, F.col("l_discount") > 0.05).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return (
        rows.groupBy("a", "b")
        .count()
        .select(
            a.cast("string").alias("a"),
            b.cast("string").alias("b"),
            if_else(a, F.lit("yes"), F.lit("no")).alias("if_a"),
            if_else(a & b, F.lit("yes"), F.lit("no")).alias("if_and"),
            if_else(a | b, F.lit("yes"), F.lit("no")).alias("if_or"),
            if_else(~a & b, F.lit("yes"), F.lit("no")).alias("if_not_a_and_b"),
            F.col("count").alias("row_count"),
        )
    )


def _normalized(sources: Sources) -> DataFrame:
    return supply.normalize_lots(sources.inventory_lots, BASE)


def _lots(sources: Sources) -> DataFrame:
    return reports.aggregated_lots(sources, BASE)


def _over_lots(sources: Sources, step: Callable[[DataFrame, Layout], DataFrame]) -> DataFrame:
    return over_parts(reports.lot_parts(sources, BASE, described=False), step)


def _allocated(sources: Sources) -> DataFrame:
    return _over_lots(sources, lambda lots, layout: reports.allocated_lots(lots, sources, BASE, layout))


def _rated(sources: Sources, rule: str) -> DataFrame:
    daily = reports.daily_rates(sources, BASE)

    def step(lots: DataFrame, layout: Layout) -> DataFrame:
        lots = projection.join_daily_forecast(lots, daily, layout)
        lots = reports.allocated_lots(lots, sources, BASE, layout)
        return projection.consumption_factor(lots, BASE, rule)

    return _over_lots(sources, step)


def _projected(sources: Sources) -> DataFrame:
    return _over_lots(sources, lambda lots, layout: reports.projected_lots(lots, sources, BASE, layout))


def _planners(sources: Sources) -> DataFrame:
    return dims.named_planners(
        dims.item_planner_dim(sources.item_planner, BASE),
        dims.planner_directory_dim(sources.planner_directory, BASE),
        BASE,
    )


def lot_sequence(sources: Sources) -> DataFrame:
    return _allocated(sources).select(*LOT, "location", "sku", "description", "expiration_date", "unit_cost")


def lot_neighbors(sources: Sources) -> DataFrame:
    daily = reports.daily_rates(sources, BASE)
    columns = {
        "total_custord_within_15_days": "previous_orders",
        "sum_of_inventory_qty": "previous_qty",
        "ending_inv_after_custord": "previous_ending",
        "net": "previous_net",
    }

    def step(lots: DataFrame, layout: Layout) -> DataFrame:
        lots = projection.join_daily_forecast(lots, daily, layout)
        lots = projection.consumption_factor(reports.allocated_lots(lots, sources, BASE, layout), BASE)
        net = F.col("ending_inv_after_custord") - F.col("consumption_factor")
        return ledger.lot_neighbors(lots.withColumn("net", net), columns, layout)

    days = F.col("previous_days_left").cast("double").alias("previous_days_left")
    return _over_lots(sources, step).select(*LOT, "previous_ref", "next_ref", days, *columns.values())


def fifo_cumulative(sources: Sources) -> DataFrame:
    lots = _allocated(sources)
    total = F.col("total_custord_within_15_days")
    return lots.select(
        *LOT,
        "sum_of_inventory_qty",
        "inv_qty_cum_sum",
        "inv_after_custord_cal_1",
        "inv_qty_cum_sum_cal",
        (F.col("inv_qty_cum_sum_cal") - total).alias("inv_qty_cum_sum_cal_2"),
        (F.col("previous_cum_sum") - total).alias("previous_cum_sum_minus_orders"),
        (F.col("previous_cum_sum_cal") - total).alias("previous_cum_sum_cal_2"),
    )


def join_planner(sources: Sources, *columns: str) -> DataFrame:
    join = dims.join_planner_number if columns == ("planner_number",) else dims.join_planner
    return join(_lots(sources), _planners(sources), BASE).select("ref", "lot_number", *columns)


def join_item_type(sources: Sources) -> DataFrame:
    lots = dims.join_planner(_lots(sources), _planners(sources), BASE)
    lots = dims.join_item_type(lots, dims.item_type_dim(sources.item_type, BASE), BASE)
    return lots.select("ref", "lot_number", "planner_number", "mbx")


def join_open_orders(sources: Sources) -> DataFrame:
    lots = ledger.join_open_orders(_lots(sources), reports.open_orders(sources, BASE), Layout(BASE.ref_keys))
    return lots.select("ref", "lot_number", "total_custord_within_15_days")


def join_daily_forecast(sources: Sources, params: ReportParams) -> DataFrame:
    rates = reports.daily_rates(sources, params)
    lots = projection.join_daily_forecast(_lots(sources), rates, Layout(params.ref_keys))
    return lots.select("ref", "lot_number", "fcst_daily_avg_after_15_days")


def join_mfg_location(sources: Sources) -> DataFrame:
    mfg = dims.mfg_dim(sources.mfg_locations, TRANSFER)
    return transfer.join_mfg_location(_lots(sources), mfg, TRANSFER).select("ref", "lot_number", "mfg_loc", "mfg_ref")


def horizon_days(sources: Sources) -> DataFrame:
    rules = [ReportParams(as_of=AS_OF, horizon_rule=rule) for rule in HORIZON_RULES]
    rows = [
        demand.month_calendar(sources.forecast, params).select(
            F.lit(params.horizon_rule).alias("horizon_rule"),
            F.col("months").getItem(2).alias("first_month"),
            F.col("months").getItem(6).alias("last_month"),
            F.col("days").cast("int").alias("days"),
        )
        for params in rules
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _consumption(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rated(sample_sources(spark, sf_dir), rule).select(*LOT, "diff_factor", "consumption_factor")

    return run


def project_inventory(sources: Sources) -> DataFrame:
    return _projected(sources).select(
        *LOT, "ending_inv_after_custord", "consumption_factor", "inv_after_custord_and_fcst"
    )


def projection_value(sources: Sources) -> DataFrame:
    return _projected(sources).select(
        *LOT, "ending_inv_after_custord_and_fcst", "ending_inv_after_custord_and_fcst_in_cost"
    )


def _pivot_mfg(sources: Sources) -> DataFrame:
    return demand.forecast_pivot_mfg(sources.forecast, TRANSFER)


def forecast_net(sources: Sources) -> DataFrame:
    net = demand.forecast_net_of_orders(_pivot_mfg(sources), reports.open_orders(sources, TRANSFER), TRANSFER)
    return net.drop("days")


def _items(sources: Sources) -> DataFrame:
    lots = supply.normalize_lots(sources.inventory_lots, TRANSFER)
    mfg = dims.mfg_dim(sources.mfg_locations, TRANSFER)
    return transfer.join_mfg_location(transfer.item_locations(lots, TRANSFER), mfg, TRANSFER)


def transfer_flag(sources: Sources) -> DataFrame:
    flags = transfer.transfer_flag(transfer.site_totals(_items(sources), _pivot_mfg(sources), TRANSFER))
    return repeat_rows(flags.select("ref", "mfg_loc", "xfer_to_other_loc", "times"), "times")


def demand_rollups(sources: Sources) -> DataFrame:
    pairs = transfer.demand_by_pair(_pivot_mfg(sources), TRANSFER)
    none = F.lit(None).cast("string")
    by_pair = pairs.select("mfg_ref", "ref", F.col("sum_of_current_month").alias("demand"))
    by_ref = transfer.demand_by_ref(pairs, TRANSFER).select(
        none.alias("mfg_ref"), "ref", F.col("sum_of_current_month_ref").alias("demand")
    )
    by_mfg_ref = transfer.demand_by_mfg_ref(pairs, TRANSFER).select(
        "mfg_ref", none.alias("ref"), F.col("sum_of_current_month_mfg_ref").alias("demand")
    )
    return by_pair.unionByName(by_ref).unionByName(by_mfg_ref)


def demand_share(sources: Sources) -> DataFrame:
    shares = transfer.demand_share(transfer.site_totals(_items(sources), _pivot_mfg(sources), TRANSFER))
    return shares.select(
        "ref", "mfg_ref", "sum_of_current_month_ref", "sum_of_current_month_mfg_ref", "percent_of_overall_demand"
    )


def inspect_ref(sources: Sources) -> DataFrame:
    return reports.inspect_ref(sources, BASE, INSPECTED_REF).select(
        *LOT, "diff_factor", "consumption_factor", "inv_after_custord", "inv_after_custord_and_fcst"
    )


def inspect_refs(sources: Sources) -> DataFrame:
    """The item-locations with many cases on order."""
    ordered = reports.open_orders(sources, BASE).where(F.col("sum_of_open_order_cases") >= MANY_CASES)
    return reports.inspect_refs(sources, BASE, ordered.select("ref")).select(
        *LOT, "diff_factor", "consumption_factor", "inv_after_custord", "inv_after_custord_and_fcst"
    )


def sink_report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the backfill, write its last two snapshots once more by other rules, and read what the place holds."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    sources = sample_sources(spark, sf_dir, snapshots=True, joined_once=True)
    for params in (BACKFILL_ALIKE, BACKFILL_AGAIN):
        days = [rules.snapshot_date for rules in params.snapshots]
        write_snapshots(reports.report(sources, params), path, days, reports.report_order(params))
    return read_snapshots(spark, path)


def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the base report and read it back."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    write_report(
        reports.report(sample_sources(spark, sf_dir, joined_once=True), BASE), path, order=reports.report_order(BASE)
    )
    return spark.read.parquet(path)


def _on_sources(build: Callable[[Sources], DataFrame], snapshots: bool = False, joined_once: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared_folder(spark)
        return build(sample_sources(spark, sf_dir, snapshots, joined_once))

    return run


def on_sources() -> dict[str, Callable[[Sources], DataFrame]]:
    """The queries that read the sources of one day."""
    return {
        "normalize_lots": _normalized,
        "supply_by_lot": lambda s: supply.supply_by_lot(_normalized(s), BASE),
        "lot_sequence": lot_sequence,
        "lot_neighbors": lot_neighbors,
        "orders_within_horizon": lambda s: demand.orders_within_horizon(s.customer_orders, BASE),
        "orders_by_ref": lambda s: reports.open_orders(s, BASE),
        "item_planner_dim": lambda s: dims.item_planner_dim(s.item_planner, BASE),
        "item_type_dim": lambda s: dims.item_type_dim(s.item_type, BASE),
        "mfg_dim": lambda s: dims.mfg_dim(s.mfg_locations, TRANSFER),
        "forecast_pivot": lambda s: demand.forecast_pivot(s.forecast, BASE).drop("days"),
        "forecast_pivot_mfg": lambda s: _pivot_mfg(s).drop("days"),
        "horizon_days": horizon_days,
        "daily_forecast_base": lambda s: reports.daily_rates(s, BASE),
        "daily_forecast_weekly": lambda s: reports.daily_rates(s, WEEKLY),
        "daily_forecast_transfer": lambda s: reports.net_forecast(s, TRANSFER),
        "forecast_net_of_orders": forecast_net,
        "join_item_planner": lambda s: join_planner(s, "planner_number"),
        "join_planner_name": lambda s: join_planner(s, "planner_number", "planner_name"),
        "join_item_type": join_item_type,
        "join_open_orders": join_open_orders,
        "join_daily_forecast": lambda s: join_daily_forecast(s, BASE),
        "join_daily_forecast_transfer": lambda s: join_daily_forecast(s, TRANSFER),
        "join_mfg_location": join_mfg_location,
        "days_to_expiry": lambda s: reports.add_days(_lots(s), BASE).select(
            "ref", "lot_number", "expiration_date", "days_left_on_expired"
        ),
        "days_range": lambda s: reports.add_days(_lots(s), BASE).select(
            "ref", "lot_number", "days_left_on_ssl", "days_range"
        ),
        "inventory_value": lambda s: ledger.value_lots(_lots(s)).select(
            "ref", "lot_number", "unit_cost", "sum_of_inventory_qty_w_neg", "sum_of_inventory_qty", "inventory_in_cost"
        ),
        "diff_factor": lambda s: _allocated(s).select(
            *LOT, F.col("previous_days_left").cast("double").alias("previous_days_left"), "diff_factor"
        ),
        "fifo_cumulative": fifo_cumulative,
        "allocate_orders": lambda s: _allocated(s).select(
            *LOT, "total_custord_within_15_days", "sum_of_inventory_qty", "inv_after_custord"
        ),
        "ending_inventory": lambda s: _allocated(s).select(
            *LOT, "ending_inv_after_custord", "ending_inv_after_custord_in_cost"
        ),
        "project_inventory": project_inventory,
        "projection_value": projection_value,
        "transfer_attrs": lambda s: transfer.transfer_attrs(_pivot_mfg(s), TRANSFER),
        "transfer_flag": transfer_flag,
        "demand_rollups": demand_rollups,
        "demand_share": demand_share,
        "report_base": lambda s: reports.report(s, BASE),
        "report_weekly": lambda s: reports.report(s, WEEKLY),
        "report_transfer": lambda s: reports.report(s, TRANSFER),
        "report_transfer_fanout": lambda s: reports.report(with_second_sites(s), TRANSFER),
        "transfer_flag_fanout": lambda s: transfer_flag(with_second_sites(s)),
        "demand_share_fanout": lambda s: demand_share(with_second_sites(s)),
        "join_daily_forecast_fanout": lambda s: join_daily_forecast(with_second_sites(s), TRANSFER),
        "report_base_fanout": lambda s: reports.report(with_repeated_dimensions(s), BASE),
        "report_base_fanout_hot": lambda s: reports.report(with_repeated_dimensions(s), HOT),
        "report_base_keys": lambda s: reports.report(with_odd_keys(s), BASE),
        "project_inventory_nulls": lambda s: project_inventory(with_unknown_days(s)),
        "transfer_flag_three_sites": lambda s: transfer_flag(with_third_sites(s)),
        "demand_share_three_sites": lambda s: demand_share(with_third_sites(s)),
        "inspect_ref": inspect_ref,
        "inspect_refs": inspect_refs,
    }


def on_snapshots() -> dict[str, Callable[[Sources], DataFrame]]:
    """The queries that read the sources of three snapshots."""
    return {
        "report_backfill": lambda s: reports.report(s, BACKFILL),
        "report_backfill_defaults": lambda s: reports.report(s, BACKFILL_DEFAULTS),
        "report_backfill_transfer": lambda s: reports.report(s, BACKFILL_TRANSFER),
    }


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {f"src_{name}": _source(name) for name in SCHEMAS}
    found |= {f"src_typed_{name}": _typed_source(name) for name in ("inventory_lots", "forecast")}
    found |= {
        "promote_header": promoted,
        "clean_names": cleaned,
        "type_convert": converted,
        "excel_serial_to_date": serials,
        "build_ref_key": ref_keys,
        "r_ifelse_semantics": ifelse_semantics,
        "consumption_prev_shippable": _consumption("prev_shippable"),
        "consumption_same_ref": _consumption("same_ref"),
        "consumption_self_shippable": _consumption("self_shippable"),
        "sink_report": sink_report,
        "sink_report_runs": sink_report_runs,
    }
    found |= {name: _on_sources(build, joined_once=name.startswith(("report_", "inspect_"))) for name, build in on_sources().items()}
    return found | {name: _on_sources(build, snapshots=True, joined_once=True) for name, build in on_snapshots().items()}
