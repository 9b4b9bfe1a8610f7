import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from inputs import AS_OF, AS_OF_SERIAL, MONTHS, forecast, lot, make_sources, order
from shelflife.operators import demand
from shelflife.operators.hot_refs import BLOCK
from shelflife.params import SNAPSHOT, ReportParams, SnapshotRules
from shelflife.plans.reports import BASE_HEADERS, TRANSFER_HEADERS, lot_parts, report
from shelflife.sources.readers import Sources
from shelflife.sources.sample import AS_OF as SAMPLE_DAY
from shelflife.sources.sample import SNAPSHOT_DATES, sample_sources
from shelflife.sources.schemas import SCHEMAS

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_report_columns(spark):
    sources = make_sources(spark, inventory_lots=[lot("1", "L", 20, 1.0)])
    assert report(sources, ReportParams.base(AS_OF)).columns == list(BASE_HEADERS.values())
    assert report(sources, ReportParams.transfer(AS_OF)).columns == list(TRANSFER_HEADERS.values())
    assert len(BASE_HEADERS) == 26 and len(TRANSFER_HEADERS) == 29


def test_key_asymmetry_of_dashed_items(spark):
    """Lots and orders drop dashes, the planner source keeps them, and the
    item type turns them into underscores."""
    sources = make_sources(
        spark,
        inventory_lots=[lot("12345-ABC", "L", 20, 9.0)],
        customer_orders=[order("12345-ABC", 4.0)],
        item_planner=[("10", "12345-ABC", "7"), ("10", "12345ABC", "8")],
        planner_directory=[("7", "Seven"), ("8", "Eight")],
        item_type=[("10-12345-ABC", "x"), ("10-12345ABC", "y")],
    )
    row = report(sources, ReportParams.base(AS_OF)).first()
    assert (row["ref"], row["Planner Name"], row["MBX"]) == ("10-12345ABC", "Eight", "y")
    assert row["Inv after CustOrd"] == 5.0


def test_planner_names(spark):
    sources = make_sources(
        spark,
        inventory_lots=[lot(s, "L", 20, 1.0) for s in ("a", "b", "c", "d")],
        item_planner=[("10", "a", None), ("10", "b", "5"), ("10", "c", "6")],
        planner_directory=[("5", "Five"), ("0", "Nobody")],
        item_type=[("10-a", "m"), ("10-d", "m")],
    )
    got = {r["Sku"]: (r["Planner#"], r["Planner Name"], r["MBX"]) for r in report(sources, ReportParams.base(AS_OF)).collect()}
    assert got == {"a": ("0", None, "m"), "b": ("5", "Five", None), "c": ("6", None, None), "d": ("DNRR", "DNRR", "DNRR")}


def test_missing_location_has_a_key(spark):
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L", 20, 9.0, location=None)],
        customer_orders=[order("1", 2.0, location=None)],
    )
    row = report(sources, ReportParams.base(AS_OF)).first()
    assert (row["ref"], row["Location"], row["Inv after CustOrd"]) == ("NA-1", None, 7.0)


def test_orders_past_due_count_and_undated_do_not(spark):
    orders = [order("1", 1.0, days=-400), order("1", 2.0, days=14), order("1", 4.0, days=15), order("1", 8.0, days=None)]
    params = ReportParams.base(AS_OF)
    near = demand.orders_within_horizon(make_sources(spark, customer_orders=orders).customer_orders, params)
    assert [r.sum_of_open_order_cases for r in demand.orders_by_ref(near, params).collect()] == [3.0]


def test_extra_month_does_not_count(spark):
    cells = forecast("1", 145.0) + [("10", "1", "10", "202302", 9e9, 0.0)]
    sources = make_sources(spark, forecast=cells)
    for params in (ReportParams.base(AS_OF), ReportParams.base(AS_OF, months=tuple(MONTHS))):
        daily = demand.daily_forecast(demand.forecast_pivot(sources.forecast, params), params)
        assert [r.fcst_daily for r in daily.collect()] == [5.0]


def test_transfer_rate_nets_orders_and_rounds_up(spark):
    sources = make_sources(spark, forecast=forecast("1", 100.0), customer_orders=[order("1", 40.9)])
    params = ReportParams.transfer(AS_OF)
    net = demand.forecast_net_of_orders(
        demand.forecast_pivot_mfg(sources.forecast, params),
        demand.orders_by_ref(demand.orders_within_horizon(sources.customer_orders, params), params),
        params,
    )
    row = demand.daily_forecast_transfer(net, params).first()
    # Orders are cut to 40 whole cases: (5 * 100 + 60) / 145 = 3.86.
    assert (row.current_month_after_custord, row.fcst_daily_rowsum, row.fcst_daily) == (60.0, 560.0, 4.0)


def test_duplicate_dimension_keys_repeat_the_lot_before_the_totals(spark):
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 10.0), lot("1", "L2", 30, 10.0)],
        customer_orders=[order("1", 5.0)],
        item_planner=[("10", "1", "3"), ("10", "1", "4")],
        item_type=[("10-1", "x"), ("10-1", "y")],
    )
    got = report(sources, ReportParams.base(AS_OF))
    assert got.count() == 8
    # Only the first of the four repeats of the first lot pays for the orders.
    assert sorted(r["Inv after CustOrd"] for r in got.collect()) == [5.0] + [10.0] * 7
    with pytest.raises(Exception, match="duplicate dimension key"):
        report(sources, ReportParams.base(AS_OF, on_duplicate="error")).collect()


def test_unique_keys_pass_the_duplicate_check(spark):
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 10.0)],
        item_planner=[("10", "1", "3")],
        item_type=[("10-1", "x")],
        planner_directory=[("3", "Three")],
        forecast=forecast("1", 30.0),
    )
    for make in (ReportParams.base, ReportParams.transfer):
        strict = report(sources, make(AS_OF, on_duplicate="error"))
        assert rows(strict) == rows(report(sources, make(AS_OF)))


def test_repeats_from_dimensions_count_towards_a_split(spark):
    """Two lots, but 120 rows once the repeated planner keys are joined."""
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 10.0), lot("1", "L2", 30, 10.0), lot("2", "L3", 30, 10.0)],
        customer_orders=[order("1", 35.0)],
        item_planner=[("10", "1", str(i)) for i in range(60)],
        forecast=forecast("1", 145.0),
    )
    whole, split = ReportParams.base(AS_OF), ReportParams.base(AS_OF, lots_per_task=20)
    assert len(lot_parts(sources, whole)) == 1
    parts = lot_parts(sources, split)
    assert parts[1].lots.select(BLOCK).distinct().count() > 3
    got = report(sources, split)
    assert got.count() == 121
    assert rows(got) == rows(report(sources, whole))


def two_sites(spark):
    return make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 10.0), lot("1", "L2", 40, 10.0), lot("9", "L3", 40, 4.0)],
        forecast=forecast("1", 58.0, site="10") + forecast("1", 290.0, site="20") + forecast("1", 10.0, location="30", site="20"),
        mfg_locations=[("10", "10", "1"), ("10", "20", "1"), ("10", "20", "1")],
    )


def test_two_sites_repeat_the_lot(spark):
    got = report(two_sites(spark), ReportParams.transfer(AS_OF))
    by_sku = {r["Sku"]: r["count"] for r in got.groupBy("Sku").count().collect()}
    # 2 lots x 2 rates x 2 site rows x (2 x 2) transfer attributes; no sites for sku 9.
    assert by_sku == {"1": 32, "9": 1}
    alone = got.where(F.col("Sku") == "9").first()
    assert (alone["Mfg Loc"], alone["Xfer to other Loc?"], alone["% of overall demand"]) == (None, "N", "0%")
    assert {r["Xfer to other Loc?"] for r in got.where(F.col("Sku") == "1").collect()} == {"N", "Y"}
    # 4 pairs per row: site 10 is own and serves one (N with itself, Y with
    # the foreign site's row), site 20 serves two (Y with both).
    flags = got.where((F.col("Sku") == "1") & (F.col("Xfer to other Loc?") == "N")).count()
    assert flags == 32 // 4
    shares = {(r["Mfg Loc"], r["% of overall demand"]) for r in got.where(F.col("Sku") == "1").collect()}
    # 348 of 58 and 348 of 300 cases.
    assert shares == {("10", "600%"), ("20", "116%")}
    # The first lot's repeats both start a chain; the second lot's follow.
    rates = got.where(F.col("Sku") == "1").select("Lot#", F.col("`Fcst daily avg. (after 15 days)`").alias("rate"), F.col("`Inv after Custord & Fcst`").alias("left")).distinct().collect()
    values = {(r["Lot#"], r["rate"]): r["left"] for r in rates}
    assert values == {
        ("L1", 3.0): 10.0 - 15.0,
        ("L1", 12.0): 10.0 - 60.0,
        ("L2", 3.0): 10.0 - 60.0 - 50.0,
        ("L2", 12.0): 10.0 - 240.0 - 100.0,
    }


@pytest.mark.parametrize("make", [ReportParams.base, ReportParams.weekly, ReportParams.transfer])
def test_split_report_equals_whole(spark, make):
    sources = sample_sources(spark, SF)
    whole, split = (report(sources, make(SAMPLE_DAY, lots_per_task=n)) for n in (10**9, 12))
    assert rows(whole) == rows(split)


def test_split_report_with_two_sites(spark):
    sources = two_sites(spark)
    whole, split = (report(sources, ReportParams.transfer(AS_OF, lots_per_task=n)) for n in (10**9, 1))
    assert rows(whole) == rows(split)


@pytest.mark.parametrize("make", [ReportParams.weekly, ReportParams.transfer])
def test_backfill_equals_one_report_per_snapshot(spark, make):
    rules = [
        SnapshotRules(SNAPSHOT_DATES[0], "prev_shippable", "half_even"),
        SnapshotRules(SNAPSHOT_DATES[1], "same_ref", "ceiling"),
        SnapshotRules(SNAPSHOT_DATES[2], "self_shippable", "half_even"),
    ]
    sources = sample_sources(spark, SF, snapshots=True)
    backfill = report(sources, make(snapshots=tuple(rules))).cache()
    for rule in rules:
        day = F.col(SNAPSHOT) == rule.snapshot_date
        one = Sources(**{name: getattr(sources, name).where(day).drop(SNAPSHOT) for name in SCHEMAS})
        single = report(one, make(rule.snapshot_date, consumption_rule=rule.consumption_rule, rate_rounding=rule.rate_rounding))
        assert rows(backfill.where(day).drop(SNAPSHOT)) == rows(single)
    split = report(sources, make(snapshots=tuple(rules), lots_per_task=7))
    assert rows(split) == rows(backfill)


def test_published_quantity_and_row_count(spark):
    sources = sample_sources(spark, SF)
    got = report(sources, ReportParams.base(SAMPLE_DAY))
    raw = sources.inventory_lots.agg(F.sum("inventory_qty_cases")).first()[0]
    total, low, count = got.agg(
        F.sum(F.col("`Sum of Inventory Qty (Cases)`")), F.min("`Ending Inv after Custord & Fcst`"), F.count("*")
    ).first()
    assert total == raw and low >= 0
    assert count == sources.inventory_lots.drop("mfg_date", "inventory_qty_cases").distinct().count()


@pytest.mark.parametrize("make", [ReportParams.base, ReportParams.weekly, ReportParams.transfer])
def test_plan_has_no_single_partition_window_or_python(spark, make):
    months = ("199805", "199806", "199807", "199808", "199809", "199810", "199811")
    plan = plan_of(report(sample_sources(spark, SF), make(SAMPLE_DAY, months=months)))
    assert "SinglePartition" not in plan
    assert not re.search(r"Python|ArrowEval|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
    # Without given months only the one-row calendar is gathered.
    plan = plan_of(report(sample_sources(spark, SF), make(SAMPLE_DAY)))
    for line in plan.splitlines():
        assert "SinglePartition" not in line or "Exchange" in line
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("make", [ReportParams.base, ReportParams.transfer])
def test_ledger_is_shuffled_twice(spark, make):
    """Once to sum the lots and once by item-location. The ledger is the left
    side of every join, so its shuffles are on the leftmost path."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(report(sample_sources(spark, SF), make(SAMPLE_DAY)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth, leftmost = -1, []
    for line in plan.splitlines():
        indent = re.search(r"[A-Z]", line).start()
        if indent <= depth:
            break
        depth = indent
        leftmost.append(line)
    shuffles = [line for line in leftmost if "Exchange hashpartitioning(" in line]
    until_lots = [line for line in shuffles if "ref#" in line or "lot_number#" in line]
    assert [("lot_number#" in line) for line in until_lots] == [False, True]


def test_base_report_sorts_the_ledger_once_for_all_windows(spark):
    plan = plan_of(report(sample_sources(spark, SF), ReportParams.base(SAMPLE_DAY)))
    assert len(re.findall(r"Sort \[[^\]]*calculated_shippable_date", plan)) == 1
    assert len(re.findall(r"\bWindow \[", plan)) >= 3


def test_settings_are_checked():
    with pytest.raises(ValueError):
        ReportParams()
    with pytest.raises(ValueError):
        ReportParams.base(date(2022, 1, 1), horizon_rule="monthly")
    with pytest.raises(ValueError):
        ReportParams.base(date(2022, 1, 1), months=("202201",))
    with pytest.raises(ValueError):
        SnapshotRules(date(2022, 1, 1), consumption_rule="none")
    assert AS_OF_SERIAL == (AS_OF - date(1899, 12, 30)) // timedelta(days=1)
