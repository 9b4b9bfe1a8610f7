"""Rules that an earlier version had wrong: rounding of prices, default rules of
snapshots, short forecasts, hot keys by every kind of repeat, written order."""

import re
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from inputs import AS_OF, MONTHS, forecast, kept_since, lot, make_sources, order, shuffle_files
from shelflife.functions import round_half_even
from shelflife.operators import hot_refs
from shelflife.operators.hot_refs import BLOCK
from shelflife.params import SNAPSHOT, ReportParams, SnapshotRules
from shelflife.plans.reports import full_ledger, inspect_ref, inspect_refs, lot_parts, report, report_order
from shelflife.sources.readers import Sources, write_report
from shelflife.sources.sample import SNAPSHOT_DATES, sample_sources
from shelflife.sources.schemas import SCHEMAS

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_prices_round_to_the_nearer_double(spark):
    cases = {1.015: 1.01, 2.675: 2.67, 0.125: 0.12, 0.375: 0.38, 901.0: 901.0, 0.29: 0.29, -1.015: -1.01, 1.1: 1.1, 5e20: 5e20}
    df = spark.createDataFrame([(k,) for k in [*cases, None, float("inf")]], "x double")
    found = {r[0]: r[1] for r in df.select("x", round_half_even(F.col("x"), 2)).collect()}
    assert found == cases | {None: None, float("inf"): float("inf")}


@pytest.mark.parametrize("make", [ReportParams.base, ReportParams.weekly, ReportParams.transfer])
def test_a_snapshot_without_rules_has_those_of_the_profile(spark, make):
    sources = sample_sources(spark, SF, snapshots=True)
    day = SNAPSHOT_DATES[1]
    dated = Sources(**{name: getattr(sources, name).where(F.col(SNAPSHOT) == day) for name in SCHEMAS})
    one = Sources(**{name: getattr(dated, name).drop(SNAPSHOT) for name in SCHEMAS})
    params = ReportParams.base(None, snapshots=(SnapshotRules(day),)) if make == ReportParams.base else make(snapshots=(SnapshotRules(day),))
    assert rows(report(dated, params).drop(SNAPSHOT)) == rows(report(one, make(day)))


def test_backfill_does_not_shuffle_by_snapshot(spark):
    sources = sample_sources(spark, SF, snapshots=True)
    params = ReportParams.transfer(snapshots=tuple(SnapshotRules(d) for d in SNAPSHOT_DATES))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = report(sources, params)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "SortMergeJoin [snapshot_date" in line]
    assert all("ref#" in line or "planner_number#" in line for line in joins)


@pytest.mark.parametrize("months", [MONTHS[:6], []])
def test_a_short_forecast_is_named(spark, months):
    cells = [row for row in forecast("1", 30.0) if row[3] in months]
    sources = make_sources(spark, inventory_lots=[lot("1", "L", 20, 1.0)], forecast=cells)
    with pytest.raises(Exception, match=f"forecast of {AS_OF} has fewer than 7 months: {', '.join(months) or 'none'}"):
        report(sources, ReportParams.base(AS_OF)).collect()


def test_repeats_by_the_planner_directory_count(spark):
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 5.0), lot("1", "L2", 30, 5.0)],
        item_planner=[("10", "1", "7")],
        planner_directory=[("7", f"name {k}") for k in range(60)],
        forecast=forecast("1", 30.0),
    )
    split, whole = ReportParams.base(AS_OF, lots_per_task=20), ReportParams.base(AS_OF)
    assert len(lot_parts(sources, split)) == 2 and len(lot_parts(sources, whole)) == 1
    assert rows(report(sources, split)) == rows(report(sources, whole))
    assert report(sources, whole).count() == 120


def test_repeats_by_sites_count(spark):
    sites = [str(k) for k in range(6)]
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 5.0), lot("1", "L2", 30, 5.0)],
        mfg_locations=[("10", s, "1") for s in sites],
        forecast=[row for s in sites for row in forecast("1", 30.0, site=s)],
    )
    split, whole = ReportParams.transfer(AS_OF, lots_per_task=20), ReportParams.transfer(AS_OF)
    assert len(lot_parts(sources, split)) == 2 and len(lot_parts(sources, whole)) == 1
    assert rows(report(sources, split)) == rows(report(sources, whole))
    assert report(sources, whole).count() == 2592


def test_every_key_may_be_hot(spark):
    skus = [f"s{k:03}" for k in range(150)]
    sources = make_sources(
        spark,
        inventory_lots=[lot(s, f"L{n}", 20 + 9 * n, 5.0 + n) for s in skus for n in range(3)],
        customer_orders=[order(s, 7.0) for s in skus[::2]],
        forecast=[row for s in skus[::3] for row in forecast(s, 30.0)],
    )
    whole, split = (report(sources, ReportParams.base(AS_OF, lots_per_task=n)) for n in (10**9, 2))
    assert rows(whole) == rows(split)


def test_report_is_written_in_the_order_of_the_keys(spark, tmp_path):
    sources = make_sources(
        spark,
        inventory_lots=[lot(s, n, 20, 5.0, location=place) for place in ("10", "1") for s in ("5", "05") for n in ("b", "a")],
        forecast=forecast("5", 30.0),
    )
    params = ReportParams.base(AS_OF)
    write_report(report(sources, params), str(tmp_path / "out"), order=report_order(params))
    written = spark.read.parquet(str(tmp_path / "out")).coalesce(1)
    assert [(r["ref"], r["Lot#"]) for r in written.collect()] == [
        (ref, n) for ref in ("10-05", "10-5", "1-05", "1-5") for n in ("a", "b")
    ]


def test_lookup_reaches_the_scan(spark, tmp_path):
    sources = make_sources(
        spark, inventory_lots=[lot("5", "L", 20, 5.0, location=p) for p in ("10", "1", None)], forecast=forecast("5", 30.0)
    )
    stored = {}
    for name in SCHEMAS:
        getattr(sources, name).write.parquet(str(tmp_path / name))
        stored[name] = spark.read.schema(SCHEMAS[name]).parquet(str(tmp_path / name))
    found = inspect_ref(Sources(**stored), ReportParams.base(AS_OF), "10_5")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("PushedFilters" in line and "location" in line.split("PushedFilters")[1] for line in plan.splitlines() if "inventory_qty_cases" in line)
    assert inspect_ref(Sources(**stored), ReportParams.base(AS_OF), "NA_5").count() == 1


def stored_by_location(spark, folder, sources):
    """Lots, orders and planners in folders by location, the others as plain Parquet."""
    kept = {}
    for name, schema in SCHEMAS.items():
        by = {"inventory_lots": "location", "customer_orders": "location", "item_planner": "b_p"}.get(name)
        writer = getattr(sources, name).write
        (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")
        kept[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return Sources(**kept)


def test_a_thousand_lookups_read_their_folders(spark, tmp_path):
    places = [None, *(f"{p}" for p in range(30)), "x_1"]
    sources = make_sources(
        spark,
        inventory_lots=[lot(f"{s}", n, 20 + s, 5.0, location=p) for p in places for s in range(40) for n in ("a", "b")],
        customer_orders=[order(f"{s}", 7.0, location=p) for p in places for s in range(0, 40, 3)],
        item_planner=[(p, f"{s}", "7") for p in places for s in range(40)],
        planner_directory=[("7", "Seven")],
        forecast=forecast("5", 30.0, location="3"),
    )
    params = ReportParams.base(AS_OF)
    asked = [f"{p}_{s}" for p in range(25) for s in range(40)] + ["x_1_5", "NA_5", "NA_5", "3-5", "nowhere_1", None, ""]
    refs = spark.createDataFrame([(r,) for r in asked], "ref string")
    stored = stored_by_location(spark, str(tmp_path), sources)
    found = inspect_refs(stored, params, refs)
    whole = full_ledger(sources, params).where(F.col("ref").isin([r for r in asked if r]))
    assert rows(found.select(sorted(found.columns))) == rows(whole.select(sorted(whole.columns)))
    assert found.count() == 2 * (1000 + 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line and "dynamicpruning" in line]
    assert any("inventory_qty_cases" in line for line in pruned) and any("oo_cases" in line for line in pruned)
    assert inspect_refs(stored, params, refs.limit(0)).count() == 0


def test_lots_without_sites_stay(spark):
    sources = make_sources(spark, inventory_lots=[lot("1", "L", 20, 5.0)], forecast=forecast("9", 30.0))
    row = report(sources, ReportParams.transfer(AS_OF)).first()
    assert (row["Mfg Loc"], row["Xfer to other Loc?"], row["% of overall demand"]) == (None, "N", "0%")


def test_rules_may_be_left_out():
    assert SnapshotRules(date(2022, 1, 1)).consumption_rule is None


def equal_rows(spark, n, types=1):
    """Two lots whose planner is n times the same in the directory."""
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 5.0), lot("1", "L2", 30, 7.0), lot("2", "L3", 9, 1.0)],
        customer_orders=[order("1", 23.0)],
        item_planner=[("10", "1", "7"), ("10", "2", "8")],
        item_type=[("10-1", "x")] * types,
        forecast=forecast("1", 30.0),
    )
    directory = spark.range(n).selectExpr("'7' AS address_number", "'Seven' AS alpha_name")
    return replace(sources, planner_directory=directory.unionByName(spark.createDataFrame([("8", "Eight")], directory.schema)))


@pytest.mark.parametrize("make", [ReportParams.base, ReportParams.transfer])
def test_equal_repeats_are_cut_apart(spark, make):
    sources = equal_rows(spark, 60, types=2)
    whole, split = make(AS_OF, lots_per_task=10**9), make(AS_OF, lots_per_task=16)
    parts = lot_parts(sources, split)
    assert parts[1].lots.groupBy(BLOCK).count().count() > 8
    assert rows(report(sources, split)) == rows(report(sources, whole))
    assert report(sources, whole).count() == 2 * 60 * 2 + 1


def test_a_hot_part_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    parts = lot_parts(equal_rows(spark, 60, types=2), ReportParams.base(AS_OF, lots_per_task=16))
    assert len(parts) == 2
    assert not kept_since(spark, before)


@pytest.mark.parametrize(("repeats", "dealt"), [(8, False), (9, True)])
def test_only_many_equal_repeats_are_dealt_to_tasks(spark, monkeypatch, repeats, dealt):
    """A shuffle of all of a hot key's rows, only where some lot has many equal rows to form."""
    plans, form = [], hot_refs._formed

    def formed(*args):
        plans.append((found := form(*args))._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(hot_refs, "_formed", formed)
    sources = equal_rows(spark, repeats, types=2)
    split, whole = ReportParams.base(AS_OF, lots_per_task=5), ReportParams.base(AS_OF, lots_per_task=10**9)
    assert rows(report(sources, split)) == rows(report(sources, whole))
    assert len(plans) == 1 and ("_first" in plans[0].partition("RepartitionByExpression")[2].partition("\n")[0]) == dealt


def test_a_million_equal_directory_rows(spark):
    """They meet the lots as one row with a number, and lie in blocks of the size of a task."""
    params = ReportParams.base(AS_OF, lots_per_task=20_000)
    parts = lot_parts(equal_rows(spark, 10**6), params)
    sizes = [r["count"] for r in parts[1].lots.groupBy(BLOCK).count().collect()]
    assert sum(sizes) == 2 * 10**6 and max(sizes) < 2 * params.lots_per_task


def test_lookups_are_not_dealt_by_location(spark):
    """A location may have any share of the rows; only keys deal them evenly."""
    sources = make_sources(spark, inventory_lots=[lot("1", "L1", 20, 5.0), lot("2", "L1", 20, 5.0)], forecast=forecast("1", 30.0))
    refs = spark.createDataFrame([("10_1",)], "ref string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = inspect_refs(sources, ReportParams.base(AS_OF), refs)
        dealt = re.findall(r"hashpartitioning\(([^)]*\)?[^)]*)", found._jdf.queryExecution().executedPlan().toString())
        assert found.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_place = [d for d in dealt if "_place" in d or d.startswith(("coalesce(location", "coalesce(b_p"))]
    assert by_place and all("_" in d and ("_ref" in d or "concat_ws" in d) for d in by_place)
