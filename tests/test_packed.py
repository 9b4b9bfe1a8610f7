"""Lots with their text packed in one column."""

import re
from datetime import date

import pytest
from inputs import AS_OF
from pyspark.sql import functions as F
from shelflife.operators import supply
from shelflife.params import ReportParams, SnapshotRules
from shelflife.plans.reports import report
from shelflife.sources.sample import SNAPSHOT_DATES, sample_sources, with_repeated_dimensions

SF = "/root/testdata/sf0.001"
WEEKS = tuple(SnapshotRules(d) for d in SNAPSHOT_DATES)


def test_packed_columns_sort_as_their_columns(spark):
    types = "calculated_shippable_date date, days_left_on_ssl int, location string, sku string, description string, " \
        "lot_number string, expiration_date date, unit_cost double, planner_number string, planner_name string, mbx string"
    some = [(None, "b"), ("a", None), (None, None), ("a", "b"), ("", "a"), ("b", "")]
    rows = [
        (None, days, place, sku, "d", "l", day, cost, planner, name, name)
        for days in (None, -1, 3) for place, sku in some for day in (None, AS_OF) for cost in (None, float("nan"), -1.5)
        for planner, name in some[:4]
    ]
    lots = spark.createDataFrame(rows, types).repartition(3)
    packed = supply.packed(supply.packed(lots, supply.PACKED_LOT), supply.PACKED_REPEAT)
    whole = supply.opened(packed.orderBy(supply.LOT_ORDER[0], supply.PACKED_LOT, supply.PACKED_REPEAT)).select(*lots.columns)
    columns = [F.col(c).asc_nulls_last() for c in (*supply.LOT_ORDER, *supply.REPEAT_ORDER)]
    assert str(whole.collect()) == str(lots.orderBy(*columns).collect())


@pytest.mark.parametrize(
    "snapshots, params",
    [
        (False, ReportParams.base(date(1998, 6, 15))),
        (True, ReportParams.base(None, snapshots=WEEKS)),
        (True, ReportParams.transfer(None, snapshots=WEEKS)),
    ],
    ids=["fanout", "backfill", "backfill-transfer"],
)
def test_windows_carry_no_text_of_lots(spark, snapshots, params):
    sources = sample_sources(spark, SF, snapshots=snapshots)
    plan = report(sources if snapshots else with_repeated_dimensions(sources), params)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if re.search(r"\bWindow \[", line) and "calculated_shippable_date" in line]
    first = next(i for i, line in enumerate(lines) if re.search(r"\bWindow \[", line))
    carried = "\n".join(line for line in lines[first : windows[-1] + 2] if "Project [" in line)
    assert windows and "packed_lot#" in carried
    assert not re.search(r"\b(description|lot_number|planner_name|days_range|inventory_in_cost)#", carried)
