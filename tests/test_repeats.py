"""Lots that repeat: counted in one shuffle, sorted once."""

import re

from inputs import AS_OF, forecast, lot, make_sources, order
from pyspark.sql import functions as F
from shelflife.operators.hot_refs import rows_per_key
from shelflife.operators.repeats import copies
from shelflife.params import ReportParams
from shelflife.plans.reports import lot_parts, report


def test_copies_up_to_any_number(spark):
    times = [1, 2, 127, 128, 129, 300, 16385]
    df = spark.createDataFrame(list(enumerate(times)), "i int, times bigint")
    for most in (16385, 10**9):
        got = copies(df, "times", most)
        assert got.columns == ["i"]
        assert {r["i"]: r["count"] for r in got.groupBy("i").count().collect()} == dict(enumerate(times))
    assert copies(df.where("times = 1"), "times", 1).count() == 1


def test_equal_repeats_are_sorted_once(spark):
    sources = make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 10.0), lot("1", "L2", 30, 10.0), lot("1", "L3", None, 1.0), lot("2", "L4", -1, 3.0)],
        customer_orders=[order("1", 125.0), order("2", 1.0)],
        item_planner=[("10", "1", "3")] * 5 + [("10", "1", "4")],
        item_type=[("10-1", "x")] * 2,
        forecast=forecast("1", 145.0),
    )
    params = ReportParams.base(AS_OF)
    (part,) = lot_parts(sources, params)
    assert sorted(r["times"] for r in part.lots.collect()) == [1, 2, 2, 2, 10, 10, 10]
    got = report(sources, params)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[[^\]]*calculated_shippable_date", plan)) == 1
    first = got.where(F.col("`Lot#`") == "L1").collect()
    # Twelve repeats of ten cases, less 125 on order; only the first of them all is compared with the whole stock.
    assert sorted(r["Inv after CustOrd"] for r in first) == [10.0 * n - 125 for n in range(1, 13)]
    assert sorted(r["Inv after CustOrd"] for r in got.where(F.col("`Lot#`") == "L2").collect()) == [5.0] + [10.0] * 11
    assert got.count() == 37


def test_tables_are_counted_in_one_shuffle(spark):
    lots = spark.createDataFrame([("a",)] * 3 + [("b",)], "ref string")
    planners = spark.createDataFrame([("a", 2), ("a", 3), ("c", 9), (None, 4)], "ref string, times bigint")
    types = spark.createDataFrame([("a",), ("a",), ("b",)], "ref string")
    sites = spark.createDataFrame([("b",), ("b",)], "ref string")
    counts = rows_per_key(lots, [planners, types], ("ref",), [(sites, 3)])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {r["ref"]: (r["rows"], r["repeats"]) for r in counts.collect()} == {"a": (30.0, 10.0), "b": (8.0, 1.0)}
