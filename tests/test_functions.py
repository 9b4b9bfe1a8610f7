from datetime import date

import pytest
from pyspark.sql import functions as F

from shelflife.functions import (
    composite_key,
    days_range,
    divide,
    floor_at_zero,
    horizon_days,
    if_else,
    month_end,
    percent_text,
    round_half_even,
    serial_to_date,
    strip_dashes,
)
from shelflife.sources.staging import snake_case


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_unknown_condition_gives_unknown(spark):
    column = if_else(F.col("c"), F.lit("yes"), F.lit("no"))
    assert values(spark, [(True,), (False,), (None,)], "c boolean", column) == ["yes", "no", None]


def test_floor_keeps_null(spark):
    assert values(spark, [(-1.0,), (0.0,), (2.0,), (None,)], "x double", floor_at_zero(F.col("x"))) == [0, 0, 2, None]


def test_half_even(spark):
    rows = [(0.5,), (1.5,), (2.5,), (-2.5,), (2.51,), (None,)]
    assert values(spark, rows, "x double", round_half_even(F.col("x"))) == [0, 2, 2, -2, 3, None]


def test_keys(spark):
    rows = [("1", "12-34-A"), (None, "5"), ("2", None), (None, None)]
    key = composite_key(F.col("l"), strip_dashes(F.col("s")))
    assert values(spark, rows, "l string, s string", key) == ["1_1234A", "NA_5", "2_NA", "NA_NA"]


def test_percent_text(spark):
    # 0/0 counts as zero, x/0 is infinite, halves round to even.
    rows = [(1.0, 3.0), (5.0, 1000.0), (25.0, 1000.0), (15.0, 1000.0), (0.0, 0.0), (4.0, 0.0), (None, 4.0), (4.0, None)]
    text = percent_text(divide(F.col("a"), F.col("b")))
    assert values(spark, rows, "a double, b double", text) == ["33%", "0%", "2%", "2%", "0%", "Inf%", "0%", "0%"]


def test_days_range(spark):
    rows = [(-3,), (0,), (1,), (30,), (31,), (60,), (61,), (None,)]
    expected = ["unshippable", "unshippable", "1-30", "1-30", "31-60", "31-60", ">60", None]
    assert values(spark, rows, "d int", days_range(F.col("d"))) == expected


def test_serials_cut_the_time_of_day(spark):
    rows = [(44797.0,), (44797.75,), (None,)]
    day = date(2022, 8, 24)
    assert values(spark, rows, "x double", serial_to_date(F.col("x"))) == [day, day, None]


def test_month_codes(spark):
    rows = [("202302",), ("2024_02",)]
    assert values(spark, rows, "m string", month_end(F.col("m"))) == [date(2023, 2, 28), date(2024, 2, 29)]


@pytest.mark.parametrize("rule, days", [("base", 145), ("weekly", 152), ("transfer", 145)])
def test_horizon(spark, rule, days):
    rows = [("202209", "202301", date(2022, 8, 24))]
    column = horizon_days(rule, F.col("a"), F.col("b"), F.col("d"), 15)
    assert values(spark, rows, "a string, b string, d date", column) == [days]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("B/P", "b_p"),
        ("Inventory Qty (Cases)", "inventory_qty_cases"),
        ("Planner#", "planner_number"),
        ("% of demand", "percent_of_demand"),
        ("lotNumber", "lot_number"),
        ("5 Months", "x5_months"),
        ("Product Label SKU", "product_label_sku"),
        ("Adjusted Forecast Pounds (lbs.)", "adjusted_forecast_pounds_lbs"),
    ],
)
def test_snake_case(raw, clean):
    assert snake_case(raw) == clean
