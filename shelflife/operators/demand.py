"""Open orders and the monthly forecast, per item-location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflife.functions import composite_key, divide, floor_at_zero, horizon_days, or_zero, round_half_even
from shelflife.functions import serial_to_date, strip_dashes
from shelflife.params import SNAPSHOT, ReportParams

# Roles of the seven lowest month codes, in order.
MONTH_ROLES = (
    "pre_month",
    "current_month",
    "fcst_month_1",
    "fcst_month_2",
    "fcst_month_3",
    "fcst_month_4",
    "fcst_month_5",
)
FORECAST_ROLES = MONTH_ROLES[2:]


def orders_within_horizon(orders: DataFrame, params: ReportParams) -> DataFrame:
    """Orders requested before the end of the order horizon. Past-due orders
    stay in; an order without a date is dropped."""
    sku = strip_dashes(F.col("product_label_sku"))
    ship_date = serial_to_date(F.col("sales_order_requested_ship_date"))
    return orders.select(
        *params.snapshot_keys,
        composite_key(F.col("location"), sku).alias("ref"),
        "location",
        sku.alias("sku"),
        ship_date.alias("sales_order_requested_ship_date"),
        or_zero(F.col("oo_cases")).alias("open_order_cases"),
    ).where(
        F.col("sales_order_requested_ship_date") < F.date_add(params.as_of_column, params.order_horizon_days)
    )


def orders_by_ref(orders: DataFrame, params: ReportParams) -> DataFrame:
    total = F.col("sum_of_open_order_cases")
    return (
        orders.groupBy(*params.ref_keys)
        .agg(F.sum("open_order_cases").alias("sum_of_open_order_cases"))
        .withColumn("custord_daily_avg", round_half_even(total / params.order_horizon_days))
    )


def normalize_forecast(forecast: DataFrame, params: ReportParams) -> DataFrame:
    sku = strip_dashes(F.col("product_label_sku_code"))
    return forecast.select(
        *params.snapshot_keys,
        composite_key(F.col("location_no"), sku).alias("ref"),
        composite_key(F.col("product_manufacturing_location_code"), sku).alias("mfg_ref"),
        F.col("forecast_month_year_code").alias("month"),
        or_zero(F.col("adjusted_forecast_cases")).alias("adjusted_forecast_cases"),
    )


def month_calendar(forecast: DataFrame, params: ReportParams) -> DataFrame:
    """One row (per snapshot): the seven lowest month codes and the horizon.
    The set holds distinct calendar months, so it is small by nature."""
    codes = forecast.select(*params.snapshot_keys, "forecast_month_year_code").distinct()
    lowest = F.slice(F.array_sort(F.collect_set("forecast_month_year_code")), 1, len(MONTH_ROLES))
    months = (
        codes.where(F.col(SNAPSHOT).isin([s.snapshot_date for s in params.snapshots]))
        .groupBy(*params.snapshot_keys)
        .agg(lowest.alias("months"))
        if params.many_snapshots
        else codes.agg(lowest.alias("months"))
    )
    found = F.concat_ws(", ", "months")
    message = F.concat(
        F.lit("the forecast of "), params.as_of_column.cast("string"),
        F.lit(f" has fewer than {len(MONTH_ROLES)} months: "), F.when(found == "", "none").otherwise(found),
    )
    enough = F.size("months") == len(MONTH_ROLES)
    months = months.withColumn("months", F.when(enough, F.col("months")).otherwise(F.raise_error(message)))
    return months.withColumn("days", _days(F.col("months"), params))


def attach_calendar(df: DataFrame, forecast: DataFrame, params: ReportParams) -> DataFrame:
    """Add `months` and `days`: literals when the months are given, otherwise
    read from the forecast (a scalar subquery, or one row per snapshot)."""
    if params.months:
        months = F.array(*[F.lit(m) for m in params.months])
        return df.withColumn("months", months).withColumn("days", _days(months, params))
    calendar = month_calendar(forecast, params)
    if params.many_snapshots:
        # One row for each snapshot in the parameters at most.
        return df.join(F.broadcast(calendar), list(params.snapshot_keys), "left")
    only = calendar.select(F.struct("months", "days")).scalar()
    return df.withColumn("_calendar", only).select("*", "_calendar.*").drop("_calendar")


def _days(months: Column, params: ReportParams) -> Column:
    return horizon_days(
        params.horizon_rule, months.getItem(2), months.getItem(6), params.as_of_column, params.order_horizon_days
    )


def forecast_pivot(forecast: DataFrame, params: ReportParams, *more_keys: str) -> DataFrame:
    """Monthly cases as one column per month role, in a single aggregation.
    Months after the seventh do not count; a key without a month has 0 there."""
    cells = attach_calendar(normalize_forecast(forecast, params), forecast, params)
    role = F.array_position("months", F.col("month"))
    cells = cells.select(*params.ref_keys, *more_keys, "days", "adjusted_forecast_cases", role.alias("role"))
    sums = [
        or_zero(F.sum(F.when(F.col("role") == i, F.col("adjusted_forecast_cases")))).alias(name)
        for i, name in enumerate(MONTH_ROLES, start=1)
    ]
    return cells.groupBy(*params.ref_keys, *more_keys).agg(*sums, F.max("days").alias("days"))


def forecast_pivot_mfg(forecast: DataFrame, params: ReportParams) -> DataFrame:
    """The pivot per item-location and manufacturing site, from the current
    month on."""
    if params.on_duplicate == "error":
        forecast = _unique_cells(forecast, params)
    return forecast_pivot(forecast, params, "mfg_ref").drop("pre_month")


def _unique_cells(forecast: DataFrame, params: ReportParams) -> DataFrame:
    cell = (
        *params.snapshot_keys,
        "location_no",
        "product_label_sku_code",
        "product_manufacturing_location_code",
        "forecast_month_year_code",
    )
    once = forecast.groupBy(*cell).agg(
        F.count("*").alias("_rows"), F.first("adjusted_forecast_cases").alias("adjusted_forecast_cases")
    )
    return once.withColumn(
        "adjusted_forecast_cases",
        F.when(F.col("_rows") > 1, F.raise_error(F.lit("duplicate forecast cell"))).otherwise(
            F.col("adjusted_forecast_cases")
        ),
    ).drop("_rows")


def _sum(names: tuple[str, ...]) -> Column:
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total


def _rounded(rate: Column, params: ReportParams) -> Column:
    rounded_up = F.when(F.abs(rate) == float("inf"), rate).otherwise(F.ceil(rate).cast("double"))
    return F.when(params.rule("rate_rounding") == "ceiling", rounded_up).otherwise(round_half_even(rate))


def daily_forecast(pivot: DataFrame, params: ReportParams) -> DataFrame:
    """Daily demand after the order horizon, per item-location."""
    total = F.col("sum_fcst_5months")
    return (
        pivot.withColumn("sum_fcst_5months", _sum(FORECAST_ROLES))
        .withColumn("fcst_daily", _rounded(divide(total, F.col("days").cast("double")), params))
        .select(*params.ref_keys, *MONTH_ROLES, "sum_fcst_5months", "fcst_daily")
    )


def forecast_net_of_orders(pivot_mfg: DataFrame, orders: DataFrame, params: ReportParams) -> DataFrame:
    """The current month less the open orders, and daily averages per month."""
    netted = (
        pivot_mfg.join(orders.select(*params.ref_keys, "sum_of_open_order_cases"), list(params.ref_keys), "left")
        .withColumn("custord_pivot", F.coalesce(F.col("sum_of_open_order_cases").try_cast("int"), F.lit(0)))
        .drop("sum_of_open_order_cases")
        .withColumn("current_month_after_custord", floor_at_zero(F.col("current_month") - F.col("custord_pivot")))
    )
    averages = {"current_month_daily_avg": F.col("current_month_after_custord") / params.order_horizon_days}
    averages |= {f"{name}_daily_avg": F.col(name) / params.month_days for name in FORECAST_ROLES}
    return netted.withColumns(averages).withColumn(
        "fcst_daily_avg", _sum(tuple(averages)) / len(averages)
    )


def daily_forecast_transfer(net: DataFrame, params: ReportParams) -> DataFrame:
    """Daily demand per item-location and manufacturing site, from the netted
    current month and the five forecast months."""
    total = F.col("fcst_daily_rowsum")
    return (
        net.withColumn("fcst_daily_rowsum", _sum((*FORECAST_ROLES, "current_month_after_custord")))
        .withColumn("fcst_daily", _rounded(divide(total, F.col("days").cast("double")), params))
        .select(
            *params.ref_keys,
            "mfg_ref",
            "current_month",
            "current_month_after_custord",
            "fcst_daily_rowsum",
            "fcst_daily",
        )
    )
