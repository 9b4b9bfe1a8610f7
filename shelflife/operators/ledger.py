"""First-expiring-first allocation of open orders to the lots of each
item-location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelflife.functions import floor_at_zero, if_else, or_zero
from shelflife.operators.hot_refs import BLOCK, REPEAT, Layout
from shelflife.operators.repeats import copies
from shelflife.operators.supply import LOT_ORDER, PACKED_LOT, PACKED_REPEAT, REPEAT_ORDER

ORDERS = "total_custord_within_15_days"


def join_open_orders(lots: DataFrame, orders: DataFrame, layout: Layout) -> DataFrame:
    joined = layout.join(lots, orders.select(*layout.keys, "sum_of_open_order_cases"))
    return joined.withColumn(ORDERS, or_zero(F.col("sum_of_open_order_cases"))).drop("sum_of_open_order_cases")


def value_lots(lots: DataFrame) -> DataFrame:
    """The quantity that counts (never negative) and its value."""
    return lots.withColumn("sum_of_inventory_qty", floor_at_zero(F.col("sum_of_inventory_qty_w_neg"))).withColumn(
        "inventory_in_cost", F.col("sum_of_inventory_qty") * F.col("unit_cost")
    )


def lot_order_columns(lots: DataFrame) -> list[str]:
    lot = [LOT_ORDER[0], PACKED_LOT] if PACKED_LOT in lots.columns else LOT_ORDER
    repeat = [PACKED_REPEAT] if PACKED_REPEAT in lots.columns else REPEAT_ORDER
    return [c for c in (*lot, *repeat, REPEAT) if c in lots.columns]


def sequence_lots(lots: DataFrame, layout: Layout) -> DataFrame:
    """Number the lots of each key and add everything the later steps need
    from earlier lots: one shuffle and one sort for all columns.

    `inv_qty_cum_sum` runs over all lots, `inv_qty_cum_sum_cal` over shippable
    ones and is NULL from the first lot with unknown days on. A `previous_`
    column is the value up to the lot before, NULL on the first lot.

    A lot with a number in `times` is sorted once and repeats after that.
    """
    lot_order = layout.window(lot_order_columns(lots))
    before = lot_order.rowsBetween(W.unboundedPreceding, -1)
    days, qty = F.col("days_left_on_ssl"), F.col("sum_of_inventory_qty")
    shippable = F.col("inv_after_custord_cal_1")
    unknown = F.when(days.isNull(), 1).otherwise(0).cast("bigint")
    repeated = "times" in lots.columns
    times = F.col("times") if repeated else F.lit(1).cast("bigint")
    rows = F.coalesce(F.sum(times).over(before), F.lit(0)) + 1 if repeated else F.row_number().over(lot_order).cast("bigint")
    lots = lots.withColumn("inv_after_custord_cal_1", if_else(days <= 0, F.lit(0.0), qty)).withColumns(
        {
            "lot_seq": rows,
            "previous_days_left": F.lag(days).over(lot_order),
            "_qty_before": or_zero(F.sum(qty * times if repeated else qty).over(before)),
            "_shippable_before": or_zero(F.sum(shippable * times if repeated else shippable).over(before)),
            "_unknown_before": F.coalesce(F.sum(unknown * times).over(before), F.lit(0)),
        }
    )
    if repeated:
        # The copies of a lot are equal until they are numbered, in the order that the later windows meet them in.
        lots = copies(lots, "times", layout.most_repeats).withColumn("_row", F.row_number().over(lot_order).cast("bigint"))
        lots = _continue_repeats(lots.withColumn("_copy", F.col("_row") - F.col("lot_seq")), unknown).drop("_copy", "_row")
    lots = lots.withColumns(
        {
            "_qty": F.col("_qty_before") + or_zero(qty),
            "_shippable": F.col("_shippable_before") + or_zero(shippable),
            "_unknown": F.col("_unknown_before") + unknown,
        }
    )
    if layout.split:
        lots = _continue_blocks(lots, layout)
    lots = lots.withColumn("is_first", F.col("lot_seq") == 1)
    return lots.withColumns(
        {
            "inv_qty_cum_sum": F.col("_qty"),
            "inv_qty_cum_sum_cal": F.when(F.col("_unknown") == 0, F.col("_shippable")),
            "previous_cum_sum": F.when(~F.col("is_first"), F.col("_qty_before")),
            "previous_cum_sum_cal": F.when(
                ~F.col("is_first") & (F.col("_unknown_before") == 0), F.col("_shippable_before")
            ),
        }
    ).drop("_qty", "_qty_before", "_shippable", "_shippable_before", "_unknown", "_unknown_before")


def _continue_repeats(lots: DataFrame, unknown: Column) -> DataFrame:
    """Add a lot's own earlier repeats, `_copy` of them, to the values before the lot."""
    nth, again = F.col("_copy"), F.col("_copy") > 0
    return lots.withColumns(
        {
            "lot_seq": F.col("_row"),
            "previous_days_left": F.when(again, F.col("days_left_on_ssl")).otherwise(F.col("previous_days_left")),
            "_qty_before": F.col("_qty_before") + F.when(again, or_zero(F.col("sum_of_inventory_qty") * nth)).otherwise(0.0),
            "_shippable_before": F.col("_shippable_before") + F.when(again, or_zero(F.col("inv_after_custord_cal_1") * nth)).otherwise(0.0),
            "_unknown_before": F.col("_unknown_before") + unknown * nth,
        }
    )


def _continue_blocks(lots: DataFrame, layout: Layout) -> DataFrame:
    """Add the totals of earlier blocks to the running values of each block."""
    running = ("_qty", "_shippable", "_unknown")
    totals = (
        lots.groupBy(*layout.partition)
        .agg(
            F.count("*").alias("rows"),
            F.sum("sum_of_inventory_qty").alias("qty"),
            or_zero(F.sum("inv_after_custord_cal_1")).alias("shippable"),
            F.count(F.when(F.col("days_left_on_ssl").isNull(), 1)).alias("unknown"),
            F.max_by("days_left_on_ssl", "lot_seq").alias("last_days"),
        )
    )
    by_block = W.partitionBy(*layout.keys).orderBy(BLOCK)
    earlier = by_block.rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *layout.partition,
        *[F.sum(c).over(earlier).alias(f"_carried_{c}") for c in ("rows", "qty", "shippable", "unknown")],
        F.lag("last_days").over(by_block).alias("_carried_days"),
    )
    lots = lots.join(carried, list(layout.partition), "left")
    starts_block = F.col("lot_seq") == 1
    shifted = {
        name: F.col(name) + F.coalesce(F.col(f"_carried{base}"), F.lit(0))
        for base in running
        for name in (base, f"{base}_before")
    }
    return (
        lots.withColumn(
            "previous_days_left",
            F.when(starts_block, F.col("_carried_days")).otherwise(F.col("previous_days_left")),
        )
        .withColumns({**shifted, "lot_seq": F.col("lot_seq") + F.coalesce("_carried_rows", F.lit(0))})
        .drop("_carried_rows", "_carried_qty", "_carried_shippable", "_carried_unknown", "_carried_days")
    )


def lot_neighbors(lots: DataFrame, columns: dict[str, str], layout: Layout) -> DataFrame:
    """`previous_ref` and `next_ref` (NULL at the ends of a sequence) and, per
    entry of `columns`, the value of the lot before under a new name. Needs
    `lot_seq`."""
    if layout.split:
        return _neighbors_by_number(lots, columns, layout)
    sequence = layout.window(["lot_seq"])
    return lots.withColumns(
        {"previous_ref": F.lag("ref").over(sequence), "next_ref": F.lead("ref").over(sequence)}
        | {name: F.lag(column).over(sequence) for column, name in columns.items()}
    )


def _neighbors_by_number(lots: DataFrame, columns: dict[str, str], layout: Layout) -> DataFrame:
    """The same by equi-joins on the lot number, which crosses blocks and
    spreads the lots of one item-location over all tasks."""
    on = [*layout.keys, "lot_seq"]
    before = lots.select(
        *layout.keys,
        (F.col("lot_seq") + 1).alias("lot_seq"),
        F.col("ref").alias("previous_ref"),
        *[F.col(column).alias(name) for column, name in columns.items()],
    )
    after = lots.select(*layout.keys, (F.col("lot_seq") - 1).alias("lot_seq"), F.col("ref").alias("next_ref"))
    return lots.join(before, on, "left").join(after, on, "left")


def add_diff_factor(lots: DataFrame) -> DataFrame:
    """Days between a lot and the shippable lot before it, else 0."""
    follows_shippable = ~F.col("is_first") & (F.col("previous_days_left") > 0)
    return lots.withColumn(
        "diff_factor",
        if_else(follows_shippable, F.col("days_left_on_ssl") - F.col("previous_days_left"), F.lit(0)),
    )


def allocate_orders(lots: DataFrame) -> DataFrame:
    """What is left of each lot after the open orders of its item-location.
    Negative where the orders exceed all stock so far."""
    total, qty, days = F.col(ORDERS), F.col("sum_of_inventory_qty"), F.col("days_left_on_ssl")
    remaining = F.col("inv_qty_cum_sum_cal") - total
    remaining_before = F.col("previous_cum_sum_cal") - total
    after_first = if_else(
        F.col("previous_days_left") <= 0, remaining, if_else(remaining_before > 0, qty, remaining)
    )
    shippable = F.when(F.col("is_first"), F.col("inv_qty_cum_sum") - total).otherwise(after_first)
    return lots.withColumn(
        "inv_after_custord", F.when(total == 0, qty).otherwise(if_else(days <= 0, qty, shippable))
    )


def ending_inventory(lots: DataFrame) -> DataFrame:
    left = F.col("inv_after_custord")
    return lots.withColumn("ending_inv_after_custord", if_else(left <= 0, F.lit(0.0), left)).withColumn(
        "ending_inv_after_custord_in_cost", F.col("ending_inv_after_custord") * F.col("unit_cost")
    )
