"""Stock after open orders and forecast demand.

Within an item-location each lot ends at

    own value                                if the lot starts a chain
    own value + min(0, value of lot before)  otherwise

so a shortage carries to the next lot and a surplus does not. With S the
running sum of own values in a chain, the value of a lot is the least of
S - S_j + own_j over the lots j so far, which is S - max(S_j - own_j): two
window aggregates, however long the chain is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelflife.functions import floor_at_zero, if_else, or_zero
from shelflife.operators.hot_refs import BLOCK, Layout
from shelflife.params import ReportParams

RATE = "fcst_daily_avg_after_15_days"


def join_daily_forecast(lots: DataFrame, daily: DataFrame, layout: Layout) -> DataFrame:
    """Several rows per key on the right (one per manufacturing site) repeat
    the lot; the repeats follow each other in the lot sequence."""
    joined = layout.join(lots, daily.select(*layout.keys, "fcst_daily"))
    rate = F.nanvl(or_zero(F.col("fcst_daily")), F.lit(0.0))
    return joined.withColumn(RATE, rate).drop("fcst_daily")


def consumption_factor(lots: DataFrame, params: ReportParams, rule: str | None = None) -> DataFrame:
    """Forecast demand that falls between a lot and the lot before it. `rule`
    says when a lot expiring together with the one before consumes nothing."""
    days, diff = F.col("days_left_on_ssl"), F.col("diff_factor")
    chosen = F.lit(rule) if rule else params.rule("consumption_rule")
    follows = ~F.col("is_first")
    shares_days = (
        F.when(chosen == "prev_shippable", follows & (F.col("previous_days_left") > 0))
        .when(chosen == "same_ref", follows)
        .when(chosen == "self_shippable", follows & (days > 0))
    )
    own_days = days - params.order_horizon_days
    consumed_days = if_else(diff == 0, if_else(shares_days, F.lit(0), own_days), diff)
    return lots.withColumn(
        "consumption_factor",
        if_else(days <= params.order_horizon_days, F.lit(0.0), consumed_days * F.col(RATE)),
    )


def project_inventory(
    lots: DataFrame, params: ReportParams, layout: Layout, order: Sequence[str] = ("lot_seq", RATE)
) -> DataFrame:
    """`order` must be a total order of the rows within a key; passing the
    order the lots are already sorted in saves a sort."""
    days = F.col("days_left_on_ssl")
    ending = F.col("ending_inv_after_custord")
    # A first lot inside the order horizon consumes nothing, so its own value
    # is the ending inventory in both branches.
    own = (
        F.when(days <= 0, F.col("sum_of_inventory_qty"))
        .when(~F.col("is_first") & (days <= params.order_horizon_days), ending)
        .when(days.isNotNull(), ending - F.col("consumption_factor"))
    )
    starts = F.col("is_first") | F.coalesce(days <= params.order_horizon_days, F.lit(False))
    sequence = layout.window(order)
    lots = _chain_values(lots.withColumn("_own", own), F.col("_own"), F.col("_own"), starts, sequence)
    if layout.split:
        lots = _continue_chains(lots.withColumn("_row", F.row_number().over(sequence)), layout).drop("_row")
    return lots.withColumnRenamed("_value", "inv_after_custord_and_fcst").drop("_own", "_sum", "_chain")


def _chain_values(rows: DataFrame, own: Column, step: Column, starts: Column, sequence: WindowSpec) -> DataFrame:
    """Add `_value` = min over the rows j of the chain so far of (own_j + later
    steps), with the running `_sum` of steps and the `_chain` number.

    Sums before the chain cancel out, and chain numbers grow along the
    sequence, so the running maximum of (chain, offset) is the maximum within
    the current chain. All windows share one partitioning and one sort.
    """
    through = sequence.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns(
        {"_sum": F.sum(step).over(through), "_chain": F.count(F.when(starts, 1)).over(through)}
    )
    offset, chain = F.col("_sum") - own, F.col("_chain")
    rows = rows.withColumns(
        {
            "_best": F.max(F.struct(chain, offset.alias("offset"))).over(through),
            "_unknown_chain": F.max(F.when(own.isNull(), chain)).over(through),
        }
    )
    best = F.col("_best.offset")
    known = F.col("_unknown_chain").isNull() | (F.col("_unknown_chain") < chain)
    # Where the row itself is the minimum, return its own value unchanged.
    value = F.when(offset >= best, own).otherwise(F.col("_sum") - best)
    return rows.withColumn("_value", F.when(known, value)).drop("_best", "_unknown_chain")


def _continue_chains(lots: DataFrame, layout: Layout) -> DataFrame:
    """Carry the last value of a block into the chain the next block continues.

    Entering a block with value v, a row of its first, still open chain ends at
    min(_value, _sum + v). The blocks of a key form chains of the same kind,
    with one row per block.
    """
    last = (
        lots.groupBy(*layout.partition)
        .agg(F.max_by(F.struct("_value", "_sum", "_chain"), "_row").alias("last"))
        .select(
            *layout.partition,
            F.col("last._value").alias("_own"),
            F.when(F.col("last._chain") == 0, F.col("last._sum")).otherwise(F.col("last._value")).alias("_step"),
            (F.col("last._chain") > 0).alias("_starts"),
        )
    )
    by_block = W.partitionBy(*layout.keys).orderBy(BLOCK)
    ended = _chain_values(last, F.col("_own"), F.col("_step"), F.col("_starts"), by_block)
    entering = ended.select(*layout.partition, F.lag("_value").over(by_block).alias("_entering"))
    lots = lots.join(entering, list(layout.partition), "left")
    continued = F.when(
        F.col("_value").isNotNull() & F.col("_entering").isNotNull(),
        F.least(F.col("_value"), F.col("_sum") + F.col("_entering")),
    )
    return lots.withColumn(
        "_value", F.when(F.col("_chain") == 0, continued).otherwise(F.col("_value"))
    ).drop("_entering")


def projection_value(lots: DataFrame) -> DataFrame:
    return lots.withColumn(
        "ending_inv_after_custord_and_fcst", floor_at_zero(F.col("inv_after_custord_and_fcst"))
    ).withColumn(
        "ending_inv_after_custord_and_fcst_in_cost",
        F.col("ending_inv_after_custord_and_fcst") * F.col("unit_cost"),
    )
