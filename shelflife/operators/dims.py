"""Item, planner and manufacturing-site dimensions and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflife.functions import composite_key, if_else, strip_dashes
from shelflife.params import ReportParams

# What the report shows for an item-location without a planner,
# and the planner number that stands for "none assigned".
NO_PLANNER = "DNRR"
UNASSIGNED = "0"


def planner_directory_dim(directory: DataFrame, params: ReportParams) -> DataFrame:
    return _unique(
        directory.select(
            *params.snapshot_keys,
            F.col("address_number").alias("planner_number"),
            F.col("alpha_name").alias("planner_name"),
        ),
        (*params.snapshot_keys, "planner_number"),
        params,
    )


def item_planner_dim(item_planner: DataFrame, params: ReportParams) -> DataFrame:
    """The item number keeps its dashes here, unlike in the other sources."""
    return _unique(
        item_planner.select(
            *params.snapshot_keys,
            composite_key(F.col("b_p"), F.col("item_number")).alias("ref"),
            F.col("b_p").alias("location"),
            F.col("item_number").alias("sku"),
            F.coalesce("planner", F.lit(UNASSIGNED)).alias("planner_number"),
        ),
        params.ref_keys,
        params,
    )


def item_type_dim(item_type: DataFrame, params: ReportParams) -> DataFrame:
    return _unique(
        item_type.select(
            *params.snapshot_keys,
            F.translate("ship_ref", "-", "_").alias("ref"),
            F.col("type").alias("mbx"),
        ),
        params.ref_keys,
        params,
    )


def mfg_dim(mfg_locations: DataFrame, params: ReportParams) -> DataFrame:
    """Distinct manufacturing sites of each item-location."""
    return (
        mfg_locations.select(
            *params.snapshot_keys,
            composite_key(F.col("location"), strip_dashes(F.col("item"))).alias("ref"),
            F.col("product_manufacturing_location").alias("mfg_loc"),
        )
        .distinct()
    )


def counted(dim: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal rows as one, with their number in `times`. `by` names the columns to shuffle by, if a join on them follows."""
    spread = dim.repartition(*by) if by else dim
    return spread.groupBy(*dim.columns).agg(F.count("*").alias("times"))


def named_planners(planners: DataFrame, directory: DataFrame, params: ReportParams) -> DataFrame:
    """Planner number and name per item-location. The name is looked up on the
    dimension, which is far smaller than the lots and has the same fan-out."""
    joined = planners.join(directory, [*params.snapshot_keys, "planner_number"], "left")
    return joined.select(*params.ref_keys, "planner_number", _shown_name())


def planner_rows(planners: DataFrame, directory: DataFrame, params: ReportParams) -> DataFrame:
    """The item-locations in `planners`, with the number of rows that `named_planners` makes of each row in `times`."""
    number = [*params.snapshot_keys, "planner_number"]
    more = directory.groupBy(*number).agg(F.count("*").alias("times")).where(F.col("times") > 1)
    return planners.join(more, number, "left").select(*params.ref_keys, F.coalesce("times", F.lit(1)).alias("times"))


def counted_planners(planners: DataFrame, directory: DataFrame, params: ReportParams) -> DataFrame:
    """`named_planners` with equal rows as one. Neither side's equal rows are formed on the way."""
    named = counted(directory).withColumnRenamed("times", "_named")
    joined = counted(planners).join(named, [*params.snapshot_keys, "planner_number"], "left")
    times = F.col("times") * F.coalesce("_named", F.lit(1))
    rows = joined.select(*params.ref_keys, "planner_number", _shown_name(), times.alias("times"))
    return rows.groupBy(*params.ref_keys, "planner_number", "planner_name").agg(F.sum("times").alias("times"))


def _shown_name() -> Column:
    number = F.col("planner_number")
    shown = F.when(number == NO_PLANNER, NO_PLANNER).when(number != UNASSIGNED, F.col("planner_name"))
    return shown.alias("planner_name")


def join_planner_number(lots: DataFrame, planners: DataFrame, params: ReportParams) -> DataFrame:
    numbers = planners.select(*params.ref_keys, "planner_number")
    return lots.join(numbers, list(params.ref_keys), "left").withColumn(
        "planner_number", F.coalesce("planner_number", F.lit(NO_PLANNER))
    )


def join_planner(lots: DataFrame, planners: DataFrame, params: ReportParams) -> DataFrame:
    """Attach `named_planners`; lots without one show `NO_PLANNER`."""
    missing = F.col("planner_number").isNull()
    return lots.join(planners, list(params.ref_keys), "left").withColumns(
        {
            "planner_number": F.coalesce("planner_number", F.lit(NO_PLANNER)),
            "planner_name": F.when(missing, NO_PLANNER).otherwise(F.col("planner_name")),
        }
    )


def join_item_type(lots: DataFrame, item_types: DataFrame, params: ReportParams) -> DataFrame:
    return lots.join(item_types, list(params.ref_keys), "left").withColumn(
        "mbx", if_else(F.col("planner_number") == NO_PLANNER, F.lit(NO_PLANNER), F.col("mbx"))
    )


def _unique(dim: DataFrame, keys: tuple[str, ...], params: ReportParams) -> DataFrame:
    """With on_duplicate="error", fail on the first key that occurs twice."""
    if params.on_duplicate == "expand":
        return dim
    values = [c for c in dim.columns if c not in keys]
    message = F.concat(F.lit("duplicate dimension key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    counted = dim.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.first(v).alias(v) for v in values])
    return counted.select(
        *[k for k in keys],
        *[F.when(F.col("_rows") > 1, F.raise_error(message)).otherwise(F.col(v)).alias(v) for v in values],
    )
