"""Manufacturing site, transfer flag and share of a site's demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelflife.functions import composite_key, divide, if_else, percent_text
from shelflife.operators.hot_refs import Layout
from shelflife.operators.repeats import repeat_chunks, spread
from shelflife.params import ReportParams


def transfer_attrs(forecast: DataFrame, params: ReportParams) -> DataFrame:
    """Per (mfg_ref, ref) of the forecast: is it the site itself, and how many
    item-locations does the site serve."""
    pairs = forecast.groupBy(*params.snapshot_keys, "mfg_ref", "ref").agg(F.count("*").alias("count"))
    served = pairs.groupBy(*params.snapshot_keys, "mfg_ref").agg(F.count("*").alias("count_of_mfg_ref"))
    return pairs.join(served, [*params.snapshot_keys, "mfg_ref"]).select(
        *params.snapshot_keys,
        "mfg_ref",
        "ref",
        if_else(F.col("mfg_ref") == F.col("ref"), F.lit(1), F.lit(0)).alias("mfg_equal_ref"),
        "count_of_mfg_ref",
    )


def demand_by_pair(forecast: DataFrame, params: ReportParams) -> DataFrame:
    return forecast.groupBy(*params.snapshot_keys, "mfg_ref", "ref").agg(
        F.sum("current_month").alias("sum_of_current_month")
    )


def demand_by_ref(pairs: DataFrame, params: ReportParams) -> DataFrame:
    return pairs.groupBy(*params.ref_keys).agg(F.sum("sum_of_current_month").alias("sum_of_current_month_ref"))


def demand_by_mfg_ref(pairs: DataFrame, params: ReportParams) -> DataFrame:
    return pairs.groupBy(*params.snapshot_keys, "mfg_ref").agg(
        F.sum("sum_of_current_month").alias("sum_of_current_month_mfg_ref")
    )


def item_locations(lots: DataFrame, params: ReportParams) -> DataFrame:
    """The item-locations that have lots. A missing item number is the text
    `NA`, as in the keys."""
    return lots.select(*params.ref_keys, F.coalesce("sku", F.lit("NA")).alias("sku")).distinct()


def join_mfg_location(items: DataFrame, mfg: DataFrame, params: ReportParams) -> DataFrame:
    return items.join(mfg, list(params.ref_keys), "left").withColumn(
        "mfg_ref", composite_key(F.col("mfg_loc"), F.col("sku"))
    )


def site_totals(items: DataFrame, pivot_mfg: DataFrame, params: ReportParams) -> DataFrame:
    """What the site columns need, on the rows of `items`: the item-location's forecast sites (`_sites`), those that also serve
    others (`_shared`) or aren't the item-location itself (`_foreign`), and the current month's demand by item-location and by site.

    Items and forecast pairs go through one shuffle by site and one by item-location. Sums over the two partitionings give
    all levels at once; no level is aggregated and joined back."""
    pairs = pivot_mfg.select(
        *params.ref_keys, F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("mfg_loc"), "mfg_ref", "current_month",
        F.lit(1).alias("_pair"),
    )
    none = {"current_month": F.lit(None).cast("double"), "_pair": F.lit(0)}
    rows = items.select(*params.ref_keys, "sku", "mfg_loc", "mfg_ref").withColumns(none).unionByName(pairs)
    site, ref = W.partitionBy(*params.snapshot_keys, "mfg_ref"), W.partitionBy(*params.ref_keys)
    rows = rows.withColumns(
        {"_served": F.sum("_pair").over(site), "sum_of_current_month_mfg_ref": F.sum("current_month").over(site)}
    )
    is_pair = F.col("_pair") == 1
    rows = rows.withColumns(
        {
            "_sites": F.sum("_pair").over(ref),
            "_shared": F.count(F.when(is_pair & (F.col("_served") > 1), 1)).over(ref),
            "_foreign": F.count(F.when(is_pair & (F.col("mfg_ref") != F.col("ref")), 1)).over(ref),
            "sum_of_current_month_ref": F.sum("current_month").over(ref),
        }
    )
    return rows.where("_pair = 0").drop("_pair", "_served", "current_month")


def transfer_flag(totals: DataFrame) -> DataFrame:
    """`Y` if the item-location's site also serves other item-locations.

    The report matches "is the site itself" and "number served" separately, so
    an item-location with k sites has k * k flags. How many of them are `Y`
    follows from three counts, so no pairs are formed: every row of a shared
    site is `Y` with all k, and one of an unshared site with the foreign ones.
    The flags come as two rows at most, with their number in `times`.
    """
    sites, shared = F.col("_sites"), F.col("_shared")
    yes = shared * sites + (sites - shared) * F.col("_foreign")
    counted = [
        F.struct(F.lit(flag).alias("xfer_to_other_loc"), times.cast("bigint").alias("times"))
        for flag, times in (("Y", yes), ("N", F.when(sites == 0, 1).otherwise(sites * sites - yes)))
    ]
    flags = F.inline(F.filter(F.array(*counted), lambda f: f["times"] > 0))
    kept = [c for c in totals.columns if c not in ("_sites", "_shared", "_foreign")]
    return totals.select(*kept, flags)


def demand_share(totals: DataFrame) -> DataFrame:
    share = divide(F.col("sum_of_current_month_ref"), F.col("sum_of_current_month_mfg_ref"))
    return totals.withColumn("percent_of_overall_demand", percent_text(share))


def site_columns(lots: DataFrame, mfg: DataFrame, pivot_mfg: DataFrame, params: ReportParams) -> DataFrame:
    """The site columns per item-location and item number, as rows with the number of `times` that each repeats a lot. They do
    not depend on the lot, so they are worked out on item-locations and joined to the ledger once."""
    items = join_mfg_location(item_locations(lots, params), mfg, params)
    rows = transfer_flag(demand_share(site_totals(items, pivot_mfg, params)))
    return rows.select(*params.ref_keys, "sku", "mfg_loc", "xfer_to_other_loc", "percent_of_overall_demand", "times")


def join_site_columns(ledger: DataFrame, sites: DataFrame, layout: Layout) -> DataFrame:
    """Attach `site_columns` on the key the ledger is already partitioned by. The lot's own item number is matched by a range,
    not by an equality: with the item number in the join key the whole ledger would be shuffled again. The site rows are cut
    into chunks of repeats before the join, and the ledger's rows are repeated once, after it."""
    names = ("mfg_loc", "xfer_to_other_loc", "percent_of_overall_demand")
    chunks = spread(sites.withColumnRenamed("sku", "_sku"), F.col("times")).drop("times", "_first")
    side = layout.align(chunks)
    side = side.select(*[F.col(c).alias(f"_at_{c}") for c in layout.partition], "_sku", *names, "_length")
    own = F.coalesce(F.col("sku"), F.lit("NA"))
    on = (F.col("_sku") >= own) & (F.col("_sku") <= own)
    for column in layout.partition:
        on = on & (F.col(column) == F.col(f"_at_{column}"))
    # A lot without any site row stays, with what the report shows for none.
    joined = ledger.join(side, on, "left").withColumns(
        {
            "xfer_to_other_loc": F.coalesce("xfer_to_other_loc", F.lit("N")),
            "percent_of_overall_demand": F.coalesce("percent_of_overall_demand", F.lit("0%")),
            "_length": F.coalesce("_length", F.lit(1)),
        }
    )
    return repeat_chunks(joined.select(*ledger.columns, *names, "_length"))
