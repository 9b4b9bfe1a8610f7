"""Site columns of the transfer report with many sites, and how often the forecast is read."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inputs import AS_OF, forecast, lot, make_sources
from shelflife.operators import demand, dims, supply, transfer
from shelflife.operators.repeats import STEP, repeat_rows, spread
from shelflife.params import ReportParams
from shelflife.plans.reports import report
from shelflife.sources.readers import Sources
from shelflife.sources.sample import AS_OF as SAMPLE_DAY
from shelflife.sources.sample import sample_sources
from shelflife.sources.schemas import SCHEMAS

SF = "/root/testdata/sf0.001"
TRANSFER = ReportParams.transfer(AS_OF)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_repeat_in_bounded_arrays(spark):
    times = [1, 2, STEP - 1, STEP, STEP + 1, 3 * STEP + 7, 2 * STEP * STEP + 5]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "times long, i long")
    assert Counter({r["i"]: r["count"] for r in repeat_rows(df, "times").groupBy("i").count().collect()}) == Counter(dict(enumerate(times)))
    assert repeat_rows(df, "times").columns == ["i"]
    pieces = spread(df, F.col("times"), 10).groupBy("times").agg(F.sum("_length").alias("n"), F.max("_length").alias("most"), F.min("_first").alias("first"), F.max(F.col("_first") + F.col("_length") - 1).alias("end"))
    assert all((r["n"], r["first"], r["end"]) == (r["times"], 1, r["times"]) and r["most"] <= 10 for r in pieces.collect())


def many_sites(spark, k, places):
    sites = [f"s{n:03}" for n in range(k - 1)] + ["10"]
    return make_sources(
        spark,
        inventory_lots=[lot("1", "L1", 20, 10.0), lot("9", "L2", 40, 4.0)],
        forecast=[row for s in sites for row in forecast("1", 58.0, site=s)] + forecast("1", 10.0, location="30", site="s000"),
        mfg_locations=[("10", p, "1") for p in places],
    )


def test_two_hundred_sites(spark):
    """200 forecast sites, one of which serves another location and one is the location itself: 200 * 200 flags for each
    site row, as two rows until the end."""
    k = 200
    sources = many_sites(spark, k, ["s000", "10"])
    lots = supply.normalize_lots(sources.inventory_lots, TRANSFER)
    pivot = demand.forecast_pivot_mfg(sources.forecast, TRANSFER)
    sites = transfer.site_columns(lots, dims.mfg_dim(sources.mfg_locations, TRANSFER), pivot, TRANSFER)
    found = {(r["sku"], r["mfg_loc"], r["xfer_to_other_loc"]): (r["times"], r["percent_of_overall_demand"]) for r in sites.collect()}
    yes = 1 * k + (k - 1) * (k - 1)
    assert found == {
        ("1", "s000", "Y"): (yes, "17059%"), ("1", "s000", "N"): (k * k - yes, "17059%"),
        ("1", "10", "Y"): (yes, "20000%"), ("1", "10", "N"): (k * k - yes, "20000%"), ("9", None, "N"): (1, "0%"),
    }
    # One lot, 200 rates, two site rows and 40 000 flags.
    assert report(sources, TRANSFER).count() == k * 2 * k * k + 1


def test_no_rows_are_gathered_for_sites(spark):
    plan = plan_of(report(sample_sources(spark, SF), ReportParams.transfer(SAMPLE_DAY)))
    assert "collect_list" not in plan and "array_repeat" not in plan
    # All levels of demand: one shuffle by site and one by item-location.
    items = transfer.join_mfg_location(
        transfer.item_locations(supply.normalize_lots(sample_sources(spark, SF).inventory_lots, TRANSFER), TRANSFER),
        dims.mfg_dim(sample_sources(spark, SF).mfg_locations, TRANSFER), TRANSFER,
    ).checkpoint()
    pivot = demand.forecast_pivot_mfg(sample_sources(spark, SF).forecast, ReportParams.transfer(SAMPLE_DAY)).checkpoint()
    totals = plan_of(transfer.site_totals(items, pivot, TRANSFER))
    assert totals.count("Exchange hashpartitioning") == 2 and "Join" not in totals


@pytest.mark.parametrize("make", [ReportParams.transfer, ReportParams.base])
def test_forecast_is_read_at_most_twice(spark, tmp_path, make):
    sources, kept = sample_sources(spark, SF), {}
    for name in SCHEMAS:
        getattr(sources, name).write.parquet(str(tmp_path / name))
        kept[name] = spark.read.schema(SCHEMAS[name]).parquet(str(tmp_path / name))
    params = make(SAMPLE_DAY)
    sources = Sources(**kept)

    def reads(df):
        return sum("FileScan" in line and "forecast_month_year_code" in line for line in plan_of(df).splitlines())

    # Once for its months and once for its cells; the transfer report has stored the cells before.
    pivot = demand.forecast_pivot_mfg if make == ReportParams.transfer else demand.forecast_pivot
    own = reads(report(sources, params))
    assert (own, reads(pivot(sources.forecast, params))) == ((0, 2) if make == ReportParams.transfer else (2, 2))
