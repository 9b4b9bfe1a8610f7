"""Time the headline queries over stored sources and print one JSON line.

The seven sources are derived from the test tables and written once, which is reported
apart. `report_base_hot` is the base report with the largest item-locations split.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from shelflife.params import ReportParams
from shelflife.plans.reports import report
from shelflife.sources.readers import Sources
from shelflife.sources.sample import AS_OF, sample_sources
from verification.queries import on_snapshots, on_sources

HEADLINE = (
    "report_base",
    "report_weekly",
    "report_transfer",
    "report_backfill",
    "report_backfill_transfer",
    "report_base_hot",
    "project_inventory",
    "ending_inventory",
    "supply_by_lot",
    "orders_by_ref",
    "daily_forecast_base",
    "daily_forecast_transfer",
    "transfer_flag",
    "demand_share",
)
#: Splits the few item-locations of the test tables that have more lots.
HOT_LOTS = 18


def stored(spark: SparkSession, sources: Sources, folder: str) -> Sources:
    tables = {}
    for f in fields(Sources):
        table = getattr(sources, f.name)
        table.write.parquet(f"{folder}/{f.name}")
        tables[f.name] = spark.read.schema(table.schema).parquet(f"{folder}/{f.name}")
    return Sources(**tables)


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="shelflife-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelflife-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    day = stored(spark, sample_sources(spark, sf_dir), f"{folder}/day")
    weeks = stored(spark, sample_sources(spark, sf_dir, snapshots=True), f"{folder}/weeks")
    derived = round(time.perf_counter() - started, 3)
    hot = ReportParams.base(AS_OF, lots_per_task=HOT_LOTS)
    runs = {name: (build, day) for name, build in on_sources().items()}
    runs |= {name: (build, weeks) for name, build in on_snapshots().items()}
    runs["report_base_hot"] = (lambda s: report(s, hot), day)
    # Start the session's code paths once, outside the measurement.
    consume(runs["report_base"][0](day))
    seconds = {}
    for name in HEADLINE:
        build, sources = runs[name]
        started = time.perf_counter()
        consume(build(sources))
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "sources_derived_seconds": derived,
            }
        )
    )


if __name__ == "__main__":
    main()
