"""Write one report, or all reports of several snapshots, with spark-submit.

    spark-submit shelflife/job.py transfer --as-of 2022-12-07 --out /reports/risk \\
        --source inventory_lots=/data/lots --source customer_orders=/data/orders ...

    Exports of several dates have the date in their path:
    spark-submit shelflife/job.py weekly --export --source "inventory_lots=/data/{snapshot}/lots.csv" ...

    spark-submit shelflife/job.py weekly --out /reports/backfill \\
        --snapshot 2022-11-02:self_shippable:half_even --snapshot 2022-11-09 ...
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from shelflife.params import ReportParams, SnapshotRules
from shelflife.plans.reports import report, report_order
from shelflife.sources.readers import load_sources, write_report
from shelflife.sources.runs import write_snapshots

PROFILES = {"base": ReportParams, "weekly": ReportParams.weekly, "transfer": ReportParams.transfer}


def snapshot(text: str) -> SnapshotRules:
    """`date[:consumption_rule[:rate_rounding]]`"""
    day, *rules = text.split(":")
    return SnapshotRules(date.fromisoformat(day), *rules)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("profile", choices=PROFILES)
    when = parser.add_mutually_exclusive_group(required=True)
    when.add_argument("--as-of", type=date.fromisoformat)
    when.add_argument("--snapshot", type=snapshot, action="append", default=[])
    parser.add_argument("--source", action="append", required=True, metavar="NAME=PATH")
    parser.add_argument("--export", action="store_true", help="sources are CSV exports with a preamble")
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--by-snapshot", action="store_true", help="keep the other snapshots at --out; read them with sources.runs")
    args = parser.parse_args(argv)
    if args.by_snapshot and args.format != "parquet":
        parser.error("--by-snapshot writes Parquet")
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    params = PROFILES[args.profile](as_of=args.as_of, snapshots=tuple(args.snapshot))
    paths = dict(source.split("=", 1) for source in args.source)
    days = [rules.snapshot_date for rules in args.snapshot]
    sources = load_sources(spark, paths, args.export, days)
    if args.by_snapshot:
        write_snapshots(report(sources, params), args.out, days or [args.as_of], report_order(params))
    else:
        write_report(report(sources, params), args.out, args.format, report_order(params))


if __name__ == "__main__":
    run(SparkSession.builder.appName("shelflife-report").getOrCreate(), arguments())
