"""Output that is replaced snapshot by snapshot."""

import os
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from inputs import AS_OF, forecast, kept_since, lot, make_sources, shuffle_files
from shelflife import job
from shelflife.params import ReportParams
from shelflife.plans.reports import report, report_order
from shelflife.sources.readers import write_report
from shelflife.sources.runs import last_runs, read_snapshots, replaced_runs, write_snapshots
from shelflife.sources.shared import shared_folder

FIRST, SECOND, THIRD = date(2022, 11, 2), date(2022, 11, 9), date(2022, 11, 16)


def table(spark, *rows):
    return spark.createDataFrame(rows, "snapshot_date date, ref string, qty double")


def held(spark, path, *days):
    return sorted((str(r.snapshot_date), r.ref, r.qty) for r in read_snapshots(spark, path, days).collect())


def test_a_second_run_replaces_its_snapshots_only(spark, tmp_path):
    path = str(tmp_path)
    old = write_snapshots(table(spark, (FIRST, "a", 1.0), (SECOND, "b", 2.0)), path, [FIRST, SECOND], ["ref"])
    new = write_snapshots(table(spark, (SECOND, "c", 3.0), (THIRD, "d", 4.0)), path, [SECOND, THIRD], ["ref"])
    assert held(spark, path) == [(str(FIRST), "a", 1.0), (str(SECOND), "c", 3.0), (str(THIRD), "d", 4.0)]
    assert held(spark, path, SECOND) == [(str(SECOND), "c", 3.0)]
    assert {r.snapshot_date: r.run for r in last_runs(spark, path).collect()} == {FIRST: old, SECOND: new, THIRD: new}
    assert replaced_runs(spark, path).count() == 0
    write_snapshots(table(spark, (FIRST, "e", 5.0)), path, [FIRST])
    assert [r.run for r in replaced_runs(spark, path).collect()] == [old]


def test_a_snapshot_is_replaced_by_no_rows(spark, tmp_path):
    path = str(tmp_path)
    write_snapshots(table(spark, (FIRST, "a", 1.0), (SECOND, "b", 2.0)), path, [FIRST, SECOND])
    write_snapshots(table(spark), path, [SECOND])
    assert held(spark, path) == [(str(FIRST), "a", 1.0)]
    # Rows of days that the run doesn't name aren't taken.
    write_snapshots(table(spark, (FIRST, "x", 9.0), (SECOND, "c", 3.0), (THIRD, "x", 9.0)), path, [SECOND])
    assert held(spark, path) == [(str(FIRST), "a", 1.0), (str(SECOND), "c", 3.0)]


def test_an_output_that_starts_without_rows(spark, tmp_path):
    path = str(tmp_path)
    write_snapshots(table(spark), path, [FIRST])
    assert read_snapshots(spark, path).count() == 0


def test_a_killed_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    write_snapshots(table(spark, (FIRST, "a", 1.0)), path, [FIRST])
    # Killed after its rows, before the manifest.
    write_report(table(spark, (FIRST, "half", 0.0)), f"{path}/runs/run=run-killed", order=["snapshot_date"], parts=["snapshot_date"])
    assert held(spark, path) == [(str(FIRST), "a", 1.0)]
    # Killed while a task still writes.
    failing = table(spark, (FIRST, "b", 2.0), (SECOND, "c", 0.0)).withColumn("qty", F.expr("IF(qty = 0, CAST(raise_error('lost') AS double), qty)"))
    with pytest.raises(Exception, match="lost"):
        write_snapshots(failing, path, [FIRST, SECOND])
    assert held(spark, path) == [(str(FIRST), "a", 1.0)]


def test_days_must_be_named(spark, tmp_path):
    with pytest.raises(ValueError):
        write_snapshots(table(spark), str(tmp_path), [])
    with pytest.raises(ValueError):
        write_snapshots(table(spark).drop("snapshot_date"), str(tmp_path), [FIRST, SECOND])


def test_files_of_a_snapshot_are_in_order(spark, tmp_path):
    path = str(tmp_path)
    rows = [(day, f"{(k * 37) % 101:03}", float(k)) for k in range(101) for day in (FIRST, SECOND)]
    write_snapshots(table(spark, *rows).repartition(3), path, [FIRST, SECOND], ["ref"])
    files = sorted((tmp_path / "runs").rglob("*.parquet"))
    refs = [r.ref for f in files if str(SECOND) in str(f) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert refs == sorted(refs) and len(refs) == 101


def test_a_report_of_one_day_and_the_job(spark, tmp_path):
    sources = make_sources(
        spark, inventory_lots=[lot(s, n, 20, 5.0) for s in ("5", "05") for n in ("b", "a")], forecast=forecast("5", 30.0)
    )
    params = ReportParams.base(AS_OF)
    write_snapshots(report(sources, params), str(tmp_path / "out"), [AS_OF], report_order(params))
    read = read_snapshots(spark, str(tmp_path / "out"))
    plain = report(sources, params)
    assert read.columns == ["snapshot_date", *plain.columns] and read.drop("snapshot_date").exceptAll(plain).count() == 0
    assert read.count() == 4

    paths = {}
    for name in ("inventory_lots", "customer_orders", "planner_directory", "item_planner", "item_type", "forecast"):
        paths[name] = str(tmp_path / name)
        getattr(sources, name).write.parquet(paths[name])
    given = [f"--source={name}={place}" for name, place in paths.items()]
    argv = ["base", "--as-of", AS_OF.isoformat(), "--out", str(tmp_path / "job"), "--by-snapshot", *given]
    for _ in range(2):
        job.run(spark, job.arguments(argv))
    assert read_snapshots(spark, str(tmp_path / "job")).count() == 4
    with pytest.raises(SystemExit):
        job.arguments([*argv, "--format", "csv"])


def test_a_report_is_worked_out_once_to_be_ordered(spark, tmp_path):
    """Its ranges are drawn from stored rows; a sample of the plan itself would run the plan again."""
    runs = tmp_path / "runs"
    runs.mkdir()

    def noted(batches):
        (runs / uuid.uuid4().hex).touch()
        yield from batches

    rows = spark.range(0, 4000, 1, 3).mapInArrow(noted, "id long")
    write_report(rows, str(tmp_path / "out"), order=[-F.col("id")])
    assert len(list(runs.iterdir())) == 3
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.sum("id")).first() == (4000, 7998000)


def test_a_written_report_leaves_nothing_but_itself(spark, tmp_path):
    """Neither the table that it was stored in before its order, nor shuffle files; so does one that fails."""

    def unordered():
        return [name for name in os.listdir(shared_folder(spark).removeprefix("file:")) if name.startswith("unordered-")]

    had, before = unordered(), shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 50).alias("id")).count()
    write_report(rows, str(tmp_path / "out"), order=["id"])
    assert unordered() == had
    assert not kept_since(spark, before)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(50))
    failing = rows.withColumn("more", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="no"):
        write_report(failing, str(tmp_path / "other"), order=["id"])
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND"):
        write_report(rows, str(tmp_path / "other"), fmt="nosuchformat", order=["id"])
    assert unordered() == had
