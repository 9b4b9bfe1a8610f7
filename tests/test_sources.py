from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from inputs import AS_OF, forecast, lot, make_sources, order
from shelflife import job
from shelflife.params import ReportParams, SnapshotRules
from shelflife.plans.reports import report, report_order
from shelflife.sources.readers import Sources, export_cells, load_sources, read_export, read_typed, rejected_cells, write_export, write_report
from shelflife.sources.sample import EXPORT_HEADERS, SNAPSHOT_DATES, as_export, sample_sources
from shelflife.sources.schemas import HEADER_ROW, SCHEMAS
from shelflife.sources.staging import clean_names, promote_header, type_convert
from verification.queries import registry


@pytest.mark.parametrize("row", [2, 3, 7])
def test_promote_header(spark, row):
    preamble = [(i, "text", None) for i in range(row)]
    rows = [*preamble, (row, "B/P", "Item Number"), (row + 1, "1", "a"), (row + 2, "2", None)]
    table = promote_header(spark.createDataFrame(rows, "pos int, c0 string, c1 string"), "pos", row)
    assert table.columns == ["B/P", "Item Number"]
    assert sorted(tuple(r) for r in table.collect()) == [("1", "a"), ("2", None)]


def test_clean_names_numbers_repeats(spark):
    table = spark.createDataFrame([(1, 2, 3)], ["Lot Number", "lot_number", "Lot #"])
    assert clean_names(table).columns == ["lot_number", "lot_number_2", "lot_number_3"]


def test_type_convert_reads_missing_cells(spark):
    rows = [("10", "12-A", "x", "L1", "44000", "44797.75", "NA", " 7 ", "", "1.005")]
    table = spark.createDataFrame(rows, [f.name for f in SCHEMAS["inventory_lots"].fields])
    row = type_convert(table, SCHEMAS["inventory_lots"]).first()
    assert row.expiration_date is None and row.inventory_qty_cases is None
    assert row.calculated_days_left_to_ship == 7 and row.calculated_shippable_date == 44797.75


def _write_export(path, header_row, headers, rows):
    lines = ["Weekly export", ""][: max(header_row, 0)]
    lines += ["note" for _ in range(header_row - len(lines))]
    lines.append(",".join(f'"{h}"' for h in headers))
    lines += [",".join(str(c) for c in r) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def test_read_export_skips_the_preamble(spark, tmp_path):
    path = tmp_path / "orders.csv"
    rows = [("10", "12-3", "44797", "5"), ("10", "45", "44798.5", "NA")]
    _write_export(path, HEADER_ROW["customer_orders"], EXPORT_HEADERS["customer_orders"], rows)
    got = sorted(tuple(r) for r in read_export(spark, "customer_orders", str(path)).collect())
    assert got == [("10", "12-3", 44797.0, 5.0), ("10", "45", 44798.5, None)]


def test_records_may_hold_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "types.csv"
    text = ["note,with comma"] * 7 + ['"Ship Ref","Type","More"', '10-1,"line one\nline two",x', '10-2,"says ""so""",', ",,"]
    path.write_text("\n".join(text) + "\n")
    got = sorted(tuple(r) for r in read_export(spark, "item_type", str(path)).collect() if r[0])
    assert got == [("10-1", "line one\nline two"), ("10-2", 'says "so"')]


@pytest.mark.parametrize("record, message", [("10,12,44797", "does not have 4 cells"), ("10,12,44797,5,6", "does not have 4 cells"), ('10,12,44797,"1,250"', "cannot read as double: 1,250")])
def test_faulty_exports_are_errors(spark, tmp_path, record, message):
    path = tmp_path / "orders.csv"
    _write_export(path, HEADER_ROW["customer_orders"], EXPORT_HEADERS["customer_orders"], [("10", "1", "44797", "5")])
    path.write_text(path.read_text() + record + "\n")
    with pytest.raises(Exception, match=message):
        read_export(spark, "customer_orders", str(path)).collect()


@pytest.mark.parametrize("text, message", [("only one line\n", "has no row 2"), ("a\nb\nLocation,oo cases\n1,2\n", "has no columns")])
def test_exports_without_a_header_are_errors(spark, tmp_path, text, message):
    (tmp_path / "orders.csv").write_text(text)
    with pytest.raises(Exception, match=message):
        read_export(spark, "customer_orders", str(tmp_path / "orders.csv")).collect()


def jobs_of(spark, group, build):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_dated_exports_are_one_scan(spark, tmp_path):
    """Ten dates, one of them in two files with another order of columns; no job runs before the result is asked for."""
    days = [AS_OF + timedelta(weeks=k) for k in range(10)]
    for k, day in enumerate(days):
        folder = tmp_path / f"week {day}"
        folder.mkdir()
        _write_export(folder / "a.csv", 2, EXPORT_HEADERS["customer_orders"], [("10", f"i{k}", "44797", "5")])
    _write_export(tmp_path / f"week {days[3]}" / "b.csv", 2, EXPORT_HEADERS["customer_orders"][::-1], [("7", "44798", "i3", "20")])
    path = f"{tmp_path}/week {{snapshot}}"
    found, jobs = jobs_of(spark, "dated exports", lambda: read_export(spark, "customer_orders", path, days))
    assert jobs == 0 and found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = sorted((r["snapshot_date"], r["location"], r["product_label_sku"], r["oo_cases"]) for r in found.collect())
    assert got == sorted([(day, "10", f"i{k}", 5.0) for k, day in enumerate(days)] + [(days[3], "20", "i3", 7.0)])
    every = read_export(spark, "customer_orders", str(tmp_path / f"week {days[0]}"), days[:2]).collect()
    assert sorted(r["snapshot_date"] for r in every) == days[:2]


def test_unreadable_cells_are_named(spark, tmp_path):
    path = tmp_path / "orders.csv"
    rows = [("10", "1", "44797", "5"), ("10", "2", "soon", "many"), ("10", "NA", "", "NA"), ("10", "4", "44797", "1e3")]
    _write_export(path, 2, EXPORT_HEADERS["customer_orders"], rows)
    found = [tuple(r)[1:] for r in rejected_cells(spark, "customer_orders", str(path)).collect()]
    assert sorted(found) == [(2, "oo_cases", "double", "many"), (2, "sales_order_requested_ship_date", "double", "soon")]
    assert rejected_cells(spark, "customer_orders", str(path)).first()["file"].endswith("orders.csv")
    assert read_export(spark, "customer_orders", str(path), unreadable="null").where("oo_cases IS NULL").count() == 2


def test_exports_are_cut_where_scans_split_them(spark, tmp_path):
    """Splits of a hundred bytes, with records across them; a file's records keep their order and numbers, and none is held whole."""
    texts = [f"{k},\r\n" + "x" * (k % 150) + '\n"said"\r' for k in range(300)]
    for name in ("a", "b"):
        body = [f'{name}{k},"{text.replace(chr(34), chr(34) * 2)}"' for k, text in enumerate(texts)]
        (tmp_path / f"{name}.csv").write_bytes("\n".join(["note"] * 7 + ["Ship Ref,Type", *body]).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        found = export_cells(spark, "item_type", str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["ship_ref"], r["record"], r["type"]) for r in rows) == sorted((f"{n}{k}", k + 1, t) for n in "ab" for k, t in enumerate(texts))
    assert "wholetext" not in plan.lower() and plan.count("FileScan") == 1


def test_written_exports_read_back(spark, tmp_path):
    rows = [("10", 'a "b", c', 'line\none', "L\\1", 44000.5, None, 1.0, -3, 2.5, 0.1), (None, "", "NA", None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows * 3, SCHEMAS["inventory_lots"]).repartition(4)
    write_export(as_export(table, "inventory_lots"), "inventory_lots", str(tmp_path / "lots"))
    none = (None,) * 10
    want = [none if r[0] is None else r for r in rows * 3]
    assert sorted(map(str, (tuple(r) for r in read_export(spark, "inventory_lots", str(tmp_path / "lots")).collect()))) == sorted(map(str, want))


def test_absent_columns_are_errors(spark, tmp_path):
    sample_sources(spark, "/root/testdata/sf0.001").customer_orders.drop("oo_cases").write.parquet(str(tmp_path / "o"))
    with pytest.raises(ValueError, match="oo_cases"):
        read_typed(spark, "customer_orders", str(tmp_path / "o"))


def test_job_reads_dated_exports(spark, tmp_path):
    sources = make_sources(spark, inventory_lots=[lot("1", "L1", 20, 8.0)], customer_orders=[order("1", 3.0)], forecast=forecast("1", 30.0))
    days = [AS_OF, AS_OF + timedelta(weeks=1)]
    argv = ["weekly", "--export", "--out", str(tmp_path / "out"), *[x for d in days for x in ("--snapshot", d.isoformat())]]
    for name in SCHEMAS:
        rows = [tuple(r) for r in as_export(getattr(sources, name), name).collect()]
        for d in days:
            (tmp_path / d.isoformat()).mkdir(exist_ok=True)
            _write_export(tmp_path / d.isoformat() / f"{name}.csv", HEADER_ROW[name], EXPORT_HEADERS[name], rows)
        argv += ["--source", f"{name}={tmp_path}/{{snapshot}}/{name}.csv"]
    job.run(spark, job.arguments(argv))
    written = spark.read.parquet(str(tmp_path / "out"))
    for d in days:
        expected = report(sources, ReportParams.weekly(d)).collect()
        got = written.where(F.col("snapshot_date") == d).drop("snapshot_date").collect()
        assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) == 1


def test_exports_and_parquet_give_the_same_report(spark, tmp_path):
    sources = make_sources(
        spark,
        inventory_lots=[lot("1-2", "L1", 20, 8.0), lot("1-2", "L2", 40, None), lot("7", "L3", 3, 2.0)],
        customer_orders=[order("12", 3.0)],
        item_planner=[("10", "12", "4")],
        planner_directory=[("4", "Dana")],
        item_type=[("10-12", "MTO")],
        forecast=forecast("12", 30.0),
        mfg_locations=[("10", "20", "12")],
    )
    csv_paths, parquet_paths = {}, {}
    for name in SCHEMAS:
        table = getattr(sources, name)
        parquet_paths[name] = str(tmp_path / f"{name}.parquet")
        table.write.parquet(parquet_paths[name])
        csv = tmp_path / f"{name}.csv"
        rows = [tuple(r) for r in as_export(table, name).collect()]
        _write_export(csv, HEADER_ROW[name], EXPORT_HEADERS[name], rows)
        csv_paths[name] = str(csv)
    params = ReportParams.transfer(AS_OF)
    from_csv = report(load_sources(spark, csv_paths, export=True), params).collect()
    from_parquet = report(load_sources(spark, parquet_paths), params).collect()
    assert len(from_csv) == 3
    assert sorted(map(str, from_csv)) == sorted(map(str, from_parquet))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_written_report_is_in_order(spark, tmp_path, fmt):
    lots = [lot(str(i % 7), f"L{i}", 10 + i % 11, float(i)) for i in range(200)]
    params = ReportParams.base(AS_OF)
    wide = report(make_sources(spark, inventory_lots=lots), params)
    write_report(wide, str(tmp_path / "out"), fmt, report_order(params))
    names = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    refs = []
    for name in names:
        back = spark.read.option("header", True).csv(str(name)) if fmt == "csv" else spark.read.parquet(str(name))
        refs += [r[0] for r in back.select("ref").collect()]
    assert len(refs) == 200 and refs == sorted(refs)


def test_job_writes_reports_of_partitioned_snapshots(spark, tmp_path):
    sources = sample_sources(spark, "/root/testdata/sf0.001", snapshots=True)
    argv = ["weekly", "--out", str(tmp_path / "out"), "--snapshot", f"{SNAPSHOT_DATES[1]}:same_ref:ceiling"]
    for name in SCHEMAS:
        path = str(tmp_path / name)
        getattr(sources, name).write.partitionBy("snapshot_date").parquet(path)
        argv += ["--source", f"{name}={path}"]
    job.run(spark, job.arguments(argv))
    rules = SnapshotRules(SNAPSHOT_DATES[1], "same_ref", "ceiling")
    day = F.col("snapshot_date") == rules.snapshot_date
    one = Sources(**{name: getattr(sources, name).where(day) for name in SCHEMAS})
    expected = report(one, ReportParams.weekly(snapshots=(rules,)))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.columns == expected.columns
    assert sorted(map(str, written.collect())) == sorted(map(str, expected.collect()))
    scan = read_typed(spark, "inventory_lots", str(tmp_path / "inventory_lots"), [rules.snapshot_date])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert str(rules.snapshot_date) in plan.split("PartitionFilters")[1]


def test_reports_join_the_tables_once(spark):
    """A report reads its sources many times, the tables they are derived from only when they are stored."""
    for name in ("report_base", "report_backfill"):
        plan = registry()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "sample-rows" in plan and "l_suppkey" not in plan and "n_regionkey" not in plan
