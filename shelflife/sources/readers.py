"""Readers for the seven report inputs and the report writer."""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, fields
from datetime import date
from itertools import groupby, islice
from operator import itemgetter
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflife.params import SNAPSHOT
from shelflife.sources.schemas import HEADER_ROW, SCHEMAS
from shelflife.sources.shared import can_store, dropped, freed, new_table, stored
from shelflife.sources.staging import snake_names, type_convert, unreadable_cells

#: Records of an export that are passed on together.
RECORDS = 20_000


@dataclass(frozen=True)
class Sources:
    inventory_lots: DataFrame
    customer_orders: DataFrame
    planner_directory: DataFrame
    item_planner: DataFrame
    item_type: DataFrame
    forecast: DataFrame
    mfg_locations: DataFrame | None = None


def read_typed(spark: SparkSession, name: str, path: str, snapshots: Sequence[date] = ()) -> DataFrame:
    """A source kept as Parquet with the declared column names and types. With
    `snapshots` it also holds a `snapshot_date` (as a column or as partition
    folders) and only those dates are read. A declared column that the files
    lack is an error; read as NULL it would count as zero."""
    schema = SCHEMAS[name]
    missing = sorted(set(schema.names) - set(spark.read.parquet(path).columns))
    if missing:
        raise ValueError(f"{name} at {path} has no columns {missing}")
    if not snapshots:
        return spark.read.schema(schema).parquet(path)
    dated = T.StructType([*schema.fields, T.StructField(SNAPSHOT, T.DateType())])
    return spark.read.schema(dated).parquet(path).where(F.col(SNAPSHOT).isin(list(snapshots)))


def read_export(
    spark: SparkSession, name: str, path: str | Sequence[str], snapshots: Sequence[date] = (), unreadable: str = "error"
) -> DataFrame:
    """A source kept as CSV exports of one sheet, each file with its own preamble and header.

    All files are read in one scan, in parallel; then the lines of a file go through one task in their order, and no task holds a file. An
    order of columns of its own is no matter. A cell may hold line breaks.
    With `snapshots`, `{snapshot}` in the path stands for the date and becomes the column `snapshot_date`; a path without it holds for
    every date. A file without the header or a declared column, and a record with another number of cells than its
    header, are errors; so is a cell that can't be read as its type, unless `unreadable` is "null".
    """
    cells = export_cells(spark, name, path, snapshots)
    dated = [SNAPSHOT] if snapshots else []
    return type_convert(cells, SCHEMAS[name], unreadable, dated)


def rejected_cells(spark: SparkSession, name: str, path: str | Sequence[str], snapshots: Sequence[date] = ()) -> DataFrame:
    """The cells of exports that can't be read as their type: snapshot date if dated, file, record, column, type and cell."""
    cells = export_cells(spark, name, path, snapshots)
    return unreadable_cells(cells, SCHEMAS[name], [*([SNAPSHOT] if snapshots else []), "file", "record"])


def export_cells(spark: SparkSession, name: str, path: str | Sequence[str], snapshots: Sequence[date] = ()) -> DataFrame:
    """The declared columns of exports as text, with the `file` and the number of the `record` in it (from 1 on after
    the header), and the snapshot date if dated."""
    paths = [path] if isinstance(path, str) else list(path)
    days = [day.isoformat() for day in snapshots]
    dated = bool(days) and any("{snapshot}" in p for p in paths)
    files = [p.replace("{snapshot}", day) for p in paths for day in (days if dated else [""])]
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(list(dict.fromkeys(files)), lineSep="\n").select("value", *place, F.monotonically_increasing_id().alias("line"))
    # A split's lines are numbered in one task; sorting spills to disk where a file is large.
    lines = lines.repartition("file").sortWithinPartitions("file", "start", "line").select("value", "file")
    columns, header_row = SCHEMAS[name].names, HEADER_ROW[name]
    schema = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("record", T.LongType()), *[T.StructField(c, T.StringType()) for c in columns]]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()))
        for file, own in groupby(rows, key=itemgetter(0)):
            yield from _records(_with_breaks(line for _, line in own), unquote(file), columns, header_row)

    cells = lines.mapInArrow(cut, schema)
    if not days:
        return cells
    if not dated:
        return cells.withColumn(SNAPSHOT, F.explode(F.array(*[F.lit(day).cast("date") for day in days])))
    places = [re.escape(p.split("://")[-1]).replace(re.escape("{snapshot}"), "(" + "|".join(days) + ")", 1) for p in paths]
    found = F.coalesce(*[F.nullif(F.regexp_extract("file", place.replace(re.escape("{snapshot}"), ".{10}"), 1), F.lit("")) for place in places])
    return cells.withColumn(SNAPSHOT, found.cast("date"))


def _with_breaks(lines: Iterator[str]) -> Iterator[str]:
    """Lines that were cut at line feeds, cut at carriage returns, too, and ending as in their file; the last one has no line feed."""
    last = next(lines).removeprefix("\ufeff")
    for line in lines:
        yield from io.StringIO(f"{last}\n", newline="") if "\r" in last else (f"{last}\n",)
        last = line
    yield from io.StringIO(last, newline="")


def _records(lines: Iterator[str], file: str, columns: Sequence[str], header_row: int) -> Iterator[pa.RecordBatch]:
    """The records of one export after its header, some thousand at a time."""
    csv.field_size_limit(sys.maxsize)
    records = csv.reader(lines)
    header = next((r for k, r in enumerate(records) if k == header_row), None)
    if header is None:
        raise ValueError(f"{file} has no row {header_row} to take the column names from")
    names = snake_names(header)
    missing = sorted(set(columns) - set(names))
    if missing:
        raise ValueError(f"{file} has no columns {missing}")
    places, number = [names.index(c) for c in columns], 0
    # A record without cells is an empty line.
    filled = (r for r in records if r)
    while part := list(islice(filled, RECORDS)):
        for k, record in enumerate(part, number + 1):
            if len(record) != len(header):
                raise ValueError(f"record {k} of {file} does not have {len(header)} cells: {record}")
        arrays = [pa.array([file] * len(part)), pa.array(range(number + 1, number + len(part) + 1), pa.int64())]
        arrays += [pa.array([r[i] for r in part], pa.string()) for i in places]
        number += len(part)
        yield pa.RecordBatch.from_arrays(arrays, ["file", "record", *columns])


def load_sources(
    spark: SparkSession, paths: Mapping[str, str], export: bool = False, snapshots: Sequence[date] = ()
) -> Sources:
    """Read every source named in `paths` (a sheet of a workbook is one path)."""

    def read(name: str) -> DataFrame:
        return (read_export if export else read_typed)(spark, name, paths[name], snapshots)

    return Sources(**{f.name: read(f.name) for f in fields(Sources) if f.name in paths})


def write_export(table: DataFrame, name: str, path: str) -> None:
    """A source as CSV exports, one per partition, each with a preamble and the header as read_export expects them."""
    header = [f"{name.replace('_', ' ')} export", *[""] * HEADER_ROW[name]][: HEADER_ROW[name]]
    titles = io.StringIO()
    csv.writer(titles, lineterminator="").writerow(table.columns)
    first = [*header, titles.getvalue()]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(first)], ["value"])
        yield from batches

    cells = F.struct(*[F.col(f"`{c}`").cast("string") for c in table.columns])
    records = table.select(F.to_csv(cells, {"escape": '"', "quoteAll": "true"}).alias("value"))
    records.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_report(
    report: DataFrame, path: str, fmt: str = "parquet", order: Sequence[str | Column] | None = None, parts: Sequence[str] = ()
) -> None:
    """Write a report, range-partitioned and sorted so that the files read in
    sequence are in report order; no task sees more than its own range. Columns
    in `parts`, the first of the order, become folders.

    The rows are stored first, if there is a shared folder: the ranges come from a sample of them, and to draw it Spark would work
    the whole report out a second time. That table goes once the report stands, or has failed."""
    spark, keys = report.sparkSession, order or report.columns[:1]
    unordered = new_table(spark, "unordered") if can_store(spark) else None
    try:
        rows = stored(report, "unordered", unordered) if unordered else report
        ordered = rows.orderBy(*[(F.col(f"`{k}`") if isinstance(k, str) else k).asc_nulls_last() for k in keys])
        writer = ordered.write.mode("overwrite")
        if parts:
            writer = writer.partitionBy(*parts)
        with freed(spark):
            if fmt == "csv":
                writer.option("header", True).csv(path)
            else:
                writer.format(fmt).save(path)
    finally:
        if unordered:
            dropped(spark, unordered)
