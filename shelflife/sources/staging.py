"""From an untyped export to a typed source table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("", "NA")  # fixed values: cell texts that mean "no value"


def promote_header(df: DataFrame, position: str, header_row: int) -> DataFrame:
    """Name the columns after the row at `header_row` and keep the rows below.

    `position` is an explicit row number; only the one header row is fetched.
    """
    cells = [c for c in df.columns if c != position]
    header = df.where(F.col(position) == header_row).select(*cells).first()
    if header is None:
        raise ValueError(f"no row at position {header_row}")
    names = [text if text is not None else "NA" for text in header]
    return df.where(F.col(position) > header_row).select(*cells).toDF(*names)


def snake_case(name: str) -> str:
    """`B/P` -> `b_p`, `Inventory Qty (Cases)` -> `inventory_qty_cases`."""
    text = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def snake_names(columns: list[str]) -> list[str]:
    """Snake-case names; a repeated name gets the suffix _2, _3, …"""
    seen: dict[str, int] = {}
    names = []
    for column in columns:
        name = snake_case(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns))


UNREADABLE = ("null", "error")


def parse_cell(text: Column, kind: T.DataType, name: str = "", unreadable: str = "null") -> Column:
    """One trimmed text cell as `kind`. Unreadable text is no missing value: it
    becomes NULL only if asked for, else it ends the job with its text."""
    cell = F.trim(text)
    value = F.when(~cell.isin(*MISSING), cell)
    if isinstance(kind, T.StringType):
        return value
    typed = value.try_cast("double").try_cast("int") if isinstance(kind, T.IntegerType) else value.try_cast(kind)
    if unreadable == "null":
        return typed
    message = F.concat(F.lit(f"column {name}: cannot read as {kind.simpleString()}: "), value)
    return F.when(value.isNotNull() & typed.isNull(), F.raise_error(message)).otherwise(typed)


def type_convert(df: DataFrame, schema: T.StructType, unreadable: str = "null", keep: Sequence[str] = ()) -> DataFrame:
    """Select the declared columns from a text table and give them their type.
    Columns that are neither declared nor in `keep` are dropped, so scans stay narrow."""
    if unreadable not in UNREADABLE:
        raise ValueError(f"{unreadable!r} is not one of {UNREADABLE}")
    return df.select(
        *[parse_cell(F.col(f.name), f.dataType, f.name, unreadable).alias(f.name) for f in schema.fields], *keep
    )


def unreadable_cells(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell that type_convert can't read: the columns in `keep`, the cell's `column`, declared `type` and `cell` text."""
    faults = []
    for field in schema.fields:
        cell = F.trim(F.col(field.name))
        wrong = cell.isNotNull() & ~cell.isin(*MISSING) & parse_cell(F.col(field.name), field.dataType).isNull()
        fault = F.struct(F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("type"), cell.alias("cell"))
        faults.append(F.when(wrong, fault))
    return df.select(*keep, F.inline(F.filter(F.array(*faults), lambda fault: fault.isNotNull())))
