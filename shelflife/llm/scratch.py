"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one, as
    in tests, gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelflife-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, compression: str | None = None, freed: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a
    lost executor costs no recomputation of what led to it. `freed`: shuffle files of the write
    go when the table stands and not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    if freed:
        spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if freed:
            spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default, which is meant for short rows: a
    thousand texts are some megabytes. A session that has its own setting keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def boxed(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns `used` and all others in one struct `_box`, so that no
    column an operator adds can clash with them; null without others."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(None).cast("int")).alias("_box"))


def unboxed(df: DataFrame, columns: list[str], used: tuple[str, ...], *more: str) -> DataFrame:
    """The columns of the table that was boxed, in its order, and `more`."""
    return df.select(*[F.col(c) if c in used else F.col(f"_box.`{c}`") for c in columns], *more)
