"""Rows that stand for several equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most elements of an array that repeats a row.
STEP = 1024
#: Largest number that one join with the table of numbers counts up to.
NUMBERS = 128


def spread(df: DataFrame, times: Column, chunk: int = STEP) -> DataFrame:
    """`_first` and `_length` per row of df: rows of at most `chunk` repeats that cover 1 to `times`. Arrays have
    STEP elements at most up to STEP * STEP chunks."""
    chunks = F.ceil(times / chunk).cast("bigint")
    outer = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((chunks - 1) / STEP).cast("bigint")))
    df = df.withColumn("_times", times.cast("bigint")).where("_times > 0").withColumn("_outer", outer)
    last = F.least(F.ceil(F.col("_times") / chunk).cast("bigint") - F.col("_outer") * STEP, F.lit(STEP).cast("bigint"))
    df = df.withColumn("_inner", F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)))
    first = (F.col("_outer") * STEP + F.col("_inner")) * chunk
    return df.withColumns({"_first": first + 1, "_length": F.least(F.col("_times") - first, F.lit(chunk).cast("bigint"))}).drop(
        "_outer", "_inner", "_times"
    )


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column `times` says, without that column. No array is longer than STEP up to STEP ** 3 repeats."""
    return repeat_chunks(spread(df, F.col(times)).drop(times, "_first"))


def repeat_chunks(pieces: DataFrame) -> DataFrame:
    """The repeats of `spread`, each row as often as its `_length` says."""
    one = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_length")))
    return pieces.withColumn("_one", one).drop("_one", "_length")


def copies(df: DataFrame, times: str, most: int) -> DataFrame:
    """`repeat_rows` for rows in an order; `times` is 1 to `most`.

    The rows are multiplied by joins with a broadcast table of numbers (`NUMBERS` * (`NUMBERS` + 1) / 2 rows at most, whatever
    `most` is), which unlike `explode` keeps the order that Spark knows the rows to have: windows over that order don't sort again."""
    step, sizes = max(2, min(most, NUMBERS)), [1]
    while sizes[-1] * step < most:
        sizes.append(sizes[-1] * step)
    df = df.withColumnRenamed(times, "_left")
    for size in reversed(sizes):
        df = df.withColumn("_pieces", F.ceil(F.col("_left") / size)).join(_numbers(df.sparkSession, step), "_pieces")
        df = df.withColumn("_left", F.least(F.col("_left") - F.col("_piece") * size, F.lit(size).cast("bigint"))).drop("_pieces", "_piece")
    return df.drop("_left")


def _numbers(spark: SparkSession, step: int) -> DataFrame:
    pieces = spark.range(1, step + 1).withColumnRenamed("id", "_pieces")
    return F.broadcast(pieces.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1))))
