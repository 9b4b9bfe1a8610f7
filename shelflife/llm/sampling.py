"""Bounded samples of labelled rows to train small models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflife.llm.scratch import written

#: Texts up to so many characters are taken first; longer ones where these are too few.
MOST_CHARS = 8_000


def text_hash() -> Column:
    """What a sample chooses by: equal rows are one example."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def sample_each(texts: DataFrame, each: int) -> DataFrame:
    """About `each` distinct rows (label, hash, chars) of every label, at most 1.2 times as many; without null labels.

    Texts of up to MOST_CHARS characters go first, chosen by hash, then those up to twice as long and so on, until
    there are `each` of them or each * MOST_CHARS characters. A label's shortest text is always taken, so no label
    that has a text is without an example."""
    keys = texts.where("label IS NOT NULL AND hash IS NOT NULL").groupBy("label", "hash").agg(F.max("chars").alias("chars"))
    keys = written(keys, "sample-keys").withColumn(
        "class", F.greatest(F.ceil(F.log2(F.greatest("chars", F.lit(1)) / F.lit(MOST_CHARS))), F.lit(0).cast("long"))
    )
    sizes = keys.groupBy("label", "class").agg(F.count("*").alias("n"), F.sum("chars").alias("all"))
    before = Window.partitionBy("label").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    rows = each - F.coalesce(F.sum("n").over(before), F.lit(0))
    chars = each * MOST_CHARS - F.coalesce(F.sum("all").over(before), F.lit(0))
    share = F.when(F.col("class") == 0, rows / F.col("n")).otherwise(F.least(rows / F.col("n"), chars / F.col("all")))
    shortest = keys.groupBy("label").agg(F.min(F.struct("chars", "hash"))["hash"].alias("shortest"))
    drawn = keys.join(sizes.select("label", "class", share.alias("share")), ["label", "class"]).join(shortest, "label")
    drawn = drawn.where((F.col("hash") / 2.0**64 + 0.5 < F.col("share")) | (F.col("hash") == F.col("shortest")))
    first = Window.partitionBy("label").orderBy("class", (F.col("hash") != F.col("shortest")), "hash")
    found = drawn.withColumn("at", F.row_number().over(first)).where(F.col("at") <= max(1, int(1.2 * each)))
    return written(found.select("label", "hash", "chars"), "sample")


def text_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
