"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Words are summed by source and by the leading bits of
the hash; in each source the bucket where the running sum crosses the budget is
opened with the next bits, and so on until it is a single hash value. A document
is taken if its hash is below the threshold of its source, so nothing is sorted.

A null source is a source of its own and comes last. A null text has no words. Rows with
the same doc_id share a hash and are taken together. A source without words and
an empty table have target 0 and take nothing. Other columns pass through `mixed`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflife.llm.scratch import written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS = 60
LEVEL_BITS = 12
#: Rows of a source are dealt over so many keys where they meet its threshold.
SALTS = 64


def word_count(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.regexp_count(spaced, F.lit("[^ ]+")).cast("long")


def document_hash(doc_id: Column) -> Column:
    """The first 60 bits of MD5 of the id as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT
) -> DataFrame:
    """sources has one row (source, source_size); adds `target`.

    Sources below their limit get weight times a common level. Taken in the order of
    size by weight, the first source that is below its limit at the level
    left by those before it fixes that level."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("_weight", weight.cast("long")).withColumn(
        "_limit", F.col("source_size") * most
    )
    # Ratios are compared as products of whole numbers would be; ties have equal outcomes.
    order = Window.orderBy((F.col("_limit") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    ) / F.sum("_weight").over(after)
    levels = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct("_limit", "_weight", "_level"))
    first = levels.withColumn("_free", F.first(fits, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    share = F.col("_free._level") * F.col("_weight")
    limit = F.col("_limit").cast("double")
    return first.withColumn("target", F.coalesce(F.least(share, limit), limit)).drop(
        "_weight", "_limit", "_level", "_free"
    )


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets has (source, _rest): words to take with one pass of part of the
    source. Adds `_below`: documents with a smaller hash are taken."""
    state = budgets.withColumns({"_prefix": F.lit(0).cast("long"), "_sum": F.lit(0).cast("long")})
    # Only what lies in an open bucket is summed again at each finer level.
    inside = sized.select("source", "size", "_hash")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("_hash", shift)
        sums = inside.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"))
        by_hash = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = sums.join(state, sums["source"].eqNullSafe(state["source"])).select(
            state["source"], "_rest", "_sum", "_bucket", "_words"
        ).withColumn("_upto", F.col("_sum") + F.sum("_words").over(by_hash))
        crossing = running.where(F.col("_upto") > F.col("_rest"))
        opened = crossing.groupBy("source").agg(
            F.min(F.struct("_bucket", "_upto", "_words", "_rest")).alias("_b")
        ).select(
            "source",
            F.col("_b._rest").alias("_rest"),
            F.col("_b._bucket").alias("_prefix"),
            (F.col("_b._upto") - F.col("_b._words")).alias("_sum"),
            F.col("_b._words").alias("_last"),
        )
        state = written(opened, "mixing-state")
        open_buckets = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
            F.col("source").alias("_s"), F.col("_prefix"), F.col("_salt")
        )
        if shift:
            inside = written(
                inside.join(
                    open_buckets,
                    inside["source"].eqNullSafe(F.col("_s"))
                    & (F.shiftright("_hash", shift) == F.col("_prefix"))
                    & (F.pmod("_hash", F.lit(SALTS)) == F.col("_salt")),
                ).select(inside["source"], "size", "_hash"),
                "mixing-open",
            )
    # The last bucket is one hash value: it is taken too if that comes nearer to the budget.
    over = F.col("_sum") + F.col("_last") - F.col("_rest")
    nearer = over < F.col("_rest") - F.col("_sum")
    return state.select("source", F.when(nearer, F.col("_prefix") + 1).otherwise(F.col("_prefix")).alias("_below"))


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(_source, source_size, target, _whole, _below, _salt): how much of each source to take."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = F.col("target") / F.col("source_size")
    targets = written(
        source_targets(sources, weights, most)
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(share)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")),
        "mixing-targets",
    )
    found = _thresholds(sized, targets.where("_rest > 0").select("source", "_rest"))
    plan = targets.join(found, targets["source"].eqNullSafe(found["source"]), "left").select(
        targets["source"].alias("_source"), "source_size", "target", "_whole",
        F.coalesce("_below", F.lit(0)).alias("_below"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    return written(plan, "mixing-plan")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id")).alias("_hash")
    )


def _met(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (with source and _hash) with their source's plan, and copies."""
    copies = F.col("_whole") + F.when(F.col("_hash") < F.col("_below"), 1).otherwise(0)
    salted = F.pmod("_hash", F.lit(SALTS)) == F.col("_salt")
    return docs.join(plan, docs["source"].eqNullSafe(plan["_source"]) & salted).withColumn(
        "copies", copies.cast("long")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each document:
    `copies` times its `size` words are taken."""
    sized = written(_sized(docs), "mixing-sizes")
    return _met(sized, _plan(sized, weights, most)).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """docs' rows, each as often as the mix takes it."""
    plan = _plan(written(_sized(docs), "mixing-sizes"), weights, most)
    box = docs.select("source", F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"), document_hash(F.col("doc_id")).alias("_hash"))
    met = _met(box, plan).where("copies > 0")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
