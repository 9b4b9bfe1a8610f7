"""Item-locations with too many lots for one task.

All sequence operators work on the lots of one item-location in order. The few
item-locations that are too large for one task take a path of their own: their
lots are range-partitioned on the full lot order into blocks, each block is
processed on its own, and what a block needs from the blocks before it is added
from a table with one row per block. All other lots keep the plain plan.
Nothing is dropped and the results do not depend on the split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelflife.operators.repeats import spread
from shelflife.sources.shared import freed, shared_folder, stored

BLOCK = "lot_block"
#: The number of a lot among repeats that are equal in all columns.
REPEAT = "lot_repeat"
#: A hot key's equal repeats are formed in pieces of a task's share of lots, so that tasks come out even.
PIECES = 64
#: A hot key's lots that repeat no more often than this aren't shuffled to form their repeats.
FEW_REPEATS = 16
#: Blocks of fewer lots share a task up to so many, as a task for each would cost more than its lots.
TASK_LOTS = 250_000

@dataclass(frozen=True)
class Layout:
    """How lots are spread over tasks: by key, or by key and block."""

    keys: tuple[str, ...]
    blocks: DataFrame | None = None  # (keys, BLOCK), one row per block of a split key
    most_repeats: int = 1  # no lot has a larger number in `times`

    @property
    def split(self) -> bool:
        return self.blocks is not None

    @property
    def partition(self) -> tuple[str, ...]:
        return (*self.keys, BLOCK) if self.split else self.keys

    def window(self, order: Sequence[str | Column], *more_keys: str) -> WindowSpec:
        return W.partitionBy(*self.partition, *more_keys).orderBy(
            *[F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
        )

    def align(self, side: DataFrame) -> DataFrame:
        """Repeat the rows of a split key once per block, so that a join on
        `partition` uses the same shuffle as the windows. Keys that are not
        split are not needed and drop out."""
        if not self.split:
            return side
        return side.join(self.blocks, list(self.keys))

    def join(self, lots: DataFrame, side: DataFrame) -> DataFrame:
        return lots.join(self.align(side), list(self.partition), "left")


@dataclass(frozen=True)
class Part:
    lots: DataFrame
    layout: Layout


def over_parts(parts: Sequence[Part], step: Callable[[DataFrame, Layout], DataFrame]) -> DataFrame:
    """Apply `step` to each part and put the results together."""
    results = [step(part.lots, part.layout).drop(BLOCK, REPEAT) for part in parts]
    together = results[0]
    for result in results[1:]:
        together = together.unionByName(result)
    return together


def split_hot_refs(
    lots: DataFrame,
    counts: DataFrame,
    keys: tuple[str, ...],
    order: Callable[[DataFrame], Sequence[str]],
    lots_per_task: int,
    enrich: Callable[[DataFrame, DataFrame | None, bool, bool], DataFrame] | None,
) -> list[Part]:
    """The enriched lots as one part or, when some keys are hot, as a plain
    part and a part in blocks. `counts` holds upper bounds per key, of the enriched
    rows as `rows` and of how often `enrich` repeats a lot as `repeats`; `enrich` gets the lots, the hot keys if there are any,
    whether the lots are theirs, and whether any lot may repeat. Then it may give equal rows as one with their number in `times`.
    Those of hot keys are formed over all tasks, and being equal they may lie in any blocks; those of others are formed
    when they have been put in order (`copies`).

    Three numbers are fetched while the plan is built: how many rows the hot keys have at most, and how often a lot
    of theirs and one of the others repeats. The keys themselves stay a table, however many there are."""
    is_hot = F.col("rows") > lots_per_task
    hot = counts.where(is_hot)
    found = [F.sum(F.when(is_hot, F.col("rows"))), F.max(F.when(is_hot, F.col("repeats"))), F.max(F.when(~is_hot, F.col("repeats")))]
    with freed(lots.sparkSession):
        most, hot_repeats, repeats = counts.agg(*found).first()
    repeats = int(repeats or 1)
    enrich = enrich or (lambda some, keys, large, repeated: some)
    if not most:
        return [Part(enrich(lots, None, False, repeats > 1), Layout(keys, most_repeats=repeats))]
    tasks = math.ceil(most / max(lots_per_task, TASK_LOTS))
    checkpoint_folder(lots.sparkSession)
    with freed(lots.sparkSession):
        hot_keys = hot.select(*keys).checkpoint()
    # Both parts read them, so they are worked out once, and the shuffle that did it goes before the next.
    lots = stored(lots, "lots")
    plain = lots.join(hot_keys, list(keys), "left_anti")
    large = enrich(lots.join(hot_keys, list(keys), "left_semi"), hot_keys, True, True)
    if "times" in large.columns:
        large = _formed(large, keys, lots_per_task, tasks if hot_repeats > FEW_REPEATS else 0)
    sequence = [F.col(c).asc_nulls_last() for c in (*keys, *order(large))]
    runs = large.repartitionByRange(tasks, *sequence).sortWithinPartitions(*sequence)
    with freed(lots.sparkSession):
        # The number grows along the sequence, by one within a task, so a block is a run of lots of one task.
        blocks = runs.withColumn(BLOCK, F.floor(F.monotonically_increasing_id() / F.lit(lots_per_task)))
        # Range bounds come from a sample. The checkpoint fixes them, so every
        # branch of the plan, and every retry, sees the same blocks.
        blocks = blocks.checkpoint()
    layout = Layout(keys, blocks.select(*keys, BLOCK).distinct())
    return [Part(enrich(plain, hot_keys, False, repeats > 1), Layout(keys, most_repeats=repeats)), Part(blocks, layout)]


def _formed(lots: DataFrame, keys: tuple[str, ...], lots_per_task: int, tasks: int) -> DataFrame:
    """Every lot as often as `times` says, numbered in REPEAT; the repeats of one lot come from many tasks, twice `tasks`,
    or with 0 from the lot's own."""
    pieces = spread(lots, F.col("times"), max(1, lots_per_task // PIECES)).drop("times")
    if tasks:
        pieces = pieces.repartition(2 * tasks, *keys, *[c for c in ("lot_number", "planner_name", "mbx") if c in lots.columns], "_first")
    return pieces.withColumn(REPEAT, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_length") - 1))).drop("_first", "_length")


def rows_per_key(
    lots: DataFrame, repeats: Sequence[DataFrame], keys: tuple[str, ...], later: Sequence[tuple[DataFrame, int]] = ()
) -> DataFrame:
    """Per key `repeats`, how often a lot repeats when every table in `repeats` has been joined on the key, and `rows`, the
    rows that there are then and once those in `later` have been joined, each so many times. A table with a column `times`
    says itself how often its key repeats a row. All tables are counted in one shuffle; none is joined with another."""
    tables = [(table, 1) for table in repeats] + list(later)
    names = [f"_of_{i}" for i in range(len(tables))]
    none = {name: F.lit(0.0) for name in names}

    def counted(table: DataFrame, **own: Column) -> DataFrame:
        return table.select(*keys, *[c.alias(name) for name, c in ({"_lots": F.lit(0.0)} | none | own).items()])

    rows = counted(lots, _lots=F.lit(1.0))
    for name, (table, _) in zip(names, tables):
        rows = rows.unionByName(counted(table, **{name: F.col("times").cast("double") if "times" in table.columns else F.lit(1.0)}))
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_lots", *names)]).where(F.col("_lots") > 0)
    # A key that a table doesn't have keeps its rows.
    product = [F.greatest(F.col(name), F.lit(1.0)) for name in names]
    times = [math.prod(some, start=F.lit(1.0)) for some in (product[: len(repeats)], [c for c, (_, n) in zip(product, tables) for _ in range(n)])]
    return sums.select(*keys, (F.col("_lots") * times[1]).alias("rows"), times[0].alias("repeats"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()
