"""Sums over subtrees by centroid decomposition of a forest of parent edges.

A component is a connected piece of the forest with one top. Its centroid is the deepest node below which lies at least half
of the component's weight. The total of the centroid's subtree within the component is added to the centroid and to all nodes on
the path from it to the top; then the centroid goes, and what is left falls apart into the pieces below its children and the piece
above, each with half of the weight at most. So a node gets at most one addition in each of some log2(weight) rounds, however
deep or wide the forest is.

A node is (conv, depth), the smallest conversation through it and its depth. `paths` lists the nodes that a conversation goes
through, which gives ancestors without walking edges. Weights are the numbers of conversations' turns at or below a node, which
one aggregate finds; all that is needed of them is that a node's is larger than its children's together.

Components of more than `whole` weight are split by joins on all executors; smaller ones are small enough for one task, which
goes on by the same steps in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflife.llm.joins import join_uneven
from shelflife.llm.scratch import written

#: Components up to this weight (and so with no more nodes) are worked on as a whole.
WHOLE = 1 << 14
#: Nodes of a conversation that are looked up together.
BLOCK = 1 << 12

_NODE = ["conv", "depth", "parent_conv"]
_TOP = ["top_conv", "top_depth"]


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], total: int, whole: int = WHOLE) -> DataFrame:
    """(conv, depth) and the sums of `values` (long) over each node's subtree. `nodes` is one tree: conv, depth, parent_conv (null
    at the top), weight and the values; `paths` has conv_id, depth and owner from depth 1 on; `total` is the top's weight."""
    state = nodes.select(*_NODE, "weight", *values, *[F.lit(0).cast("long").alias(f"sum_{v}") for v in values])
    top = nodes.where(F.col("parent_conv").isNull()).select(F.col("conv")).scalar()
    state = state.withColumns({"top_conv": top, "top_depth": F.lit(0).cast("long"), "top_weight": F.lit(total).cast("long")})
    sums = ["conv", "depth", *[f"sum_{v}" for v in values]]
    done = []
    large = written(state, "components")
    while large.where(F.col("top_weight") > whole).limit(1).count():
        small = large.where(F.col("top_weight") <= whole)
        split, centroids = _split(large.where(F.col("top_weight") > whole), paths, values, total)
        done += [_within(small, values), centroids.select(*sums)]
        large = split
    done.append(_within(large, values))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("conv", "depth", *[F.col(f"sum_{v}").alias(v) for v in values])


def _block(depth: str) -> Column:
    return F.shiftright(F.col(depth), BLOCK.bit_length() - 1).alias("_block")


def _split(large: DataFrame, paths: DataFrame, values: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """One round over components that are too large for a task: what is left of them, and the centroids."""
    half = large.where(2 * F.col("weight") >= F.col("top_weight"))
    at = F.max(F.struct("depth", "conv", "weight")).alias("_c")
    cents = written(
        half.groupBy(*_TOP).agg(at, F.first("top_weight").alias("top_weight")).select(
            *_TOP, F.col("_c.conv").alias("c_conv"), F.col("_c.depth").alias("c_depth"), F.col("_c.weight").alias("c_weight"), "top_weight"
        ),
        "centroids",
    )
    # Pieces below: children of centroids, with their weights. A centroid has no more children than weight.
    children = large.where(F.col("parent_conv").isNotNull()).select(
        F.col("parent_conv").alias("c_conv"), (F.col("depth") - 1).alias("c_depth"), F.col("conv").alias("piece"), F.col("weight").alias("piece_weight")
    )
    pieces = join_uneven(children, cents.select("c_conv", "c_depth", "c_weight"), ["c_conv", "c_depth"], "c_weight", total).select(
        "piece", "c_depth", "piece_weight"
    )
    # Nodes of one conversation in a component: all below the same child, or none but those of the centroid's own.
    runs = large.groupBy(*_TOP, "conv", _block("depth")).agg(F.max("depth").alias("_last"))
    runs = join_uneven(runs, cents, _TOP, "top_weight", total)
    at_c = paths.select(F.col("conv_id").alias("conv"), F.col("depth").alias("c_depth"), F.col("owner").alias("_at"))
    below_c = paths.select(F.col("conv_id").alias("conv"), (F.col("depth") - 1).alias("c_depth"), F.col("owner").alias("piece"))
    runs = runs.join(at_c, ["conv", "c_depth"], "left").join(below_c, ["conv", "c_depth"], "left")
    below = (F.col("_last") >= F.col("c_depth")) & (
        (F.col("c_depth") == 0) | (F.col("conv") == F.col("c_conv")) | F.coalesce(F.col("_at") == F.col("c_conv"), F.lit(False))
    )
    runs = written(runs.withColumn("_below", below), "runs")
    # A run that ends with the centroid has no node in a piece; that below may have gone in an earlier round.
    lower = F.col("_below") & (F.col("_last") > F.col("c_depth"))
    in_piece = join_uneven(runs.where(lower), pieces, ["piece", "c_depth"], "piece_weight", total)
    rest = runs.where(~lower).withColumn("piece_weight", F.lit(None).cast("long"))
    runs = in_piece.unionByName(rest).drop("top_weight", "_at", "_last")
    keys = [*_TOP, "conv", "_block"]
    placed = large.withColumn("_block", _block("depth")).join(runs, keys)
    is_c = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
    placed = written(
        placed.withColumns({"_is_c": is_c, "_below": F.col("_below") & ((F.col("conv") != F.col("c_conv")) | (F.col("depth") >= F.col("c_depth")))}),
        "placed",
    )
    totals = placed.where("_below").groupBy(*_TOP).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # From each centroid to the top of its component.
    last = F.greatest(F.col("c_depth") - 1, F.col("top_depth"))
    ways = cents.join(totals, _TOP).withColumn(
        "_block", F.explode(F.sequence(F.shiftright("top_depth", BLOCK.bit_length() - 1), F.shiftright(last, BLOCK.bit_length() - 1)))
    )
    steps = paths.withColumn("_block", _block("depth")).select(F.col("conv_id").alias("c_conv"), "_block", "depth", F.col("owner").alias("conv"))
    added = [f"_t_{v}" for v in values]
    on_way = ways.join(steps, ["c_conv", "_block"]).where((F.col("depth") >= F.col("top_depth")) & (F.col("depth") < F.col("c_depth")))
    on_way = on_way.select("conv", "depth", "c_weight", *added)
    ends = cents.join(totals, _TOP)
    at_top = ends.where("top_depth = 0 AND c_depth > 0").select(F.col("top_conv").alias("conv"), F.lit(0).cast("long").alias("depth"), "c_weight", *added)
    at_cent = ends.select(F.col("c_conv").alias("conv"), F.col("c_depth").alias("depth"), F.lit(0).cast("long").alias("c_weight"), *added)
    adds = on_way.unionByName(at_top).unionByName(at_cent).withColumnRenamed("c_weight", "_lost")
    moved = placed.join(adds, ["conv", "depth"], "left").withColumns(
        {"weight": F.col("weight") - F.coalesce("_lost", F.lit(0))}
        | {f"sum_{v}": F.col(f"sum_{v}") + F.coalesce(f"_t_{v}", F.lit(0)) for v in values}
    )
    below = F.col("_below")
    moved = moved.withColumns(
        {
            "top_conv": F.when(below, F.col("piece")).otherwise(F.col("top_conv")),
            "top_depth": F.when(below, F.col("c_depth") + 1).otherwise(F.col("top_depth")),
            "top_weight": F.when(below, F.col("piece_weight")).otherwise(F.col("top_weight") - F.col("c_weight")),
        }
    )
    moved = written(moved.select(*large.columns, "_is_c"), "components")
    return moved.where("NOT _is_c").drop("_is_c"), moved.where("_is_c").drop("_is_c")


def _within(small: DataFrame, values: list[str]) -> DataFrame:
    """The sums of components that fit a task: whole components, one after the other, many in a batch."""
    columns = [*_TOP, *_NODE, "weight", *values, *[f"sum_{v}" for v in values]]
    k = len(values)

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            def column(name: str) -> np.ndarray:
                found = table.column(name)
                return found.fill_null(0).to_numpy().astype(np.int64)

            of = np.stack([column(v) for v in values])
            sums = np.stack([column(f"sum_{v}") for v in values])
            parts = [column(c) for c in (*_TOP, *_NODE, "weight")]
            sums = sums + forest_sums(*parts, of)
            arrays = [pa.array(parts[2]), pa.array(parts[3]), *[pa.array(sums[i]) for i in range(k)]]
            return pa.RecordBatch.from_arrays(arrays, ["conv", "depth", *[f"sum_{v}" for v in values]])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tops = [held.column(c).to_numpy() for c in _TOP]
            change = np.flatnonzero((np.diff(tops[0]) != 0) | (np.diff(tops[1]) != 0))
            if len(change):  # the last component may go on
                yield out(held.slice(0, change[-1] + 1))
                held = held.slice(change[-1] + 1)
        if held is not None and held.num_rows:
            yield out(held)

    names = ", ".join(f"sum_{v} long" for v in values)
    gathered = small.select(*columns).repartition(*_TOP).sortWithinPartitions(*_TOP)
    return gathered.mapInArrow(rolled, f"conv long, depth long, {names}")


def forest_sums(
    top_conv: np.ndarray, top_depth: np.ndarray, conv: np.ndarray, depth: np.ndarray, parent_conv: np.ndarray, weight: np.ndarray, values: np.ndarray
) -> np.ndarray:
    """Sums of `values` (rows of an array) over the subtrees of each node within its component, by the same rounds
    as between tasks, for all components at once."""
    n = len(conv)
    known, code = np.unique(conv, return_inverse=True)
    span = int(depth.max()) + 2
    key = code * span + depth
    order = np.argsort(key)
    is_top = (conv == top_conv) & (depth == top_depth)

    def place(convs: np.ndarray, depths: np.ndarray) -> np.ndarray:
        codes = np.minimum(np.searchsorted(known, convs), len(known) - 1)
        return order[np.minimum(np.searchsorted(key[order], codes * span + depths), n - 1)]

    parent = np.where(is_top, -1, place(parent_conv, depth - 1))
    label = place(top_conv, top_depth)
    weight, sums = weight.copy(), np.zeros_like(values)
    live = np.arange(n)
    while len(live):
        candidate = live[2 * weight[live] >= weight[label[live]]]
        deepest = np.full(n, -1)
        np.maximum.at(deepest, label[candidate], depth[candidate])
        cents = candidate[depth[candidate] == deepest[label[candidate]]]
        is_cent = np.zeros(n, bool)
        is_cent[cents] = True
        # New tops: old tops, centroids and their children; all others go to their parent's.
        jump = np.arange(n)
        old = live[label[live] != live]
        down = old[~is_cent[old]]
        down = down[~is_cent[parent[down]]]
        jump[down] = parent[down]
        while True:
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        new = jump[live]
        total = np.zeros_like(values)
        total[:, cents] = values[:, cents]
        below = live[(label[new] != new) & ~is_cent[new]]
        for row, value in zip(total, values):
            np.add.at(row, parent[jump[below]], value[below])
        sums[:, cents] += total[:, cents]
        at = cents[label[cents] != cents]
        of = at
        while len(at):
            at = parent[at]
            sums[:, at] += total[:, of]
            weight[at] -= weight[of]
            going = label[at] != at
            at, of = at[going], of[going]
        label = np.where(is_cent, label, jump)
        live = live[~is_cent[live]]
    return sums
