"""Exact k nearest binary codes by incremental multi-index hashing.

A code has m segments. If two codes differ in at most r bits, some segment differs
in at most r // m bits. So a query looks up its segments at growing radii, and stops once its kth
verified distance is at most the distance that the radii so far cover.

Equal codes are one entry with its k + 1 smallest ids, which are all that can be among
the k nearest (one more, as a query isn't its own neighbour). Entries are dealt over blocks of bounded size
by a hash; each block is an index of its own, and a block of queries meets every block of
entries, first one that gives a bound, then the others with that bound. The k best of all blocks are the result.

A null vector, an empty one or one that holds a null has no code: it is no query
and no neighbour. Vectors shorter than the longest have 0 bits at the end. Repeated rows are
neighbours of their copies; rows with equal ids are one id. Ties go to smaller ids. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflife.llm.scratch import written
from shelflife.llm.text import U64

K = 10
QUERY_EVERY = 50
SEGMENT_BITS = 16
#: Codes of an index block and queries of a query block, about.
INDEX_BLOCK, QUERY_BLOCK = 1 << 17, 1 << 12


def sign_code(vector: Column, at: int) -> Column:
    """Signs of 64 dimensions from `at` as one 64-bit value."""
    part = F.slice(vector, at + 1, 64)
    bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def sign_codes(vectors: DataFrame, vector: str) -> DataFrame:
    """vectors with `code`, an array of 64-bit values; rows without a code are left out."""
    sized = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    longest = sized.agg(F.max(F.size(vector))).first()[0] or 0
    return sized.withColumn("code", F.array(*[sign_code(F.col(vector), at) for at in range(0, max(1, longest), 64)]))


def _masks(radius: int) -> np.ndarray:
    """All changes of exactly `radius` bits of a segment."""
    return np.array(
        [sum(1 << b for b in bits) for bits in itertools.combinations(range(SEGMENT_BITS), radius)], np.int64
    )


class Index:
    """Multi-index over distinct codes (n x words of 64 bits)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        keys = codes.view(np.uint16)  # n x segments
        self.segments = keys.shape[1]
        self.order = [np.argsort(keys[:, j], kind="stable") for j in range(self.segments)]
        every = np.arange((1 << SEGMENT_BITS) + 1)
        self.starts = [np.searchsorted(keys[o, j], every) for j, o in enumerate(self.order)]

    def search(self, query: np.ndarray, weights: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries at the k smallest distances (an entry counts weights[entry] times) and these distances; entries
        farther than bound may be left out."""
        segments = query.view(np.uint16).astype(np.int64)
        seen = np.zeros(len(self.codes), bool)
        found, distances = [], []
        for radius in range(SEGMENT_BITS + 1):
            for j in range(self.segments):
                keys = segments[j] ^ _cached_masks(radius)
                low, high = self.starts[j][keys], self.starts[j][keys + 1]
                hit = np.flatnonzero(high > low)
                if len(hit):
                    count = high[hit] - low[hit]
                    places = np.repeat(low[hit] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                    entries = self.order[j][places]
                    entries = entries[~seen[entries]]
                    seen[entries] = True
                    found.append(entries)
                    distances.append(np.bitwise_count(self.codes[entries] ^ query).sum(axis=1).astype(np.int64))
                # Segments up to j are covered at this radius, the others at the one before.
                covered = radius * self.segments + j
                if covered >= bound or self._kth(found, distances, weights, k) <= covered:
                    return self._best(found, distances, weights, k, bound)
        return self._best(found, distances, weights, k, bound)

    def _kth(self, found, distances, weights, k) -> int:
        if not found:
            return 1 << 30
        entries, far = np.concatenate(found), np.concatenate(distances)
        total = np.cumsum(np.bincount(far, weights[entries]))
        at = int(np.searchsorted(total, k))
        return at if at < len(total) else 1 << 30

    def _best(self, found, distances, weights, k, bound):
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        entries, far = np.concatenate(found), np.concatenate(distances)
        keep = far <= min(bound, self._kth(found, distances, weights, k))
        return entries[keep], far[keep]


_mask_cache: dict[int, np.ndarray] = {}


def _cached_masks(radius: int) -> np.ndarray:
    if radius not in _mask_cache:
        _mask_cache[radius] = _masks(radius)
    return _mask_cache[radius]


def _codes(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(rows, -1)).view(U64)


def _search_blocks(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """queries (cell, block, code, bound), entries (cell, block, code, ids): (code, distance, ids) found in each cell."""
    schema = "code array<long>, distance long, ids array<long>"

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        empty = pa.table({"code": pa.array([], pa.list_(pa.int64())), "distance": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
        if not asked.num_rows or not held.num_rows:
            return empty
        index = Index(_codes(held.column("code"), held.num_rows))
        ids = held.column("ids").combine_chunks()
        weights = ids.value_lengths().to_numpy()
        bounds = asked.column("bound").to_numpy()
        at, which, far = [], [], []
        for i, query in enumerate(_codes(asked.column("code"), asked.num_rows)):
            entries, distances = index.search(query, weights, k + 1, int(bounds[i]))
            at.append(np.full(len(entries), i))
            which.append(entries)
            far.append(distances)
        at, which = np.concatenate(at), np.concatenate(which)
        code = asked.column("code").combine_chunks().take(pa.array(at))
        return pa.table({"code": code, "distance": pa.array(np.concatenate(far)), "ids": ids.take(pa.array(which))})

    by = ["cell", "block"]
    return queries.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(search, schema)


def nearest_codes(
    coded: DataFrame, id_column: str, is_query: Column, k: int = K,
    index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of every row
    with is_query, by Hamming distance of `code`, then id."""
    rows = written(
        coded.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), "code", is_query.alias("asks")).distinct(), "codes"
    )
    # The smallest ids of a code; each task keeps so many before the shuffle.
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = rows.select("code", "id").distinct().withColumn("_n", place).where(F.col("_n") <= k + 1)
    entries = written(entries.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    queries = rows.where("asks").select("code").distinct()
    blocks = -(-max(1, entries.count()) // index_block)
    cells = -(-max(1, queries.count()) // query_block)
    dealt = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    held = entries.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), dealt(blocks).alias("block"), "code", "ids"
    )
    query_cell = F.pmod(F.xxhash64("code", F.lit(1)), F.lit(cells)).cast("int")
    # Its own block bounds the distances of a query; the others needn't look farther.
    first = queries.select(query_cell.alias("cell"), dealt(blocks).alias("block"), "code", F.lit(1 << 30).cast("long").alias("bound"))
    near = written(_search_blocks(first, held, k), "near")
    if blocks > 1:
        each = near.withColumn("_n", F.sum(F.size("ids")).over(
            Window.partitionBy("code").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
        ))
        bounds = each.groupBy("code").agg(F.min(F.when(F.col("_n") > k, F.col("distance"))).alias("bound"))
        others = first.drop("bound").join(bounds, "code", "left").select(
            "cell", F.col("block").alias("_own"), "code", F.coalesce("bound", F.lit(1 << 30).cast("long")).alias("bound"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        ).where("block != _own").drop("_own")
        near = written(near.unionByName(_search_blocks(others, held, k)), "near-all")
    closest = Window.partitionBy("code").orderBy("distance", "neighbor_id")
    found = near.select("code", "distance", F.explode("ids").alias("neighbor_id"))
    found = written(found.withColumn("_n", F.row_number().over(closest)).where(F.col("_n") <= k + 1).drop("_n"), "nearest")
    asked = rows.where("asks").select("id", "code").distinct()
    of_query = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (
        asked.join(found, "code").select(F.col("id").alias("query_id"), "neighbor_id", "distance")
        .where("query_id != neighbor_id")
        .withColumn("rank", F.row_number().over(of_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "neighbor_id", "distance")
    )
