"""Alignment of two tokenizers' tokens over the same texts, and how often two tokens end together.

A batch of documents is encoded by both tokenizers. pandas merge_asof, keyed by document, finds for the start of every
token the other side's token that covers it; the union of both directions are all overlaps. Overlaps that end at the same byte
are links, and their ends cut the tokens of both sides into groups.

The counts of linked pairs over all documents are sums by pair, of sums by task. Documents look their pairs up: the
most frequent pairs, HOT_PAIRS at most, are broadcast, and all others are joined; that changes no result.

A document without tokens has zeros and an empty text of groups: a null or empty text, and one whose tokens don't spell it (a
vocabulary that replaces characters). Names of special tokens are plain text. Repeated rows count as often as they occur and get
equal results. An empty table gives no rows. All other columns stay, also those named like an inner column; the operator's own is
`alignment` (or `groups`). A document is worked on as a whole in one task, with memory of some 100 times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelflife.llm.scratch import boxed, text_batches, unboxed, written
from shelflife.llm.text import pieces
from shelflife.llm.token_pairs import Aligned, TokenPair, byte_level_coder, group_texts, piece_coder

#: Most pairs that are broadcast, with their counts.
HOT_PAIRS = 1 << 20
#: Distinct pairs that a task holds before it passes them on.
TALLIED = 1 << 20
#: Bytes of text that are worked on at once.
PIECE = 1 << 20
#: A pair is one number: id of A * SPAN + id of B.
SPAN = 1 << 24

_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
_ALIGNED = f"_row long, {', '.join(c + ' long' for c in _COUNTS)}, groups_sha256 string, _a binary, _b binary"
_SETTLED = f"{', '.join(c + ' long' for c in _COUNTS)}, groups_sha256 string, n_best long, count_sum long"


def public_pair() -> TokenPair:
    """The public byte-level vocabulary of 50k and the public piece vocabulary of 32k."""
    import public_tokenizers

    return TokenPair(
        byte_level_coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        piece_coder(public_tokenizers.path("piece_bpe_32k.model")),
    )


def _over_texts(batches: Iterator[pa.RecordBatch], pair: Callable[[], TokenPair]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    coder = pair()
    for batch in pieces(batches, PIECE):
        yield batch, coder.align(batch.column("text").to_pylist())


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.int64))


def token_groups(docs: DataFrame, pair: Callable[[], TokenPair] = public_pair) -> DataFrame:
    """The columns of docs and `groups`: the groups of tokens in the order of the text, each with the ids of both sides and the
    end of its bytes in the space and the text."""
    text_batches(docs.sparkSession)
    box = boxed(docs, "text")
    columns = box.columns
    schema = StructType([*box.schema.fields, *StructType.fromDDL("groups array<struct<end:long,a:array<int>,b:array<int>>>").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, al in _over_texts(batches, pair):
            n = len(al.link_a)
            first = np.concatenate([[0], al.ends_a])[al.rows_a[:-1]]
            ends = al.ends_a[al.link_a] - np.repeat(first, np.diff(al.rows_groups))
            lists = [
                pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n + 1)).astype(np.int32)), pa.array(ids, pa.int32()))
                for group, ids in ((al.group_a, al.a), (al.group_b, al.b))
            ]
            structs = pa.StructArray.from_arrays([_longs(ends), *lists], ["end", "a", "b"])
            groups = pa.ListArray.from_arrays(pa.array(al.rows_groups.astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], groups], schema.names)

    return unboxed(box.mapInArrow(cut, schema), docs.columns, ("text",), "groups")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs of a task and their numbers."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_longs(keys), _longs(counts)], ["pair", "n"])

    for batch in batches:
        more, times = np.unique(_pairs(batch), return_counts=True)
        keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, times]), len(keys)).astype(np.int64)
        if len(keys) > TALLIED:
            yield out()
            keys, counts = keys[:0], counts[:0]
    yield out()


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4") for c in ("_a", "_b"))
    return a.astype(np.int64) * SPAN + b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked pairs; best if no pair of the same B has more."""
    counts = written(
        aligned.select("_a", "_b").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        .withColumn("_id", F.pmod("pair", F.lit(SPAN))),
        "pair-counts",
    )
    # One row for each id of B that occurs: the vocabulary is the bound.
    most = counts.groupBy("_id").agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most), "_id").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def least_hot(counts: DataFrame, most: int = HOT_PAIRS) -> int:
    """The least count at which no more than `most` pairs have it or more. Counts are first summed by their power of 2 ** 0.25,
    so that a few rows are fetched however many pairs there are."""
    step = F.floor(F.log2("n") * 4)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        total += row["pairs"]
        if total > most:
            break
        least = row["least"]
    return least if least is not None else (1 << 62)


def align(docs: DataFrame, pair: Callable[[], TokenPair] = public_pair, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The columns of docs but for `text`, and a struct `alignment`: numbers of tokens, groups, links and overlaps, the hash of the
    groups' text (empty without tokens), n_best (links whose pair is the most frequent of its B, ties included) and count_sum
    (the sum of the links' counts over all documents)."""
    spark = docs.sparkSession
    text_batches(spark)
    kept = [c for c in docs.columns if c != "text"]
    box = boxed(docs, "text").select("_box", "text")
    box_field = box.schema["_box"]
    aligned_schema = StructType([box_field, *StructType.fromDDL(_ALIGNED).fields])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch, al in _over_texts(batches, pair):
            n = batch.num_rows
            hashes = [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(al)]
            a, b = al.a[al.link_a].astype("<u4"), al.b[al.link_b].astype("<u4")
            links = [[x[s:e].tobytes() for s, e in zip(al.rows_links[:-1], al.rows_links[1:])] for x in (a, b)]
            counts = (np.diff(al.rows_a), np.diff(al.rows_b), np.diff(al.rows_groups), np.diff(al.rows_links), al.overlaps)
            columns = [batch.column("_box"), _longs(np.arange(row, row + n)), *map(_longs, counts), pa.array(hashes, pa.string())]
            columns += [pa.array(x, pa.binary()) for x in links]
            row += n
            yield pa.RecordBatch.from_arrays(columns, aligned_schema.names)

    table = written(box.mapInArrow(aligned, aligned_schema), "aligned", "zstd")
    counts = written(pair_counts(table), "pairs")
    least = least_hot(counts, hot_pairs)
    hot = counts.where(F.col("n") >= least).orderBy("pair").toPandas()
    shared = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool)))
    rare_type = "array<struct<pair:long,times:long>>"
    settled_schema = StructType([box_field, *StructType.fromDDL(f"_row long, {_SETTLED}, _rare {rare_type}").fields])
    settled_names = settled_schema.names

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        index = pd.Index(keys)
        for batch in batches:
            found = _pairs(batch)
            ends = np.cumsum([0, *np.asarray(batch.column("n_links"))])
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = index.get_indexer(found)
            hit = at >= 0
            where = at[hit]
            n_best = np.bincount(of[hit], best[where], batch.num_rows)
            sums = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, of[hit], n[where])
            rest, times = np.unique(np.stack([of[~hit], found[~hit]], 1), axis=0, return_counts=True)
            structs = pa.StructArray.from_arrays([_longs(rest[:, 1]), _longs(times)], ["pair", "times"])
            offsets = np.searchsorted(rest[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            same = [batch.column(c) for c in settled_names[: -3]]
            yield pa.RecordBatch.from_arrays(
                [*same, _longs(n_best), _longs(sums), pa.ListArray.from_arrays(pa.array(offsets), structs)], settled_names
            )

    done = written(table.mapInArrow(settled, settled_schema), "settled")
    rare = (
        done.select("_row", F.inline("_rare")).join(counts.where(F.col("n") < least), "pair")
        .groupBy("_row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
        )
    )
    result = F.struct(
        *_COUNTS, "groups_sha256",
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )
    joined = done.drop("_rare").join(rare, "_row", "left").select("_box", result.alias("alignment"))
    return unboxed(joined, kept, (), "alignment")
