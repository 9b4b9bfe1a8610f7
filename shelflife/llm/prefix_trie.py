"""The prefix trie of conversations, with totals over subtrees.

Every distinct sequence of the first d turns of a conversation is a node of depth d; the root, of depth 0, has no text. A node is
named by its smallest conversation and its depth. It counts its members (conversations that start with it), its children, the
childless nodes in its subtree, and the words that its subtree would save if every shared turn were held once. Totals over subtrees
come from a centroid decomposition (`centroids.py`), so neither depth nor width of the trie makes a long chain of steps.

Turns are in order of `turn`, null first; equal turns in order of a hash of role and text, so reruns agree. A null role or text is
empty. Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table
gives no nodes. Only conv_id, turn, role and text are read, so other columns may have any names.

A conversation may hold a third of all turns: its turns are numbered and hashed in blocks, whose totals are added up afterwards. A
turn may begin a third of all conversations: its members meet it by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelflife.llm.centroids import BLOCK, WHOLE, rollup
from shelflife.llm.joins import join_uneven
from shelflife.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations next to each other in their ids that are joined to one text before the texts of a node are hashed.
IDS = 1 << 12

_PREFIX = ["depth", "s0", "s1", "s2", "s3"]


def _block(column: str) -> Column:
    return F.shiftright(F.col(column), BLOCK.bit_length() - 1)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words) of all turns: pos counts from 1, key is a hash of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("key")]
    # Rows that are equal throughout may lie in several blocks, as it doesn't matter which of them comes first.
    dealt = written(turns.repartitionByRange("conv_id", *order, F.rand(7)).withColumn("_block", F.spark_partition_id()), "turn-blocks")
    within = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy(*order))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("conv_id", "_block").agg(F.count("*").alias("_n")).select("conv_id", "_block", before.alias("_before"))
    return dealt.withColumn("_at", within).join(offsets, ["conv_id", "_block"]).select(
        "conv_id", (F.col("_at") + F.col("_before")).cast("long").alias("pos"), "key", "words"
    )


def lengths_of(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n"))


def plain_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations as they are: (conv_id, depth, key, words) and (conv_id, len)."""
    return turns.withColumnRenamed("pos", "depth"), lengths_of(turns).withColumnRenamed("n", "len")


def rebuilt_prefixes(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % family in place of its own first h turns, h being the crc32 of
    c as text modulo `most`. A conversation may be left without turns."""
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "pos", "key", "words")
    own = lengths_of(turns)
    convs = own.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long").alias("h"),
        (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(
        convs.join(bases, "base", "left").select(
            "conv_id", "base", "h", "n", (taken - F.col("h")).alias("shift"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")
        ),
        "conversations",
    )
    first = convs.where("h > 0").join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "key", "words")
    shifts = convs.where("n > h").select("conv_id", "h", "shift", F.explode(F.sequence(F.lit(0).cast("long"), _block("n"))).alias("_block"))
    rest = turns.withColumn("_block", _block("pos")).join(shifts, ["conv_id", "_block"]).where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "key", "words")
    return first.unionByName(rest), convs.select("conv_id", "len")


def _hashed(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, len, words) and the identity s0..s3 of each prefix: sums of hashes of its turns and their depths."""
    term = F.md5(F.concat_ws(":", "key", F.col("depth").cast("string")).cast("binary"))
    parts = [F.conv(F.substring(term, 8 * k + 1, 8), 16, 10).cast("long").alias(f"t{k}") for k in range(4)]
    spans = lengths.where("len > 0").select("conv_id", "len", F.explode(F.sequence(F.lit(0).cast("long"), _block("len"))).alias("_block"))
    rows = turns.select("conv_id", "depth", "words", _block("depth").alias("_block"), *parts)
    run = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumns({f"w{k}": F.sum(f"t{k}").over(run) for k in range(4)})
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "_block").agg(*[F.sum(f"t{k}").alias(f"b{k}") for k in range(4)])
    before = totals.select("conv_id", "_block", *[F.coalesce(F.sum(f"b{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in range(4)])
    joined = within.join(before, ["conv_id", "_block"]).join(spans, ["conv_id", "_block"])
    return joined.select("conv_id", "depth", "len", "words", *[(F.col(f"w{k}") + F.col(f"b{k}")).alias(f"s{k}") for k in range(4)])


def _digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256): the hash of the ascending, comma-joined ids of the conversations that end at a node. A text
    of ids goes through the hash part by part."""
    part = F.shiftright("conv_id", IDS.bit_length() - 1).alias("_part")
    # A part has IDS ids at most, as ids of conversations are distinct.
    texts = ends.groupBy("conv", "depth", part).agg(F.array_sort(F.collect_list("conv_id")).alias("_ids")).select(
        "conv", "depth", "_part", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("_text")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, depth, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "depth", "_text")]):
                if (conv, depth) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield batch_of(done)
        if node is not None:
            yield batch_of([(*node, state.hexdigest())])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["conv", "depth", "ends_sha256"]
        )

    dealt = texts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "_part")
    return dealt.select("conv", "depth", "_text").mapInArrow(hashed, "conv long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Nodes of the trie of `turns` (conv_id, depth from 1 on without gaps, key, words) and `lengths` (conv_id, len, also 0): conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256."""
    lengths = written(lengths, "lengths")
    size = lengths.agg(F.count("*").alias("n"), F.sum("len").alias("turns"), F.min("conv_id").alias("least")).first()
    total = (size["turns"] or 0) + size["n"]
    rows = written(_hashed(turns, lengths), "prefixes")
    found = written(
        rows.groupBy(*_PREFIX).agg(
            F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum((F.col("depth") == F.col("len")).cast("long")).alias("n_ends"),
            F.sum(F.col("len") - F.col("depth") + 1).alias("weight"), F.max("words").alias("words"),
        ),
        "prefix-nodes",
    )
    owners = found.select(*_PREFIX, "owner", "n_convs")
    paths = written(
        join_uneven(rows, owners, _PREFIX, "n_convs", total).select("conv_id", "depth", "owner", (F.col("depth") == F.col("len")).alias("ends")), "paths"
    )
    root = lengths.agg(
        F.min("conv_id").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv"), F.count("*").alias("n_convs"),
        F.sum((F.col("len") == 0).cast("long")).alias("n_ends"), F.lit(total).cast("long").alias("weight"), F.lit(0).cast("long").alias("words"),
    ).where("n_convs > 0")
    above = paths.select(F.col("conv_id").alias("conv"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("_above"))
    parent = F.when(F.col("depth") == 1, F.lit(size["least"]).cast("long")).otherwise(F.col("_above"))
    nodes = found.withColumnRenamed("owner", "conv").join(above, ["conv", "depth"], "left").withColumn("parent_conv", parent)
    nodes = root.unionByName(nodes.select(root.columns))
    nodes = written(nodes, "trie-edges")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(
        nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "trie-nodes"
    )
    sums = rollup(nodes, paths, ["n_leaves", "saved_tokens"], total, whole)
    ends = paths.where("ends").select(F.col("owner").alias("conv"), "depth", "conv_id")
    ends = ends.unionByName(lengths.where("len = 0").select(F.lit(size["least"]).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    result = nodes.drop("n_leaves", "saved_tokens").join(sums, ["conv", "depth"]).join(_digests(ends), ["conv", "depth"], "left")
    return result.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        "n_ends", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
