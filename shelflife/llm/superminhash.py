"""Near-duplicate groups by SuperMinHash, banding, verification and connected components.

A text is the set of its 5-word shingles. In a SuperMinHash signature each element visits the
positions in a random order, its own permutation, with value rank plus a random
fraction; a position keeps its least value. A text stops as soon as no later rank can lower any value.
Equal sets are one node from the start. Nodes that agree in a band of the signature meet; of those, only a
forest of the likeliest links is confirmed on full sets, since links inside a
component add nothing. Then members of a bucket that are still in different components and may be linked are compared on full
sets, chunk by chunk; only links that join components leave a task.

A null or empty text, or one without words, has an empty set and is linked with nothing; so is
a row with a null id, which has no component and stays. A text of fewer than five words is one shingle.
Repeated rows are equal sets. Ties go to smaller ids. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from shelflife.llm.components import components, merged_components
from shelflife.llm.scratch import written
from shelflife.llm.text import U64, Spans, Words, mix, pieces, row_of, signed, text_of
from shelflife.llm.windows import key_filter, passing, with_lists, with_key

SHINGLE = 5
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 32 bands of 4: of two sets at the limit, all bands differ with probability 5e-6.
SIZE, ROWS = 128, 4
#: Pairs whose signatures agree less aren't confirmed; 4.4 standard deviations under the limit.
LEAST_AGREEMENT = 0.58
#: Members of a bucket that are compared in one task.
CHUNK = 1024
#: Elements of their sets that are compared in one task.
CHUNK_ITEMS = 1 << 19

_RANK = U64(57)


def shingle_sets(batch: pa.RecordBatch, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and the offsets of the texts."""
    words = Words(*text_of(batch), lower=True)
    rows, n = words.rows, np.diff(words.rows)
    if not len(words):
        return np.zeros(0, U64), np.zeros(batch.num_rows + 1, np.int64)
    spans = Spans(words.hashes())
    start = np.arange(len(words))
    owner = row_of(rows)
    end = start + k
    whole = end <= rows[1:][owner]
    short = (n[owner] < k) & (start == rows[:-1][owner])
    end = np.where(short, rows[1:][owner], end)
    take = whole | short
    hashes, owner = spans.hashes(start[take], end[take]), owner[take]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(batch.num_rows + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of every set: rank in the high bits, fraction in the low ones. Sets of a batch go
    through the ranks together; a set leaves when its largest value is below the next rank."""
    out = np.full((len(offsets) - 1, size), np.iinfo(np.uint64).max, U64)
    flat, owner, order = out.ravel(), row_of(offsets), None
    elements = hashes
    for rank in range(size):
        if rank:
            open_rows = out.max(axis=1) >= U64(rank) << _RANK
            stays = open_rows[owner]
            if not stays.any():
                break
            if order is None:
                elements, owner, at = elements[stays], owner[stays], at[stays]
                order = np.tile(np.arange(size, dtype=np.min_scalar_type(size - 1)), (len(elements), 1))
                order[np.arange(len(at)), at] = 0
            elif not stays.all():
                elements, owner, order = elements[stays], owner[stays], order[stays]
        drawn = mix(elements + U64((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        pick = rank + (((drawn & U64(0xFFFF)) * U64(size - rank)) >> U64(16)).astype(np.int64)
        if order is None:
            at = place = pick
        else:
            each = np.arange(len(elements))
            place = order[each, pick].astype(np.int64)
            order[each, pick] = order[each, rank]
        np.minimum.at(flat, owner * size + place, (U64(rank) << _RANK) | (drawn >> U64(64 - 57)))
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, size = signature.shape
    parts = mix(signature).reshape(n, size // rows, rows)
    keys = np.zeros((n, size // rows), U64)
    for k in range(rows):
        keys = mix(keys * U64(31) + parts[:, :, k])
    return mix(keys + np.arange(size // rows, dtype=U64))


def signed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, _h, row, n, f1 and f2 (of the set), bands, sketch (a byte of each signature value)."""
    long = LongType()
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name in ("_h", "row", "n", "f1", "f2"):
        schema = schema.add(name, long)
    schema = schema.add("bands", ArrayType(long)).add("sketch", BinaryType())

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in pieces(batches, 1 << 18):
            n = batch.num_rows
            hashes, offsets = shingle_sets(batch)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            prints = np.zeros((2, n), U64)
            for k, salt in enumerate((0x51ED27F5, 0xC0FFEE11)):
                if len(full):
                    prints[k, full] = np.add.reduceat(mix(hashes ^ U64(salt)), offsets[:-1][full])
            signature = signatures(hashes, offsets)
            keys = bands(signature)
            ends = pa.array(np.arange(n + 1) * keys.shape[1], pa.int32())
            small = (mix(signature) & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("_h"), pa.array(np.arange(row, row + n)), pa.array(size.astype(np.int64)),
                    pa.array(signed(prints[0])), pa.array(signed(prints[1])),
                    pa.ListArray.from_arrays(ends, pa.array(signed(keys.ravel()))),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                ],
                schema.names,
            )
            row += n

    return written(docs.select("doc_id", "_h", "text").mapInArrow(sketched, schema), "signed")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end with the end of a group of equal (key, part), and the starts of the groups."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        key, part = (batch.column(x).to_numpy() for x in ("key", "part"))
        edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        if len(edges):
            yield batch.slice(0, edges[-1]), np.append(0, edges[:-1])
            rest = batch.slice(edges[-1])
        else:
            rest = batch
    if rest is not None:
        yield rest, np.array([0])


def _agreement(sketch: np.ndarray, one: np.ndarray, n: np.ndarray, n_one: int) -> np.ndarray:
    """Share of equal values with `one`, corrected for chance; 0 if the sizes exclude a link."""
    same = ((sketch == one).mean(axis=1) * 256 - 1) / 255
    fits = 100 * np.minimum(n, n_one) >= PERCENT * np.maximum(n, n_one)
    return np.where(fits, same, 0)


def _forest(sketch: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the most agreeing pairs, at least LEAST_AGREEMENT."""
    count = len(n)
    best, parent = np.full(count, -1.0), np.zeros(count, np.int64)
    out, left = [], np.ones(count, bool)
    at = 0
    for _ in range(count):
        if best[at] >= LEAST_AGREEMENT:
            out.append((parent[at], at))
        left[at] = False
        near = np.where(left, _agreement(sketch, sketch[at], n, n[at]), -1)
        closer = near > best
        best[closer], parent[closer] = near[closer], at
        if not left.any():
            break
        at = int(np.where(left, best, -2).argmax())
    return out


def _questioned(sketch: np.ndarray, n: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Members that agree enough with one of another component."""
    _, which = np.unique(component, return_inverse=True)
    largest = np.bincount(which).argmax()
    out = np.zeros(len(n), bool)
    for i in np.flatnonzero(which != largest):
        near = (_agreement(sketch, sketch[i], n, n[i]) >= LEAST_AGREEMENT) & (which != which[i])
        out |= near
        out[i] |= near.any()
    return out


def _links(items: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Links that join different components, found on full sets: a member's elements are looked up among those of all
    members at once, so its intersections with all of them are counted together."""
    _, which = np.unique(component, return_inverse=True)
    largest = np.bincount(which).argmax()
    sizes = np.array([len(x) for x in items])
    everything = np.concatenate(items)
    order = np.argsort(everything)
    sorted_items, owner = everything[order], np.repeat(np.arange(len(items)), sizes)[order]
    out = []
    for i in np.flatnonzero(which != largest):
        low, high = np.searchsorted(sorted_items, items[i]), np.searchsorted(sorted_items, items[i], "right")
        held = np.repeat(low - np.append(0, np.cumsum(high - low)[:-1]), high - low) + np.arange((high - low).sum())
        both = np.bincount(owner[held], minlength=len(items))
        linked = 100 * both >= PERCENT * (sizes + sizes[i] - both)
        for j in np.flatnonzero(linked):
            if which[j] != which[i]:
                out.append((i, j))
                which[which == which[j]] = which[i]
    return out


def _placed(members: DataFrame) -> DataFrame:
    """The members of each (key, part) one after the other in one partition."""
    return members.repartition("key", "part").sortWithinPartitions("key", "part", "node")


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _pairs(node: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    """Distinct pairs (a, b) of nodes, a < b."""
    ends = node[np.array(found, np.int64).reshape(-1, 2)]
    pairs = np.unique(np.sort(ends, axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _candidates(members: DataFrame) -> DataFrame:
    """The likeliest links (a, b) in every part of members (key, part, node, n, sketch): a forest of each part."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches):
            node, n, sketch = batch.column("node").to_numpy(), batch.column("n").to_numpy(), _sketches(batch)
            ends = np.append(starts[1:], len(node))
            two = starts[ends - starts == 2]
            same = ((sketch[two] == sketch[two + 1]).mean(axis=1) * 256 - 1) / 255 if len(two) else np.zeros(0)
            n1, n2 = n[two], n[two + 1]
            fits = (same >= LEAST_AGREEMENT) & (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2))
            found = [(i, i + 1) for i in two[fits]]
            for s, e in zip(starts, ends):
                if e - s > 2:
                    found += [(s + i, s + j) for i, j in _forest(sketch[s:e], n[s:e])]
            yield _pairs(node, found)

    return _placed(members).mapInArrow(paired, "a long, b long").distinct()


def _unsettled(members: DataFrame) -> DataFrame:
    """(key, node, n, root) of members (key, part, node, n, sketch, root) that may have a link to another component."""

    def questioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches):
            n, root, sketch = batch.column("n").to_numpy(), batch.column("root").to_numpy(), _sketches(batch)
            take = np.zeros(len(n), bool)
            for s, e in zip(starts, np.append(starts[1:], len(n))):
                take[s:e] = _questioned(sketch[s:e], n[s:e], root[s:e])
            yield batch.select(["key", "node", "n", "root"]).filter(pa.array(take))

    return _placed(members).mapInArrow(questioned, "key long, node long, n long, root long").distinct()


def _joining(members: DataFrame) -> DataFrame:
    """Links (a, b) between components in the parts of members (key, part, node, root, items)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches):
            node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            items = [np.frombuffer(x.as_buffer(), U64) for x in batch.column("items")]
            found = []
            for s, e in zip(starts, np.append(starts[1:], len(node))):
                found += [(s + i, s + j) for i, j in _links(items[s:e], root[s:e])]
            yield _pairs(node, found)

    columns = members.select("key", "part", "node", "root", "items")
    return _placed(columns).mapInArrow(joined, "a long, b long").distinct()


def _sets(ends: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items) with the full set of every node in ends. docs come from with_key; nodes have (node, doc_id, _h)."""
    wanted = written(nodes.join(ends.distinct(), "node").select("node", "doc_id", "_h"), "wanted")
    # Rows with one key are equal, so any of them will do.
    listed = wanted.groupBy("doc_id", "_h").agg(F.min("node").alias("_node"))
    texts = with_lists(passing(docs, key_filter(wanted), True), listed, "_node").where("_node IS NOT NULL")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 18):
            hashes, offsets = shingle_sets(batch)
            found = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_node"), pa.array(found, pa.binary())], ["node", "items"])

    full = texts.select("text", "_node").mapInArrow(sets, "node long, items binary")
    return written(full.dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    full = _sets(ends, docs, nodes)
    left = full.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = full.select(F.col("node").alias("b"), F.col("items").alias("items_b"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("items_a"), batch.column("items_b"))):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b").mapInArrow(similar, "a long, b long")


def _dealt(members: DataFrame, chunks: Column) -> DataFrame:
    """members (key, node, least, ...) with `part`: a bucket's members in `chunks` chunks, each also with the
    bucket's first member `least`."""
    own = F.pmod(F.xxhash64("node"), chunks).cast("long")
    every = F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)
    return members.withColumn("part", F.explode(F.when(F.col("node") == F.col("least"), every).otherwise(F.array(own))))


def _tally(members: DataFrame) -> DataFrame:
    """key, its members and their elements (total, items_total), the component with the most of them (largest), and
    the members and elements outside of it (outside, items_outside), of members (key, node, n, root)."""
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("_rows"), F.sum("n").alias("_items"))
    order = F.struct("_rows", "root")
    return by_root.groupBy("key").agg(
        F.sum("_rows").alias("total"), F.sum("_items").alias("items_total"), F.max_by("root", order).alias("largest"),
        (F.sum("_rows") - F.max("_rows")).alias("outside"),
        (F.sum("_items") - F.max_by("_items", order)).alias("items_outside"),
    )


def _met(members: DataFrame, chunks: Column, chunks_outside: Column) -> DataFrame:
    """members (key, node, root, and _tally's columns) with `part`, so that all pairs of two components share one. Of
    such a pair one is outside the largest component: a part is a chunk of all members and a chunk of those outside, so
    members of the largest are repeated only for chunks of the others, be they ever so many."""
    wide = F.lit(1 << 32)
    own, away = (F.pmod(F.xxhash64("node"), n).cast("long") for n in (chunks, chunks_outside))
    every, every_outside = (F.sequence(F.lit(0).cast("long"), n.cast("long") - 1) for n in (chunks, chunks_outside))
    meets = F.transform(every_outside, lambda o: own * wide + o)
    asks = F.transform(every, lambda c: c * wide + away)
    parts = F.when(F.col("root") == F.col("largest"), meets).otherwise(F.array_union(meets, asks))
    return members.withColumn("part", F.explode(parts))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and _h for each row of docs; _h is text_key() of the row."""
    keyed = with_key(docs.select("doc_id", "text"))
    rows = signed_sets(keyed)
    linkable = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(
        linkable.groupBy("f1", "f2").agg(F.min("row").alias("node"), F.min("doc_id").alias("label")), "sets-of"
    )
    nodes = written(
        rows.join(classes.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node"), "nodes"
    )
    keys = nodes.select("node", F.explode("bands").alias("key"))
    busy = keys.groupBy("key").agg(F.count("*").alias("total"), F.min("node").alias("least")).where("total > 1")
    members = written(keys.join(written(busy, "busy"), "key"), "members")
    described = written(members.join(nodes.select("node", "n", "sketch"), "node"), "described")
    by_count = F.ceil(F.col("total") / CHUNK)
    forest = written(_candidates(_dealt(described, by_count)), "forest")
    links = written(_confirmed(forest, keyed, nodes), "links")
    roots = written(components(links), "roots")
    # What is still apart in a bucket and may be linked. The one pair of a bucket of two is settled.
    placed = described.where("total > 2").drop("total").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_members = placed.join(written(_tally(placed).where("outside > 0"), "apart"), "key")
    outside_by_count = F.ceil(F.col("outside") / CHUNK)
    unsettled = written(_unsettled(_met(open_members, by_count, outside_by_count)), "unsettled")
    weighed = unsettled.join(written(_tally(unsettled).where("outside > 0"), "weights"), "key")
    by_size = F.greatest(by_count, F.ceil(F.col("items_total") / CHUNK_ITEMS))
    outside_by_size = F.greatest(outside_by_count, F.ceil(F.col("items_outside") / CHUNK_ITEMS))
    questions = _met(weighed, by_size, outside_by_size).select("key", "part", "node", "root")
    full = _sets(unsettled.select("node"), keyed, nodes)
    more_links = written(_joining(questions.join(full, "node")), "more-links")
    all_roots = written(merged_components(roots, more_links), "all-roots")
    rooted = classes.join(all_roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    labels = written(rooted.groupBy("root").agg(F.min("label").alias("component")), "labels")
    of_set = written(rooted.join(labels, "root").select("f1", "f2", "component"), "of-set")
    found = rows.select("doc_id", "_h", "n", "f1", "f2").join(of_set, ["f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "_h",
    )
