"""Repeated windows: which windows of W symbols of a text are found elsewhere.

Every window has an anchor: the gram of q symbols in it with the least hash, the
leftmost of equal ones. Equal windows have equal anchors at equal places,
so only windows of one anchor need comparing. Neighbouring windows with the same
anchor are one run, the unit that is stored: anchor, identity of the text that its windows
cover, and place.

Runs of one identity form a class. A class with another member elsewhere is
settled at once, however many copies there are. Where an anchor has several classes, the windows of one
member of each are compared in cells of offsets from the anchor: all windows
of a cell share a core; a core found nowhere else settles its cell as single,
equal texts of whole cells settle them as repeated, and what is left is split into smaller cells down to single windows.
All comparisons are counts or minima by key, so no pairs are made and hot keys are summed before
they are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from shelflife.llm.scratch import text_batches, written
from shelflife.llm.text import U64, Spans, byte_symbols, mix, pieces, signed

#: Symbols of a row batch, and the offsets of its rows in them.
SymbolsOf = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]

_CHUNK = 1 << 21
_PLACE_BITS = U64(24)
#: Bits of the filter that keeps documents without work out of shuffles.
FILTER_BITS = 1 << 24


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int
    #: Sizes of cells, largest first, the last 1.
    cells: tuple[int, ...]
    #: Stored symbols: np.uint8 for bytes, or 64-bit hashes.
    kind: type
    #: Only texts with a smaller doc_id count as elsewhere; else any other place does.
    earlier_only: bool


@dataclass
class Runs:
    row: np.ndarray
    start: np.ndarray  # of the first window, within the row
    windows: np.ndarray
    times: np.ndarray  # equal runs that follow one another, as in a text with a period
    offset: np.ndarray  # anchor's place after the first window's start
    anchor: np.ndarray
    identity: np.ndarray


def values(symbols: np.ndarray) -> np.ndarray:
    return byte_symbols(symbols) if symbols.dtype == np.uint8 else symbols


def find_runs(symbols: np.ndarray, offsets: np.ndarray, shape: Shape) -> Runs:
    parts = []
    for begin in range(0, max(1, len(symbols)), _CHUNK):
        # Windows that start in the chunk; runs may end at its edge.
        piece = symbols[begin : begin + _CHUNK + shape.window - 1]
        parts.append(_runs_of(piece, begin, offsets, shape))
    joined = [np.concatenate(x) for x in zip(*parts)]
    return Runs(*joined)


def _runs_of(symbols: np.ndarray, begin: int, offsets: np.ndarray, shape: Shape) -> tuple:
    n, width = len(symbols), shape.window - shape.gram + 1
    none = tuple(np.zeros(0, kind) for kind in (np.int64,) * 5 + (U64, U64))
    lengths = np.diff(offsets)
    first = np.clip(offsets[:-1] - begin, 0, _CHUNK)
    last = np.clip(offsets[1:] - shape.window + 1 - begin, 0, min(_CHUNK, max(0, n - shape.window + 1)))
    long = (lengths >= shape.window) & (last > first)
    if not long.any():
        return none
    marks = np.zeros(n + 1, np.int8)
    np.add.at(marks, first[long], 1)
    np.add.at(marks, last[long], -1)
    starts = np.flatnonzero(np.cumsum(marks[:-1]))
    spans = Spans(values(symbols))
    grams = spans.grams(shape.gram)
    keys = ((grams >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(grams), dtype=U64)
    place = (_sliding_least(keys, width)[starts] & U64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    start, place = starts[at], place[at]
    row = np.searchsorted(offsets, start + begin, "right") - 1
    anchor = grams[place]
    identity = spans.hashes(start, start + count - 1 + shape.window)
    identity = mix(identity + (place - start).astype(U64) * U64(0x9E3779B97F4A7C15) + count.astype(U64))
    # Equal neighbours, each starting where the one before it ends, are one row.
    head = np.ones(len(start), bool)
    head[1:] = (identity[1:] != identity[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1])
    heads = np.flatnonzero(head)
    times = np.diff(np.append(heads, len(start)))
    return (
        row[heads], (start + begin - offsets[row])[heads], count[heads], times,
        (place - start)[heads], anchor[heads], identity[heads],
    )


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours: within blocks of that width, the least so far from either side."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], upto[width - 1 : n])


def text_key() -> Column:
    """With doc_id it tells the texts of a table apart."""
    return F.xxhash64(F.col("text"), F.col("doc_id").isNull())


def with_key(docs: DataFrame) -> DataFrame:
    """docs with `_h`, the text_key, and `_slot`, the row's place in the filter."""
    text_batches(docs.sparkSession)
    keyed = docs.withColumn("_h", text_key())
    return keyed.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(FILTER_BITS)).cast("int"))


def _of(field: StructField, name: str) -> StructField:
    return StructField(name, field.dataType)


def stored_runs(docs: DataFrame, symbols_of: SymbolsOf, shape: Shape) -> DataFrame:
    id_field = docs.schema["doc_id"]
    long, small = LongType(), IntegerType()
    schema = StructType([_of(id_field, "doc_id"), StructField("_h", long)])
    for name in ("run", "anchor", "identity"):
        schema = schema.add(name, long)
    for name in ("start", "windows", "times", "offset"):
        schema = schema.add(name, small)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in pieces(batches, 1 << 18):
            runs = find_runs(*symbols_of(batch), shape)
            n, row = len(runs.row), pa.array(runs.row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(row), batch.column("_h").take(row),
                    pa.array(np.arange(number, number + n)), pa.array(signed(runs.anchor)), pa.array(signed(runs.identity)),
                    *[pa.array(x.astype(np.int32)) for x in (runs.start, runs.windows, runs.times, runs.offset)],
                ],
                schema.names,
            )
            number += n

    return written(docs.select("doc_id", "_h", "text").mapInArrow(seeded, schema), "runs")


def elsewhere(shape: Shape, own: Column) -> Column:
    """With `first`, `last` of all holders of a key: is there one that counts beside `own`?"""
    return (F.col("first") < own) if shape.earlier_only else (F.col("first") < F.col("last"))


def repeated_spans(docs: DataFrame, symbols_of: SymbolsOf, shape: Shape) -> DataFrame:
    """(doc_id, _h, start, end): symbols covered by repeated windows; docs come from with_key."""
    runs = stored_runs(docs.where("doc_id IS NOT NULL") if shape.earlier_only else docs, symbols_of, shape)
    holder = F.col("doc_id") if shape.earlier_only else F.col("run")
    # A run that follows its equal in one text counts as two holders.
    other = holder if shape.earlier_only else F.when(F.col("times") > 1, F.col("run") + 1).otherwise(F.col("run"))
    classes = runs.groupBy("anchor", "identity").agg(F.min(holder).alias("first"), F.max(other).alias("last"))
    classes = written(classes, "classes")
    several = classes.groupBy("anchor").agg(
        F.count("*").alias("_n"), F.min("first").alias("_low"), F.max("first").alias("_high")
    )
    several = written(several.where("_n > 1 AND _low < _high").select("anchor"), "anchors").withColumn("open", F.lit(True))
    marked = classes.join(several, "anchor", "left").where("open OR first < last")
    found = runs.join(written(marked, "marked"), ["anchor", "identity"]).where(
        elsewhere(shape, holder) | (F.col("open") & (holder == F.col("first")))
    )
    found = written(found.withColumn("settled", elsewhere(shape, holder)), "found")
    width = F.col("windows") * F.col("times") + shape.window - 1
    settled = found.where("settled").select("doc_id", "_h", "start", (F.col("start") + width).alias("end"))
    # One member of each class, settled or not, stands for it where others are compared.
    waiting = found.where(F.col("open") & (F.col("first") == holder))
    return settled.unionByName(_refined(docs, waiting, symbols_of, shape, holder))


def _refined(docs: DataFrame, waiting: DataFrame, symbols_of: SymbolsOf, shape: Shape, holder: Column) -> DataFrame:
    """Spans of repeated windows among one run of each class of the open anchors."""
    place = waiting.select("run", "doc_id", "_h", (F.col("start") + F.col("offset")).alias("_place"))
    texts = _texts(docs, waiting, symbols_of, shape, holder)
    found = []
    cells = texts
    for size in shape.cells:
        compared = written(cells.mapInArrow(_compare(shape, size), _compared(cells.schema)), f"cells-{size}")
        whole = compared.where("whole IS NOT NULL").groupBy("anchor", "whole").agg(
            F.min("holder").alias("first"), F.max("holder").alias("last")
        )
        whole = written(whole.where("first < last"), "wholes")
        live = compared.withColumn("mixed", F.lit(False))
        if size > 1:
            # A core that one holder has alone settles its cell; so does one whose cells are all equal.
            core = compared.groupBy("anchor", "core").agg(
                F.min("holder").alias("_low"), F.max("holder").alias("_high"),
                ((F.count("whole") < F.count("*")) | (F.min("whole") < F.max("whole"))).alias("mixed"),
            )
            core = written(core.where("_low < _high").drop("_low", "_high"), "cores")
            live = compared.join(core, ["anchor", "core"])
        judged = live.join(whole, ["anchor", "whole"], "left" if size > 1 else "inner")
        judged = written(
            judged.select(
                "run", "low", "high",
                F.coalesce(elsewhere(shape, F.col("holder")), F.lit(False)).alias("dup"),
                # Of equal cells one stands for all in the next comparison.
                (F.col("mixed") & F.coalesce(F.col("holder") == F.col("first"), F.lit(True))).alias("next"),
            ),
            "judged",
        )
        found.append(judged.where("dup").select("run", "low", "high"))
        if size > 1:
            open_cells = judged.where("next").select("run", F.col("low").alias("_low"), F.col("high").alias("_high"))
            cells = cells.join(open_cells, "run").where("low <= _high AND _low <= high").withColumns(
                {"low": F.greatest("low", "_low"), "high": F.least("high", "_high")}
            ).drop("_low", "_high")
            if size != shape.cells[-2]:
                cells = written(cells.mapInArrow(_trim(shape), cells.schema), "texts")
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    return all_found.join(place, "run").select(
        "doc_id", "_h", (F.col("_place") - F.col("high")).alias("start"),
        (F.col("_place") - F.col("low") + shape.window).alias("end"),
    )


def _texts(docs: DataFrame, waiting: DataFrame, symbols_of: SymbolsOf, shape: Shape, holder: Column) -> DataFrame:
    """run, holder, anchor, low, high (offsets of the run's windows before the anchor), top
    and symbols (from the start of the window at offset `top`)."""
    listed = waiting.groupBy("doc_id", "_h").agg(
        F.collect_list(F.struct("run", "anchor", "start", "windows", "offset")).alias("_runs")
    )
    kept = passing(docs, key_filter(waiting), True)
    joined = with_lists(kept, listed, "_runs")
    holder_field = StructField("holder", docs.schema["doc_id"].dataType if shape.earlier_only else LongType())
    small = IntegerType()
    schema = StructType(
        [StructField("run", LongType()), holder_field, StructField("anchor", LongType())]
        + [StructField(x, small) for x in ("low", "high", "top")]
        + [StructField("symbols", BinaryType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 18):
            lists = batch.column("_runs")
            symbols, offsets = symbols_of(batch)
            runs = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            get = lambda x: runs.field(x).to_numpy(zero_copy_only=False).astype(np.int64)
            start, windows, offset = get("start"), get("windows"), get("offset")
            begin = offsets[row] + start
            texts = [symbols[b : b + w + shape.window - 1].tobytes() for b, w in zip(begin, windows)]
            holders = batch.column("doc_id").take(pa.array(row)) if shape.earlier_only else runs.field("run")
            low = (offset - windows + 1).astype(np.int32)
            top = pa.array(offset.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [runs.field("run"), holders, runs.field("anchor"), pa.array(low), top, top, pa.array(texts, pa.binary())],
                schema.names,
            )

    columns = ["doc_id", "text", "_runs"]
    return written(joined.select(*columns).mapInArrow(cut, schema), "texts")


def _symbols(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the column and the place of each row's first."""
    column = batch.column("symbols")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), (ends[:-1] - ends[0]) // kind.itemsize


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _compared(schema: StructType) -> StructType:
    long, small = LongType(), IntegerType()
    fields = [StructField("run", long), schema["holder"], StructField("anchor", long)]
    fields += [StructField(x, small) for x in ("low", "high")] + [StructField(x, long) for x in ("core", "whole")]
    return StructType(fields)


def _compare(shape: Shape, size: int) -> Callable:
    """Cells of `size` offsets of every row, with identities of their core and,
    if the row has all their windows, of the text that these cover."""
    window, most = shape.window, shape.window - shape.gram

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            symbols, begin = _symbols(batch, np.dtype(shape.kind))
            low, high, top = (batch.column(x).to_numpy().astype(np.int64) for x in ("low", "high", "top"))
            spans = Spans(values(symbols))
            cells = high // size - low // size + 1
            row = np.repeat(np.arange(batch.num_rows), cells)
            step = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
            cell = low[row] // size + step
            c_low, c_high = cell * size, np.minimum(cell * size + size - 1, most)
            zero = begin[row] + top[row]  # the anchor's place
            tag = (cell * 64 + size).astype(U64) * U64(0x9E3779B97F4A7C15)
            core = mix(spans.hashes(zero - c_low, zero - c_high + window) + tag)
            full = (c_low >= low[row]) & (c_high <= high[row])
            whole = np.zeros(len(row), U64)
            whole[full] = mix(spans.hashes((zero - c_high)[full], (zero - c_low)[full] + window) + tag[full] + U64(1))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("run").take(take), batch.column("holder").take(take), batch.column("anchor").take(take),
                    pa.array(np.maximum(c_low, low[row]).astype(np.int32)), pa.array(np.minimum(c_high, high[row]).astype(np.int32)),
                    pa.array(signed(core)), pa.array(signed(whole), mask=~full),
                ],
                ["run", "holder", "anchor", "low", "high", "core", "whole"],
            )

    return compare


def _trim(shape: Shape) -> Callable:
    """Keep the symbols that the windows in low..high and their cells' cores cover."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            symbols, begin = _symbols(batch, np.dtype(shape.kind))
            low, high, top = (batch.column(x).to_numpy().astype(np.int64) for x in ("low", "high", "top"))
            first, last = begin + top - high, begin + top - low + shape.window
            texts = [symbols[a:b].tobytes() for a, b in zip(first, last)]
            names = batch.schema.names
            columns = [batch.column(x) for x in names]
            columns[names.index("top")] = batch.column("high")
            columns[names.index("symbols")] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return trim


def key_filter(keyed: DataFrame) -> np.ndarray:
    """Bits of the (doc_id, _h) in keyed; as many bits at every size."""
    slots = keyed.select(F.pmod(F.xxhash64("doc_id", "_h"), F.lit(FILTER_BITS)).alias("_slot"))
    bit = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    rows = slots.groupBy(F.shiftright("_slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words


def _chosen(batches: Iterator[pa.RecordBatch], words: np.ndarray, wanted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = batch.column("_slot").to_numpy()
        yield batch.filter(pa.array(((words[slot >> 6] >> (slot & 63)) & 1 == 1) == wanted))


def passing(docs: DataFrame, bits: np.ndarray, wanted: bool) -> DataFrame:
    """The rows of docs whose key may be (wanted) or can't be (not wanted) in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    return docs.mapInArrow(lambda batches: _chosen(batches, shared.value, wanted), docs.schema)


def with_lists(docs: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """docs with the list of their (doc_id, _h) in listed, null without one."""
    right = listed.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), name)
    return docs.join(right, docs["doc_id"].eqNullSafe(right["_id"]) & (docs["_h"] == right["_hash"]), "left").drop("_id", "_hash")


def merged(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which of `length` symbols are covered by any span."""
    edges = np.zeros(length + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def cut_spans(docs: DataFrame, spans: DataFrame, cut: Callable, schema: StructType) -> DataFrame:
    """cut(batch, covered) for all docs (from with_key). covered: per row the (starts, ends) to remove.
    Only documents that may have spans are shuffled to meet them."""
    # Equal rows have equal spans: they are listed once, however often the row is there.
    listed = spans.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    bits = key_filter(spans)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 18):
            covered = [(np.zeros(0, np.int64),) * 2] * batch.num_rows
            if "_spans" in batch.schema.names:
                lists = batch.column("_spans")
                n = lists.value_lengths().fill_null(0).to_numpy()
                flat = lists.flatten()
                start, end = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "end"))
                to = np.cumsum(n)
                covered = [(start[t - k : t], end[t - k : t]) for k, t in zip(n, to)]
            yield cut(batch, covered)

    # One Python step for both: each has a worker of its own in every task.
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    untouched = docs.mapInArrow(lambda batches: removed(_chosen(batches, shared.value, False)), schema)
    touched = with_lists(passing(docs, bits, True), listed, "_spans").mapInArrow(removed, schema)
    return untouched.unionByName(touched)
