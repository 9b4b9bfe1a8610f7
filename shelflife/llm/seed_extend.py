"""Substring dedup by seed and extend, on words.

Seeds are winnowed anchors: the least 16-word gram of every 50-word window. Documents meet on
equal seeds only. A seed is extended both ways to the windows around it, in steps of
cells of offsets, against one member of each class of equal surroundings; the
extents found form maximal repeats, and all their words go but those of the
document with the smallest id (see windows.py).

A null or empty text has no words and stays as it is; so does a text shorter than a window. A
row with a null id is compared with nothing. Rows with equal ids don't count as earlier
than each other: both stay. Other columns pass through, but one named `repeats` is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from shelflife.llm.scratch import boxed, unboxed
from shelflife.llm.text import U64, Words, text_of
from shelflife.llm.windows import Shape, cut_spans, merged, repeated_spans, with_key

WINDOW = 50
SEED = 16


def word_symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = Words(*text_of(batch))
    return words.hashes() if len(words) else np.zeros(0, U64), words.rows


def shape(window: int = WINDOW, seed: int = SEED) -> Shape:
    return Shape(window, seed, (6, 1), np.uint64, earlier_only=True)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs' columns, with text cut, and n_words, n_removed and removed (spans of
    removed words as [start, end) numbers of the input's words) in `repeats`."""
    box = boxed(docs, "doc_id", "text")
    fields = box.schema.fields
    long = LongType()
    span = StructType([StructField("start", long), StructField("end", long)])
    repeats = StructType(
        [StructField("n_words", long), StructField("n_removed", long), StructField("removed", ArrayType(span))]
    )
    schema = StructType([*fields, StructField("repeats", repeats)])

    def cut(batch: pa.RecordBatch, covered: list) -> pa.RecordBatch:
        data, offsets = text_of(batch)
        words = Words(data, offsets)
        kept, counts, removed, spans = [], np.diff(words.rows), np.zeros(batch.num_rows, np.int64), []
        for r, (starts, ends) in enumerate(covered):
            gone = merged(starts, ends, counts[r])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            removed[r] = gone.sum()
            first, last = offsets[r], offsets[r + 1]
            # A word goes with the white space up to the next word.
            begins = np.append(words.starts[words.rows[r] : words.rows[r + 1]], last)
            parts, at = [], first
            for a, b in zip(edges[::2], edges[1::2]):
                parts.append(data[at : begins[a]].tobytes())
                at = begins[b]
            parts.append(data[at:last].tobytes())
            kept.append(b"".join(parts))
        text = pa.array(kept, pa.binary()).cast(pa.string())
        if batch.column("text").null_count:
            text = pc.if_else(batch.column("text").is_valid(), text, None)
        columns = [text if f.name == "text" else batch.column(f.name) for f in fields]
        counted = pa.StructArray.from_arrays(
            [pa.array(counts.astype(np.int64)), pa.array(removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["n_words", "n_removed", "removed"],
        )
        return pa.RecordBatch.from_arrays([*columns, counted], schema.names)

    keyed = with_key(box)
    found = repeated_spans(keyed.select("doc_id", "text", "_h", "_slot"), word_symbols, shape(window, seed))
    columns = [c for c in docs.columns if c != "repeats"]
    return unboxed(cut_spans(keyed, found, cut, schema), columns, ("doc_id", "text"), "repeats")
