"""Exact removal of repeated byte strings by bucket refinement.

Every 400-byte string belongs to the bucket of its least 40-byte gram. Buckets with
several members are refined level by level, down to single strings (see windows.py). Singletons leave at
once, as do members that are equal in whole.

This isn't the refinement by pointers that the method is named after: a level compares hashes of the bytes around
the gram, in cells of 64, 8 and 1 offsets, and not the bucket identifiers of later offsets that the level before gave. Identifiers for all offsets
would need a row per byte and a shuffle of them all in each round; here a row stands for all strings around one gram.

Texts are UTF-8 bytes; a null text is empty. Strings never cross texts, and the same text
may hold both copies. Rows that are equal in full repeat each other, and all of both
goes. Rows with a null id take part. A cut may fall inside a character, so
what is left is binary. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructType

from shelflife.llm.text import text_of
from shelflife.llm.windows import Shape, cut_spans, merged, repeated_spans, with_key

WINDOW = 400
GRAM = 40


def byte_text(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_of(batch)


def shape(window: int = WINDOW, gram: int = GRAM) -> Shape:
    return Shape(window, gram, (64, 8, 1), np.uint8, earlier_only=False)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) for each row."""
    schema = StructType([docs.schema["doc_id"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, LongType())
    schema = schema.add("kept", BinaryType())

    def cut(batch: pa.RecordBatch, covered: list) -> pa.RecordBatch:
        data, offsets = text_of(batch)
        kept, removed, spans = [], [], []
        for r, (starts, ends) in enumerate(covered):
            text = data[offsets[r] : offsets[r + 1]]
            gone = merged(starts, ends, len(text))
            kept.append(text[~gone].tobytes() if len(starts) else text.tobytes())
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(kept, pa.binary()),
            ],
            schema.names,
        )

    keyed = with_key(docs.select("doc_id", "text"))
    found = repeated_spans(keyed, byte_text, shape(window, gram))
    return cut_spans(keyed, found, cut, schema)
