"""Sum-of-squares online packing of token sequences into windows.

Each partition of the documents is a shard that packs what it reads, in reading
order. A document is cut into full windows and a rest; the rest goes to the fill
level that leaves the smallest sum of squared counts of partially filled windows.
Levels, counts and the open windows of a level are an array over 0..length.
At the end of a shard, and when they hold more than `MOST_OPEN` tokens, the open
windows are joined and cut again, which leaves one partially filled window at most.

A null or empty text is one piece with the end token. Repeated rows and repeated
doc_ids are packed one by one. An empty table gives no pieces. Only doc_id and
text are read, so other columns may have any names. The name of an added
token in a text is that token with json_encoder, and ordinary text with public_encoder.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelflife.llm.scratch import text_batches
from shelflife.llm.text import pieces

LENGTH = 2048
END_TOKEN = 1
#: Tokens in open windows beyond which a shard joins and cuts them early.
MOST_OPEN = 1 << 22
#: Sequence ids of one shard.
SHARD_SPAN = 1 << 40

PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class RankEncoder:
    """Token ids (little-endian unsigned 32-bit) of whole texts by a vocabulary of ranks. Names of `added`
    tokens are cut out first, the longest at each place, and stand for their ids."""

    def __init__(self, ranks_file: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._ids = coding.encode_ordinary
        self._added = {name: [i] for name, i in (added or {}).items()}
        self._names = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> bytes:
        ids = self._ids(text) if not any(name in text for name in self._added) else self._around(text)
        return np.array(ids, "<u4").tobytes()

    def _around(self, text: str) -> list[int]:
        parts = self._names.split(text)
        return [i for k, part in enumerate(parts) for i in (self._added[part] if k % 2 else self._ids(part))]


class Levels:
    """Open windows by fill level, and the sum-of-squares rule."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(length + 1)]

    def place(self, size: int, item) -> list | None:
        """Put an item of 0 < size < length into the best window; the window's items if that fills it.

        Moving a window from level h to h + size changes the sum of squares by
        2 * (count[h + size] - count[h]) + 2; a new window by 2 * count[size] + 1; filling one
        by 1 - 2 * count[h]. Of equal choices the fullest window is taken."""
        counts, length = self.counts, self.length
        full = length - size
        level, least = 0, 2 * counts[size] + 1
        if full > 1:
            open_levels = counts[1:full]
            change = np.where(open_levels > 0, 2 * (counts[1 + size : length] - open_levels) + 2, np.iinfo(np.int64).max)
            at = full - 2 - int(change[::-1].argmin())
            if change[at] <= least:
                level, least = at + 1, change[at]
        if counts[full] and 1 - 2 * counts[full] <= least:
            level = full
        window = []
        if level:
            window = self.windows[level].pop()
            counts[level] -= 1
        window.append(item)
        if level + size == length:
            return window
        self.windows[level + size].append(window)
        counts[level + size] += 1
        return None

    def drain(self) -> Iterator:
        """All items in open windows, fullest windows first."""
        for level in range(self.length - 1, 0, -1):
            for window in self.windows[level]:
                yield from window
            self.windows[level] = []
            self.counts[level] = 0


class Shard:
    """Packs (key, ids) in order; `ready` collects finished pieces as tuples
    (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, first_sequence: int):
        self.levels = Levels(length)
        self.length = length
        self.sequence = first_sequence
        self.ready: list[tuple] = []
        self.open_tokens = 0

    def _close(self, items: list) -> None:
        offset = 0
        for key, start, ids, total in items:
            self.ready.append((key, start, ids, total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, key, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.length
        whole = len(ids) - len(ids) % width
        for at in range(0, whole, width):
            self._close([(key, at // 4, ids[at : at + width], total)])
        if whole < len(ids):
            item = (key, whole // 4, ids[whole:], total)
            self.open_tokens += total - whole // 4
            if (filled := self.levels.place(total - whole // 4, item)) is not None:
                self._close(filled)
                self.open_tokens -= self.length
            if self.open_tokens > MOST_OPEN:
                self.end()

    def end(self) -> None:
        """Join the open windows' items and cut them into windows."""
        window, room, self.open_tokens = [], 4 * self.length, 0
        for key, start, ids, total in self.levels.drain():
            while ids:
                part, ids = ids[:room], ids[room:]
                window.append((key, start, part, total))
                start += len(part) // 4
                room -= len(part)
                if not room:
                    self._close(window)
                    window, room = [], 4 * self.length
        if window:
            self._close(window)


def pack(
    docs: DataFrame,
    encoder: Callable[[], RankEncoder],
    length: int = LENGTH,
    end_token: int = END_TOKEN,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and the
    piece's ids (binary, little-endian unsigned 32-bit). encoder() is called
    once in each task."""
    text_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_token], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        shard = Shard(length, TaskContext.get().partitionId() * SHARD_SPAN)
        id_field = None

        def out() -> pa.RecordBatch:
            key, start, ids, total, sequence, offset = zip(*shard.ready)
            shard.ready.clear()
            whole = [pa.array(x, pa.int64()) for x in (start, [len(i) // 4 for i in ids], total, sequence, offset)]
            return pa.RecordBatch.from_arrays(
                [pa.array(key, id_field), *whole, pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in pieces(batches):
            id_field = batch.schema.field("doc_id").type
            keys = batch.column("doc_id").to_pylist()
            for key, text in zip(keys, batch.column("text")):
                shard.add(key, (coder.encode(text.as_py() or "") + end))
            if shard.ready:
                yield out()
        shard.end()
        if shard.ready:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(packed, f"doc_id {id_type}, {PIECES}")


def public_encoder() -> RankEncoder:
    """The encoder of the public 50k byte-level vocabulary; its rank file holds
    the same vocabulary as byte_bpe_50k.json."""
    import public_tokenizers

    return RankEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def json_encoder() -> RankEncoder:
    """The encoder whose ids are those of `tokenizers` with byte_bpe_50k.json and add_special_tokens=False,
    which finds the file's added tokens inside a text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that depend on what is beside them aren't built")
    ids = {token["content"]: token["id"] for token in added}
    return RankEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=ids)
