"""Language-model scores by a weighted backoff automaton.

States are the n-grams of the learned texts, all of them: those of one and two words are
contexts, those of up to three are arcs. An arc carries a discounted probability; where a
state has no arc for the next word, its failure arc leads to the state without the first word
and costs the state's backoff weight; the last state is the root, whose arcs are all words, by add-one counts.

No n-gram is left out, however rare. Texts are gathered into chunks of `chunk_tokens` tokens, each a
dictionary of its words and one number per token, written once. A chunk asks for what its states need
and is answered in three rounds: counts of its words and pairs; counts of its triples and, by word, the sums
that backoff weights are made of; these sums by pair. Then it has the part of the automaton that its texts visit,
and every text is read from left to right along it. A question is the sorted distinct hashes of a chunk,
dealt by hash into buckets of some `bucket_tokens` keys, so neither a frequent word nor a frequent context makes a bucket large:
a chunk asks for an n-gram once, however often it holds it, and sums by context are formed in the chunks,
each distinct arc in the one chunk that the bucket calls its owner. A pair that occurs once in all texts has one arc at most,
which the chunk knows, so only triples after pairs that occur again are asked for.

A null text is empty and has the end token alone. Rows where `learned` is false or null are scored but not
learned from. Repeated rows count as often as they occur and get equal scores. With nothing learned there is
only the unknown word. Ids needn't be unique, rows aren't told apart by them. N-grams are identified by
64-bit hashes. A text is scored as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from shelflife.llm.scratch import boxed, text_batches, unboxed, written
from shelflife.llm.text import U64, Words, mix, pieces, text_of

DISCOUNT = 0.5
CHUNK_TOKENS = 5 << 18
BUCKET_TOKENS = 1 << 20
#: Bytes of text that are worked on at once.
PIECE = 1 << 20

_END = U64(0x5E5E5E5E00000001)
_FIRST = U64(0x9E3779B97F4A7C15)
#: What a question is about; a bucket's number is _KIND times this, and its place.
_KIND = 1 << 40
_WORDS, _PAIRS, _TRIPLES, _AFTER_WORD, _AFTER_PAIR = range(5)
#: Marks of an answer: the chunk is the key's owner; the key occurs twice or more in all texts; some of that isn't learned.
_OWNER, _AGAIN, _OUTSIDE = 1, 2, 4
_COUNTS = (np.int64, np.uint8)
_SUMS = (np.int64, np.int64)
_QUESTION = "bucket long, chunk long, blob binary"
_ANSWER = "chunk long, bucket long, blob binary, n long, v long"


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text closed by the end token; offsets of the texts."""
    words = Words(*text_of(batch), lower=True)
    n = batch.num_rows
    offsets = words.rows + np.arange(n + 1)
    out = np.full(offsets[-1], _END, U64)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] - 1] = False
    out[inside] = words.hashes()
    return out, offsets


def joined_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    return mix(mix(first * _FIRST) + second)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte in order of significance and compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).ravel() for c in columns]
    return len(columns[0]).to_bytes(8, "little") + pa.compress(np.concatenate(planes).tobytes(), "zstd", asbytes=True)


def unpacked(blob: pa.BinaryScalar, *types: type) -> list[np.ndarray]:
    data = blob.as_py()
    n, widths = int.from_bytes(data[:8], "little"), [np.dtype(t).itemsize for t in types]
    planes = np.frombuffer(pa.decompress(data[8:], n * sum(widths), "zstd"), np.uint8).reshape(sum(widths), n)
    ends = np.cumsum(widths)
    return [np.ascontiguousarray(planes[e - w : e].T).view(t).ravel() for e, w, t in zip(ends, widths, types)]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each, and the number of each place's key."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[order[new]], order[new], number


def _asked(kind: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) for sorted keys and what is known of them, dealt by the keys' first bits."""
    place = ((keys >> U64(32)) * U64(buckets)) >> U64(32)
    edges = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(keys)) if len(keys) else []
    for a, b in zip(edges[:-1], edges[1:]):
        steps = np.diff(keys[a:b], prepend=U64(0))
        yield kind * _KIND + int(place[a]), packed(steps, *(c[a:b] for c in columns))


def _questions(chunk: int, asked: list[tuple[int, bytes]]) -> pa.Table:
    buckets, blobs = zip(*asked) if asked else ((), ())
    columns = [pa.array(buckets, pa.int64()), pa.array([chunk] * len(buckets), pa.int64()), pa.array(blobs, pa.binary())]
    return pa.table(columns, ["bucket", "chunk", "blob"])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _answer(questions: pa.Table) -> pa.Table:
    """The answers of one bucket, to each chunk for its keys in order. Chunks are taken in order, so that
    a task that runs again answers alike."""
    questions = questions.sort_by("chunk")
    bucket = questions.column("bucket")[0].as_py()
    blobs, chunks = questions.column("blob"), questions.column("chunk")
    sums = bucket // _KIND >= _AFTER_WORD
    known = [unpacked(b, U64, *(_SUMS if sums else (np.int32, np.int32))) for b in blobs]
    keys, one, two = (np.concatenate([np.cumsum(k[0]) if c == 0 else k[c] for k in known]) for c in range(3))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    starts, which = np.flatnonzero(new), np.cumsum(new) - 1
    one, two = (_sums(x[order].astype(np.int64), starts) for x in (one, two))
    if sums:
        answers = (one, two)
    else:
        answers = (one, (_AGAIN * (two > 1) + _OUTSIDE * (two > one)).astype(np.uint8))
    columns = [np.empty(len(keys), a.dtype) for a in answers]
    for column, answer in zip(columns, answers):
        column[order] = answer[which]
    if not sums:
        columns[1][order[starts]] |= _OWNER
    ends = np.cumsum([len(k[0]) for k in known])
    found = [packed(*(c[e - len(k[0]) : e] for c in columns)) for k, e in zip(known, ends)]
    totals = (int(one.sum()), int((one > 0).sum())) if bucket // _KIND == _WORDS else (0, 0)
    rest = [pa.array([t] + [0] * (len(found) - 1), pa.int64()) for t in totals]
    same = pa.array([bucket] * len(found), pa.int64())
    return pa.table([chunks, same, pa.array(found, pa.binary()), *rest], ["chunk", "bucket", "blob", "n", "v"])


def _answers(questions: DataFrame, name: str) -> DataFrame:
    """The questions of all chunks, answered bucket by bucket."""
    return written(questions.groupBy("bucket").applyInArrow(_answer, _ANSWER), name, "zstd", freed=True)


@dataclass
class Chunk:
    """The texts of one chunk: words are the distinct hashes, most frequent first, ids the tokens' numbers in them."""

    words: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    learned: np.ndarray

    @classmethod
    def of(cls, row: pa.Table) -> Chunk:
        field = lambda name, kind: unpacked(row.column(name)[0], kind)[0]
        return cls(field("words", U64), field("ids", np.int32), field("sizes", np.int64), field("learned", np.bool_))

    def __post_init__(self):
        self.offsets = np.append(0, np.cumsum(self.sizes))
        self.place = np.arange(len(self.ids)) - np.repeat(self.offsets[:-1], self.sizes)
        self.counts = np.repeat(self.learned, self.sizes)  # whether a token is learned from
        self.order = np.argsort(self.words)
        # Pairs: the tokens at which one ends, their distinct keys, one's place, and each token's number.
        self.second = np.flatnonzero(self.place >= 1)
        keys = joined_keys(self.words[self.ids[self.second - 1]], self.words[self.ids[self.second]])
        self.pairs, at, number = _distinct(keys)
        self.first, self.last = self.ids[self.second[at] - 1], self.ids[self.second[at]]
        self.pair_of = np.zeros(len(self.ids), np.int32)
        self.pair_of[self.second] = number

    def tallies(self, number: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
        """Learned and all occurrences of n keys, from the key's number of each of the tokens `at`."""
        return [np.bincount(x, minlength=n).astype(np.int32) for x in (number[self.counts[at]], number)]

    def hear(self, answers: pa.Table) -> None:
        """Answers of every round so far, in the order of the questions."""
        answers = answers.sort_by("bucket")
        kinds = answers.column("bucket").to_numpy() // _KIND
        blobs = answers.column("blob")

        def of(kind: int, types: tuple[type, ...]) -> list[np.ndarray]:
            known = [unpacked(blobs[int(i)], *types) for i in np.flatnonzero(kinds == kind)]
            return [np.concatenate([np.zeros(0, t), *(k[c] for k in known)]) for c, t in enumerate(types)]

        n, marks = of(_WORDS, _COUNTS)
        self.word_n, self.word_marks = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.uint8)
        self.word_n[self.order], self.word_marks[self.order] = n, marks
        self.pair_n, self.pair_marks = of(_PAIRS, _COUNTS)
        self.heard = of

    def ask_triples(self) -> None:
        """The tokens whose state is a pair of learned texts that occurs again, and their distinct triples."""
        third = np.flatnonzero(self.place >= 2)
        state = self.pair_of[third - 1]
        self.after = third[(self.pair_n[state] > 0) & (self.pair_marks[state] & _AGAIN > 0)]
        keys = joined_keys(self.pairs[self.pair_of[self.after - 1]], self.words[self.ids[self.after]])
        self.triples, at, self.triple_of = _distinct(keys)
        self.state, self.lower = self.pair_of[self.after[at] - 1], self.pair_of[self.after[at]]

    def pair_p(self) -> np.ndarray:
        """Probabilities of the arcs of one-word states."""
        return np.maximum(self.pair_n - DISCOUNT, 0) / np.maximum(self.word_n[self.first], 1)

    def sums(self, context: np.ndarray, owned: np.ndarray, lower: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """(context, arcs, their counts in the next state) from the arcs this chunk owns, for contexts that have some
        or are wanted. Whole numbers, so that the order in which they are added doesn't matter."""
        arcs, below = np.bincount(context[owned], minlength=len(wanted)), np.zeros(len(wanted), np.int64)
        np.add.at(below, context[owned], lower[owned])
        at = np.flatnonzero(wanted | (arcs > 0))
        return at, arcs[at], below[at]


def _failure(total: np.ndarray, arcs: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 weight of the failure arcs of states: what their arcs leave, over what these leave in the next state."""
    left = np.maximum(DISCOUNT * arcs / np.maximum(total, 1), 1e-9)
    return np.where(arcs > 0, np.log10(np.where(arcs > 0, left, 1) / np.maximum(1 - lower, 1e-9)), 0.0)


class Model:
    """What all chunks share: the numbers of tokens and words that were learned, and of buckets."""

    def __init__(self, buckets: int, tokens: int = 0, distinct: int = 0):
        self.buckets, self.tokens, self.distinct = buckets, tokens, distinct

    def root(self, chunk: Chunk) -> np.ndarray:
        return (chunk.word_n + 1) / (self.tokens + self.distinct + 1)

    def counts(self, chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        """First round: words and pairs, with their occurrences in the chunk."""
        every = np.arange(len(chunk.ids))
        words = [c[chunk.order] for c in chunk.tallies(chunk.ids, every, len(chunk.words))]
        yield from _asked(_WORDS, self.buckets, chunk.words[chunk.order], *words)
        pairs = chunk.tallies(chunk.pair_of[chunk.second], chunk.second, len(chunk.pairs))
        yield from _asked(_PAIRS, self.buckets, chunk.pairs, *pairs)

    def _words(self, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """One-word states that a text can leave by a failure arc, in the order of their hashes."""
        failing = np.zeros(len(chunk.words), bool)
        failing[chunk.first[chunk.pair_n == 0]] = True
        owned = (chunk.pair_marks & _OWNER > 0) & (chunk.pair_n > 0) & (chunk.word_marks[chunk.first] & _OUTSIDE > 0)
        at, *sums = chunk.sums(chunk.first, owned, chunk.word_n[chunk.last] + 1, failing & (chunk.word_n > 0))
        order = np.argsort(chunk.words[at])
        return at[order], *(x[order] for x in sums)

    def arcs(self, chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        """Second round: triples, and sums over the arcs of words that a text can leave by a failure arc."""
        chunk.ask_triples()
        yield from _asked(_TRIPLES, self.buckets, chunk.triples, *chunk.tallies(chunk.triple_of, chunk.after, len(chunk.triples)))
        at, *sums = self._words(chunk)
        yield from _asked(_AFTER_WORD, self.buckets, chunk.words[at], *sums)

    def _pairs(self, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """Two-word states that a text can leave by a failure arc, in the order of their hashes."""
        chunk.ask_triples()
        chunk.triple_n, chunk.triple_marks = chunk.heard(_TRIPLES, _COUNTS)
        failing = np.zeros(len(chunk.pairs), bool)
        failing[chunk.state[chunk.triple_n == 0]] = True
        owned = (chunk.triple_marks & _OWNER > 0) & (chunk.triple_n > 0) & (chunk.pair_marks[chunk.state] & _OUTSIDE > 0)
        return chunk.sums(chunk.state, owned, chunk.pair_n[chunk.lower], failing)

    def states(self, chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        """Third round: sums over the arcs of pairs that a text can leave by a failure arc."""
        at, *sums = self._pairs(chunk)
        yield from _asked(_AFTER_PAIR, self.buckets, chunk.pairs[at], *sums)

    def traverse(self, chunk: Chunk) -> pa.Table:
        """Every text from left to right, with the chunk's part of the automaton."""
        root = self.root(chunk)
        word_log, pair_log = np.log10(root), np.log10(np.where(chunk.pair_n > 0, chunk.pair_p(), 1))
        at, *_ = self._words(chunk)
        arcs, lower = chunk.heard(_AFTER_WORD, _SUMS)
        word_fail = np.zeros(len(chunk.words))
        word_fail[at] = _failure(chunk.word_n[at], arcs, lower / (self.tokens + self.distinct + 1))
        at, *_ = self._pairs(chunk)
        arcs, lower = chunk.heard(_AFTER_PAIR, _SUMS)
        pair_fail = np.zeros(len(chunk.pairs))
        below = (lower - DISCOUNT * arcs) / np.maximum(chunk.word_n[chunk.last[at]], 1)
        pair_fail[at] = _failure(chunk.pair_n[at], arcs, below)

        logs = np.zeros(len(chunk.ids))
        at = np.flatnonzero(chunk.place == 0)  # a text starts at the root
        logs[at] = word_log[chunk.ids[at]]
        at = chunk.second  # from one-word states, or from where a two-word state's failure arc leads
        pair = chunk.pair_of[at]
        arc = chunk.pair_n[pair] > 0
        logs[at] = np.where(arc, pair_log[pair], word_fail[chunk.ids[at - 1]] + word_log[chunk.ids[at]])
        third = np.flatnonzero(chunk.place >= 2)
        state = chunk.pair_of[third - 1]
        # A pair that occurs once and is learned has the arc that follows it here.
        alone = third[(chunk.pair_n[state] > 0) & (chunk.pair_marks[state] & _AGAIN == 0)]
        logs[alone] = np.log10(1 - DISCOUNT)
        state, n = chunk.pair_of[chunk.after - 1], chunk.triple_n[chunk.triple_of]
        p = np.log10(np.where(n > 0, n - DISCOUNT, 1) / np.maximum(chunk.pair_n[state], 1))
        logs[chunk.after] = np.where(n > 0, p, pair_fail[state] + logs[chunk.after])

        by_text = lambda x: _sums(x, chunk.offsets[:-1])
        known = by_text((chunk.word_n[chunk.ids] > 0).astype(np.int64))
        n = pa.array(np.full(len(chunk.sizes), self.tokens))
        columns = [pa.array(x) for x in (chunk.sizes, known, by_text(word_log[chunk.ids]), by_text(logs))]
        return pa.StructArray.from_arrays([*columns, n], ["n_tokens", "n_known", "base_score", "score", "train_tokens"])


def _chunks(docs: DataFrame, learned: Column, chunk_tokens: int) -> DataFrame:
    """(chunk, tokens, words, ids, sizes, learned, boxes): all rows of docs, gathered."""
    flag = F.coalesce(learned, F.lit(False))
    box = boxed(docs.withColumn("_learned", flag), "text", "_learned")
    schema = StructType().add("chunk", LongType()).add("tokens", LongType())
    for name in ("words", "ids", "sizes", "learned"):
        schema = schema.add(name, BinaryType())
    schema = schema.add("boxes", ArrayType(box.schema["_box"].dataType))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, []

        def row() -> pa.RecordBatch:
            words, ids, n = np.unique(np.concatenate([h for h, *_ in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            sizes, flags = (np.concatenate([h[c] for h in held]) for c in (1, 2))
            blobs = [pa.array([packed(x)], pa.binary()) for x in (words[order], rank[ids], sizes, flags)]
            boxes = pa.concat_arrays([h[3] for h in held])
            boxes = pa.ListArray.from_arrays(pa.array([0, len(boxes)], pa.int32()), boxes)
            counts = [pa.array([x], pa.int64()) for x in (chunk, len(ids))]
            return pa.RecordBatch.from_arrays([*counts, *blobs, boxes], schema.names)

        for batch in pieces(batches, PIECE):
            hashes, offsets = tokens(batch)
            flags = batch.column("_learned").to_numpy(zero_copy_only=False)
            held.append((hashes, np.diff(offsets), flags, batch.column("_box")))
            if sum(len(h) for h, *_ in held) >= chunk_tokens:
                yield row()
                chunk, held = chunk + 1, []
        if held:
            yield row()

    return written(box.mapInArrow(gathered, schema), "lm-chunks", "zstd")


def score(docs: DataFrame, learned: Column, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """docs' columns but text, with a struct `lm`: n_tokens, n_known, base_score, score, train_tokens.
    The model is that of the rows where `learned` is true; to score other texts by it, add them as rows that aren't."""
    text_batches(docs.sparkSession)
    chunks = _chunks(docs, learned, chunk_tokens)
    size = chunks.agg(F.sum("tokens")).first()[0] or 0
    model = Model(max(1, -(-size // bucket_tokens)))
    texts = chunks.select("chunk", "words", "ids", "sizes", "learned")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(at, 1)])
                yield from _questions(row.column("chunk")[0].as_py(), list(model.counts(Chunk.of(row)))).to_batches()

    def asking(ask):
        def asked(row: pa.Table, heard: pa.Table) -> pa.Table:
            chunk = Chunk.of(row)
            chunk.hear(heard)
            return _questions(row.column("chunk")[0].as_py(), list(ask(chunk)))

        return asked

    def again(ask, answers: DataFrame) -> DataFrame:
        by_chunk = answers.select("chunk", "bucket", "blob").groupBy("chunk")
        return texts.groupBy("chunk").cogroup(by_chunk).applyInArrow(asking(ask), _QUESTION)

    counts = _answers(texts.mapInArrow(first, _QUESTION), "lm-counts")
    learnt = counts.agg(F.sum("n"), F.sum("v")).first()
    model = Model(model.buckets, learnt[0] or 0, learnt[1] or 0)
    arcs = counts.unionByName(_answers(again(model.arcs, counts), "lm-arcs"))
    states = arcs.unionByName(_answers(again(model.states, arcs), "lm-states"))

    boxes = chunks.schema["boxes"].dataType.elementType
    lm = StructType()
    for name in ("n_tokens", "n_known", "base_score", "score", "train_tokens"):
        lm = lm.add(name, DoubleType() if name.endswith("score") else LongType())
    schema = StructType().add("_box", boxes).add("lm", lm)

    def traversed(row: pa.Table, heard: pa.Table) -> pa.Table:
        chunk = Chunk.of(row)
        chunk.hear(heard)
        found = model.traverse(chunk)
        return pa.table([row.column("boxes").combine_chunks().flatten(), found], ["_box", "lm"])

    by_chunk = states.select("chunk", "bucket", "blob").groupBy("chunk")
    found = chunks.drop("tokens").groupBy("chunk").cogroup(by_chunk).applyInArrow(traversed, schema)
    return unboxed(found, [c for c in docs.columns if c not in ("text", "lm")], (), "lm")
