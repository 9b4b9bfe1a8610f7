"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte n-grams (hashed into
`BUCKETS`), mapped to languages by one linear layer. Both are trained by
stochastic gradient descent in numpy on a bounded sample. The softmax is
calibrated by a temperature on examples kept apart, and a prediction whose score is
under the calibrated threshold is marked `rejected`.

A null text, an empty one or one without a letter is `und` with score 0 and
rejected; so is every text if no language was learned. Only doc_id and text are read for
predictions. Repeated rows get equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflife.llm.sampling import sample_each, text_hash
from shelflife.llm.scratch import text_batches
from shelflife.llm.text import lowered, pieces, text_of

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
DIMENSION = 16
#: Bound of the training sample: documents per language.
SAMPLE_EACH = 500
#: Share of correct calibration examples that the threshold may reject.
REJECT_CORRECT = 0.002

_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def gram_buckets(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram from each byte; BUCKETS where it would leave its text."""
    wide = lowered(data).astype(np.uint32)
    n = len(data)
    value = np.full(n, size * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    # Data shorter than the n-gram, as one text of two bytes, has no byte for its last factors.
    for k in range(min(size, n)):
        value[: n - k] += wide[k:] * np.uint32(_FACTORS[k])
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    out = (value >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    for k in range(1, size):
        at = offsets[1:] - k
        out[at[at >= 0]] = BUCKETS
    return out


@dataclass
class Model:
    """Per-bucket contributions to each language's score, and the calibration."""

    languages: list[str]
    table: np.ndarray  # languages x (BUCKETS + 1); the last bucket is 0
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, full = len(offsets) - 1, np.flatnonzero(np.diff(offsets) > 0)
        sums = np.zeros((rows, len(self.languages)))
        grams = np.zeros(rows)
        lengths = np.diff(offsets)
        for size in SIZES:
            if not len(full):
                break
            buckets = gram_buckets(data, offsets, size)
            for k, weights in enumerate(self.table):
                sums[full, k] += np.add.reduceat(weights[buckets], offsets[:-1][full], dtype=np.float64)
            grams += np.maximum(lengths - size + 1, 0)
        return sums / np.maximum(grams, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    out = []
    for text in texts:
        data, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        all_buckets = np.concatenate([gram_buckets(data, ends, size) for size in SIZES])
        ids, n = np.unique(all_buckets[all_buckets < BUCKETS], return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(texts: list[bytes], labels: list[str], epochs: int = 4, rate: float = 8.0, batch: int = 32) -> Model:
    """Train and calibrate; every fifth example, in a fixed shuffled order, calibrates."""
    rng = np.random.default_rng(7)
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    order = rng.permutation(len(texts))
    held = order[::5] if len(texts) >= 50 else order
    train = np.setdiff1d(order, held) if len(texts) >= 50 else order
    grams = _counts(texts)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    linear = rng.normal(0, 0.1, (DIMENSION, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, step = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = [i for i in train[at : at + batch] if len(grams[i][0])]
            if not rows:
                continue
            ids = np.concatenate([grams[i][0] for i in rows])
            shares = np.concatenate([grams[i][1] for i in rows])
            starts = np.cumsum([0] + [len(grams[i][0]) for i in rows[:-1]])
            hidden = np.add.reduceat(embed[ids] * shares[:, None], starts)
            z = hidden @ linear + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            now = rate * (1 - step / steps)
            back = error @ linear.T
            linear -= now * hidden.T @ error
            bias -= now * error.sum(axis=0)
            owner = np.repeat(np.arange(len(rows)), np.diff([*starts, len(ids)]))
            np.add.at(embed, ids, -now * len(rows) ** 0.5 * back[owner] * shares[:, None])
            step += 1
    table = np.zeros((len(languages), BUCKETS + 1), np.float32)
    table[:, :BUCKETS] = (embed @ linear).T
    model = Model(languages, table, bias.astype(np.float64))
    return _calibrated(model, [texts[i] for i in held], y[held])


def _calibrated(model: Model, texts: list[bytes], y: np.ndarray) -> Model:
    data = np.frombuffer(b"".join(texts), np.uint8)
    logits = model.logits(data, np.cumsum([0, *map(len, texts)]))
    rows = np.arange(len(y))

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -np.log(np.maximum(model.scores(logits)[rows, y], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    scores = model.scores(logits)
    right = scores.argmax(axis=1) == y
    if right.any():
        model.threshold = float(np.quantile(scores.max(axis=1)[right], REJECT_CORRECT))
    return model


def train(labelled: DataFrame, each: int = SAMPLE_EACH) -> Model | None:
    """A model from doc_id, text, lang; None without examples. What reaches the driver is
    at most 1.2 * each texts per language, see sample_each()."""
    texts = labelled.select("doc_id", "text", F.col("lang").alias("label"), text_hash().alias("hash"))
    texts = texts.where(F.col("text").rlike(r"\p{L}"))
    chosen = sample_each(texts.select("label", "hash", F.length("text").alias("chars")), each).select("label", "hash")
    found = texts.join(F.broadcast(chosen), ["label", "hash"]).dropDuplicates(["label", "hash"])
    rows = found.select("text", "label", "hash").orderBy("hash", "label").collect()
    if not rows:
        return None
    return fit([r["text"].encode() for r in rows], [r["label"] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of docs."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, 1 << 20):
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            n = batch.num_rows
            names, best = np.full(n, "und", object), np.zeros(n)
            rejected = np.ones(n, bool)
            if model is not None:
                scores = model.scores(model.logits(*text_of(batch)))
                names[letters] = np.array(model.languages, object)[scores.argmax(axis=1)[letters]]
                best[letters] = scores.max(axis=1)[letters]
                rejected = ~letters | (best < model.threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(best), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(
        predict, f"doc_id {id_type}, lang_pred string, score double, rejected boolean"
    )
