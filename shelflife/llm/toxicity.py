"""Toxicity by a chain of linear classifiers.

The categories are predicted in order; each later model also sees the
probabilities of the earlier categories. It is trained with out-of-fold probabilities,
that is, with those of models that haven't seen the example. Features
are the presence of words and of word beginnings, by 64-bit hash; those that tell most about the
categories are kept.

A null or empty text has no features and gets each model's base rate. Only the text is read for
predictions; repeated rows get equal ones. Other columns pass through, but one named `toxicity` is replaced.
Labels that are null, or of ids that no document has, aren't used. Without labels all probabilities are 0. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from shelflife.llm.sampling import sample_each, text_hash
from shelflife.llm.scratch import boxed, text_batches, unboxed
from shelflife.llm.text import U64, Spans, Words, byte_symbols, mix, not_letters, pieces, row_of, text_of

#: Categories in the order of the chain: column of the labels and the value that counts as 1.
CATEGORIES = (("quality", 0), ("toxic", 1))
PREFIXES = (4, 5, 6)
#: Bound of the training sample: documents of each combination of labels.
SAMPLE_EACH = 1500
MOST_FEATURES = 2048
FOLDS = 3
THRESHOLD = 0.4

_BREAKS = not_letters()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and word beginning, repeats included."""
    words = Words(data, offsets, lower=True, breaks=_BREAKS)
    spans, rows = Spans(byte_symbols(words.data)), row_of(words.rows)
    hashes, owners = [spans.hashes(words.starts, words.ends)], [rows]
    for k in PREFIXES:
        long = words.ends - words.starts > k
        start = words.starts[long]
        hashes.append(mix(spans.hashes(start, start + k) ^ U64(k)))
        owners.append(rows[long])
    return np.concatenate(owners), np.concatenate(hashes)


@dataclass
class Chain:
    categories: list[str]
    known: np.ndarray  # sorted hashes of the features
    weights: list[np.ndarray] = field(default_factory=list)  # per category: features, earlier categories, bias
    _near: np.ndarray | None = None

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature number) pairs."""
        if self._near is None:
            self._near = np.zeros(1 << 16, bool)
            self._near[(self.known >> U64(48)).astype(np.int64)] = True
        rows, hashes = features(data, offsets)
        maybe = self._near[(hashes >> U64(48)).astype(np.int64)]
        rows, hashes = rows[maybe], hashes[maybe]
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        hit = self.known[at] == hashes if len(self.known) else np.zeros(len(at), bool)
        pairs = np.unique(rows[hit] * (len(self.known) + 1) + at[hit])
        return np.divmod(pairs, len(self.known) + 1)

    def probabilities(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.categories)))
        m = len(self.known)
        for k, w in enumerate(self.weights):
            z = np.bincount(rows, w[ids], minlength=n) + w[-1] + out[:, :k] @ w[m : m + k]
            out[:, k] = _sigmoid(z)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights and a last bias of a logistic regression, by accelerated gradient descent on
    centred columns; the step is the inverse of the loss's largest curvature."""
    if y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), 40.0 if y[0] else -40.0)
    n, mean = len(y), x.mean(axis=0)
    centred = np.hstack([x - mean, np.ones((n, 1), x.dtype)])
    shrink = np.append(np.full(x.shape[1], penalty, x.dtype), x.dtype.type(0))
    direction = np.ones(centred.shape[1], x.dtype)
    for _ in range(20):
        direction = centred.T @ (centred @ direction)
        largest = np.linalg.norm(direction)
        direction /= largest
    rate = x.dtype.type(1 / (0.3 * largest / n + penalty))
    w = look = np.zeros(centred.shape[1], x.dtype)
    for t in range(steps):
        slope = centred.T @ (_sigmoid(centred @ look) - y).astype(x.dtype) / n + shrink * look
        new = look - rate * slope
        look, w = new + x.dtype.type(t / (t + 3)) * (new - w), new
    weights = w.astype(np.float64)
    weights[-1] -= weights[:-1] @ mean
    return weights


def _telling(names: np.ndarray, with_it: np.ndarray, positive: np.ndarray, base: float, most: int) -> np.ndarray:
    """Names whose share among positive and negative examples differs most."""
    z = (positive - with_it * base) / np.sqrt(np.maximum(with_it * base * (1 - base), 1e-9))
    score = np.where(with_it >= 3, np.abs(z), 0)
    best = np.argsort(-score, kind="stable")[:most]
    return names[best[score[best] > 3]]


def _distinct(texts: list[bytes], at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct features of every text."""
    rows, hashes = [np.zeros(0, np.int32)], [np.zeros(0, U64)]
    for first in range(0, len(texts), at_once):
        some = texts[first : first + at_once]
        row, found = features(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
        rows.append((row[new] + first).astype(np.int32))
        hashes.append(found[new])
    return np.concatenate(rows), np.concatenate(hashes)


def fit(texts: list[bytes], labels: np.ndarray, categories: Sequence[str], most: int = MOST_FEATURES) -> Chain:
    """labels: examples x categories, 0 or 1."""
    rows, hashes = _distinct(texts)
    names, at = np.unique(hashes, return_inverse=True)
    with_it = np.bincount(at, minlength=len(names))
    share = most // len(categories)
    best = [
        _telling(names, with_it, np.bincount(at, y[rows], minlength=len(names)), y.mean(), share)
        for y in labels.T.astype(float)
    ]
    known = np.unique(np.concatenate(best))
    del rows, hashes, names, at
    chain = Chain(list(categories), known)
    x = np.zeros((len(texts), len(known)), np.float32)
    for first in range(0, len(texts), 200):
        some = texts[first : first + 200]
        at, ids = chain.present(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        x[at + first, ids] = 1
    fold = np.random.default_rng(7).integers(0, FOLDS, len(texts))
    earlier = np.zeros((len(texts), 0), np.float32)
    for y in labels.T.astype(np.float64):
        seen = np.hstack([x, earlier])
        chain.weights.append(_logistic(seen, y))
        unseen = np.zeros(len(texts), np.float32)
        for k in range(FOLDS):
            if (inside := fold == k).any() and not inside.all():
                w = _logistic(seen[~inside], y[~inside])
                unseen[inside] = _sigmoid(seen[inside] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, unseen[:, None]])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, each: int = SAMPLE_EACH) -> Chain | None:
    """A chain from the labelled documents; None without examples. Labels meet the documents' lengths and
    hashes first, then only the sample's texts move; what reaches the driver is at most 1.2 * each texts
    per combination of labels, see sample_each()."""
    flags = [(F.col(c) == value).cast("int").cast("string") for c, value in categories]
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_label_id"), F.concat(*flags).alias("label"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text", text_hash().alias("hash"))
    sizes = texts.select("doc_id", "hash", F.length("text").alias("chars"))
    labelled = sizes.join(known.dropna().distinct(), F.col("doc_id") == F.col("_label_id"))
    chosen = sample_each(labelled.select("label", "hash", "chars"), each).select("label", "hash")
    found = texts.join(F.broadcast(chosen), "hash").dropDuplicates(["label", "hash"])
    rows = found.select("text", "label", "hash").orderBy("hash", "label").collect()
    if not rows:
        return None
    return fit([r["text"].encode() for r in rows], np.array([[*map(int, r["label"])] for r in rows]), [c for c, _ in categories])


def score(docs: DataFrame, chain: Chain | None, categories=CATEGORIES) -> DataFrame:
    """docs' columns and `toxicity`, an array of probabilities in the order of the categories."""
    text_batches(docs.sparkSession)
    box = boxed(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in pieces(batches, 1 << 20):
            n = batch.num_rows
            found = np.zeros((n, len(categories)))
            if chain is not None:
                data, offsets = text_of(batch)
                found = chain.probabilities(*chain.present(data, offsets), n)
            ends = pa.array(np.arange(n + 1) * len(categories), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "toxicity"])

    schema = StructType([*box.schema.fields]).add("toxicity", ArrayType(DoubleType()))
    columns = [c for c in docs.columns if c != "toxicity"]
    return unboxed(box.mapInArrow(predict, schema), columns, ("text",), "toxicity")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() by a chain trained on docs and labels."""
    return score(docs, train(docs, labels))


def is_toxic(threshold: float = THRESHOLD) -> Column:
    """Of the result of score(): the last category's probability is at least `threshold`."""
    return F.element_at("toxicity", -1) >= threshold
