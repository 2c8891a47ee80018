"""Operator 5: supervised subword embeddings for document quality.

Every word and its character n-grams are hashed to rows of an embedding table;
of the word pairs those of equal words have one row in common.  A document is the mean of its rows, followed by a softmax layer; both are
learned by numpy stochastic gradient descent on a bounded sample of labelled
documents.  At scoring time a word's rows only matter through their projection
on the two classes, so each worker adds up one number per distinct word.

Defined cases: a null or empty text has no features and gets the share of
label 1 among the training rows; without labels that share is 0.5; repeated
rows get equal scores; no rows give no rows.  Columns other than the text are
never inputs of a score.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import add_columns, forget, once, texts
from tablerecon.llm.sampling import bounded, one_label

#: Bound on the labelled documents a model is fitted on.
TRAIN_ROWS = 4000
BUCKETS = 1 << 16
DIM = 16
EPOCHS = 6
#: Updates at least, so that a small sample is gone over more often.
LEAST_STEPS = 12_000
RATE = 4.0
NGRAMS = (3, 4)
#: Distinct words whose value a worker keeps, about 250 bytes each.
KEPT_WORDS = 200_000


#: Feature of a word that equals the one before it.
SAME = "<<same>>"


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """Table rows of a word: itself and its n-grams with boundary marks."""
    marked = f"<{word}>"
    grams = [marked, *(marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


@dataclass
class Model:
    """Log-odds a feature adds, and the log-odds without any."""

    projected: np.ndarray
    bias: float
    prior: float


class WordValues(dict):
    """Sum and number of a word's features, as one complex number to add up fast."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> complex:
        if len(self) >= KEPT_WORDS:
            self.clear()
        rows = features(word.decode(), len(self.model.projected))
        value = self[word] = complex(float(self.model.projected[rows].sum()), len(rows))
        return value


def same_pairs(split: list[bytes]) -> int:
    return sum(map(eq, split, split[1:]))


def _document(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text and their share of all its features."""
    counts: dict[bytes, int] = {}
    split = text.split()
    for word in split:
        counts[word] = counts.get(word, 0) + 1
    ids, weights = [zlib.crc32(SAME.encode()) % BUCKETS], [same_pairs(split)]
    for word, n in counts.items():
        rows = features(word.decode())
        ids += rows
        weights += [n] * len(rows)
    if not split:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    rows, at = np.unique(np.array(ids, np.int32), return_inverse=True)
    shares = np.bincount(at, weights=weights)
    return rows, (shares / shares.sum()).astype(np.float32)


def descend(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Model:
    """Fit table and softmax layer by stochastic gradient descent."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if not 0 < prior < 1:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, prior)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.log(np.array([1 - prior, prior], np.float32))
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(documents)))
    steps, done = epochs * len(documents), 0
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            rows, shares = documents[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(rows):
                continue
            mean = shares @ table[rows]
            odds = np.exp((z := mean @ layer + bias) - z.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = layer @ error
            layer -= 0.1 * rate * np.outer(mean, error)
            bias -= 0.01 * rate * error
            table[rows] -= rate * shares[:, None] * back
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str, *, text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``rows`` of the labelled documents given.

    The sampled labels are bounded, hence broadcast; the documents are not
    shuffled.  Features meet in one task that trains, bounded by ``rows``.
    """
    picked = bounded(one_label(labels, label, id_col), rows, "doc_id")
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sample = bounded(own.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y"), rows, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        documents, ys = [], []
        for batch in batches:
            documents += [_document(t) for t in texts(batch.column(0))]
            ys += batch.column(1).to_pylist()
        m = descend(documents, np.array(ys, np.int64))
        yield pa.RecordBatch.from_pylist([{"projected": m.projected.tobytes(), "bias": m.bias, "prior": m.prior}])

    # Sorted, so that the order of training does not hang on task order.
    fed = sample.select("text", "y", F.xxhash64("doc_id", "text").alias("o")).repartition(1).sortWithinPartitions("o").select("text", "y")
    got = fed.mapInArrow(run, "projected binary, bias double, prior double").first()
    if got is None:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.5)
    return Model(np.frombuffer(got.projected, np.float32), got.bias, got.prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Append the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(column: pa.Array) -> list:
        value = once(key, lambda: WordValues(shared.value)).__getitem__
        m, out = shared.value, []
        same = complex(float(m.projected[zlib.crc32(SAME.encode()) % len(m.projected)]), 1)
        for text in texts(column):
            split = text.split()
            total = sum(map(value, split), same * same_pairs(split))
            z = total.real / total.imag + m.bias if total.imag else None
            out.append(m.prior if z is None else 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
        return [out]

    return add_columns(docs, [text_col], f"{name} double", run, keep, uses=[key])
