"""Operator 3: toxicity from positive and unlabelled documents.

A linear numpy classifier over the words and word beginnings of a document is trained from
confirmed toxic documents plus unlabelled ones, with the non-negative risk
estimator: the negative risk of the unlabelled rows less the class prior times
that of the toxic rows, never below zero.  Labels 0 are not used but for the
class prior, the share of toxic rows among the training labels.

Defined cases: a null or empty text has no words and is scored by the bias
alone; without toxic training rows every score is 0; repeated rows get equal
scores; no rows give no rows.  Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import add_columns, once
from tablerecon.llm.sampling import bounded, one_label

#: Bounds on the toxic and the unlabelled documents a model is fitted on.
TOXIC_ROWS = 3000
UNLABELLED_ROWS = 9000
#: A feature must be in so many, and in this share, of the toxic documents sampled.
LEAST_DOCUMENTS = 3
LEAST_SHARE = 0.01
#: ... and with it a document must be this likely toxic, by the shares and the prior.
LEAST_PURITY = 0.5
#: Lengths of the word beginnings that are features too.
BEGINNINGS = (4, 5)
#: Distinct words whose features a worker keeps.
KEPT_WORDS = 400_000
EPOCHS = 60
BATCHES = 8
RATE = 0.05
DECAY = 1e-3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    """The word, and its beginnings, marked by a dash."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


class Known(dict):
    """Features of a word that have a weight."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in features(word) if f in self.weights)
        return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -60.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def non_negative_pu(toxic: list[frozenset[str]], other: list[frozenset[str]], prior: float, seed: int = 3) -> Model:
    """Minimise prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic)) with the sigmoid loss."""
    if not toxic or not 0 < prior < 1:
        return Model()
    counts: dict[str, list[int]] = {}
    for row in toxic:
        for word in row:
            counts.setdefault(word, [0, 0])[0] += 1
    for row in other:
        for word in row & counts.keys():
            counts[word][1] += 1
    least = max(min(LEAST_DOCUMENTS, len(toxic)), LEAST_SHARE * len(toxic))
    ratio = {
        w: math.log((p + 0.5) / (len(toxic) + 1)) - math.log((u + 0.5) / (len(other) + 1))
        for w, (p, u) in sorted(counts.items())
        if p >= least
    }
    # Each feature is scaled by its evidence.
    names = [w for w, r in ratio.items() if prior * math.exp(r) >= LEAST_PURITY]
    if not names:
        return Model()
    index = {w: i for i, w in enumerate(names)}
    scale = np.array([ratio[w] for w in names])
    dense = [np.zeros((len(rows), len(names)), np.float32) for rows in (toxic, other)]
    for x, rows in zip(dense, (toxic, other)):
        for i, row in enumerate(rows):
            for w in row & index.keys():
                x[i, index[w]] = scale[index[w]]
    p, u = dense
    rng = np.random.default_rng(seed)
    # Naive Bayes is the start.
    w, b = np.ones(len(names)), math.log(prior / (1 - prior))
    m, v, t = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0
    for _ in range(EPOCHS):
        for pi, ui in zip(np.array_split(rng.permutation(len(p)), BATCHES), np.array_split(rng.permutation(len(u)), BATCHES)):
            if not len(pi) or not len(ui):
                continue
            sp, su = _sigmoid(p[pi] @ w + b), _sigmoid(u[ui] @ w + b)
            dp, du = sp * (1 - sp) / len(pi), su * (1 - su) / len(ui)
            negative = su.mean() - prior * sp.mean()
            # Sigmoid losses: 1 - s for a positive, s for a negative.
            gp, gu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
            grad = np.append(gp @ p[pi] + gu @ u[ui] + DECAY * (w - 1), gp.sum() + gu.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return Model({n: float(a * s) for n, a, s in zip(names, w, scale) if a > 0}, float(b))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    text_col: str = "text",
    id_col: str = "doc_id",
    toxic_rows: int = TOXIC_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
) -> Model:
    """Fit from the toxic rows of ``labels`` and a sample of all documents.

    Both samples are bounded, meet in one task that trains, and cost no
    shuffle of documents: the sampled labels are broadcast.
    """
    known = one_label(labels, label, id_col)
    prior = known.agg(F.avg("y").alias("p")).first().p
    if not prior:
        return Model()
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    picked = bounded(known.where("y = 1").select("doc_id"), toxic_rows, "doc_id")
    toxic = bounded(own.join(F.broadcast(picked), "doc_id"), toxic_rows, "doc_id", "text").withColumn("y", F.lit(1))
    other = bounded(own, unlabelled_rows, "doc_id", "text").withColumn("y", F.lit(0))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in words(t) for f in features(w)}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1), batch.column(2)], names=["words", "y", "o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Toxic rows come first; of the others only features that those hold matter.
        toxic_sets: list[frozenset[str]] = []
        other_sets: list[frozenset[str]] = []
        names: dict[str, str] = {}
        for batch in batches:
            for found, y in zip(batch.column(0), batch.column(1).to_pylist()):
                if y:
                    toxic_sets.append(frozenset(names.setdefault(w, w) for w in found.as_py()))
                else:
                    other_sets.append(frozenset(names[w] for w in found.as_py() if w in names))
        m = non_negative_pu(toxic_sets, other_sets, prior)
        rows = [{"word": k, "weight": w} for k, w in m.weights.items()] + [{"word": None, "weight": m.bias}]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("word", pa.string()), ("weight", pa.float64())]))

    order = F.xxhash64("doc_id", "text").alias("o")
    both = toxic.select("text", "y", order).unionAll(other.select("text", "y", order))
    fed = both.mapInArrow(featurise, "words array<string>, y int, o long").repartition(1).sortWithinPartitions(F.desc("y"), "o")
    got = fed.select("words", "y").mapInArrow(run, "word string, weight double").collect()
    return Model({r.word: r.weight for r in got if r.word is not None}, next((r.weight for r in got if r.word is None), -60.0))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Append the probability-like score of toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(column: pa.Array) -> list:
        m = shared.value
        known = once(key, lambda: Known(m.weights)).__getitem__
        totals = [math.fsum(m.weights[f] for f in set(chain.from_iterable(map(known, words(t))))) for t in column.to_pylist()]
        return [[1 / (1 + math.exp(-max(-60.0, min(60.0, z + m.bias)))) for z in totals]]

    return add_columns(docs, [text_col], f"{name} double", run, keep, uses=[key])
