"""Operator 13: I-Match fingerprints over randomised lexicon subsets.

Terms are lower-cased words.  The lexicon holds the terms whose inverse
document frequency lies in a band: a term in fewer than LEAST_SHARE of all
documents is noise, one in more than MOST_SHARE says nothing.  A document is
its sorted distinct lexicon terms.  Each of SUBSETS randomised subsets of the
lexicon gives one hash, of the document's terms within that subset, so an edit
changes only the hashes of subsets that hold an edited term.

How many terms an edit touches grows with the text, so the subsets come at
rates 4^-level, nested in one another, and a fingerprint holds two levels,
chosen by its number of terms: about 2 to 8 terms and 0.5 to 2 terms a subset.
Two fingerprints are compared on the sparsest level both have: the share of
equal hashes among the subsets in which either has a term, which estimates the
share of common terms.

The lexicon is the only thing broadcast.  Its size has a bound that does not
grow with the number of documents: distinct terms of a mean document divided
by LEAST_SHARE.  Where even that is more than LEXICON_TERMS, the lexicon is
cut to the half, quarter, ... of its terms that a hash picks.

Edited texts and the likeness to the next document need the documents in order
of their ids.  Bounds between ranges come from approximate quantiles, an id
that fills ranges of its own is cut by a hash of its texts, every range is
sorted and streamed, and each range's first documents are copied to the end of
the range before it.

Defined cases: a null text is empty; a text without words has an empty
fingerprint, alike (1.0) to other empty ones only; a text without lexicon
terms is fingerprinted by all its terms; null ids come first in the order,
equal ids by a hash of their texts, so repeated rows follow each other; a
single document is its own next; no rows give no rows.  Other columns are not
read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import forget, once, stored
from tablerecon.llm.wordhash import mix, words_of

#: The band of document frequencies, as shares of all documents.
LEAST_SHARE, MOST_SHARE = 1 / 2000, 1 / 5
#: Terms a broadcast lexicon holds at most, 8 bytes each.
LEXICON_TERMS = 4_000_000
#: Lexicon subsets of a level, and the sparsest pair of levels.
SUBSETS, LAST_LEVEL = 32, 6
#: Text of a range that is sorted and streamed by one task.
RANGE_BYTES = 128 << 20
#: Distinct terms a task gathers before it sends their counts on.
GATHERED = 1_000_000

_HASH_BYTES = 3
_SEEDS = np.random.default_rng(13).integers(1, 1 << 63, SUBSETS // 4 + 1, np.uint64)


def term_counts(texts: DataFrame) -> DataFrame:
    """In how many texts each term stands: term (a 64-bit hash), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kept: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for _, words in words_of(batch.column(0), lower=True):
                for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
                    terms = np.unique(words.hashes[a:b])
                    kept.append(terms)
                    size += len(terms)
                    if size >= GATHERED:
                        yield counts()
                        size = 0
        if size:
            yield counts()

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, least_share: float, most_share: float, bound: int, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms within the band, at most about ``bound`` of them."""
    total = docs.count()
    banded = term_counts(docs.select(F.col(f"`{text_col}`"))).where((F.col("n") >= least_share * total) & (F.col("n") <= most_share * total))
    banded = stored(banded.select("term"), "imatch-lexicon")
    halvings = 0
    while banded.count() >> halvings > bound:
        halvings += 1
    picked = banded.where(F.pmod(F.xxhash64("term"), F.lit(1 << halvings)) == 0)
    return np.sort(picked.toArrow().column("term").to_numpy().view(np.uint64))


def fingerprint_lanes(terms: np.ndarray) -> tuple[int, np.ndarray]:
    """The level, and 24-bit hashes per subset at that level and the next; 0 where a subset has no term."""
    level = min(max((len(terms).bit_length() - 2) // 2, 0), LAST_LEVEL)
    lanes = mix(terms[:, None] ^ _SEEDS[None, :-1]).view(np.uint16)
    value = mix(terms ^ _SEEDS[-1])[:, None]
    made = np.zeros((2, SUBSETS), np.uint32)
    for i in (0, 1):
        held = lanes < np.uint32(1 << 16 >> 2 * (level + i))
        sums = mix((held * value).sum(axis=0, dtype=np.uint64))
        made[i] = np.where(held.any(axis=0), sums % np.uint64((1 << 8 * _HASH_BYTES) - 1) + np.uint64(1), 0)
    return level, made


def fingerprints(column: pa.Array, known: np.ndarray) -> list[tuple[int, np.ndarray] | None]:
    """The fingerprint of each text; None for a text without words."""
    out: list[tuple[int, np.ndarray] | None] = []
    for _, words in words_of(column, lower=True):
        for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
            terms = np.unique(words.hashes[a:b])
            if not len(terms):
                out.append(None)
                continue
            at = np.searchsorted(known, terms)
            inside = terms[known[np.minimum(at, len(known) - 1)] == terms] if len(known) else terms[:0]
            out.append(fingerprint_lanes(inside if len(inside) else terms))
    return out


def render(fingerprint: tuple[int, np.ndarray] | None) -> str:
    """``level:hashes``, six hex digits a subset."""
    if fingerprint is None:
        return ""
    level, lanes = fingerprint
    raw = lanes.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - _HASH_BYTES :]
    return f"{level}:{raw.tobytes().hex()}"


def likeness(a: tuple[int, np.ndarray] | None, b: tuple[int, np.ndarray] | None) -> float:
    """Share of equal hashes among the subsets in which either has a term; 0 without a common level."""
    if a is None or b is None:
        return float(a is b)
    level = min(a[0], b[0]) + 1
    if level < max(a[0], b[0]):
        return 0.0
    left, right = a[1][level - a[0]], b[1][level - b[0]]
    either = (left != 0) | (right != 0)
    if not either.any():  # a few terms can miss every subset of this level
        return float(a[0] == b[0] and bool((a[1] == b[1]).all()))
    return float((left == right)[either].mean())


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with ``range`` (from 0, ascending with the order) and ``ghost``; and the number of ranges.

    A ghost is the copy of the first document of the next range.
    """
    spark = docs.sparkSession
    size, rows, nulls = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [0.5], max(10 * wanted, 10_000))).first()[0] or []
    ids, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    null_times = 1 + nulls * wanted // max(rows, 1)

    def place(doc_id: pd.Series, null: pd.Series, tie: pd.Series) -> np.ndarray:
        """The range, as a number that grows with the order; hot ids and nulls are cut by ``tie``."""
        known, value = ~null.to_numpy(), doc_id.to_numpy()
        after = np.searchsorted(ids, value, "right")
        hot = np.zeros(len(value), np.int64)
        if len(ids):
            last = np.maximum(after - 1, 0)
            hot = np.where((ids[last] == value) & (after > 0) & (times[last] > 1), times[last], 0)
        parts = np.where(known, hot, null_times)
        spread = (tie.to_numpy() >> 32) + (1 << 31)
        cut = spread * parts >> 32
        return np.where(known, 2 * after + 1 + (parts == 0), 0) * (1 << 31) + cut

    number = F.pandas_udf(lambda *order: pd.Series(place(*order)), "long")
    order = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("tie")]
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    firsts = keyed.groupBy(number(*order).alias("place")).agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    firsts = firsts.orderBy("place").select("place", "first.*").collect()
    places = np.array([r.place for r in firsts], np.int64)
    first_ids = np.array([r.doc_id or 0 for r in firsts], np.int64)
    first_ties = np.array([r.tie for r in firsts], np.int64)

    @F.pandas_udf("array<int>")
    def dealt(doc_id: pd.Series, null: pd.Series, tie: pd.Series) -> pd.Series:
        own = np.searchsorted(places, place(doc_id, null, tie))
        first = (first_ids[own] == doc_id.to_numpy()) & (first_ties[own] == tie.to_numpy())
        before = (own - 1) % max(len(places), 1)
        return pd.Series([[o, b] if f else [o] for o, b, f in zip(own.tolist(), before.tolist(), first.tolist())])

    return keyed.select("*", F.posexplode(dealt(*order)).alias("ghost", "range")), max(len(places), 1)


def fingerprint_with_next(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_share: float = LEAST_SHARE,
    most_share: float = MOST_SHARE,
    lexicon_terms: int = LEXICON_TERMS,
    edited_part: int = 4,
) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited and near_next of each document.

    The edited text ends in the head of the next document: its last
    ``1 / edited_part`` is replaced.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    key, known = uuid.uuid4().hex, spark.sparkContext.broadcast(lexicon(own, least_share, most_share, lexicon_terms))
    rows, n = _ranges(own)
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        terms = once(key, lambda: known.value)
        waiting = None  # (id, text, fingerprint) of the last document, whose next is yet to come
        for batch in batches:
            found = fingerprints(batch.column(3), terms)
            done = []
            for doc_id, ghost, text, mark in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), found):
                if waiting is not None:
                    cut = len(waiting[1]) // edited_part
                    edited = waiting[1][: len(waiting[1]) - cut] + text[:cut]
                    done.append((waiting[0], len(waiting[1]), edited, waiting[2], likeness(waiting[2], mark)))
                waiting = None if ghost else (doc_id, text, mark)
            if done:
                ids, lengths, edited, marks, near_next = zip(*done)
                edited = pa.array(edited, pa.string())
                other = fingerprints(edited, terms)
                near = [likeness(a, b) for a, b in zip(marks, other)]
                columns = [ids, lengths, edited, [render(m) for m in marks], [render(m) for m in other], near, near_next]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    ordered = rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", "ghost", "doc_id", "tie")
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("range", "doc_id", "ghost", "text").mapInArrow(run, schema)
