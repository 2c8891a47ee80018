"""Operator 2: find benchmark items in documents with an Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, words are runs of digits,
letters and non-ASCII bytes.  Each window of ``width`` words of an item is one
pattern, an item of fewer words is one window.  The automaton reads a word as
two letters that number it among the items' words, the first and the second of
alphabets of their own, so that it holds few nodes and matches whole words
only.  A document's normalised text is scanned once; hit words are mapped to
character offsets of the original.

Items of more than ``part_bytes`` make several automata, a few of which a
worker holds at once.  Beyond those, the documents are scanned in rounds: a
round's items are the only ones on the driver and in memory, and what it hits,
few rows, is written to the shared folder and joined by a hash of the text.

Defined cases: a null or empty text has no words, is never hit, and as an item
never occurs; repeated item rows count once per item id; a null item id is
left out of the listed ids but its windows still hit; repeated documents are
judged one by one; without items nothing is hit.  Extra columns are kept when
asked for (``keep``) and otherwise not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import add_columns, forget, once, stored, texts, unused

WIDTH = 10
#: Bytes of item text in one automaton (about 100 bytes of memory each), and automata held at once.
AUTOMATON_BYTES, AT_ONCE = 512 << 10, 4

#: ASCII letters in lower case, digits and bytes over 127 kept, others to a space.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(words: list[bytes], width: int) -> list[list[bytes]]:
    return [words[i : i + width] for i in range(max(len(words) - width, 0) + 1)] if words else []


class Matcher:
    """An automaton over all windows of some items; its values are (words, item ids)."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        import ahocorasick

        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for window in windows(normal_words(text), width):
                owners.setdefault(tuple(window), set()).add(item)
        words = sorted({w for window in owners for w in window})
        # Letters of one word: its number's digits to a base of about the root of all.
        base = max(2, int(len(words) ** 0.5) + 1)
        self.letters = {w: chr(2 + i // base) + chr(2 + base + i % base) for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word("".join(map(self.letters.__getitem__, window)), (len(window), frozenset(ids)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes], marks: np.ndarray, found: set) -> None:
        """Count up ``marks`` where hit words begin and down after they end; gather item ids."""
        if not self.letters or self.letters.keys().isdisjoint(words):
            return
        get = self.letters.get
        for end, (n, items) in self.automaton.iter("".join([get(w, "\x01\x01") for w in words])):
            after = (end + 1) // 2
            marks[after - n] += 1
            marks[after] -= 1
            found |= items


def spans_of(text: bytes, hit: np.ndarray) -> list[dict]:
    """Character offsets in the original of each run of hit words."""
    words = [m.span() for m in _WORD.finditer(text.decode())]
    return [{"start": words[a][0], "end": words[b - 1][1]} for a, b in zip(*_runs(hit))]


def item_parts(items: DataFrame, id_col: str, text_col: str, part_bytes: int) -> tuple[DataFrame, int]:
    """Items with the part each belongs to, and the number of parts."""
    size = items.select(F.coalesce(F.sum(F.octet_length(f"`{text_col}`").cast("long")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // part_bytes))
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null").distinct()
    return rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))), parts


def _share(items: DataFrame, parts: range) -> list[tuple[str, Broadcast]]:
    """A key and the items of each part, for the workers."""
    held: dict[int, list] = {p: [] for p in parts}
    for r in items.where((F.col("part") >= parts.start) & (F.col("part") < parts.stop)).collect():
        held[r.part].append((r.i, r.t.encode()))
    return [(uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(v)) for v in held.values()]


def _hits(shared: list[tuple[str, Broadcast]], width: int, rows: list[bytes]) -> tuple[list[np.ndarray], list[set]]:
    """Which words of each text are hit (1) and by which items; the words of one text are held at a time."""
    matchers = [once(key, lambda items=items: Matcher(items.value, width), kept=AT_ONCE) for key, items in shared]
    hits, found = [], []
    for text in rows:
        words, ids = normal_words(text), set()
        marks = np.zeros(len(words) + 1, np.int32)
        for matcher in matchers:
            matcher.scan(words, marks, ids)
        hits.append((np.cumsum(marks)[:-1] > 0).astype(np.int8))
        found.append(ids)
    return hits, found


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))).tolist()
    return edges[::2], edges[1::2]


def _columns(rows: list[bytes], hits: list[np.ndarray], found: list[set]) -> list[list]:
    return [
        [len(h) for h in hits],
        [int(h.sum()) for h in hits],
        [len(ids) for ids in found],
        [sorted(i for i in ids if i is not None) for ids in found],
        [spans_of(t, h) if h.any() else [] for t, h in zip(rows, hits)],
    ]


def _round(docs: DataFrame, shared: list[tuple[str, Broadcast]], width: int) -> DataFrame:
    """Texts that one round of items hits: mark, begins and ends of runs of hit words, item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(*[key for key, _ in shared])
        for batch in batches:
            hits, found = _hits(shared, width, texts(batch.column(1)))
            on = [i for i, h in enumerate(hits) if h.any()]
            begins, ends = [list(x) for x in zip(*[_runs(hits[i]) for i in on])] or [[], []] if on else [[], []]
            ids = [sorted(found[i], key=lambda x: (x is None, x)) for i in on]
            ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
            arrays = [batch.column(0).take(pa.array(on, pa.int64())), pa.array(begins, ints), pa.array(ends, ints), pa.array(ids, strings)]
            yield pa.RecordBatch.from_arrays(arrays, names=["mark", "begins", "ends", "ids"])

    return docs.mapInArrow(run, "mark string, begins array<int>, ends array<int>, ids array<string>")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    keep: list[str] | None = None,
    prefix: str = "",
    part_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Add n_words, n_hit, item_ids (sorted) and hit_spans of each document."""
    dealt, parts = item_parts(items, item_id, item_text, part_bytes)
    fields = "n_words long, n_hit long, n_items long, item_ids array<string>, hit_spans array<struct<start:int,end:int>>"
    fields = ", ".join(prefix + f for f in fields.split(", "))
    if parts <= AT_ONCE:
        shared = _share(dealt, range(parts))

        def run(column: pa.Array) -> list:
            rows = texts(column)
            return _columns(rows, *_hits(shared, width, rows))

        return add_columns(docs, [text_col], fields, run, keep, uses=[key for key, _ in shared])

    dealt = stored(dealt, "items")
    mark = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    marked = docs.select(mark.alias("mark"), F.col(f"`{text_col}`").alias("text"))
    rounds = []
    for first in range(0, parts, AT_ONCE):
        shared = _share(dealt, range(first, min(first + AT_ONCE, parts)))
        rounds.append(stored(_round(marked, shared, width), "hits"))
        for _, items_ in shared:
            items_.destroy()
    own, got, at = unused(docs, "text_mark"), unused(docs, "hit_mark"), unused(docs, "hit_runs")
    hits = reduce(DataFrame.unionByName, rounds).dropDuplicates(["mark", "ids"]).groupBy(F.col("mark").alias(got))
    hits = hits.agg(F.collect_list(F.struct("begins", "ends", "ids")).alias(at)).withColumn(got + "_h", F.xxhash64(got))
    joined = docs.withColumn(own, mark).withColumn(own + "_h", F.xxhash64(own))
    joined = joined.join(hits, (F.col(own) == F.col(got)) & (F.col(own + "_h") == F.col(got + "_h")), "left")

    def merge(column: pa.Array, runs: pa.Array) -> list:
        rows = texts(column)
        marks = [np.zeros(len(normal_words(t)), np.int8) for t in rows]
        found: list[set] = [set() for _ in rows]
        for mark, ids, held in zip(marks, found, runs.to_pylist()):
            for hit in held or ():
                ids.update(hit["ids"])
                for a, b in zip(hit["begins"], hit["ends"]):
                    mark[a:b] = 1
        return _columns(rows, marks, found)

    return add_columns(joined, [text_col, at], fields, merge, docs.columns if keep is None else keep)
