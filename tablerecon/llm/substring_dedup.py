"""Operator 8: remove word windows that already stand earlier in the corpus.

A window is ``width`` consecutive words.  Words are removed if a window that
covers them also starts earlier: in a document of smaller id, or further up in
the same one.  Earlier text is held in suffix automata, through which the rest
is streamed for matching statistics; where these reach ``width``, the window
ends a removed span.

The reference grows with the corpus, so no task or broadcast holds all of it.
It is sharded by anchors: of the n-grams in a window the one with the smallest
hash.  Equal windows have equal anchors.  Neighbouring windows with one anchor
form a segment; only segments whose anchor occurs twice are sent, to the shard
of their anchor.  There an anchor's segments, in order of document and
position, are streamed through the automaton of those before them and then
added to it.  Copies of a segment are resolved before it is sent, so a passage
that many documents share reaches its shard once from each task.  A frequent
phrase would bring all its differing surroundings to one shard as an anchor:
where one occurs more than HOT times, each window is a segment of its own, with
the whole window as its anchor, and only windows that are equal meet.

Words are compared by 64-bit hashes within a document's own task, and by 32
bits each across the network: windows that differ in a word are taken as equal
with a probability of 2**-32 for each such word.

Defined cases: a text without words (null, empty, blank) or with fewer than
``width`` is kept; rows of one id are ordered by their texts' hashes, and equal
rows are one document, removed from alike; a null id comes after all others;
no rows give no rows.  Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import parts_for
from tablerecon.llm.wordhash import Words, mix, words_of

WIDTH = 20
#: Words of an anchor.
ANCHOR = 5
#: Occurrences of an anchor from which its segments are cut into windows.
HOT = 50_000
#: Text of a shard.
PART_BYTES = 64 << 20
#: Anchors and bytes of text a task gathers before it sends them on.
GATHERED = 1_000_000
GATHERED_BYTES = 32 << 20

_LAST = (1 << 63) - 1


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of length(p) + 1 for ``word``: ``q`` or a copy made of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            if word in moves[last]:
                last = self._split(last, word, moves[last][word])
                continue
            new, p = self._state(length[last] + 1, 0, {}), last
            while p >= 0 and word not in moves[p]:
                moves[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, word, moves[p][word])
            last = new

    def statistics(self, words: list[int]) -> list[int]:
        """Length of the longest match that ends at each word."""
        moves, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for word in words:
            while state and word not in moves[state]:
                state = link[state]
                n = length[state]
            if word in moves[state]:
                state, n = moves[state][word], n + 1
            else:
                n = 0
            out.append(n)
        return out


def segments(words: Words, width: int, anchor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with windows: its row, anchor hash, first window and number of windows of its segments."""
    grams = words.windows(anchor)
    span = width - anchor + 1
    n = max(len(grams) - span + 1, 0)
    low = np.uint64((1 << max(span - 1, 1).bit_length()) - 1)
    high = ~low
    best = np.full(n, ~np.uint64(0))
    for j in range(span):
        np.minimum(best, (grams[j : j + n] & high) | np.uint64(j), out=best)
    place = np.arange(n) + (best & low).astype(np.int64)
    for row, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist())):
        if b - a >= width:
            at = place[a : b - width + 1]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            yield row, grams[at[first]], first, np.diff(np.append(first, len(at)))


def document_key(doc_id: int | None, text: bytes) -> tuple[int, int, int]:
    """Id, hash of the text, and one number for both."""
    own = _LAST if doc_id is None else doc_id
    h = xxhash.xxh3_64_intdigest(text) >> 1
    return own, h, xxhash.xxh3_64_intdigest(f"{own}:{h}".encode()) >> 1


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _rows(part: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """The values of each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist() if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(part[a]), tuple(v[order[a:b]] for v in values)


_PACKED = "part int, data binary"


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["part", "data"]
    )


def _loaded(table: pa.Table) -> Iterator:
    return (pickle.loads(d.as_py()) for d in table.column("data"))


def _documents(docs: DataFrame, parts: int) -> DataFrame:
    """Texts dealt by document key, many compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size, press = 0, zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            made = _batch([(p, press.compress(pickle.dumps(rows, 5))) for p, rows in held.items()])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                text = text or b""
                key = document_key(doc_id, text)[2]
                held.setdefault(int(_part(np.array([key]), parts)[0]), []).append((doc_id, text))
                size += len(text)
                if size >= GATHERED_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return docs.mapInArrow(run, _PACKED)


def _texts(table: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    for data in table.column("data"):
        yield from pickle.loads(zstandard.decompress(data.as_py()))


def _repeated(docs: DataFrame, width: int, anchor: int, parts: int, hot: int) -> DataFrame:
    """By document key: the first windows of segments whose anchor occurs twice or more, and whether it is hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            anchors, keys, first = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return _batch([(p, pickle.dumps(v, 5)) for p, v in _rows(_part(anchors, parts), anchors, keys, first)])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for base, words in words_of(texts):
                for row, anchors, first, _ in segments(words, width, anchor):
                    key = document_key(ids[base + row], texts[base + row].as_py().encode())[2]
                    held.append((anchors, np.full(len(first), key, np.int64), first.astype(np.uint32)))
                    size += len(first)
                    if size >= GATHERED:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        anchors, keys, first = (np.concatenate(x) for x in zip(*_loaded(table)))
        order = np.argsort(anchors, kind="stable")
        ranked = anchors[order]
        same = ranked[1:] == ranked[:-1]
        starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(ranked) else np.zeros(0, np.int64)
        times = np.repeat(np.diff(np.append(starts, len(ranked))), np.diff(np.append(starts, len(ranked))))
        on = order[times > 1]
        rows = _rows(_part(keys[on], parts), keys[on], first[on], (times[times > 1] > hot).astype(np.uint32))
        return pa.Table.from_batches([_batch([(p, pickle.dumps(v, 5)) for p, v in rows])])

    return docs.mapInArrow(send, _PACKED).groupBy("part").applyInArrow(count, _PACKED)


def _by_document(table: pa.Table) -> dict[int, np.ndarray]:
    """Values of each document key, from rows of (keys, values)."""
    got = list(_loaded(table))
    if not got:
        return {}
    keys = np.concatenate([g[0] for g in got])
    rest = [np.concatenate([g[i] for g in got]) for i in range(1, len(got[0]))]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=~keys[0])).tolist() + [len(keys)] if len(keys) else [0]
    return {int(keys[a]): np.stack([r[order[a:b]] for r in rest]) for a, b in zip(cuts[:-1], cuts[1:])}


def _send_segments(width: int, anchor: int, parts: int):
    """Segments with a repeated anchor to the shard of their anchor; copies within the task are hits at once."""

    def run(found: pa.Table, texts: pa.Table) -> pa.Table:
        wanted = _by_document(found)
        earliest: dict[tuple[int, bytes], tuple] = {}
        hits: list[tuple[int, int, int]] = []
        done: set[int] = set()
        for doc_id, text in _texts(texts) if wanted else ():
            own, h, key = document_key(doc_id, text)
            if key not in wanted or key in done:
                continue  # equal rows are one document
            done.add(key)
            repeated, hot = wanted[key][0], set(wanted[key][0][wanted[key][1] > 0].tolist())
            for _, words in words_of(pa.array([text], pa.binary())):
                for _, anchors, first, count in segments(words, width, anchor):
                    short = (words.hashes >> np.uint64(32)).astype(np.uint32)
                    whole = words.windows(width) if hot else None
                    pieces = []
                    for i in np.flatnonzero(np.isin(first, repeated)).tolist():
                        start, n = int(first[i]), int(count[i])
                        if start in hot:
                            pieces += [(int(whole[j]), j, 1) for j in range(start, start + n)]
                        else:
                            pieces.append((int(anchors[i]), start, n))
                    for name, start, n in pieces:
                        name = name, short[start : start + n + width - 1].tobytes()
                        new, old = (own, h, start, key, n), earliest.get(name)
                        if old is None or new < old:
                            earliest[name], new = new, old
                        if new is not None:
                            hits.append((new[3], new[2], new[4]))
        rows = []
        if earliest:
            anchors = np.array([a for a, _ in earliest], np.uint64)
            for p, (at,) in _rows(_part(anchors, parts), np.arange(len(anchors))):
                picked = set(at.tolist())
                rows.append((p, [(*k, *v[:4]) for i, (k, v) in enumerate(earliest.items()) if i in picked]))
        return rows, hits

    def packed(found: pa.Table, texts: pa.Table) -> pa.Table:
        rows, hits = run(found, texts)
        out = [(p, pickle.dumps((0, r), 5)) for p, r in rows]
        if hits:
            # Carried along, to where the other hits are made.
            keys, start, count = (np.array(x, np.int64) for x in zip(*hits))
            out.append((int(keys[0]) % parts, pickle.dumps((1, (keys, start, count)), 5)))
        return pa.Table.from_batches([_batch(out)])

    return packed


def _match(width: int, parts: int):
    """Stream each anchor's segments, in order, through the automaton of those before."""

    def run(table: pa.Table) -> pa.Table:
        hits: list[tuple[int, int, int]] = []
        given: list[tuple] = []
        rows: list[tuple] = []
        for kind, value in _loaded(table):
            if kind:
                given.append(value)
            else:
                rows += value
        rows.sort(key=lambda r: (r[0], r[2:]))
        for _, group in groupby(rows, key=lambda r: r[0]):
            members = list(group)
            if len(members) == 1:
                continue
            seen: set[bytes] = set()
            automaton: Automaton | None = None
            for _, data, _, _, start, key in members:
                count = len(data) // 4 - width + 1
                if data in seen:
                    hits.append((key, start, count))
                    continue
                words = np.frombuffer(data, np.uint32).tolist()
                if automaton is None:
                    automaton = Automaton()
                elif seen:
                    long = [n >= width for n in automaton.statistics(words)[width - 1 :]]
                    hits += [(key, start + i, 1) for i, hit in enumerate(long) if hit]
                    if all(long):
                        seen.add(data)
                        continue
                automaton.add(words)
                seen.add(data)
        if hits:
            given.append(tuple(np.array(x, np.int64) for x in zip(*hits)))
        if not given:
            return pa.Table.from_batches([_batch([])])
        keys, start, count = (np.concatenate(x) for x in zip(*given))
        values = keys, start.astype(np.uint32), count.astype(np.uint32)
        return pa.Table.from_batches([_batch([(p, pickle.dumps(v, 5)) for p, v in _rows(_part(keys, parts), *values)])])

    return run


def _remove(width: int):
    def run(found: pa.Table, texts: pa.Table) -> pa.Table:
        hits = _by_document(found)
        out: dict[str, list] = {"doc_id": [], "n_words": [], "removed": [], "kept": []}
        for doc_id, text in _texts(texts):
            words = text.split()
            got = hits.get(document_key(doc_id, text)[2])
            spans = []
            if got is not None:
                marks = np.zeros(len(words) + 1, np.int32)
                np.add.at(marks, got[0].astype(np.int64), 1)
                np.add.at(marks, got[0].astype(np.int64) + got[1] + width - 1, -1)
                gone = np.cumsum(marks)[:-1] > 0
                words = [w for w, g in zip(words, gone.tolist()) if not g]
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words) + sum(s["end"] - s["start"] for s in spans))
            out["removed"].append(spans)
            out["kept"].append(b" ".join(words).decode())
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.string())]
        return pa.table({n: pa.array(out[n], t) for n, t in kinds})

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    anchor: int = ANCHOR,
    parts: int | None = None,
    hot: int = HOT,
) -> DataFrame:
    """doc_id, n_words, removed spans (word numbers) and kept words, joined by a space, of every row.

    ``parts`` is the number of shards, by default from the bytes of text: a
    shard's repeated segments, or its documents, should fit in a task's memory.
    """
    parts = parts or parts_for(docs, text_col, PART_BYTES)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = _documents(own, parts).groupBy("part")
    repeated = _repeated(own, width, anchor, parts, hot).groupBy("part")
    sent = repeated.cogroup(texts).applyInArrow(_send_segments(width, anchor, parts), _PACKED)
    hits = sent.groupBy("part").applyInArrow(_match(width, parts), _PACKED).groupBy("part")
    return hits.cogroup(texts).applyInArrow(
        _remove(width), "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string"
    )
