"""Operator 9: near-duplicate documents by a Jaccard join on word n-grams.

A document is the set of its distinct lower-cased word 4-grams (the whole
sequence if it has fewer words).  Equal sets form one class before anything is
paired.  N-grams are ordered rare first by the number of classes that hold
them.  Two classes of similarity t or more share an n-gram among the first
|x| - ceil(t|x|) + 1 of either, so only those are joined on; n-grams of a
single class take up room in a prefix but need not be sent.

No task gathers all pairs of a frequent n-gram.  A prefix n-gram's smallest
class is its home; members of a home are first verified against the home
class.  Those that link need no comparison with each other.  The rest meet
all members in blocks of bounded size, where candidates share a prefix n-gram,
pass the length, positional and suffix filters, are not yet connected, and are
verified once, at their first common n-gram.  So every link between different
sets is found or already implied by found ones.

Defined cases: a text without words (null, empty or blank) has an empty set
and is its own component; repeated rows and equal sets share a component; a
null id is never a component's smallest while another id is there; no rows
give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import add_columns, cut, forget, parts_for
from tablerecon.llm.components import components
from tablerecon.llm.wordhash import Words, words_of

WIDTH = 4
PERCENT = 85
#: N-grams a task gathers before it sends them on.
GATHERED = 500_000
#: Text whose n-grams one hash range holds, about four times as much.
PART_BYTES = 64 << 20
#: Members of a block; a task of the block stage holds two blocks.
BLOCK = 256
#: Hash ranges of a set by which the suffix filter bounds an overlap.
RANGES = 32

_LEAST = np.uint64(0x632BE59BD9B4E019)


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    full = words.windows(width)
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            short = Words(words.hashes[a:b], words.at, words.starts, words.ends, words.data)
            yield short.windows(b - a) ^ _LEAST
        else:
            yield np.zeros(0, np.uint64)


def set_key(grams: np.ndarray) -> int | None:
    """Signed 64-bit name of a set; null for the empty one."""
    return int(np.int64(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63))) if len(grams) else None


def _pack(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, *values: np.ndarray) -> bytes:
    """Keys with their set sizes and counts, then the values of all keys in turn."""
    head = np.array([len(keys), sum(map(len, values)) // max(len(values), 1)], np.int64)
    return b"".join(x.tobytes() for x in (head, keys, sizes, counts, *values))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    keys, n = np.frombuffer(data, np.int64, 2).tolist()
    out, at = [], 16
    for kind, size in ((np.int64, keys), (np.int32, keys), (np.int32, keys), *((k, n) for k in kinds)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _dealt(part: np.ndarray, keys: np.ndarray, sizes: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One row per part; ``part``, ``keys`` and ``sizes`` go with each value."""
    order = np.argsort(part, kind="stable")
    part, keys, sizes = part[order], keys[order], sizes[order]
    values = tuple(v[order] for v in values)
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else []
    rows, data = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        first = np.flatnonzero(np.diff(keys[a:b], prepend=~keys[a]))
        counts = np.diff(np.append(first, b - a)).astype(np.int32)
        rows.append(int(part[a]))
        data.append(_pack(keys[a:b][first], sizes[a:b][first].astype(np.int32), counts, *(v[a:b] for v in values)))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int32)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """Size of the n-gram set and the set's name, beside all columns but the text."""

    def run(column: pa.Array) -> list:
        sizes, keys = [], []
        for _, words in words_of(column, lower=True):
            for grams in shingle_sets(words, width):
                sizes.append(len(grams))
                keys.append(set_key(grams))
        return [sizes, keys]

    return add_columns(docs, ["text"], "n_shingles long, key long", run, [c for c in docs.columns if c != "text"])


def shared_grams(docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Classes with an n-gram of another class in their prefix.

    Columns: key, size of the set, ``grams`` held by two classes or more in
    rare-first order, and how many of them lie in the prefix (``reach``).
    N-grams cross the network as packed arrays, once by n-gram and, if shared,
    once back by class.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        kept: list[np.ndarray] = []
        keys: list[int] = []

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(g) for g in kept])
            grams, names = np.concatenate(kept), np.repeat(np.array(keys, np.int64), lengths)
            made = _dealt(_part(grams, parts), names, np.repeat(lengths, lengths), grams)
            kept.clear()
            keys.clear()
            return made

        size = 0
        for batch in batches:
            for _, words in words_of(batch.column(1), lower=True):
                for grams in shingle_sets(words, width):
                    key = set_key(grams)
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    kept.append(grams)
                    keys.append(key)
                    size += len(grams)
                    if size >= GATHERED:
                        yield flush()
                        size = 0
                        if len(seen) > GATHERED:
                            seen.clear()
        if kept:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        forget()
        got = [_unpack(d.as_py(), np.uint64) for d in table.column("data")]
        keys = np.concatenate([np.repeat(g[0], g[2]) for g in got])
        sizes = np.concatenate([np.repeat(g[1], g[2]) for g in got])
        grams = np.concatenate([g[3] for g in got])
        del got
        order = np.lexsort((keys, grams))
        keys, sizes, grams = keys[order], sizes[order], grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])
        keys, sizes, grams = keys[new], sizes[new], grams[new]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        times = np.diff(np.append(first, len(grams)))
        times = np.repeat(times, times)
        on = np.flatnonzero(times > 1)
        on = on[np.argsort(keys[on], kind="stable")]
        back = _part(keys[on].view(np.uint64), parts)
        return pa.Table.from_batches([_dealt(back, keys[on], sizes[on], grams[on], times[on].astype(np.int32))])

    def gather(table: pa.Table) -> pa.Table:
        forget()
        got = [_unpack(d.as_py(), np.uint64, np.int32) for d in table.column("data")]
        keys = np.concatenate([np.repeat(g[0], g[2]) for g in got])
        sizes = np.concatenate([np.repeat(g[1], g[2]) for g in got])
        grams, times = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got])
        order = np.lexsort((grams, times, keys))
        keys, sizes, grams = keys[order], sizes[order].astype(np.int64), grams[order].view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        shared = np.diff(np.append(first, len(keys)))
        n = sizes[first]
        prefix = n - (percent * n + 99) // 100 + 1
        reach = np.minimum(prefix - (n - shared), shared)
        rows = [
            {"key": k, "size": s, "reach": r, "grams": grams[a : a + m]}
            for k, s, r, a, m in zip(keys[first].tolist(), n.tolist(), reach.tolist(), first.tolist(), shared.tolist())
            if r > 0
        ]
        return pa.Table.from_pylist(rows, pa.schema([("key", pa.int64()), ("size", pa.int64()), ("reach", pa.int64()), ("grams", pa.list_(pa.int64()))]))

    packed = "part int, data binary"
    return (
        docs.mapInArrow(send, packed)
        .groupBy("part")
        .applyInArrow(count, packed)
        .groupBy("part")
        .applyInArrow(gather, "key long, size long, reach long, grams array<long>")
    )


def least_overlap(m: int, n: int, percent: int) -> int:
    """Common n-grams that sets of these sizes need for 100 * common >= percent * union."""
    return -(-percent * (m + n) // (100 + percent))


def block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between the two sides of a block pair, or within one block; a forest of them."""
    keys, sizes = table.column("key").to_pylist(), table.column("size").to_pylist()
    side, reach = table.column("side").to_pylist(), table.column("reach").to_pylist()
    lists = table.column("grams").to_pylist()
    home_grams = table.column("home_grams").to_pylist()
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    sets = [frozenset(g) for g in lists]
    prefixes = [g[:r] for g, r in zip(lists, reach)]
    heads = [frozenset(p) for p in prefixes]
    homes = [frozenset(g) for g in home_grams]
    ranges = np.zeros((len(keys), RANGES), np.int32)
    for x, grams in enumerate(lists):
        ranges[x] = np.bincount((np.array(grams, np.int64).view(np.uint64) >> np.uint64(65 - RANGES.bit_length())).astype(np.int64), minlength=RANGES)
    parent = list(range(len(keys)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # Members that the home class links are one component already; sides of
    # linked members hold nothing else.
    linked = [x for x, v in enumerate(table.column("linked").to_pylist()) if v]
    for x in linked[1:]:
        parent[x] = linked[0]
    holders: dict[int, list[tuple[int, int]]] = {}
    for x in range(len(keys)):
        if one or side[x] == 0:
            for at, gram in enumerate(prefixes[x]):
                if gram in homes[x]:
                    holders.setdefault(gram, []).append((x, at))
    links = []
    for y in range(len(keys)):
        if not one and side[y] == 0:
            continue
        tried: set[int] = set()
        for at, gram in enumerate(prefixes[y]):
            for x, other in holders.get(gram, ()) if gram in homes[y] else ():
                if x in tried or x == y or (one and x > y):
                    continue
                tried.add(x)
                m, n = sizes[x], sizes[y]
                need = least_overlap(m, n, percent)
                if min(m, n) < need or root(x) == root(y):
                    continue
                # Positional filter: what either set has before and from this n-gram on.
                if min(other, at) + min(len(lists[x]) - other, len(lists[y]) - at) < need:
                    continue
                # Suffix filter: the overlap in each hash range is at most the smaller part.
                if int(np.minimum(ranges[x], ranges[y]).sum()) < need:
                    continue
                common = heads[x] & heads[y]
                if next(g for g in prefixes[y] if g in common) not in homes[y]:
                    continue  # verified in the home of their first common n-gram
                if len(sets[x] & sets[y]) >= need:
                    links.append((keys[x], keys[y]))
                    parent[root(x)] = root(y)
    return links


def class_links(classes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links that connect the same classes as all links of similarity ``percent`` do."""
    heads = classes.select("key", F.explode(F.expr("slice(grams, 1, cast(reach as int))")).alias("gram"))
    homes = heads.groupBy("gram").agg(F.min("key").alias("home"), F.count("*").alias("n")).where("n > 1")
    homes = homes.select(F.col("gram").alias("_gram"), F.xxhash64("gram").alias("_h"), "home")
    at_home = heads.withColumn("h", F.xxhash64("gram")).join(homes, (F.col("gram") == F.col("_gram")) & (F.col("h") == F.col("_h")))
    members = at_home.groupBy("home", "key").agg(F.collect_list("gram").alias("home_grams"))
    first = classes.select(F.col("key").alias("home"), F.col("size").alias("home_size"), F.col("grams").alias("first_grams"))
    common = F.size(F.array_intersect("grams", "first_grams"))
    star = cut(
        members.where("home <> key")
        .join(classes, "key")
        .join(first, "home")
        .select("home", "key", "home_grams", (100 * common >= percent * (F.col("size") + F.col("home_size") - common)).alias("linked"))
    )
    counts = star.groupBy("home").agg(
        F.ceil(F.count_if(~F.col("linked")) / block).cast("int").alias("open_blocks"),
        F.ceil(F.count_if("linked") / block).cast("int").alias("linked_blocks"),
        F.count("*").alias("n"),
    )
    counts = counts.where("open_blocks > 0 and n > 1").select(F.col("home").alias("_home"), F.xxhash64("home").alias("_h"), "open_blocks", "linked_blocks")
    open_home = (F.col("home") == F.col("_home")) & (F.col("h") == F.col("_h"))
    own = F.when(F.col("linked"), F.pmod(F.xxhash64("key"), F.greatest("linked_blocks", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("key"), F.col("open_blocks"))
    )
    # Tasks of a home: open block i with open block j >= i, and with linked block j.
    tasks = F.expr(
        """CASE WHEN linked THEN transform(sequence(0, open_blocks - 1), x -> struct(x AS i, open_blocks + b AS j, 1 AS side))
        ELSE concat(
            transform(sequence(b, open_blocks - 1), x -> struct(b AS i, x AS j, 0 AS side)),
            transform(filter(sequence(0, b), x -> x < b), x -> struct(x AS i, b AS j, 1 AS side)),
            transform(filter(sequence(0, linked_blocks), x -> x < linked_blocks), x -> struct(b AS i, open_blocks + x AS j, 0 AS side)))
        END"""
    )
    dealt = (
        star.withColumn("h", F.xxhash64("home"))
        .join(counts, open_home)
        .withColumn("b", own.cast("int"))
        .select("home", "key", "home_grams", "linked", F.explode(tasks).alias("t"))
        .select("home", "key", "home_grams", "linked", "t.*")
        .join(classes, "key")
    )

    def run(table: pa.Table) -> pa.Table:
        links = block_links(table, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    found = dealt.groupBy("home", "i", "j").applyInArrow(run, "a long, b long")
    return star.where("linked").select(F.col("home").alias("a"), F.col("key").alias("b")).unionAll(found)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    block: int = BLOCK,
    parts: int | None = None,
    carry: str | None = None,
) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable by links, of each row.

    ``carry`` names a column that goes along, as does then ``component``, a
    name of the component that is null for an empty set.  ``parts`` is the
    number of hash ranges the n-grams are counted in, by default from the bytes
    of text: a range should fit in a task's memory.
    """
    parts = parts or parts_for(docs, text_col, PART_BYTES)
    own_columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    own = docs.select(*own_columns)
    carried = [F.col(f"`{carry}`").alias("carried")] if carry else []
    sets = cut(sets_of(docs.select(*own_columns, *carried), width))
    classes = cut(shared_grams(own, width, percent, parts))
    joined = components(class_links(classes, percent, block))
    least = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = least.join(joined, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    totals = named.groupBy("label").agg(F.min("least").alias("component_id"))
    result = named.join(totals, "label").select(F.col("key").alias("_key"), F.xxhash64("key").alias("_h"), "component_id", "label")
    more = [F.col("carried").alias(carry), F.col("label").alias("component")] if carry else []
    return (
        sets.withColumn("h", F.xxhash64("key"))
        .join(result, (F.col("key") == F.col("_key")) & (F.col("h") == F.col("_h")), "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more)
    )
