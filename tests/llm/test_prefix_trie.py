"""The trie against one that is built prefix by prefix in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablerecon.llm.prefix_trie import end_digests, prefix_trie, with_texts

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(first, [])[:h] + turns[c][h:]
    return out


def brute(rows):
    made = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = {n for n in below if len(n) == len(node) + 1}
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(made[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, digest))
    return sorted(out, key=str)


def trie_rows(spark, rows, schema=SCHEMA):
    trie = prefix_trie(spark.createDataFrame(rows, schema))
    nodes = trie.nodes.join(end_digests(trie.ends), ["depth", "k1", "k2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes, ends_sha256".split(", ")
    return trie, sorted([tuple((r[n] or empty) if n == "ends_sha256" else r[n] for n in names) for r in nodes.collect()], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(-7, 70), 40) + [10**12, 10**12 + 3, 65535, 65536, 131072]
    rows = []
    for c in ids:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t if t != 2 or c % 2 else None, rng.choice(["user", "bot", "", None]), rng.choice(["a", "é", "", None, "b\n"])))
    assert trie_rows(spark, rows)[1] == brute(rows)


def test_copies_collapse_and_proper_prefixes_are_no_leaves(spark):
    # Multiples of five keep their own turns, whatever their head's length.
    rows = [(c, t, "u", f"x{t}") for c in range(0, 500, 5) for t in range(3 if c % 2 else 5)]
    trie, found = trie_rows(spark, rows)
    assert found == brute(rows)
    sequences = {(r.n_turns, r.weight, r.is_leaf) for r in trie.sequences.collect()}
    assert sequences == {(5, 50, True), (3, 50, False)}


def test_conversations_without_turns_end_at_the_root(spark):
    short = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(short, 0, "u", "a"), (short, 1, "u", "b")]
    assert trie_rows(spark, rows)[1] == brute(rows) == [
        (short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())
    ]


def test_empty_nulls_ties_and_clashing_names(spark):
    assert trie_rows(spark, [])[1] == []
    assert trie_rows(spark, [(None, 1, "u", "a")])[1] == []
    # Equal turns come in an order of their hashes: the same for copies.
    rows = [(c, 1, "u", t) for c in (0, 5, 10) for t in ("a", "b", "b")]
    found = trie_rows(spark, rows)[1]
    assert [r[1:6] for r in sorted(found, key=lambda r: r[1])] == [(0, None, 3, 1, 1), (1, 0, 3, 1, 1), (2, 0, 3, 1, 1), (3, 0, 3, 0, 1)]
    extra = ", own string, place string, family string, depth string, k1 string, conv string, rep string, h1 string, bytes string"
    wide = [r + ("?",) * 9 for r in rows]
    assert trie_rows(spark, wide, SCHEMA + extra)[1] == found


def test_long_end_list_spans_blocks_and_nodes_give_texts(spark):
    convs = spark.range(0, 700_000, 5).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("u").alias("role"), F.lit("hé").alias("text"))
    trie = prefix_trie(convs)
    assert trie.ends.count() > 2
    digest = end_digests(trie.ends).collect()
    assert [r.ends_sha256 for r in digest] == [hashlib.sha256(",".join(map(str, range(0, 700_000, 5))).encode()).hexdigest()]
    rows = {(r.depth, r.role, r.text, r.n_convs, r.saved_bytes) for r in with_texts(trie.nodes, convs).collect()}
    assert rows == {(0, None, None, 140_000, 139_999 * 3), (1, "u", "hé", 140_000, 139_999 * 3)}
