"""Operator 11: the prefix trie of conversations, by collapsing whole sequences.

A conversation is rebuilt from the head of its family's first conversation and
its own tail.  A prefix of rebuilt turns is named by its length and two 64-bit
words, each the exclusive or of hashes of (place, role, text), so that a
running window gives the names of all prefixes of a conversation at once.

Identical rebuilt conversations become one weighted sequence, whose ends are
listed in blocks of ids.  Only the prefixes of these distinct sequences are
unfolded.  A sequence that is a proper prefix of another goes in an anti-join;
those left are the leaves.  A node belongs to the sequence with its smallest
conversation, and a sequence owns the nodes from some depth on.  So children
and the bytes of distinct nodes below a node are sums over the sequences that
pass it, like its weight: everything is one aggregation with partial sums,
and no task gathers the members of a node.

Defined cases: turns are ordered with null first, equal ones by a hash of role
and text, repeated rows are turns of their own; null role or text is empty; a
null conversation id is no conversation; a conversation without rebuilt turns
ends at the root; no rows give no nodes.  Other columns are not read.  Names
of 128 bits tell prefixes apart with a chance of error below n^2 / 2^128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablerecon.llm.common import stored
from tablerecon.operators.keyed import attach

#: Conversations of a family share its first one's head, of up to HEADS - 1 turns.
FAMILY, HEADS = 5, 9
#: Ids of a block of an end list, as a power of two.
BLOCK_BITS = 16

_NODE = ["depth", "k1", "k2"]


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per distinct prefix, with the place of its last turn.

    ``sequences``: distinct rebuilt conversations by their smallest id, with
    number of turns, weight and whether they are leaves.  ``ends``: for each
    node where conversations end, their ids in blocks of ascending order.
    """

    nodes: DataFrame
    sequences: DataFrame
    ends: DataFrame


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def _turns(conversations: DataFrame) -> DataFrame:
    """Numbered turns without their texts: hashes, bytes and the family's first id."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"),
        conv.alias("own"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("family", "own").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    return turns.withColumn("place", F.row_number().over(order).cast("long")).drop("turn")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations, and a turn of depth 0 for each of them.

    A family meets in one place once; its first conversation's head is copied
    to the at most ``2 * FAMILY - 2`` others, everything else stays where it is.
    """
    family = Window.partitionBy("family")
    known = _turns(conversations).withColumns(
        {
            "members": F.collect_set("own").over(family),
            "first_turns": F.count_if(F.col("own") == F.col("family")).over(family),
        }
    )
    own, place, head = F.col("own"), F.col("place"), head_length(F.col("own"))

    def at(conv: Column, depth: Column) -> Column:
        return F.struct(conv.alias("conv"), depth.cast("long").alias("depth"))

    others = F.filter("members", lambda m: (m != own) & (head_length(m) >= place))
    lent = F.concat(F.array(at(own, place)), F.transform(others, lambda m: at(m, place)))
    tail = F.array(at(own, F.least(head, F.col("first_turns")) + place - head))
    none = F.filter(F.array(at(own, place)), lambda x: F.lit(False))
    turns = F.when(own == F.col("family"), lent).when(place > head, tail).otherwise(none)
    roots = F.when(place == 1, F.array(at(own, F.lit(0)))).otherwise(none)
    rows = known.select("family", "own", "place", "h1", "h2", "bytes", F.explode(F.concat(turns, roots)).alias("to"))
    zero, depth = F.lit(0).cast("long"), F.col("depth")
    return rows.select("family", "own", "place", "h1", "h2", "bytes", "to.*").select(
        "family",
        "conv",
        "depth",
        *[F.when(depth == 0, zero).otherwise(F.xxhash64("depth", h)).alias(x) for h, x in (("h1", "x1"), ("h2", "x2"))],
        F.when(depth == 0, zero).otherwise(F.col("bytes")).alias("bytes"),
        F.when(depth > 0, own).alias("from_conv_id"),
        F.when(depth > 0, place).alias("from_place"),
    )


def _prefixes(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation, and the name of the whole."""
    whole = Window.partitionBy("family", "conv")
    so_far = whole.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rebuilt(conversations).select(
        "*",
        F.bit_xor("x1").over(so_far).alias("k1"),
        F.bit_xor("x2").over(so_far).alias("k2"),
        F.sum("bytes").over(so_far).alias("upto"),
        F.bit_xor("x1").over(whole).alias("e1"),
        F.bit_xor("x2").over(whole).alias("e2"),
        F.max("depth").over(whole).alias("n_turns"),
        F.sum("bytes").over(whole).alias("total"),
    )
    return named.select(
        "conv",
        *_NODE,
        F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"),
        "bytes",
        (F.col("total") - F.col("upto") + F.col("bytes")).alias("rest"),
        "from_conv_id",
        "from_place",
        "e1",
        "e2",
        "n_turns",
    )


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of rebuilt conversations.

    Nodes hold conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_bytes, from_conv_id and from_place (which turn
    of the table its last turn is) and k1, k2, the rest of its name.
    """
    prefixes = _prefixes(conversations)
    wholes = stored(prefixes.where("depth = 0").select("conv", "e1", "e2", "n_turns"), "trie-wholes")
    sequences = wholes.groupBy("e1", "e2", "n_turns").agg(F.min("conv").alias("rep"), F.count("*").alias("weight"))
    weights = sequences.select("rep", "weight")
    unfolded = stored(prefixes.join(weights, F.col("conv") == F.col("rep")).drop("conv", "e1", "e2"), "trie-prefixes")

    owner = F.min(F.struct("rep", "from_conv_id", "from_place")).alias("owner")
    nodes = unfolded.groupBy(*_NODE).agg(owner, F.max("n_turns").alias("deepest"), F.max("bytes").alias("bytes"))
    nodes = stored(nodes.select(*_NODE, "owner.*", "deepest", "bytes"), "trie-nodes")
    inner = nodes.where("deepest > depth").select(*_NODE)
    at_end = [F.col(a) == F.col(b) for a, b in zip(("n_turns", "e1", "e2"), _NODE)]
    leaves = sequences.join(inner, at_end, "left_anti").select("rep", F.lit(True).alias("is_leaf"))
    owned = nodes.groupBy("rep").agg(F.min("depth").alias("from_depth"), F.sum("bytes").alias("owned_bytes"))
    facts = sequences.join(leaves, "rep", "left").join(owned, "rep", "left")
    facts = stored(
        facts.select(
            "rep",
            "n_turns",
            "weight",
            F.coalesce("is_leaf", F.lit(False)).alias("is_leaf"),
            F.coalesce("from_depth", F.col("n_turns") + 1).alias("from_depth"),
            F.coalesce("owned_bytes", F.lit(0)).alias("owned_bytes"),
        ),
        "trie-sequences",
    )

    child = (F.col("depth") < F.col("n_turns")) & (F.col("depth") + 1 >= F.col("from_depth"))
    totals = (
        unfolded.select("rep", *_NODE, "p1", "p2", "rest", "n_turns", "weight")
        .join(facts.select("rep", "is_leaf", "from_depth", "owned_bytes"), "rep")
        .groupBy(*_NODE)
        .agg(
            F.max("p1").alias("p1"),
            F.max("p2").alias("p2"),
            F.sum("weight").alias("n_convs"),
            F.count_if(child).alias("n_children"),
            F.count_if("is_leaf").alias("n_leaves"),
            F.sum(F.col("weight") * F.col("rest") - F.least("owned_bytes", "rest")).alias("saved_bytes"),
        )
    )
    owners = nodes.select(*_NODE, F.col("rep").alias("conv_id"), "from_conv_id", "from_place")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_conv_id"))
    found = attach(attach(totals, owners, _NODE), parents, ["depth", "p1", "p2"])
    found = found.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))

    block = F.shiftright("conv", BLOCK_BITS)
    ends = wholes.groupBy(F.col("n_turns").alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), block.alias("block"))
    ends = ends.agg(F.array_sort(F.collect_list("conv")).alias("conv_ids"))
    return Trie(found.drop("p1", "p2"), facts.withColumnRenamed("rep", "conv_id"), ends)


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each end list, ids in ascending order between commas: depth, k1, k2, ends_sha256.

    Blocks are rendered where they lie; a list's blocks then stream in order
    through the one digest that such a chain needs, a block at a time.
    """
    names = [*_NODE, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def made() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)] or [[], [], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.string()))], names=names)

        for batch in batches:
            *keys, blocks = [c.to_pylist() for c in batch.columns]
            for now, block in zip(zip(*keys), blocks):
                if now == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                digest.update(block.encode())
            yield made()
        if key is not None:
            done.append((*key, digest.hexdigest()))
        yield made()

    shown = F.array_join(F.transform("conv_ids", lambda c: c.cast("string")), ",")
    rows = ends.select(*_NODE, "block", shown.alias("ids"))
    ordered = rows.repartition("k1", "k2", "depth").sortWithinPartitions(*_NODE, "block")
    return ordered.select(*_NODE, "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn (null at the root)."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(conv.isNotNull()).select(conv.alias("from_conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("from_conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.xxhash64(F.lit(1), "role", "text"), F.xxhash64(F.lit(2), "role", "text")
    )
    turns = rows.withColumn("from_place", F.row_number().over(order).cast("long")).drop("turn")
    return nodes.join(turns, ["from_conv_id", "from_place"], "left")
