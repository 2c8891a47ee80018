"""Operator 12: how filters interact, by min-plus removal ranks.

A document is the set of filters it fails, a bit mask, so a part of the corpus
is one row of counts per mask, whatever its size.  For each order of the
filters their places in it are the inverse permutation.  With 0 for a failed
filter and infinity for a passed one, the min-plus product of masks and places
is the step at which a mask's documents are removed (infinity: never).  Counts
are scattered to those steps; what fails a filter but was removed earlier is
redundant there; a filter's removals summed over all orders are its Shapley
value times the number of orders.

Texts are scanned once, where they lie.  Equal texts are found by the smallest
id of each pair of 64-bit hashes; hot groups of copies shrink in the map tasks
and are joined so that adaptive execution can split them.

Defined cases: a null text is empty; a null part is the empty part; repeated
rows count as often as they occur and make no copies of each other, as only a
smaller id does; a null id has and is no smaller id, and has no label; of
several label rows of an id any 1 counts; no documents give no rows.  Columns
are renamed at the start, so further columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import stored
from tablerecon.operators.keyed import attach

#: Bounds of the filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
NAMES = "ABCDE"
_GAP = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Filters that look at a single text: short, repetitive, loud, marked up."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        n_words < LEAST_WORDS,
        n_distinct.cast("long") * 100 < n_words.cast("long") * LEAST_DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.char_length(text).cast("long") * MOST_CAPITALS_PERCENT,
        text.rlike(r"[#$%&*|]"),
    ]


def fail_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and ``mask``: bit i is set if filter i fails; the last filter is the copy of a smaller id."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    checks = text_failures(text)
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(checks)), F.lit(0))
    scanned = stored(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
            bits.alias("bits"),
            F.xxhash64(F.lit(1), text).alias("t1"),
            F.xxhash64(F.lit(2), text).alias("t2"),
        ),
        "filter-audit",
    )
    firsts = scanned.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("bits") + F.when(copy, F.lit(1 << len(checks))).otherwise(F.lit(0))
    return attach(scanned, firsts, ["t1", "t2"]).select("doc_id", "part", mask.cast("int").alias("mask"))


def with_labels(masked: DataFrame, labels: DataFrame, names: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """Add a boolean for each label: is it 1 in any row of the id?"""
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[(F.col(f"`{n}`") == 1).alias(n) for n in names])
    known = own.where("doc_id is not null").groupBy("doc_id").agg(*[F.bool_or(n).alias(n) for n in names])
    return attach(masked, known, ["doc_id"]).withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the filters in every order (1 first), and the step at which each order removes each mask.

    ``places[o, f]`` and ``steps[m, o]``; a step of ``n_filters + 1`` is never.
    """
    orders = np.array(list(permutations(range(n_filters))), np.int64).reshape(-1, n_filters)
    places = np.argsort(orders, axis=1) + 1
    failed = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters) & 1).astype(bool)
    never = n_filters + 1
    steps = np.full((len(failed), len(orders)), never, np.int64)
    for f in range(n_filters):
        np.minimum(steps, np.where(failed[:, f, None], places[None, :, f], never), out=steps)
    return places, steps


def interactions(counts: np.ndarray, n_filters: int) -> dict[str, np.ndarray]:
    """From counts per mask and weight, ``counts[m, w]``, the figures per order and step.

    ``lost[o, s, w]`` is removed at step s + 1; ``kept``, ``redundant``,
    ``unique`` and ``shapley`` are of the first weight, all documents.
    """
    places, steps = removal_steps(n_filters)
    n_orders = len(places)
    lost = np.zeros((n_orders, n_filters + 2, counts.shape[1]), np.int64)
    for o in range(n_orders):
        np.add.at(lost[o], steps[:, o], counts)
    lost = lost[:, 1 : n_filters + 1]
    removed, orders = lost[:, :, 0], np.argsort(places, axis=1)
    failed = (np.arange(len(counts))[:, None] >> np.arange(n_filters) & 1).astype(np.int64)
    fails = failed.T @ counts[:, 0]
    by_filter = np.take_along_axis(removed, places - 1, axis=1).sum(axis=0)
    return {
        "orders": orders,
        "lost": lost,
        "kept": counts[:, 0].sum() - np.cumsum(removed, axis=1),
        "redundant": fails[orders] - removed,
        "unique": counts[1 << np.arange(n_filters), 0][orders],
        "shapley": by_filter[orders],
    }


def audit(masked: DataFrame, names: str = NAMES, labels: Sequence[str] = ()) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, shapley and ``lost_<label>``.

    Parts are counted by mask first: a part is at most 2^filters rows from then on.
    """
    n = len(names)
    counts = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(F.col(x)).alias(f"n_{i}") for i, x in enumerate(labels)])
    fields = ["part string", "filter_order string", "step int", "kept long", "removed long", "redundant long", "unique_fails long", "shapley long"]
    fields += [f"`lost_{x}` long" for x in labels]

    def run(table: pa.Table) -> pa.Table:
        weights = np.zeros((1 << n, 1 + len(labels)), np.int64)
        weights[table.column("mask").to_numpy()] = np.stack([table.column(c).to_numpy() for c in table.column_names[2:]], axis=1)
        found = interactions(weights, n)
        shown = ["".join(names[f] for f in order) for order in found["orders"].tolist()]
        rows = len(shown) * n
        columns = [
            pa.array([table.column("part")[0].as_py()] * rows, pa.string()),
            pa.array([s for s in shown for _ in range(n)], pa.string()),
            pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(shown))),
            pa.array(found["kept"].reshape(-1)),
            pa.array(found["lost"][:, :, 0].reshape(-1)),
            *[pa.array(found[k].reshape(-1)) for k in ("redundant", "unique", "shapley")],
            *[pa.array(found["lost"][:, :, i + 1].reshape(-1)) for i in range(len(labels))],
        ]
        return pa.table(columns, names=[f.split()[0].strip("`") for f in fields])

    return counts.groupBy("part").applyInArrow(run, ", ".join(fields))
