"""Match two tables on their keys: common, missing and extra rows in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.names import col
from tablerecon.functions.text import display_key, norm, norm_of
from tablerecon.operators.keyed import attach

SRC, TGT = "src_", "tgt_"
IN_SRC, IN_TGT, PAIRS = "_in_src", "_in_tgt", "_pairs"


def key_name(i: int) -> str:
    return f"_key_{i}"


def key_columns(
    a: DataFrame, b: DataFrame, keys: Sequence[str], integral_keys: bool = False
) -> tuple[list[Column], list[Column], list[bool]]:
    """Comparable key columns of both sides, and which of them are text.

    Whole-number keys of one type are matched as numbers, everything else as
    normalized text (which is never null).  ``integral_keys`` makes the texts
    ``12.0`` and ``12`` the same key.
    """
    left, right, texts = [], [], []
    for k in keys:
        ta, tb = a.schema[k].dataType, b.schema[k].dataType
        if isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType):
            left.append(col(k) if ta == tb else col(k).cast("long"))
            right.append(col(k) if ta == tb else col(k).cast("long"))
            texts.append(False)
            continue
        pair = [norm(col(k), dtype=ta), norm(col(k), dtype=tb)]
        if integral_keys:
            pair = [F.regexp_replace(p, r"^([+-]?\d+)\.0+$", "$1") for p in pair]
        left.append(pair[0])
        right.append(pair[1])
        texts.append(True)
    return left, right, texts


def _is_blank(names: Sequence[str], texts: Sequence[bool]) -> Column:
    return reduce(
        lambda x, y: x | y, [(F.col(n) == "") if t else F.col(n).isNull() for n, t in zip(names, texts)]
    )


def _side(df: DataFrame, keys: list[Column], tag: str, names: Sequence[str], mark: str) -> DataFrame:
    return df.select(
        *[k.alias(n) for k, n in zip(keys, names)],
        *[col(c).alias(tag + c) for c in df.columns],
        F.lit(True).alias(mark),
    )


def _pad(df: DataFrame, like: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def match(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    integral_keys: bool = False,
    blank_keys_match: bool = True,
    on_duplicates: str = "stop",
    keys_complete: bool = False,
    keys_unique: bool = False,
) -> DataFrame:
    """Every key of either table with the row of both sides.

    Gives ``_key_0..``, ``src_*``, ``tgt_*``, the marks ``_in_src`` and
    ``_in_tgt`` and ``_pairs``, the number of row pairs a result row stands
    for.  One shuffle per side on the key.

    ``keys_complete`` says that no key is blank (the gate counts them): then
    the join is on the bare key columns, and tables bucketed or already
    partitioned on whole-number keys are not shuffled again.

    The keys must be unique per side, so that no join key can be hot: a
    repeated one fails the job, found on the shuffle and sort that the join
    needs anyway.  ``keys_unique`` says that the gate has made sure already.
    ``on_duplicates='fanout'`` accepts repeated keys and pairs
    their rows as an SQL join does; copies of one row are counted first
    instead of paired one by one, and the pairs come from an inner join,
    whose hot partitions adaptive execution can split on both sides.
    """
    left_keys, right_keys, texts = key_columns(a, b, keys, integral_keys)
    names = [key_name(i) for i in range(len(keys))]
    other = [f"_other_{i}" for i in range(len(keys))]
    left = _side(a, left_keys, SRC, names, IN_SRC)
    right = _side(b, right_keys, TGT, other, IN_TGT)
    if on_duplicates == "fanout":
        return _fanout(left, right, names, other, blank_keys_match)

    lone_left = lone_right = None
    if not blank_keys_match and not keys_complete:
        # Rows with a blank key match nothing: they bypass the shuffle, where
        # all of them would meet in one task.
        blank_left, blank_right = _is_blank(names, texts), _is_blank(other, texts)
        lone_left, left = left.where(blank_left), left.where(~blank_left)
        lone_right, right = right.where(blank_right), right.where(~blank_right)
    null_safe = blank_keys_match and not keys_complete
    if keys_unique:
        joined = left.join(right, _condition(names, other, texts, null_safe), "full")
    else:
        left, left_on = _unique(left, names, texts, null_safe, "_left_on")
        right, right_on = _unique(right, other, texts, null_safe, "_right_on")
        on = [F.col(x) == F.col(y) for x, y in zip(left_on, right_on)]
        joined = left.join(right, reduce(lambda x, y: x & y, on), "full").drop(*left_on, *right_on)
    out = _finish(joined, names, other).withColumn(PAIRS, F.lit(1).cast("long"))
    if lone_left is not None:
        lone = [lone_left.withColumn(IN_TGT, F.lit(False)), _named(lone_right, names, other).withColumn(IN_SRC, F.lit(False))]
        for part in lone:
            out = out.unionByName(_pad(part.withColumn(PAIRS, F.lit(1).cast("long")), out))
    return out


def _unique(df: DataFrame, names, texts, null_safe: bool, tag: str) -> tuple[DataFrame, list[str]]:
    """Columns to join on, and rows that fail the job where a key comes a second time.

    A whole-number key that may be null joins as a value and a null mark, so
    that the check and the join want the same partitioning and order.
    """
    on: dict[str, Column] = {}
    for i, (n, text) in enumerate(zip(names, texts)):
        if null_safe and not text:
            on[f"{tag}_{i}"], on[f"{tag}_null_{i}"] = F.coalesce(F.col(n), F.lit(0)), F.col(n).isNull()
        else:
            on[f"{tag}_{i}"] = F.col(n)
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on])
    repeated = F.raise_error(F.concat(F.lit("a key repeats: "), F.to_json(F.struct(*names)))).cast("boolean")
    marked = df.withColumns(on).withColumn("_place", place)
    return marked.where(F.when(known & (F.col("_place") > 1), repeated).otherwise(F.lit(True))).drop("_place"), list(on)


def _condition(names, other, texts, null_safe: bool) -> Column:
    parts = []
    for n, o, text in zip(names, other, texts):
        safe = null_safe and not text
        parts.append(F.col(n).eqNullSafe(F.col(o)) if safe else F.col(n) == F.col(o))
    return reduce(lambda x, y: x & y, parts)


def _named(right: DataFrame, names, other) -> DataFrame:
    return right.withColumnsRenamed(dict(zip(other, names)))


def _finish(joined: DataFrame, names, other) -> DataFrame:
    both = {n: F.coalesce(F.col(n), F.col(o)) for n, o in zip(names, other)}
    marks = {m: F.coalesce(F.col(m), F.lit(False)) for m in (IN_SRC, IN_TGT)}
    return joined.withColumns(both | marks).drop(*other)


def _fanout(left, right, names, other, blank_keys_match) -> DataFrame:
    n_left, n_right = "_n_src", "_n_tgt"

    def texts(df: DataFrame, cols: list[str]) -> DataFrame:
        keys = {c: norm_of(df, c) for c in cols}
        # A null key equals nothing, which is what an unmatched blank needs.
        return df.withColumns(keys if blank_keys_match else {c: F.nullif(k, F.lit("")) for c, k in keys.items()})

    left, right = texts(left, names), texts(right, other)
    known = left.select(*names)
    left = left.groupBy(*[col(c) for c in left.columns]).agg(F.count(F.lit(1)).alias(n_left))
    right = right.groupBy(*[col(c) for c in right.columns]).agg(F.count(F.lit(1)).alias(n_right))
    # The outer join gives the pairs and the lone source rows; the lone target
    # rows are those without one of the plain source keys.
    condition = reduce(lambda x, y: x & y, [F.col(n) == F.col(o) for n, o in zip(names, other)])
    paired = left.join(right, condition, "left")
    paired = paired.withColumn(PAIRS, F.col(n_left) * F.coalesce(F.col(n_right), F.lit(1)))
    out = _finish(paired, names, other).drop(n_left, n_right)
    lone_right = attach(right, known, list(zip(other, names)), "left_anti")
    lone_right = _named(lone_right.withColumnRenamed(n_right, PAIRS), names, other).withColumn(IN_SRC, F.lit(False))
    out = out.unionByName(_pad(lone_right, out))
    return out.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in names})


def common_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables with a common key, as ``src_*`` and ``tgt_*``."""
    left_keys, right_keys, texts = key_columns(a, b, keys)
    names = [key_name(i) for i in range(len(keys))]
    other = [f"_other_{i}" for i in range(len(keys))]
    left = _side(a, left_keys, SRC, names, IN_SRC).drop(IN_SRC)
    right = _side(b, right_keys, TGT, other, IN_TGT).drop(IN_TGT)
    return left.join(right, _condition(names, other, texts, True), "inner").drop(*other)


def missing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows without a target key, all columns kept.

    Blank keys match each other, whether null or empty text.
    """
    left_keys, right_keys, texts = key_columns(a, b, keys)
    names = [key_name(i) for i in range(len(keys))]
    # A null whole-number key has no blank text to stand for it: its null
    # mark joins as a second part.
    marks = [f"_null_{i}" for i, t in enumerate(texts) if not t]
    nulls = [i for i, t in enumerate(texts) if not t]

    def keyed(df: DataFrame, cols: list[Column], keep: bool) -> DataFrame:
        parts = [F.coalesce(c, F.lit(0)) if not t else c for c, t in zip(cols, texts)]
        extra = [cols[i].isNull() for i in nulls]
        chosen = [p.alias(n) for p, n in zip(parts + extra, names + marks)]
        return df.select(*(["*"] if keep else []), *chosen)

    known = keyed(b, right_keys, False)
    return attach(keyed(a, left_keys, True), known, names + marks, "left_anti").drop(*names, *marks)


def extra_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows without a source key."""
    return missing_rows(b, a, keys)


def key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each distinct key with the set it belongs to: missing, extra or common.

    Distinct keys are counted per side in one shuffle, in place of two
    differences and an intersection.
    """
    left_keys, right_keys, _ = key_columns(a, b, keys)
    profile = key_profile(a, b, left_keys, right_keys, list(keys))
    which = (
        F.when(F.col("n_tgt") == 0, F.lit("missing")).when(F.col("n_src") == 0, F.lit("extra")).otherwise(F.lit("common"))
    )
    return profile.select(*[col(k) for k in keys], which.alias("key_set"))


def key_profile(
    a: DataFrame, b: DataFrame, left_keys: list[Column], right_keys: list[Column], names: list[str]
) -> DataFrame:
    """Rows per key on each side (``n_src``, ``n_tgt``), combined map-side."""
    left = a.select(*[k.alias(n) for k, n in zip(left_keys, names)], F.lit(1).alias("_s"), F.lit(0).alias("_t"))
    right = b.select(*[k.alias(n) for k, n in zip(right_keys, names)], F.lit(0).alias("_s"), F.lit(1).alias("_t"))
    both = left.unionByName(right)
    return both.groupBy(*[col(n) for n in names]).agg(F.sum("_s").alias("n_src"), F.sum("_t").alias("n_tgt"))


def key_lists(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key sets as rows of display text, in key order.

    A list of keys has no size limit, so it stays rows instead of one text.
    """
    sets = key_sets(a, b, keys)
    shown = sets.select("key_set", display_key([col(k) for k in keys]).alias("display_key"))
    return shown.orderBy("key_set", "display_key")
