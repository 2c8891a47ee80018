"""Membership tests, code lookups and keyed updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.functions.names import col
from tablerecon.functions.text import norm_of
from tablerecon.operators.keyed import On, attach, first_per_key, key_pairs


def _keys_of(b: DataFrame, on: On | str) -> DataFrame:
    """Key columns as they are: a semi or anti join needs no distinct ones."""
    return b.select(*[col(r) for _, r in key_pairs(on)])


def flag_exists(a: DataFrame, b: DataFrame, on: On | str, name: str = "found") -> DataFrame:
    """Every row of ``a`` with a flag: does its key occur in ``b``?"""
    known = _keys_of(b, on).distinct().withColumn(name, F.lit(True))
    return attach(a, known, on).withColumn(name, F.coalesce(col(name), F.lit(False)))


def not_found(a: DataFrame, b: DataFrame, on: On | str) -> DataFrame:
    """Rows of ``a`` whose key does not occur in ``b``."""
    return attach(a, _keys_of(b, on), on, "left_anti")


def keep_known(a: DataFrame, b: DataFrame, on: On | str) -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b``."""
    return attach(a, _keys_of(b, on), on, "left_semi")


def rows_for_keys(df: DataFrame, keys: DataFrame, on: On | str) -> DataFrame:
    """Full rows for a set of keys."""
    return keep_known(df, keys, on)


def lookup_left(
    a: DataFrame, b: DataFrame, on: On | str, values: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Fill values from the first row of ``b`` with the same (differently named) key."""
    keys = [r for _, r in key_pairs(on)]
    return attach(a, first_per_key(b, keys, values, order), on)


def map_frame(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """A rule sheet's lookup map as a table ``(key, value)``."""
    return spark.createDataFrame(list(mapping.items()), "key string, value string")


def map_values(
    df: DataFrame,
    name: str,
    map_df: DataFrame,
    key: str = "key",
    value: str = "value",
    order: Sequence[str] = (),
    into: str | None = None,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Translate a column by the first match; an unmatched value stays (or is null)."""
    small = map_df.select(
        norm_of(map_df, key).alias("_map_key"),
        col(value).cast("string").alias("_map_value"),
        *[col(o).alias(f"_map_order_{i}") for i, o in enumerate(order)],
    ).where(F.col("_map_key") != "")
    orders = [f"_map_order_{i}" for i in range(len(order))] or ["_map_value"]
    first = first_per_key(small, ["_map_key"], ["_map_value"], orders)
    probe = df.withColumn("_probe", norm_of(df, name))
    out = attach(probe, first, [("_probe", "_map_key")])
    found = F.col("_map_value")
    result = F.coalesce(found, col(name).cast("string")) if keep_unmatched else found
    return out.withColumn(into or name, result).drop("_probe", "_map_value")


def map_values_preferring(
    df: DataFrame,
    name: str,
    mapping: DataFrame,
    key: str,
    code: str,
    parts: Sequence[str],
    target: DataFrame,
    target_col: str,
    order: Sequence[str],
    length: int = 4,
    into: str | None = None,
) -> DataFrame:
    """One-to-many lookup that prefers codes the target uses.

    Of a value's mapping rows the first whose ``parts`` joined with ``-``
    occur in the target wins, else its first row; the code is cut to
    ``length``.  A value without mapping rows becomes null.
    """
    numbered = mapping.select(
        col(key).cast("string").alias("_map_key"),
        col(code).cast("string").alias("_map_code"),
        F.concat_ws("-", *[col(p).cast("string") for p in parts]).alias("_map_text"),
        *[col(o).alias(f"_map_order_{i}") for i, o in enumerate(order)],
    )
    used = flag_exists(numbered, target, [("_map_text", target_col)], "_used")
    used = used.withColumn("_unused", ~F.col("_used"))
    orders = ["_unused"] + [f"_map_order_{i}" for i in range(len(order))]
    best = first_per_key(used, ["_map_key"], ["_map_code"], orders)
    out = attach(df, best, [(name, "_map_key")])
    return out.withColumn(into or name, F.substring("_map_code", 1, length)).drop("_map_code")


def map_composite(
    df: DataFrame,
    name: str,
    mapping: DataFrame,
    parts: Sequence[str],
    code: str,
    order: Sequence[str],
    length: int = 4,
    into: str | None = None,
) -> DataFrame:
    """Look a value up among ``parts`` joined with ``-``; unmatched keeps its own prefix."""
    small = mapping.select(
        F.concat_ws("-", *[col(p).cast("string") for p in parts]).alias("_map_text"),
        col(code).cast("string").alias("_map_code"),
        *[col(o).alias(f"_map_order_{i}") for i, o in enumerate(order)],
    )
    first = first_per_key(small, ["_map_text"], ["_map_code"], [f"_map_order_{i}" for i in range(len(order))])
    out = attach(df, first, [(name, "_map_text")])
    chosen = F.coalesce(F.col("_map_code"), col(name).cast("string"))
    return out.withColumn(into or name, F.substring(chosen, 1, length)).drop("_map_code")


def build_multimap(
    df: DataFrame, key: str, value: str, sep: str = "|", header_words: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """Allowed values per key as distinct rows ``(key, value)``.

    Cells hold several values split by ``sep``.  Rows with a blank on either
    side are left out.  The first row by ``order`` is taken for a repeated
    header if its key or value contains one of ``header_words``; later rows
    never are.  The pairs stay rows, so a key may have any number of values.
    """
    pairs = df.select(norm_of(df, key).alias("key"), norm_of(df, value).alias("value"), *([col(order).alias("_order")] if order else []))
    if header_words:
        if order is None:
            raise ValueError("header words need the column that orders the rows")
        named = reduce(
            lambda x, y: x | y, [F.contains(c, F.lit(w)) for w in header_words for c in (F.col("key"), F.col("value"))]
        )
        first = df.agg(F.min(col(order))).scalar()
        pairs = pairs.where(~(F.col("_order").eqNullSafe(first) & named))
    pairs = pairs.where((F.col("key") != "") & (F.col("value") != ""))
    return pairs.select("key", F.explode(F.split("value", f"[{sep}]")).alias("value")).distinct()


def allowed_match(
    df: DataFrame, source: str, target: str, multimap: DataFrame, name: str = "allowed"
) -> DataFrame:
    """Is the target value one of those allowed for the source value?  Two blanks match."""
    pairs = multimap.select(
        F.col("key").alias("_allowed_key"), F.col("value").alias("_allowed_value")
    ).distinct().withColumn(name, F.lit(True))
    probe = df.withColumns({"_probe_key": norm_of(df, source), "_probe_value": norm_of(df, target)})
    out = attach(probe, pairs, [("_probe_key", "_allowed_key"), ("_probe_value", "_allowed_value")])
    both_blank = (F.col("_probe_key") == "") & (F.col("_probe_value") == "")
    return out.withColumn(name, both_blank | F.coalesce(col(name), F.lit(False))).drop("_probe_key", "_probe_value")


def coded_match(
    df: DataFrame,
    source: str,
    target: str,
    map_df: DataFrame,
    key: str = "key",
    value: str = "value",
    translate: str = "source",
    order: Sequence[str] = (),
    name: str = "matches",
) -> DataFrame:
    """Are both values equal after translating one side by the map?"""
    side, other = (source, target) if translate == "source" else (target, source)
    out = map_values(df, side, map_df, key, value, order, into="_translated")
    return out.withColumn(name, norm_of(out, "_translated") == norm_of(out, other)).drop("_translated")


def apply_updates(
    df: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    order: Sequence[str] = (),
) -> DataFrame:
    """Set columns of the rows whose key has an update; the last update wins.

    ``order`` tells which update is last; without it the keys of ``updates``
    must be unique.
    """
    if order:
        updates = first_per_key(updates, keys, names, order, last=True)
    fresh = updates.select(
        *[col(k) for k in keys], *[col(n).alias(f"_new_{n}") for n in names], F.lit(True).alias("_updated")
    )
    out = attach(df, fresh, list(keys))
    hit = F.coalesce(F.col("_updated"), F.lit(False))
    out = out.withColumns({n: F.when(hit, col(f"_new_{n}")).otherwise(col(n)) for n in names})
    return out.select(*[col(c) for c in df.columns])
