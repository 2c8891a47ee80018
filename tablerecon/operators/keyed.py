"""Joins of a big table with a key-unique one, safe against hot keys.

No side is broadcast by hint; Spark broadcasts what its own estimate allows.
Beyond that the join shuffles, and adaptive execution splits the left
partitions that hot keys swell.  It can do so only if both sides come straight
from a shuffle made for the join.  A right side that was grouped by the key
lies there already, so a hash of the key joins as a second equality: the small
right side is shuffled once more and the left can be split.  Semi and anti
joins take the plain key columns of the right side instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.names import col

On = Sequence[str | tuple[str, str]]

_LEFT_HASH, _RIGHT_HASH = "_left_hash", "_right_hash"


def key_pairs(on: On | str) -> list[tuple[str, str]]:
    """``['k', ('a', 'b')]`` as ``[('k', 'k'), ('a', 'b')]``."""
    if isinstance(on, str):
        on = [on]
    return [(o, o) if isinstance(o, str) else (o[0], o[1]) for o in on]


def attach(
    left: DataFrame,
    right: DataFrame,
    on: On | str,
    how: str = "left",
) -> DataFrame:
    """Join ``left`` with ``right``, whose rows are unique on the key.

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``; for the
    last two ``right`` may repeat keys.  The right's key columns are dropped;
    its other columns must not clash with the left's.
    """
    pairs = key_pairs(on)
    renamed = {r: f"_right_key_{i}" for i, (_, r) in enumerate(pairs)}
    right = right.select(*[col(c).alias(renamed.get(c, c)) for c in right.columns])
    lefts, rights = [], []
    for l, r in pairs:
        tl, tr = left.schema[l].dataType, right.schema[renamed[r]].dataType
        common = common_type(tl, tr)
        lefts.append(col(l) if tl == common else col(l).try_cast(common))
        rights.append(F.col(renamed[r]) if tr == common else F.col(renamed[r]).try_cast(common))
    extra = []
    if how in ("left", "inner"):
        extra = [_LEFT_HASH, _RIGHT_HASH]
        left = left.withColumn(_LEFT_HASH, F.xxhash64(*lefts))
        right = right.withColumn(_RIGHT_HASH, F.xxhash64(*rights))
    parts = [x == y for x, y in zip(lefts + [F.col(e) for e in extra[:1]], rights + [F.col(e) for e in extra[1:]])]
    return left.join(right, reduce(lambda x, y: x & y, parts), how).drop(*renamed.values(), *extra)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two keys are compared.

    Whole numbers meet as ``bigint``, other numbers as decimals or doubles,
    and a text meets numbers, dates and booleans as what they are.
    """
    if a == b:
        return a
    kinds = [t for t in (a, b) if not isinstance(t, (T.StringType, T.CharType, T.VarcharType))]
    if len(kinds) == 1:
        return T.LongType() if isinstance(kinds[0], T.IntegralType) else kinds[0]
    if not kinds:
        return T.StringType()
    if all(isinstance(t, T.IntegralType) for t in kinds):
        return T.LongType()
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in kinds):
        return T.DecimalType(38, max(t.scale for t in kinds if isinstance(t, T.DecimalType)))
    if all(isinstance(t, T.NumericType) for t in kinds):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in kinds):
        return next(t for t in kinds if not isinstance(t, T.DateType))
    return T.StringType()


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    order: Sequence[str],
    last: bool = False,
) -> DataFrame:
    """One row per key: the values of its first (or last) row in ``order``.

    An aggregate, so a hot key shrinks to one row per task before the shuffle.
    """
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*[col(v) for v in values]), F.struct(*[col(o) for o in order]))
    out = df.groupBy(*[col(k) for k in keys]).agg(best.alias("_best"))
    return out.select(*[col(k) for k in keys], *[F.col("_best").getField(v).alias(v) for v in values])
