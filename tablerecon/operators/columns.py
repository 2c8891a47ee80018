"""Column sets: names, selection, types, guards."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.text import norm_of
from tablerecon.functions.names import col


class SchemaError(ValueError):
    """Tables that lack what a job needs."""


def clean_name(name: str) -> str:
    return re.sub(r"[*\s]+", "", name)


# What stands before a leading digit, for no name, and the longest name.
DIGIT_PREFIX, NO_NAME, NAME_LENGTH = "col_", "unnamed_column", 64


def sanitize_names(names: Sequence[str], length: int = NAME_LENGTH) -> list[str]:
    """Distinct names of word characters; a repeated one gets a number within ``length``."""
    taken: set[str] = set()
    out = []
    for name in names:
        letters = "".join(c if c.isalnum() or c == "_" else "_" for c in name) or NO_NAME
        base = (DIGIT_PREFIX if letters[0].isdigit() else "") + letters
        candidate, n = base[:length], 1
        while candidate.lower() in taken:
            n += 1
            candidate = f"{base[: length - len(str(n)) - 1]}_{n}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def clean_columns(df: DataFrame) -> DataFrame:
    """Drop ``*`` and every whitespace character from the column names."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def sanitize_columns(df: DataFrame, length: int = NAME_LENGTH) -> DataFrame:
    """Distinct names of word characters, not starting with a digit, at most ``length`` long."""
    return df.toDF(*sanitize_names(df.columns, length))


def select_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, found by their cleaned names."""
    by_name = {clean_name(c): c for c in df.columns}
    return df.select(*[col(by_name[n]).alias(n) for n in map(clean_name, names) if n in by_name])


def cast_columns(df: DataFrame, types: Mapping[str, str | T.DataType]) -> DataFrame:
    """Override column types; text that does not fit becomes null."""
    return df.withColumns({c: col(c).try_cast(t) for c, t in types.items()})


def set_columns(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Set columns to a constant or to another column (``F.col(...)``)."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()})


def missing_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n not in have]


def require_columns(
    df: DataFrame,
    names: Iterable[str],
    other: DataFrame | None = None,
    other_names: Iterable[str] = (),
) -> None:
    """Fail with a list of what each table lacks."""
    parts = []
    lacking = missing_columns(df, names)
    if lacking:
        parts.append(f"source lacks {', '.join(lacking)}")
    if other is not None:
        lacking = missing_columns(other, other_names)
        if lacking:
            parts.append(f"target lacks {', '.join(lacking)}")
    if parts:
        raise SchemaError("; ".join(parts))


def require_same_schema(a: DataFrame, b: DataFrame) -> None:
    """Fail unless both tables have the same column names in the same order."""
    if a.columns != b.columns:
        raise SchemaError(f"columns differ: {a.columns} and {b.columns}")


def require_rows(df: DataFrame, name: str = "table") -> None:
    """Fail when the table has a header but no rows; reads at most one row."""
    if df.isEmpty():
        raise SchemaError(f"{name} has no rows")


def require_some_value(df: DataFrame, names: Sequence[str]) -> None:
    """Fail when one of the columns is null in every row."""
    row = df.agg(*[F.count(col(n)).alias(n) for n in names]).first()
    empty = [n for n in names if row[n] == 0]
    if empty:
        raise SchemaError(f"no value at all in {', '.join(empty)}")


def fill_missing_columns(df: DataFrame, like: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the columns ``like`` has and ``df`` lacks as ``''``; says which."""
    lacking = missing_columns(df, like.columns)
    return df.withColumns({c: F.lit("") for c in lacking}) if lacking else df, lacking


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The n-th expected name goes to the n-th column unless it exists already."""
    have = set(df.columns)
    out = list(df.columns)
    for i, name in enumerate(names[: len(out)]):
        if name not in have:
            out[i] = name
    return df.toDF(*out)


def non_blank(df: DataFrame, name: str) -> DataFrame:
    return df.where(norm_of(df, name) != "")


def dedup_columns(df: DataFrame, keys: Sequence[str], calculated: Sequence[str] = ()) -> DataFrame:
    """Keep one column per repeated key name: the first, or the last if calculated."""
    names = df.columns
    keep = []
    for i, name in enumerate(names):
        if name not in keys:
            keep.append(i)
            continue
        places = [j for j, other in enumerate(names) if other == name]
        if i == (places[-1] if name in calculated else places[0]):
            keep.append(i)
    numbered = df.toDF(*[f"_{i}" for i in range(len(names))])
    return numbered.select(*[f"_{i}" for i in keep]).toDF(*[names[i] for i in keep])
