"""Key quality: duplicates, blanks, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.text import norm_of, strip_all_space
from tablerecon.functions.names import col


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; counts are combined in the map tasks, so hot keys stay cheap."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys repeat, and how many rows carry them."""
    repeated = key_counts(df, keys).where("n_rows > 1")
    return repeated.agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_examples(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` repeated keys in key order."""
    return key_counts(df, keys).where("n_rows > 1").orderBy(*[col(k) for k in keys]).limit(n)


def blank_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: blank values per key column, and rows with any blank part."""
    blank = {k: norm_of(df, k) == "" for k in keys}
    any_blank = None
    for b in blank.values():
        any_blank = b if any_blank is None else any_blank | b
    return df.agg(
        *[F.count_if(b).alias(f"blank_{k}") for k, b in blank.items()],
        F.count_if(any_blank).alias("blank_any"),
    )


def _cleaned(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    texts = [k for k in keys if isinstance(df.schema[k].dataType, T.StringType)]
    return df.withColumns({k: F.coalesce(strip_all_space(col(k)), F.lit("")) for k in texts})


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key cleaned of whitespace: its first in ``order``.

    Spark limits each map task to one row per key before the shuffle (its
    window group limit), so a hot key does not pile up in one task.
    """
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(o) for o in order])
    ranked = _cleaned(df, keys).withColumn("_rank", F.row_number().over(w))
    return ranked.where("_rank = 1").drop("_rank")


def dedup_removed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows de-duplication keeps and removes."""
    return key_counts(_cleaned(df, keys), keys).agg(
        F.count(F.lit(1)).alias("kept"),
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("removed"),
    )
