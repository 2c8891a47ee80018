"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def bounded(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most about ``rows`` rows, picked by a hash of ``key``; never above twice that."""
    total = df.count()
    share = int(_STEPS * min(1.0, rows / max(total, 1)))
    return df.where(F.pmod(F.xxhash64(F.lit(17), *key), F.lit(_STEPS)) < share).limit(2 * rows)


def one_label(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """One row per labelled id; contradicting labels go by their mean, an even split counts as 1."""
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).dropna()
    return own.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
