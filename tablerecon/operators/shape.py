"""Merging, splitting and filling tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.text import norm_of, plain_number, safe_name
from tablerecon.functions.names import col


def merge_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by position under the first table's header.

    Short tables are padded with null; columns beyond the first header get
    the names ``_extra_1``, ``_extra_2``, ...
    """
    header = list(tables[0].columns)
    width = max(len(t.columns) for t in tables)
    names = header + [f"_extra_{i + 1}" for i in range(width - len(header))]
    types: list = [None] * width
    for t in tables:
        for i, f in enumerate(t.schema.fields):
            types[i] = f.dataType if types[i] is None or types[i] == f.dataType else "string"

    def aligned(t: DataFrame) -> DataFrame:
        numbered = t.toDF(*[f"_{i}" for i in range(len(t.columns))])
        have = len(t.columns)
        return numbered.select(
            *[(F.col(f"_{i}") if i < have else F.lit(None)).cast(types[i]).alias(names[i]) for i in range(width)]
        )

    return reduce(DataFrame.union, [aligned(t) for t in tables])


def append_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    """Existing rows followed by further ones with the same column names."""
    return df.unionByName(more)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows per non-blank value of a column (what a split by it would write)."""
    value = norm_of(df, name)
    return df.where(value != "").groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


def split_by_value(df: DataFrame, name: str, part: str = "part", length: int = 200) -> DataFrame:
    """Rows with a non-blank value and the name of the part they belong to.

    One part per value: where cleaning or cutting changed a name, a hash of
    the whole value follows it.  Write the result with ``write_parts``, which
    keeps hot values spread out.
    """
    dtype = df.schema[name].dataType
    value = plain_number(col(name), dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else col(name).cast("string")
    plain = safe_name(value, length)
    marked = F.concat(F.substring(plain, 1, length - 17), F.lit("~"), F.substring(F.sha2(value, 256), 1, 16))
    return df.where(norm_of(df, name) != "").withColumn(part, F.when(plain == value, plain).otherwise(marked))


#: Rows of a range that are sorted together, and sampled rows by which a range is found.
_RANGE_ROWS, _SAMPLED = 1_000_000, 16


def _bounds(df: DataFrame, place: Column) -> list[str]:
    """Places, as JSON and in order, that cut ``df`` into ranges of about equal size.

    Any bounds give right row numbers, as long as they are fixed; a sample
    gives even ones.
    """
    total = df.count()
    ranges = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // _RANGE_ROWS))
    share = min(1.0, _SAMPLED * ranges / max(total, 1))
    ordered = F.sort_array(F.collect_list(place))
    sample = df.sample(share, seed=17).agg(F.transform(ordered, lambda p: F.to_json(p))).first()[0]
    step = max(1, len(sample) // ranges)
    return sample[step::step]


def _range_of(place: Column, bounds: list[str], kind: T.DataType) -> Column:
    """How many of the ordered bounds lie at or below a place, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)

    def listed(texts: list[str]) -> Column:
        return F.from_json(F.lit(f"[{','.join(texts)}]"), T.ArrayType(kind))

    step = max(1, int(len(bounds) ** 0.5))
    whole = F.size(F.filter(listed(bounds[step - 1 :: step]), lambda b: b <= place)) * step
    return whole + F.size(F.filter(F.slice(listed(bounds), whole + 1, F.lit(step)), lambda b: b <= place))


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """A gapless 1-based row number in ``order``, without a one-task window.

    Fixed bounds, taken from a sample of (order, hash of the row), cut the
    rows into ranges.  A range's rows are numbered by a window of its own; the
    ranges before it add what they hold.  So there is one shuffle of the rows,
    by range, and one of a count per range.  Rows with the same place in
    ``order`` may be many: the hash cuts them into further ranges, and orders
    them.  The rows given must come out alike when they are read again.
    """
    order_by = [*[col(o) for o in order], F.col("_tie")]
    tied, place = df.withColumn("_tie", F.xxhash64(*[col(c) for c in df.columns])), F.struct(*order_by)
    kind = tied.select(place.alias("p")).schema["p"].dataType
    ranged = tied.withColumn("_range", _range_of(place, _bounds(tied, place), kind))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range, so the one task that adds them up is bounded.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by))
    numbered = ranged.withColumn("_no", inside).join(starts, F.col("_range") == F.col("_of"))
    return numbered.withColumn(name, F.col("_start") + F.col("_no")).drop("_tie", "_range", "_of", "_start", "_no")


def split_by_rows(df: DataFrame, rows: int, order: Sequence[str], part: str = "part") -> DataFrame:
    """Number chunks of ``rows`` rows in ``order``, starting at 1."""
    numbered = with_row_number(df, order, "_row_no")
    return numbered.withColumn(part, F.expr(f"(_row_no - 1) DIV {int(rows)} + 1")).drop("_row_no")


def fill_right(df: DataFrame, row: Sequence[str], position: str, value: str, name: str = "filled") -> DataFrame:
    """Give each blank cell of a row the nearest value to its left.

    ``row`` names the row a cell belongs to; a sheet row has at most 16,384
    cells, so the groups are bounded.
    """
    w = (
        Window.partitionBy(*[col(r) for r in row])
        .orderBy(col(position))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    shown = F.when(norm_of(df, value) != "", col(value))
    return df.withColumn(name, F.last(shown, ignorenulls=True).over(w))
