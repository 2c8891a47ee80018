"""Numeric coercion, tolerance comparison and number rendering."""

from __future__ import annotations

import re
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def to_num(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Text to double; text that is no number, and NaN, become null.

    Pass the column's ``dtype`` when it is known: a column that is already
    numeric then skips the text checks.
    """
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, _EXACT):
        return c.cast("double")
    if isinstance(dtype, T.NumericType):
        return F.nullif(c.cast("double"), F.lit(float("nan")))
    text = c.cast("string")
    # The JVM reads `12d`, `3f` and hexadecimal floats as numbers; none of
    # them is a number in a ledger.
    jvm_only = text.rlike(r"[xX]|\d\.?[dDfF]\s*$")
    value = F.when(~jvm_only, text.try_cast("double"))
    return F.nullif(value, F.lit(float("nan")))


def num_or_zero(c: Column | str, dtype: T.DataType | None = None) -> Column:
    return F.coalesce(to_num(c, dtype), F.lit(0.0))


def num_differs(
    a: Column,
    b: Column,
    tolerance: float | None = None,
    one_sided_null: str = "differs",
    exact: bool = False,
) -> Column:
    """Whether two numbers differ; two nulls are equal.

    Without a tolerance the values must be identical, otherwise they differ
    when they are more than ``tolerance`` apart.  ``one_sided_null='ignore'``
    treats a missing value on one side as no difference when a tolerance is
    set.  ``exact`` keeps decimal arithmetic for decimal operands.
    """
    if tolerance is None:
        return ~a.eqNullSafe(b)
    bound = F.lit(Decimal(str(tolerance))) if exact else F.lit(float(tolerance))
    apart = F.abs(a - b) > bound
    missing = F.lit(False) if one_sided_null == "ignore" else ~(a.isNull() & b.isNull())
    return F.coalesce(apart, missing)


def rounded_differs(a: Column, b: Column, digits: int, threshold: float) -> Column:
    """Round both to ``digits`` (null counts as 0), then compare with a threshold."""
    left = F.round(F.coalesce(a, F.lit(0.0)), digits)
    right = F.round(F.coalesce(b, F.lit(0.0)), digits)
    return F.abs(left - right) > F.lit(float(threshold))


# Spreadsheet date tokens and their Spark pattern letters.
_DATE_TOKENS = {"yyyy": "yyyy", "yy": "yy", "mm": "MM", "m": "M", "dd": "dd", "d": "d", "hh": "HH", "h": "H", "ss": "ss"}
_TOKEN = re.compile("yyyy|yy|mm|m|dd|d|hh|h|ss|AM/PM|am/pm|.", re.DOTALL)


def spreadsheet_date_pattern(fmt: str) -> str:
    """A spreadsheet date format as a Spark pattern.

    ``mm`` after hours or before seconds is minutes; with AM/PM hours run to 12.
    """
    tokens = _TOKEN.findall(fmt.split(";")[0])
    half_days = any(t.lower() == "am/pm" for t in tokens)
    out, after_hour = [], False
    for i, token in enumerate(tokens):
        following = next((t for t in tokens[i + 1 :] if t in _DATE_TOKENS), "")
        if token in ("mm", "m") and (after_hour or following == "ss"):
            out.append("mm")
            after_hour = False
        elif token.lower() == "am/pm":
            out.append("a")
        elif token in _DATE_TOKENS:
            out.append(token if half_days and token in ("hh", "h") else _DATE_TOKENS[token])
            after_hour = token in ("hh", "h") or after_hour and token == "ss"
        else:
            out.append(f"'{token}'" if token.isalpha() else token)
    return "".join(out)


def is_date_format(fmt: str) -> bool:
    return any(t in fmt.lower() for t in ("yy", "dd", "d/", "/d", "hh", "ss", "h:", ":mm"))


def decimals_of(fmt: str) -> int:
    """Digits a number format shows after its decimal point."""
    return fmt.rsplit(".", 1)[1].count("0") if "." in fmt else 0


def render_number_format(value: Column | str, fmt: str | None, percent: bool = True) -> Column:
    """A cell's value as the spreadsheet shows it.

    ``percent=False`` shows percent formats as plain numbers.
    """
    value = F.col(value) if isinstance(value, str) else value
    if fmt in (None, "General", "@"):
        return F.coalesce(value.cast("string"), F.lit(""))
    if is_date_format(fmt):
        return F.coalesce(F.date_format(value, spreadsheet_date_pattern(fmt)), F.lit(""))
    number = value.cast("double")
    digits = decimals_of(fmt)
    if "%" in fmt and percent:
        shown = F.format_string(f"%.{digits}f%%", number * F.lit(100.0))
    else:
        shown = F.format_string(f"%.{digits}f", number)
    return F.when(number.isNull(), F.lit("")).otherwise(shown)


def render_by_format(value: Column | str, fmt: Column | str, formats: Mapping[str, bool] | list[str]) -> Column:
    """Per-row number formats, chosen from the formats a workbook declares."""
    fmt = F.col(fmt) if isinstance(fmt, str) else fmt
    value = F.col(value) if isinstance(value, str) else value
    out = None
    for f in formats:
        shown = render_number_format(value, f)
        out = F.when(fmt == f, shown) if out is None else out.when(fmt == f, shown)
    plain = F.coalesce(value.cast("string"), F.lit(""))
    return plain if out is None else out.otherwise(plain)
