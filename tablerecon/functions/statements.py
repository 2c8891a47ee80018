"""Rows rendered as statements, and literals rewritten in statement text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablerecon.functions.text import norm


def quoted(c: Column | str) -> Column:
    """A text literal with its quotes doubled; null becomes ``NULL``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def plain_number(c: Column | str) -> Column:
    """A whole number without quotes; anything else becomes ``NULL``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(norm(c).try_cast("decimal(38,0)").cast("string"), F.lit("NULL"))


def to_date_call(c: Column | str) -> Column:
    """``TO_DATE('yyyy-MM-dd', 'yyyy-MM-dd')`` for a date column, else ``NULL``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(
        F.concat(F.lit("TO_DATE('"), F.date_format(c, "yyyy-MM-dd"), F.lit("', 'yyyy-MM-dd')")), F.lit("NULL")
    )


_RENDER = {"text": quoted, "number": plain_number, "date": to_date_call}


def _assignments(cols: Mapping[str, str], sep: str) -> list[Column]:
    out: list[Column] = []
    for i, (name, kind) in enumerate(cols.items()):
        out += [F.lit(f"{sep if i else ''}{name} = "), _RENDER[kind](name)]
    return out


def render_update(table: str, assign: Mapping[str, str], where: Sequence[str] | Mapping[str, str]) -> Column:
    """One ``UPDATE`` statement per row.

    ``assign`` and ``where`` map columns to ``text``, ``number`` or ``date``.
    """
    conditions = where if isinstance(where, Mapping) else {c: "text" for c in where}
    return F.concat(
        F.lit(f"UPDATE {table} SET "),
        *_assignments(assign, ", "),
        F.lit(" WHERE "),
        *_assignments(conditions, " AND "),
        F.lit(";"),
    )


# The literal looked for and the call that replaces it.
TIMESTAMP_LITERAL = r"TIMESTAMP '(\d{4}-\d{2}-\d{2}) \d{2}:\d{2}:\d{2}'"
DATE_CALL = r"TO_DATE('$1', 'yyyy-MM-dd')"


def rewrite_timestamps(c: Column | str) -> Column:
    """Turn ``TIMESTAMP 'Y-m-d H:M:S'`` literals into ``TO_DATE`` calls."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, TIMESTAMP_LITERAL, DATE_CALL)
