"""Text, code and name normalizers as pure ``Column -> Column`` expressions.

Everything here stays inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.names import col

# The yes/no spellings that count as one value.
YES_WORDS = ("是", "Y")
NO_WORDS = ("否", "N")

# Characters that may not appear in a file name.
ILLEGAL_NAME_CHARS = '\\/:*?"<>|'

# The characters that count as whitespace, Unicode-wide.
# SQL trim() alone only removes U+0020.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace from both ends; null stays null."""
    return F.trim(_col(c).cast("string"), F.lit(WHITESPACE))


def _text(c: Column | str, clean: bool) -> Column:
    """The normalized text, or the column itself when it is ``clean`` already."""
    return _col(c) if clean else norm(c)


def plain_number(c: Column, dtype: T.DataType) -> Column:
    """A float as text without an exponent, where 12 decimals and 26 digits before them can show it."""
    text = c.cast("string")
    exact = text.try_cast("decimal(38,12)")
    digits = F.regexp_replace(exact.cast("string"), r"(\.\d+?)0*$", "$1")
    return F.when(F.contains(text, F.lit("E")) & (exact.cast(dtype) == c), digits).otherwise(text)


def norm(c: Column | str, nulls: Sequence[str] = (), ci: bool = False, dtype: T.DataType | None = None) -> Column:
    """One spelling for "no value": null and blanks become ``''``.

    Pass the column's ``dtype`` when it is known: a NaN of a float column is
    no value either, and its numbers are written out.

    ``nulls`` lists further words that mean "no value" (``('None',)``, or
    ``('none', 'null')`` with ``ci=True`` to ignore case).
    """
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = _col(c)
        c = plain_number(F.nullif(number, F.lit(float("nan")).cast(dtype)), dtype)
    text = F.coalesce(strip(c), F.lit(""))
    if not nulls:
        return text
    probe = F.lower(text) if ci else text
    words = [w.lower() for w in nulls] if ci else list(nulls)
    return F.when(probe.isin(words), F.lit("")).otherwise(text)


def norm_of(df: DataFrame, name: str, nulls: Sequence[str] = (), ci: bool = False) -> Column:
    """``norm`` of a column, by the type it has in ``df``."""
    return norm(col(name), nulls, ci, df.schema[name].dataType)


def strip_all_space(c: Column | str) -> Column:
    """Drop every whitespace character, inner ones too."""
    return F.translate(_col(c).cast("string"), WHITESPACE, "")


def norm_bool(c: Column | str, clean: bool = False) -> Column:
    """Unify yes/no spellings to 是 / 否; other text is only normalized.

    ``clean``, here and below, says that the text is normalized already.
    """
    text = _text(c, clean)
    upper = F.upper(text)
    return (
        F.when(upper.isin(*YES_WORDS), F.lit(YES_WORDS[0]))
        .when(upper.isin(*NO_WORDS), F.lit(NO_WORDS[0]))
        .otherwise(text)
    )


def norm_synonym(c: Column | str, mapping: Mapping[str, str], clean: bool = False) -> Column:
    """Replace a value by its preferred synonym (``{'直线法': '年限平均法'}``)."""
    text = _text(c, clean)
    out = None
    for variant, preferred in mapping.items():
        hit = text == F.lit(variant)
        out = F.when(hit, F.lit(preferred)) if out is None else out.when(hit, F.lit(preferred))
    return text if out is None else out.otherwise(text)


def last_segment(c: Column | str, sep: str | None = None, clean: bool = False) -> Column:
    """The part after the last separator.

    Without ``sep`` a value holding a backslash is cut there, any other at
    its last hyphen.
    """
    text = _text(c, clean)
    if sep is not None:
        return norm(F.substring_index(text, sep, -1))
    cut = F.when(F.instr(text, "\\") > 0, F.substring_index(text, "\\", -1)).otherwise(
        F.substring_index(text, "-", -1)
    )
    return norm(cut)


def prefix(c: Column | str, length: int, digits_only: bool = False, clean: bool = False) -> Column:
    """First ``length`` characters; with ``digits_only`` other text is kept whole."""
    text = _text(c, clean)
    cut = F.substring(text, 1, length)
    return F.when(text.rlike(r"^\d+$"), cut).otherwise(text) if digits_only else cut


def display_key(cols: Sequence[Column | str], sep: str = " + ", nulls: str = "blank") -> Column:
    """Composite key as shown to people; never used as a join key.

    ``nulls`` says what a null part does: ``blank`` shows nothing in its
    place, ``null`` makes the whole key null, ``skip`` leaves the part out.
    """
    parts = [_col(c).cast("string") for c in cols]
    if nulls == "skip":
        return F.concat_ws(sep, *parts)
    if nulls == "blank":
        return F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])
    if nulls == "null":
        pieces = [parts[0]]
        for p in parts[1:]:
            pieces += [F.lit(sep), p]
        return F.concat(*pieces)
    raise ValueError(f"nulls must be blank, null or skip, not {nulls!r}")


def combined_key(*cols: Column | str) -> Column:
    """Parts joined without a separator; a null part makes the key null."""
    return F.concat(*[_col(c).cast("string") for c in cols])


def pad_code(c: Column | str, width: int = 10, fill: str = "0") -> Column:
    """Left-pad short codes; a longer code is never cut."""
    text = _col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def coalesce_code(c: Column | str, parts: Sequence[Column | str]) -> Column:
    """A code without spaces; when it is blank, its parts run together."""
    own = norm(c)
    rest = F.concat_ws("", *[_col(p).cast("string") for p in parts])
    return F.replace(norm(F.when(own == "", rest).otherwise(own)), F.lit(" "), F.lit(""))


def safe_name(c: Column | str, length: int = 200) -> Column:
    """A value usable as file or sheet name."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    text = F.translate(text, ILLEGAL_NAME_CHARS, "_" * len(ILLEGAL_NAME_CHARS))
    text = F.regexp_replace(text, r"^[. ]+|[. ]+$", "")
    return F.when(text == "", F.lit("unnamed")).otherwise(F.substring(text, 1, length))
