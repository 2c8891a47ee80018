"""Dates that arrive as text in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.text import norm

# Characters kept at each precision.
PRECISION_CHARS = {"year": 4, "month": 7, "day": 10, "hour": 13, "minute": 16, "second": 19}
# Precision names used in rule sheets.
PRECISION_WORDS = {"年": "year", "月": "month", "日": "day", "时": "hour", "分": "minute", "秒": "second"}

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_DAY = "yyyy-MM-dd"
_SECOND = "yyyy-MM-dd HH:mm:ss"


def precision_name(word: str | None) -> str | None:
    if word is None or word in PRECISION_CHARS:
        return word
    return PRECISION_WORDS.get(word)


def _parsed(text: Column) -> Column:
    """The timestamp a date text stands for, or null.

    The accepted spellings are ``Y-m-d`` with or without ``H:M:S``, ``Y/m/d``,
    ``Y年m月d日``, ``m-d-Y``, ``m/d/Y`` and ``Ymd``.  They exclude each other
    by the place of their first separator: a year before it is four characters
    long, a month or day at most two.  So each value is parsed once, with the
    one pattern its shape allows, instead of failing through seven patterns.
    """
    dash, slash = F.instr(text, "-"), F.instr(text, "/")

    def by(pattern: str) -> Column:
        return F.try_to_timestamp(text, F.lit(pattern))

    return (
        F.when(dash == 5, F.when(F.instr(text, ":") > 0, by("yyyy-M-d H:m:s")).otherwise(by("yyyy-M-d")))
        .when(slash == 5, by("yyyy/M/d"))
        .when(F.instr(text, "年") == 5, by("yyyy年M月d日"))
        .when(dash > 0, by("M-d-yyyy"))
        .when(slash > 0, by("M/d/yyyy"))
        .when(F.length(text) == 8, by("yyyyMMdd"))
    )


# Month names and how they may be cut, in order.
MONTHS = (
    "jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?",
    "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?",
)
#: Years of two digits from here on are of the last century.
PIVOT = 69

_MONTH = f"({'|'.join(MONTHS)})\\.?"
_DAY_NO, _YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|\d{2})"
_WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?[,.]? +"
_TIME = r"(?:[ ,]+|(?<=\d)t)(\d{1,2}:\d{1,2}(?::\d{1,2})?)(?:\.\d+)? *([ap]m)? *(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
#: Shapes of a date in lower case, and the year, month and day in them.  Of two
#: numbers before the year the month is first, unless it cannot be one.
_SHAPES = (
    (r"^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日?$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (rf"^(1[3-9]|[2-9]\d)([-/.])(\d{{1,2}})\2{_YEAR}$", "$4-$3-$1"),
    (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2{_YEAR}$", "$4-$1-$3"),
    (rf"^{_DAY_NO}[-/. ]*(?:of )?{_MONTH}[-/., ]*{_YEAR}$", "$3-$2-$1"),
    (rf"^{_MONTH}[-/. ]*{_DAY_NO}[-/., ]+{_YEAR}$", "$3-$1-$2"),
    (rf"^(\d{{4}})[-/. ]*{_MONTH}[-/. ]*(\d{{1,2}})$", "$1-$2-$3"),
    (rf"^{_MONTH}[-/., ]*(\d{{4}})$", "$2-$1-1"),
    (r"^(\d{4})[-/.](\d{1,2})$", "$1-$2-1"),
    (r"^(\d{4})年(\d{1,2})月$", "$1-$2-1"),
    (r"^(\d{4})$", "$1-1-1"),
)
#: What stands before a date whose shape was found; no shape begins so.
_FOUND = "~"


def _parsed_freely(text: Column) -> Column:
    """As ``_parsed``, and what people write besides.

    The shape of a date's tokens decides: year first, month first, or day
    first where the first number cannot be a month; months by name; years of
    two digits; a month or a year alone is its first day.  A weekday may come
    before, a time of day after, with fractions, am or pm and a zone, which is
    left out: the wall clock counts.
    """
    lower = F.regexp_replace(F.lower(text), _WEEKDAY, "")
    date = F.regexp_replace(lower, _TIME, "")
    for shape, order in _SHAPES:
        date = F.regexp_replace(date, shape, f"{_FOUND}{order}")
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    parts = F.split(F.substring(date, 2, 100), "-")
    clock = F.regexp_replace(F.regexp_extract(lower, _TIME, 1), r"^(\d+:\d+)$", "$1:0")
    found = F.struct(parts.alias("p"), clock.alias("clock"), F.upper(F.regexp_extract(lower, _TIME, 2)).alias("half"))

    def moment(x: Column) -> Column:
        year, month = F.get(x["p"], F.lit(0)), F.get(x["p"], F.lit(1))
        century = F.when(F.length(year) > 2, F.lit("")).when(year < F.lit(str(PIVOT)), F.lit("20")).otherwise(F.lit("19"))
        place = F.array_position(names, F.substring(month, 1, 3))
        day = F.concat_ws("-", F.concat(century, year), F.when(place > 0, place.cast("string")).otherwise(month), F.get(x["p"], F.lit(2)))
        whole = F.rtrim(F.concat_ws(" ", day, x["clock"], x["half"]))
        pattern = F.when(x["clock"] == "", "yyyy-M-d").when(x["half"] == "", "yyyy-M-d H:m:s").otherwise("yyyy-M-d h:m:s a")
        return F.try_to_timestamp(whole, pattern)

    # One value per row: the parts are found once and then read several times.
    free = F.get(F.transform(F.array(F.when(F.startswith(date, F.lit(_FOUND)), found)), moment), F.lit(0))
    return F.coalesce(_parsed(text), free)


def parse_date(
    c: Column | str,
    mode: str = "ladder",
    keep_time: bool = False,
    dtype: T.DataType | None = None,
    clean: bool = False,
) -> Column:
    """A date as ``yyyy-MM-dd`` text (``yyyy-MM-dd HH:mm:ss`` with ``keep_time``).

    Unparsable text is kept as it is in mode ``ladder`` and becomes null in
    the modes ``strict`` and ``free``; a blank gives ``''`` (``ladder``) or
    null.  ``free`` accepts more spellings (``_parsed_freely``).
    Columns of a date type are formatted without parsing; ``clean`` text is
    normalized already.
    """
    c = F.col(c) if isinstance(c, str) else c
    pattern = _SECOND if keep_time else _DAY
    if isinstance(dtype, _DATE_TYPES):
        shown = F.date_format(c, pattern)
        return F.coalesce(shown, F.lit("")) if mode == "ladder" else shown
    text = c if clean else norm(c)
    shown = F.date_format(_parsed_freely(text) if mode == "free" else _parsed(text), pattern)
    return F.coalesce(shown, text) if mode == "ladder" else shown


def norm_date_digits(c: Column | str) -> Column:
    """Dates by their digits: eight of them make ``Y-m-d``, ``Y-m-d`` gets padded.

    Everything else is unchanged.
    """
    text = norm(c)
    digits = F.regexp_replace(text, r"\D", "")
    compact = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    parts = F.split(text, "-")

    def two(i: int) -> Column:
        part = parts.getItem(i)
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    padded = F.concat_ws("-", parts.getItem(0), two(1), two(2))
    return (
        F.when(F.length(digits) == 8, compact)
        .when(text.rlike(r"^[^-]*-\d+-\d+$"), padded)
        .otherwise(text)
    )


def cut_date(c: Column, precision: str | None, default: str = "day") -> Column:
    """Cut date text at a precision; an unknown precision falls back to ``default``."""
    chars = PRECISION_CHARS[precision_name(precision) or default]
    return F.substring(c, 1, chars)


def comparable_date(
    c: Column | str,
    precision: str | None,
    default: str = "day",
    mode: str = "ladder",
    dtype: T.DataType | None = None,
    clean: bool = False,
) -> Column:
    """The text two dates are compared by (null only in mode ``sql``)."""
    name = precision_name(precision) or default
    if mode == "prefix":
        return cut_date(c if clean else norm(c), name)
    if mode == "sql":
        return parse_date(c, mode="strict", dtype=dtype, clean=clean)
    keep_time = PRECISION_CHARS[name] > PRECISION_CHARS["day"]
    shown = parse_date(c, mode="free" if mode == "free" else "ladder", keep_time=keep_time, dtype=dtype, clean=clean)
    return F.coalesce(cut_date(shown, name), F.lit(""))


def date_differs(
    a: Column | str,
    b: Column | str,
    precision: str | None = None,
    default: str = "day",
    mode: str = "ladder",
    a_type: T.DataType | None = None,
    b_type: T.DataType | None = None,
    clean: bool = False,
) -> Column:
    """Whether two dates differ at a precision; two blanks are equal."""
    left = comparable_date(a, precision, default, mode, a_type, clean)
    right = comparable_date(b, precision, default, mode, b_type, clean)
    if mode == "sql":
        # A side that is no date is no difference.
        return F.coalesce(left != right, F.lit(False))
    return left != right
