"""Field rules: what to compare, with what, and how strictly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.dates import precision_name
from tablerecon.functions.text import norm

# Data type names used in rule sheets.
KIND_WORDS = {"文本": "text", "数值": "number", "日期": "date"}
# Fixed value: the rule sheet's mark for a key field.
KEY_WORD = "是"


@dataclass(frozen=True)
class Category:
    """How two sides name the same category, as rows of a mapping table.

    ``key`` is the source's name and ``code`` its code.  The target writes
    ``parts`` joined by ``-``, whose code is ``target_code``.  Codes agree if
    their first ``length`` characters do.  ``order`` says which row is first.
    """

    table: DataFrame
    key: str
    code: str
    parts: tuple[str, ...]
    target_code: str
    order: tuple[str, ...]
    length: int = 4


@dataclass(frozen=True)
class Rule:
    """How one source field compares with one target field.

    ``comparator`` refines text rules: ``bool``, ``synonym``,
    ``last_segment``, ``prefix``, ``allowed``, ``coded`` or ``category``.
    ``allowed`` and ``coded``, and ``prefix`` when codes must be looked up
    first, take a ``lookup`` table with the columns ``key`` and ``value`` (a
    mapping works as well); ``category`` takes a ``Category`` instead.
    ``against`` names another target column to compare with, while the field's
    own target column is still the one shown.
    """

    source: str
    target: str | None = None
    kind: str = "text"
    tolerance: float | None = None
    precision: str | None = None
    key: bool = False
    calc: str | None = None
    comparator: str | None = None
    lookup: DataFrame | Mapping[str, str] | None = None
    category: Category | None = None
    synonyms: Mapping[str, str] = field(default_factory=dict)
    length: int = 2
    digits_only: bool = True
    separators: tuple[str | None, str | None] = (None, None)
    absolute: bool = False
    against: str | None = None
    round_digits: int | None = None

    @property
    def target_name(self) -> str:
        return self.target or self.source


@dataclass(frozen=True)
class Options:
    """Where versions of a comparison disagree, one switch each."""

    mode: str = "typed"  # "sql": blank keys never match, missing numbers are 0
    one_sided_null: str = "differs"  # or "ignore", for numbers with a tolerance
    date_mode: str = "ladder"  # or "free", "prefix", "sql"
    default_precision: str = "day"
    null_words: tuple[str, ...] = ()
    null_words_any_case: bool = False
    yes_no: bool = True
    abs_if_name_contains: tuple[str, ...] = ()
    integral_keys: bool = False
    on_duplicates: str = "stop"  # or "fanout"
    on_missing_column: str = "stop"  # or "blank"
    compare_keys: bool = False
    null_safe_concat: bool = True
    calc_decimal_scale: int | None = None

    def for_sql(self) -> Options:
        """The switches of a comparison written as one SQL statement."""
        return replace(self, mode="sql", date_mode="sql", null_safe_concat=False)


def key_rules(rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if r.key]


def field_rules(rules: Sequence[Rule], options: Options) -> list[Rule]:
    return [r for r in rules if options.compare_keys or not r.key]


def load_rules(df: DataFrame) -> list[Rule]:
    """Rules from a sheet of five or six columns, by position.

    Source field, target field, data type, tolerance or precision, key mark
    and (optional) calculation; rows that lack a field name are skipped.  The
    last row for a source field counts, at the place of the first.  The
    columns ``_file``, ``_sheet`` and ``_row`` of a sheet that was read as a
    workbook only serve to keep the rows in order.
    """
    places = [c for c in ("_file", "_sheet", "_row") if c in df.columns]
    if places:
        df = df.orderBy(*places).drop(*places)
    names = [f"_{i}" for i in range(len(df.columns))]
    sheet = df.toDF(*names).select(*[norm(n).alias(n) for n in names])
    rows = sheet.where((F.col("_0") != "") & (F.col("_1") != "")).collect()
    rules: dict[str, Rule] = {}
    for row in rows:
        source, target, kind, strictness, mark = row[:5]
        kind = kind.lower()
        kind = KIND_WORDS.get(kind, kind)
        rules[source] = Rule(
            source=source,
            target=target,
            kind=kind,
            tolerance=float(strictness) if kind == "number" and strictness else None,
            precision=precision_name(strictness) if kind == "date" and strictness else None,
            key=mark == KEY_WORD,
            calc=(row[5] or None) if len(row) > 5 else None,
        )
    return list(rules.values())
