"""Compare matched rows field by field.

A comparison is one lazy plan: the key match plus one boolean per field.
Every output is a projection of it, so Spark reads and shuffles only the
columns that output needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.dates import date_differs
from tablerecon.functions.names import col
from tablerecon.functions.numbers import num_differs, rounded_differs, to_num
from tablerecon.functions.text import last_segment, norm, norm_bool, norm_of, norm_synonym, prefix
from tablerecon.operators.columns import clean_columns, fill_missing_columns
from tablerecon.operators.keyed import attach
from tablerecon.operators.lookup import map_composite, map_frame, map_values, map_values_preferring
from tablerecon.plans.match import IN_SRC, IN_TGT, SRC, TGT, key_name, match
from tablerecon.plans.prepare import is_absolute, prepare
from tablerecon.plans.rules import Options, Rule, field_rules, key_rules

_EXACT = (T.IntegralType, T.DecimalType)


def differs_name(field: str) -> str:
    return f"_differs_{field}"


def code_name(field: str) -> str:
    """The column of a field's looked-up code."""
    return f"_code_{field}"


def against_name(field: str) -> str:
    """The target column a field is compared with but not shown by."""
    return f"_against_{field}"


@dataclass(frozen=True)
class Comparison:
    """Matched rows with one difference mark per compared field.

    ``frame`` holds the keys (``_key_0..``), the marks ``_in_src``,
    ``_in_tgt`` and ``_pairs``, both sides' columns (``src_*``, ``tgt_*``)
    and ``_differs_<field>``, which is only true on keys both sides have.
    """

    frame: DataFrame
    keys: tuple[str, ...]
    fields: tuple[str, ...]
    missing_columns: tuple[str, ...] = ()

    @property
    def key_columns(self) -> list[Column]:
        return [F.col(key_name(i)).alias(k) for i, k in enumerate(self.keys)]

    @property
    def any_differs(self) -> Column:
        marks = [col(differs_name(f)) for f in self.fields]
        return reduce(lambda x, y: x | y, marks) if marks else F.lit(False)

    def side_columns(self, tag: str) -> list[str]:
        helpers = (f"{tag}_code_", f"{tag}_against_")
        return [c for c in self.frame.columns if c.startswith(tag) and not c.startswith(helpers)]

    def matched(self) -> DataFrame:
        return self.frame.where(F.col(IN_SRC) & F.col(IN_TGT))

    def differing(self) -> DataFrame:
        return self.frame.where(self.any_differs)

    def missing(self) -> DataFrame:
        """Source rows whose key the target lacks."""
        return self._one_side(IN_TGT, SRC)

    def extra(self) -> DataFrame:
        """Target rows whose key the source lacks."""
        return self._one_side(IN_SRC, TGT)

    def _one_side(self, absent: str, tag: str) -> DataFrame:
        rows = self.frame.where(~F.col(absent))
        return rows.select(*[col(c).alias(c.removeprefix(tag)) for c in self.side_columns(tag)])

    def stored(self, path: str) -> Comparison:
        """Write the comparison once when several outputs will be taken from it.

        Put the path in a folder all executors share.
        """
        self.frame.write.mode("overwrite").parquet(path)
        return replace(self, frame=self.frame.sparkSession.read.parquet(path))


def text_differs(left: Column, right: Column, rule: Rule, options: Options) -> Column:
    """Normalized texts are unequal, but for what the rule's comparator allows."""
    unequal = left != right
    match rule.comparator:
        case "last_segment":
            a, b = rule.separators
            return last_segment(left, a, clean=True) != last_segment(right, b, clean=True)
        case "prefix":
            n, digits = rule.length, rule.digits_only
            return prefix(left, n, digits, clean=True) != prefix(right, n, digits, clean=True)
        case "coded" | "category":
            return unequal
        case "synonym":
            words = rule.synonyms
            return unequal & (norm_synonym(left, words, clean=True) != norm_synonym(right, words, clean=True))
        case None | "text" | "bool":
            if options.yes_no or rule.comparator == "bool":
                return unequal & (norm_bool(left, clean=True) != norm_bool(right, clean=True))
            return unequal
    raise ValueError(f"unknown comparator {rule.comparator!r} for {rule.source}")


def number_differs(a: Column, b: Column, rule: Rule, options: Options, ta: T.DataType, tb: T.DataType) -> Column:
    exact = isinstance(ta, _EXACT) and isinstance(tb, _EXACT)
    left, right = (a, b) if exact else (to_num(a, ta), to_num(b, tb))
    if is_absolute(rule, options):
        left, right = F.abs(left), F.abs(right)
    if options.mode == "sql":
        zero = F.lit(0) if exact else F.lit(0.0)
        left, right = F.coalesce(left, zero), F.coalesce(right, zero)
        if rule.tolerance and rule.round_digits is not None:
            return rounded_differs(left, right, rule.round_digits, rule.tolerance)
    return num_differs(left, right, rule.tolerance, options.one_sided_null, exact)


def _text_name(column: str) -> str:
    return f"_text_{column}"


def field_differs(
    rule: Rule, options: Options, source: str, target: str, types: Mapping[str, T.DataType]
) -> Column:
    """The rule as a Column over two named columns.

    Texts, and dates that are text, are read from their normalized copies.
    """
    ta, tb = types[source], types[target]
    if rule.kind == "number":
        return number_differs(col(source), col(target), rule, options, ta, tb)
    a, b = [col(_text_name(c) if _is_text(rule, types[c]) else c) for c in (source, target)]
    if rule.kind == "date":
        return date_differs(a, b, rule.precision, options.default_precision, options.date_mode, ta, tb, clean=True)
    return text_differs(a, b, rule, options)


def _is_text(rule: Rule, dtype: T.DataType) -> bool:
    return rule.kind == "text" or rule.kind == "date" and isinstance(dtype, T.StringType)


def lookup_frame(df: DataFrame, rule: Rule) -> DataFrame:
    if isinstance(rule.lookup, Mapping):
        return map_frame(df.sparkSession, rule.lookup)
    return rule.lookup


def coded_source(a: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the looked-up code of each coded field; the raw value stays for display."""
    for rule in rules:
        if rule.lookup is not None and rule.comparator in ("coded", "prefix"):
            table = lookup_frame(a, rule)
            order = ["ord"] if "ord" in table.columns else []
            a = map_values(a, rule.source, table, order=order, into=code_name(rule.source))
    return a


def category_codes(a: DataFrame, b: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Add the codes that category fields are compared by to both sides.

    Where the mapping has several codes for a source value, the first whose
    name the target uses anywhere counts; the values themselves stay, so that
    reports show them as they were.
    """
    for rule in rules:
        if rule.comparator != "category":
            continue
        c, into = rule.category, code_name(rule.source)
        if c is None:
            raise ValueError(f"the category rule for {rule.source} has no mapping")
        compared = against_name(rule.source) if rule.against else rule.source
        used = b.select(norm_of(b, compared).alias("_used_name"))
        a = a.withColumn("_named", norm_of(a, rule.source))
        a = map_values_preferring(
            a, "_named", c.table, c.key, c.code, c.parts, used, "_used_name", c.order, c.length, into
        ).drop("_named")
        b = b.withColumn("_named", norm_of(b, compared))
        b = map_composite(b, "_named", c.table, c.parts, c.target_code, c.order, c.length, into).drop("_named")
    return a, b


def allowed_flag(frame: DataFrame, rule: Rule, source: str, target: str) -> DataFrame:
    """Mark the pairs of values that a rule's multimap allows."""
    table = lookup_frame(frame, rule)
    left, right = f"_allow_key_{rule.source}", f"_allow_value_{rule.source}"
    pairs = table.select(norm("key").alias(left), norm("value").alias(right)).distinct()
    pairs = pairs.withColumn(f"_allow_{rule.source}", F.lit(True))
    return attach(frame, pairs, [(source, left), (target, right)])


def compare(
    a: DataFrame,
    b: DataFrame,
    rules: Sequence[Rule],
    options: Options = Options(),
    keep_all: bool = False,
    keys_complete: bool = False,
    keys_unique: bool = False,
) -> Comparison:
    """Compare two tables by rules; see ``Comparison`` for what comes back.

    A key that repeats on a side fails the job unless the options ask for
    fan-out.  ``keep_all`` carries columns without a rule along for reports,
    ``keys_complete`` says that no key is blank and ``keys_unique`` that none
    repeats; ``reconcile`` knows both from its gate.
    """
    a, b, lacking = prepare(a, b, rules, options, keep_all)
    keys = [r.source for r in key_rules(rules)]
    if not keys:
        raise ValueError("no rule is marked as key")
    checked = field_rules(rules, options)
    a = coded_source(a, checked)
    a, b = category_codes(a, b, checked)
    frame = match(
        a,
        b,
        keys,
        integral_keys=options.integral_keys,
        blank_keys_match=options.mode != "sql",
        on_duplicates=options.on_duplicates,
        keys_complete=keys_complete,
        keys_unique=keys_unique,
    )
    types = {f.name: f.dataType for f in frame.schema.fields}
    sides: dict[str, tuple[str, str]] = {}
    for rule in checked:
        coded, target_coded = SRC + code_name(rule.source), TGT + code_name(rule.source)
        target = TGT + (against_name(rule.source) if rule.against else rule.source)
        sides[rule.source] = (
            coded if coded in types else SRC + rule.source,
            target_coded if target_coded in types else target,
        )
    # Normalized texts are used several times over: as columns of their own
    # they are made once per row, and the comparisons stay short.
    texts = {
        _text_name(c): norm(col(c), options.null_words, options.null_words_any_case, types[c])
        for rule in checked
        for c in sides[rule.source]
        if _is_text(rule, types[c])
    }
    frame = frame.withColumns(texts) if texts else frame
    both = F.col(IN_SRC) & F.col(IN_TGT)
    marks: dict[str, Column] = {}
    for rule in checked:
        source, target = sides[rule.source]
        if rule.comparator == "allowed":
            frame = allowed_flag(frame, rule, _text_name(source), _text_name(target))
            blank = (col(_text_name(source)) == "") & (col(_text_name(target)) == "")
            mark = ~(blank | F.coalesce(col(f"_allow_{rule.source}"), F.lit(False)))
        else:
            mark = field_differs(rule, options, source, target, types)
        marks[differs_name(rule.source)] = both & mark
    frame = frame.withColumns(marks).drop(*[f"_allow_{r.source}" for r in checked], *texts)
    return Comparison(frame, tuple(keys), tuple(r.source for r in checked), tuple(lacking))


def compare_text(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    null_words: tuple[str, ...] = ("None",),
    on_duplicates: str = "stop",
) -> Comparison:
    """Compare every source column as normalized text, without a rule sheet.

    Columns the target lacks count as blank there and are reported.
    """
    a, b = clean_columns(a), clean_columns(b)
    b, lacking = fill_missing_columns(b, a)
    rules = [Rule(c, key=c in keys) for c in a.columns]
    ordered = [r for k in keys for r in rules if r.source == k] + [r for r in rules if not r.key]
    options = Options(yes_no=False, null_words=null_words, on_duplicates=on_duplicates)
    return replace(compare(a, b, ordered, options), missing_columns=tuple(lacking))
