"""Count the row pairs of repeated keys without forming them.

An SQL join on a repeated key pairs every source row with every target row.
The number of pairs follows from the rows per key.  Which of them are equal is
counted from groups of equal values on either side, which meet on the key and
on every field at once:

* A field whose equality is that of one canonical value is part of the group.
* A field that a missing value lets pass (numbers with ``one_sided_null =
  "ignore"``, dates of SQL mode) equals ``1 - both present + both present and
  equal``.  The product of these over the fields is a sum over patterns, so a
  group is counted once per pattern, with a sign, and missing values never
  have to meet all others.
* A set of allowed values is unfolded on the source's side into the values it
  allows.
* Numbers with a tolerance meet in the buckets next to theirs and are compared
  there, value by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerecon.functions.dates import comparable_date
from tablerecon.functions.names import col
from tablerecon.functions.numbers import to_num
from tablerecon.functions.text import last_segment, norm, norm_bool, norm_synonym, prefix
from tablerecon.plans.compare import against_name, category_codes, code_name, coded_source, lookup_frame, number_differs
from tablerecon.plans.match import key_columns
from tablerecon.plans.prepare import is_absolute, prepare
from tablerecon.plans.rules import Options, Rule, field_rules, key_rules

_NO_NUMBER = -(1 << 62)
_EXACT = (T.IntegralType, T.DecimalType)


def _is_near(rule: Rule) -> bool:
    """Is the rule's equality one of neighbouring values?"""
    return rule.kind == "number" and bool(rule.tolerance)


def _lets_pass(rule: Rule, options: Options) -> bool:
    """Does a value that is missing on one side count as equal?"""
    if rule.kind == "number":
        return rule.tolerance is not None and options.mode != "sql" and options.one_sided_null == "ignore"
    return rule.kind == "date" and options.date_mode == "sql"


def _canonical(rule: Rule, options: Options, name: str, dtype: T.DataType, is_source: bool) -> Column:
    """The value two sides share exactly when the rule calls them equal."""
    if rule.kind == "number":
        value = to_num(col(name), dtype)
        value = F.abs(value) if is_absolute(rule, options) else value
        value = F.coalesce(value, F.lit(0.0)) if options.mode == "sql" else value
        rounded = options.mode == "sql" and rule.round_digits is not None and rule.tolerance is not None
        return F.round(value, rule.round_digits) if rounded else value
    if rule.kind == "date":
        return comparable_date(col(name), rule.precision, options.default_precision, options.date_mode, dtype)
    text = norm(col(name), options.null_words, options.null_words_any_case, dtype)
    match rule.comparator:
        case "last_segment":
            return last_segment(text, rule.separators[0 if is_source else 1], clean=True)
        case "prefix":
            return prefix(text, rule.length, rule.digits_only, clean=True)
        case "synonym":
            return norm_synonym(text, rule.synonyms, clean=True)
        case "coded" | "category" | "allowed":
            return text
    return norm_bool(text, clean=True) if options.yes_no or rule.comparator == "bool" else text


def _bucket(rule: Rule, options: Options, value: Column) -> Column:
    """Numbers within the tolerance lie in the same bucket or in neighbours."""
    if options.mode == "sql" and rule.round_digits is not None:
        value = F.round(value, rule.round_digits)
    place = F.least(F.greatest(value / F.lit(2.0 * rule.tolerance), F.lit(-9e15)), F.lit(9e15))
    return F.coalesce(F.floor(place), F.lit(_NO_NUMBER))


def _pair_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], options: Options) -> tuple[list[Column], list[Column]]:
    """Keys of both sides; in SQL mode a blank one is null, which equals nothing."""
    left, right, texts = key_columns(a, b, keys, options.integral_keys)

    def named(columns: list[Column]) -> list[Column]:
        return [
            (F.nullif(c, F.lit("")) if t and options.mode == "sql" else c).alias(f"key_{i}") for i, (c, t) in enumerate(zip(columns, texts))
        ]

    return named(left), named(right)


def _patterns(n: int) -> list[tuple[int, ...]]:
    """For each field that lets missing values pass: 0 no condition, 1 both present, 2 both present and equal."""
    return list(product((0, 1, 2), repeat=n))


def _groups(df: DataFrame, keys: list[Column], checked: Sequence[Rule], options: Options, is_source: bool) -> DataFrame:
    """Rows by key, pattern and the values it compares, with their number.

    ``value_i`` is what field i is compared by (null where the pattern does not
    ask), ``near_i`` its bucket.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(keys)
    for i, rule in enumerate(checked):
        helpers = [code_name(rule.source)] + ([] if is_source else [against_name(rule.source)])
        name = next((h for h in helpers if h in types), rule.source)
        if _is_near(rule):
            value = to_num(col(name), types[name]) if not isinstance(types[name], _EXACT) else col(name)
            value = F.abs(value) if is_absolute(rule, options) else value
            value = F.coalesce(value, F.lit(0).cast(types[name]) if isinstance(types[name], _EXACT) else F.lit(0.0)) if options.mode == "sql" else value
        else:
            value = _canonical(rule, options, name, types[name], is_source)
        columns.append(value.alias(f"value_{i}"))
    rows = df.select(*columns)
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    passing = [i for i, r in enumerate(checked) if _lets_pass(r, options)]
    cases = []
    for number, pattern in enumerate(_patterns(len(passing))):
        present = [F.col(f"value_{i}").isNotNull() for i, c in zip(passing, pattern) if c]
        kept = {i: c == 2 for i, c in zip(passing, pattern)}
        values = [
            (F.col(f"value_{i}") if kept.get(i, True) else F.lit(None).cast(rows.schema[f"value_{i}"].dataType)).alias(f"value_{i}")
            for i in range(len(checked))
        ]
        case = F.struct(F.lit(number).alias("pattern"), *values)
        cases.append(F.when(reduce(lambda x, y: x & y, present, F.lit(True)), case))
    found = F.filter(F.array(*cases), lambda c: c.isNotNull()) if passing else F.array(*cases)
    key_names = [f"key_{i}" for i in range(len(keys))]
    spread = rows.select(*key_names, "n", F.explode(found).alias("c")).select(*key_names, "n", "c.*")
    grouped = spread.groupBy(*[c for c in spread.columns if c != "n"]).agg(F.sum("n").alias("n")) if passing else spread
    near = [i for i, r in enumerate(checked) if _is_near(r)]
    return grouped.withColumns({f"near_{i}": _bucket(checked[i], options, F.col(f"value_{i}").cast("double")) for i in near}) if near else grouped


def _unfold_allowed(left: DataFrame, checked: Sequence[Rule]) -> DataFrame:
    """Each source value in place of the target values it allows; a blank allows a blank."""
    for i, rule in enumerate(checked):
        if rule.comparator != "allowed":
            continue
        pairs = lookup_frame(left, rule).select(norm("key").alias("_from"), norm("value").alias("_to"))
        blank = left.sparkSession.createDataFrame([("", "")], "_from string, _to string")
        pairs = pairs.unionAll(blank).distinct()
        left = left.join(pairs, F.col(f"value_{i}") == F.col("_from")).withColumn(f"value_{i}", F.col("_to")).drop("_from", "_to")
        counted = [c for c in left.columns if c != "n"]
        left = left.groupBy(*counted).agg(F.sum("n").alias("n"))
    return left


def _equal_pairs(left: DataFrame, right: DataFrame, n_keys: int, checked: Sequence[Rule], options: Options) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = [F.col(f"key_{i}") == F.col(f"r_key_{i}") for i in range(n_keys)] + [F.col("pattern") == F.col("r_pattern")]
    near = [i for i, r in enumerate(checked) if _is_near(r)]
    for i in range(len(checked)):
        if i not in near:
            on.append(F.col(f"value_{i}").eqNullSafe(F.col(f"r_value_{i}")))
    # Two fields at most look into their neighbours; the others are compared in the pairs that are left.
    for i in near[:2]:
        b = F.col(f"r_near_{i}")
        beside = F.when(b == _NO_NUMBER, F.array(b)).otherwise(F.array(b - 1, b, b + 1))
        right = right.withColumn(f"r_near_{i}", F.explode(beside))
        on.append(F.col(f"near_{i}") == b)
    pairs = left.join(right, reduce(lambda x, y: x & y, on), "inner")
    types = {f.name: f.dataType for f in pairs.schema.fields}
    for i in near:
        a, b = f"value_{i}", f"r_value_{i}"
        both_open = F.col(a).isNull() & F.col(b).isNull()
        differs = number_differs(F.col(a), F.col(b), checked[i], options, types[a], types[b])
        pairs = pairs.where(both_open | ~differs)
    passing = sum(_lets_pass(r, options) for r in checked)
    signs = F.array(*[F.lit(-1 if p.count(1) % 2 else 1) for p in _patterns(passing)])
    total = F.sum(F.get(signs, F.col("pattern")) * F.col("n") * F.col("r_n"))
    return pairs.agg(F.coalesce(total, F.lit(0)).alias("equal"))


def pair_summary(a: DataFrame, b: DataFrame, rules: Sequence[Rule], options: Options = Options()) -> DataFrame:
    """The fan-out counts of ``summarize`` from groups instead of pairs."""
    a, b, lacking = prepare(a, b, rules, options)
    keys = [r.source for r in key_rules(rules)]
    checked = field_rules(rules, options)
    a, b = category_codes(coded_source(a, checked), b, checked)
    left_keys, right_keys = _pair_keys(a, b, keys, options)
    left = _unfold_allowed(_groups(a, left_keys, checked, options, True), checked)
    right = _groups(b, right_keys, checked, options, False)

    names = [f"key_{i}" for i in range(len(keys))]
    # From the key columns alone, combined in the map tasks.
    sides = [
        a.select(*left_keys, F.lit(1).cast("long").alias("s"), F.lit(0).cast("long").alias("t")),
        b.select(*right_keys, F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("t")),
    ]
    per_key = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    lone = reduce(lambda x, y: x | y, [F.col(n).isNull() for n in names])
    s, t = F.col("s"), F.col("t")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    counts = per_key.agg(
        total(s).alias("total_source"),
        total(t).alias("total_target"),
        total(F.when(lone | (t == 0), s)).alias("missing"),
        total(F.when(lone | (s == 0), t)).alias("extra"),
        total(F.when(~lone, s * t)).alias("common"),
    )
    equal = _equal_pairs(left, right, len(keys), checked, options)
    # Two rows of sums, added up.
    both = counts.unionByName(equal, allowMissingColumns=True).agg(
        *[F.sum(F.coalesce(col(c), F.lit(0))).alias(c) for c in [*counts.columns, "equal"]]
    )
    differing = F.col("common") - F.col("equal")
    return both.select(
        F.lit(" + ".join(keys)).alias("primary_key"),
        "total_source",
        "total_target",
        "missing",
        "extra",
        "common",
        differing.alias("differing"),
        "equal",
        F.round(F.when(F.col("common") > 0, differing / F.col("common")).otherwise(F.lit(0.0)), 6).alias("diff_ratio"),
        (F.col("total_source") != F.col("total_target")).alias("row_counts_differ"),
        F.lit(", ".join(lacking)).alias("missing_columns"),
    )
