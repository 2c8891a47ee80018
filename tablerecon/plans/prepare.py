"""Bring both tables to the same columns before they are matched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.calc import calc
from tablerecon.operators.columns import SchemaError, clean_columns, missing_columns
from tablerecon.functions.names import col
from tablerecon.plans.rules import Options, Rule


def map_fields(df: DataFrame, rules: Sequence[Rule], options: Options = Options()) -> DataFrame:
    """Name the target's columns like the source's.

    A target column that already carries a source name gives way when the
    rule takes that field from elsewhere or calculates it.
    """
    taken = {r.source for r in rules if r.calc or r.source != r.target_name}
    moved = {r.target_name for r in rules if not r.calc and r.source != r.target_name}
    kept = [c for c in df.columns if c not in taken and c not in moved]
    return df.select(*[col(c) for c in kept], *[target_field(df, r, options).alias(r.source) for r in rules if r.source not in kept])


def target_field(df: DataFrame, rule: Rule, options: Options) -> Column:
    """The target's value for a rule: calculated, or a plain column."""
    if rule.calc:
        value = calc(
            df, rule.calc, rule.kind, options.abs_if_name_contains, options.null_safe_concat, options.calc_decimal_scale
        )
        return F.abs(value) if rule.kind == "number" and is_absolute(rule, options) else value
    if rule.target_name not in df.columns and options.on_missing_column == "blank":
        return F.lit("")
    return col(rule.target_name)


def is_absolute(rule: Rule, options: Options) -> bool:
    return rule.absolute or any(w in rule.source for w in options.abs_if_name_contains)


def project_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Only the fields the rules name."""
    return df.select(*[col(r.source) for r in rules])


def check_fields(a: DataFrame, b: DataFrame, rules: Sequence[Rule], options: Options) -> list[str]:
    """Target columns the rules need and the target lacks.

    A lacking source column always stops the run, a lacking target column
    unless it may be blank.
    """
    lacking_a = missing_columns(a, [r.source for r in rules])
    needed = [r.target_name for r in rules if not r.calc] + [r.against for r in rules if r.against]
    lacking_b = missing_columns(b, needed)
    problems = []
    if lacking_a:
        problems.append(f"source lacks {', '.join(lacking_a)}")
    if lacking_b and options.on_missing_column == "stop":
        problems.append(f"target lacks {', '.join(lacking_b)}")
    if problems:
        raise SchemaError("; ".join(problems))
    return lacking_b


def prepare(
    a: DataFrame, b: DataFrame, rules: Sequence[Rule], options: Options, keep_all: bool = False
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables under the source's field names, and the target's lacking columns.

    Only rule fields survive, so that scans read and shuffles move nothing
    else; ``keep_all`` carries the other columns along for the reports.
    """
    a, b = clean_columns(a), clean_columns(b)
    lacking = check_fields(a, b, rules, options)
    # Columns that are compared but not shown are copied before any renaming.
    copies = {f"_against_{r.source}": col(r.against) for r in rules if r.against}
    b = b.withColumns(copies) if copies else b
    b = map_fields(b, rules, options)
    if keep_all:
        return a, b, lacking
    return project_rules(a, rules), b.select(*[col(r.source) for r in rules], *copies), lacking
