"""The quality gate in front of a comparison, and the whole run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.operators.columns import SchemaError
from tablerecon.functions.names import col
from tablerecon.plans.compare import Comparison, compare
from tablerecon.plans.match import key_columns, key_profile
from tablerecon.plans.prepare import prepare
from tablerecon.plans.rules import Options, Rule, key_rules


@dataclass(frozen=True)
class GateReport:
    """What the gate found; ``stopped`` says why a comparison makes no sense."""

    stopped: str | None = None
    warnings: tuple[str, ...] = ()
    counts: dict = field(default_factory=dict)
    examples: tuple[tuple, ...] = ()


@dataclass(frozen=True)
class Reconciliation:
    gate: GateReport
    result: Comparison | None


def gate_counts(
    a: DataFrame, b: DataFrame, keys: Sequence[str], integral_keys: bool = False
) -> DataFrame:
    """One row with everything the gate asks about the keys of both tables.

    Rows, duplicate rows and blank keys per side and the sizes of the key
    sets come from one shuffle of (key, counts); repeated keys are combined
    in the map tasks.
    """
    left, right, texts = key_columns(a, b, keys, integral_keys)
    profile = key_profile(a, b, left, right, list(keys))
    n_src, n_tgt = F.col("n_src"), F.col("n_tgt")
    blank = {k: (col(k) == "") if t else col(k).isNull() for k, t in zip(keys, texts)}

    def rows(n: Column, condition: Column | None = None) -> Column:
        return F.coalesce(F.sum(n if condition is None else F.when(condition, n)), F.lit(0))

    sums = []
    for side, n in (("source", n_src), ("target", n_tgt)):
        any_blank = F.lit(False)
        sums += [rows(n).alias(f"rows_{side}"), rows(n, n > 1).alias(f"duplicate_rows_{side}")]
        for k, is_blank in blank.items():
            sums.append(rows(n, is_blank).alias(f"blank_{k}_{side}"))
            any_blank = any_blank | is_blank
        sums.append(rows(n, any_blank).alias(f"blank_any_{side}"))
    return profile.agg(
        *sums,
        F.count_if((n_src > 0) & (n_tgt > 0)).alias("common_keys"),
        F.count_if(n_tgt == 0).alias("missing_keys"),
        F.count_if(n_src == 0).alias("extra_keys"),
    )


def gate(
    a: DataFrame, b: DataFrame, rules: Sequence[Rule], options: Options = Options()
) -> GateReport:
    """Check columns, rows, keys, duplicates, blanks and common keys, in that order."""
    keys = [r.source for r in key_rules(rules)]
    try:
        a, b, lacking = prepare(a, b, rules, options)
    except SchemaError as e:
        return GateReport(stopped=str(e))
    if not keys:
        return GateReport(stopped="no rule is marked as key")
    counts = gate_counts(a, b, keys, options.integral_keys).first().asDict()
    warnings = [f"target lacks {c}, taken as blank" for c in lacking]
    for side in ("source", "target"):
        if counts[f"rows_{side}"] == 0:
            return GateReport(stopped=f"{side} has no rows", counts=counts)
    for side, df, other in (("source", a, b), ("target", b, a)):
        repeated = counts[f"duplicate_rows_{side}"]
        if repeated and options.on_duplicates == "stop":
            examples = _examples(a, b, keys, side, options)
            return GateReport(f"{side} has {repeated} rows with duplicate keys", tuple(warnings), counts, examples)
        if repeated:
            warnings.append(f"{side} has {repeated} rows with duplicate keys")
    for side in ("source", "target"):
        for k in keys:
            if counts[f"blank_{k}_{side}"]:
                warnings.append(f"{side} has {counts[f'blank_{k}_{side}']} blank values in key {k}")
    if counts["rows_source"] != counts["rows_target"]:
        warnings.append(f"row counts differ: {counts['rows_source']} and {counts['rows_target']}")
    if counts["common_keys"] == 0:
        return GateReport("no common key", tuple(warnings), counts)
    return GateReport(None, tuple(warnings), counts)


def _examples(a, b, keys, side: str, options: Options) -> tuple[tuple, ...]:
    left, right, _ = key_columns(a, b, keys, options.integral_keys)
    chosen, df = (left, a) if side == "source" else (right, b)
    named = df.select(*[c.alias(k) for c, k in zip(chosen, keys)])
    repeated = named.groupBy(*[col(k) for k in keys]).count().where("count > 1")
    return tuple(tuple(r)[: len(keys)] for r in repeated.orderBy(*[col(k) for k in keys]).limit(5).collect())


def reconcile(
    a: DataFrame,
    b: DataFrame,
    rules: Sequence[Rule],
    options: Options = Options(),
    keep_all: bool = False,
) -> Reconciliation:
    """Gate, then compare; ``result`` is ``None`` when the gate stops the run."""
    report = gate(a, b, rules, options)
    if report.stopped:
        return Reconciliation(report, None)
    blank = report.counts["blank_any_source"] or report.counts["blank_any_target"]
    return Reconciliation(report, compare(a, b, rules, options, keep_all, keys_complete=not blank, keys_unique=options.on_duplicates == "stop"))
