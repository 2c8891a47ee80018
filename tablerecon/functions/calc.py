"""Calculated fields: the rule sheet's small notation as Columns.

``code[:4]`` takes a prefix, ``a+b`` on a text rule concatenates, and on a
number rule ``+ - * / ( )`` over column names and numbers is arithmetic.
Python's own expression grammar reads the arithmetic; only names of known
columns, numbers and these operators are let through.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.names import col
from tablerecon.functions.numbers import num_or_zero

_PREFIX = re.compile(r"^\s*(?P<field>.+?)\s*\[:\s*(?P<n>\d+)\s*\]\s*$")
_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
}


class CalcError(ValueError):
    """A calculation rule that cannot be applied to a table."""


def calc_prefix(c: Column | str, length: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, length)


def calc_concat(cols: Sequence[Column], null_safe: bool = True) -> Column:
    """Concatenate; a null part counts as ``''`` unless ``null_safe`` is off."""
    parts = [c.cast("string") for c in cols]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts] if null_safe else parts)


def _need(df: DataFrame, names: Sequence[str], rule: str) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise CalcError(f"rule {rule!r} names unknown fields: {', '.join(unknown)}")


def _arithmetic(df: DataFrame, rule: str, abs_if_name_contains: Sequence[str]) -> Column:
    names = sorted(df.columns, key=len, reverse=True)
    slots: dict[str, str] = {}

    def to_slot(match: re.Match) -> str:
        return slots.setdefault(match.group(0), f"_slot{len(slots)}_")

    pattern = "|".join(re.escape(n) for n in names if n and not n.isdigit())
    safe = re.sub(rf"(?<!\w)(?:{pattern})(?!\w)", to_slot, rule) if pattern else rule
    by_slot = {slot: name for name, slot in slots.items()}
    types = {f.name: f.dataType for f in df.schema.fields}
    try:
        tree = ast.parse(safe.strip(), mode="eval").body
    except SyntaxError as e:
        raise CalcError(f"rule {rule!r} is no arithmetic expression") from e
    unknown = [n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id not in by_slot]
    if unknown:
        raise CalcError(f"rule {rule!r} names unknown fields: {', '.join(unknown)}")

    def build(node: ast.AST) -> Column:
        match node:
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](build(left), build(right))
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -build(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return build(operand)
            case ast.Name(id=slot):
                name = by_slot[slot]
                value = num_or_zero(col(name), types[name])
                return F.abs(value) if any(w in name for w in abs_if_name_contains) else value
            case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
                return F.lit(float(number))
        raise CalcError(f"rule {rule!r} uses more than + - * / ( )")

    # Division by zero is null, and a null result counts as 0.
    return F.coalesce(build(tree), F.lit(0.0))


def calc(
    df: DataFrame,
    rule: str,
    kind: str,
    abs_if_name_contains: Sequence[str] = (),
    null_safe: bool = True,
    decimal_scale: int | None = None,
) -> Column:
    """The Column a calculation rule describes over ``df``."""
    cut = _PREFIX.match(rule)
    if cut:
        field = cut.group("field")
        _need(df, [field], rule)
        return calc_prefix(col(field), int(cut.group("n")))
    if kind == "text":
        fields = [f.strip() for f in rule.split("+")]
        _need(df, fields, rule)
        return calc_concat([col(f) for f in fields], null_safe)
    if kind == "number":
        value = _arithmetic(df, rule, abs_if_name_contains)
        return value if decimal_scale is None else value.cast(f"decimal(20,{decimal_scale})")
    raise CalcError(f"a calculation rule needs a text or number field, not {kind}")
