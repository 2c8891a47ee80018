"""Small pieces of DuckDB SQL that the reference statements are built from."""

from __future__ import annotations

# The date spellings of the ladder.
DATE_FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%Y年%m月%d日", "%m-%d-%Y", "%m/%d/%Y", "%Y%m%d", "%Y-%m-%d %H:%M:%S"]


SPACES = " || ".join(
    f"chr({n})" for n in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)


def norm(x: str) -> str:
    return f"coalesce(trim(CAST({x} AS VARCHAR), {SPACES}), '')"


def yes_no(x: str) -> str:
    n = norm(x)
    return f"CASE WHEN upper({n}) IN ('是', 'Y') THEN '是' WHEN upper({n}) IN ('否', 'N') THEN '否' ELSE {n} END"


def text_differs(a: str, b: str, bools: bool = True) -> str:
    plain = f"({norm(a)}) <> ({norm(b)})"
    return f"({plain} AND ({yes_no(a)}) <> ({yes_no(b)}))" if bools else f"({plain})"


def to_num(x: str) -> str:
    return f"nullif(try_cast({x} AS DOUBLE), 'nan'::DOUBLE)"


def num_differs(a: str, b: str, tolerance: str | None = None, ignore_null: bool = False) -> str:
    if tolerance is None:
        return f"({a} IS DISTINCT FROM {b})"
    one_sided = "false" if ignore_null else f"NOT ({a} IS NULL AND {b} IS NULL)"
    return f"coalesce(abs({a} - {b}) > {tolerance}, {one_sided})"


def parsed(x: str) -> str:
    formats = ", ".join(f"'{f}'" for f in DATE_FORMATS)
    return f"try_strptime({norm(x)}, [{formats}])"


def ladder(x: str) -> str:
    return f"coalesce(strftime({parsed(x)}, '%Y-%m-%d'), {norm(x)})"
