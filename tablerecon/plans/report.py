"""What people read off a comparison: counts, statuses, details, reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.text import display_key, norm
from tablerecon.functions.names import col
from tablerecon.plans.compare import Comparison, differs_name
from tablerecon.plans.match import IN_SRC, IN_TGT, PAIRS, SRC, TGT, key_name


@dataclass(frozen=True)
class Labels:
    """The texts reports are written in."""

    equal: str = "一致"
    differs: str = "不一致"
    not_in_target: str = "此数据不存在于SAP"
    not_in_source: str = "此数据不存在于平台"
    status: str = "对比结果"
    source: str = "平台表"
    target: str = "ERP表"
    field: str = "列"
    more: str = "...还有 {} 条差异记录未显示..."
    more_lines: str = "...（还有 {} 条消息未显示）"
    key: str = "主键："
    pair_source: str = "文件1_"
    pair_target: str = "文件2_"


LABELS = Labels()


def summarize(result: Comparison) -> DataFrame:
    """One row of counts; every count is a conditional sum over the one match.

    With fan-out, ``common`` and ``differing`` count row pairs.
    """
    n = F.col(PAIRS)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    in_src, in_tgt = F.col(IN_SRC), F.col(IN_TGT)
    counts = result.frame.agg(
        total(in_src & ~in_tgt).alias("missing"),
        total(in_tgt & ~in_src).alias("extra"),
        total(in_src & in_tgt).alias("common"),
        total(result.any_differs).alias("differing"),
    )
    common, differing = F.col("common"), F.col("differing")
    ratio = F.when(common > 0, differing / common).otherwise(F.lit(0.0))
    return counts.select(
        F.lit(" + ".join(result.keys)).alias("primary_key"),
        (common + F.col("missing")).alias("total_source"),
        (common + F.col("extra")).alias("total_target"),
        "missing",
        "extra",
        "common",
        "differing",
        (common - differing).alias("equal"),
        F.round(ratio, 6).alias("diff_ratio"),
        (F.col("missing") != F.col("extra")).alias("row_counts_differ"),
        F.lit(", ".join(result.missing_columns)).alias("missing_columns"),
    )


def field_counts(result: Comparison) -> DataFrame:
    """Differing rows per field, from one pass."""
    sums = result.frame.agg(*[F.count_if(col(differs_name(f))).alias(f) for f in result.fields])
    return sums.unpivot([], [col(f) for f in result.fields], "field", "differing")


def _shown(result: Comparison, tag: str, field: str) -> Column:
    return norm(col(tag + field), dtype=result.frame.schema[tag + field].dataType)


def diff_records(result: Comparison) -> DataFrame:
    """One row per differing field: key, field, both values.

    Equal rows are dropped first, so values are written out for differing ones only.
    """
    entries = [
        F.when(
            col(differs_name(f)),
            F.struct(
                F.lit(f).alias("field"),
                _shown(result, SRC, f).alias("source_value"),
                _shown(result, TGT, f).alias("target_value"),
            ),
        )
        for f in result.fields
    ]
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    rows = result.differing().select(*result.key_columns, F.explode(found).alias("_record"))
    return rows.select(*[col(k) for k in result.keys], "_record.*")


def diff_pairs(result: Comparison) -> DataFrame:
    """Full source and target row of each differing key, as two structs."""

    def side(tag: str) -> Column:
        return F.struct(*[col(c).alias(c.removeprefix(tag)) for c in result.side_columns(tag)])

    return result.differing().select(
        *result.key_columns, side(SRC).alias("source"), side(TGT).alias("target"), F.col(PAIRS).alias("pairs")
    )


def side_by_side(result: Comparison, labels: Labels = LABELS) -> DataFrame:
    """Differing rows with both sides' columns next to each other."""
    return result.differing().select(
        *[col(c).alias(labels.pair_source + c.removeprefix(SRC)) for c in result.side_columns(SRC)],
        *[col(c).alias(labels.pair_target + c.removeprefix(TGT)) for c in result.side_columns(TGT)],
    )


def diff_mask(result: Comparison) -> DataFrame:
    """Which cells of each differing row to highlight: one boolean per field."""
    return result.differing().select(*result.key_columns, *[col(differs_name(f)).alias(f) for f in result.fields])


def status_column(result: Comparison, labels: Labels = LABELS) -> Column:
    return (
        F.when(~F.col(IN_TGT), F.lit(labels.not_in_target))
        .when(~F.col(IN_SRC), F.lit(labels.not_in_source))
        .when(result.any_differs, F.lit(labels.differs))
        .otherwise(F.lit(labels.equal))
    )


def _side_rows(result: Comparison, side: str) -> DataFrame:
    return result.frame.where(F.col(IN_SRC if side == "source" else IN_TGT))


def status(result: Comparison, side: str = "source", labels: Labels = LABELS) -> DataFrame:
    """The keys of one side with their status."""
    return _side_rows(result, side).select(*result.key_columns, status_column(result, labels).alias("status"))


def detail_column(result: Comparison, field: str, labels: Labels = LABELS) -> Column:
    text = F.concat(
        F.lit(f"{labels.differs}：{labels.source}="),
        _shown(result, SRC, field),
        F.lit(f", {labels.target}="),
        _shown(result, TGT, field),
    )
    return F.when(col(differs_name(field)), text).otherwise(F.lit(""))


def detail_columns(result: Comparison, side: str = "source", labels: Labels = LABELS) -> DataFrame:
    """The keys of one side with one detail text per field."""
    return _side_rows(result, side).select(
        *result.key_columns, *[detail_column(result, f, labels).alias(f) for f in result.fields]
    )


def annotate(result: Comparison, side: str = "source", labels: Labels = LABELS) -> DataFrame:
    """One side's rows with their status and a detail column per field.

    Compare with ``keep_all=True`` to have the columns without a rule here too.
    """
    tag = SRC if side == "source" else TGT
    return _side_rows(result, side).select(
        *[col(c).alias(c.removeprefix(tag)) for c in result.side_columns(tag)],
        status_column(result, labels).alias(labels.status),
        *[detail_column(result, f, labels).alias(f"{f}_{labels.status}") for f in result.fields],
    )


def _log_line(field: Column, source_value: Column, target_value: Column, labels: Labels) -> Column:
    return F.concat(
        F.lit(f" - {labels.field} ["),
        field,
        F.lit(f"] {labels.differs}：{labels.source}="),
        source_value,
        F.lit(f", {labels.target}="),
        target_value,
    )


def log_lines(result: Comparison, labels: Labels = LABELS) -> DataFrame:
    """A log line per difference, showing values as they were before any lookup."""
    records = diff_records(result)
    line = _log_line(F.col("field"), F.col("source_value"), F.col("target_value"), labels)
    return records.select(display_key([col(k) for k in result.keys]).alias("display_key"), "field", line.alias("line"))


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (a distributed top-n)."""
    return df.orderBy(*[col(o) for o in order]).limit(n)


#: Keys and lines a log shows at most.
MAX_KEYS, MAX_LINES = 10_000, 5_000


def _note(pattern: str, n: Column) -> Column:
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def _first_keys(result: Comparison, n: int, lines: Column) -> DataFrame:
    """One row: ``shown``, the first ``n`` differing keys in key order with their lines, and ``total``, how many differ.

    The differing rows are shuffled once; both the top-n and the count read
    that shuffle, so the comparison is joined once.
    """
    names = [key_name(i) for i in range(len(result.keys))]
    rows = result.differing().select(*names, display_key(names).alias("_shown_key"), lines.alias("_lines")).repartition(*names)
    top = rows.orderBy(*names).limit(n).select(F.struct(*names, "_shown_key", "_lines").alias("top"), F.lit(0).cast("long").alias("n"))
    # Each row counts as 1, found from all its columns: only if both readers want the same of the shuffle is it made once.
    one = F.pmod(F.xxhash64(*names, "_shown_key", "_lines"), F.lit(1)) + 1
    count = rows.select(one.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    both = top.unionByName(count, allowMissingColumns=True)
    return both.agg(F.sort_array(F.collect_list("top")).alias("shown"), F.sum("n").alias("total"))


def capped_log(result: Comparison, max_keys: int = MAX_KEYS, max_lines: int = MAX_LINES, labels: Labels = LABELS) -> DataFrame:
    """The difference log as people read it: ``line_no`` from 1, and ``line``.

    Each differing key in key order has a line of its own and one per
    differing field, with values as they were before any lookup.  Beyond
    ``max_keys`` keys a note says how many follow, and beyond ``max_lines``
    lines another.  What is shown is bounded by the caps; the notes count all.
    """
    fields = [
        F.when(col(differs_name(f)), _log_line(F.lit(f), _shown(result, SRC, f), _shown(result, TGT, f), labels)) for f in result.fields
    ]
    first = _first_keys(result, max_keys, F.filter(F.array(*fields), lambda x: x.isNotNull()))
    of_key = F.transform("shown", lambda x: F.concat(F.array(F.concat(F.lit(labels.key), x["_shown_key"])), x["_lines"]))
    hidden = F.col("total") - F.size("shown")
    lines = F.concat(F.flatten(of_key), F.filter(F.array(F.when(hidden > 0, _note(labels.more, hidden))), lambda x: x.isNotNull()))
    size = F.size("lines")
    cut = F.concat(F.slice("lines", 1, max_lines), F.array(_note(labels.more_lines, size - max_lines)))
    shown = first.select(lines.alias("lines")).select(F.posexplode(F.when(size > max_lines, cut).otherwise(F.col("lines"))).alias("place", "line"))
    return shown.select((F.col("place") + 1).alias("line_no"), "line")


def cap_details(result: Comparison, n: int, labels: Labels = LABELS) -> DataFrame:
    """The first ``n`` differing keys in key order, and a line saying how many follow.

    Only what is shown is capped; counts and reports always cover all rows.
    """
    first = _first_keys(result, n, F.array().cast("array<string>"))
    hidden = F.col("total") - F.size("shown")
    keys = F.transform("shown", lambda x: F.struct(F.lit(0).alias("is_note"), x["_shown_key"].alias("line")))
    note = F.filter(F.array(F.when(hidden > 0, F.struct(F.lit(1).alias("is_note"), _note(labels.more, hidden).alias("line")))), lambda x: x.isNotNull())
    return first.select(F.inline(F.concat(keys, note)))


def report_rows(result: Comparison) -> DataFrame:
    """Missing, extra and differing rows in one table, told apart by ``section``."""
    section = (
        F.when(~F.col(IN_TGT), F.lit("missing"))
        .when(~F.col(IN_SRC), F.lit("extra"))
        .when(result.any_differs, F.lit("differing"))
    )
    rows = result.frame.withColumn("section", section).where(F.col("section").isNotNull())
    return rows.select(
        "section",
        *[col(c) for c in result.side_columns(SRC)],
        *[col(c) for c in result.side_columns(TGT)],
        *[col(differs_name(f)).alias(f"differs_{f}") for f in result.fields],
    )


def write_report(result: Comparison, path: str, fmt: str = "parquet") -> None:
    """The report as one dataset with a folder per section, from a single job."""
    report_rows(result).write.mode("overwrite").partitionBy("section").format(fmt).save(path)
