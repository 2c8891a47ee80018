"""Queries that write the test tables as files, and read them with the sources.

Files go to a new folder under the one that driver and executors share.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.functions import statements as st
from tablerecon.plans import compare as cmp
from tablerecon.plans import report as rep
from tablerecon.plans.rules import load_rules
from tablerecon.session import ensure_checkpoint_dir
from tablerecon.sources import textfiles as tf
from tablerecon.sources import workbooks as wb
from tablerecon.sources.files import create_binary
from tablerecon.workload import comparing
from tablerecon.workload import fixtures as fx
from tablerecon.workload.fixtures import table
from tablerecon.workload.registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- text files -----------------------------------------------------------------------------------------------------

# Texts with what a CSV file must quote.
_NAME = "CASE WHEN c_custkey % 7 = 0 THEN ' say \"' || c_name || '\", then' || chr(10) || 'go' WHEN c_custkey % 5 = 0 THEN '编码，' || c_name || ',' ELSE c_name END"
_CUSTOMERS_SQL = f"SELECT CAST(c_custkey AS VARCHAR) AS id, {_NAME} AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer"


def _customers(spark, sf) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    said = F.concat(F.lit(' say "'), name, F.lit('", then\ngo'))
    shown = F.when(k % 7 == 0, said).when(k % 5 == 0, F.concat(F.lit("编码，"), name, F.lit(","))).otherwise(name)
    segment = F.when(k % 3 != 0, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(k.cast("string").alias("id"), shown.alias("name"), segment.alias("segment"))


@query("csv_bom_round_trip", _CUSTOMERS_SQL)
def _(spark, sf):
    folder = _folder(spark, "csv")
    tf.write_csv_bom(_customers(spark, sf).repartition(4, "id"), folder)
    return tf.read_csv_parts(spark, folder)


def _mixed(spark, sf) -> list[str]:
    """The customers as CSV files in UTF-8 and in UTF-16, a folder each."""
    folders = []
    for i, encoding in enumerate(("UTF-8", "UTF-16")):
        folders.append(_folder(spark, encoding.lower()))
        rows = _customers(spark, sf).where(F.col("id").cast("long") % 2 == i).coalesce(1)
        options = {"header": True, "escape": '"', "encoding": encoding, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        rows.write.options(**options).csv(folders[-1])
    return folders


@query("csv_mixed_encodings", _CUSTOMERS_SQL)
def _(spark, sf):
    return tf.read_csv_text(spark, _mixed(spark, sf), range_bytes=1 << 16).drop("_file")


@query(
    "csv_catalogue",
    """SELECT 'utf-8' AS encoding, 'id,name,segment' AS columns, true AS multiline UNION ALL SELECT 'utf-16', 'id,name,segment', true""",
)
def _(spark, sf):
    folders = _mixed(spark, sf)
    probed = tf.probe_encodings(spark, folders).select("file", "multiline")
    return tf.csv_catalog(spark, folders).join(probed, "file").select("encoding", F.array_join("columns", ",").alias("columns"), "multiline")


@query(
    "statements_round_trip",
    "SELECT 'UPDATE t SET priority = ''' || o_orderpriority || ''' WHERE k = ' || o_orderkey || ';' AS line FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("k"))
    statement = st.render_update("t", {"priority": "text"}, {"k": "number"})
    folder = _folder(spark, "statements")
    # The second run replaces what the first one wrote.
    tf.write_statements(orders.select(F.lower("priority").alias("statement")), folder)
    tf.write_statements(orders.select(statement.alias("statement")), folder)
    return tf.read_statements(spark, folder)


# --- workbooks ------------------------------------------------------------------------------------------------------

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _workbook(sheets: dict[str, list[list]], merges: str = "") -> bytes:
    """A small workbook: texts in place, numbers as numbers."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData>{merges}</worksheet>")
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_LINKS}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>')
    return out.getvalue()


def _workbooks(spark, sf, two_level: bool) -> str:
    """A workbook for every 400 customers, with a sheet for even and one for odd keys."""
    folder = _folder(spark, "books")
    merges = '<mergeCells><mergeCell ref="A2:B2"/><mergeCell ref="C2:D2"/></mergeCells>' if two_level else ""

    def write(rows: pa.Table) -> pa.Table:
        values = [rows.column(c).to_pylist() for c in ("c_custkey", "c_name", "c_mktsegment", "c_acctbal")]
        head = [["*客户 编码", "name", "segment", "amount"]]
        if two_level:
            head = [["客户", None, "账户", None], ["编码", "名称", "类别", "金额"]]
        sheets = {
            sheet: [["customers"], *head, *[list(r) for r in zip(*values) if r[0] % 2 == odd]] for odd, sheet in enumerate(("even", "odd"))
        }
        part = rows.column("part")[0].as_py()
        with create_binary(f"{folder}/客户 {part}.xlsx") as f:
            f.write(_workbook(sheets, merges))
        return pa.table({"part": pa.array([part], pa.int64())})

    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").cast("double").alias("c_acctbal"))
    made = customers.withColumn("part", F.expr("c_custkey DIV 400")).groupBy("part").applyInArrow(write, "part long")
    made.write.format("noop").mode("overwrite").save()
    return folder


_ROWS_SQL = """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS sheet, CAST(c_custkey AS VARCHAR) AS code, c_name AS name,
  c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(12,2)) AS amount FROM customer"""


@query("workbooks_read", _ROWS_SQL)
def _(spark, sf):
    read = wb.read_workbooks(spark, [_workbooks(spark, sf, False)], layout=wb.Layout(header_row=2))
    return read.select(F.col("_sheet").alias("sheet"), F.col("客户编码").alias("code"), "name", "segment", F.col("amount").cast("decimal(12,2)").alias("amount"))


@query("workbooks_two_level_header", _ROWS_SQL + " WHERE c_custkey % 2 = 1")
def _(spark, sf):
    read = wb.read_workbooks(spark, [_workbooks(spark, sf, True)], "odd", wb.Layout(header_row=2, two_level=True))
    names = {"_sheet": "sheet", "客户-编码": "code", "客户-名称": "name", "账户-类别": "segment"}
    return read.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()], F.col("`账户-金额`").cast("decimal(12,2)").alias("amount"))


@query(
    "workbooks_catalogue",
    """SELECT unnest(['even', 'odd']) AS sheet, '客户编码,name,segment,amount' AS columns, count(DISTINCT c_custkey // 400) AS n_files FROM customer""",
)
def _(spark, sf):
    found = wb.workbook_catalog(spark, [_workbooks(spark, sf, False)], wb.Layout(header_row=2))
    return found.groupBy("sheet", F.array_join("columns", ",").alias("columns")).agg(F.count_distinct("file").alias("n_files"))


@query("rule_sheet_summary", comparing.marked() + comparing.ORDER_COUNTS)
def _(spark, sf):
    # The rules come from a sheet, as people keep them.
    sheet = [
        ("o_orderkey", "key", "文本", "", "是", ""),
        ("o_totalprice", "price", "数值", "0.01", "否", ""),
        ("o_orderdate", "order_dt", "日期", "月", "", ""),
        (" o_orderpriority ", "priority", "文本", None, None, None),
        ("", "spare", "文本", "", "", ""),
        ("o_orderstatus", "status", "文本", "", "", ""),
    ]
    rules = load_rules(spark.createDataFrame(sheet, ", ".join(f"c{i} string" for i in range(6))))
    return rep.summarize(cmp.compare(fx.orders_source(spark, sf), fx.orders_target(spark, sf), rules))
