import csv
import io
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F
from workbook_writer import write_workbook

from tablerecon.plans.rules import load_rules
from tablerecon.sources import textfiles as tf
from tablerecon.sources import workbooks as wb
from tablerecon.sources.datagen import generate_like, permuted
from tablerecon.sources.files import open_binary


def test_workbooks_single_header(spark, tmp_path):
    rows = [["*资产 编码", "金额", None], ["A1", 12, True], ["A2", 1.5, "x"], [None, None, None], ["A3", (45296, 1), None]]
    write_workbook(tmp_path / "a.xlsx", {"data": (rows, []), "other": ([["k"], ["v"]], [])}, ["yyyy-mm-dd"])
    write_workbook(tmp_path / "b.xlsx", {"data": ([["金额", "资产编码"], [7, "B1"]], [])}, shared=False)
    df = wb.read_workbooks(spark, [str(tmp_path / "*.xlsx")], "data")
    assert set(df.columns) == {"_file", "_sheet", "_row", "资产编码", "金额", "_column_3"}
    got = {r["资产编码"]: (r["_row"], r["金额"], r["_column_3"]) for r in df.collect()}
    assert got == {"A1": (2, "12", "True"), "A2": (3, "1.5", "x"), "A3": (5, "2024-01-05", None), "B1": (2, "7", None)}


def test_workbooks_two_level_header(spark, tmp_path):
    top = ["基本", None, "价值", None, "备注"]
    low = ["编码", "名称*", "原值", "折 旧", None]
    rows = [top, low, ["1", "n", "10", "2", "z"]]
    write_workbook(tmp_path / "m.xlsx", {"s": (rows, ["A1:B1", "C1:D1"])})
    write_workbook(tmp_path / "v.xlsx", {"s": (rows, [])})
    layout = wb.Layout(two_level=True)
    merged = wb.read_workbooks(spark, [str(tmp_path / "m.xlsx")], "s", layout)
    assert merged.columns[3:] == ["基本-编码", "基本-名称", "价值-原值", "价值-折旧", "备注"]
    assert merged.first()["价值-折旧"] == "2"
    visual = wb.read_workbooks(spark, [str(tmp_path / "v.xlsx")], "s", layout)
    assert visual.columns[3:] == ["基本-编码", "基本-名称", "价值-原值", "价值-折旧", "备注"]
    assert visual.count() == 1


def test_workbooks_header_offset_display_and_catalog(spark, tmp_path):
    rows = [["title"], ["skip"], ["k", "rate", "sum"], ["1", (0.125, 1), (1234.5, 2)]]
    path = str(tmp_path / "o.xlsx")
    write_workbook(path, {"s": (rows, []), "t": ([["x"], [], ["p", "q"]], [])}, ["0.0%", "#,##0.00"])
    df = wb.read_workbooks(spark, [path], "s", wb.Layout(header_row=3, display=True))
    assert df.select("k", "rate", "sum").collect()[0] == ("1", "12.5%", "1234.50")
    kept = wb.read_workbooks(spark, [path], "t", wb.Layout(header_row=3, data_row=1, keep_blank_rows=True))
    assert [r["p"] for r in kept.orderBy("_row").collect()] == ["x", None, "p"]
    dropped = wb.read_workbooks(spark, [path], "s", wb.Layout(header_row=1, data_row=4))
    assert dropped.count() == 1
    catalog = {r["sheet"]: r["columns"] for r in wb.workbook_catalog(spark, [path], wb.Layout(header_row=3)).collect()}
    assert catalog == {"s": ["k", "rate", "sum"], "t": ["p", "q"]}


def test_known_columns_skip_the_header_pass(spark, tmp_path):
    path = str(tmp_path / "c.xlsx")
    write_workbook(path, {"s": ([["k", "v"], ["1", "2"]], [])})
    df = wb.read_workbooks(spark, [path], columns=["v", "absent"])
    assert df.select("v", "absent").collect()[0] == ("2", None)


def test_many_workbooks(spark, tmp_path):
    for i in range(60):
        sheets = {f"s{j}": ([["k", f"only{i % 3}"], [f"{i}-{j}", i]], []) for j in range(3)}
        write_workbook(tmp_path / f"工作 簿{i}.xlsx", sheets, shared=i % 2 == 0)
    df = wb.read_workbooks(spark, [str(tmp_path)])
    assert df.columns == ["_file", "_sheet", "_row", "k", "only0", "only1", "only2"]
    rows = df.collect()
    assert {r.k for r in rows} == {f"{i}-{j}" for i in range(60) for j in range(3)} and len(rows) == 180
    assert all(r[f"only{int(r.k.split('-')[0]) % 3}"] == r.k.split("-")[0] for r in rows)
    assert wb.workbook_catalog(spark, [str(tmp_path)]).count() == 180
    # A store that only Spark reads: the files come along as cells.
    same = wb.read_workbooks(spark, [str(tmp_path)], "s1", columns=["k"], through_spark=True)
    assert {r.k for r in same.collect()} == {f"{i}-1" for i in range(60)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("Scan binaryFile")[1].split("]")[0]


def test_sheet_details(spark, tmp_path):
    body = (
        '<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:dimension ref="A1:D4"/><x:sheetData>'
        '<x:row><x:c t="inlineStr"><x:is><x:r><x:t>a</x:t></x:r><x:rPh sb="0" eb="1"><x:t>no</x:t></x:rPh><x:r><x:t>&amp;b</x:t></x:r></x:is></x:c>'
        '<x:c t="str"><x:f>"c"</x:f><x:v>c</x:v></x:c></x:row>'
        '<x:row r="3"><x:c r="B3" t="e"><x:v>#N/A</x:v></x:c><x:c r="D3"><x:v>1e3</x:v></x:c></x:row>'
        '<x:row r="4"><x:c r="A4" t="b"><x:v>0</x:v></x:c><x:c r="B4" s="9"/></x:row></x:sheetData>'
        '<x:mergeCells><x:mergeCell ref="A1:B1"/></x:mergeCells></x:worksheet>'
    )
    path = tmp_path / "d.xlsx"
    write_workbook(path, {"s": ([], [])}, parts={"xl/worksheets/sheet1.xml": body})
    rows = wb.read_workbooks(spark, [str(path)]).orderBy("_row").collect()
    assert [tuple(r)[2:] for r in rows] == [(3, None, "#N/A", None, "1000"), (4, "False", None, None, None)]
    assert rows[0].__fields__[3:] == ["a&b", "c", "_column_3", "_column_4"]
    with open_binary(str(path)) as f:
        assert wb._Book(f).merged("s") == [(1, 0, 1)]


def test_a_long_sheet_streams(tmp_path):
    """The memory that reading takes does not grow with the sheet."""
    path = tmp_path / "long.xlsx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        write_workbook(tmp_path / "small.xlsx", {"s": ([], [])})
        with zipfile.ZipFile(tmp_path / "small.xlsx") as small:
            for name in small.namelist():
                if "sheet1" not in name:
                    z.writestr(name, small.read(name))
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(b'<worksheet><dimension ref="A1:H200000"/><sheetData>')
            for r in range(1, 200_001):
                f.write(f'<row r="{r}">{"".join(f"""<c r="{c}{r}"><v>{r * 7919}</v></c>""" for c in "ABCDEFGH")}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    tracemalloc.start()
    with open_binary(str(path)) as f:
        n = sum(len(cells) for _, cells, _ in wb._Book(f).rows("s", False, frozenset([0, 7])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < 8 << 20


def test_csv_encodings(spark, tmp_path):
    body = '编码,名称,备注\n1,"多行\n字段",\n2,"a ""q"" b",NA\n'
    for name, encoding in (("a", "utf-8"), ("b", "gbk"), ("c", "utf-16"), ("d", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes(body.replace("1,", f"{name}1,").encode(encoding))
    (tmp_path / "e.csv").write_bytes("其他,表头\n5,短\n".encode("gbk"))
    probed = {r["file"][-5:]: (r["encoding"], r["multiline"]) for r in tf.probe_encodings(spark, [str(tmp_path)]).collect()}
    assert probed == {
        "a.csv": ("utf-8", True), "b.csv": ("gbk", True), "c.csv": ("utf-16", True),
        "d.csv": ("utf-8", True), "e.csv": ("gbk", False)}
    heads = {r["file"][-5:]: r["columns"] for r in tf.csv_catalog(spark, [str(tmp_path)]).collect()}
    assert heads == {f"{n}.csv": ["编码", "名称", "备注"] for n in "abcd"} | {"e.csv": ["其他", "表头"]}
    df = tf.read_csv_text(spark, [str(tmp_path)])
    assert df.columns == ["编码", "名称", "备注", "_file"]
    rows = {(r["编码"], r["名称"], r["备注"]) for r in df.collect()}
    wanted = {(f"{n}1", "多行\n字段", "") for n in "abcd"} | {("2", 'a "q" b', "NA"), ("5", "短", "")}
    assert rows == wanted
    assert df.count() == 9


def test_csv_ranges_cut_anywhere(spark, tmp_path):
    """Records are whole and in no range twice, wherever ranges cut them, in every encoding."""
    rows = [["编码", "名 称", "note"]]
    for i in range(300):
        rows.append([str(i), ["洹水", 'say "郦"', "两行\n文字\n三", "", "x,y", "q\r\nz"][i % 6], ["", "a", "\u3000", '""'][i % 4] * (i % 9)])
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator="\n").writerows(rows)
    for name, encoding in (("a", "utf-8"), ("b", "gbk"), ("c", "utf-16"), ("d", "utf-8-sig"), ("e", "utf-16-be")):
        mark = "\ufeff" if encoding == "utf-16-be" else ""
        (tmp_path / f"{name}.csv").write_bytes((mark + text.getvalue()).encode(encoding))
    (tmp_path / "f.csv").write_bytes(b"")
    (tmp_path / "g.csv").write_bytes("only,a,header".encode())
    expected = sorted(map(tuple, rows[1:]))
    for size in (10, 64, 1000, 1 << 20):
        df = tf.read_csv_text(spark, [str(tmp_path)], header_from="a.csv", range_bytes=size)
        assert df.columns == ["编码", "名 称", "note", "_file"]
        got = df.collect()
        for name in "abcde":
            assert sorted(tuple(r)[:3] for r in got if r["_file"].endswith(f"/{name}.csv")) == expected, (name, size)
        assert len(got) == 5 * 300
    whole = tf.read_csv_text(spark, [str(tmp_path)], header_from="a.csv", through_spark=True)
    assert whole.count() == 5 * 300
    assert tf.read_csv_text(spark, [str(tmp_path / "f.csv")]).columns == ["_file"]


def test_csv_without_fitting_encoding(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"k\n\xff\x01\xfa\n")
    with pytest.raises(tf.EncodingError):
        tf.read_csv_text(spark, [str(tmp_path)], encodings=("utf-8", "gbk"))


def test_csv_bom_sink_round_trip(spark, tmp_path, frame):
    df = frame("编码, 值", [("1", 'a,"b"'), ("2", "x\ny")])
    out = str(tmp_path / "out")
    tf.write_csv_bom(df.coalesce(1), out, single_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().startswith("\ufeff编码,值\n".encode("utf-8"))
    back = tf.read_csv_text(spark, [str(part)])
    assert {tuple(r)[:2] for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_csv_bom_has_one_mark_and_one_header(spark, tmp_path):
    df = spark.range(0, 1000, numPartitions=7).select(
        F.concat(F.lit(" "), "id").alias('a,"b'), F.when(F.col("id") % 3 > 0, F.concat(F.lit('say "'), "id", F.lit('", then\n'))).alias("备注"), F.lit("").alias("c")
    )
    out = tmp_path / "out"
    tf.write_csv_bom(df, str(out))
    tf.write_csv_bom(df, str(out))  # replaces what was there
    parts = sorted(out.glob("part-*"))
    assert len(parts) == 8
    whole = b"".join(p.read_bytes() for p in parts)
    assert whole.startswith('\ufeff"a,""b",备注,c\n'.encode()) and whole.count("\ufeff".encode()) == 1
    rows = list(csv.reader(io.StringIO(whole.decode("utf-8-sig"), newline="")))
    assert rows[0] == ['a,"b', "备注", "c"]
    assert rows[1:] == [[x or "" for x in r] for r in df.collect()]
    back = tf.read_csv_parts(spark, str(out))
    assert back.columns == rows[0] and sorted(map(list, back.collect())) == sorted(rows[1:])


def test_statement_sink_overwrites(spark, tmp_path, frame):
    out = str(tmp_path / "sql")
    tf.write_statements(frame("statement", [("A;",), ("B;",)]), out)
    tf.write_statements(frame("statement", [("C;",)]), out)
    assert [r.line for r in tf.read_statements(spark, out).collect()] == ["C;"]


def test_write_parts_keeps_every_row(spark, tmp_path):
    from tablerecon.operators.shape import split_by_value

    df = spark.range(100).selectExpr("id", "CASE WHEN id % 10 = 0 THEN ' ' ELSE concat('v/', id % 3) END AS v")
    out = str(tmp_path / "parts")
    tf.write_parts(split_by_value(df, "v"), out, rows_per_file=7)
    back = spark.read.parquet(out)
    assert back.count() == 90
    assert {r.part for r in back.select("part").distinct().collect()} == set(split_by_value(df, "v").toPandas().part)


def test_rule_sheet(spark, tmp_path):
    rows = [
        ["字段1", "字段2", "类型", "尾差", "主键", "计算"],
        ["编码", "code", "文本", None, "是", None],
        ["原值", "amount", "数值", 0.01, "否", None],
        ["日期", "dt", "日期", "月", None, None],
        [None, "lost", "文本", None, None, None],
        ["类别", "kind", "文本", None, None, "kind[:2]"],
    ]
    path = str(tmp_path / "rules.xlsx")
    write_workbook(path, {"比对规则": (rows, [])})
    sheet = wb.read_workbooks(spark, [path], "比对规则")
    rules = {r.source: r for r in load_rules(sheet)}
    assert list(rules) == ["编码", "原值", "日期", "类别"]
    assert rules["编码"].key and not rules["原值"].key
    assert rules["原值"].tolerance == 0.01 and rules["原值"].kind == "number"
    assert rules["日期"].precision == "month"
    assert rules["类别"].calc == "kind[:2]" and rules["类别"].tolerance is None
    assert len(load_rules(sheet.drop(sheet.columns[-1]))) == 4


def test_generate_like(spark, frame):
    df = frame("key, a, b", [(f"k{i}", "x", "y") for i in range(10)])
    made = generate_like(df, "key", 1000, seed=3)
    assert made.count() == 1000
    assert made.select("key").distinct().count() == 1000
    assert df.exceptAll(made).count() == 0
    letters = {r.a for r in made.select("a").distinct().collect()}
    assert letters == {"x", "A", "B", "C", "D", "E"}
    assert made.exceptAll(generate_like(df, "key", 1000, seed=3)).count() == 0
    assert generate_like(df, "key", 5).count() == 10


def test_generated_keys_are_distinct_whatever_is_taken(spark, frame):
    first = generate_like(frame("key, a", []), "key", 3000, seed=9)
    assert first.select("key").distinct().count() == 3000
    # Keys of an earlier run are taken; the new ones are longer than any of them.
    more = generate_like(first, "key", times=2, seed=9)
    assert more.count() == 6000 and more.select("key").distinct().count() == 6000
    with pytest.raises(ValueError):
        generate_like(first, "key")


def test_numbers_are_shuffled_one_to_one(spark):
    numbers = spark.range(1 << 16).select("id", permuted(F.col("id"), 8, 3).alias("p"), permuted(F.col("id"), 8, 4).alias("q"))
    rows = numbers.collect()
    assert {r.p for r in rows} == {r.q for r in rows} == set(range(1 << 16))
    assert sum(r.p == r.id for r in rows) < 20 and sum(r.p == r.q for r in rows) < 20


def test_quotes_after_gbk_lead_bytes(spark, tmp_path):
    from tablerecon.sources import textfiles as tf

    path = tmp_path / "g.csv"
    path.write_bytes('a,b\n"洹","x"\n"郦y",z\n'.encode("gbk"))
    row = tf.probe_encodings(spark, [str(path)]).first()
    assert (row.encoding, row.multiline) == ("gbk", False)
