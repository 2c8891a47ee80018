"""Edge rows of the normalizers, date ladder, numbers, calculations and statements."""

import pytest
from pyspark.sql import functions as F

from tablerecon.functions import calc as ca
from tablerecon.functions import dates as dt
from tablerecon.functions import numbers as nu
from tablerecon.functions import statements as st
from tablerecon.functions import text as tx


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_norm_blank_forms(spark):
    rows = [None, "", "  ", "　", "\t\n", " a b ", "　x\x85", "None", " NULL ", "é"]
    assert values(spark, tx.norm("v"), rows) == ["", "", "", "", "", "a b", "x", "None", "NULL", "é"]
    assert values(spark, tx.norm("v", nulls=("None",)), rows)[7:9] == ["", "NULL"]
    assert values(spark, tx.norm("v", nulls=("none", "null"), ci=True), rows)[7:9] == ["", ""]


def test_norm_agrees_with_python_strip(spark):
    rows = [chr(c) + "a" + chr(c) for c in range(1, 0x3100) if chr(c).isspace()]
    assert values(spark, tx.norm("v"), rows) == ["a"] * len(rows)
    assert values(spark, tx.strip_all_space("v"), rows) == ["a"] * len(rows)


def test_bool_and_synonym(spark):
    assert values(spark, tx.norm_bool("v"), ["Y", " y", "是", "n", "否 ", "yes", None]) == ["是", "是", "是", "否", "否", "yes", ""]
    assert values(spark, tx.norm_synonym("v", {"直线法": "年限平均法"}), ["直线法 ", "年限平均法", "x"]) == ["年限平均法", "年限平均法", "x"]


def test_last_segment(spark):
    assert values(spark, tx.last_segment("v"), ["a\\b-c", "a-b - c", "plain", "", None]) == ["b-c", "c", "plain", "", ""]
    assert values(spark, tx.last_segment("v", "-"), ["a\\b-c", "x"]) == ["c", "x"]


def test_prefix_and_pad(spark):
    assert values(spark, tx.prefix("v", 2, digits_only=True), ["1234", "ab12", "1"]) == ["12", "ab12", "1"]
    assert values(spark, tx.prefix("v", 2), ["1234", "ab12"]) == ["12", "ab"]
    assert values(spark, tx.pad_code("v"), ["12", "12345678901", None]) == ["0000000012", "12345678901", None]


def test_safe_name(spark):
    rows = ['a/b\\c:d*e?f"g<h>i|j', " .x. ", "..", None, "z" * 300]
    assert values(spark, tx.safe_name("v"), rows) == ["a_b_c_d_e_f_g_h_i_j", "x", "unnamed", "unnamed", "z" * 200]


LADDER = [
    ("2024-1-5", "2024-01-05"), ("2024/01/05", "2024-01-05"), ("2024年1月5日", "2024-01-05"), ("1-5-2024", "2024-01-05"),
    ("01/05/2024", "2024-01-05"), ("20240105", "2024-01-05"), ("2024-01-05 3:04:05", "2024-01-05"), (" 2024-01-05 ", "2024-01-05"),
    ("1/5/2024", "2024-01-05"), ("2024-02-30", "2024-02-30"), ("20241305", "20241305"), ("soon", "soon"), ("", ""), (None, ""),
    ("2024-01", "2024-01"), ("2024-02-29", "2024-02-29"), ("2023-02-29", "2023-02-29"),
]


def test_date_ladder(spark):
    assert values(spark, dt.parse_date("v"), [a for a, _ in LADDER]) == [b for _, b in LADDER]


def test_date_free_and_precision(spark):
    assert values(spark, dt.parse_date("v", mode="free"), ["2024-02-30", "20240105", None]) == [None, "2024-01-05", None]
    rows = ["2024-01-05 03:04:05", "2024-1-5"]
    assert values(spark, dt.comparable_date("v", "分"), rows) == ["2024-01-05 03:04", "2024-01-05 00:00"]
    assert values(spark, dt.comparable_date("v", "年"), rows) == ["2024", "2024"]
    assert values(spark, dt.comparable_date("v", None, "year"), rows) == ["2024", "2024"]
    assert values(spark, dt.comparable_date("v", "month", mode="prefix"), rows) == ["2024-01", "2024-1-"]


def test_date_sql_mode_ignores_what_is_no_date(spark):
    differs = dt.date_differs("v", F.lit("2024-01-06"), "day", mode="sql")
    assert values(spark, differs, ["2024-01-05", "soon", None, "2024/1/6"]) == [True, False, False, False]


def test_norm_date_digits(spark):
    rows = ["20240105", "2024/01/05", "2024-1-5", "24-1-5", "2024年1月", "1-2-3-4", ""]
    wanted = ["2024-01-05", "2024-01-05", "2024-01-05", "24-01-05", "2024年1月", "1-2-3-4", ""]
    assert values(spark, dt.norm_date_digits("v"), rows) == wanted


def test_to_num(spark):
    rows = [" 12 ", "1e3", "1,000", "NaN", "", None, "12d", "3.f", "0x1p3", "-.5", "x"]
    assert values(spark, nu.to_num("v"), rows) == [12.0, 1000.0, None, None, None, None, None, None, None, -0.5, None]


@pytest.mark.parametrize(
    "a, b, tolerance, one_sided, differs",
    [
        (1.0, 1.25, 0.25, "differs", False), (1.0, 1.26, 0.25, "differs", True), (None, None, 0.1, "differs", False),
        (None, 1.0, 0.1, "differs", True), (None, 1.0, 0.1, "ignore", False), (1.0, None, None, "ignore", True),
        (None, None, None, "differs", False), (1.0, 1.0, None, "differs", False),
    ],
)
def test_num_differs(spark, a, b, tolerance, one_sided, differs):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(nu.num_differs(F.col("a"), F.col("b"), tolerance, one_sided)).first()[0] is differs


def test_rounded_differs(spark):
    df = spark.createDataFrame([(None, 0.004), (1.0, 3.1)], "a double, b double")
    assert [r[0] for r in df.select(nu.rounded_differs(F.col("a"), F.col("b"), 2, 2.0)).collect()] == [False, True]


def test_number_formats(spark):
    assert nu.spreadsheet_date_pattern("yyyy-mm-dd hh:mm:ss") == "yyyy-MM-dd HH:mm:ss"
    for fmt, pattern in (("h:mm", "H:mm"), ("mm:ss", "mm:ss"), ("h:mm AM/PM", "h:mm a")):
        assert nu.is_date_format(fmt) and nu.spreadsheet_date_pattern(fmt) == pattern
    assert nu.spreadsheet_date_pattern("yyyy年m月d日;@").replace("'", "") == "yyyy年M月d日"
    render = lambda f, **k: values(spark, nu.render_number_format("v", f, **k), [1234.5, None], "double")
    assert render("#,##0.00") == ["1234.50", ""]
    assert render("0") == ["1235", ""]
    assert render("0.0%") == ["123450.0%", ""]
    assert render("0.0%", percent=False) == ["1234.5", ""]
    assert render("General") == ["1234.5", ""]


def test_calc_rules(spark):
    df = spark.createDataFrame([("12", " 5 ", None, "0"), ("x", "-2", "ab", "4")], "`使用年限` string, `折旧a` string, t string, d1 string")

    def run(rule, kind, *args):
        return [r[0] for r in df.select(ca.calc(df, rule, kind, *args)).collect()]

    assert run("使用年限+折旧a/2", "number") == [14.5, -1.0]
    assert run("折旧a", "number", ["折旧"]) == [5.0, 2.0]
    assert run("使用年限/d1", "number") == [0.0, 0.0]
    assert run("(使用年限 + 1) * -2.5", "number") == [-32.5, -2.5]
    assert run("t + d1", "text") == ["0", "ab4"]
    assert run("使用年限[:1]", "text") == ["1", "x"]
    assert run(" t [: 1 ]", "number") == ["", "a"]
    for bad in ("nope + 1", "__import__('os')", "t ** 2", "t if d1 else t", "1 +", "t.real", "'a' + t"):
        with pytest.raises(ca.CalcError):
            run(bad, "number")
    with pytest.raises(ca.CalcError):
        run("t + nope", "text")
    with pytest.raises(ca.CalcError):
        run("t", "date")


def test_update_statement(spark):
    df = spark.sql("SELECT '5100' AS vid, 'O''Brien' AS clerk, DATE'2024-10-22' AS d, CAST(NULL AS STRING) AS none, 'c1' AS code")
    text = df.select(st.render_update("t", {"vid": "number", "none": "number", "clerk": "text", "d": "date"}, ["code"])).first()[0]
    assert text == (
        "UPDATE t SET vid = 5100, none = NULL, clerk = 'O''Brien', d = TO_DATE('2024-10-22', 'yyyy-MM-dd') WHERE code = 'c1';"
    )


def test_rewrite_timestamps(spark):
    rows = ["x TIMESTAMP '2024-11-06 09:52:36', TIMESTAMP '2024-11-06'"]
    assert values(spark, st.rewrite_timestamps("v"), rows) == ["x TO_DATE('2024-11-06', 'yyyy-MM-dd'), TIMESTAMP '2024-11-06'"]


def test_months_and_days_of_one_digit(spark):
    from tablerecon.functions.dates import parse_date

    spelled = ["12-5-2024", "1-15-2024", "12/5/2024", "1/15/2024", "1/5/2024", "01-05-2024", "2024-1-5", "2024/12/5", "2024-1-5 3:4:5"]
    days = ["2024-12-05", "2024-01-15", "2024-12-05", "2024-01-15", "2024-01-05", "2024-01-05", "2024-01-05", "2024-12-05", "2024-01-05"]
    df = spark.createDataFrame([(s,) for s in spelled], "d string")
    for mode in ("ladder", "strict", "free"):
        assert [r[0] for r in df.select(parse_date("d", mode)).collect()] == days
    free = ["2024-01-05T03:04:05", "2024.1.5", "2024/1/5 03:04", "2024-01-05 03:04:05.25", "5 o'clock", "2024.1.5.6"]
    df = spark.createDataFrame([(s,) for s in free], "d string")
    assert [r[0] for r in df.select(parse_date("d", "free")).collect()] == ["2024-01-05"] * 4 + [None] * 2
    assert [r[0] for r in df.select(parse_date("d", "strict")).collect()][1] is None


def test_dates_as_people_write_them(spark):
    spelled = {
        "5 January 2024": "2024-01-05 00:00:00", "5th of Jan. 2024": "2024-01-05 00:00:00", "Jan 5, 2024 3:04 pm": "2024-01-05 15:04:00",
        "SEPT-5-24": "2024-09-05 00:00:00", "13/01/2024": "2024-01-13 00:00:00", "01/13/2024": "2024-01-13 00:00:00",
        "1/5/2024 03:04": "2024-01-05 03:04:00", "31.12.99": "1999-12-31 00:00:00", "5.1.68 1:02:03": "2068-05-01 01:02:03",
        "Friday, 5 jan 2024": "2024-01-05 00:00:00", "2024-Jan-05": "2024-01-05 00:00:00", "2024/1/5 12:00:01 AM": "2024-01-05 00:00:01",
        "2024-01-05T03:04:05.123Z": "2024-01-05 03:04:05", "2024-01-05 03:04:05+09:30": "2024-01-05 03:04:05",
        "2024年1月": "2024-01-01 00:00:00", "January 2024": "2024-01-01 00:00:00", "2024-02": "2024-02-01 00:00:00", "2024": "2024-01-01 00:00:00",
        "20240105 1:2": "2024-01-05 01:02:00", "30 Feb 2024": None, "13/13/2024": None, "Janus 5 2024": None, "5 January": None,
        "1/5-2024": None, "25:00": None, "2024-01-05 25:00": None, "2024-01-05 13:00 pm": None, "12": None, "tomorrow": None, "": None,
    }
    df = spark.createDataFrame([(s,) for s in spelled], "d string")
    assert dict(df.select("d", dt.parse_date("d", "free", keep_time=True)).collect()) == spelled
