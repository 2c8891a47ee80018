"""Rules, gate, comparison and reports on hand-written rows, and what must always hold."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablerecon.operators.columns import SchemaError
from tablerecon.plans import compare as cmp
from tablerecon.plans import match as m
from tablerecon.plans import report as rep
from tablerecon.plans.pairs import pair_summary
from tablerecon.plans.reconcile import gate, reconcile
from tablerecon.plans.rules import Category, Options, Rule
from tablerecon.workload import fixtures as fx

RULES = [Rule("k", key=True), Rule("n", "num", "number", tolerance=0.01), Rule("d", "day", "date"), Rule("t", "txt")]


@pytest.fixture
def pair(frame):
    a = frame("*k, n, d , t", [("1", "10", "2024-01-05", "是"), ("2", "10.5", "2024/1/6", "a"), ("3", None, None, None), ("4", "1", "x", "q")])
    b = frame("k, num, day, txt, spare", [
        ("1", "10.004", "2024年1月5日", "Y", "s"), ("2", "11", "01-07-2024", " a", "s"), (" 3 ", "", " ", "　", "s"), ("a + b", "1", "x", "q", "s")])
    return a, b


def counts(result):
    return rep.summarize(result).first().asDict()


def test_reconcile(pair):
    r = reconcile(*pair, RULES)
    assert r.gate.stopped is None and r.gate.counts["common_keys"] == 3
    c = counts(r.result)
    assert (c["missing"], c["extra"], c["common"], c["differing"], c["equal"], c["diff_ratio"]) == (1, 1, 3, 1, 2, 0.333333)
    records = {(x.k, x.field, x.source_value, x.target_value) for x in rep.diff_records(r.result).collect()}
    assert records == {("2", "n", "10.5", "11"), ("2", "d", "2024/1/6", "01-07-2024")}
    status = {x.k: x.status for x in rep.status(r.result, "target").collect()}
    assert status == {"1": "一致", "2": "不一致", "3": "一致", "a + b": "此数据不存在于平台"}
    lines = {x.line for x in rep.log_lines(r.result).collect()}
    assert " - 列 [n] 不一致：平台表=10.5, ERP表=11" in lines
    mask = rep.diff_mask(r.result).first()
    assert (mask.n, mask.d, mask.t) == (True, True, False)
    assert [x.k for x in r.result.missing().collect()] == ["4"] and [x.k for x in r.result.extra().collect()] == ["a + b"]


def test_annotate_keeps_all_columns(pair):
    rows = {r["k"]: r for r in rep.annotate(cmp.compare(*pair, RULES, keep_all=True), "target").collect()}
    assert rows["2"]["spare"] == "s" and rows["2"]["对比结果"] == "不一致"
    assert rows["2"]["n_对比结果"] == "不一致：平台表=10.5, ERP表=11" and rows["2"]["t_对比结果"] == ""


def test_report_sections_round_trip(pair, spark, tmp_path):
    result = cmp.compare(*pair, RULES).stored(str(tmp_path / "matched"))
    rep.write_report(result, str(tmp_path / "report"))
    back = spark.read.parquet(str(tmp_path / "report"))
    assert {r.section: r["count"] for r in back.groupBy("section").count().collect()} == {"missing": 1, "extra": 1, "differing": 1}


def test_cap_says_how_many_follow(pair):
    result = cmp.compare(*pair, RULES)
    assert rep.cap_details(result, 0).collect()[0].line == "...还有 1 条差异记录未显示..."
    assert [r.line for r in rep.cap_details(result, 5).collect()] == ["2"]


def test_capped_log(spark, frame):
    a = frame("k, v, w", [(f"k{i}", "1", "x") for i in range(9)])
    b = frame("k, v, w", [(f"k{i}", "1" if i % 3 == 0 else "2", "x" if i % 2 else "y") for i in range(9)])
    result = cmp.compare(a, b, [Rule("k", key=True), Rule("v"), Rule("w")])
    expected = []
    for i in range(9):
        fields = [("v", "1", "2")] * (i % 3 > 0) + [("w", "x", "y")] * (i % 2 == 0)
        if fields:
            expected.append([f"主键：k{i}"] + [f" - 列 [{f}] 不一致：平台表={x}, ERP表={y}" for f, x, y in fields])
    whole = [line for key in expected for line in key]

    def log(keys, lines):
        rows = sorted(rep.capped_log(result, keys, lines).collect())
        assert [r.line_no for r in rows] == list(range(1, len(rows) + 1))
        return [r.line for r in rows]

    assert log(100, 100) == whole and log(len(expected), len(whole)) == whole
    few = [line for key in expected[:3] for line in key] + [f"...还有 {len(expected) - 3} 条差异记录未显示..."]
    assert log(3, 100) == few
    assert log(3, 4) == few[:4] + [f"...（还有 {len(few) - 4} 条消息未显示）"]
    assert log(0, 100) == [f"...还有 {len(expected)} 条差异记录未显示..."]
    same = cmp.compare(a, a, [Rule("k", key=True), Rule("v"), Rule("w")])
    assert rep.capped_log(same).collect() == [] and rep.cap_details(same, 3).collect() == []


def test_capped_log_joins_once(spark, sf_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = cmp.compare(fx.orders_source(spark, sf_dir), fx.orders_target(spark, sf_dir), fx.ORDER_RULES)
        for out in (rep.capped_log(result, 20, 30), rep.cap_details(result, 20)):
            out.collect()
            final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert final.count("SortMergeJoin") == 1 and "ReusedExchange" in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_category_rule(frame):
    """A code the target uses is preferred; labels are shown as they were."""
    table = frame("name, code, big, detail, erp", [("pump", "1111a", "P", "x", "9999"), ("pump", "2222b", "P", "y", "2222c"), ("valve", "3333", "V", "z", "3333")])
    category = Category(table.withColumn("o", F.monotonically_increasing_id()), "name", "code", ("big", "detail"), "erp", ("o",))
    a = frame("k, 类", [("1", " pump "), ("2", "valve"), ("3", "pump"), ("4", "other"), ("5", None), ("6", "valve")])
    b = frame("k, 类", [("1", "P-y"), ("2", "V-z"), ("3", "3333x"), ("4", "othe"), ("5", " "), ("6", "33331")])
    result = cmp.compare(a, b, [Rule("k", key=True), Rule("类", comparator="category", category=category)])
    records = {(r.k, r.source_value, r.target_value) for r in rep.diff_records(result).collect()}
    assert records == {("3", "pump", "3333x"), ("4", "other", "othe")}
    assert not any(c.startswith(("src__code", "tgt__code")) for c in result.side_columns("src_") + result.side_columns("tgt_"))
    fan = Options(on_duplicates="fanout")
    rules = [Rule("k", key=True), Rule("类", comparator="category", category=category)]
    assert pair_summary(a, b, rules, fan).first().equal == counts(cmp.compare(a, b, rules, fan))["equal"] == 4
    with pytest.raises(ValueError, match="no mapping"):
        cmp.compare(a, b, [Rule("k", key=True), Rule("类", comparator="category")])


def test_gate_stops_on_columns_rows_keys(pair, spark):
    a, b = pair
    assert "source lacks t" in gate(a.drop("t"), b, RULES).stopped
    assert "target lacks num" in gate(a, b.drop("num"), RULES).stopped
    assert gate(a.limit(0), b, RULES).stopped == "source has no rows"
    assert gate(a, b, RULES[1:]).stopped == "no rule is marked as key"
    apart = b.withColumn("k", F.concat(F.lit("z"), "k"))
    assert gate(a, apart, RULES).stopped == "no common key"
    blank = gate(a, b.drop("num"), RULES, Options(on_missing_column="blank"))
    assert blank.stopped is None and "target lacks num, taken as blank" in blank.warnings


def test_gate_duplicates_and_blanks(frame):
    a = frame("k, v", [("1", "x"), ("1 ", "y"), (None, "z"), ("2", "z")])
    b = frame("k, v", [("1", "x"), ("2", "y")])
    rules = [Rule("k", key=True), Rule("v")]
    r = reconcile(a, b, rules)
    assert r.result is None and r.gate.stopped == "source has 2 rows with duplicate keys" and r.gate.examples == (("1",),)
    fan = reconcile(a, b, rules, Options(on_duplicates="fanout"))
    assert fan.gate.stopped is None and any("blank" in w for w in fan.gate.warnings)
    c = counts(fan.result)
    assert (c["common"], c["differing"], c["missing"], c["extra"]) == (3, 2, 1, 0)


def test_blank_keys_match_except_in_sql_mode(frame):
    a, b = frame("k, v", [(None, "1"), ("x", "1")]), frame("k, v", [("  ", "1"), ("x", "2")])
    rules = [Rule("k", key=True), Rule("v")]
    assert counts(cmp.compare(a, b, rules))["common"] == 2
    c = counts(cmp.compare(a, b, rules, Options().for_sql()))
    assert (c["common"], c["missing"], c["extra"], c["differing"]) == (1, 1, 1, 1)


def test_fanout_counts_copies_and_pairs(frame):
    a = frame("k, v", [("1", "x")] * 3 + [("1", "y"), ("2", "q")])
    b = frame("k, v", [("1", "x")] * 2 + [("3", "z")] * 4)
    for mode in (Options(on_duplicates="fanout"), Options(mode="sql", on_duplicates="fanout")):
        c = counts(cmp.compare(a, b, [Rule("k", key=True), Rule("v")], mode))
        assert (c["common"], c["differing"], c["missing"], c["extra"]) == (8, 2, 1, 4)


def test_integral_keys(frame):
    a, b = frame("k, v", [("12", "1")]), frame("k, v", [("12.0", "1")])
    rules = [Rule("k", key=True), Rule("v")]
    assert counts(cmp.compare(a, b, rules))["common"] == 0
    assert counts(cmp.compare(a, b, rules, Options(integral_keys=True)))["common"] == 1


def test_null_whole_number_keys_match(spark):
    a = spark.createDataFrame([(None, "x"), (1, "x")], "k long, v string")
    b = spark.createDataFrame([(None, "x"), (2, "x")], "k int, v string")
    assert counts(cmp.compare(a, b, [Rule("k", key=True), Rule("v")]))["common"] == 1
    assert [r.k for r in m.missing_rows(a, b, ["k"]).collect()] == [1]


def test_composite_key_with_separator_inside(frame):
    a = frame("p, q, v", [("a + b", "c", "1")])
    b = frame("p, q, v", [("a", "b + c", "1")])
    rules = [Rule("p", key=True), Rule("q", key=True), Rule("v")]
    c = counts(cmp.compare(a, b, rules))
    assert (c["common"], c["missing"], c["extra"]) == (0, 1, 1)


def test_name_clash_after_mapping(frame):
    # The target's own `x` gives way to the column the rule maps to x.
    a = frame("k, x", [("1", "right")])
    b = frame("k, x, y", [("1", "wrong", "right")])
    assert counts(cmp.compare(a, b, [Rule("k", key=True), Rule("x", "y")]))["differing"] == 0
    both = [Rule("k", key=True), Rule("x", "y"), Rule("y", "x")]
    c = counts(cmp.compare(a.withColumn("y", F.lit("wrong")), b, both))
    assert c["differing"] == 0


def test_calculated_key_and_field(frame):
    a = frame("k, total", [("AB1", "5"), ("AB2", "7")])
    b = frame("p, q, x, y", [("AB", "1", "2", "3"), ("AB", "2", "-3", "3")])
    rules = [Rule("k", calc="p+q", key=True), Rule("total", kind="number", calc="x+y")]
    r = reconcile(a, b, rules)
    assert counts(r.result)["differing"] == 1
    absolute = [rules[0], Rule("total", kind="number", calc="x-y", absolute=True)]
    assert [x.target_value for x in rep.diff_records(cmp.compare(a, b, absolute)).orderBy("k").collect()] == ["1.0", "6.0"]


def test_lookup_comparators(frame):
    a = frame("k, volt, combo, cat", [("1", "10kV", "A", "变压器"), ("2", "20kV", "B", "线路"), ("3", "", "", "9988")])
    b = frame("k, volt, combo, cat", [("1", "07", "A|B", "1255"), ("2", "07", "A|B", "3377"), ("3", None, " ", "99")])
    multimap = frame("key, value", [("A", "A|B"), ("B", "C")])
    rules = [
        Rule("k", key=True),
        Rule("volt", comparator="coded", lookup={"10kV": "07", "20kV": "08"}),
        Rule("combo", comparator="allowed", lookup=multimap),
        Rule("cat", comparator="prefix", lookup={"变压器": "1234", "线路": "2200"}, length=2),
    ]
    got = {(r.k, r.field, r.source_value) for r in rep.diff_records(cmp.compare(a, b, rules)).collect()}
    assert got == {("2", "volt", "20kV"), ("2", "combo", "B"), ("2", "cat", "线路")}
    shown = rep.annotate(cmp.compare(a, b, rules, keep_all=True)).columns
    assert not [c for c in shown if c.startswith("_")]


def test_unknown_comparator(pair):
    with pytest.raises(ValueError):
        cmp.compare(*pair, [RULES[0], Rule("t", "txt", comparator="soundex")])
    with pytest.raises(SchemaError):
        cmp.compare(*pair, [RULES[0], Rule("absent")])
    with pytest.raises(ValueError):
        cmp.compare(*pair, RULES[1:])


def test_compare_text_reports_missing_columns(frame):
    a = frame("* k, v, w", [("1", "None", "x")])
    b = frame("k , v", [("1", None)])
    result = cmp.compare_text(a, b, ["k"])
    assert counts(result)["missing_columns"] == "w"
    assert [(r.field, r.source_value, r.target_value) for r in rep.diff_records(result).collect()] == [("w", "x", "")]


def test_properties_on_orders(spark, sf_dir):
    a, b = fx.orders_source(spark, sf_dir), fx.orders_target(spark, sf_dir)
    c = counts(cmp.compare(a, b, fx.ORDER_RULES))
    assert c["missing"] + c["common"] == a.count() and c["extra"] + c["common"] == b.count()
    assert c["equal"] + c["differing"] == c["common"]
    same = [Rule(r.source, None, r.kind, r.tolerance, r.precision, r.key) for r in fx.ORDER_RULES]
    own = counts(cmp.compare(a, a, same))
    assert (own["missing"], own["extra"], own["differing"]) == (0, 0, 0)
    back = b.withColumnsRenamed(dict(zip(fx.TARGET_FIELDS, fx.ORDER_FIELDS)))
    swapped = counts(cmp.compare(back, a, same))
    assert (swapped["missing"], swapped["extra"], swapped["differing"]) == (c["extra"], c["missing"], c["differing"])


PAIR_RULES = [
    Rule("k", key=True),
    Rule("n", kind="number", tolerance=0.5),
    Rule("m", kind="number"),
    Rule("d", kind="date", precision="month"),
    Rule("t"),
    Rule("s", comparator="allowed", lookup={"a": "A", "b": "B"}),
    Rule("c", comparator="coded", lookup={"x": "1", "y": "2"}),
]


@pytest.mark.parametrize(
    "options",
    [
        Options(on_duplicates="fanout"),
        Options(on_duplicates="fanout", one_sided_null="ignore"),
        Options(on_duplicates="fanout", yes_no=False, date_mode="free"),
        Options(mode="sql", date_mode="sql", on_duplicates="fanout"),
    ],
)
def test_pair_summary_against_the_pairs(spark, options):
    rng = random.Random(11)

    def rows(texts, codes, count):
        return [
            (
                rng.choice(["hot", "hot ", "p", "q", None, " "]),
                rng.choice(["1", "1.5", "2.0", "-3", None, "x", "1.2"]),
                rng.choice(["7", "7.0", "8", None]),
                rng.choice(["2024-01-05", "2024/1/9", "20240205", "soon", None]),
                rng.choice(["是", "Y", "n", "N ", "否", None]),
                rng.choice(texts),
                rng.choice(codes),
            )
            for _ in range(count)
        ]

    schema = "k string, n string, m string, d string, t string, s string, c string"
    a = spark.createDataFrame(rows(["a", "b", "", None], ["x", "y", "1"], 120), schema)
    b = spark.createDataFrame(rows(["A", "B", "a", None], ["1", "2", " 1"], 90), schema)
    for n_rules in (2, 4, 7):
        rules = PAIR_RULES[:n_rules]
        want = counts(cmp.compare(a, b, rules, options))
        got = pair_summary(a, b, rules, options).first().asDict()
        for name in ("missing", "extra", "common", "differing", "equal"):
            assert got[name] == want[name], (name, n_rules)
        assert (got["total_source"], got["total_target"]) == (120, 90)


def test_pairs_of_a_hot_key_are_not_formed(spark):
    """10^5 rows on either side of one key: 10^10 pairs, of which those equal are counted from groups."""
    n = 100_000
    day = F.when(F.col("id") % 4 == 0, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 5 + 1).cast("string"), 2, "0")))
    side = spark.range(n).select(F.lit("k").alias("k"), day.alias("d"), F.when(F.col("id") % 3 > 0, F.col("id") % 10).cast("string").alias("n"))
    rules = [Rule("k", key=True), Rule("d", kind="date"), Rule("n", kind="number", tolerance=0.5)]
    options = Options(on_duplicates="fanout", one_sided_null="ignore", date_mode="sql")
    start = time.monotonic()
    got = pair_summary(side, side, rules, options).first()
    assert time.monotonic() - start < 30
    kinds = Counter((None if i % 4 == 0 else i % 5, i % 10 if i % 3 else None) for i in range(n))
    equal = sum(
        x * y
        for (d, v), x in kinds.items()
        for (e, w), y in kinds.items()
        if (d is None or e is None or d == e) and (v is None or w is None or v == w)
    )
    assert (got.common, got.equal, got.differing) == (n * n, equal, n * n - equal)
    plan = pair_summary(side, side, rules, options)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_a_repeated_key_stops_the_job(frame):
    from tablerecon.plans.compare import compare, compare_text

    a, b = frame("k, v", [("1", "x")] * 3), frame("k, v", [("1", "x"), ("2", "y")])
    rules = [Rule("k", key=True), Rule("v")]
    for left, right in ((a, b), (b, a)):
        with pytest.raises(Exception, match="a key repeats"):
            rep.field_counts(compare(left, right, rules)).collect()
        with pytest.raises(Exception, match="a key repeats"):
            rep.summarize(compare_text(left, right, ["k"])).collect()
    whole = [x.withColumn("k", F.col("k").cast("int")) for x in (b, b)]
    assert rep.summarize(compare(*whole, rules)).first().common == 2
    nulls = frame("k, v", [(None, "x"), (None, "y")]).withColumn("k", F.col("k").cast("int"))
    with pytest.raises(Exception, match="a key repeats"):
        rep.summarize(compare(nulls, whole[0], rules)).collect()


def test_nan_is_no_value(spark):
    from tablerecon.plans.compare import compare

    a = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, None), (2, float("nan"))], "k int, v double")
    got = rep.diff_records(compare(a, b, [Rule("k", key=True), Rule("v")])).collect()
    assert [(r.k, r.source_value, r.target_value) for r in got] == [(2, "1.0", "")]
