"""Columns, lookups, quality, shaping and ledgers on small fixtures; joins with hot keys."""

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablerecon.operators import columns as co
from tablerecon.operators import keyed
from tablerecon.operators import ledger as le
from tablerecon.operators import lookup as lo
from tablerecon.operators import quality as qu
from tablerecon.operators import shape as sh
from tablerecon.plans import match as m


def test_guards(frame):
    a, b = frame("x, y", [("1", None)]), frame("y, x", [])
    co.require_columns(a, ["x"], b, ["y"])
    with pytest.raises(co.SchemaError, match="source lacks z; target lacks w, v"):
        co.require_columns(a, ["x", "z"], b, ["w", "v"])
    with pytest.raises(co.SchemaError):
        co.require_same_schema(a, b)
    co.require_same_schema(a, a)
    co.require_rows(a)
    with pytest.raises(co.SchemaError):
        co.require_rows(b)
    co.require_some_value(a, ["x"])
    with pytest.raises(co.SchemaError, match="no value at all in y"):
        co.require_some_value(a, ["x", "y"])


def test_dedup_columns(spark):
    df = spark.sql("SELECT 1 AS k, 2 AS v, 3 AS k, 4 AS v, 5 AS c, 6 AS c")
    assert [list(r) for r in co.dedup_columns(df, ["k", "c"], calculated=["c"]).collect()] == [[1, 2, 4, 6]]


def test_merge_of_a_split_is_the_table(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    parts = [t.where(F.col("o_orderkey") % 3 == i) for i in range(3)]
    merged = sh.merge_tables(parts)
    assert merged.exceptAll(t).count() == 0 and merged.count() == t.count()
    cut = sh.split_by_rows(t, 100, ["o_orderkey"])
    sizes = {r.part: r["count"] for r in cut.groupBy("part").count().collect()}
    assert sizes == {i + 1: 100 for i in range(15)}


def test_equal_order_values_fill_several_ranges(spark):
    df = spark.range(20_000).repartition(8).select(F.lit(1).alias("same"), "id")
    numbered = sh.with_row_number(df, ["same"])
    assert numbered.select("row_no").distinct().count() == 20_000
    text = numbered._jdf.queryExecution().toString()
    # What one task adds up is a count per range, never rows.
    below = [part.splitlines()[1] for part in text.split("Exchange SinglePartition")[1:]]
    assert all("HashAggregate(keys=[_range" in line for line in below)


def test_merge_mixed_types(spark):
    out = sh.merge_tables([spark.sql("SELECT 1 AS a, 'x' AS b"), spark.sql("SELECT 'y' AS q")])
    assert out.columns == ["a", "b"] and {tuple(r) for r in out.collect()} == {("1", "x"), ("y", None)}


def test_row_numbers_have_no_gaps_on_equal_order_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    rows = sh.with_row_number(df, ["g"]).collect()
    assert sorted(r.row_no for r in rows) == list(range(1, 1001))
    by_no = [r.g for r in sorted(rows, key=lambda r: r.row_no)]
    assert by_no == sorted(by_no)
    assert sh.with_row_number(df.limit(0), ["g"]).count() == 0


def test_multimap_skips_headers_and_blanks(frame):
    rows = [("1", "平台代码", "x"), ("2", "A", "A|B"), ("3", "A", "B"), ("4", None, "C"), ("5", "D", " "), ("6", "P代码1", "C")]
    df = frame("n, a, b", rows)
    got = {tuple(r) for r in lo.build_multimap(df, "a", "b", header_words=("代码",), order="n").collect()}
    assert got == {("A", "A"), ("A", "B"), ("P代码1", "C")}
    got = {tuple(r) for r in lo.build_multimap(df.where("n > 1"), "a", "b", header_words=("代码",), order="n").collect()}
    assert got == {("A", "A"), ("A", "B"), ("P代码1", "C")}


def test_split_by_value_has_one_part_per_value(frame):
    values = ["a/b", "a:b", "a_b", "x" * 201, "x" * 200 + "y", "x" * 200, " "]
    got = {r.v: r.part for r in sh.split_by_value(frame("v", [(v,) for v in values]), "v").collect()}
    assert len(got) == len(set(got.values())) == 6 and got["a_b"] == "a_b" and all(len(p) <= 200 for p in got.values())


def test_sanitized_names_are_distinct():
    names = ["a b", "a_b", "A-B", "1", "", "y" * 70, "y" * 71]
    got = co.sanitize_names(names)
    assert got[0] == "a_b" and got[3:5] == ["col_1", "unnamed_column"] and got[5] == "y" * 64
    assert len({g.lower() for g in got}) == len(names) and max(map(len, got)) == 64


def test_map_values_first_match(frame, spark):
    mapping = spark.createDataFrame([("x", "2", 2), ("x", "1", 1), (None, "9", 0)], "key string, value string, ord int")
    df = frame("v", [(" x ",), ("y",), (None,)])
    assert [r.v for r in lo.map_values(df, "v", mapping, order=["ord"]).collect()] == ["1", "y", None]
    assert [r.v for r in lo.map_values(df, "v", mapping, order=["ord"], keep_unmatched=False).collect()] == ["1", None, None]


def test_apply_updates_sets_nulls_too(frame):
    df = frame("k, v", [("1", "a"), ("2", "b")])
    upd = frame("k, v, o", [("1", "early", "1"), ("1", None, "2")])
    got = {tuple(r) for r in lo.apply_updates(df, upd, ["k"], ["v"], ["o"]).collect()}
    assert got == {("1", None), ("2", "b")}


def test_reciprocal_totals_text_parties(frame):
    df = frame("own, peer, amount", [("A", "b", "0.10"), ("A", "b", "0.20"), ("b", "A", "1"), ("A", None, "5"), ("c", "d", "x")])
    got = {tuple(str(v) for v in r) for r in le.reciprocal_totals(df, "own", "peer", ["amount"]).collect()}
    assert got == {
        ("A", "b", "0.30", "b", "A", "1.00"), ("b", "A", "1.00", "A", "b", "0.30"), ("c", "d", "None", "0", "0", "0.00")}


# --- hot keys -------------------------------------------------------------------------------------------------------


@pytest.fixture
def shuffled_joins(spark):
    """No side counts as small: every keyed join takes its shuffle path."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def split_joins(spark, shuffled_joins):
    """Partitions of a few KB already count as skewed."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "50",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """A third of all rows share one key, another third has none."""
    n = 30_000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id") % 500)
    left = spark.range(n).repartition(8).select("id", key.alias("k"))
    right = spark.range(0, 400).select(F.col("id").alias("rk"), (F.col("id") * 10).alias("v"))
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_keys_are_split_by_adaptive_execution(spark, hot, shuffled_joins, how):
    left, right = hot
    grouped = right.groupBy("rk").agg(F.max("v").alias("v")) if how in ("left", "inner") else right
    plain = left.join(grouped, F.col("k") == F.col("rk"), how).drop("rk")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "50",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = keyed.attach(left.where("k is not null"), grouped, [("k", "rk")], how)
        rows = out.collect()
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in text and "Broadcast" not in text
        assert Counter(rows) == Counter(plain.where("k is not null").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_keys_of_other_types(spark, hot, shuffled_joins):
    left, right = hot
    for kind in ("int", "decimal(12,2)", "string"):
        other = right.withColumn("rk", F.col("rk").cast(kind))
        plain = left.join(other, F.col("k") == F.col("rk"), "left").drop("rk")
        assert Counter(keyed.attach(left, other, [("k", "rk")]).collect()) == Counter(plain.collect())


def test_building_a_plan_starts_no_job(spark, sf_dir, shuffled_joins):
    from tablerecon.workload import QUERIES

    tracker = spark.sparkContext.statusTracker()
    for name in ("map_values_preferring", "coded_match", "sql_mode_fanout", "comparator_allowed", "not_found", "flag_exists"):
        spark.sparkContext.setJobGroup(f"plan-{name}", name)
        frame = QUERIES[name](spark, sf_dir)
        # Reading a table's schema is a job of its own.
        plans = [j for j in tracker.getJobIdsForGroup(f"plan-{name}") if len(tracker.getJobInfo(j).stageIds) > 1]
        assert frame is not None and not plans, name
    spark.sparkContext.setJobGroup("tests", "tests")


def test_membership_against_brute_force(spark, shuffled_joins):
    rng = random.Random(5)
    a = [(i, rng.choice([1, 1, 1, 2, 3, None, rng.randrange(50)])) for i in range(3000)]
    b = [(rng.choice([1, 4, 9, None, rng.randrange(50)]),) for _ in range(200)]
    left, right = spark.createDataFrame(a, "i int, k int"), spark.createDataFrame(b, "r int")
    known = {r for (r,) in b if r is not None}
    flagged = {(r.i, r.found) for r in lo.flag_exists(left, right, [("k", "r")]).collect()}
    assert flagged == {(i, k in known) for i, k in a}
    assert {r.i for r in lo.not_found(left, right, [("k", "r")]).collect()} == {i for i, k in a if k not in known}
    assert {r.i for r in lo.keep_known(left, right, [("k", "r")]).collect()} == {i for i, k in a if k in known}


def test_dedup_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", " h ot", "x", None, str(rng.randrange(20))]), i) for i in range(2000)]
    rng.shuffle(rows)
    first: dict = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        first.setdefault((k or "").replace(" ", ""), i)
    df = spark.createDataFrame(rows, "k string, i int").repartition(8)
    assert {tuple(r) for r in qu.dedup_keep_first(df, ["k"], ["i"]).collect()} == set(first.items())
    removed = qu.dedup_removed(df, ["k"]).first()
    assert (removed.kept, removed.removed) == (len(first), 2000 - len(first))


# --- plans ----------------------------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_shrinks_groups_before_the_shuffle(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(qu.dedup_keep_first(lines, ["l_orderkey"], ["l_shipdate"]))
    assert "WindowGroupLimit" in text.split("Exchange")[1]


def test_summary_plan(spark, sf_dir):
    from tablerecon.workload import QUERIES

    text = plan(QUERIES["orders_summary"](spark, sf_dir))
    assert "SortMergeJoin" in text and "FullOuter" in text
    for unwanted in ("NestedLoop", "Cartesian", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in text
    assert text.count("Exchange hashpartitioning") == 2
    assert "o_custkey" not in text  # column without a rule: never read


def test_no_query_uses_cross_joins_or_python(spark, sf_dir, shuffled_joins):
    from tablerecon.workload import QUERIES

    # Python reads the files that Spark's own readers cannot.
    reading = {"csv_mixed_encodings", "csv_catalogue", "workbooks_read", "workbooks_two_level_header", "workbooks_catalogue"}
    for name in sorted(set(QUERIES) - {"generate_like"} - reading):
        text = plan(QUERIES[name](spark, sf_dir))
        for unwanted in ("NestedLoop", "Cartesian", "EvalPython", "MapInArrow", "MapInPandas"):
            assert unwanted not in text, name


def test_scan_reads_only_rule_columns(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(m.missing_rows(lines.select("l_orderkey", "l_linenumber"), lines.where("l_quantity > 10"), ["l_orderkey"]))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text and "l_comment" not in text
    assert "l_extendedprice" not in text


def test_bucketed_tables_are_not_shuffled(spark, sf_dir, tmp_path):
    from tablerecon.plans.compare import compare
    from tablerecon.plans.report import summarize
    from tablerecon.plans.rules import Rule

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    for name in ("left_orders", "right_orders"):
        writer = orders.write.mode("overwrite").bucketBy(4, "o_orderkey").option("path", str(tmp_path / name))
        writer.saveAsTable(name)
    rules = [Rule("o_orderkey", key=True), Rule("o_totalprice", kind="number")]
    a, b = spark.table("left_orders"), spark.table("right_orders")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = compare(a, b, rules, keys_complete=True)
        assert "Exchange hashpartitioning" not in plan(summarize(result))
        assert summarize(result).first().equal == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE left_orders")
        spark.sql("DROP TABLE right_orders")


def test_keys_of_unlike_types(spark):
    kinds = {
        "string": ["1", "2.0", "x", None], "bigint": [1, 2, 3, None], "int": [1, 2, 3, None], "double": [1.0, 2.5, float("nan"), None],
        "decimal(10,2)": [Decimal("1.00"), Decimal("2.50"), Decimal("7.00"), None], "boolean": [True, False, None], "date": [datetime.date(2024, 1, 5), None],
        "timestamp_ntz": [datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 5, 1), None],
    }
    def pairs(a, b):
        left = spark.createDataFrame([(x,) for x in kinds[a]], f"k {a}")
        right = spark.createDataFrame([(x,) for x in kinds[b]], f"k {b}")
        out = {str(r.k) for r in lo.flag_exists(left, right, "k").where("found").collect()}
        assert out == {str(r.k) for r in lo.keep_known(left, right, "k").collect()}
        return out

    assert pairs("bigint", "string") == {"1"} and pairs("string", "bigint") == {"1"}
    assert pairs("int", "bigint") == {"1", "2", "3"} and pairs("double", "bigint") == {"1.0"}
    assert pairs("string", "double") == {"1"} and pairs("decimal(10,2)", "double") == {"1.00", "2.50"}
    assert pairs("decimal(10,2)", "int") == {"1.00"} and pairs("date", "timestamp_ntz") == {"2024-01-05"}
    assert pairs("boolean", "boolean") == {"True", "False"} and pairs("string", "date") == set()


def test_hot_keys_of_unlike_types_are_split(spark, split_joins):
    big = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    small = spark.range(0, 60_000, 3).select(F.col("id").cast("string").alias("t"))
    for run in (lambda: lo.flag_exists(big, small, [("k", "t")]), lambda: lo.lookup_left(big, small.withColumn("w", F.lit(1)), [("k", "t")], ["w"], ["w"])):
        out = run()
        rows = out.collect()
        assert len(rows) == 60_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    updates = small.select(F.col("t").alias("k"), F.lit("new").alias("v"))
    out = lo.apply_updates(big, updates, ["k"], ["v"])
    assert sum(r.v == "new" for r in out.collect()) == big.where("k % 3 = 0").count()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_names_with_dots(frame):
    from tablerecon.plans.compare import compare
    from tablerecon.plans.report import annotate, diff_records, field_counts, summarize
    from tablerecon.plans.rules import Options, Rule

    a, b = frame("k.1, v.x", [("1", "a"), ("2", "b")]), frame("k.1, v.x", [("1", "a"), ("2", "c")])
    rules = [Rule("k.1", key=True), Rule("v.x")]
    for options in (Options(), Options(on_duplicates="fanout")):
        result = compare(a, b, rules, options)
        assert summarize(result).first().differing == 1
        assert diff_records(result).first().asDict() == {"k.1": "2", "field": "v.x", "source_value": "b", "target_value": "c"}
        assert field_counts(result).first().differing == 1
        assert annotate(result).count() == 2
