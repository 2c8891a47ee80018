"""Reconciliation inputs made from the test tables, for Spark and for SQL.

The target is a copy of ``orders`` (or of ``lineitem`` reduced to one row per
key) with known disturbances, from integer arithmetic on the key only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.operators.quality import dedup_keep_first
from tablerecon.plans.rules import Rule

EXTRA_SHIFT = 100_000_000

# Spellings of a date in the target, picked by key % 6.
DATE_SPELLINGS = ["yyyy-M-d", "yyyy/MM/dd", "yyyyMMdd", "MM-dd-yyyy", "MM/dd/yyyy", "yyyy年M月d日", "M-d-yyyy", "M/d/yyyy"]
SQL_SPELLINGS = ["%Y-%-m-%-d", "%Y/%m/%d", "%Y%m%d", "%m-%d-%Y", "%m/%d/%Y", "%Y年%-m月%-d日"]

ORDER_FIELDS = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"]
TARGET_FIELDS = ["key", "price", "order_dt", "priority", "status"]

ORDER_RULES = [
    Rule("o_orderkey", "key", key=True),
    Rule("o_totalprice", "price", "number", tolerance=0.01),
    Rule("o_orderdate", "order_dt", "date", precision="month"),
    Rule("o_orderpriority", "priority"),
    Rule("o_orderstatus", "status"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(18,3)").alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "O", "是").otherwise("否").alias("o_orderstatus"),
    )


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,3)")
    price = (
        F.when(k % 17 == 0, price + F.lit(5))
        .when(k % 13 == 0, price + F.lit(0.004).cast("decimal(18,3)"))
        .otherwise(price)
    ).cast("decimal(18,3)")
    days = F.when(k % 37 == 0, 40).when(k % 31 == 0, 1).otherwise(0)
    o = o.withColumn("_day", F.date_add(F.to_date("o_orderdate"), days))
    spelled = F.date_format("_day", DATE_SPELLINGS[0])
    for i, pattern in enumerate(DATE_SPELLINGS[1:], 1):
        spelled = F.when(k % 6 == i, F.date_format("_day", pattern)).otherwise(spelled)
    p = F.col("o_orderpriority")
    priority = (
        F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, "  ").when(k % 29 == 0, F.concat(F.lit("  "), p, F.lit(" ")))
    ).otherwise(p)
    made = o.where(k % 97 != 0).select(
        k.alias("key"),
        price.alias("price"),
        spelled.alias("order_dt"),
        priority.alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "Y").otherwise("N").alias("status"),
    )
    # One scan: a row to be copied is exploded into itself and its copy.
    shift = F.when(F.col("key") % 89 == 0, F.array(F.lit(0), F.lit(EXTRA_SHIFT))).otherwise(F.array(F.lit(0)))
    return made.withColumn("_shift", F.explode(shift)).withColumn("key", F.col("key") + F.col("_shift")).drop("_shift")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, the way sheets and CSV files arrive."""
    dates = {f.name for f in df.schema.fields if f.dataType.typeName().startswith("timestamp")}
    return df.select(
        *[(F.date_format(c, "yyyy-MM-dd") if c in dates else F.col(c).cast("string")).alias(c) for c in df.columns]
    )


def _spelled(day: str) -> str:
    cases = " ".join(f"WHEN k % 6 = {i} THEN strftime({day}, '{f}')" for i, f in enumerate(SQL_SPELLINGS))
    return f"CASE {cases} END"


ORDERS_SQL = f"""
a AS (
  SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,3)) AS o_totalprice, o_orderdate, o_orderpriority,
         CASE WHEN o_orderstatus = 'O' THEN '是' ELSE '否' END AS o_orderstatus
  FROM orders),
shifted AS (
  SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,3)) AS p0, o_orderpriority AS r0, o_orderstatus AS s0,
         CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 37 = 0 THEN 40 WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS d0
  FROM orders WHERE o_orderkey % 97 <> 0),
kept AS (
  SELECT k AS key,
         CAST(CASE WHEN k % 17 = 0 THEN p0 + 5 WHEN k % 13 = 0 THEN p0 + 0.004 ELSE p0 END AS DECIMAL(18,3)) AS price,
         {_spelled('d0')} AS order_dt,
         CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '  ' WHEN k % 29 = 0 THEN '  ' || r0 || ' ' ELSE r0 END AS priority,
         CASE WHEN s0 = 'O' THEN 'Y' ELSE 'N' END AS status
  FROM shifted),
b AS (
  SELECT * FROM kept UNION ALL
  SELECT key + {EXTRA_SHIFT} AS key, price, order_dt, priority, status FROM kept WHERE key % 89 = 0)
"""

LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_RULES = [
    Rule("l_orderkey", key=True),
    Rule("l_linenumber", key=True),
    Rule("l_quantity", kind="number", tolerance=0.01),
    Rule("l_extendedprice", kind="number", tolerance=0.01),
    Rule("l_returnflag"),
    Rule("l_shipdate", kind="date", precision="month"),
]


def lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with one row per (order, line number)."""
    return dedup_keep_first(table(spark, sf_dir, "lineitem"), LINE_KEYS, LINE_ORDER)


def lines_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_source(spark, sf_dir)
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    quantity = F.when(n % 17 == 0, F.col("l_quantity") + 1.0).otherwise(F.col("l_quantity"))
    flag = F.when(n % 29 == 0, F.concat(F.lit(" "), "l_returnflag")).when(n % 31 == 0, F.lit("Z"))
    shipped = F.when(n % 37 == 0, F.to_date("l_shipdate") + F.expr("INTERVAL 40 DAYS")).otherwise(F.to_date("l_shipdate"))
    return lines.where(n % 97 != 0).withColumns(
        {
            "l_quantity": quantity,
            "l_returnflag": flag.otherwise(F.col("l_returnflag")),
            "l_shipdate": F.date_format(shipped, "yyyy/M/d"),
        }
    )


LINES_SQL = f"""
a AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY {', '.join(LINE_KEYS)} ORDER BY {', '.join(LINE_ORDER)}) = 1),
b AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice,
         CASE WHEN n % 17 = 0 THEN l_quantity + 1.0::DOUBLE ELSE l_quantity END AS l_quantity,
         CASE WHEN n % 29 = 0 THEN ' ' || l_returnflag WHEN n % 31 = 0 THEN 'Z' ELSE l_returnflag END AS l_returnflag,
         strftime(CAST(l_shipdate AS DATE) + CASE WHEN n % 37 = 0 THEN 40 ELSE 0 END, '%Y/%-m/%-d') AS l_shipdate
  FROM (SELECT *, l_orderkey * 7 + l_linenumber AS n FROM a) WHERE n % 97 <> 0)
"""
