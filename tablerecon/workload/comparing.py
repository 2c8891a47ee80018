"""Queries over whole reconciliations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.plans import compare as cmp
from tablerecon.plans import match as m
from tablerecon.plans import pairs as prs
from tablerecon.plans import reconcile as rec
from tablerecon.plans import report as rep
from tablerecon.plans.rules import Options, Rule
from tablerecon.workload import fixtures as fx
from tablerecon.workload import sqltext as sq
from tablerecon.workload.registry import query

ASCII_LABELS = rep.Labels(
    equal="equal", differs="differs", not_in_target="not in target", not_in_source="not in source",
    status="status", source="source", target="target", field="field", more="{} more",
    pair_source="a_", pair_target="b_", more_lines="{} more lines", key="key ",
)


def orders(spark: SparkSession, sf: str, options: Options = Options(), rules=None, keep_all=False) -> cmp.Comparison:
    a, b = fx.orders_source(spark, sf), fx.orders_target(spark, sf)
    return cmp.compare(a, b, rules or fx.ORDER_RULES, options, keep_all)


def orders_text(spark: SparkSession, sf: str, options: Options = Options(), rules=None) -> cmp.Comparison:
    a, b = fx.as_text(fx.orders_source(spark, sf)), fx.as_text(fx.orders_target(spark, sf))
    return cmp.compare(a, b, rules or fx.ORDER_RULES, options)


DATE_A = "strftime(o_orderdate, '%Y-%m-%d')"
PRICE_D = sq.num_differs("o_totalprice", "price", "0.01")
DATE_D = f"(left({DATE_A}, 7) <> left({sq.ladder('order_dt')}, 7))"
PRIORITY_D = sq.text_differs("o_orderpriority", "priority")
STATUS_D = sq.text_differs("o_orderstatus", "status")


def marked(
    price: str = PRICE_D, date: str = DATE_D, priority: str = PRIORITY_D, status: str = STATUS_D, on: str = "o_orderkey = key"
) -> str:
    """CTEs ``j`` (full join with one mark per field) over the two orders tables."""
    both = "o_orderkey IS NOT NULL AND key IS NOT NULL"
    return f"""WITH {fx.ORDERS_SQL}, j AS (
      SELECT *, coalesce(o_orderkey, key) AS k, o_orderkey IS NOT NULL AS in_a, key IS NOT NULL AS in_b,
        coalesce({both} AND {price}, false) AS d_price, coalesce({both} AND {date}, false) AS d_date,
        coalesce({both} AND {priority}, false) AS d_priority, coalesce({both} AND {status}, false) AS d_status
      FROM a FULL JOIN b ON {on}),
    r AS (SELECT *, d_price OR d_date OR d_priority OR d_status AS d FROM j)"""


COUNTS = """
 SELECT '{keys}' AS primary_key, count_if(in_a) AS total_source, count_if(in_b) AS total_target,
   count_if(in_a AND NOT in_b) AS missing, count_if(in_b AND NOT in_a) AS extra, count_if(in_a AND in_b) AS common,
   count_if(d) AS differing, count_if(in_a AND in_b) - count_if(d) AS equal,
   round(CASE WHEN count_if(in_a AND in_b) > 0 THEN count_if(d)::DOUBLE / count_if(in_a AND in_b) ELSE 0 END, 6) AS diff_ratio,
   count_if(in_a) <> count_if(in_b) AS row_counts_differ, '{missing}' AS missing_columns FROM r"""
ORDER_COUNTS = COUNTS.format(keys="o_orderkey", missing="")

# One row per difference: field number, values as shown, mark.
FIELDS = [
    ("o_totalprice", "CAST(o_totalprice AS VARCHAR)", "CAST(price AS VARCHAR)", "d_price"),
    ("o_orderdate", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", sq.norm("order_dt"), "d_date"),
    ("o_orderpriority", sq.norm("o_orderpriority"), sq.norm("priority"), "d_priority"),
    ("o_orderstatus", sq.norm("o_orderstatus"), sq.norm("status"), "d_status"),
]
RECORDS = " UNION ALL ".join(
    f"SELECT k AS o_orderkey, '{f}' AS field, {a} AS source_value, {b} AS target_value FROM r WHERE {d}"
    for f, a, b, d in FIELDS
)


def detail_sql(a: str, b: str, d: str) -> str:
    return f"CASE WHEN {d} THEN 'differs：source=' || {a} || ', target=' || {b} ELSE '' END"


DETAILS = {f: detail_sql(a, b, d) for f, a, b, d in FIELDS}
STATUS = """CASE WHEN NOT in_b THEN 'not in target' WHEN NOT in_a THEN 'not in source'
  WHEN d THEN 'differs' ELSE 'equal' END"""


@query("orders_summary", marked() + ORDER_COUNTS)
def _(spark, sf):
    return rep.summarize(orders(spark, sf))


@query("orders_text_summary", marked() + ORDER_COUNTS)
def _(spark, sf):
    return rep.summarize(orders_text(spark, sf))


@query(
    "orders_field_counts",
    marked() + " " + " UNION ALL ".join(f"SELECT '{f}' AS field, count_if({d}) AS differing FROM r" for f, _, _, d in FIELDS),
)
def _(spark, sf):
    return rep.field_counts(orders(spark, sf))


@query("orders_diff_records", marked() + RECORDS)
def _(spark, sf):
    return rep.diff_records(orders(spark, sf))


@query(
    "orders_diff_pairs",
    marked() + f""" SELECT k AS o_orderkey, o_totalprice AS source_price, price AS target_price,
      {DATE_A} AS source_date, order_dt AS target_date, o_orderpriority AS source_priority, priority AS target_priority,
      1::BIGINT AS pairs FROM r WHERE d""",
)
def _(spark, sf):
    pairs = rep.diff_pairs(orders(spark, sf))
    return pairs.select(
        "o_orderkey",
        F.col("source.o_totalprice").alias("source_price"),
        F.col("target.o_totalprice").alias("target_price"),
        F.date_format("source.o_orderdate", "yyyy-MM-dd").alias("source_date"),
        F.col("target.o_orderdate").alias("target_date"),
        F.col("source.o_orderpriority").alias("source_priority"),
        F.col("target.o_orderpriority").alias("target_priority"),
        "pairs",
    )


@query(
    "orders_diff_mask",
    marked() + """ SELECT k AS o_orderkey, d_price AS o_totalprice, d_date AS o_orderdate,
      d_priority AS o_orderpriority, d_status AS o_orderstatus FROM r WHERE d""",
)
def _(spark, sf):
    return rep.diff_mask(orders(spark, sf))


@query(
    "orders_side_by_side",
    marked() + f""" SELECT o_orderkey AS a_o_orderkey, o_totalprice AS a_o_totalprice, {DATE_A} AS a_o_orderdate,
      o_orderpriority AS a_o_orderpriority, o_orderstatus AS a_o_orderstatus, key AS b_o_orderkey, price AS b_o_totalprice,
      order_dt AS b_o_orderdate, priority AS b_o_orderpriority, status AS b_o_orderstatus FROM r WHERE d""",
)
def _(spark, sf):
    rows = rep.side_by_side(orders(spark, sf), ASCII_LABELS)
    return rows.withColumn("a_o_orderdate", F.date_format("a_o_orderdate", "yyyy-MM-dd"))


@query("orders_status_source", marked() + f" SELECT k AS o_orderkey, {STATUS} AS status FROM r WHERE in_a")
def _(spark, sf):
    return rep.status(orders(spark, sf), "source", ASCII_LABELS)


@query("orders_status_target", marked() + f" SELECT k AS o_orderkey, {STATUS} AS status FROM r WHERE in_b")
def _(spark, sf):
    return rep.status(orders(spark, sf), "target", ASCII_LABELS)


@query(
    "orders_detail_columns",
    marked() + " SELECT k AS o_orderkey, " + ", ".join(f"{e} AS {f}" for f, e in DETAILS.items()) + " FROM r WHERE in_a",
)
def _(spark, sf):
    return rep.detail_columns(orders(spark, sf), "source", ASCII_LABELS)


@query(
    "orders_annotate_target",
    marked() + f""" SELECT key AS o_orderkey, price AS o_totalprice, order_dt AS o_orderdate, priority AS o_orderpriority,
      status AS o_orderstatus, {STATUS} AS status, """
    + ", ".join(f"{e} AS {f}_status" for f, e in DETAILS.items()) + " FROM r WHERE in_b",
)
def _(spark, sf):
    return rep.annotate(orders(spark, sf, keep_all=True), "target", ASCII_LABELS)


@query(
    "orders_log_lines",
    marked() + f""" SELECT CAST(o_orderkey AS VARCHAR) AS display_key, field,
      ' - field [' || field || '] differs：source=' || source_value || ', target=' || target_value AS line FROM ({RECORDS})""",
)
def _(spark, sf):
    return rep.log_lines(orders(spark, sf), ASCII_LABELS)


@query(
    "orders_cap_details",
    marked() + """ SELECT * FROM (SELECT 0 AS is_note, CAST(k AS VARCHAR) AS line FROM r WHERE d ORDER BY k LIMIT 100)
      UNION ALL SELECT 1, CAST(count(*) - 100 AS VARCHAR) || ' more' FROM r WHERE d HAVING count(*) > 100""",
)
def _(spark, sf):
    return rep.cap_details(orders(spark, sf), 100, ASCII_LABELS)


def capped_log_sql(max_keys: int, max_lines: int) -> str:
    """The log with its caps and notes, from all records."""
    order = ", ".join(f"'{f}'" for f, *_ in FIELDS)
    return f""", rec AS ({RECORDS}), ranked AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_orderkey FROM rec)),
      lines AS (SELECT n, 0 AS f, 'key ' || k AS line FROM ranked WHERE n <= {max_keys}
        UNION ALL SELECT n, list_position([{order}], field), ' - field [' || field || '] differs：source=' || source_value || ', target=' || target_value
          FROM rec JOIN ranked ON k = o_orderkey WHERE n <= {max_keys}
        UNION ALL SELECT {max_keys} + 1, 0, CAST(count(*) - {max_keys} AS VARCHAR) || ' more' FROM ranked HAVING count(*) > {max_keys}),
      numbered AS (SELECT row_number() OVER (ORDER BY n, f) AS line_no, line FROM lines)
    SELECT CAST(line_no AS INTEGER) AS line_no, line FROM numbered WHERE line_no <= {max_lines}
      UNION ALL SELECT {max_lines} + 1, CAST(count(*) - {max_lines} AS VARCHAR) || ' more lines' FROM numbered HAVING count(*) > {max_lines}"""


@query("orders_capped_log", marked() + capped_log_sql(500, 700))
def _(spark, sf):
    return rep.capped_log(orders(spark, sf), 500, 700, ASCII_LABELS)


@query("orders_capped_log_keys", marked() + capped_log_sql(100, 5000))
def _(spark, sf):
    return rep.capped_log(orders(spark, sf), 100, 5000, ASCII_LABELS)


@query("orders_preview_missing", marked() + " SELECT k AS o_orderkey, o_totalprice FROM r WHERE NOT in_b ORDER BY k LIMIT 5")
def _(spark, sf):
    return rep.preview(orders(spark, sf).missing(), ["o_orderkey"], 5).select("o_orderkey", "o_totalprice")


@query(
    "orders_report_sections",
    marked() + """ SELECT CASE WHEN NOT in_b THEN 'missing' WHEN NOT in_a THEN 'extra' ELSE 'differing' END AS section,
      count(*) AS n_rows, count(o_totalprice) AS source_rows, count_if(d_price) AS price_differs
      FROM r WHERE d OR NOT in_a OR NOT in_b GROUP BY 1""",
)
def _(spark, sf):
    return rep.report_rows(orders(spark, sf)).groupBy("section").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("src_o_totalprice").alias("source_rows"),
        F.count_if("differs_o_totalprice").alias("price_differs"),
    )


# --- matching -------------------------------------------------------------------------------------------------------


def _target(spark, sf) -> DataFrame:
    return fx.orders_target(spark, sf).withColumnsRenamed(dict(zip(fx.TARGET_FIELDS, fx.ORDER_FIELDS)))


@query(
    "match_one_pass",
    marked() + " SELECT k AS o_orderkey, in_a, in_b, o_totalprice AS source_price, price AS target_price FROM r",
)
def _(spark, sf):
    out = m.match(fx.orders_source(spark, sf), _target(spark, sf), ["o_orderkey"])
    return out.select(
        F.col("_key_0").alias("o_orderkey"), F.col("_in_src").alias("in_a"), F.col("_in_tgt").alias("in_b"),
        F.col("src_o_totalprice").alias("source_price"), F.col("tgt_o_totalprice").alias("target_price"),
    )


@query(
    "common_rows",
    f"WITH {fx.ORDERS_SQL} SELECT o_orderkey, o_totalprice AS source_price, price AS target_price FROM a JOIN b ON o_orderkey = key",
)
def _(spark, sf):
    out = m.common_rows(fx.orders_source(spark, sf), _target(spark, sf), ["o_orderkey"])
    return out.select(
        F.col("_key_0").alias("o_orderkey"),
        F.col("src_o_totalprice").alias("source_price"),
        F.col("tgt_o_totalprice").alias("target_price"),
    )


@query(
    "missing_rows",
    f"WITH {fx.ORDERS_SQL} SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM a WHERE o_orderkey NOT IN (SELECT key FROM b)",
)
def _(spark, sf):
    return m.missing_rows(fx.orders_source(spark, sf), _target(spark, sf), ["o_orderkey"]).drop("o_orderdate")


@query(
    "extra_rows",
    f"""WITH {fx.ORDERS_SQL} SELECT key AS o_orderkey, price AS o_totalprice, order_dt AS o_orderdate,
      priority AS o_orderpriority, status AS o_orderstatus FROM b WHERE key NOT IN (SELECT o_orderkey FROM a)""",
)
def _(spark, sf):
    return m.extra_rows(fx.orders_source(spark, sf), _target(spark, sf), ["o_orderkey"])


@query(
    "missing_rows_text_key",
    f"""WITH {fx.ORDERS_SQL} SELECT o_orderkey, o_orderpriority FROM a
      WHERE o_orderpriority NOT IN (SELECT {sq.norm('priority')} || CASE WHEN {sq.norm('priority')} LIKE '%-%O%' THEN '~' ELSE '' END FROM b)""",
)
def _(spark, sf):
    # The whole target, in which some priorities are spelled as the source never does.
    b = _target(spark, sf)
    odd = F.concat(F.trim("o_orderpriority"), F.lit("~"))
    b = b.withColumn("o_orderpriority", F.when(F.col("o_orderpriority").like("%-%O%"), odd).otherwise(F.col("o_orderpriority")))
    return m.missing_rows(fx.orders_source(spark, sf), b, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query(
    "key_sets",
    f"""WITH {fx.ORDERS_SQL} SELECT coalesce(o_orderkey, key) AS o_orderkey, CASE WHEN key IS NULL THEN 'missing'
      WHEN o_orderkey IS NULL THEN 'extra' ELSE 'common' END AS key_set FROM a FULL JOIN b ON o_orderkey = key""",
)
def _(spark, sf):
    return m.key_sets(fx.orders_source(spark, sf), _target(spark, sf), ["o_orderkey"])


@query(
    "key_lists",
    f"""WITH {fx.LINES_SQL} SELECT CASE WHEN b.l_orderkey IS NULL THEN 'missing' WHEN a.l_orderkey IS NULL THEN 'extra'
        ELSE 'common' END AS key_set,
      coalesce(a.l_orderkey, b.l_orderkey) || ' + ' || coalesce(a.l_linenumber, b.l_linenumber) AS display_key
      FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
)
def _(spark, sf):
    return m.key_lists(fx.lines_source(spark, sf), fx.lines_target(spark, sf), fx.LINE_KEYS)


# --- composite key --------------------------------------------------------------------------------------------------

LINES_MARKED = f"""WITH {fx.LINES_SQL}, r AS (
  SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k1, coalesce(a.l_linenumber, b.l_linenumber) AS k2,
    a.l_orderkey IS NOT NULL AS in_a, b.l_orderkey IS NOT NULL AS in_b,
    coalesce(a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL AND (
      {sq.num_differs('a.l_quantity', 'b.l_quantity', '0.01::DOUBLE')}
      OR {sq.num_differs('a.l_extendedprice', 'b.l_extendedprice', '0.01::DOUBLE')}
      OR {sq.text_differs('a.l_returnflag', 'b.l_returnflag')}
      OR left(strftime(a.l_shipdate, '%Y-%m-%d'), 7) <> left({sq.ladder('b.l_shipdate')}, 7)), false) AS d
  FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)"""


@query("lines_summary", LINES_MARKED + COUNTS.format(keys="l_orderkey + l_linenumber", missing=""))
def _(spark, sf):
    return rep.summarize(cmp.compare(fx.lines_source(spark, sf), fx.lines_target(spark, sf), fx.LINE_RULES))


@query("lines_status", LINES_MARKED + f" SELECT k1 AS l_orderkey, k2 AS l_linenumber, {STATUS} AS status FROM r WHERE in_a")
def _(spark, sf):
    result = cmp.compare(fx.lines_source(spark, sf), fx.lines_target(spark, sf), fx.LINE_RULES)
    return rep.status(result, "source", ASCII_LABELS)


# --- options --------------------------------------------------------------------------------------------------------

NULL_PRICE = "CASE WHEN key % 7 = 0 THEN NULL ELSE price END"


def _null_prices(spark, sf) -> DataFrame:
    b = fx.orders_target(spark, sf)
    return b.withColumn("price", F.when(F.col("key") % 7 != 0, F.col("price")))


@query("option_one_sided_null_differs", marked(price=sq.num_differs("o_totalprice", f"({NULL_PRICE})", "0.01")) + ORDER_COUNTS)
def _(spark, sf):
    return rep.summarize(cmp.compare(fx.orders_source(spark, sf), _null_prices(spark, sf), fx.ORDER_RULES))


@query(
    "option_one_sided_null_ignored",
    marked(price=sq.num_differs("o_totalprice", f"({NULL_PRICE})", "0.01", True)) + ORDER_COUNTS,
)
def _(spark, sf):
    options = Options(one_sided_null="ignore")
    return rep.summarize(cmp.compare(fx.orders_source(spark, sf), _null_prices(spark, sf), fx.ORDER_RULES, options))


@query("option_no_tolerance", marked(price=sq.num_differs("o_totalprice", "price")) + ORDER_COUNTS)
def _(spark, sf):
    rules = [replace(r, tolerance=None) for r in fx.ORDER_RULES]
    return rep.summarize(orders(spark, sf, rules=rules))


def _date_rules(precision: str | None) -> list[Rule]:
    return [replace(r, precision=precision) for r in fx.ORDER_RULES]


@query(
    "option_default_precision_day",
    marked(date=f"({DATE_A} <> left({sq.ladder('order_dt')}, 10))") + ORDER_COUNTS,
)
def _(spark, sf):
    return rep.summarize(orders(spark, sf, rules=_date_rules(None)))


@query(
    "option_default_precision_year",
    marked(date=f"(left({DATE_A}, 4) <> left({sq.ladder('order_dt')}, 4))") + ORDER_COUNTS,
)
def _(spark, sf):
    return rep.summarize(orders(spark, sf, Options(default_precision="year"), _date_rules(None)))


@query("option_date_prefix", marked(date=f"(left({DATE_A}, 10) <> left({sq.norm('order_dt')}, 10))") + ORDER_COUNTS)
def _(spark, sf):
    return rep.summarize(orders_text(spark, sf, Options(date_mode="prefix"), _date_rules("day")))


BAD_DATE = "CASE WHEN key % 11 = 0 THEN 'unknown' ELSE order_dt END"


def _bad_dates(spark, sf) -> DataFrame:
    b = fx.orders_target(spark, sf)
    return b.withColumn("order_dt", F.when(F.col("key") % 11 == 0, "unknown").otherwise(F.col("order_dt")))


@query(
    "option_date_free",
    marked(date=f"({DATE_A} <> coalesce(strftime({sq.parsed(BAD_DATE)}, '%Y-%m-%d'), ''))") + ORDER_COUNTS,
)
def _(spark, sf):
    result = cmp.compare(
        fx.orders_source(spark, sf), _bad_dates(spark, sf), _date_rules("day"), Options(date_mode="free")
    )
    return rep.summarize(result)


@query(
    "sql_mode_summary",
    marked(
        price=f"(abs(round(coalesce(o_totalprice::DOUBLE, 0), 2) - round(coalesce(({NULL_PRICE})::DOUBLE, 0), 2)) > 0.5)",
        date=f"coalesce({DATE_A} <> strftime({sq.parsed('order_dt')}, '%Y-%m-%d'), false)",
    )
    + ORDER_COUNTS,
)
def _(spark, sf):
    rules = [replace(r, tolerance=0.5, round_digits=2) if r.kind == "number" else r for r in fx.ORDER_RULES]
    a, b = fx.as_text(fx.orders_source(spark, sf)), fx.as_text(_null_prices(spark, sf))
    return rep.summarize(cmp.compare(a, b, rules, Options().for_sql()))


@query(
    "sql_mode_blank_keys",
    f"""WITH {fx.ORDERS_SQL},
      a2 AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS k, o_orderpriority AS p FROM a),
      b2 AS (SELECT CASE WHEN key % 3 = 0 THEN ' ' ELSE CAST(key AS VARCHAR) END AS k, priority AS p FROM b),
      r AS (SELECT a2.k IS NOT NULL AS in_a, b2.k IS NOT NULL AS in_b,
        coalesce(a2.k IS NOT NULL AND b2.k IS NOT NULL AND {sq.text_differs('a2.p', 'b2.p')}, false) AS d
        FROM (SELECT * FROM a2 WHERE k IS NOT NULL) a2 FULL JOIN (SELECT * FROM b2 WHERE k <> ' ') b2 ON a2.k = b2.k
        UNION ALL SELECT true, false, false FROM a2 WHERE k IS NULL
        UNION ALL SELECT false, true, false FROM b2 WHERE k = ' ')
    """ + COUNTS.format(keys="o_orderkey", missing=""),
)
def _(spark, sf):
    a, b = fx.as_text(fx.orders_source(spark, sf)), fx.as_text(fx.orders_target(spark, sf))
    a = a.withColumn("o_orderkey", F.when(F.col("o_orderkey").cast("long") % 3 != 0, F.col("o_orderkey")))
    b = b.withColumn("key", F.when(F.col("key").cast("long") % 3 == 0, " ").otherwise(F.col("key")))
    rules = [r for r in fx.ORDER_RULES if r.key or r.source == "o_orderpriority"]
    return rep.summarize(cmp.compare(a, b, rules, Options().for_sql()))


FANOUT_ROWS = """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
  b AS (SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS l_quantity, l_returnflag
        FROM lineitem WHERE l_orderkey % 97 <> 0),
  r AS (SELECT a.l_orderkey AS ka, b.l_orderkey AS kb, a.l_orderkey IS NOT NULL AS in_a, b.l_orderkey IS NOT NULL AS in_b,
    coalesce(a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL AND
      (abs(a.l_quantity - b.l_quantity) > 0.01::DOUBLE OR a.l_returnflag <> b.l_returnflag), false) AS d
    FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)"""
FANOUT_OPTIONS = replace(Options().for_sql(), on_duplicates="fanout")


def _fanout_inputs(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    raised = F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)
    b = lines.where("l_orderkey % 97 <> 0").withColumn("l_quantity", raised)
    return lines, b, [r for r in fx.LINE_RULES if r.source in (*fx.LINE_KEYS, "l_quantity", "l_returnflag")]


@query("sql_mode_fanout", FANOUT_ROWS + COUNTS.format(keys="l_orderkey + l_linenumber", missing=""))
def _(spark, sf):
    return rep.summarize(cmp.compare(*_fanout_inputs(spark, sf), FANOUT_OPTIONS))


@query(
    "sql_mode_pair_summary",
    FANOUT_ROWS + COUNTS.format(keys="l_orderkey + l_linenumber", missing="")
    .replace("count_if(in_a) AS total_source", "(SELECT count(*) FROM a) AS total_source")
    .replace("count_if(in_b) AS total_target", "(SELECT count(*) FROM b) AS total_target")
    .replace("count_if(in_a) <> count_if(in_b)", "(SELECT count(*) FROM a) <> (SELECT count(*) FROM b)"),
)
def _(spark, sf):
    return prs.pair_summary(*_fanout_inputs(spark, sf), FANOUT_OPTIONS)


UNTYPED = [("o_totalprice", "price"), ("o_orderpriority", "priority"), ("o_orderstatus", "status")]


@query(
    "compare_text_records",
    f"""WITH {fx.ORDERS_SQL}, j AS (SELECT * FROM a JOIN b ON o_orderkey = key) """
    + " UNION ALL ".join(
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '{x}' AS field, {sq.norm(x)} AS source_value, {sq.norm(y)} AS target_value
        FROM j WHERE {sq.norm(x)} <> {sq.norm(y)}""" for x, y in UNTYPED)
    + """ UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d'), '' FROM j""",
)
def _(spark, sf):
    # The target has no date column: it counts as blank.
    a, b = fx.as_text(fx.orders_source(spark, sf)), fx.as_text(_target(spark, sf).drop("o_orderdate"))
    return rep.diff_records(cmp.compare_text(a, b, ["o_orderkey"]))


# --- numbers as text -------------------------------------------------------------------------------------------------

# Doubles above 10^7, some of them NaN, which is no value.
AMOUNTS_SQL = """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE ELSE o_orderkey * 4099 + 12345678.5::DOUBLE END AS x FROM orders),
  t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'nan'::DOUBLE ELSE o_orderkey * 4099 + 12345678.5::DOUBLE + CASE WHEN o_orderkey % 3 = 0 THEN 0.25 ELSE 0 END END AS x FROM orders),
  r AS (SELECT s.k, CASE WHEN isnan(s.x) THEN NULL ELSE s.x END AS x, CASE WHEN isnan(t.x) THEN NULL ELSE t.x END AS y FROM s JOIN t ON s.k = t.k),
  d AS (SELECT k, coalesce(CAST(x AS VARCHAR), '') AS x, coalesce(CAST(y AS VARCHAR), '') AS y FROM r WHERE x IS DISTINCT FROM y)"""


def _amounts(spark, sf) -> cmp.Comparison:
    k = F.col("o_orderkey")
    amount, nan = k * 4099 + F.lit(12345678.5), F.lit(float("nan"))
    raised = amount + F.when(k % 3 == 0, F.lit(0.25)).otherwise(F.lit(0.0))
    orders_ = fx.table(spark, sf, "orders")
    a = orders_.select(k.alias("k"), F.when(k % 11 == 0, nan).otherwise(amount).alias("x"))
    b = orders_.select(k.alias("k"), F.when(k % 13 == 0, nan).otherwise(raised).alias("x"))
    return cmp.compare(a, b, [Rule("k", key=True), Rule("x", kind="number")], keys_unique=True)


@query("amounts_diff_records", AMOUNTS_SQL + " SELECT k, 'x' AS field, x AS source_value, y AS target_value FROM d")
def _(spark, sf):
    return rep.diff_records(_amounts(spark, sf))


@query("amounts_detail_columns", AMOUNTS_SQL + f" SELECT s.k, coalesce({detail_sql('d.x', 'd.y', 'd.k IS NOT NULL')}, '') AS x FROM s LEFT JOIN d ON s.k = d.k")
def _(spark, sf):
    return rep.detail_columns(_amounts(spark, sf), "source", ASCII_LABELS)


@query("amounts_log_lines", AMOUNTS_SQL + " SELECT CAST(k AS VARCHAR) AS display_key, 'x' AS field, ' - field [x] differs：source=' || x || ', target=' || y AS line FROM d")
def _(spark, sf):
    return rep.log_lines(_amounts(spark, sf), ASCII_LABELS)


# --- gate -----------------------------------------------------------------------------------------------------------


@query(
    "gate_counts",
    f"""WITH a AS (SELECT nullif(l_orderkey, 7) AS l_orderkey, l_linenumber FROM lineitem), {fx.ORDERS_SQL.replace('a AS (', 'unused AS (', 1)},
      b3 AS (SELECT nullif(key, 8) AS l_orderkey, CAST(key % 7 + 1 AS INTEGER) AS l_linenumber FROM b),
      u AS (SELECT *, 1 AS s, 0 AS t FROM a UNION ALL SELECT *, 0, 1 FROM b3),
      g AS (SELECT l_orderkey, l_linenumber, sum(s) AS s, sum(t) AS t FROM u GROUP BY ALL)
    SELECT """
    + ", ".join(
        f"""CAST(coalesce(sum({n}), 0) AS BIGINT) AS rows_{side},
        CAST(coalesce(sum({n}) FILTER ({n} > 1), 0) AS BIGINT) AS duplicate_rows_{side},
        CAST(coalesce(sum({n}) FILTER (l_orderkey IS NULL), 0) AS BIGINT) AS blank_l_orderkey_{side},
        CAST(coalesce(sum({n}) FILTER (l_linenumber IS NULL), 0) AS BIGINT) AS blank_l_linenumber_{side},
        CAST(coalesce(sum({n}) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS blank_any_{side}"""
        for side, n in (("source", "s"), ("target", "t")))
    + """, count_if(s > 0 AND t > 0) AS common_keys, count_if(t = 0) AS missing_keys, count_if(s = 0) AS extra_keys FROM g""",
)
def _(spark, sf):
    a = fx.table(spark, sf, "lineitem").select(F.nullif("l_orderkey", F.lit(7)).alias("l_orderkey"), "l_linenumber")
    b = fx.orders_target(spark, sf).select(
        F.nullif("key", F.lit(8)).alias("l_orderkey"), (F.col("key") % 7 + 1).cast("int").alias("l_linenumber")
    )
    return rec.gate_counts(a, b, fx.LINE_KEYS)


@query("reconcile_orders", marked() + ORDER_COUNTS)
def _(spark, sf):
    return rep.summarize(rec.reconcile(fx.orders_source(spark, sf), fx.orders_target(spark, sf), fx.ORDER_RULES).result)
