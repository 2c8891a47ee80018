"""Queries over names, values and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerecon.functions import calc as ca
from tablerecon.functions import dates as dt
from tablerecon.functions import numbers as nu
from tablerecon.functions import statements as st
from tablerecon.functions import text as tx
from tablerecon.operators import columns as co
from tablerecon.plans import prepare as pr
from tablerecon.plans.rules import Options, Rule
from tablerecon.workload import fixtures as fx
from tablerecon.workload import sqltext as sq
from tablerecon.workload.fixtures import table
from tablerecon.workload.registry import query

# --- names and columns ----------------------------------------------------------------------------------------------


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    sheet = table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "*o_order key", "o_totalprice": " o_total\tprice"})
    return co.select_columns(sheet, ["o_orderkey", "o_totalprice*", "no_such_column"])


@query(
    "cast_columns",
    "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice, CAST(p_size AS VARCHAR) AS p_size, try_cast(p_brand AS INTEGER) AS p_brand FROM part",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", "p_brand")
    return co.cast_columns(part, {"p_retailprice": "decimal(18,2)", "p_size": "string", "p_brand": "int"})


@query("clean_columns", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return co.clean_columns(c.toDF("* c_cust key", "c　_name*\n"))


@query("sanitize_columns", "SELECT c_custkey AS col_1st_key_, c_name AS name_of_customer, c_acctbal AS unnamed_column FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return co.sanitize_columns(c.toDF("1st key!", "name/of customer", ""))


@query(
    "map_fields",
    "SELECT l_orderkey, l_quantity AS qty, l_tax AS l_discount, l_extendedprice * (1.0::DOUBLE - l_discount) AS net FROM lineitem",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    rules = [
        Rule("l_orderkey", key=True),
        Rule("qty", "l_quantity", "number"),
        Rule("l_discount", "l_tax", "number"),
        Rule("net", "net", "number", calc="l_extendedprice * (1 - l_discount)"),
    ]
    return pr.map_fields(lines, rules).drop("l_extendedprice")


@query("project_rules", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    rules = [Rule("o_orderkey", key=True), Rule("o_totalprice", kind="number"), Rule("o_orderpriority")]
    return pr.project_rules(table(spark, sf, "orders"), rules)


@query(
    "fill_missing_columns",
    "SELECT o_orderkey, o_orderpriority, '' AS o_orderstatus, '' AS o_totalprice FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    b = orders.select("o_orderkey", "o_orderpriority")
    return co.fill_missing_columns(b, orders)[0]


@query("rename_by_position", "SELECT c_custkey AS code, c_name, c_acctbal AS balance FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").toDF("Unnamed: 0", "c_name", "Unnamed: 2")
    return co.rename_by_position(c, ["code", "c_name", "balance"])


@query(
    "set_columns",
    "SELECT c_custkey, 'C01' AS compid, c_custkey AS internal_id, 'FURNITURE' AS c_mktsegment FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return co.set_columns(c, {"compid": "C01", "internal_id": F.col("c_custkey"), "c_mktsegment": "FURNITURE"})


@query("filter_equal", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("filter_non_blank", f"WITH {fx.ORDERS_SQL} SELECT key, priority FROM b WHERE {sq.norm('priority')} <> ''")
def _(spark, sf):
    return co.non_blank(fx.orders_target(spark, sf), "priority").select("key", "priority")


# --- text normalizers -----------------------------------------------------------------------------------------------

# Values with outer whitespace and the words that stand for "no value".
PADDED = """CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN chr(12288) || role || chr(9)
  WHEN conv_id % 5 = 2 THEN 'None' WHEN conv_id % 5 = 3 THEN ' NULL ' ELSE '  ' END"""


def _padded():
    n = F.col("conv_id") % 5
    return (
        F.when(n == 0, F.lit(None))
        .when(n == 1, F.concat(F.lit("　"), "role", F.lit("\t")))
        .when(n == 2, "None")
        .when(n == 3, " NULL ")
        .otherwise("  ")
    )


@query(
    "norm",
    f"""WITH t AS (SELECT conv_id, turn, {PADDED} AS v FROM conversations)
    SELECT conv_id, turn, {sq.norm('v')} AS plain,
      CASE WHEN {sq.norm('v')} = 'None' THEN '' ELSE {sq.norm('v')} END AS none_word,
      CASE WHEN lower({sq.norm('v')}) IN ('none', 'null') THEN '' ELSE {sq.norm('v')} END AS any_case FROM t""",
)
def _(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", _padded().alias("v"))
    return t.select(
        "conv_id",
        "turn",
        tx.norm("v").alias("plain"),
        tx.norm("v", nulls=("None",)).alias("none_word"),
        tx.norm("v", nulls=("none", "null"), ci=True).alias("any_case"),
    )


@query("norm_whole_texts", f"SELECT doc_id, {sq.norm('text')} AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.norm("text").alias("text"))


BOOLS = "CASE o_orderkey % 7 WHEN 0 THEN '是' WHEN 1 THEN 'Y' WHEN 2 THEN ' y' WHEN 3 THEN '否' WHEN 4 THEN 'N' WHEN 5 THEN 'n ' ELSE o_orderpriority END"


@query("norm_bool", f"SELECT o_orderkey, {sq.yes_no(BOOLS)} AS v FROM orders")
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in ("是", "Y", " y", "否", "N", "n ")])
    n = (F.col("o_orderkey") % 7).cast("int")
    v = F.when(n < 6, F.get(words, n)).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", tx.norm_bool(v).alias("v"))


@query(
    "norm_synonym",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'EQUIPMENT' WHEN 'HOUSEHOLD' THEN 'HOME' ELSE c_mktsegment END AS v FROM customer""",
)
def _(spark, sf):
    v = tx.norm_synonym("c_mktsegment", {"MACHINERY": "EQUIPMENT", "HOUSEHOLD": "HOME"})
    return table(spark, sf, "customer").select("c_custkey", v.alias("v"))


@query(
    "last_segment",
    """SELECT p_partkey, p_type AS from_path, split_part(p_brand, '#', -1) AS from_brand,
      CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS either FROM part""",
)
def _(spark, sf):
    path = F.concat(F.lit("grid\\line-1\\"), "p_type", F.lit(" "))
    mixed = F.when(F.col("p_size") % 2 == 0, path).otherwise(F.concat(F.lit("a-b - "), "p_name"))
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.last_segment(path).alias("from_path"),
        tx.last_segment("p_brand", "#").alias("from_brand"),
        tx.last_segment(mixed).alias("either"),
    )


@query(
    "display_key",
    """WITH t AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS f FROM lineitem)
    SELECT l_orderkey || ' + ' || l_linenumber || ' + ' || coalesce(f, '') AS blank,
      l_orderkey || ' + ' || l_linenumber || ' + ' || f AS strict,
      concat_ws(' + ', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), f) AS skipping,
      CAST(l_orderkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR) AS combined FROM t""",
)
def _(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("f", F.nullif("l_returnflag", F.lit("N")))
    cols = ["l_orderkey", "l_linenumber", "f"]
    return t.select(
        tx.display_key(cols).alias("blank"),
        tx.display_key(cols, nulls="null").alias("strict"),
        tx.display_key(cols, nulls="skip").alias("skipping"),
        tx.combined_key("l_orderkey", "l_linenumber").alias("combined"),
    )


@query(
    "pad_code",
    """SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 4 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0')
      ELSE CAST(o_orderkey AS VARCHAR) END AS code FROM orders""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.pad_code("o_orderkey", 4).alias("code"))


@query(
    "coalesce_code",
    """SELECT p_partkey, replace(CASE WHEN p_size % 3 = 0 THEN p_brand || p_type ELSE p_name END, ' ', '') AS code FROM part""",
)
def _(spark, sf):
    own = F.when(F.col("p_size") % 6 == 0, " ").when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), "p_name"))
    parts = [F.col("p_brand"), F.nullif("p_type", F.col("p_type")), F.col("p_type")]
    return table(spark, sf, "part").select("p_partkey", tx.coalesce_code(own, parts).alias("code"))


@query(
    "safe_name",
    r"""SELECT page_id, left(CASE WHEN trim(n, '. ') = '' THEN 'unnamed' ELSE trim(n, '. ') END, 31) AS sheet
    FROM (SELECT page_id, regexp_replace(CASE WHEN page_id % 10 = 0 THEN ' .. ' ELSE ' .' || url || '. ' END, '[\\/:*?"<>|]', '_', 'g') AS n FROM pages)""",
)
def _(spark, sf):
    name = F.when(F.col("page_id") % 10 == 0, " .. ").otherwise(F.concat(F.lit(" ."), "url", F.lit(". ")))
    return table(spark, sf, "pages").select("page_id", tx.safe_name(name, 31).alias("sheet"))


# --- calculations ---------------------------------------------------------------------------------------------------


@query(
    "calc_rules",
    """SELECT l_orderkey, l_linenumber, left(l_returnflag, 1) AS cut, l_returnflag || l_linestatus AS joined,
      l_extendedprice * (1.0::DOUBLE - l_discount) AS net,
      coalesce(l_extendedprice / nullif(l_linenumber::DOUBLE - 2.0::DOUBLE, 0), 0) AS per_line,
      abs(l_quantity) + 12.0::DOUBLE * (-l_tax) AS mixed FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        ca.calc(lines, "l_returnflag[:1]", "text").alias("cut"),
        ca.calc(lines, "l_returnflag + l_linestatus", "text").alias("joined"),
        ca.calc(lines, "l_extendedprice*(1-l_discount)", "number").alias("net"),
        ca.calc(lines, "l_extendedprice/(l_linenumber-2)", "number").alias("per_line"),
        ca.calc(lines, "l_quantity + 12*-l_tax", "number", ["quantity"]).alias("mixed"),
    )


@query(
    "calc_text_input",
    """SELECT c_custkey, CAST(c_acctbal * 2.0::DOUBLE AS DECIMAL(20,4)) AS doubled, 1.0::DOUBLE AS from_words,
      CAST(abs(c_acctbal) AS DECIMAL(20,4)) AS size, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name || c_mktsegment END AS strict FROM customer""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").withColumns(
        {"bal": F.concat(F.lit(" "), F.col("c_acctbal").cast("string")), "half": F.when(F.col("c_custkey") % 2 == 1, F.col("c_name"))}
    )
    return c.select(
        "c_custkey",
        ca.calc(c, "bal * 2", "number", decimal_scale=4).alias("doubled"),
        ca.calc(c, "c_name + 1", "number").alias("from_words"),
        ca.calc(c, "bal", "number", ["bal"], decimal_scale=4).alias("size"),
        ca.calc(c, "half + c_mktsegment", "text", null_safe=False).alias("strict"),
    )


# --- dates ----------------------------------------------------------------------------------------------------------


@query(
    "parse_dates",
    f"""WITH {fx.ORDERS_SQL}, t AS (SELECT key, CASE WHEN key % 41 = 0 THEN 'on ' || order_dt WHEN key % 43 = 0 THEN order_dt || ' '
        WHEN key % 47 = 0 THEN '2024-02-30' ELSE order_dt END AS d FROM b)
    SELECT key, {sq.ladder('d')} AS ladder, strftime({sq.parsed('d')}, '%Y-%m-%d') AS free,
      left({sq.ladder('d')}, 4) AS y, left({sq.ladder('d')}, 7) AS m FROM t""",
)
def _(spark, sf):
    k, d = F.col("key"), F.col("order_dt")
    text = (
        F.when(k % 41 == 0, F.concat(F.lit("on "), d))
        .when(k % 43 == 0, F.concat(d, F.lit(" ")))
        .when(k % 47 == 0, "2024-02-30")
        .otherwise(d)
    )
    t = fx.orders_target(spark, sf).select("key", tx.norm(text).alias("d"))
    t = t.select("key", dt.parse_date("d").alias("ladder"), dt.parse_date("d", mode="free").alias("free"))
    return t.select("*", dt.cut_date(F.col("ladder"), "年").alias("y"), dt.cut_date(F.col("ladder"), "month").alias("m"))


@query(
    "parse_date_times",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H') AS hour,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS second FROM events""",
)
def _(spark, sf):
    text = F.date_format("ts", "yyyy-M-d H:m:s")
    t = table(spark, sf, "events").select("event_id", text.alias("d"))
    return t.select(
        "event_id",
        dt.comparable_date("d", "day").alias("day"),
        dt.comparable_date("d", "时").alias("hour"),
        dt.comparable_date("d", "second").alias("second"),
    )


# Spellings by event_id % 12: Spark's pattern, DuckDB's, and the forms that it is read by, the first that fits.
FREE_SPELLINGS = [
    ("d MMMM yyyy", "%-d %B %Y", ["%d %B %Y"]),
    ("dd-MMM-yyyy", "%d-%b-%Y", ["%d-%b-%Y"]),
    ("MMMM d, yyyy HH:mm", "%B %-d, %Y %H:%M", ["%B %d, %Y %H:%M"]),
    ("dd/MM/yyyy", "%d/%m/%Y", ["%m/%d/%Y", "%d/%m/%Y"]),
    ("M/d/yyyy H:m:s", "%-m/%-d/%Y %-H:%-M:%-S", ["%m/%d/%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S"]),
    ("dd.MM.yyyy HH:mm", "%d.%m.%Y %H:%M", ["%m.%d.%Y %H:%M", "%d.%m.%Y %H:%M"]),
    ("EEE, d MMM yyyy", "%a, %-d %b %Y", ["%a, %d %b %Y"]),
    ("yyyy.M.d hh:mm a", "%Y.%-m.%-d %I:%M %p", ["%Y.%m.%d %I:%M %p"]),
    ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "%Y-%m-%dT%H:%M:%S+02:00", ["%Y-%m-%dT%H:%M:%S+02:00"]),
    ("MMM yyyy", "%b %Y", ["%b %Y"]),
    ("yyyyMMdd HH:mm:ss", "%Y%m%d %H:%M:%S", ["%Y%m%d %H:%M:%S"]),
    ("'about 'yyyy", "about %Y", ["%Y"]),
]
_FREE_TEXT_SQL = " ".join(f"WHEN event_id % 12 = {i} THEN strftime(ts, '{f}')" for i, (_, f, _) in enumerate(FREE_SPELLINGS))
_FREE_READ_SQL = " ".join(f"WHEN event_id % 12 = {i} THEN try_strptime(d, {forms})" for i, (_, _, forms) in enumerate(FREE_SPELLINGS))


@query(
    "parse_dates_free",
    f"""WITH t AS (SELECT event_id, CASE {_FREE_TEXT_SQL} END AS d FROM events), p AS (SELECT event_id, d, CASE {_FREE_READ_SQL} END AS moment FROM t)
    SELECT event_id, d, strftime(moment, '%Y-%m-%d') AS day, strftime(moment, '%Y-%m-%d %H:%M:%S') AS second FROM p""",
)
def _(spark, sf):
    spelled = None
    for i, (pattern, _, _) in enumerate(FREE_SPELLINGS):
        text = F.date_format("ts", pattern)
        spelled = F.when(F.col("event_id") % 12 == i, text) if spelled is None else spelled.when(F.col("event_id") % 12 == i, text)
    t = table(spark, sf, "events").select("event_id", spelled.alias("d"))
    return t.select("*", dt.parse_date("d", "free").alias("day"), dt.parse_date("d", "free", keep_time=True).alias("second"))


@query(
    "norm_date_digits",
    rf"""WITH {fx.ORDERS_SQL}, t AS (SELECT key, order_dt AS d, regexp_replace(order_dt, '\D', '', 'g') AS g FROM b)
    SELECT key, CASE WHEN length(g) = 8 THEN left(g, 4) || '-' || substr(g, 5, 2) || '-' || substr(g, 7, 2)
      WHEN regexp_full_match(d, '[^-]*-\d+-\d+') THEN split_part(d, '-', 1) || '-' ||
        CASE WHEN length(split_part(d, '-', 2)) < 2 THEN '0' ELSE '' END || split_part(d, '-', 2) || '-' ||
        CASE WHEN length(split_part(d, '-', 3)) < 2 THEN '0' ELSE '' END || split_part(d, '-', 3)
      ELSE d END AS d FROM t""",
)
def _(spark, sf):
    return fx.orders_target(spark, sf).select("key", dt.norm_date_digits("order_dt").alias("d"))


# --- numbers --------------------------------------------------------------------------------------------------------

MESSY = """CASE o_orderkey % 8 WHEN 0 THEN ' ' || o_orderkey || ' ' WHEN 1 THEN '1,000' WHEN 2 THEN 'NaN' WHEN 3 THEN '1e3'
  WHEN 4 THEN o_orderkey || '.5' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE o_orderpriority END"""


@query("to_num", f"SELECT o_orderkey, {sq.to_num(MESSY)} AS v FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    n = k % 8
    text = (
        F.when(n == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
        .when(n == 1, "1,000").when(n == 2, "NaN").when(n == 3, "1e3")
        .when(n == 4, F.concat(k.cast("string"), F.lit(".5"))).when(n == 5, "").when(n == 6, F.lit(None))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf, "orders").select(k, nu.to_num(text).alias("v"))


@query(
    "num_differs",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 <> 0 THEN l_discount END AS a, CASE WHEN l_suppkey % 3 <> 0 THEN l_tax END AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, {sq.num_differs('a', 'b')} AS exact, {sq.num_differs('a', 'b', '0.02::DOUBLE')} AS tolerant,
      {sq.num_differs('a', 'b', '0.02::DOUBLE', True)} AS ignoring FROM t""",
)
def _(spark, sf):
    t = table(spark, sf, "lineitem").withColumns(
        {"a": F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")), "b": F.when(F.col("l_suppkey") % 3 != 0, F.col("l_tax"))}
    )
    a, b = F.col("a"), F.col("b")
    return t.select(
        "l_orderkey", "l_linenumber",
        nu.num_differs(a, b).alias("exact"),
        nu.num_differs(a, b, 0.02).alias("tolerant"),
        nu.num_differs(a, b, 0.02, "ignore").alias("ignoring"),
    )


@query(
    "render_number_format",
    """SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS two, printf('%.0f', l_quantity) AS whole,
      printf('%.1f%%', l_discount * 100.0::DOUBLE) AS percent, strftime(l_shipdate, '%Y/%m/%d') AS shipped,
      CASE WHEN l_linestatus = 'F' THEN printf('%.2f', l_tax) ELSE printf('%.0f%%', l_tax * 100.0::DOUBLE) END AS by_row FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    fmt = F.when(F.col("l_linestatus") == "F", "0.00").otherwise("0%")
    return lines.select(
        "l_orderkey", "l_linenumber",
        nu.render_number_format("l_extendedprice", "#,##0.00").alias("two"),
        nu.render_number_format("l_quantity", "0").alias("whole"),
        nu.render_number_format("l_discount", "0.0%").alias("percent"),
        nu.render_number_format("l_shipdate", "yyyy/mm/dd").alias("shipped"),
        nu.render_by_format("l_tax", fmt, ["0.00", "0%"]).alias("by_row"),
    )


# --- statements -----------------------------------------------------------------------------------------------------


@query(
    "render_update",
    """SELECT o_orderkey, 'UPDATE ledger.orders SET voucher = ' || CASE WHEN o_orderkey % 4 = 0 THEN 'NULL' ELSE CAST(o_custkey AS VARCHAR) END ||
      ', bill = ''' || replace(o_orderpriority || '''s', '''', '''''') || ''', billed = TO_DATE(''' || strftime(o_orderdate, '%Y-%m-%d') ||
      ''', ''yyyy-MM-dd'') WHERE code = ''' || o_orderstatus || ''' AND o_orderkey = ' || o_orderkey || ';' AS statement FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("voucher"),
        F.concat("o_orderpriority", F.lit("'s")).alias("bill"),
        F.col("o_orderdate").alias("billed"),
        F.col("o_orderstatus").alias("code"),
    )
    statement = st.render_update(
        "ledger.orders", {"voucher": "number", "bill": "text", "billed": "date"}, {"code": "text", "o_orderkey": "number"}
    )
    return o.select("o_orderkey", statement.alias("statement"))


@query(
    "rewrite_timestamps",
    """SELECT o_orderkey, 'SET d = TO_DATE(''' || strftime(o_orderdate, '%Y-%m-%d') || ''', ''yyyy-MM-dd''), e = TO_DATE(''' ||
      strftime(o_orderdate, '%Y-%m-%d') || ''', ''yyyy-MM-dd''), f = TIMESTAMP ''soon''' AS line FROM orders""",
)
def _(spark, sf):
    literal = F.concat(F.lit("TIMESTAMP '"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    line = F.concat(F.lit("SET d = "), literal, F.lit(", e = "), literal, F.lit(", f = TIMESTAMP 'soon'"))
    return table(spark, sf, "orders").select("o_orderkey", st.rewrite_timestamps(line).alias("line"))
