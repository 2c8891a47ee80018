"""Queries over lookups, key quality, ledgers and table shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablerecon.operators.columns import (
    SchemaError,
    dedup_columns,
    non_blank,
    require_columns,
    require_rows,
    require_same_schema,
    require_some_value,
)
from tablerecon.operators import ledger as le
from tablerecon.operators import lookup as lo
from tablerecon.operators import quality as qu
from tablerecon.operators import shape as sh
from tablerecon.plans import compare as cmp
from tablerecon.plans import report as rep
from tablerecon.plans.rules import Category, Options, Rule
from tablerecon.operators.keyed import attach
from tablerecon.sources.datagen import VALUES, generate_like
from tablerecon.workload import fixtures as fx
from tablerecon.workload import sqltext as sq
from tablerecon.workload.fixtures import table
from tablerecon.workload.registry import query

def _disturbed(df, name: str, every: int):
    """The whole table with every ``every``-th key made one that nothing has: its negative."""
    return df.withColumn(name, F.when(F.col(name) % every == 0, -F.col(name) - 1).otherwise(F.col(name)))


def _disturbed_sql(name: str, every: int) -> str:
    return f"CASE WHEN {name} % {every} = 0 THEN -{name} - 1 ELSE {name} END"


# --- membership -----------------------------------------------------------------------------------------------------


@query(
    "flag_exists",
    f"SELECT doc_id, source, doc_id IN (SELECT {_disturbed_sql('doc_id', 3)} FROM labels) AS found FROM documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return lo.flag_exists(docs, _disturbed(table(spark, sf, "labels"), "doc_id", 3), "doc_id")


@query(
    "flag_exists_combined_key",
    """SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l_orderkey
      AND o.o_orderstatus = l_linestatus) AS found FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    on = [("l_orderkey", "o_orderkey"), ("l_linestatus", "o_orderstatus")]
    return lo.flag_exists(lines, table(spark, sf, "orders"), on).drop("l_linestatus")


@query(
    "not_found",
    f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT {_disturbed_sql('o_custkey', 5)} FROM orders)",
)
def _(spark, sf):
    orders = _disturbed(table(spark, sf, "orders"), "o_custkey", 5)
    return lo.not_found(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, [("c_custkey", "o_custkey")])


@query(
    "not_found_count",
    f"""SELECT count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N'
      AND l_partkey NOT IN (SELECT {_disturbed_sql('p_partkey', 3)} FROM part)""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linestatus = 'O' AND l_returnflag = 'N'")
    return lo.not_found(lines, _disturbed(table(spark, sf, "part"), "p_partkey", 3), [("l_partkey", "p_partkey")]).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "keep_known",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT {_disturbed_sql('c_custkey', 3)} FROM customer)",
)
def _(spark, sf):
    known = _disturbed(table(spark, sf, "customer"), "c_custkey", 3)
    return lo.keep_known(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, [("o_custkey", "c_custkey")])


@query(
    "prefix_not_found",
    f"SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE 'Supplier#%' AND s_suppkey NOT IN (SELECT {_disturbed_sql('l_suppkey', 4)} FROM lineitem)",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_name").startswith("Supplier#")).select("s_suppkey", "s_name")
    return lo.not_found(s, _disturbed(table(spark, sf, "lineitem"), "l_suppkey", 4), [("s_suppkey", "l_suppkey")])


@query(
    "rows_for_keys",
    f"SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT {_disturbed_sql('c_custkey', 2)} FROM customer)",
)
def _(spark, sf):
    keys = _disturbed(table(spark, sf, "customer"), "c_custkey", 2)
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return lo.rows_for_keys(events, keys, [("user_id", "c_custkey")])


# --- lookups --------------------------------------------------------------------------------------------------------


@query(
    "lookup_left",
    """SELECT c_custkey, s_suppkey, s_name FROM customer LEFT JOIN (SELECT s_nationkey, s_suppkey, s_name FROM supplier
      QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1) ON c_nationkey = s_nationkey""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return lo.lookup_left(c, s, [("c_nationkey", "s_nationkey")], ["s_suppkey", "s_name"], ["s_suppkey"]).drop("c_nationkey")


@query(
    "map_values",
    """WITH m AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN 'economy' ELSE p_type END AS p_type, min_by(p_brand, p_partkey) AS code
      FROM part GROUP BY 1)
    SELECT p_partkey, coalesce(code, p.p_type) AS p_type FROM part p LEFT JOIN m ON p.p_type = m.p_type""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    mapping = part.withColumn("p_type", F.when(F.col("p_type") == "ECONOMY", F.lit("economy")).otherwise(F.col("p_type")))
    return lo.map_values(part.select("p_partkey", "p_type"), "p_type", mapping, "p_type", "p_brand", ["p_partkey"])


@query(
    "map_values_preferring",
    f"""WITH m AS (SELECT CASE WHEN p_type = 'PROMO' THEN 'promo' ELSE p_type END AS k, p_brand AS code,
        p_name || '-' || p_size AS txt, p_partkey AS o FROM part),
      used AS (SELECT DISTINCT p_name || '-' || p_size AS txt FROM part WHERE p_partkey IN (SELECT {_disturbed_sql('l_partkey', 7)} FROM lineitem)),
      best AS (SELECT k, code FROM m LEFT JOIN used USING (txt)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY used.txt IS NULL, o) = 1)
    SELECT p_partkey, left(code, 7) AS code FROM part LEFT JOIN best ON p_type = k""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    lines = _disturbed(table(spark, sf, "lineitem"), "l_partkey", 7)
    mapping = part.withColumn("p_type", F.when(F.col("p_type") == "PROMO", F.lit("promo")).otherwise(F.col("p_type")))
    in_use = lo.keep_known(part, lines, [("p_partkey", "l_partkey")])
    target = in_use.select(F.concat_ws("-", "p_name", "p_size").alias("txt"))
    out = lo.map_values_preferring(
        part.select("p_partkey", "p_type"), "p_type", mapping, "p_type", "p_brand",
        ["p_name", "p_size"], target, "txt", ["p_partkey"], 7, "code",
    )
    return out.drop("p_type")


@query(
    "map_composite",
    """WITH m AS (SELECT CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END || '-' || n_regionkey AS txt,
        min_by(CAST(n_nationkey + 1000 AS VARCHAR), n_nationkey) AS code FROM nation GROUP BY 1),
      c AS (SELECT c_custkey, n_name || '-' || n_regionkey AS v FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, left(coalesce(code, v), 4) AS v FROM c LEFT JOIN m ON v = txt""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.concat_ws("-", "n_name", "n_regionkey").alias("v"))
    mapping = nation.withColumn("code", F.col("n_nationkey") + 1000).withColumn(
        "n_name", F.when(F.col("n_regionkey") == 2, F.lower("n_name")).otherwise(F.col("n_name"))
    )
    return lo.map_composite(c, "v", mapping, ["n_name", "n_regionkey"], "code", ["n_nationkey"])


# Brands and names seen with each part type, as `|`-separated cells.  Every
# row holds the header word, but only the first is a header.
MULTIMAP_SQL = """m AS (SELECT DISTINCT p_type AS key, unnest(string_split(p_brand || '|' || p_name, '|')) AS value
  FROM part WHERE p_partkey <> (SELECT min(p_partkey) FROM part))"""


def _multimap(spark, sf):
    cells = table(spark, sf, "part").select("p_partkey", "p_type", F.concat_ws("|", "p_brand", "p_name").alias("codes"))
    return lo.build_multimap(cells, "p_type", "codes", header_words=("Brand",), order="p_partkey")


# Each third part has a brand that no type allows.
ODD_BRAND_SQL = "CASE WHEN p_partkey % 3 = 0 THEN p_brand || '0' ELSE p_brand END"


def _odd_brand():
    return F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("0"))).otherwise(F.col("p_brand"))


@query("build_multimap", f"WITH {MULTIMAP_SQL} SELECT key, value FROM m")
def _(spark, sf):
    return _multimap(spark, sf)


@query(
    "allowed_match",
    f"WITH {MULTIMAP_SQL} SELECT p_partkey, (p_type, {ODD_BRAND_SQL}) IN (SELECT (key, value) FROM m) AS allowed FROM part",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", _odd_brand().alias("p_brand"))
    return lo.allowed_match(part, "p_type", "p_brand", _multimap(spark, sf)).select("p_partkey", "allowed")


@query(
    "coded_match",
    """SELECT c_custkey, c_nationkey % 4 <> 0 AND c_nationkey % 3 <> 0 AS by_source, c_nationkey % 4 <> 0 AS by_target
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name", "n_nationkey")
    c = table(spark, sf, "customer")
    c = c.join(nation, c.c_nationkey == nation.n_nationkey).select(
        "c_custkey", "n_name", "code", F.when(F.col("c_nationkey") % 4 == 0, "none").otherwise(F.col("code")).alias("some_code"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("some_name"),
    )
    # name -> code on the source side, code -> name on the target side
    out = lo.coded_match(c, "some_name", "some_code", nation, "n_name", "code", name="by_source")
    out = lo.coded_match(out, "n_name", "some_code", nation, "code", "n_name", translate="target", name="by_target")
    return out.select("c_custkey", "by_source", "by_target")


@query(
    "apply_updates",
    f"""WITH u AS (SELECT {_disturbed_sql('l_orderkey', 4)} AS l_orderkey, max_by(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS q
      FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN o_totalprice ELSE q END AS o_totalprice FROM orders LEFT JOIN u ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    updates = _disturbed(table(spark, sf, "lineitem"), "l_orderkey", 4).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("o_totalprice"),
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    )
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return lo.apply_updates(orders, updates, ["o_orderkey"], ["o_totalprice"], order)


# --- comparators of text rules --------------------------------------------------------------------------------------


def _records(a, b, rule: Rule, key: str, options: Options = Options()):
    return rep.diff_records(cmp.compare(a, b, [Rule(key, key=True), rule], options))


def _record_sql(key: str, field: str, a: str, b: str, differs: str, frm: str) -> str:
    return f"SELECT {key}, '{field}' AS field, {sq.norm(a)} AS source_value, {sq.norm(b)} AS target_value FROM {frm} WHERE {differs}"


YN_A = "CASE WHEN o_orderkey % 3 = 0 THEN '是' ELSE '否' END"
YN_B = "CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' WHEN 2 THEN '否 ' ELSE '' END"


@query(
    "comparator_bool",
    _record_sql("o_orderkey", "flag", YN_A, YN_B, sq.text_differs(YN_A, YN_B), "orders"),
)
def _(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    a = o.select(k, F.when(k % 3 == 0, "是").otherwise("否").alias("flag"))
    b = o.select(k, F.when(k % 4 == 0, "Y").when(k % 4 == 1, "n").when(k % 4 == 2, "否 ").otherwise("").alias("flag"))
    return _records(a, b, Rule("flag", comparator="bool"), "o_orderkey", Options(yes_no=False))


@query(
    "comparator_synonym",
    _record_sql(
        "c_custkey", "method", "c_mktsegment", "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'EQUIPMENT' ELSE 'HOUSEHOLD' END",
        "c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')", "customer"),
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    a = c.select("c_custkey", F.col("c_mktsegment").alias("method"))
    b = c.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "EQUIPMENT").otherwise("HOUSEHOLD").alias("method"))
    return _records(a, b, Rule("method", comparator="synonym", synonyms={"EQUIPMENT": "MACHINERY"}), "c_custkey")


@query(
    "comparator_last_segment",
    _record_sql(
        "p_partkey", "kind", r"'grid\line\' || p_type", "'x-' || CASE WHEN p_size > 25 THEN p_type ELSE p_name END",
        "p_size <= 25 AND p_type <> p_name", "part"),
)
def _(spark, sf):
    p = table(spark, sf, "part")
    a = p.select("p_partkey", F.concat(F.lit("grid\\line\\"), "p_type").alias("kind"))
    b = p.select(
        "p_partkey", F.concat(F.lit("x-"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_name"))).alias("kind")
    )
    return _records(a, b, Rule("kind", comparator="last_segment", separators=("\\", "-")), "p_partkey")


@query(
    "comparator_prefix",
    """SELECT p_partkey, 'class' AS field, p_type AS source_value, CAST(p_size AS VARCHAR) || '99' AS target_value
    FROM part JOIN (SELECT p_type AS t, min(p_brand) AS code FROM part GROUP BY 1) ON p_type = t
    WHERE left(replace(code, 'Brand#', ''), 1) <> left(CAST(p_size AS VARCHAR), 1)""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    codes = p.groupBy(F.col("p_type").alias("key")).agg(F.replace(F.min("p_brand"), F.lit("Brand#"), F.lit("")).alias("value"))
    a = p.select("p_partkey", F.col("p_type").alias("class"))
    b = p.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("99")).alias("class"))
    return _records(a, b, Rule("class", comparator="prefix", lookup=codes, length=1), "p_partkey")


@query(
    "comparator_prefix_against",
    """SELECT p_partkey, 'p_brand' AS field, p_brand AS source_value, p_name AS target_value FROM part
      WHERE left(p_brand, 7) <> left('Brand#' || p_size, 7)""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    a = p.select("p_partkey", "p_brand")
    b = p.select("p_partkey", F.col("p_name").alias("shown"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("detail"))
    rule = Rule("p_brand", "shown", comparator="prefix", length=7, digits_only=False, against="detail")
    return _records(a, b, rule, "p_partkey")


@query(
    "comparator_allowed",
    f"WITH {MULTIMAP_SQL} " + _record_sql(
        "p_partkey", "codes", "p_type", ODD_BRAND_SQL, f"(p_type, {ODD_BRAND_SQL}) NOT IN (SELECT (key, value) FROM m)", "part"),
)
def _(spark, sf):
    p = table(spark, sf, "part")
    a = p.select("p_partkey", F.col("p_type").alias("codes"))
    b = p.select("p_partkey", _odd_brand().alias("codes"))
    return _records(a, b, Rule("codes", comparator="allowed", lookup=_multimap(spark, sf)), "p_partkey")


@query(
    "comparator_coded",
    _record_sql(
        "c_custkey", "nation", "n_name", "CAST(CASE WHEN c_custkey % 5 = 0 THEN n_nationkey + 1 ELSE n_nationkey END AS VARCHAR)",
        "c_custkey % 5 = 0", "customer JOIN nation ON c_nationkey = n_nationkey"),
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    codes = nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a = c.select("c_custkey", F.col("n_name").alias("nation"))
    code = F.when(F.col("c_custkey") % 5 == 0, F.col("n_nationkey") + 1).otherwise(F.col("n_nationkey"))
    b = c.select("c_custkey", code.cast("string").alias("nation"))
    return _records(a, b, Rule("nation", comparator="coded", lookup=codes), "c_custkey")


# Each part type has several codes; the target writes name-size and uses some of them only.
CATEGORY_SQL = f"""WITH m AS (SELECT p_type AS k, p_partkey AS o, 'c' || (p_partkey % 7) AS code, 'c' || ((p_partkey + p_partkey % 3) % 7) AS target_code,
    p_name || '-' || p_size AS txt FROM part WHERE p_partkey % 4 <> 0),
  a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN ' ' || p_type || ' ' ELSE p_type END AS v FROM part),
  b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || '-' || p_size ELSE 'c' || (p_partkey % 7) || 'x' END AS v FROM part WHERE p_partkey % 5 <> 0),
  best AS (SELECT k, left(code, 2) AS code FROM m LEFT JOIN (SELECT DISTINCT v FROM b) AS used ON v = txt
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY v IS NULL, o) = 1),
  named AS (SELECT txt, left(min_by(target_code, o), 2) AS code FROM m GROUP BY txt),
  r AS (SELECT a.id, trim(a.v) AS x, b.v AS y, coalesce(best.code, '') AS cx, coalesce(named.code, left(b.v, 2)) AS cy
    FROM a JOIN b ON a.id = b.id LEFT JOIN best ON best.k = trim(a.v) LEFT JOIN named ON named.txt = b.v)"""


def _category(spark, sf, compared: str = "v"):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.concat_ws("-", "p_name", "p_size")
    mapping = part.where(k % 4 != 0).select(
        "p_type", "p_partkey", "p_name", "p_size",
        F.concat(F.lit("c"), k % 7).alias("code"), F.concat(F.lit("c"), (k + k % 3) % 7).alias("target_code"),
    )
    a = part.select(k.alias("id"), F.when(k % 9 == 0, F.concat(F.lit(" "), "p_type", F.lit(" "))).otherwise(F.col("p_type")).alias("v"))
    code = F.concat(F.lit("c"), k % 7, F.lit("x"))
    b = part.where(k % 5 != 0).select(k.alias("id"), F.when(k % 2 == 0, name).otherwise(code).alias(compared), F.lit("shown").alias("label"))
    category = Category(mapping, "p_type", "code", ("p_name", "p_size"), "target_code", ("p_partkey",), 2)
    return a, b, category


@query("comparator_category", CATEGORY_SQL + " SELECT id, 'v' AS field, x AS source_value, y AS target_value FROM r WHERE cx <> cy")
def _(spark, sf):
    a, b, category = _category(spark, sf)
    return _records(a, b, Rule("v", comparator="category", category=category), "id")


@query("comparator_category_against", CATEGORY_SQL + " SELECT id, 'v' AS field, x AS source_value, 'shown' AS target_value FROM r WHERE cx <> cy")
def _(spark, sf):
    a, b, category = _category(spark, sf, "sap")
    return _records(a, b, Rule("v", "label", comparator="category", category=category, against="sap"), "id")


# --- key quality ----------------------------------------------------------------------------------------------------


@query(
    "duplicate_keys",
    """SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM
      (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def _(spark, sf):
    return qu.duplicate_keys(table(spark, sf, "lineitem"), fx.LINE_KEYS)


@query(
    "duplicate_examples",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5""",
)
def _(spark, sf):
    return qu.duplicate_examples(table(spark, sf, "lineitem"), fx.LINE_KEYS, 5)


@query(
    "blank_keys",
    f"""WITH {fx.ORDERS_SQL} SELECT count_if({sq.norm('priority')} = '') AS blank_priority, count_if(status = 'N') AS blank_status,
      count_if({sq.norm('priority')} = '' OR status = 'N') AS blank_any FROM b""",
)
def _(spark, sf):
    b = fx.orders_target(spark, sf).withColumn("status", F.nullif("status", F.lit("N")))
    return qu.blank_keys(b.select("priority", "status"), ["priority", "status"])


# Prices of which some are NaN: no value, whatever its type.
NAN_SQL = "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) * 1000000 END AS price FROM orders)"


def _nan_prices(spark, sf):
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(None)).otherwise((k % 50).cast("double") * 1000000)
    return table(spark, sf, "orders").select("o_orderkey", price.alias("price"))


@query("filter_non_blank_nan", NAN_SQL + " SELECT o_orderkey, price FROM p WHERE price IS NOT NULL AND NOT isnan(price)")
def _(spark, sf):
    return non_blank(_nan_prices(spark, sf), "price")


@query("blank_keys_nan", NAN_SQL + """ SELECT 0 AS blank_o_orderkey, count_if(price IS NULL OR isnan(price)) AS blank_price,
  count_if(price IS NULL OR isnan(price)) AS blank_any FROM p""")
def _(spark, sf):
    return qu.blank_keys(_nan_prices(spark, sf), ["o_orderkey", "price"])


@query("value_counts_nan", NAN_SQL + " SELECT CAST(price AS VARCHAR) AS value, count(*) AS n_rows FROM p WHERE price IS NOT NULL AND NOT isnan(price) GROUP BY 1")
def _(spark, sf):
    return sh.value_counts(_nan_prices(spark, sf), "price")


@query("split_by_value_nan", NAN_SQL + " SELECT o_orderkey, CAST(price AS VARCHAR) AS part FROM p WHERE price IS NOT NULL AND NOT isnan(price)")
def _(spark, sf):
    return sh.split_by_value(_nan_prices(spark, sf), "price").drop("price")


# --- guards ---------------------------------------------------------------------------------------------------------


def _refused(guard, *args) -> str:
    """What a guard says, or that it lets the table pass."""
    try:
        guard(*args)
    except SchemaError as e:
        return str(e)
    return "passed"


def _guarded(table_, findings: dict[str, str]):
    """The table's rows under each finding."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("guard"), F.lit(v).alias("finding")) for k, v in findings.items()]))
    return table_.select(rows.alias("g")).groupBy("g.guard", "g.finding").agg(F.count("*").alias("n_rows"))


def _guarded_sql(name: str, findings: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS guard, '{v}' AS finding, count(*) AS n_rows FROM {name}" for k, v in findings.items())


@query(
    "guard_columns",
    _guarded_sql("orders", {"both": "source lacks amount, name; target lacks l_name", "one": "source lacks name", "none": "passed"}),
)
def _(spark, sf):
    o, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return _guarded(o, {
        "both": _refused(require_columns, o, ["amount", "o_orderkey", "name"], lines, ["l_orderkey", "l_name"]),
        "one": _refused(require_columns, o, ["name"], lines, ["l_tax"]),
        "none": _refused(require_columns, o, o.columns, lines, lines.columns),
    })


@query(
    "guard_schema",
    _guarded_sql("nation", {"same": "passed", "order": "columns differ: [n_nationkey, n_name, n_regionkey] and [n_name, n_nationkey, n_regionkey]"}),
)
def _(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    turned = n.select("n_name", "n_nationkey", "n_regionkey")
    return _guarded(n, {"same": _refused(require_same_schema, n, n), "order": _refused(require_same_schema, n, turned).replace("'", "")})


@query(
    "guard_values",
    _guarded_sql("customer", {"rows": "passed", "no rows": "customer has no rows", "values": "passed", "no value": "no value at all in c_phone, c_fax"}),
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("c_phone"), F.lit(None).cast("int").alias("c_fax"))
    none = c.where(F.col("c_custkey") < F.lit(0))
    return _guarded(c, {
        "rows": _refused(require_rows, c, "customer"),
        "no rows": _refused(require_rows, none, "customer"),
        "values": _refused(require_some_value, c, ["c_custkey", "c_name"]),
        "no value": _refused(require_some_value, c, ["c_phone", "c_name", "c_fax"]),
    })


@query(
    "dedup_columns",
    """SELECT c_custkey AS id, c_name AS name, n_name AS name_2, n_nationkey + 1000 AS code FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # The key came twice and counts first; the calculated code came twice and counts last; other names stay twice.
    code = F.col("n_nationkey")
    twice = c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), code.alias("code"), F.lit(-1).alias("id"),
        F.col("n_name").alias("name"), (code + 1000).alias("code"),
    )
    return dedup_columns(twice, ["id", "code"], calculated=["code"]).toDF("id", "name", "name_2", "code")


@query("dedup_keep_first", f"WITH {fx.LINES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM a")
def _(spark, sf):
    return fx.lines_source(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@query(
    "dedup_cleaned_text_key",
    """SELECT k, c_custkey FROM (SELECT replace(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE ' ' || left(c_mktsegment, 3) || ' ' || substr(c_mktsegment, 4) END, ' ', '') AS k, c_custkey FROM customer)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY c_custkey) = 1""",
)
def _(spark, sf):
    seg = F.col("c_mktsegment")
    spaced = F.concat(F.lit(" "), F.substring(seg, 1, 3), F.lit(" "), F.substring(seg, 4, 100))
    c = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, seg).otherwise(spaced).alias("k"), "c_custkey"
    )
    return qu.dedup_keep_first(c, ["k"], ["c_custkey"])


@query(
    "dedup_removed",
    "SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS kept, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed FROM lineitem",
)
def _(spark, sf):
    return qu.dedup_removed(table(spark, sf, "lineitem"), fx.LINE_KEYS)


# --- ledger ---------------------------------------------------------------------------------------------------------

ENTRIES_SQL = """e AS (SELECT l_orderkey AS voucher, nullif(l_suppkey % 7, 5) AS own, l_partkey % 7 AS peer,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS debit, CAST(l_quantity AS DECIMAL(18,2)) AS credit FROM lineitem)"""


def _entries(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("voucher"),
        F.nullif(F.col("l_suppkey") % 7, F.lit(5)).alias("own"),
        (F.col("l_partkey") % 7).alias("peer"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("debit"),
        F.col("l_quantity").cast("decimal(18,2)").alias("credit"),
    )


@query(
    "pair_totals",
    f"WITH {ENTRIES_SQL} SELECT own, peer, sum(debit) AS debit, sum(credit) AS credit FROM e WHERE own IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return le.pair_totals(_entries(spark, sf), "own", "peer", ["debit", "credit"])


NETTED = """t AS (SELECT own, peer, sum(debit) AS debit, sum(credit) AS credit FROM {src} WHERE own IS NOT NULL GROUP BY 1, 2)
  SELECT t.*, coalesce(u.own, 0) AS back_own, coalesce(u.peer, 0) AS back_peer, coalesce(u.debit, 0) AS back_debit,
    coalesce(u.credit, 0) AS back_credit FROM t LEFT JOIN t u ON t.own = u.peer AND t.peer = u.own"""


@query("reciprocal_totals", f"WITH {ENTRIES_SQL}, " + NETTED.format(src="e"))
def _(spark, sf):
    return le.reciprocal_totals(_entries(spark, sf), "own", "peer", ["debit", "credit"])


@query(
    "net_vouchers",
    f"WITH {ENTRIES_SQL}, k AS (SELECT * FROM e WHERE voucher IN (SELECT {_disturbed_sql('o_orderkey', 3)} FROM orders)), "
    + NETTED.format(src="k"),
)
def _(spark, sf):
    known = _disturbed(table(spark, sf, "orders"), "o_orderkey", 3).select(F.col("o_orderkey").alias("voucher"))
    return le.net_vouchers(known, _entries(spark, sf), "voucher", "own", "peer", ["debit", "credit"])


# --- shaping --------------------------------------------------------------------------------------------------------


@query(
    "merge_tables",
    """SELECT o_orderkey AS id, o_orderpriority AS label, o_orderstatus AS _extra_1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
      SELECT o_orderkey, o_orderpriority, NULL FROM orders WHERE o_orderkey % 3 = 1 UNION ALL
      SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 3 = 2""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    first = o.where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    wide = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return sh.merge_tables([first, wide, o.where("o_orderkey % 3 = 2").select("o_orderkey")])


@query(
    "append_rows",
    "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("c_name"), F.col("s_suppkey").alias("c_custkey"))
    return sh.append_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), s)


@query(
    "value_counts",
    f"WITH {fx.ORDERS_SQL} SELECT {sq.norm('priority')} AS value, count(*) AS n_rows FROM b WHERE {sq.norm('priority')} <> '' GROUP BY 1",
)
def _(spark, sf):
    return sh.value_counts(fx.orders_target(spark, sf), "priority")


@query(
    "split_by_rows",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 + 1 AS part FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return sh.split_by_rows(o, 1000, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "split_by_value",
    # Two values that clean to one name are two parts.
    f"""WITH {fx.ORDERS_SQL}, v AS (SELECT key, replace(priority, '-', CASE WHEN key % 2 = 0 THEN '/' ELSE ':' END) AS value FROM b),
      c AS (SELECT *, trim(replace(replace(value, '/', '_'), ':', '_'), '. ') AS plain FROM v)
    SELECT key, CASE WHEN plain = value THEN plain ELSE plain || '~' || substr(sha256(value), 1, 16) END AS part
    FROM c WHERE {sq.norm('value')} <> ''""",
)
def _(spark, sf):
    sign = F.when(F.col("key") % 2 == 0, F.lit("/")).otherwise(F.lit(":"))
    b = fx.orders_target(spark, sf).select("key", F.replace("priority", F.lit("-"), sign).alias("priority"))
    return sh.split_by_value(b, "priority").drop("priority")


@query(
    "fill_right",
    """WITH cells AS (SELECT p_partkey, unnest([1, 2, 3, 4, 5]) AS pos, unnest([p_name, NULL, CASE WHEN p_size > 25 THEN p_brand ELSE ' ' END, '', p_type]) AS title FROM part)
    SELECT p_partkey, pos, CASE WHEN pos = 5 THEN max(title) FILTER (pos = 5) OVER w WHEN pos >= 3 AND max(trim(title)) FILTER (pos = 3) OVER w <> ''
        THEN max(title) FILTER (pos = 3) OVER w ELSE max(title) FILTER (pos = 1) OVER w END AS filled
    FROM cells WINDOW w AS (PARTITION BY p_partkey)""",
)
def _(spark, sf):
    titles = F.array("p_name", F.lit(None), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" "), F.lit(""), "p_type")
    cells = table(spark, sf, "part").select("p_partkey", F.posexplode(titles).alias("pos", "title"))
    cells = cells.withColumn("pos", F.col("pos") + 1)
    return sh.fill_right(cells, ["p_partkey"], "pos", "title").drop("title")


def _generated(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderpriority", "o_orderstatus")
    return generate_like(orders, "key", times=3, seed=7)


@query("generate_like")
def _(spark, sf):
    return _generated(spark, sf)


@query(
    "generate_like_summary",
    """SELECT 3 * count(*) AS n_rows, 3 * count(DISTINCT o_orderkey) AS distinct_keys, count(*) AS kept_rows,
      2 * count(*) AS new_rows, 0.2::DOUBLE AS share_a, 0.2::DOUBLE AS share_b, 0.2::DOUBLE AS share_c, 0.2::DOUBLE AS share_d, 0.2::DOUBLE AS share_e FROM orders""",
)
def _(spark, sf):
    made = _generated(spark, sf)
    kept = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.lit(True).alias("_kept"))
    rows = attach(made, kept, ["key"])
    new = F.col("_kept").isNull()
    letters = [
        F.round(F.count_if(new & (F.col("o_orderpriority") == v)) / F.count_if(new), 1).alias(f"share_{v.lower()}") for v in VALUES
    ]
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("key").alias("distinct_keys"), F.count("_kept").alias("kept_rows"),
        F.count_if(new).alias("new_rows"), *letters,
    )
