"""The corpus operators over the test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.llm import (
    decontaminate,
    filter_audit,
    hnsw,
    imatch,
    jaccard_join,
    packing,
    pii,
    prefix_trie,
    quality,
    substring_dedup,
    toxicity,
    url_templates,
    warc,
)
from tablerecon.llm.common import new_folder, table
from tablerecon.llm.sampling import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "hit_spans",
    )


def _judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    """The columns that the queries on classifiers return."""
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return _judged(toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]), 5, 0)


def _spans_of(kind: int) -> Column:
    """Number of base spans of a kind; a second argument of the lambda would be an element's place."""
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [_spans_of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.concat("base", "terms")).alias("spans")
    )


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return _judged(quality.score(docs, quality.fit(docs, labels, "quality"), keep=["doc_id"]), 3, 1)


#: DuckDB's digest is hex: five digits make four letters of base 32.
_BASE32_SQL = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST("
    "(CAST('0x' || substr({h}, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '')"
)


@query(
    "op6_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    o AS (SELECT h, max(page_id) AS original FROM p GROUP BY h)
    SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, {_BASE32_SQL.format(h="sha1(p.h)")} AS payload_digest,
        CASE WHEN p.page_id = o.original THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN p.page_id <> o.original THEN o.original END AS refers_to
    FROM p JOIN o ON p.h = o.h""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder, written_at="2024-01-01T00:00:00Z")
    return warc.resolved_records(warc.read_archives(spark, folder, payload=False))


#: Rules given for the pages, as (verdict, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query("op7_url_templates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op1_hnsw")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC32_SQL = (
    "xor(list_reduce(list_transform(range(length({t})), lambda i: CAST(unicode(substr({t}, CAST(i + 1 AS BIGINT), 1)) AS BIGINT)), lambda crc, byte: "
    "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), 4294967295), 4294967295)"
)


@query(
    "op11_prefix_trie",
    f"""
    WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, c - c % 5 AS b, {_CRC32_SQL.format(t="CAST(c AS VARCHAR)")} % 9 AS h, count(*) AS turns FROM t GROUP BY c),
    made AS (SELECT n.c, t.p AS d, t.r, t.x FROM n JOIN t ON t.c = n.b WHERE t.p <= n.h
        UNION ALL SELECT n.c, least(n.h, coalesce(f.turns, 0)) + t.p - n.h, t.r, t.x
        FROM n JOIN t ON t.c = n.c LEFT JOIN n AS f ON f.c = n.b WHERE t.p > n.h),
    pre AS (SELECT c, 0 AS d, '' AS k, NULL AS pk, 0 AS bytes FROM n
        UNION ALL SELECT c, d, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), ''), bytes FROM (
            SELECT c, d, strlen(x) AS bytes, sha256(CAST(to_json(list([r, x]) OVER (PARTITION BY c ORDER BY d)) AS VARCHAR)) AS k FROM made)),
    node AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM pre GROUP BY d, k),
    child AS (SELECT pk AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY pk),
    below AS (SELECT DISTINCT a.k AS top, b.k FROM pre AS a JOIN pre AS b ON a.c = b.c AND a.d <= b.d),
    tree AS (SELECT below.top AS k, count_if(child.k IS NULL) AS n_leaves, sum(node.saved) AS saved
        FROM below JOIN node ON node.k = below.k LEFT JOIN child ON child.k = below.k GROUP BY below.top),
    ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest FROM pre
        WHERE d = (SELECT max(d) FROM pre AS q WHERE q.c = pre.c) GROUP BY k)
    SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n_convs,
        coalesce(child.n_children, 0) AS n_children, CAST(tree.n_leaves AS BIGINT) AS n_leaves, CAST(tree.saved AS BIGINT) AS saved_tokens,
        coalesce(ends.digest, sha256('')) AS ends_sha256
    FROM node JOIN tree ON tree.k = node.k LEFT JOIN child ON child.k = node.k LEFT JOIN ends ON ends.k = node.k
        LEFT JOIN node AS parent ON node.d > 0 AND parent.k = node.pk""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    digests = prefix_trie.end_digests(trie.ends)
    return trie.nodes.join(digests, ["depth", "k1", "k2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


_FILTERS_SQL = "['A', 'B', 'C', 'D', 'E']"


@query(
    "op12_filter_audit",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    f AS (SELECT doc_id, part, list_filter({_FILTERS_SQL}, lambda x: CASE x
            WHEN 'A' THEN len(ws) < 200 WHEN 'B' THEN 100 * len(list_distinct(ws)) < 50 * len(ws) WHEN 'C' THEN 100 * capitals > 2 * length(t)
            WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(doc_id > first, false) END) AS fails FROM w),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
    c AS (SELECT part, fails, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(bad, false)) AS bad
        FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, fails),
    x AS (SELECT unnest({_FILTERS_SQL}) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x AS a, x AS b, x AS c, x AS d, x AS e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    r AS (SELECT *, list_min(list_transform(fails, lambda y: instr(filter_order, y))) AS gone FROM c, o),
    s AS (SELECT part, filter_order, s.step, substr(filter_order, s.step, 1) AS x,
            sum(CASE WHEN gone IS NULL OR gone > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s.step THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN gone < s.step AND list_contains(fails, substr(filter_order, s.step, 1)) THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN fails = [substr(filter_order, s.step, 1)] THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN gone = s.step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = s.step THEN bad ELSE 0 END) AS toxic_lost
        FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step) AS s GROUP BY part, filter_order, s.step)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = filter_audit.fail_masks(table(spark, sf_dir, "documents"))
    labelled = filter_audit.with_labels(masked, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    found = filter_audit.audit(labelled, labels=["quality", "toxic"])
    return found.withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


@query("op13_imatch")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.fingerprint_with_next(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
