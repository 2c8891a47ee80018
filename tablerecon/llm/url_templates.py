"""Operator 7: url filters from a tree of path templates, in DataFrame operations only.

Urls are counted by host and whole path; the counts hold how many of them the
given rules block or allow, which are the labels.  Below each host a tree of
path segments grows.  Segments that all urls of a branch share are taken
together, without a test, so the number of rounds is that of branchings on a
path, not of its segments.  Where a branch parts, sibling segments are compared
by the labelled purity of what lies below them: one that differs from all
siblings together, by a two-sided z-test, keeps a branch of its own.  The others
are folded to their form, with runs of digits as ``#``; a form that differs, as
a whole, keeps its branch; what is left, few labels included, is merged into the
wildcard ``*``.  Each template's purity is smoothed towards its host's, and a
host's towards one half; templates at or above a threshold are rejected.

Defined cases: a null url, or one without ``://``, has empty host and path;
repeated rows are counted and judged each; a null id is kept; a url without
labels near it is allowed; no rows give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.llm.common import cut, fold_case
from tablerecon.operators.keyed import attach

#: (verdict, host, path): a rule fits its host and all below it, and paths that begin so.
Rule = tuple[str, str, str]

#: Sibling branches merge unless their purity differs by more than so many standard errors.
Z = 1.96
#: Rows' worth of the parent's purity that is added to a branch.
SMOOTHING = 5.0
#: Purity from which a template is rejected.
THRESHOLD = 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    return fold_case(host), path


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _smoothed(blocked: Column, labelled: Column, towards: Column, weight: float) -> Column:
    return (blocked + weight * towards) / (labelled + weight)


def _alike(blocked: Column, labelled: Column, z: float) -> Column:
    """Whether a branch's purity is that of all its siblings, as far as its labels can tell."""
    pooled = _smoothed(F.col("all_blocked"), F.col("all_labelled"), F.lit(0.5), 1.0)
    own = _smoothed(blocked, labelled, pooled, 1.0)
    return (F.abs(own - pooled) <= z * F.sqrt(pooled * (1 - pooled) / (labelled + 1))) | (labelled == 0)


def _shared(first: Column, last: Column) -> Column:
    """How many leading segments two lists share; for the least and greatest of a set, all of it does."""
    n = F.least(F.size(first), F.size(last))
    apart = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.get(first, i).eqNullSafe(F.get(last, i)))
    return F.get(apart, F.lit(0))


def _segment_names(rows: DataFrame, z: float) -> DataFrame:
    """host, branch, segment and the name under which its branch goes on."""
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    branch = ["host", "branch"]
    children = rows.groupBy(*branch, "all_labelled", "all_blocked", "segment").agg(*sums)
    form = F.regexp_replace("segment", "[0-9]+", "#")
    tested = children.withColumn("alike", _alike(F.col("blocked"), F.col("labelled"), z)).withColumn("form", form)
    forms = tested.where("alike").groupBy(*branch, "all_labelled", "all_blocked", "form").agg(*sums)
    merged = forms.select(*branch, "form", _alike(F.col("blocked"), F.col("labelled"), z).alias("merged"))
    literal = F.when(F.col("segment") == "*", F.lit("%2A")).otherwise(F.col("segment"))
    # Neither ``#`` nor a lone ``*`` is a segment's own name, as paths end at a ``#``.
    kept = F.when(~F.col("alike") | (F.col("segment") == ""), literal).when(F.col("merged"), F.lit("*")).otherwise(F.col("form"))
    return attach(tested, merged, [*branch, "form"]).select(*branch, "segment", kept.alias("kept"))


def templates(paths: DataFrame, z: float) -> DataFrame:
    """Adds ``template`` to rows of host, path, labelled, blocked.

    ``paths`` is one row per host and path.  In every round each branch's rows
    first go down the segments that all of them share, found from the least
    and greatest rest of a path, and then one segment further, under the name
    that the comparison of siblings gives it.  A round is a few aggregations
    with partial sums and joins that adaptive execution can split.  Its rows
    are read several times, so each is cut off from its lineage.  Rows leave when
    their segments end.
    """
    rows = paths.withColumn("rest", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("branch", F.lit(""))
    finished = []
    while True:
        branches = rows.groupBy("host", "branch").agg(
            F.min("rest").alias("first"), F.max("rest").alias("last"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
        )
        branches = branches.withColumn("shared", _shared(F.col("first"), F.col("last"))).drop("first", "last")
        rows = attach(rows, branches, ["host", "branch"])
        literal = F.transform(F.slice("rest", F.lit(1), F.col("shared")), lambda p: F.when(p == "*", F.lit("%2A")).otherwise(p))
        rows = rows.withColumn("branch", F.concat("branch", F.array_join(F.transform(literal, lambda p: F.concat(F.lit("/"), p)), "")))
        rest = F.when(F.size("rest") > F.col("shared"), F.slice("rest", F.col("shared") + 1, F.size("rest"))).otherwise(F.slice("rest", 1, 0))
        rows = cut(rows.withColumn("rest", rest).withColumn("segment", F.get("rest", F.lit(0))).drop("shared"))
        ended = F.col("segment").isNull()
        finished.append(rows.where(ended).select("host", "path", "labelled", "blocked", F.col("branch").alias("template")))
        rows = rows.where(~ended)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        named = attach(rows.drop("all_labelled", "all_blocked"), _segment_names(rows, z), ["host", "branch", "segment"])
        rows = cut(
            named.select(
                "host",
                "path",
                "labelled",
                "blocked",
                F.expr("slice(rest, 2, size(rest))").alias("rest"),
                F.concat("branch", F.lit("/"), "kept").alias("branch"),
            )
        )


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = Z,
    smoothing: float = SMOOTHING,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row."""
    host, path = split_url(F.col("url"))
    parsed = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    counted = parsed.groupBy("host", "path").agg(F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    tree = templates(cut(counted), z)
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    hosts = tree.groupBy(F.col("host").alias("_host")).agg(*[s.alias(f"host_{c}") for s, c in zip(sums, ("labelled", "blocked"))])
    host_purity = _smoothed(F.col("host_blocked"), F.col("host_labelled"), F.lit(0.5), smoothing)
    purity = _smoothed(F.col("blocked"), F.col("labelled"), host_purity, smoothing)
    judged = tree.groupBy("host", "template").agg(*sums)
    judged = attach(judged, hosts, [("host", "_host")]).select("host", "template", purity.alias("purity"))
    named = attach(tree.select("host", "path", "template"), judged, ["host", "template"])
    method = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return attach(parsed, named, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity"
    )
