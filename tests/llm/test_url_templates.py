import math
import os
import random
import re
import time
from collections import defaultdict

import pytest

from tablerecon.llm.queries import URL_RULES
from tablerecon.llm.url_templates import filter_urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return best or (None, None)


URLS = [
    None,
    "",
    "no scheme/net/x",
    "http://",
    "HTTP://WWW.Example.NET/en/1?x=http://a.net/",
    "http://example.net/de/1#a/b",
    "http://example.net",
    "http://net/",
    "http://xnet/",
    "http://a.example.com/de/x",
    "http://a.example.com/den/x",
    "http://ÄB.org/fr/",
    "http://b.org?x/fr/",
    "http://u@h:80//x//y/",
    "x://y://z.net/q",
    "http://c.org/en/" + "1/" * 500,
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[5], "y"), (None, URLS[5], "y")]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), URL_RULES).collect()
    assert len(got) == len(rows)
    expected = sorted(((i, *parse(u), *ruled(*parse(u))) for i, u, _ in rows), key=str)
    for r, (page, host, path, rule, verdict) in zip(sorted(got, key=lambda r: str((r.page_id, r.host, r.path))), sorted(expected, key=lambda r: str(r[:3]))):
        assert (r.page_id, r.host, r.path, r.rule) == (page, host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_purity_of_a_template_decides(spark):
    rules = [("block", "h.test", "/ads/1"), ("allow", "h.test", "/news/1")]
    urls = [f"http://h.test/{part}/{d}{i}.html" for part in ("ads", "news") for d in (1, 2) for i in range(60)]
    urls += [f"http://other.test/ads/{i}" for i in range(30)]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    of = {u: v for u, v in ((urls[r.page_id], r.verdict) for r in got)}
    assert all(v == ("block" if "/h.test/ads/" in u else "allow") for u, v in of.items())
    templates = {r.template for r in got if r.host == "h.test"}
    assert templates == {"/ads/*.html", "/news/*.html"} or all("*" in t for t in templates)


def test_sections_of_small_share_keep_their_verdict(spark):
    sections = [f"s{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rules = [("block" if i % 2 else "allow", "h.test", f"/{s}/p") for i, s in enumerate(sections)]
    urls = [f"http://h.test/{s}/{page}{i}" for s in sections for page in "pq" for i in range(40)]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    of = {s: {r.verdict for r in got if r.path.startswith(f"/{s}/q")} for s in sections}
    assert of == {s: {"block" if i % 2 else "allow"} for i, s in enumerate(sections)}


def test_branches_that_part_at_a_deep_level(spark):
    rules = [(v, "h.test", f"/a/b/c/d/e/f/{s}/p") for v, s in (("block", "casino"), ("allow", "news"))]
    urls = [f"http://h.test/a/b/c/d/e/f/{s}/{page}{c}" for s in ("casino", "news") for page in "pq" for c in "abcdefghijklmnopqrstuvwxyz"]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert len(got) == len(urls) and {(r.path.split("/")[7], r.verdict) for r in got} == {("casino", "block"), ("news", "allow")}


def brute_templates(urls, rules, z=1.96):
    """Template of each url and its purity, by a recursion over lists of whole paths."""
    pages = [parse(u) for u in urls]
    marks = {}
    for host, path in pages:
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict = max(fits)[1] if fits else None
        labelled, blocked = marks.get((host, path), (0, 0))
        marks[host, path] = (labelled + (verdict is not None), blocked + (verdict == "block"))
    found = {}

    def total(rows):
        return sum(marks[k][0] for k, _ in rows), sum(marks[k][1] for k, _ in rows)

    def alike(rows, pooled):
        n, b = total(rows)
        return n == 0 or abs((b + pooled) / (n + 1) - pooled) <= z * math.sqrt(pooled * (1 - pooled) / (n + 1))

    def grow(rows, branch):
        n, b = total(rows)
        pooled = (b + 0.5) / (n + 1)
        shared = os.path.commonprefix([rest for _, rest in rows])
        branch += "".join("/" + ("%2A" if s == "*" else s) for s in shared)
        rows = [(k, rest[len(shared) :]) for k, rest in rows]
        found.update({k: branch for k, rest in rows if not rest})
        parted = defaultdict(list)
        for k, rest in rows:
            if rest:
                parted[rest[0]].append((k, rest))
        forms = defaultdict(list)
        for segment, below in parted.items():
            if alike(below, pooled):
                forms[re.sub("[0-9]+", "#", segment)] += below
        after = defaultdict(list)
        for segment, below in parted.items():
            form = re.sub("[0-9]+", "#", segment)
            name = "%2A" if segment == "*" else segment
            if segment and below[0] in forms[form]:
                name = "*" if alike(forms[form], pooled) else form
            after[name] += [(k, rest[1:]) for k, rest in below]
        for name, below in after.items():
            grow(below, branch + "/" + name)

    by_host = defaultdict(list)
    for host, path in marks:
        by_host[host].append(((host, path), re.sub("^/", "", path).split("/")))
    for rows in by_host.values():
        grow(rows, "")
    sums = defaultdict(lambda: [0, 0])
    for key, (n, b) in marks.items():
        for name in ((key[0], found[key]), (key[0], None)):
            sums[name][0] += n
            sums[name][1] += b
    out = []
    for key in pages:
        host_n, host_b = sums[key[0], None]
        n, b = sums[key[0], found[key]]
        out.append((found[key], (b + 5 * (host_b + 2.5) / (host_n + 5)) / (n + 5)))
    return out


def test_templates_equal_brute_force(spark):
    rng = random.Random(7)
    rules = [("block", "a.test", "/x/p1"), ("allow", "a.test", "/x/p2"), ("block", "a.test", "/y"), ("allow", "b.test", "/"), ("block", "b.test", "/v1/p")]
    rules += [("allow", "c.test", f"/q/{d}") for d in "1357"] + [("block", "c.test", f"/r/{d}") for d in "2468"]
    parts = ["x", "y", "p1", "p12", "p2", "p3", "v1", "v2", "q", "r", "", "*", "1.html", "22.html", "3"]
    urls = ["http://" + rng.choice("aabc") + ".test" + "".join("/" + rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 5]))) for _ in range(900)]
    urls += [f"http://c.test/{s}/{i}" for s in "qr" for i in range(100)] + urls[:50]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    expected = brute_templates(urls, rules)
    assert {r.page_id: r.template for r in got} == {i: t for i, (t, _) in enumerate(expected)}
    for r in got:
        assert r.purity == pytest.approx(expected[r.page_id][1])
        fits = [(len(h + p), v) for v, h, p in rules if r.host == h and r.path.startswith(p)]
        assert r.verdict == (max(fits)[1] if fits else "block" if expected[r.page_id][1] >= 0.8 else "allow")
    assert len({r.template for r in got}) > 20


def test_segments_that_differ_in_digits_only_keep_their_verdicts(spark):
    rules = [("block", "h.test", "/v1/p"), ("allow", "h.test", "/v2/p")]
    urls = [f"http://h.test/v{v}/{page}{i}" for v in (1, 2) for page in "pq" for i in range(60)]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {(r.path.split("/")[1], r.verdict) for r in got} == {("v1", "block"), ("v2", "allow")}


def test_shared_segments_take_no_rounds(spark):
    deep = "/".join(f"s{i}" for i in range(500))
    urls = [f"http://h.test/{deep}/{i}" for i in range(3)] + [f"http://h.test/{deep}/z{deep}/{i}" for i in range(3)]
    start = time.monotonic()
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    assert len(got) == 6 and time.monotonic() - start < 20


def test_plan_is_native(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = filter_urls(pages, URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
