"""The audit against filters that are run one after the other, in every order."""

import re
from itertools import permutations

import numpy as np
import pytest

from tablerecon.llm.filter_audit import audit, fail_masks, interactions, removal_steps, with_labels

SCHEMA = "doc_id long, text string, source string"


def fails(rows):
    """Names of the failed filters of each row."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        lower = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        checks = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            re.search(r"[#$%&*|]", text) is not None,
            lower,
        ]
        out.append({n for n, c in zip("ABCDE", checks) if c})
    return out


def brute(rows, labels):
    found = fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {s or "" for _, _, s in rows}:
        own = [(r[0], f) for r, f in zip(rows, found) if (r[2] or "") == part]
        lines, per_filter = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                per_filter[name] += len(gone)
                earlier = sum(name in f for _, f in own) - len(gone)
                lines.append([part, order, step, len(left), len(gone), earlier, sum(f == {name} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out += [tuple(x) + (per_filter[x[1][x[2] - 1]],) for x in lines]
    return sorted(out)


COLUMNS = "part filter_order step kept removed redundant unique_fails lost_quality lost_toxic shapley".split()


def audited(spark, rows, labels, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit(with_labels(fail_masks(docs), marks, ["quality", "toxic"]), labels=["quality", "toxic"])
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


LONG = " ".join(f"w{i}" for i in range(220))
DULL = "a b " * 120
ROWS = [
    (1, LONG, "s"),
    (2, LONG, "s"),
    (2, LONG, "t"),
    (3, LONG + " #", "s"),
    (4, DULL, None),
    (5, DULL, ""),
    (6, None, "s"),
    (7, "", "s"),
    (None, "", "s"),
    (None, LONG, "t"),
    (8, "ABC\x0bé　d", "t"),
    (9, " " + LONG.upper() + "\n", "t"),
    (10, "é" * 100 + "AB", "t"),
    (11, "é" * 98 + "AB", "t"),
    (12, " ".join(f"w{i % 100}" for i in range(200)), "t"),
    (13, " ".join(f"w{i % 99}" for i in range(200)), "t"),
    (14, LONG * 200, "t"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 0, None), (None, 1, 1), (8, 1, 0), (99, 1, 1)]


def test_audit_equals_running_the_filters(spark):
    assert audited(spark, ROWS, LABELS) == brute(ROWS, LABELS)


def test_masks(spark):
    rows = fail_masks(spark.createDataFrame(ROWS, SCHEMA)).collect()
    named = sorted((r.doc_id is None, r.doc_id or 0, r.part, "".join(n for i, n in enumerate("ABCDE") if r["mask"] >> i & 1)) for r in rows)
    expected = sorted((i is None, i or 0, s or "", "".join(sorted(f))) for (i, _, s), f in zip(ROWS, fails(ROWS)))
    assert named == expected


def test_empty_table_clashing_names_and_no_labels(spark):
    assert audited(spark, [], LABELS) == []
    extra = ", part string, mask int, t1 long, t2 long, bits int, first long, n long, quality int"
    wide = [r + ("x", 1, 2, 3, 4, 5, 6, 1) for r in ROWS]
    assert audited(spark, wide, [], SCHEMA + extra) == brute(ROWS, [])


@pytest.mark.parametrize("n", [1, 3])
def test_steps_and_shapley_add_up(n):
    places, steps = removal_steps(n)
    assert steps[0].tolist() == [n + 1] * len(places) and (steps[-1] == 1).all()
    counts = np.random.default_rng(n).integers(0, 50, (1 << n, 2))
    found = interactions(counts, n)
    # In every order the same documents are left, and the removals add up.
    assert (found["kept"][:, -1] == counts[0, 0]).all()
    assert (found["lost"].sum(axis=1) == counts[1:].sum(axis=0)).all()
    assert found["shapley"][0].sum() == len(places) * counts[1:, 0].sum()
