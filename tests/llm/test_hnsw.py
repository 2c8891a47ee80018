import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablerecon.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, wanted=10):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if queries(q):
            near = {}
            for i, w in ok:
                if i != q:
                    s = float(np.sqrt(((w - v) ** 2).sum()))
                    near[i] = min(s, near.get(i, math.inf))
            for i, s in near.items():
                if s < out.setdefault(q, {}).get(i, math.inf):
                    out[q][i] = s
    return {q: sorted((s, i) for i, s in near.items())[:wanted] for q, near in out.items()}


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for near in got.values():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1))
    return {q: [(s, i) for _, s, i in near] for q, near in got.items()}


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:700] = x[0]  # a third of all vectors are one
    rows = list(zip(range(1500), x.tolist()))
    got, expected = run(spark, rows, shard_rows=400), brute(rows, lambda q: q % 100 == 0)
    assert got.keys() == expected.keys()
    hits = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.97 * sum(map(len, expected.values()))
    assert got[0] == [(0.0, i) for i in range(200, 210)]


def test_blocks_of_queries_meet_each_graph(spark, monkeypatch):
    """More groups of query blocks than one, over several shards: the same rows."""
    rng = np.random.default_rng(5)
    rows = list(zip(range(0, 60_000, 100), rng.normal(size=(600, 8)).astype(np.float32).tolist()))
    expected = brute(rows, lambda q: True)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 20)
    monkeypatch.setattr(hnsw, "BLOCKS_AT_ONCE", 3)
    got = run(spark, rows, shard_rows=150)
    assert got.keys() == expected.keys()
    assert sum(len(set(got[q]) & set(expected[q])) for q in expected) >= 0.97 * 6000


def test_few_and_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]),
        (100, [0.0, 0.0]),
        (200, None),
        (300, []),
        (400, [1.0, None]),
        (500, [float("nan"), 1.0]),
        (600, [float("inf"), 1.0]),
        (None, [1.0, 1.0]),
        (7, [1.0, 2.0]),
        (8, [1.0, 2.0]),
        (7, [1.0, 0.5]),
        (0, [5.0, 5.0]),
    ]
    got = run(spark, rows)
    assert got == brute(rows, lambda q: q % 100 == 0)
    assert run(spark, rows[:1]) == {} and run(spark, []) == {}
    with pytest.raises(Exception, match="differ in length"):
        run(spark, [(0, [1.0, 2.0]), (1, [1.0])])


def test_a_graph_reaches_every_node():
    x = np.concatenate([np.random.default_rng(i).normal(i * 100, 1, (60, 4)) for i in range(5)])
    graph = hnsw.build(x)
    assert sorted(hnsw.search(graph, x[3], 300)) == list(range(300))
    assert all(level.dtype == np.int32 for level in graph.levels)
