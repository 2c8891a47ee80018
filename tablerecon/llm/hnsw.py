"""Operator 1: nearest neighbours from small-world graphs, one per shard.

Vectors are dealt by their id into shards of bounded size.  A shard builds one
hierarchical navigable small-world graph: nodes enter in random order, each is
linked to near and mutually far nodes among those before it, and levels thin
out geometrically.  The candidates for these links are exact: distances to all
earlier nodes of the shard, a matrix product that the shard's size bounds.
Neighbours are stored as flat arrays, padded with -1, and written to the
shared folder, so that no graph is built twice.  Queries, packed in blocks, are
searched in every shard; a task holds one graph and a bounded number of blocks,
however many queries there are.  The shards' results are merged by exact
distance.  The number of searches is queries times shards: give larger shards
to larger tables, as far as a task's memory goes.

Equal vectors are one node of a shard, which keeps its smallest ids only as
far as a query can need them, so copies neither crowd a neighbour list nor
grow a shard.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another length than most are refused; ties
go to smaller ids; repeated rows of an id are separate vectors but an id is
found once; an id is never its own neighbour; with fewer candidates than
wanted all are found; no rows give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablerecon.llm.common import forget, stored

#: Rows of a shard, about.
SHARD_ROWS = 8192
#: Queries that travel together, and blocks of them that a task holds at once.
QUERY_BLOCK, BLOCKS_AT_ONCE = 512, 16
LINKS = 16
#: Candidates a new node picks its links from, and width of a search.
BUILD_WIDTH = 64
SEARCH_WIDTH = 200


@dataclass
class Graph:
    """Flat neighbour arrays: ``levels[l][i]`` are the nodes linked with node ``i``."""

    vectors: np.ndarray
    levels: list[np.ndarray]
    entry: int


def _pick(node: np.ndarray, near: np.ndarray, apart: np.ndarray, vectors: np.ndarray, most: int) -> list[int]:
    """From ``near``, in order of distance, those nearer to the node than to any picked before."""
    own = vectors[near]
    among = apart_of(own, own)
    picked: list[int] = []
    for i in range(len(near)):
        if len(picked) == most:
            break
        if not picked or (among[i, picked] > apart[i]).all():
            picked.append(i)
    return near[picked].tolist()


def apart_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` and ``b``."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0)


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 1) -> Graph:
    """The graph over distinct ``vectors``, whose order is the order of entry.

    A node's candidates are its nearest among the nodes before it, found by a
    matrix product, which is exact and bounded by the size of a shard.
    """
    n = len(vectors)
    vectors = vectors.astype(np.float32)
    rng = np.random.default_rng(seed)
    height = np.minimum((-np.log(rng.random(n)) / math.log(links)).astype(int), 8)
    levels = []
    for level in range(int(height.max()) + 1 if n else 0):
        most = 2 * links if level == 0 else links
        on = np.flatnonzero(height >= level)
        lists: list[list[int]] = [[] for _ in range(n)]
        for first in range(0, len(on), 512):
            block = on[first : first + 512]
            before = on[: first + len(block)]
            d = apart_of(vectors[block], vectors[before])
            d[np.arange(len(block))[:, None] + first <= np.arange(len(before))[None]] = np.inf
            k = min(width, d.shape[1])
            best = np.argpartition(d, k - 1, 1)[:, :k]
            rows = np.take_along_axis(d, best, 1)
            order = np.argsort(rows, 1, kind="stable")
            best, rows = np.take_along_axis(best, order, 1), np.take_along_axis(rows, order, 1)
            for node, near, apart in zip(block.tolist(), best, rows):
                fine = np.isfinite(apart)
                for other in _pick(vectors[node], before[near[fine]], apart[fine], vectors, links):
                    lists[node].append(other)
                    lists[other].append(node)
        flat = np.full((n, most), -1, np.int32)
        for node in on.tolist():
            near = np.array(lists[node], np.int64)
            if len(near) > most:
                apart = apart_of(vectors[[node]], vectors[near])[0]
                order = np.argsort(apart, kind="stable")
                kept = _pick(vectors[node], near[order], apart[order], vectors, most)
                # The first link leads to an earlier node and keeps the graph connected.
                near = np.array([lists[node][0], *[k for k in kept if k != lists[node][0]]][:most])
            flat[node, : len(near)] = near
        levels.append(flat)
    return Graph(vectors, levels, int(np.argmax(height)) if n else -1)


def search(graph: Graph, query: np.ndarray, wanted: int, width: int = SEARCH_WIDTH) -> list[int]:
    """About the ``wanted`` nearest nodes: greedy from level to level, then best first on the lowest."""
    vectors = graph.vectors
    if graph.entry < 0:
        return []
    query = query.astype(np.float32)

    def far(nodes: np.ndarray) -> np.ndarray:
        d = vectors[nodes] - query
        return np.einsum("ij,ij->i", d, d)

    at = graph.entry
    best = float(far(np.array([at]))[0])
    for level in reversed(graph.levels[1:]):
        while True:
            near = level[at]
            near = near[near >= 0]
            if not len(near):
                break
            d = far(near)
            i = int(d.argmin())
            if d[i] >= best:
                break
            at, best = int(near[i]), float(d[i])
    width = max(width, wanted)
    seen = np.zeros(len(vectors), bool)
    found: list[tuple[float, int]] = []
    start, ground = at, graph.levels[0]
    while start >= 0:
        d = float(far(np.array([start]))[0])
        seen[start] = True
        open_ = [(d, start)]
        heappush(found, (-d, start)) if len(found) < width else None
        while open_:
            d, node = heappop(open_)
            if len(found) >= width and d > -found[0][0]:
                break
            near = ground[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for e, other in zip(far(near).tolist(), near.tolist()):
                if len(found) < width:
                    heappush(found, (-e, other))
                    heappush(open_, (e, other))
                elif e < -found[0][0]:
                    heapreplace(found, (-e, other))
                    heappush(open_, (e, other))
        # Fewer than wanted: go on in a part of the graph not reached yet.
        start = -1 if len(found) >= wanted or seen.all() else int(np.argmin(seen))
    return [node for _, node in sorted((-d, node) for d, node in found)]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & ~zero


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    wanted: int = 10,
    shard_rows: int = SHARD_ROWS,
    width: int = SEARCH_WIDTH,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``wanted`` nearest of each row that ``is_query`` picks.

    ``is_query`` is over the columns vec_id and vector.  Distances returned
    are Euclidean, of the given vectors in double precision.
    """
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    own = own.where(_usable(F.col("vector")) & F.col("vec_id").isNotNull())
    shards = max(1, -(-own.count() // shard_rows))
    rows = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = own.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int"))
    packed = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("queries"))
    # Every block of queries goes to every shard, as one row each time; every graph to every group of blocks.
    group = F.floor(F.col("block") / BLOCKS_AT_ONCE).cast("int").alias("group")
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), group, "queries")
    groups = F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_AT_ONCE))

    def make(table: pa.Table) -> pa.Table:
        forget()
        ids = table.column("vec_id").to_numpy()
        values = table.column("vector").combine_chunks()
        widths = np.diff(values.offsets.to_numpy())
        if len(set(widths.tolist())) > 1:
            raise ValueError("vectors differ in length")
        x = values.flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        distinct, at = np.unique(x, axis=0, return_inverse=True)
        mixed = np.random.default_rng(0).permutation(len(distinct))
        graph = build(distinct[mixed])
        # Ids of each node, smallest first, one more than wanted as one may be the query's own.
        holders: list[list[int]] = [[] for _ in distinct]
        place = np.empty(len(distinct), np.int64)
        place[mixed] = np.arange(len(distinct))
        for i, node in zip(ids.tolist(), place[at.ravel()].tolist()):
            if len(holders[node]) <= wanted and i not in holders[node]:
                holders[node].append(i)
        data = pickle.dumps((graph, distinct[mixed], holders), 5)
        return pa.table({"shard": table.column("shard").slice(0, 1), "graph": pa.array([data], pa.binary())})

    def run(graphs: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if graphs.num_rows and queries.num_rows:
            graph, exact, holders = pickle.loads(graphs.column("graph")[0].as_py())
            for block in queries.column("queries"):
                for query in block.as_py():
                    q = np.array(query["vector"])
                    if len(q) != exact.shape[1]:
                        raise ValueError("vectors differ in length")
                    nodes = np.array(search(graph, q, wanted + 1, width))
                    d = np.sqrt(((exact[nodes] - q) ** 2).sum(1))
                    near = [(s, i) for s, n in zip(d.tolist(), nodes.tolist()) for i in holders[n] if i != query["vec_id"]]
                    for s, i in sorted(near)[:wanted]:
                        out["query_id"].append(query["vec_id"])
                        out["vec_id"].append(i)
                        out["score"].append(s)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    graphs = stored(rows.groupBy("shard").applyInArrow(make, "shard int, graph binary"), "graphs")
    graphs = graphs.withColumn("group", F.explode(groups))
    keys = ["shard", "group"]
    found = graphs.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    # A query of a repeated id counts once: its nearest of either vector.
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
