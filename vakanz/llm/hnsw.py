"""Approximate nearest neighbours: one navigable small-world graph per shard, shard results merged.

Equal vectors are one node, which carries the smallest ids of its rows: no more than ``k + 1`` of
them can ever be in an answer, so nothing is lost and a vector that a third of all rows share is one
node. Nodes are dealt to shards by hash. A shard's hierarchical graph is built in the order of that hash with
levels from a fixed seed, so a task that runs again builds the same graph, and is written
as flat arrays: vectors, neighbours of the ground level (``2 * LINKS`` a node, -1 where unused),
neighbours of the upper levels and where a node's upper levels begin. Every query then searches every
shard; queries of a shard are cut into parts of ``QUERIES``, each with its copy of the graph. Distances
of what was found are taken again on the original vectors in double precision, and the ``k`` best of a
query over all shards stay.

Shards hold about ``32 * sqrt(n)`` nodes, at most ``MAX_NODES`` and ``MAX_BYTES`` of vectors, so a task's
memory is bounded and both shards and their sizes grow with the table.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries take no part;
a query meets vectors of its own length only; its own row is left out once, so other rows with its id
or its vector are candidates; ties go to the smaller id, a null id comes last; rows with a null id are
candidates, never queries; a query row that occurs twice is answered twice; fewer than ``k`` candidates
are all returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz.llm.common import stage

LINKS = 16  # a node's links on an upper level, half of those on the ground level
WIDTH_BUILD, WIDTH_SEARCH = 72, 160  # nodes a search keeps
MAX_NODES, MAX_BYTES = 1 << 17, 1 << 27
QUERIES = 1 << 13
INDEX = "dim int, shard int, vectors binary, ground binary, upper binary, upper_at binary, entry int, ids array<array<long>>"
FOUND = "query_no long, query_id long, vec_id long, score double"


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, v: rows whose vector has only finite entries, not all of them zero."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("v"))
    return rows.filter(fine & F.exists("v", lambda c: c != 0))


class Graph:
    """Hierarchical small-world graph over the rows of ``x``, in flat arrays."""

    def __init__(self, x, ground, upper, upper_at, entry):
        self.x, self.ground, self.upper, self.upper_at, self.entry = x, ground, upper, upper_at, entry
        self.seen, self.turn = np.zeros(len(x), dtype=np.int32), 0

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        n = len(x)
        draws = (np.random.default_rng(20261201).random(n) + 1e-12).clip(max=1.0)
        levels = np.floor(-np.log(draws) / math.log(LINKS)).astype(np.int64)
        upper_at = np.concatenate(([0], np.cumsum(levels)))
        graph = cls(x, np.full((n, 2 * LINKS), -1, dtype=np.int32),
                    np.full((max(1, upper_at[-1]), LINKS), -1, dtype=np.int32), upper_at, 0)
        for i in range(1, n):
            graph._insert(i, int(levels[i]), int(levels[graph.entry]))
        return graph

    def links(self, node: int, level: int) -> np.ndarray:
        return self.ground[node] if level == 0 else self.upper[self.upper_at[node] + level - 1]

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        off = self.x[nodes] - q
        return np.einsum("ij,ij->i", off, off)

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes met, nearest first."""
        self.turn += 1
        seen, turn = self.seen, self.turn
        for _, node in start:
            seen[node] = turn
        ahead = list(start)
        heapq.heapify(ahead)
        best = [(-d, node) for d, node in start]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while ahead:
            d, node = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= width:
                break
            near = self.links(node, level)
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            for far, other in zip(self._far(q, near).tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-far, other))
                    heapq.heappush(ahead, (far, other))
                elif far < -best[0][0]:
                    heapq.heapreplace(best, (-far, other))
                    heapq.heappush(ahead, (far, other))
        return sorted((-d, node) for d, node in best)

    def _spread(self, nodes: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the nodes, nearest first; one nearer to a chosen node waits, and fills up at the end."""
        if len(nodes) <= most:
            return nodes
        x = self.x[nodes]
        square = np.einsum("ij,ij->i", x, x)
        closer = square[:, None] + square[None, :] - 2 * (x @ x.T) < far[:, None]
        chosen, waiting = [], []
        blocked = np.zeros(len(nodes), dtype=bool)
        for at in range(len(nodes)):
            if blocked[at]:
                waiting.append(at)
                continue
            chosen.append(at)
            if len(chosen) == most:
                break
            blocked |= closer[:, at]
        chosen += waiting[: most - len(chosen)]
        return nodes[chosen]

    def _insert(self, i: int, level: int, top: int) -> None:
        q = self.x[i]
        found = [(float(self._far(q, np.array([self.entry]))[0]), self.entry)]
        for at in range(top, level, -1):
            found = self._search(q, found[:1], 1, at)
        for at in range(min(level, top), -1, -1):
            found = self._search(q, found, WIDTH_BUILD, at)
            nodes = np.array([node for _, node in found], dtype=np.int32)
            chosen = self._spread(nodes, np.array([d for d, _ in found]), LINKS)
            own = self.links(i, at)
            own[: len(chosen)] = chosen
            for node in chosen.tolist():
                self._link_back(node, i, at)
        if level > top:
            self.entry = i

    def _link_back(self, node: int, new: int, level: int) -> None:
        own = self.links(node, level)
        if own[-1] < 0:
            own[int((own >= 0).sum())] = new
            return
        nodes = np.append(own, np.int32(new))
        far = self._far(self.x[node], nodes)
        order = np.argsort(far, kind="stable")
        own[:] = self._spread(nodes[order], far[order], len(own))

    def nearest(self, q: np.ndarray, k: int, width: int = WIDTH_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """The nodes found nearest to ``q``, at least ``k`` if there are, and their distances."""
        found = [(float(self._far(q, np.array([self.entry]))[0]), self.entry)]
        for at in range(int(self.upper_at[self.entry + 1] - self.upper_at[self.entry]), 0, -1):
            found = self._search(q, found[:1], 1, at)
        nodes = np.array([node for _, node in self._search(q, found, max(width, k), 0)])
        off = self.x[nodes] - q
        far = np.sqrt((off * off).sum(axis=1))
        order = np.argsort(far, kind="stable")
        kept = far[order] <= far[order[min(k, len(order)) - 1]]  # ties of the k-th included
        return nodes[order][kept], far[order][kept]


def _build(table: pa.Table) -> pa.Table:
    """Rows of one shard in, its graph as one row out."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    table = table.sort_by([("place", "ascending"), ("key", "ascending")])
    x = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    graph = Graph.build(np.ascontiguousarray(x))
    ids = table["ids"].combine_chunks()
    row = {"dim": [dim], "shard": [shard], "vectors": [x.tobytes()], "ground": [graph.ground.tobytes()],
           "upper": [graph.upper.tobytes()], "upper_at": [graph.upper_at.tobytes()], "entry": [graph.entry]}
    types = {"dim": pa.int32(), "shard": pa.int32(), "entry": pa.int32()}
    columns = [pa.array(v, types.get(c, pa.binary())) for c, v in row.items()]
    nested = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.Table.from_arrays([*columns, nested], [*row, "ids"])


def _search(k: int, width: int):
    def search(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if index.num_rows and asked.num_rows:
            dim = index["dim"][0].as_py()
            read = lambda c, kind: np.frombuffer(index[c][0].as_buffer(), dtype=kind)
            graph = Graph(read("vectors", np.float64).reshape(-1, dim), read("ground", np.int32).reshape(-1, 2 * LINKS),
                          read("upper", np.int32).reshape(-1, LINKS), read("upper_at", np.int64), index["entry"][0].as_py())
            ids = index["ids"].combine_chunks().flatten()
            for no, own, q in zip(asked["query_no"].to_pylist(), asked["query_id"].to_pylist(), asked["v"]):
                q = q.values.to_numpy()
                nodes, far = graph.nearest(q, k + 1, width)
                rows = []
                for node, d in zip(nodes.tolist(), far.tolist()):
                    held = ids[node].as_py()
                    if d == 0.0 and (graph.x[node] == q).all() and own in held:
                        held.remove(own)
                    rows += [(d, i is None, i or 0) for i in held]
                for d, no_id, i in heapq.nsmallest(k, rows):
                    for column, value in zip(out, (no, own, None if no_id else i, d)):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["query_no", "query_id", "vec_id", "score"])

    return search


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: every different vector with the ``k + 1`` smallest ids of its rows."""
    window = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k + 1)
    listed = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("ids"))
    return listed.select("v", F.col("ids.vec_id").alias("ids"))


def shards_of(n: int, dim: int) -> int:
    size = min(MAX_NODES, MAX_BYTES // (8 * max(1, dim)), 32 * math.isqrt(max(1, n)))
    return max(1, -(-n // max(64, size)))


def build_index(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """One row per (length, shard) with its graph, and the number of shards."""
    nodes = stage(distinct_vectors(rows, k).select(
        "v", "ids", F.size("v").alias("dim"), F.xxhash64("v").alias("place"), F.col("ids")[0].alias("key")))
    size = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    shards = shards_of(size.n, size.dim or 1)
    dealt = nodes.withColumn("shard", F.pmod(F.hash(F.col("place")), F.lit(shards)))
    # by range, so that a few shards don't meet in one task
    return stage(dealt.repartitionByRange(shards, "shard").groupBy("dim", "shard").applyInArrow(_build, INDEX)), shards


def nearest(
    df: DataFrame, asked: Column, *, id_col: str = "vec_id", vector: str = "embedding", k: int = 10,
    width: int = WIDTH_SEARCH,
) -> DataFrame:
    """query_no, query_id, rank, vec_id, score: the ``k`` nearest rows found for every row where ``asked`` holds.

    ``asked`` is a condition on ``vec_id``, the id as a long.
    """
    rows = usable(df, id_col, vector)
    index, shards = build_index(rows, k)
    queries = stage(rows.filter(asked & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("query_no"), F.col("vec_id").alias("query_id"), "v"))
    parts = max(1, -(-queries.count() // QUERIES))
    part = F.pmod(F.hash("query_no"), F.lit(parts))
    spread = queries.select("*", F.size("v").alias("dim"), part.alias("part"),
                            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    place = ["dim", "shard", "part"]
    found = copies.groupBy(*place).cogroup(spread.groupBy(*place)).applyInArrow(_search(k, width), FOUND)
    best = Window.partitionBy("query_no").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select(
        "query_no", "query_id", "rank", "vec_id", "score")
