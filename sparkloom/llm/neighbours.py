"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays.

Equal vectors are one node that keeps the smallest ids it stands for, as many as a search may return, so a hot vector
neither grows a shard nor cuts the graph. Nodes are dealt into shards by a hash of the vector: a shard for each core, as
long as shards stay above `least_rows`, and never more than `shard_rows` nodes a shard, which bounds a worker's memory.
Each shard's graph is one row of a stored table. Queries go to every shard, stream past its graph in as many tasks as
there are cores for (the index is shipped once to each, however many queries there are), and the best k of all shards
are merged. All distances, in the graph and in the result, are Euclidean
ones of the original vectors, summed over differences in double precision; so vectors far from the origin or of mixed
scale lose nothing, and whatever the search has met is ranked exactly.

Defined results: vectors that are null or zero, hold null or non-finite components, or differ in length from most
others take no part, neither as queries nor as candidates; ties go to the smaller id; a query's own row is no candidate,
other rows are, also those with the same vector or the same id. Rows that repeat an id are queries of their own, each
with its k results. With fewer candidates than k all are given; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, stored


class Graph:
    """Layers of neighbour rows over vectors; -1 fills a row up. Layer 0 holds all nodes in order."""

    def __init__(self, vectors: np.ndarray, width: int = 16, beam: int = 80, seed: int = 0) -> None:
        self.v = np.ascontiguousarray(vectors, np.float64)
        n = len(self.v)
        self.width, self.beam = width, beam
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(width)).astype(int), 12)
        top = int(self.levels.max()) if n else 0
        self.rows = [np.arange(n, dtype=np.int32)]
        self.layers = [np.full((n, 2 * width), -1, np.int32)]
        for level in range(1, top + 1):
            there = np.flatnonzero(self.levels >= level)
            row = np.full(n, -1, np.int32)
            row[there] = np.arange(len(there))
            self.rows.append(row)
            self.layers.append(np.full((len(there), width), -1, np.int32))
        self.stamp, self.turn = np.zeros(n, np.int32), 0
        self.entry = -1
        for i in range(n):
            self._insert(i)

    @classmethod
    def of(cls, vectors: np.ndarray, levels: np.ndarray, rows: list[np.ndarray], layers: list[np.ndarray], entry: int) -> Graph:
        self = cls.__new__(cls)
        self.v, self.levels, self.rows, self.layers, self.entry = vectors, levels, rows, layers, entry
        self.stamp, self.turn = np.zeros(len(vectors), np.int32), 0
        return self

    def away(self, q: np.ndarray, nodes: np.ndarray | list[int]) -> np.ndarray:
        """Squared distances of nodes from q."""
        x = self.v[nodes] - q
        return np.einsum("ij,ij->i", x, x)

    def _beam(self, q: np.ndarray, starts: list[tuple[float, int]], beam: int, level: int) -> list[tuple[float, int]]:
        """The nearest nodes of a layer (squared distance, node), by best-first search."""
        self.turn += 1
        stamp, turn, layer, row = self.stamp, self.turn, self.layers[level], self.rows[level]
        for _, i in starts:
            stamp[i] = turn
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in starts]
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            near = layer[row[i]]
            near = near[near >= 0]
            near = near[stamp[near] != turn]
            if not len(near):
                continue
            stamp[near] = turn
            far = self.away(q, near)
            if len(best) >= beam:
                good = far < -best[0][0]
                near, far = near[good], far[good]
            for e, j in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (-e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                else:
                    continue
                heapq.heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)

    def _choose(self, nodes: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Of nodes in order of distance, those nearer to the new node than to any chosen before; then the nearest."""
        if len(nodes) <= most:
            return nodes
        around = self.v[nodes] - self.v[nodes[0]]  # near the origin, where the product below loses nothing
        norms = np.einsum("ij,ij->i", around, around)
        near = norms[:, None] + norms[None, :] - 2 * (around @ around.T)
        chosen: list[int] = []
        closest = np.full(len(nodes), np.inf)
        for i in range(len(nodes)):
            if far[i] < closest[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.minimum(closest, near[i], out=closest)
        if len(chosen) < most:
            rest = np.setdiff1d(np.arange(len(nodes)), chosen, assume_unique=True)
            chosen += rest[: most - len(chosen)].tolist()
        return nodes[chosen]

    def _insert(self, i: int) -> None:
        level = int(self.levels[i])
        if self.entry < 0:
            self.entry = i
            return
        q = self.v[i]
        start = [(float(self.away(q, [self.entry])[0]), self.entry)]
        high = int(self.levels[self.entry])
        for at in range(high, level, -1):
            start = self._beam(q, start, 1, at)
        for at in range(min(level, high), -1, -1):
            start = self._beam(q, start, self.beam, at)
            nodes = np.array([j for _, j in start], np.int32)
            far = np.array([d for d, _ in start])
            chosen = self._choose(nodes, far, self.width)
            layer, row = self.layers[at], self.rows[at]
            layer[row[i], : len(chosen)] = chosen
            for j in chosen.tolist():
                own = layer[row[j]]
                free = np.flatnonzero(own < 0)
                if len(free):
                    own[free[0]] = i
                    continue
                others = np.append(own, np.int32(i))
                away = self.away(self.v[j], others)
                order = np.argsort(away, kind="stable")
                kept = self._choose(others[order], away[order], max(4, len(own) * 3 // 4))
                own[:] = -1
                own[: len(kept)] = kept
        if level > high:
            self.entry = i

    def met(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        """The whole beam of a search, nearest first: (squared distance, node)."""
        if self.entry < 0:
            return []
        q = np.asarray(q, np.float64)
        start = [(float(self.away(q, [self.entry])[0]), self.entry)]
        for at in range(int(self.levels[self.entry]), 0, -1):
            start = self._beam(q, start, 1, at)
        return self._beam(q, start, beam, 0)

    def search(self, q: np.ndarray, count: int, beam: int) -> list[int]:
        return [i for _, i in self.met(q, max(beam, count))][:count]


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _flat(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def build_index(vectors: DataFrame, keep: int, shard_rows: int, least_rows: int, width: int, beam: int) -> tuple[DataFrame, int]:
    """vectors: vec_id, vec; usable ones only. A row for each shard; the number of shards."""
    rows = vectors.withColumn("hash", F.xxhash64("vec"))
    # Few ids a part first, so that a hot vector's rows are never one group.
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(64))
    for by in (["hash", "vec", "part"], ["hash", "vec"]):
        rows = rows.withColumn("part", part) if "part" in by else rows.drop("part")
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        rows = rows.withColumn("nth", nth).filter(F.col("nth") <= keep).drop("nth")
    nodes = stored(rows.groupBy("hash", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    count, cores = nodes.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-count // shard_rows), min(cores, -(-count // least_rows)))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("hash", ignore_index=True)
        graph = Graph(np.stack(part["vec"].to_numpy()), width, beam)
        ends = np.cumsum([len(x) for x in part["ids"]])
        out = {
            "shard": [int(part["shard"].iloc[0])],
            "vectors": [_flat(graph.v)],
            "ids": [_flat(np.concatenate(part["ids"].to_numpy()).astype(np.int64))],
            "ends": [_flat(ends.astype(np.int64))],
            "levels": [_flat(graph.levels.astype(np.int32))],
            "layers": [[_flat(x) for x in graph.layers]],
            "entry": [graph.entry],
        }
        return pd.DataFrame(out)

    schema = "shard int, vectors binary, ids binary, ends binary, levels binary, layers array<binary>, entry int"
    placed = nodes.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    return stored(placed.groupBy("shard").applyInPandas(build, schema), "index"), shards


def open_graph(row: pd.Series, dim: int) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph of an index row, the ids of its nodes end to end, and where each node's ids end."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
    levels = np.frombuffer(row["levels"], np.int32)
    rows, layers = [], []
    for level, blob in enumerate(row["layers"]):
        there = np.flatnonzero(levels >= level)
        at = np.full(len(vectors), -1, np.int32)
        at[there] = np.arange(len(there))
        rows.append(at)
        layers.append(np.frombuffer(blob, np.int32).reshape(len(there), -1))
    return Graph.of(vectors, levels, rows, layers, int(row["entry"])), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)


def nearest(
    table: DataFrame, every: int = 100, k: int = 10, shard_rows: int = 65_536, least_rows: int = 4096, width: int = 16, beam: int = 80, search_beam: int = 120, block: int = 2048,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows."""
    small_batches(table.sparkSession)
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vec"))
    common = rows.filter("vec_id is not null and vec is not null").groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"), dim))
    index, shards = build_index(rows, k + 1, min(shard_rows, max(1, (256 << 20) // (8 * max(1, dim)))), least_rows, width, beam)
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("query", F.monotonically_increasing_id())
    asked = stored(asked.select("query", F.col("vec_id").alias("query_id"), "vec"), "queries")
    # Each shard's queries are dealt to so many tasks that all cores have work; the index is shipped once to each of them.
    cores = table.sparkSession.sparkContext.defaultParallelism
    salts = max(1, min(-(-asked.count() // block), -(-2 * cores // shards)))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(salts)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # A shard's row comes before its queries, which stream by.
    rows = parts.unionByName(asked, allowMissingColumns=True).repartition(shards * salts, "shard", "salt")
    rows = rows.sortWithinPartitions("shard", "salt", F.col("query").asc_nulls_first())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, graph, ids, ends = None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                here = (row["shard"][0].as_py(), row["salt"][0].as_py())
                query = row["query"][0].as_py()
                if query is None:
                    graph = None  # one shard's graph at a time
                    graph, ids, ends = open_graph(row.to_pylist()[0], dim)
                    at = here
                    continue
                if here != at:
                    continue  # a shard without vectors has no row
                query_id, q = row["query_id"][0].as_py(), row["vec"][0].values.to_numpy(zero_copy_only=False).astype(np.float64)
                found = []
                for d, n in graph.met(q, max(search_beam, k + 1)):
                    these = ids[ends[n - 1] if n else 0 : ends[n]].tolist()
                    if d == 0 and query_id in these:
                        these.remove(query_id)  # the query's own row, once
                    found += [(math.sqrt(d), x) for x in these]
                out += [(query, query_id, x, d) for d, x in heapq.nsmallest(k, found)]
            columns = [pa.array([r[i] for r in out], pa.float64() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score"])

    hits = rows.mapInArrow(find, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], vectors: np.ndarray, every: int = 100, k: int = 10) -> Iterator[tuple[int, int, int, float]]:
    """What nearest() approximates, for small tables in memory."""
    ids_ = np.array(ids)
    for i in np.flatnonzero(ids_ % every == 0):
        far = np.sqrt(((vectors.astype(np.float64) - vectors[i].astype(np.float64)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids_, far)) if j != i][:k]
        for rank, j in enumerate(order, 1):
            yield int(ids_[i]), rank, int(ids_[j]), float(far[j])
