"""Nearest neighbours by exact distance, edges between entries, and links graded by strength."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def score(dist: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + dist)


def check_dimension(vector: Column, dim: int) -> Column:
    """The vector, or an error where its length is not dim."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} numbers, got "), F.size(vector).cast("string"))))


def top_k(chunks: DataFrame, vector: list[float] | Column, k: int, where: Column | None = None) -> DataFrame:
    """The k chunks nearest to one vector, with distance and score; ties by id. `where` acts before the cut."""
    q = F.array(*(F.lit(float(x)) for x in vector)) if isinstance(vector, list) else vector
    rows = chunks if where is None else chunks.filter(where)
    rows = rows.withColumn("distance", F.round(distance(F.col("vector"), q), 6))
    return rows.orderBy("distance", "chunk_id").limit(k).withColumn("score", F.round(score(F.col("distance")), 6)).drop("vector")


def vector_of(chunks: DataFrame, chunk_id: int) -> list[float]:
    """One chunk's vector: one row, whatever the table's size."""
    row = chunks.filter(F.col("chunk_id") == chunk_id).select("vector").first()
    if row is None:
        raise ValueError(f"no chunk {chunk_id}")
    return [float(x) for x in row["vector"]]


def batch_top_k(chunks: DataFrame, queries: DataFrame, k: int, block: int = 4096, query_block: int = 1024, drop_self: bool = False) -> DataFrame:
    """The k nearest chunks of each query (query_id, vector): query_id, chunk_id, distance, rank.

    Both sides are dealt into blocks by hash. A pair of blocks is one matrix product of bounded size that gives out
    the k best of its block a query, ties cut by chunk_id; the best of all blocks follow by rank. Neither side is broadcast.
    """
    sides = [max(1, -(-df.count() // size)) for df, size in ((chunks, block), (queries, query_block))]
    left = queries.select("query_id", F.col("vector").alias("query_vector"), F.pmod(F.xxhash64("query_id"), F.lit(sides[1])).cast("int").alias("query_part"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sides[0] - 1))))
    right = chunks.select("chunk_id", "vector", F.pmod(F.xxhash64("chunk_id"), F.lit(sides[0])).cast("int").alias("part"))
    right = right.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(sides[1] - 1))))

    def find(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        a, b = (np.stack(x.to_numpy()).astype(np.float64) for x in (q["query_vector"], c["vector"]))
        ids, asked = c["chunk_id"].to_numpy(), q["query_id"].to_numpy()
        squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]
        near = squares - 2 * a @ b.T
        if drop_self:
            near[asked[:, None] == ids[None, :]] = np.inf
        most = min(len(ids), k)
        kth = np.partition(near, most - 1, axis=1)[:, most - 1]
        # All that may tie with the k-th: the product rounds, and distances are compared at six digits.
        off = 4 * (a.shape[1] + 4) * np.finfo(float).eps * squares.max(1)
        limit = (np.sqrt(np.maximum(kth, 0) + off) + 2e-6) ** 2 + off
        parts = []
        for i in range(len(asked)):  # a query at a time, which bounds what a large tie takes
            cut = np.flatnonzero(~(near[i] > limit[i]))
            if drop_self:
                cut = cut[ids[cut] != asked[i]]
            far = np.sqrt(((a[i] - b[cut]) ** 2).sum(1)).round(6)
            first = np.lexsort((ids[cut], far))[:k]
            parts.append((np.full(len(first), asked[i]), ids[cut[first]], far[first]))
        return pd.DataFrame(dict(zip(("query_id", "chunk_id", "distance"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    keys = ["query_part", "part"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, "query_id long, chunk_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_vectors(chunks: DataFrame) -> DataFrame:
    """entry_id and the vector of its chunk with the smallest index."""
    return chunks.groupBy("entry_id").agg(F.min_by(F.struct("chunk_id", "vector"), "chunk_index").alias("first")).select("entry_id", "first.*")


def entry_edges(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Undirected edges between entries from the k nearest chunks of each query entry: a < b, best weight of a pair."""
    hits = batch_top_k(chunks, queries.select(F.col("chunk_id").alias("query_id"), "vector"), k, drop_self=True)
    ends = hits.join(queries.select(F.col("chunk_id").alias("query_id"), F.col("entry_id").alias("x")), "query_id")
    ends = ends.join(chunks.select("chunk_id", F.col("entry_id").alias("y")), "chunk_id").filter("x <> y")
    weight = F.round(score(F.col("distance")), 6)
    return ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(weight).alias("weight"))


def strength(value: Column, strong: float = 0.75, base: float = 0.5) -> Column:
    """strong from `strong` on, moderate from half way between base and strong on, else weak."""
    return F.when(value >= strong, "strong").when(value >= (strong + base) / 2, "moderate").otherwise("weak")


def related_entries(chunks: DataFrame, vector: list[float], exclude: int | None, k: int = 10, fetch: int = 20, least: float = 0.5, strong: float = 0.75, where: Column | None = None) -> DataFrame:
    """Entries near a vector: the best chunk of each, not the excluded one, scores from `least` on."""
    hits = top_k(chunks, vector, fetch, where)
    if exclude is not None:
        hits = hits.filter(F.col("entry_id") != exclude)
    best = F.row_number().over(Window.partitionBy("entry_id").orderBy("distance", "chunk_id"))
    hits = hits.withColumn("nth", best).filter("nth = 1").filter(F.col("score") >= least)
    return hits.orderBy(F.desc("score"), "chunk_id").limit(k).select("entry_id", "chunk_id", "score", strength(F.col("score"), strong, least).alias("strength"))


def from_bytes(blob: Column, dim: int) -> Column:
    """Little-endian 32-bit floats as array<float>; an error where the length isn't that of dim numbers."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return check_dimension(run(blob), dim)
