"""Merkle dataset manifest by cogrouped subtree exchange.

1. Each row becomes a leaf digest where it lies. Leaves are numbered within their tree (one for each language, by doc_id)
   by range-sorting them and adding up counts over ranges, so that a tree is never in one task.
2. A superblock is a subtree of `fan ** levels` consecutive nodes. Every superblock reduces to one node in applyInPandas;
   these nodes are the leaves of the next round, until each tree is one node, and the trees' roots are one root.
3. Downwards, the nodes of a superblock are cogrouped with the one row that holds what lies outside of it: the siblings of
   its path to the root. The cogroup finishes the reduction inside the block, joins both parts of each proof and, at the
   leaves, folds the tampered leaf along it.

So a task holds one superblock and one path, whatever the number of rows; rounds grow with the logarithm of the rows.

Defined results: nulls in any column are `-` in a leaf; a null doc_id comes first in its tree and is never tampered with;
rows that repeat a doc_id are leaves of their own, in order of their digests (equal ones are interchangeable); a tree of
one leaf is that leaf; texts of any length are hashed whole; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, small_batches, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its number of bytes, a colon and itself, or a dash if it is null."""
    parts = (F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values))
    return F.sha2(F.concat(*parts), 256)


def depth(nodes: int, fan: int) -> int:
    """How many levels lie above so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    return levels


def reduced(nodes: list[str], fan: int, levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], at: int, fan: int) -> tuple[list[str], list[str]]:
    """For each level below the top, the digests left and right of the path from node `at`, each as one string."""
    left, right = [], []
    for nodes in levels[:-1]:
        first = at - at % fan
        left.append("".join(nodes[first:at]))
        right.append("".join(nodes[at + 1 : first + fan]))
        at //= fan
    return left, right


def numbered(leaves: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """Add idx (place within the tree), n (nodes of the tree) and _tree (place of the tree among all, in order of `tree`). Stored.

    Rows are range-sorted; what is added up over ranges has a row for each range and tree in it.
    """
    rows = ranged = stored(leaves.repartitionByRange(F.col(tree), *order).withColumn("_part", F.spark_partition_id()), "leaves")
    counts = rows.groupBy(tree, "_part").agg(F.count("*").alias("_here"))
    totals = counts.groupBy(tree).agg(F.sum("_here").alias("n"))
    # Trees are in order over the ranges: those that begin in a range are numbered there, and ranges are added up.
    begins = counts.groupBy(tree).agg(F.min("_part").alias("_begin"))
    per = begins.groupBy("_begin").agg(F.count("*").alias("_trees"))
    ahead = Window.orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_begin", F.coalesce(F.sum("_trees").over(ahead), F.lit(0)).alias("_base"))
    trees = begins.join(per, "_begin").withColumn("_tree", F.col("_base") + F.row_number().over(Window.partitionBy("_begin").orderBy(tree)) - 1)
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_here").over(before), F.lit(0))).join(totals, tree).join(trees.select(tree, "_tree"), tree)
    local = Window.partitionBy("_part", tree).orderBy(*order)
    rows = rows.withColumn("_local", F.row_number().over(local) - 1)
    rows = rows.join(offsets.drop("_here"), [tree, "_part"])
    out = stored(rows.withColumn("idx", F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset", tree, "_spread"), "numbered")
    discard(ranged)
    return out


def climbed(nodes: DataFrame, rounds: int, fan: int, levels: int, kept: list[DataFrame]) -> DataFrame:
    """One row (_tree, h) for each tree of nodes (_tree, idx, h, n); the nodes of each round are added to `kept`."""
    block = fan**levels

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        top = reduced(rows["h"].tolist(), fan, min(levels, depth(n, fan)))[-1][0]
        return pd.DataFrame({"_tree": rows["_tree"].iloc[:1], "idx": rows["idx"].iloc[:1] // block, "h": [top], "n": [-(-n // block)]})

    for _ in range(rounds):
        kept.append(nodes)
        grouped = nodes.select("_tree", "idx", "h", "n").groupBy("_tree", F.floor(F.col("idx") / block).alias("_block"))
        nodes = stored(grouped.applyInPandas(reduce, "_tree long, idx long, h string, n long"), "blocks")
    return nodes


def descended(nodes: DataFrame, outer: DataFrame, fan: int, levels: int) -> DataFrame:
    """A row of outer for each node of nodes, from the outer row (_tree, _block, subroot, root, left, right) of its block."""
    block = fan**levels

    def paths(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["_tree", "_block", "subroot", "root", "left", "right"])
        rows, path = rows.sort_values("idx"), path.iloc[0]
        levels_ = reduced(rows["h"].tolist(), fan, min(levels, depth(int(rows["n"].iloc[0]), fan)))
        own = [siblings(levels_, i, fan) for i in range(len(rows))]
        ends = {"left": [[*x[0], *path["left"]] for x in own], "right": [[*x[1], *path["right"]] for x in own]}
        return pd.DataFrame({"_tree": rows["_tree"].to_numpy(), "_block": rows["idx"].to_numpy(), "subroot": path["subroot"], "root": path["root"], **ends})

    rows = nodes.select("_tree", "idx", "h", "n").groupBy("_tree", F.floor(F.col("idx") / block).alias("_block"))
    return rows.cogroup(outer.groupBy("_tree", "_block")).applyInPandas(paths, "_tree long, _block long, subroot string, root string, left array<string>, right array<string>")


def finished(leaves: DataFrame, outer: DataFrame, fan: int, levels: int) -> DataFrame:
    """The manifest's rows, from leaves (_tree, idx, n, doc_id, h, tampered) and the outer row of each block."""
    block = fan**levels
    fields = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")

    def finish(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=list(fields))
        rows, path = rows.sort_values("idx"), path.iloc[0]
        levels_ = reduced(rows["h"].tolist(), fan, min(levels, depth(int(rows["n"].iloc[0]), fan)))
        proofs, folds = [], []
        outer_proof = "".join(x + y for x, y in zip(path["left"], path["right"], strict=True))
        for i, start in enumerate(rows["tampered"]):
            left, right = siblings(levels_, i, fan)
            proofs.append(digest("".join(x + y for x, y in zip(left, right, strict=True)) + outer_proof))
            for x, y in zip([*left, *path["left"]], [*right, *path["right"]], strict=True):
                start = digest(x + start + y)  # noqa: PLW2901
            folds.append(start)
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "leaf": rows["h"].to_numpy(), "subroot": path["subroot"], "root": path["root"], "proof_sha256": proofs, "folded_root": folds})

    rows = leaves.select("_tree", "idx", "n", F.col("doc_id").cast("string"), "h", "tampered").groupBy("_tree", F.floor(F.col("idx") / block).alias("_block"))
    return rows.cogroup(outer.groupBy("_tree", "_block")).applyInPandas(finish, "doc_id string, " + ", ".join(f"{x} string" for x in fields[1:]))


def manifest(docs: DataFrame, fan: int = 8, levels: int = 3, divisor: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `divisor` divides the crc32 of doc_id, the folded leaf has its text's A-Z lower-cased.
    """
    small_batches(docs.sparkSession)
    values = {c: F.col(c) for c in FIELDS}
    leaf = leaf_of(list(values.values()))
    tampered = leaf_of([values[c] if c != "text" else F.translate("text", UPPER, LOWER) for c in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 0, F.lit(False)) & (F.col("text").rlike("[A-Z]"))
    # A tree's name sorts as its language does, null first. Equal rows are spread over ranges by their place.
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("a"), F.col("lang")))
    leaves = docs.select("doc_id", tree.alias("_lang"), leaf.alias("h"), F.coalesce(F.when(hit, tampered), leaf).alias("tampered"), F.xxhash64(F.monotonically_increasing_id()).alias("_spread"))
    leaves = stored(leaves, "digests")
    nodes = numbered(leaves, "_lang", [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("_spread")])
    discard(leaves)
    most, trees = nodes.agg(F.max("n"), F.max("_tree")).first()
    rounds = lambda n: max(1, -(-depth(n, fan) // levels))
    inner: list[DataFrame] = []
    above: list[DataFrame] = []
    roots = climbed(nodes, rounds(most or 1), fan, levels, inner)
    tops = stored(roots.select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("idx"), "h", F.lit((trees or 0) + 1).cast("long").alias("n")), "subroots")
    root = climbed(tops, rounds((trees or 0) + 1), fan, levels, above)
    none = F.array().cast("array<string>")
    outer = root.select("_tree", F.lit(0).cast("long").alias("_block"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"), none.alias("left"), none.alias("right"))
    for level in reversed(above):
        outer = descended(level, outer, fan, levels)
    # What was a node of the top tree is the only block of a tree's last round.
    outer = outer.withColumnsRenamed({"_tree": "_top", "_block": "_tree"}).drop("_top", "subroot")
    outer = outer.join(roots.select("_tree", F.col("h").alias("subroot")), "_tree").withColumn("_block", F.lit(0).cast("long"))
    outer = outer.select("_tree", "_block", "subroot", "root", "left", "right")
    for level in reversed(inner[1:]):
        outer = descended(level, outer, fan, levels)
    out = finished(nodes, stored(outer, "paths"), fan, levels)
    discard(roots, tops, root, *inner[1:])
    kind = docs.schema["doc_id"].dataType
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("verified", F.col("folded_root") == F.col("root"))
