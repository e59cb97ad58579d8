"""Two versions of a table compared by trees of digests, so that only buckets of keys that differ are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored
from .maintain import difference


class HashTree:
    """The keys and marks of a table, dealt by the MD5 of the key: a leaf is its first `depth` hex digits, a node fewer.

    Each node has its number of rows and two sums of hashes of (key, mark), which don't depend on order and tell repeated
    rows from missing ones (100 bits together; a difference is missed with a chance of 2**-100). Leaves are
    summed in one aggregation, each level above from the one below. Rows lie in 16 folders by their first digit, in order
    of their leaves, so a reader of some leaves opens few folders and few row groups. Rows whose key is null are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, mark: str, depth: int = 3) -> None:
        self.spark, self.folder, self.key, self.mark, self.depth = spark, folder.rstrip("/"), key, mark, depth

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str, mark: str, depth: int = 3) -> HashTree:
        """Write the tree of rows into a new folder."""
        tree = cls(rows.sparkSession, folder, key, mark, depth)
        leaf = F.substring(F.md5(F.col(key).cast("string")), 1, depth)
        dealt = rows.filter(F.col(key).isNotNull()).select(key, mark, leaf.alias("leaf")).withColumn("part", F.substring("leaf", 1, 1))
        dealt.limit(0).write.parquet(f"{tree.folder}/shape")  # an empty table has no file in its folders that tells its columns
        dealt.repartitionByRange("leaf").sortWithinPartitions("leaf").write.partitionBy("part").parquet(f"{tree.folder}/rows")
        sums = [F.sum(F.pmod(F.xxhash64(F.lit(seed), key, mark), F.lit(1 << 50)).cast("decimal(20,0)")).alias(name) for seed, name in ((1, "one"), (2, "two"))]
        nodes = tree.rows().groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("rows"), *sums)
        for level in range(depth, -1, -1):
            nodes.write.parquet(f"{tree.folder}/level-{level}")
            sums = [F.sum(F.col(c).cast("decimal(28,0)")).cast("decimal(30,0)").alias(c) for c in ("one", "two")]
            nodes = tree.level(level).groupBy(F.substring("node", 1, level - 1).alias("node")).agg(F.sum("rows").alias("rows"), *sums) if level else nodes
        return tree

    def rows(self) -> DataFrame:
        """key, mark, leaf, part (its first digit)."""
        return self.spark.read.schema(self.spark.read.parquet(f"{self.folder}/shape").schema).parquet(f"{self.folder}/rows")

    def level(self, level: int) -> DataFrame:
        """node (its first `level` digits), rows, one, two."""
        return self.spark.read.parquet(f"{self.folder}/level-{level}")

    def differing(self, other: HashTree) -> DataFrame:
        """leaf: those that differ, found from the root down; of a level only children of nodes that differ are compared."""
        if self.depth != other.depth:
            raise ValueError("trees of different depths")
        found = None
        for level in range(self.depth + 1):
            sides = [t.level(level).select("node", F.struct("rows", "one", "two").alias(name)) for t, name in ((self, "a"), (other, "b"))]
            if found is not None:
                above = found.withColumnRenamed("node", "above")
                sides = [s.join(above, F.substring("node", 1, level - 1) == F.col("above"), "left_semi") for s in sides]
            found = sides[0].join(sides[1], "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        return found.withColumnRenamed("node", "leaf")

    def rows_of(self, leaves: DataFrame, few: int = 1000) -> DataFrame:
        """The rows of some leaves: up to `few` are named in the scan's filter, more are joined."""
        names = [r.leaf for r in leaves.limit(few + 1).collect()]
        if len(names) > few:
            return self.rows().join(leaves, "leaf", "left_semi")
        return self.rows().filter(F.col("part").isin(sorted({n[:1] for n in names})) & F.col("leaf").isin(names))

    def difference(self, other: HashTree, few: int = 1000) -> DataFrame:
        """key, action (add, delete, update): what makes the other table equal to this one."""
        leaves = stored(self.differing(other), "leaves")
        return difference(self.rows_of(leaves, few), other.rows_of(leaves, few), self.key, self.mark)
