"""Helpers that the operators of this folder share: shared storage, batch sizes, prefix sums, joins on hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import discard, shared_dir, stored

__all__ = ["WHITE", "WORD", "discard", "give_back", "hex_digits", "prefix_sums", "running_sums", "shared_dir", "small_batches", "spread_join", "stored", "tidy"]

#: White space of the text contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Narrow rows of one key that a task may always be given.
FEW = 1000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers hold, so that long texts don't fill them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


def give_back() -> None:
    """Give what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at the end of a task its worker gives what it has freed back to the system.

    Spark keeps several workers an executor for later tasks, and each would otherwise stay as large as its largest task.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


def hex_digits(rows: int, per_bucket: int = 512) -> int:
    """How many leading hex digits of a hash split `rows` rows into buckets of about per_bucket."""
    n = 1
    while 16**n * per_bucket < rows:
        n += 1
    return n


def bucket_offsets(totals: DataFrame, parts: Sequence[str], digits: int) -> DataFrame:
    """parts, _bucket, _offset from parts, _bucket (hex digits), _total: the totals of the buckets before.

    Many buckets are summed in two levels, so that a window holds about the square root of their number.
    """
    before = lambda *by: Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if digits <= 3:
        return totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before(*parts)), F.lit(0))).drop("_total")
    fine = totals.withColumn("_high", F.substring("_bucket", 1, digits // 2))
    high = fine.groupBy(*parts, "_high").agg(F.sum("_total").alias("_sum"))
    ahead = Window.partitionBy(*parts).orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)
    high = high.select(*parts, "_high", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    fine = fine.withColumn("_in", F.coalesce(F.sum("_total").over(before(*parts, "_high")), F.lit(0)))
    return fine.join(high, [*parts, "_high"]).select(*parts, "_bucket", (F.col("_base") + F.col("_in")).alias("_offset"))


def prefix_sums(df: DataFrame, parts: Sequence[str], key: str, digits: int, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of value over the rows of the same parts that come before, in order of the hex string `key`.

    No task holds a whole part: totals of buckets (the first digits of the key) give offsets, and rows are summed within
    their own bucket only, in order of (key, order).
    """
    rows = df.withColumn("_bucket", F.substring(key, 1, digits)).withColumn("_value", value)
    keys = [*parts, "_bucket"]
    offsets = bucket_offsets(rows.groupBy(*keys).agg(F.sum("_value").alias("_total")), parts, digits)
    local = Window.partitionBy(*keys).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    return rows.join(offsets, keys).withColumn(name, F.col("_offset") + F.col("_local")).drop("_bucket", "_value", "_local", "_offset")


def running_sums(df: DataFrame, order: Sequence[Column], values: dict[str, str]) -> DataFrame:
    """Add for each name the sum of a column over the rows before in a total order, and as name_all the sum of all rows.

    Rows are dealt by ranges of the order; a window over all ranges sees one row for each of them.
    """
    rows = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranges = rows.groupBy("_part").agg(*(F.sum(v).alias(f"_of_{n}") for n, v in values.items()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = [F.coalesce(F.sum(f"_of_{n}").over(ahead), F.lit(0)).alias(f"_at_{n}") for n in values]
    ranges = ranges.select("_part", *sums, *(F.sum(f"_of_{n}").over(every).alias(f"{n}_all") for n in values))
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *(F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_in_{n}") for n, v in values.items()))
    rows = rows.join(ranges, "_part")
    return rows.select(*df.columns, *((F.col(f"_at_{n}") + F.col(f"_in_{n}")).alias(n) for n in values), *(f"{n}_all" for n in values))


def spread_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], size: str, total: int, by: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with side on keys (not null), where a few keys may hold most of rows. Adds side's other columns.

    side has one row a key; its column `size` says how many rows have that key, `total` how many rows there are. Keys
    with more than a thousandth of all rows (and more than FEW) are fewer than 1,000: these rows of side are broadcast,
    and the rows that have found one go through the shuffle of the rest spread out by the columns `by`.
    """
    if how == "inner" and total <= FEW:  # no key can have more
        return rows.join(side, list(keys)).select(*rows.columns, *(c for c in side.columns if c not in keys))
    limit = max(FEW, total // 1000)
    values = [c for c in side.columns if c not in keys]

    def part(which: Column, name: str) -> DataFrame:
        return side.filter(which).select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), F.struct(*values).alias(f"_{name}"))

    hot, cold = part(F.col(size) > limit, "hot"), part(F.col(size) <= limit, "cold")
    # Always 0, but no literal: the optimizer would take a literal out of the join's keys, and nothing would be spread.
    cold = cold.withColumn("_rest", F.pmod(F.xxhash64(*(f"_cold_{k}" for k in keys)), F.lit(1)).cast("long"))
    match = lambda name: [F.col(k) == F.col(f"_{name}_{k}") for k in keys]
    out = rows.join(F.broadcast(hot), match("hot"), "left")
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.lit(1 << 20)) + 1).cast("long")
    out = out.withColumn("_salt", salt).join(cold, [*match("cold"), F.col("_salt") == F.col("_rest")], "left")
    found = F.coalesce("_hot", "_cold")
    out = out.withColumn("_found", found)
    if how == "inner":
        out = out.filter(F.col("_found").isNotNull())
    return out.select(*rows.columns, *(F.col("_found")[v].alias(v) for v in values))
