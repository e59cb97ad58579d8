"""Numbers of distinct values over any range of days, merged from sketches that are kept for each day and group.

A day's sketch takes at most 2**lg bytes whatever it counted, and the error of an estimate is about 1.04 / sqrt(2**lg)
(1.6 % at lg = 12). Batches append their own sketches to the folders of their days; merging a sketch twice changes
nothing, so a batch that is run again, or late rows of an old day, need no care. Ranges read the folders of their days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DistinctByDay:
    """Sketches of one column by day and group, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], lg: int = 12) -> None:
        self.spark, self.path, self.by, self.lg = spark, path, list(by), lg

    def add(self, rows: DataFrame, time: str, value: str) -> None:
        """Count the values of a batch in the days of its times; rows without a time or a value count nowhere."""
        dated = rows.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).withColumn("day", F.to_date(time))
        sketches = dated.groupBy("day", *self.by).agg(F.hll_sketch_agg(value, self.lg).alias("sketch"))
        # A day's groups lie in one file a batch.
        sketches.repartition("day").write.mode("append").partitionBy("day").parquet(self.path)

    def days(self) -> DataFrame:
        """day, groups, sketch: one row a batch."""
        return self.spark.read.parquet(self.path)

    def between(self, first: str, last: str) -> DataFrame:
        """groups, estimate: distinct values from the first to the last day, both included."""
        rows = self.days().filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        return rows.groupBy(*self.by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))

    def trailing(self, days: int) -> DataFrame:
        """groups, day, estimate: distinct values of the `days` days that end with each day that has any.

        Batches of a day are merged first, then each day's sketch goes to the windows that it is part of.
        """
        merged = self.days().groupBy("day", *self.by).agg(F.hll_union_agg("sketch").alias("sketch"))
        ends = F.sequence(F.col("day"), F.date_add("day", days - 1))
        spread = merged.select(*self.by, F.col("day").alias("of"), F.explode(ends).alias("day"), "sketch")
        out = spread.groupBy(*self.by, "day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.max("of").alias("newest"))
        return out.filter("newest = day").drop("newest")

    def compact(self, path: str) -> DistinctByDay:
        """All batches merged to one sketch a day and group, in another folder."""
        merged = self.days().groupBy("day", *self.by).agg(F.hll_union_agg("sketch").alias("sketch"))
        merged.repartition("day").write.partitionBy("day").parquet(path)
        return DistinctByDay(self.spark, path, self.by, self.lg)
