"""A crawl's frontier that remembers addresses in bitmaps, so that only possible repeats are looked up.

Each address in its normal form has a place among 2**bits, by its hash. The store holds two tables, both only appended
to: `bits`, a bitmap of 4 KB for each bucket of 32,768 places that a batch touched, and `seen`, the addresses. A new
address whose bit is not set was surely never seen; the others (repeats, and a share of about seen / 2**bits by chance)
are joined with `seen` exactly. So the result is that of `crawl.admitted`, whatever `bits` is.

A batch writes its bits before its addresses: if it dies in between, its addresses only look as if they had been seen,
and the exact join of the next attempt finds that they weren't. OR-ing a bitmap twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.storage import stored

_BITS, _SEEN = "bucket long, bitmap binary", "place long, normal string"


def bit_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap (as bitmap_construct_agg makes it) is set; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


class Frontier:
    """Addresses seen so far, under a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, bits: int = 30) -> None:
        self.spark, self.path, self.places = spark, path, 1 << bits
        for name, schema in (("bits", _BITS), ("seen", _SEEN)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def bitmaps(self) -> DataFrame:
        """bucket, bitmap: the layers of all batches merged."""
        return self._read("bits", _BITS).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def admit(self, tasks: DataFrame) -> DataFrame:
        """tasks: url, depth. The new addresses (normal, depth, url, sure), which count as seen from now on.

        Smallest depth and url of each normal form; sure: the bitmaps alone told that it is new. Null addresses are
        left out, an empty batch admits nothing.
        """
        normal = urls.untracked(F.col("url"))
        rows = tasks.filter("url is not null").withColumn("normal", normal).groupBy("normal").agg(F.min("depth").alias("depth"), F.min("url").alias("url"))
        place = F.pmod(F.xxhash64("normal"), F.lit(self.places)).cast("long")
        rows = rows.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place"))
        rows = rows.join(self.bitmaps(), "bucket", "left")
        rows = stored(rows.withColumn("sure", ~bit_set(F.col("bitmap"), F.bitmap_bit_position("place"))).drop("bitmap"), "batch")
        maybe = rows.filter("not sure").join(self._read("seen", _SEEN), ["place", "normal"], "left_anti")
        new = stored(rows.filter("sure").unionByName(maybe.select(rows.columns)), "admitted")
        bits = new.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
        bits.write.mode("append").parquet(f"{self.path}/bits")
        new.select("place", "normal").write.mode("append").parquet(f"{self.path}/seen")
        return new.select("normal", "depth", "url", "sure")
